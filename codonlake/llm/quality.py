"""A quality classifier from trusted positives and unlabelled text (positive-unlabelled learning)."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: A text's features: how often chunks of each hashed shape occur, and the numbers of `dense`.
SHAPES, DENSE = 256, 9
#: The model is fitted on so many trusted positives and unlabelled rows at most, those with the smallest hashes of doc_id.
POSITIVES, UNLABELLED = 6000, 9000
#: Random halves on which the class prior is estimated.
SPLITS = 3
#: Characters of a chunk; a longer one, as in texts without spaces, counts as so many chunks.
CHUNK = 64
#: Below this score a text is rejected.
REJECT = 0.3

_fold = str.maketrans({c: "a" for c in map(chr, range(0x61, 0x7B))} | {c: "A" for c in map(chr, range(0x41, 0x5B))} | {c: "0" for c in "0123456789"} | {chr(c): "a" if chr(c).islower() else "A" for c in range(0xC0, 0x250) if chr(c).isalpha()})
_runs = re.compile(r"(.)\1+", re.S)


class _Shapes(dict):
    """The slot of a chunk's shape: letters, capitals and digits stand for their kind, runs for one."""

    def __missing__(self, chunk: str) -> int:
        if len(self) > 300_000:
            self.clear()
        slot = zlib.crc32(_runs.sub(r"\1", chunk.translate(_fold)).encode("utf-8", "surrogatepass")) % SHAPES
        self[chunk] = slot
        return slot


_shapes = _Shapes()


def chunked(text: str | None) -> list[str]:
    """What stands between white space, in pieces of at most CHUNK characters."""
    found = text.split() if text else []
    if found and max(map(len, found)) > CHUNK:
        return [c[k : k + CHUNK] for c in found for k in range(0, len(c), CHUNK)]
    return found


def features(texts: list[str | None]) -> np.ndarray:
    """One row per whole text; a null or empty text gives zeros but for the last column, which is 1."""
    out = np.zeros((len(texts), SHAPES + DENSE), dtype=np.float32)
    for row, text in zip(out, texts):
        chunks = chunked(text)
        n = len(chunks)
        if not n:
            row[-1] = 1
            continue
        row[:SHAPES] = np.sqrt(np.bincount(list(map(_shapes.__getitem__, chunks)), minlength=SHAPES) / n)
        lines = text.split("\n")
        distinct = len(set(chunks))
        same = sum(map(str.__eq__, chunks, chunks[1:]))
        row[SHAPES:] = (
            np.log1p(n) / 8,
            distinct / n,
            np.sqrt(distinct) / 40,
            same / n,
            len(set(lines)) / len(lines),
            min(n / len(lines), 200) / 100,
            min(len(text) / n, 40) / 10,
            np.log(n / distinct + 1e-9) / 3,
            0,
        )
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    prior: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return _forward(self.weights, (x - self.mean) / self.scale)[1]

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(features(texts)).astype(np.float64), -40, 40)))


def _forward(w, x):
    h = np.tanh(x @ w[0] + w[1])
    return h, (h @ w[2] + w[3])[:, 0]


def _fit(pos: np.ndarray, unl: np.ndarray, prior: float | None, hidden: int = 24, epochs: int = 40, batch: int = 512, rate: float = 3e-3, decay: float = 1e-4) -> list[np.ndarray]:
    """Adam on the non-negative PU risk with logistic loss; with prior None on the plain risk of pos against unl.

    The risk is prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)]). Where the part
    for the negatives falls below zero, the step goes against that part's own gradient.
    """
    rng = np.random.default_rng(7)
    d = pos.shape[1]
    w = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, 1)), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for _ in range(epochs):
        up, pp = rng.permutation(len(unl)), rng.permutation(len(pos))
        steps = max(1, len(unl) // batch)
        for k in range(steps):
            u = unl[up[k * batch : (k + 1) * batch]]
            p = pos[pp[np.arange(k * batch, (k + 1) * batch) % len(pos)]]
            x = np.concatenate([p, u])
            h, z = _forward(w, x)
            zp, zu = z[: len(p)], z[len(p) :]
            gp, gu = np.zeros(len(p)), np.zeros(len(u))
            if prior is None:
                gp, gu = (sig(zp) - 1) / len(p) / 2, sig(zu) / len(u) / 2
            else:
                negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
                if negative >= 0:
                    gp = prior * (sig(zp) - 1) / len(p) - prior * sig(zp) / len(p)
                    gu = sig(zu) / len(u)
                else:
                    gp, gu = prior * sig(zp) / len(p), -sig(zu) / len(u)
            g = np.concatenate([gp, gu])[:, None]
            dh = g @ w[2].T * (1 - h * h)
            grads = [x.T @ dh + decay * w[0], dh.sum(axis=0), h.T @ g + decay * w[2], g.sum(axis=0)]
            t += 1
            for i, a in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * a
                v[i] = 0.999 * v[i] + 0.001 * a * a
                w[i] = w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return w


def class_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The share of positives in unlabelled text: the least ratio of the rates at which both exceed a threshold.

    A plain classifier of positives against unlabelled rows ranks the halves that it has not seen; above
    a high threshold there are positives only, so the ratio of the rates is the prior there. Rare bins
    are held off by a confidence term. Each of SPLITS splits gives an upper bound; the least counts.
    """
    found = []
    for split in range(SPLITS):
        rng = np.random.default_rng(split)
        p, u = pos[rng.permutation(len(pos))], unl[rng.permutation(len(unl))]
        a, b = slice(0, None, 2), slice(1, None, 2)
        w = _fit(p[a], u[a], None, epochs=12)
        sp, su = np.sort(_forward(w, p[b])[1]), np.sort(_forward(w, u[b])[1])
        rate_p = 1 - np.searchsorted(sp, sp) / len(sp)
        rate_u = 1 - np.searchsorted(su, sp) / len(su)
        slack = np.sqrt(np.log(20) / 2 / len(sp)) + np.sqrt(np.log(20) / 2 / len(su))
        ok = rate_p > 0.05
        best = np.argmin((rate_u[ok] + slack) / rate_p[ok])
        found.append(rate_u[ok][best] / rate_p[ok][best])
    return float(np.clip(min(found), 0.05, 0.95))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from labels of the rows in the training folds; None without positives or unlabelled rows.

    Labels come only from rows whose crc32(doc_id as text) mod 5 is not 0; a doc_id with a label other
    than 1 is not trusted. Of the labels, only quality = 1 is used.
    """
    ids = docs.select("doc_id").where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).withColumn("h", F.xxhash64("doc_id"))
    trusted = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("least"), F.max("quality").alias("most")).where("least = 1 and most = 1").select("doc_id")
    pos = ids.join(trusted, "doc_id", "left_semi").dropDuplicates(["doc_id"]).orderBy("h", "doc_id").limit(POSITIVES).select("doc_id", F.lit(1).alias("is_pos"))
    unl = ids.dropDuplicates(["doc_id"]).orderBy("h", "doc_id").limit(UNLABELLED).select("doc_id", F.lit(1).alias("is_unl"))
    chosen = pos.join(unl, "doc_id", "full").select("doc_id", F.coalesce("is_pos", F.lit(0)).alias("is_pos"), F.coalesce("is_unl", F.lit(0)).alias("is_unl"))
    picked = [tuple(r) for r in chosen.collect()]
    if not picked:
        return None
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    small = F.broadcast(spark.createDataFrame(picked, f"doc_id {kind}, is_pos int, is_unl int"))

    def run(batches):
        for b in batches:
            x = features(b.column("text").to_pylist())
            yield {"doc_id": b.column("doc_id"), "is_pos": b.column("is_pos"), "is_unl": b.column("is_unl"), "x": [r.tobytes() for r in x]}

    rows = map_batches(docs.select("doc_id", "text").join(small, "doc_id"), run, f"doc_id {kind}, is_pos int, is_unl int, x binary").toPandas()
    rows = rows.assign(crc=[zlib.crc32(x) for x in rows.x]).sort_values(["doc_id", "crc"]).drop_duplicates("doc_id")
    x = np.frombuffer(b"".join(rows.x), dtype=np.float32).reshape(len(rows), -1).astype(np.float64)
    order = np.random.default_rng(3).permutation(len(rows))
    x, is_pos, is_unl = x[order], rows.is_pos.to_numpy()[order] == 1, rows.is_unl.to_numpy()[order] == 1
    if is_pos.sum() < 2 or is_unl.sum() < 2:
        return None
    mean, scale = x[is_unl].mean(axis=0), x[is_unl].std(axis=0) + 0.02
    x = (x - mean) / scale
    prior = class_prior(x[is_pos], x[is_unl])
    return Model(mean, scale, _fit(x[is_pos], x[is_unl], prior), prior)


def held_out(doc_id):
    """True in the fold whose labels are never learned; a null doc_id is in it."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def score(docs: DataFrame, model: Model | None, keep: list[str], name: str) -> DataFrame:
    """The columns to keep and, under a name that is none of them, the score (0 to 1) of each row's whole text.

    A null or empty text is scored like any other; without a model each score is 0.5.
    """
    if model is None:
        return docs.select(*keep, F.lit(0.5).alias(name))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some 50 KB

    def run(batches):
        for b in batches:
            yield {c: b.column(c) for c in keep} | {name: shared.value.score(b.column("text").to_pylist())}

    ddl = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_batches(docs.select(*dict.fromkeys([*keep, "text"])), run, f"{ddl}, `{name}` double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text; others are ignored).

    The features are rates and counts over the whole text, of any length and any number of chunks. Rows
    that repeat a text tie in score; a score of REJECT itself is predicted 1. A null or empty text is
    scored by its being empty. Without a trusted positive and unlabelled rows each score is 0.5; an empty
    table gives no rows.
    """
    out = score(docs.select("doc_id", "text"), train(docs, labels), ["doc_id"], "score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))
