"""Language identification by a convolutional network over bytes."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_batches

#: Bytes of a window; filters of each width; bytes that filters span.
WINDOW, FILTERS, WIDTHS = 128, 16, (2, 3, 4)
#: The sample that the network is fitted on: so many texts of each language at most, and so many windows of each,
#: the ones of least hash among all windows of the whole text.
TEXTS, WINDOWS = 1500, 6
#: Windows that go through the network at once.
CHUNK = 4096
#: Below this score, or without a letter, a text is rejected.
REJECT = 0.4
UNKNOWN = "und"

_letter = regex.compile(r"\p{L}").search


def windows(text: str) -> np.ndarray:
    """A whole text's bytes, lower case, as rows of WINDOW, the last one filled with zeros."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8)
    out = np.zeros((max(1, -(-len(raw) // WINDOW)), WINDOW), dtype=np.uint8)
    out.reshape(-1)[: len(raw)] = raw
    return out


@dataclass
class Network:
    langs: list[str]
    tables: dict[int, np.ndarray]  # width -> (width, 256, FILTERS)
    bias: dict[int, np.ndarray]
    out: np.ndarray  # (len(WIDTHS) * FILTERS + 1, languages)

    def compiled(self) -> list[list[tuple[int, bool, np.ndarray]]]:
        """For each width its lookups (offset, of a pair of bytes, table), pairs first."""
        found = []
        for w in WIDTHS:
            t, parts = self.tables[w].astype(np.float32), []
            for k in range(0, w - 1, 2):
                parts.append((k, True, np.ascontiguousarray((t[k][None, :, :] + t[k + 1][:, None, :]).reshape(65536, -1))))
            if w % 2:
                parts.append((w - 1, False, t[w - 1]))
            found.append(parts)
        return found


def pooled(net: Network, compiled, x: np.ndarray) -> np.ndarray:
    """The largest answer of each filter in each window, and a 1."""
    low = x.astype(np.uint16)
    pair = low[:, :-1] | (low[:, 1:] << 8)
    out = np.ones((len(x), len(WIDTHS) * FILTERS + 1), dtype=np.float32)
    for i, (w, parts) in enumerate(zip(WIDTHS, compiled)):
        n = WINDOW - w + 1
        z = None
        for k, two, t in parts:
            got = t.take((pair if two else x)[:, k : k + n], axis=0)
            z = got if z is None else np.add(z, got, out=z)
        out[:, i * FILTERS : (i + 1) * FILTERS] = np.maximum(z.max(axis=1) + net.bias[w].astype(np.float32), 0)
    return out


def predict(net: Network, compiled, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The language and its probability of each whole text: softmax over the mean of its windows' answers."""
    known = [i for i, t in enumerate(texts) if t and _letter(t)]
    langs, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    at = 0
    while at < len(known):
        rows, ids, to = 0, [], at
        parts = []
        while to < len(known) and (rows < CHUNK or not parts):
            parts.append(windows(texts[known[to]]))
            rows += len(parts[-1])
            ids.append(known[to])
            to += 1
        at = to
        x, n = np.concatenate(parts), np.array([len(p) for p in parts])
        h = np.concatenate([pooled(net, compiled, x[k : k + CHUNK]) for k in range(0, len(x), CHUNK)])
        z = h.astype(np.float64) @ net.out
        mean = np.add.reduceat(z, np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0) / n[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        for i, k, s in zip(ids, best, p[np.arange(len(p)), best]):
            langs[i], score[i] = net.langs[k], s
    return langs, score


def fit(x: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = 6, batch: int = 256, rate: float = 4e-3) -> Network:
    """Adam on the cross entropy of windows; the gradient of a filter flows to the place of its largest answer."""
    rng = np.random.default_rng(11)
    w = {("t", k): rng.normal(0, 0.1, (k, 256, FILTERS)) for k in WIDTHS} | {("b", k): np.zeros(FILTERS) for k in WIDTHS}
    w["out"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS + 1, len(langs)))
    m, v, t = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0
    weight = len(y) / len(langs) / np.maximum(np.bincount(y, minlength=len(langs)), 1)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            xb, yb = x[rows], y[rows]
            h, peaks = np.ones((len(xb), len(WIDTHS) * FILTERS + 1)), {}
            for i, k in enumerate(WIDTHS):
                n = WINDOW - k + 1
                z = sum(w["t", k][o].astype(np.float32)[xb[:, o : o + n]] for o in range(k))
                peaks[k] = z.argmax(axis=1)
                h[:, i * FILTERS : (i + 1) * FILTERS] = np.maximum(np.take_along_axis(z, peaks[k][:, None, :], axis=1)[:, 0] + w["b", k], 0)
            z = h @ w["out"]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(yb)), yb] -= 1
            p *= weight[yb][:, None] / len(yb)
            g = {"out": h.T @ p}
            dh = (p @ w["out"].T)[:, :-1] * (h[:, :-1] > 0)
            for i, k in enumerate(WIDTHS):
                d = dh[:, i * FILTERS : (i + 1) * FILTERS]
                g["b", k] = d.sum(axis=0)
                g["t", k] = np.zeros_like(w["t", k])
                for o in range(k):
                    byte = np.take_along_axis(xb, peaks[k] + o, axis=1).astype(np.int64)
                    g["t", k][o] = np.bincount((byte * FILTERS + np.arange(FILTERS)).ravel(), weights=d.ravel(), minlength=256 * FILTERS).reshape(256, FILTERS)
            t += 1
            for k, a in g.items():
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return Network(langs, {k: w["t", k] for k in WIDTHS}, {k: w["b", k] for k in WIDTHS}, w["out"])


def held_out(doc_id):
    """True in the fold whose languages are never learned; a null doc_id counts as empty text (crc32 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame) -> Network | None:
    """A network from text and non-null lang of the training folds; None where there is none.

    At most TEXTS texts of each language, those with the least hashes of doc_id and text, give up to WINDOWS
    windows each, whatever repeats. Hashes above a share that leaves twice as many are not sorted.
    """
    own = docs.select("doc_id", "lang", "text").where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    counts = own.groupBy("lang").count().collect()
    if not counts:
        return None
    spark = docs.sparkSession
    share = F.broadcast(spark.createDataFrame([(r["lang"], min(1.0, 2 * (TEXTS + 20) / r["count"])) for r in counts], "lang string, share double"))
    hashed = own.withColumn("h", F.xxhash64("doc_id", "text")).join(share, "lang")
    near = hashed.where(F.pmod(F.col("h"), F.lit(1 << 40)) < F.col("share") * (1 << 40))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(F.col("h"), F.lit(1 << 40)), "h"))
    drawn = near.withColumn("rank", rank).where(F.col("rank") <= TEXTS)

    def run(batches):
        for b in batches:
            out = {"lang": [], "x": []}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                if text and _letter(text):
                    x = windows(text)
                    if len(x) > WINDOWS:
                        x = x[np.argsort([zlib.crc32(w) for w in x], kind="stable")[:WINDOWS]]
                    out["lang"].append(lang)
                    out["x"].append(x.tobytes())
            yield out

    rows = map_batches(drawn.select("lang", "text"), run, "lang string, x binary").toPandas().sort_values(["lang", "x"])
    if not len(rows):
        return None
    langs = sorted(set(rows.lang))
    n = np.array([len(x) // WINDOW for x in rows.x])
    x = np.frombuffer(b"".join(rows.x), dtype=np.uint8).reshape(-1, WINDOW)
    y = np.repeat(np.array([langs.index(k) for k in rows.lang]), n)
    return fit(x, y, langs, epochs=int(np.clip(150_000 // max(1, len(x)), 5, 40)))


def identify(docs: DataFrame, net: Network | None, keep: list[str], lang: str, score: str) -> DataFrame:
    """The columns to keep and, under two names that are none of them, language and score of each row's whole text.

    `und` with score 0 where text is null or has no letter, and everywhere without a network.
    """
    if net is None:
        return docs.select(*keep, F.lit(UNKNOWN).alias(lang), F.lit(0.0).alias(score))
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some 100 KB

    def run(batches):
        compiled = shared.value.compiled()
        for b in batches:
            found, p = predict(shared.value, compiled, b.column("text").to_pylist())
            yield {c: b.column(c) for c in keep} | {lang: found, score: p}

    ddl = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_batches(docs.select(*dict.fromkeys([*keep, "text"])), run, f"{ddl}, `{lang}` string, `{score}` double")


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs (doc_id, text, lang; others are ignored).

    All windows of a text count, whatever its length. Rows that repeat a text get the same; of languages
    that tie the first by name is taken. A null text, or one without a letter, is `und` with score 0, and
    so is each without a learned language; an empty table gives no rows.
    """
    out = identify(docs.select("doc_id", "text"), train(docs), ["doc_id"], "lang_pred", "score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
