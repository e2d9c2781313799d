"""Document fingerprints from spot signatures: chains of content words after common words."""

from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, mix
from .jaccard import jaccard_rows

#: Common words of English, German, French and Spanish that anchor signatures.
ANCHORS = frozenset(
    "a an and are as at be by for from in is it of on or that the this to was with "
    "das dem den der des die ein eine ist mit nicht sich und von zu "
    "au dans de du elle en est et il la le les par pour que qui sur un une "
    "con del el es las los no para por se su una y".split()
)
#: Content words of a chain.
CHAIN = 2
#: Content words of which one is an anchor too.
OWN = np.uint64(4)
#: Bytes of text that a bucket of doc_ids gets, about; and rows.
BUCKET_BYTES, BUCKET_ROWS = 4 << 20, 500
#: A longer chunk, as in texts without spaces, counts as its runs of GRAM characters, one from each place.
LONG, GRAM = 32, 4

_EDGE = "".join(chr(c) for c in range(0x21, 0xC0) if not chr(c).isalnum())
_A = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """The code of a chunk: 0 for no word, odd for an anchor, even for a content word."""

    def __missing__(self, chunk: str) -> int:
        if len(self) > 300_000:
            self.clear()
        word = chunk.strip(_EDGE).lower()
        code = (xxhash.xxh3_64_intdigest(word) | 1) ^ (word not in ANCHORS) if word else 0
        self[chunk] = code
        return code


_words = _Words()


def signatures(text: str | None) -> np.ndarray:
    """The sorted distinct 32-bit spot signatures of a whole text.

    A signature is an anchor with the CHAIN content words that follow it, other anchors skipped; the
    beginning of the text counts as an anchor, and so does about each OWN-th content word, by its hash, so
    that texts of any language have signatures from all their length. Where none of them has a chain
    (short texts), each content word begins one. A text with too few content words has one signature of
    all its words, or of the text itself where there is no word; a null or empty text has none.
    """
    if not text:
        return np.zeros(0, dtype=np.uint32)
    chunks = text.split()
    if max(map(len, chunks), default=0) > LONG:
        chunks = [g for c in chunks for g in ([c] if len(c) <= LONG else [c[k : k + GRAM] for k in range(len(c) - GRAM + 1)])]
    code = np.fromiter(map(_words.__getitem__, chunks), dtype=np.uint64, count=len(chunks))
    is_anchor = (code & np.uint64(1)).astype(bool)
    content = (code != 0) & ~is_anchor
    words = code[content]
    if len(words) < CHAIN:
        z = code[code != 0].tobytes() or text.encode("utf-8", "surrogatepass")
        return np.array([xxhash.xxh3_64_intdigest(z) & 0xFFFFFFFF], dtype=np.uint32)
    chain = words[: len(words) - CHAIN + 1]
    for k in range(1, CHAIN):
        chain = mix(chain * _A + words[k : len(words) - CHAIN + 1 + k])
    after = np.cumsum(content)[is_anchor]  # the content word that follows each anchor
    anchors = code[is_anchor]
    ok = after < len(chain)
    own = np.flatnonzero((words >> np.uint64(1)) % OWN == 0)
    own = own[own + 1 < len(chain)]
    found = mix(np.append(anchors[ok] * _A + chain[after[ok]], words[own] * _A + chain[own + 1]))
    starts = chain[:1] if len(found) else chain
    return np.unique(np.append(found, mix(starts + _A)).astype(np.uint32))


def encoded(s: np.ndarray) -> str:
    return base64.b64encode(s.astype("<u4").tobytes()).decode()


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), dtype="<u4")


def likeness(a: np.ndarray, b: np.ndarray, floor: float = 0.0) -> float:
    """The Jaccard similarity of two sorted sets, 0 where it cannot reach the floor; two empty sets are alike.

    Sets whose lengths allow less than the floor are in partitions that never meet and are not compared.
    """
    few, many = sorted((len(a), len(b)))
    if not many:
        return 1.0
    if not few or few < floor * many:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    out = both / (few + many - both)
    return out if out >= floor else 0.0


def signature_sets(texts: pa.Array) -> list[np.ndarray]:
    """The signatures of each text of a column, spread over 64 bits."""
    return [np.sort(mix(signatures(t).astype(np.uint64) + np.uint64(1))) for t in texts.to_pylist()]


def near_copies(docs: DataFrame, percent: int = 70) -> DataFrame:
    """doc_id, n_signatures, component_id of each row: documents that link at a Jaccard of `percent` of their signature sets.

    SpotSigs' search: inverted lists of the rarest signatures of each set, ordered by the length of the
    sets, so that an entry meets only sets whose length allows the similarity; then the exact Jaccard of
    what the bounds leave. See jaccard.jaccard_rows for the steps and for nulls, ties, repeated rows, very
    long texts and empty tables. A null or empty text links with nothing.
    """
    found = jaccard_rows(docs, percent=percent, sets_of_texts=signature_sets)
    return found.select("doc_id", F.col("n_shingles").alias("n_signatures"), "component_id")


def edited(text: str, following: str) -> str:
    """The text with its last third (code points, rounded down) replaced by as many first ones of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of docs (doc_id, text).

    The next document is the one before it by doc_id (descending; rows with one doc_id by the text's
    hash, null doc_ids last), after the last the first. Whole texts are dealt once, to ranges of doc_id of
    about BUCKET_BYTES; a doc_id that fills several ranges is dealt by the text's hash as well. The first
    document of each range goes to the range before it too. The driver holds two numbers for each range.

    A null text counts as empty; repeated rows are next to each other; with one row it is its own next
    document; a text of any length is one row; an empty table gives no rows. Columns of docs other than
    doc_id and text are ignored.
    """
    spark = docs.sparkSession
    least = -(1 << 63)
    src = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("at")).withColumn("tie", F.xxhash64("text"))
    total = src.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).first()
    parts = int(max(1, total["n"] // BUCKET_ROWS, (total["size"] or 0) // BUCKET_BYTES))
    found = src.approxQuantile("at", [k / parts for k in range(1, parts)], 0.25 / parts) if parts > 1 else []
    often = Counter(math.ceil(q) for q in found)
    hot = {q: n + 1 for q, n in often.items() if n > 1}  # doc_ids that fill several ranges
    cuts = np.array(sorted({*often, *(q + 1 for q in hot)}), dtype=np.int64)
    # a bucket's number counts down: 0 has the largest doc_ids; a hot one has a number for each range of ties
    wide = np.ones(len(cuts) + 1, dtype=np.int64)
    for q, n in hot.items():
        wide[np.searchsorted(cuts, q, side="right")] = n
    after = wide[::-1].cumsum()[::-1] - wide  # numbers of the buckets above

    @F.pandas_udf("long")
    def bucket_of(at: pd.Series, tie: pd.Series) -> pd.Series:
        own = np.searchsorted(cuts, at.to_numpy(), side="right")
        share = (tie.to_numpy().astype(np.float64) / 2.0**64 + 0.5).clip(0, 1 - 1e-9)
        return pd.Series(after[own] + wide[own] - 1 - np.floor(share * wide[own]).astype(np.int64))

    bucketed = src.withColumn("bucket", bucket_of("at", "tie"))
    tops = {r["bucket"]: (r["top"]["at"], r["top"]["tie"]) for r in bucketed.groupBy("bucket").agg(F.max(F.struct("at", "tie")).alias("top")).collect()}
    order = sorted(tops)
    heads = [(b, *tops[b], order[i - 1]) for i, b in enumerate(order)]
    heads = F.broadcast(spark.createDataFrame(heads, "bucket long, at long, tie long, before long"))  # a row for each range
    own = bucketed.select("bucket", F.lit(0).alias("extra"), "at", "tie", "doc_id", "text")
    copies = bucketed.join(heads, ["bucket", "at", "tie"]).select(F.col("before").alias("bucket"), F.lit(1).alias("extra"), "at", "tie", "doc_id", "text")
    dealt = own.union(copies).repartition(parts, "bucket").sortWithinPartitions("bucket", "extra", F.desc("at"), F.desc("tie")).drop("tie", "at")

    def run(batches):
        names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
        bucket, last, closed = None, None, False
        for b in batches:
            out = {k: [] for k in names}
            for where, extra, doc, text in zip(*(b.column(c).to_pylist() for c in ("bucket", "extra", "doc_id", "text"))):
                if where != bucket:
                    bucket, last, closed = where, None, False
                if closed:
                    continue
                text = text or ""
                sig = signatures(text)
                if last:
                    changed = edited(last[1], text)
                    other = signatures(changed)
                    row = last[0], len(last[1]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), encoded(last[2]), encoded(other), likeness(last[2], other), likeness(last[2], sig)
                    for k, v in zip(names, row):
                        out[k].append(v)
                last = doc, text, sig
                closed = bool(extra)
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(dealt, run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
