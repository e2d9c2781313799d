"""Shards by vector bin packing over bytes, tokens and rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import written

#: A group of equal texts above this share of a shard, in bytes or in rows, is packed as an item of its own.
LARGE = 1 / 64
#: Bytes that hold one token at least.
TOKEN_BYTES = 16
#: Small groups are packed in lots; there are so many lots at least, and one for each LOT_ROWS rows, at most MOST_LOTS.
LOTS, LOT_ROWS, MOST_LOTS = 4096, 1_000_000, 1 << 18


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item (bytes, tokens, rows).

    The largest item first, each goes where the dot product of its vector with the shard's residual
    capacity is highest; the capacity is the total over the number of shards in each dimension.
    Then items move or swap between the fullest and the emptiest shard while that brings their bytes closer.
    """
    total = np.maximum(items.sum(axis=0), 1)
    v = items / total
    room = np.full((shards, v.shape[1]), 1 / shards)
    out = np.zeros(len(items), dtype=np.int32)
    for i in np.argsort(-v.max(axis=1), kind="stable"):
        k = int(np.argmax(room @ v[i]))
        out[i] = k
        room[k] -= v[i]
    size = items[:, 0]
    load = np.bincount(out, weights=size, minlength=shards)
    for _ in range(50 * shards):
        hi, lo = int(np.argmax(load)), int(np.argmin(load))
        gap = load[hi] - load[lo]
        a, b = np.flatnonzero(out == hi), np.flatnonzero(out == lo)
        if gap <= 1 or not len(a):
            break
        # the move or the swap that brings the difference of the two nearest to half the gap
        order = b[np.argsort(size[b], kind="stable")]
        below = np.concatenate([[0.0], size[order]])
        want = size[a] - gap / 2
        at = np.clip(np.searchsorted(below, want), 1, len(below) - 1) if len(order) else np.zeros(len(a), dtype=int)
        at = np.where((at > 0) & (np.abs(below[np.maximum(at - 1, 0)] - want) <= np.abs(below[at] - want)), at - 1, at)
        moved = size[a] - below[at]
        best = int(np.argmin(np.abs(moved - gap / 2)))
        if not 0 < moved[best] < gap:
            break
        out[a[best]] = lo
        if at[best]:
            out[order[at[best] - 1]] = hi
        load[hi] -= moved[best]
        load[lo] += moved[best]
    return out


def vector_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, n_tokens, text_crc32, law, shard, slot, grown_shard for each row of docs (doc_id, text; others are ignored).

    The law is `bytes`: the shards' sizes (UTF-8 bytes of the text plus 1) are near equal, and tokens
    (runs of non-space characters; a token for every TOKEN_BYTES bytes where that is more, as in texts
    without spaces) and rows as near as that allows. Equal texts are a group and share a shard, however
    large; only a group that is larger than a whole shard, in bytes or in rows, is dealt to as few even
    parts as fit. What the driver packs has a fixed bound: the large groups (at most 2 * shards / LARGE)
    and lots of small groups by text hash.

    A null text counts as empty (size 1, crc 0); a null doc_id is a value like any other; repeated rows
    each get a slot, in the order of doc_id; a text of any length is one item; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = written(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.greatest(F.regexp_count(text, F.lit(r"\S+")), F.floor(F.octet_length(text) / TOKEN_BYTES)).cast("long").alias("n_tokens"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("grp"),
            F.monotonically_increasing_id().alias("rid"),
        ),
        "shards",
    )
    sums = [F.sum("size").alias("size"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n")]
    total = base.agg(*sums).first()
    if not total["n"]:
        return base.select("doc_id", "size", "n_tokens", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    shard_bytes, shard_rows = max(1, total["size"] / shards), max(1, total["n"] / shards)
    large = base.groupBy("grp").agg(*sums).where((F.col("size") > shard_bytes * LARGE) | (F.col("n") > shard_rows * LARGE))
    cuts = [(r["grp"], int(np.ceil(max(r["size"] / shard_bytes, r["n"] / shard_rows)))) for r in large.collect()]
    lots = int(min(MOST_LOTS, max(LOTS, total["n"] // LOT_ROWS)))
    firsts = np.cumsum([lots, *(n for _, n in cuts)])
    spark = docs.sparkSession
    known = spark.createDataFrame([(g, n, int(f)) for (g, n), f in zip(cuts, firsts)], "grp long, pieces int, first_lot int")
    lotted = base.join(F.broadcast(known), "grp", "left").withColumn("lot", F.when(F.col("pieces").isNull(), F.pmod("grp", F.lit(lots))).otherwise(F.col("first_lot") + F.pmod(F.xxhash64("rid"), F.col("pieces"))).cast("int"))
    rows = lotted.groupBy("lot").agg(*sums).toPandas().sort_values("lot", ignore_index=True)
    shard = place(rows[["size", "n_tokens", "n"]].to_numpy(dtype=float), shards)
    n = rows["n"].to_numpy()
    start = np.zeros(len(n), dtype=np.int64)
    for k in range(shards):
        own = shard == k
        start[own] = np.cumsum(n[own]) - n[own]
    plan = spark.createDataFrame(list(zip(rows["lot"].tolist(), shard.tolist(), start.tolist())), "lot int, shard int, start long")
    by_lot = Window.partitionBy("lot").orderBy("doc_id", "grp", "rid")
    return (
        lotted.withColumn("rank", F.row_number().over(by_lot))
        .join(F.broadcast(plan), "lot")  # at most MOST_LOTS and the pieces, some MB
        .select("doc_id", "size", "n_tokens", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
