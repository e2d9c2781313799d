import zlib

import numpy as np
import pytest

from codonlake.llm import sharding

DDL = "doc_id long, text string, shard string"


def check(rows, got, shards=8):
    assert len(got) == len(rows)
    by = {k: sorted(r["slot"] for r in got if r["shard"] == k) for k in range(shards)}
    assert all(v == list(range(len(v))) for v in by.values())
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards


def test_balance_and_groups(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(rng.integers(1, 200)) + f"é{i % 700}", "x") for i in range(1500)] + [(5000 + i, "copy of one text", "y") for i in range(700)]
    got = sharding.vector_shards(spark.createDataFrame(rows, DDL)).collect()
    check(rows, got)
    text = {i: t for i, t, _ in rows}
    assert all(r["size"] == len(text[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in got)
    load = np.bincount([r["shard"] for r in got], weights=[r["size"] for r in got])
    assert load.max() - load.min() <= 0.01 * load.mean()
    tokens = np.bincount([r["shard"] for r in got], weights=[r["n_tokens"] for r in got])
    assert tokens.max() <= 1.1 * tokens.mean()


def test_small_groups_stay_together(spark):
    rows = [(i, f"text {i // 3} " * 5, None) for i in range(6000)]
    got = sharding.vector_shards(spark.createDataFrame(rows, DDL)).collect()
    home = {}
    for r in got:
        assert home.setdefault(r["doc_id"] // 3, r["shard"]) == r["shard"]


def test_large_groups_stay_whole(spark):
    """A twentieth and a tenth of all rows are copies; a group of a third of the rows fills three shards."""
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(1, 60)) + str(i), None) for i in range(2000)]
    rows += [(9000 + i, "first copy " * 5, None) for i in range(150)] + [(10000 + i, "second copy " * 4, None) for i in range(290)]
    got = sharding.vector_shards(spark.createDataFrame(rows, DDL).repartition(3)).collect()
    check(rows, got)
    for lo, hi in ((9000, 9150), (10000, 10290)):
        assert len({r["shard"] for r in got if lo <= r["doc_id"] < hi}) == 1
    load = np.bincount([r["shard"] for r in got], weights=[r["size"] for r in got])
    assert load.max() - load.min() <= 0.02 * load.mean()
    rows += [(20000 + i, "third", None) for i in range(1200)]
    got = sharding.vector_shards(spark.createDataFrame(rows, DDL)).collect()
    check(rows, got)
    assert len({r["shard"] for r in got if r["doc_id"] >= 20000}) <= 3


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [(1, "", "a"), (1, "", "a"), (None, "x" * 300_000, "b"), (2, None, None)], [(7, "same", None)] * 50])
def test_edges(spark, rows):
    got = sharding.vector_shards(spark.createDataFrame(rows, DDL)).collect()
    check(rows, got)
    assert sorted(r["size"] for r in got) == sorted(len((t or "").encode()) + 1 for _, t, _ in rows)


def test_place_takes_the_highest_dot_product():
    items = np.array([[9.0, 1.0, 1.0], [1.0, 9.0, 1.0], [8.0, 1.0, 1.0], [1.0, 8.0, 1.0]])
    out = sharding.place(items, 2)
    load = np.stack([items[out == k].sum(axis=0) for k in range(2)])
    assert np.abs(load[0] - load[1])[0] <= 1
