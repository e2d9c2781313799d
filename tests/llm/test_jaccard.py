import re

import numpy as np
import pytest

from codonlake.llm import common, jaccard
from codonlake.llm.common import components, table


def sets_of(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < n:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute(rows, n, percent):
    s = [sets_of(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = root(i)
        least[r] = doc if least.get(r) is None else min(least[r], doc) if doc is not None else least[r]
    return sorted(((doc, len(s[i]), least[root(i)]) for i, (doc, _) in enumerate(rows)), key=repr), len({root(i) for i in range(len(rows))})


def made(seed, hot=40):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdeé"), 3))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(60):
        base = [word() for _ in range(int(rng.integers(1, 120)))]
        rows.append((len(rows), " ".join(base) + (" " + passage if i % 3 == 0 else "")))
        for _ in range(int(rng.integers(0, 4))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(0, len(copy)))] = word()
            rows.append((len(rows), "\t".join(copy).upper()))
    base = [word() for _ in range(150)]
    for _ in range(hot):
        copy = list(base)
        copy[int(rng.integers(0, 150))] = word()
        rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize(("n", "percent", "seed"), [(3, 90, 0), (3, 90, 1), (5, 80, 2), (2, 50, 3)])
def test_against_brute_force(spark, n, percent, seed, monkeypatch):
    if seed == 1:  # several groups for one first shingle
        monkeypatch.setattr(jaccard, "GROUP_SETS", 5)
    rows = made(seed)
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n, percent)
    want, parts = brute(rows, n, percent)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    kept = jaccard.keep_one(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string"), n, percent)
    assert kept.columns == ["doc_id", "text", "kept"] and kept.count() == parts


def test_hot_group_of_near_copies(spark, monkeypatch):
    """One group of 2,500 near copies in parts, with strays that miss the similarity by little."""
    monkeypatch.setattr(jaccard, "GROUP_SETS", 200)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(2500):
        copy = list(base)
        for _ in range(1 if i % 10 else 4):
            copy[int(rng.integers(0, 120))] = f"x{int(rng.integers(0, 400))}"
        rows.append((i, " ".join(copy)))
    sets = [sets_of(t, 3) for _, t in rows]
    token = {x: k for k, x in enumerate(set().union(*sets))}
    table_of = np.zeros((len(sets), len(token)), dtype=np.float32)
    for k, s in enumerate(sets):
        table_of[k, [token[x] for x in s]] = 1
    both = (table_of @ table_of.T).astype(int)
    n = both.diagonal()
    label = jaccard.spanning(100 * both >= 90 * (n[:, None] + n[None] - both))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: (int(n[i]), int(label[i])) for i in range(len(rows))} and len(set(label.tolist())) > 5


def test_bounds_are_upper_bounds():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, int(rng.integers(1, 300))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(60)]
    maps = [np.frombuffer(jaccard.bitmap(s), dtype=np.uint8) for s in sets]
    n = np.array([len(s) for s in sets])
    both = jaccard.overlaps(sets, None)
    assert (both == np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])).all()
    assert (jaccard.overlaps(sets[:20], sets[20:]) == both[:20, 20:]).all()
    for percent in (30, 60, 90):
        mask = jaccard.linked(sets, None, percent)
        assert (jaccard.pairs_that_may_link(n, maps, percent) >= mask.any(axis=1)).all()
        assert (jaccard.pairs_across(n[:20], maps[:20], n[20:], maps[20:], percent) >= mask[:20, 20:]).all()
        may = jaccard.may_link(n[:20], maps[:20], n[20:].min(), n[20:].max(), jaccard.union(maps[20:]), percent)
        assert (may >= mask[:20, 20:].any(axis=1)).all()


def test_edges(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, None), (3, ""), (4, " \t\n"), (5, "A b C d"), (None, "a b c d"), (6, "one"), (7, "ONE"), (8, "one two"), (9, "x " * 50_000), (None, "alone here now")]
    got = sorted(map(tuple, jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == brute(rows, 3, 90)[0]
    more = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, row_a int, Rank int, stay int, kept int")
    assert jaccard.keep_one(more).columns == more.columns and jaccard.keep_one(more).count() == brute(rows, 3, 90)[1]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_join(empty).collect() == [] and jaccard.keep_one(empty).collect() == []
    assert jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).count() == brute(rows, 3, 90)[1]


def test_sf_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, jaccard.jaccard_join(docs).collect()), key=repr) == brute(rows, 3, 90)[0]


def test_few_files_without_adaptive_merging(spark, monkeypatch):
    """Small tables made in many partitions are not written as as many files, and nothing of the result changes."""
    files, write = {}, jaccard.written

    def counted(df, name, scratch=None):
        out = write(df, name, scratch)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    monkeypatch.setattr(common, "written", counted)
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in held}
    rows = made(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        out = jaccard.jaccard_join(docs)
        assert out.rdd.getNumPartitions() == 1 and sorted(map(tuple, out.collect()), key=repr) == brute(rows, 3, 90)[0]
        kept = jaccard.keep_one(docs)
        assert kept.rdd.getNumPartitions() == 1 and kept.count() == brute(rows, 3, 90)[1]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {"classes", "postings", "groups", "settled", "found", "links"} <= set(files)
    assert {k: n for k, n in files.items() if n > 1 and k != "sets"} == {}


@pytest.mark.parametrize("last", [0, 50, 10**6])
def test_components(spark, last, monkeypatch):
    monkeypatch.setattr(common, "LAST", last)
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert len({got[i] for i in range(41)}) == 1 and len({got[i] for i in range(100, 160)}) == 1 and got[0] != got[100]
