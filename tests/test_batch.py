import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from codonlake import CodingSpace, CodonWeights, ForbiddenPaths, MaxHomopolymer, SpaceSpec, TandemRepeats, catalogue
from codonlake.functions import display as D
from codonlake.functions import sequence as S
from codonlake.plans import batch as B
from codonlake.sources.sites import RestrictionSite
from codonlake.streaming.spaces import count_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_catalogue_matches_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    want = duck.sql(catalogue.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rounded = lambda rows: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    assert rounded(map(tuple, got.select(*names).collect())) == rounded(want.select(*[f'"{n}"' for n in names]).fetchall())


def test_samples_are_valid(spark):
    rows = catalogue.queries()["sample_valid"](spark, SF).collect()
    assert rows and all("AAAA" not in r["cds"] for r in rows)


def test_counts_list_a_protein_once(spark, monkeypatch):
    rows = [(k, aa) for k, aa in enumerate(["MKLW", "SSRL", "MKLW"] * 40)] + [(0, "SSRL")]
    df = spark.createDataFrame(rows, "id long, aa_seq string")
    listed = []
    real = B.enumerate_native
    monkeypatch.setattr(B, "enumerate_native", lambda spaces, *a, **b: (listed.append(spaces.count()), real(spaces, *a, **b))[1])
    rule = catalogue.RULES["hairpin"][0]
    got = {r["id"]: r["n_valid"] for r in B.count_native(df, 4, [rule], ["id"], "AAGGA", "TTCCT").collect()}
    want = {aa: CodingSpace(aa, constraints=[rule], context_l="AAGGA", context_r="TTCCT").count() for aa in ("MKLW", "SSRL")}
    assert listed == [2]
    assert got == {k: want[aa] for k, aa in rows[1:-1]} | {0: want["MKLW"] + want["SSRL"]}


def test_codon_changes_are_counted_without_a_list(spark):
    ref = {"MKLW": "ATGAAACTGTGG", "SSRL": "AGCTCTCGACTT", "MWMW": "ATGTGGATGTGG"}
    df = spark.createDataFrame([(x,) for x in [*ref, "MBK", None]], "aa_seq string")
    for n in range(6):
        got = {r[0]: r[1] for r in df.select("aa_seq", B.exact_changes("aa_seq", n)).collect()}
        want = {aa: CodingSpace(aa).mutants(cds, min_codons=n, max_codons=n).count() for aa, cds in ref.items()}
        assert got == want | {"MBK": None, None: None}
    plan = catalogue.queries()["mutants_codon"](spark, SF)._jdf.queryExecution().toString()
    assert "HashJoin" not in plan and "Join Inner" not in plan and "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", ["enumerate_small", "slice_small", "enumerate_range", "fixed_codons", "pinned_codons", "mutants_nt", "unrank_index", "whole_gc"])
def test_parts_are_dealt_to_all_tasks(spark, name):
    assert catalogue.queries()[name](spark, SF).rdd.getNumPartitions() == 4


def test_counts_make_no_graph(monkeypatch):
    spec = SpaceSpec.make("MKTLEFQNGS", rules=[catalogue.RULES[k][0] for k in ("motifs", "homopolymer", "direct")])
    want = spec.graph()
    monkeypatch.setattr("codonlake.plans.kernel.compile_graph", lambda *a, **b: pytest.fail("a graph was made"))
    assert B.total(spec) == B.K.count(want, spec.logs()).total > 0


def test_whole_proteins_by_the_kernel(spark):
    q = catalogue.queries()
    whole = catalogue.whole_peptides(spark, SF)
    small = whole.orderBy(B.exact_count("aa_seq"), "p_partkey").limit(4).cache()
    assert small.count() == 4 and {len(r["aa_seq"]) for r in whole.collect()} == {10}
    every = B.enumerate_native(small, 10)
    for name, (rule, _) in catalogue.RULES.items():
        ok = B.satisfies("cds", [rule], catalogue.CONTEXT_L, catalogue.CONTEXT_R).cast("long")
        want = {r["p_partkey"]: r["n"] for r in every.groupBy("p_partkey").agg(F.sum(ok).alias("n")).collect()}
        got = {r["p_partkey"]: int(r["n_valid"]) for r in q[f"whole_{name}"](spark, SF).collect()}
        assert len(got) == 200 and {k: got[k] for k in want} == want
    near = every.where(S.nt_distance("cds", "ref").between(1, 2)).select("p_partkey", "cds")
    keys = [r["p_partkey"] for r in small.collect()]
    assert sorted(near.collect()) == sorted(q["whole_mutants_nt"](spark, SF).where(F.col("p_partkey").isin(keys)).select("p_partkey", "cds").collect())
    rank = {r["p_partkey"]: r["n"] for r in every.groupBy("p_partkey").agg(F.sum((F.col("cds") < F.col("ref")).cast("long")).alias("n")).collect()}
    assert rank == {r["p_partkey"]: int(r["rank"]) for r in q["whole_rank"](spark, SF).collect() if r["p_partkey"] in rank}


def test_counts_beyond_python_digits(spark):
    df = spark.createDataFrame([(1, "L" * 6000)], "id int, aa_seq string")
    assert len(B.count_spaces(df, B.from_columns(), ["id"]).collect()[0]["n_valid"]) == 4669


def test_one_large_space(spark):
    spec = SpaceSpec.make("MIKEY" * 20, rules=[MaxHomopolymer(4), TandemRepeats(3, 3)])
    space = CodingSpace("MIKEY" * 20, constraints=[MaxHomopolymer(4), TandemRepeats(3, 3)])
    start = space.count() // 7
    got = sorted(B.range_frame(spark, spec, start, start + 25, block=7).collect(), key=lambda r: int(r["idx"]))
    assert [r["cds"] for r in got] == list(space.enumerate_range(start, start + 25))
    stepped = sorted(B.range_frame(spark, spec, start, start + 40, 13).collect(), key=lambda r: int(r["idx"]))
    assert [r["cds"] for r in stepped] == [space[i] for i in range(start, start + 40, 13)]
    draws = B.sample_frame(spark, spec, 50, 3).collect()
    assert len(draws) == 50 and all(space.contains(r["cds"]) for r in draws)
    assert sorted(draws) == sorted(B.sample_frame(spark, spec, 50, 3).collect())


def test_stored_edges_are_read_again(spark, tmp_path):
    rules = [MaxHomopolymer(3), ForbiddenPaths([[(1, "AAA"), (3, "CTG")]])]
    df = spark.createDataFrame([(1, "KALMW"), (2, "MSSG"), (3, "WWMM")], "id int, aa_seq string")
    B.edges(df, B.from_columns(rules, weights=CodonWeights.ecoli()), ["id"]).write.parquet(str(tmp_path / "edges"))

    def fn(c):
        rng = random.Random(5)
        yield {"n": c.total, "last": c.at(c.total - 1), "rank": c.rank(c.at(c.total // 2)), "drawn": [c.draw(rng) for _ in range(20)]}

    got = {r["id"]: r for r in B.from_edges(spark.read.parquet(str(tmp_path / "edges")), ["id"], fn, "n long, last string, rank long, drawn array<string>").collect()}
    for r in df.collect():
        space = CodingSpace(r["aa_seq"], constraints=rules, codon_weights=CodonWeights.ecoli(), seed=5)
        n = space.count()
        assert (got[r["id"]]["n"], got[r["id"]]["last"], got[r["id"]]["rank"]) == (n, space[n - 1], n // 2)
        assert got[r["id"]]["drawn"] == space.sample(20)


def test_specs_as_rows(spark):
    specs = [SpaceSpec.make("MIKEY"), SpaceSpec.make("SALLY", rules=[MaxHomopolymer(2)], context_l="AA")]
    df = spark.createDataFrame([(i, s.to_json()) for i, s in enumerate(specs)], "id int, spec string")
    got = {r["id"]: int(r["n_valid"]) for r in B.count_spaces(df, B.from_json(), ["id"]).collect()}
    assert got == {i: B.counted(s).total for i, s in enumerate(specs)}


def test_plans_stay_native(spark):
    plan = catalogue.queries()["contains_membership"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    plan = catalogue.queries()["enumerate_small"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_repeat_functions_against_python(spark):
    from test_space import repeat

    rng = random.Random(4)
    rows = [("".join(rng.choice("ACGT") for _ in range(rng.randint(0, 40))),) for _ in range(300)]
    df = spark.createDataFrame(rows, "s string")
    for length, lo, hi in ((3, 0, None), (4, 3, 9), (2, 1, 2), (5, 0, 0)):
        for r in df.select("s", S.has_direct_repeat("s", length, lo, hi).alias("d"), S.has_inverted_repeat("s", length, lo, hi).alias("i")).collect():
            assert (r["d"], r["i"]) == (repeat(r["s"], length, lo, hi, False), repeat(r["s"], length, lo, hi, True))


def test_scalar_nulls_and_errors(spark):
    df = spark.createDataFrame([("atg aau",), ("ATX",), ("",), (None,), ("ATGA",)], "s string")
    got = df.select(S.normalise("s"), S.translate(S.normalise("s")), S.reverse_complement("s"), S.normalise("s", True)).collect()
    assert [r[0] for r in got] == ["ATGAAT", None, "", None, "ATGA"] and [r[1] for r in got] == ["MN", None, "", None, None]
    assert got[0][3] == "AUGAAU"
    assert df.select(S.codon_lookup("s")).collect()[2][0] is None
    with pytest.raises(Exception, match="Invalid"):
        df.select(S.normalise_strict("s")).collect()


def test_format_count_column(spark):
    rows = [0, 12, 1234, 999_999_999, 1_000_000_000, 12_345_678_901, 9_999_999_999, 5 * 10**40]
    df = spark.createDataFrame([(str(n),) for n in rows], "n string")
    assert [r[0] for r in df.select(S.format_count("n")).collect()] == [D.format_count(n) for n in rows]


def test_format_count_query_keeps_large_counts(spark, tmp_path):
    keys = [1, 31_622, 31_623, 150_000, 3_000_000_000]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r["o_orderkey"]: r["shown"] for r in catalogue.queries()["format_count"](spark, str(tmp_path)).collect()}
    assert got == {k: D.format_count(k * k) for k in keys}


def test_format_count_rounds_halves_as_sql(spark, duck, tmp_path):
    keys = [45_000, 45_001, 55_000, 65_000, 99_990, 99_999, 335_000, 450_000, 750_000, 3_016_621, 3_037_000_499]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    want = duck.sql(f"WITH orders AS (FROM '{tmp_path}/orders.parquet/*.parquet') " + catalogue.oracle_sql()["format_count"].replace("WITH x AS", ", x AS", 1)).fetchall()
    assert sorted(want) == sorted(map(tuple, catalogue.queries()["format_count"](spark, str(tmp_path)).collect()))
    rows = [10**9 * k // 8 for k in range(8, 80)] + [int(f"1{k}5{'0' * 30}") for k in range(10, 100)]
    df = spark.createDataFrame([(str(n),) for n in rows], "n string")
    assert [r[0] for r in df.select(S.format_count("n")).collect()] == [D.format_count(n) for n in rows]


def test_restriction_sites_screen_wants_whole_sites(spark, monkeypatch):
    rows = [(1, "CCGAATCC"), (2, "CCGAATTCCC"), (3, "GAGACCAA"), (4, "GCGGCCGC"), (5, "GCGGCC")]
    df = spark.createDataFrame(rows, "o_orderkey long, dna string")
    monkeypatch.setattr(catalogue, "order_dna", lambda s, d: df)
    got = {tuple(r) for r in catalogue.queries()["restriction_sites_screen"](spark, "").collect()}
    assert got == {(k, x.name, m) for k, dna in rows for x in RestrictionSite for m in x.motifs if m in dna} and {k for k, *_ in got} == {2, 3, 4}


def test_distances(spark):
    df = spark.createDataFrame([("ATGAAA", "ATGAAG"), ("ATGAAA", "CTGCCC"), ("A", "AT")], "a string, b string")
    assert [tuple(r) for r in df.select(S.nt_distance("a", "b"), S.codon_distance("a", "b")).collect()] == [(1, 1), (4, 2), (None, None)]


def test_counts_beyond_decimal(spark):
    df = spark.createDataFrame([("L" * 100,), ("MK",), ("MB",)], "aa_seq string")
    got = df.select(B.exact_count("aa_seq").alias("n"), B.log10_count("aa_seq").alias("l")).collect()
    assert got[0]["n"] is None and abs(got[0]["l"] - 77.8151) < 1e-3 and int(got[1]["n"]) == 2 and got[2]["l"] is None


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "MIKEY"), (2, "SALLY")], "id int, aa_seq string")
    df.write.parquet(str(tmp_path / "in"))
    out = count_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), B.from_columns(), ["id"])
    q = out.writeStream.format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    assert {r["id"]: r["n_valid"] for r in spark.table("counted").collect()} == {1: "24", 2: str(CodingSpace("SALLY").count())}


def test_entry_without_extras():
    import __spark_entry__ as e

    assert set(catalogue.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
