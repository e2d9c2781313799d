import os

import duckdb
import pytest

from pyspark.sql import functions as F
from test_jaccard import brute

import corpus_pipeline
from codonlake.llm import queries
from codonlake.llm.common import table, written

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = table(spark, SF, "documents")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == table(spark, SF, "documents").columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < sizes[0] and sizes[-1] > 0.6 * sizes[0]
    got = corpus_pipeline.run(spark, SF).select("doc_id").distinct().count()
    assert got == sizes[-1]


def test_empty_tables(spark, tmp_path):
    for t in ("documents", "labels"):
        table(spark, SF, t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_edges_and_clashing_columns(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, and extra columns whose names the stages use."""
    docs = table(spark, SF, "documents").limit(120)
    long = "A sentence about the weather in the city and what people said of it. " * 3000
    odd = spark.createDataFrame([(None, None), (None, ""), (70001, None), (70002, long), (70002, long), (70003, "***")], "doc_id long, text string")
    docs = docs.unionByName(odd, allowMissingColumns=True)
    for k, name in enumerate(("quality_score", "LANG_PRED", "lang_score", "row_a", "stay", "rank", "__quality", "rid")):
        docs = docs.withColumn(name, F.lit(k))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, SF, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    docs = table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = written(stage(spark, docs, str(tmp_path)), name)
        assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0
        docs = kept
    ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
    assert 70001 not in ids and 70003 not in ids and ids.count(70002) <= 1 and None not in ids and len(ids) > 60
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(ids)


def test_near_copies_stage_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    kept = [r["doc_id"] for r in corpus_pipeline.no_near_copies(spark, docs, SF).select("doc_id").collect()]
    want, groups = brute(rows, 5, 80)
    assert len(kept) == groups and set(kept) == {c for _, _, c in want}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    got = queries.queries()[name](spark, SF)
    want = con.sql(queries.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(want.select(*names).fetchall(), key=repr)


def test_every_operator_has_a_query():
    assert [k.split("_")[0] for k in sorted(queries.queries(), key=lambda k: int(k[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 11)]
