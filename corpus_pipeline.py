"""A corpus from raw documents to packed sequences.

Each stage is a function of (spark, docs, sf_dir); its rows are written as Parquet and read again as the
next stage's docs. A stage works on all rows that its predecessor kept. All but the last return the
columns of docs, extra ones included, whatever their names. A null or empty text is scored as such by the
first stage and, having no letter, goes in the second. Rows that repeat doc_id and text stay as one row
after the third; a null doc_id is a value like any other. Texts of any length go whole through all
stages. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonlake.llm import jaccard, language, packing, quality
from codonlake.llm.common import fresh, table, written
from codonlake.llm.queries import tokenizer_path

#: No stage can be expressed in SQL; tests/llm/test_pipeline.py tests them.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier scores 0.3 or more."""
    (score,) = fresh(docs, "quality_score")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, docs.columns, score).where(F.col(score) >= quality.REJECT).select(*docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the byte network knows: not `und`, and with a score of 0.4 or more."""
    lang, score = fresh(docs, "lang_pred", "lang_score")
    out = language.identify(docs, language.train(docs), docs.columns, lang, score)
    return out.where((F.col(lang) != language.UNKNOWN) & (F.col(score) >= language.REJECT)).select(*docs.columns)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links at a Jaccard similarity of 0.8 or more of five-word shingles."""
    return jaccard.keep_one(docs, n=5, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", good_quality), ("language", known_language), ("jaccard", no_near_copies), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
