"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark, sf_dir):
    from .sharding import vector_shards

    return vector_shards(table(spark, sf_dir, "documents"))


def op2_quality(spark, sf_dir):
    from .quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_chat(spark, sf_dir):
    from .chat import perspectives, spans_text

    out = perspectives(table(spark, sf_dir, "conversations"))
    return out.withColumn("mask", spans_text("spans")).drop("spans")


def op4_embeddings(spark, sf_dir):
    from .multiindex import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op6_fingerprints(spark, sf_dir):
    from .spotsigs import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op5_language(spark, sf_dir):
    from .language import language_id

    return language_id(table(spark, sf_dir, "documents"))


def op7_nbest(spark, sf_dir):
    """Digests of the three best segmentations of each whole text of `documents`."""
    from pyspark.sql import functions as F

    from .nbest import nbest

    out = nbest(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), 3, ["doc_id", "text"])
    ids = F.crc32(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"))
    return out.select("doc_id", "rank", "score", F.size("ids").alias("n_pieces"), ids.alias("ids_crc32"), (F.col("decoded") == F.col("text")).alias("round_trip"))


def op8_jaccard(spark, sf_dir):
    from .jaccard import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


def op9_urls(spark, sf_dir):
    from .urls import dated_captures, dated_entries, temporal_verdicts

    pages = table(spark, sf_dir, "pages")
    return temporal_verdicts(dated_captures(pages), dated_entries(pages))


def op10_packing(spark, sf_dir):
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


VECTORS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98
), r(id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id
), n AS (SELECT a, count(*) AS n FROM l GROUP BY a), m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT vec_id, coalesce(n, 0) AS n_links, m.c AS component_id, m.c = vec_id AS kept FROM v JOIN m ON m.id = vec_id LEFT JOIN n ON n.a = vec_id
"""
JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w
), t AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l
), r(id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id
), m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, m.c AS component_id FROM s JOIN m ON m.id = doc_id
"""


def queries():
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql():
    from . import chat, urls

    return {"op3_chat": chat.SQL, "op4_embeddings": VECTORS_SQL, "op8_jaccard": JACCARD_SQL, "op9_urls": urls.SQL}
