import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codonlake.llm import language, quality
from codonlake.llm.common import table

SF = "/root/testdata/sf0.01"


def test_quality_held_out(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = quality.classify(docs, labels).join(labels, "doc_id").toPandas()
    own = got[got.held_out]
    assert (own.predicted == own.quality).mean() > 0.93
    assert own[own.quality == 1].predicted.mean() > 0.95
    assert all((got.score >= 0) & (got.score <= 1)) and all(got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id])


def test_class_prior_is_near():
    rng = np.random.default_rng(1)
    pos, neg = rng.normal(1.5, 1, (3000, 4)), rng.normal(-1.5, 1, (3000, 4))
    for share in (0.3, 0.7):
        k = int(3000 * share)
        assert abs(quality.class_prior(pos[:1500], np.concatenate([pos[1500 : 1500 + k // 2], neg[: (3000 - k) // 2]])) - share) < 0.12


def test_non_negative_risk_learns_without_negatives():
    rng = np.random.default_rng(2)
    pos, neg = rng.normal(1.2, 1, (2000, 3)), rng.normal(-1.2, 1, (2000, 3))
    w = quality._fit(pos[:1000], np.concatenate([pos[1000:1600], neg[:400]]), 0.6)
    score = lambda x: quality._forward(w, x)[1]
    assert (score(pos[1600:]) > 0).mean() > 0.85 and (score(neg[400:]) < 0).mean() > 0.85


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [(1, "", "en"), (1, "", "en"), (2, None, None), (None, "x" * 200_000, "de")]])
def test_edges(spark, rows):
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    q = quality.classify(docs, labels).collect()
    assert len(q) == len(rows) and all(r["score"] == 0.5 and r["predicted"] == 1 for r in q)
    found = language.language_id(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        assert 0 <= r["score"] <= 1 and (r["lang_pred"] == "und") == (r["doc_id"] in (1, 2) or len(rows) == 1)


def test_long_chunks_count_whole():
    a, b = "漢" * 100 + "ab1" * 1000, "漢" * 100 + "X-9" * 1000
    assert not np.allclose(*quality.features([a, b])[:, : quality.SHAPES])
    assert np.allclose(quality.features(["ab " * 9])[0, : quality.SHAPES], quality.features(["cd " * 9])[0, : quality.SHAPES])


def test_the_sample_is_bounded_whatever_repeats(spark, monkeypatch):
    monkeypatch.setattr(language, "TEXTS", 30)
    seen = []
    monkeypatch.setattr(language, "fit", lambda x, y, langs, **k: seen.append((len(x), langs)))
    rows = [(4, "the same text of one document " * 50, "en")] * 3000 + [(i, f"text {i} of many documents", "en") for i in range(3000)] + [(i, f"ein Text {i}", "de") for i in range(50)]
    language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert seen[0][1] == ["de", "en"] and seen[0][0] <= 2 * 30 * language.WINDOWS


def test_ties_and_repeated_rows(spark):
    net = language.Network(["a", "b"], {w: np.zeros((w, 256, language.FILTERS)) for w in language.WIDTHS}, {w: np.zeros(language.FILTERS) for w in language.WIDTHS}, np.zeros((len(language.WIDTHS) * language.FILTERS + 1, 2)))
    docs = spark.createDataFrame([(1, "x", 1.0)] * 3 + [(2, None, 2.0)], "doc_id long, text string, lang_pred double")
    got = language.identify(docs, net, docs.columns, "l", "s").collect()
    assert sorted((r["doc_id"], r["l"], r["s"], r["lang_pred"]) for r in got) == [(1, "a", 0.5, 1.0)] * 3 + [(2, "und", 0.0, 2.0)]


def test_language_held_out(spark):
    docs = table(spark, SF, "documents")
    got = language.language_id(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").toPandas()
    own = got[got.held_out & (got.lang_pred != "und")]
    assert (own.lang_pred == own.lang).mean() > 0.95
    assert all(got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id])
    same = docs.where("doc_id < 20").withColumn("lang", F.lit("xx")).select("doc_id", "text", "lang")
    assert same.count() == 20


def test_convolution_against_a_plain_one():
    rng = np.random.default_rng(3)
    net = language.Network(["a", "b"], {w: rng.normal(size=(w, 256, language.FILTERS)) for w in language.WIDTHS}, {w: rng.normal(size=language.FILTERS) for w in language.WIDTHS}, rng.normal(size=(len(language.WIDTHS) * language.FILTERS + 1, 2)))
    x = rng.integers(0, 256, (5, language.WINDOW)).astype(np.uint8)
    got = language.pooled(net, net.compiled(), x)
    for r in range(5):
        want = []
        for w in language.WIDTHS:
            z = np.stack([sum(net.tables[w][o][x[r, i + o]] for o in range(w)) for i in range(language.WINDOW - w + 1)])
            want += list(np.maximum(z.max(axis=0) + net.bias[w], 0))
        assert np.allclose(got[r], [*want, 1], atol=1e-4)
    text = "Straße " * 400
    assert language.windows(text).tobytes().rstrip(b"\0") == text.lower().encode()
