"""Toxicity and language: held-out quality, and defined results for odd rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid, queries, toxicity

BIG = "/root/testdata/sf0.01"


def test_toxicity_held_out(spark):
    got = queries.op4_toxicity(spark, BIG)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == spark.read.parquet(f"{BIG}/documents.parquet").count()
    rows = got.where("held_out").join(spark.read.parquet(f"{BIG}/labels.parquet"), "doc_id").collect()
    pos, neg = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.75
    assert np.mean([s >= 0.7 for s in neg]) < 0.03
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)


def _labelled(spark):
    rng = np.random.default_rng(0)
    vocab = ["".join(rng.choice(list("abcdefghij"), 4)) for _ in range(200)]
    rows = [(k, " ".join(rng.choice(vocab, 60)) + (" zzyzx" * 2 if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(150)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")


def test_toxicity_cases(spark):
    docs, labels = _labelled(spark)
    model = toxicity.fit(docs, labels.union(labels.limit(5)).union(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int")))
    odd = [(1, None, "x"), (2, "", "x"), (3, "pure zzyzx zzyzx here", "x"), (4, "word " * 200_000 + "zzyzx zzyzx", "x"), (None, "zzyzx zzyzx", "x")]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(odd, "doc_id long, text string, label string"), model).collect()}
    assert got[1] == got[2] and min(got[3], got[4], got[None]) > 0.7 > got[1]
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_without_classes(spark):
    docs, labels = _labelled(spark)
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs.limit(1), none).first().score == pytest.approx(0.5)
    one = toxicity.fit(docs, labels.where("toxic = 0"))
    assert toxicity.score(docs.limit(1), one).first().score < 0.05


def test_language_held_out(spark):
    got = queries.op5_langid(spark, BIG)
    rows = got.where("held_out").join(spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == 1000


def test_language_cases(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").limit(300)
    model = langid.fit(docs.withColumn("lang", F.when(F.col("doc_id") % 7 > 0, F.col("lang"))))
    odd = [(1, None), (2, ""), (3, "123 !? 456"), (4, "the and of that with"), (None, "der die und ein " * 100_000)]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0.0 for k in (1, 2, 3))
    assert got[4].lang_pred == "en" and got[None].lang_pred == "de" and 0 < got[4].score <= 1
    nothing = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.predict(docs.limit(3), nothing).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_temperature_lowers_loss():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 500)
    z = rng.normal(0, 1, (500, 3))
    z[np.arange(500), y] += 1.5
    assert langid._temperature(z * 10, y) > 3


def _buckets(text, orders, bits):
    """The n-grams of a text and their buckets, one at a time."""
    cps = [ord(c) for c in (text or "").lower()]
    for n in orders:
        mult = (0x2C1B3C6D + 2 * n * 0x1F123BB5) & 0xFFFFFFFF | 1
        for a in range(len(cps) - n + 1):
            h = 0x811C9DC5
            for c in cps[a : a + n]:
                h = (h * 0x01000193 + c * 0x9E3779B1) & 0xFFFFFFFF
            yield ((h ^ (h >> 15)) * mult & 0xFFFFFFFF) >> (32 - bits)


def _sample_texts(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()]
    return [*(t[:3000] if t else t for t in texts), None, "", "İß ﬁ", texts[3], texts[3]]


def test_toxicity_scores_against_a_plain_scorer(spark):
    """The score of every text, from the fitted weights, with Python numbers only."""
    texts = _sample_texts(spark)
    model = toxicity.fit(*_labelled(spark))
    df = spark.createDataFrame([(k, (t or "") + (" zzyzx" if k % 5 == 0 else "") if t is not None else None, "clash") for k, t in enumerate(texts)], "doc_id long, text string, score string")
    got = toxicity.score(df, model)
    assert got.columns == ["doc_id", "text", "score"]
    for r in got.collect():
        z = model.bias + sum(float(model.weights[b]) for b in set(_buckets(r.text, model.params.orders, model.params.bits)) if abs(model.weights[b]) > 1e-7)
        assert r.score == pytest.approx(1 / (1 + np.exp(-min(30, max(-30, z)))), rel=1e-6)


def test_toxicity_features_are_count_ratios(spark):
    """Counts by class against a plain count."""
    docs, labels = _labelled(spark)
    rows = docs.join(labels, "doc_id").select(F.col("toxic").alias("label"), "text")
    p = toxicity.Params()
    seen, total = toxicity._counts(rows, p)
    want = np.zeros((2, 1 << p.bits), np.int64)
    for r in rows.collect():
        want[r.label, list(set(_buckets(r.text, p.orders, p.bits)))] += 1
    assert (seen == want).all() and total.tolist() == [100, 50]


def test_language_scores_against_a_plain_scorer(spark):
    texts = _sample_texts(spark)
    model = langid.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang_pred string, score int")
    got = langid.predict(df, model)
    assert got.columns == ["doc_id", "text", "lang_pred", "score"]
    for r in got.collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        b = list(_buckets(r.text, model.params.orders, model.params.bits))
        z = (np.array([sum(float(model.weights[x, c]) for x in b) for c in range(len(model.langs))]) / len(b) + model.bias) / model.temperature
        e = np.exp(z - z.max())
        assert r.lang_pred == model.langs[int(np.argmax(z))] and r.score == pytest.approx(e.max() / e.sum(), rel=1e-5)


def test_document_frequencies_are_of_all_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    p = langid.Params()
    df = np.zeros(1 << p.bits)
    rows = docs.collect()
    for r in rows:
        df[list(set(_buckets(r.text, p.orders, p.bits)))] += 1
    assert langid.idf(docs.repartition(3), p) == pytest.approx(np.log((1 + len(rows)) / (1 + df)) + 1)


def test_repeated_rows_are_learnt_from(spark):
    docs = spark.createDataFrame([(k // 2, "abc def ghi " * 5, "aa") if k % 4 < 2 else (k // 2, "xyz uvw rst " * 5, "bb") for k in range(80)], "doc_id long, text string, lang string")
    model = langid.fit(docs, params=langid.Params(max_rows=10))
    got = langid.predict(docs.limit(8), model).collect()
    assert [r.lang_pred for r in got] == [r.lang for r in got]
