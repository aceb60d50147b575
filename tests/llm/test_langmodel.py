"""Counts and base scores against a plain count; the model must be a distribution and help."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, langmodel, queries

P = langmodel.Params()


def plain(rows, held):
    count = Counter()
    toks = {d: (t or "").encode().lower().split() + [None] for d, t in rows}
    for d in toks:
        if not held(d):
            count.update(toks[d])
    n, v = sum(count.values()), len(count)
    base = {d: sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t) for d, t in toks.items()}
    return {d: (held(d), len(toks[d]), sum(count[w] > 0 for w in toks[d]), n, base[d]) for d in toks}


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = plain(rows, lambda d: zlib.crc32(str(d).encode()) % 10 == 0)
    got = queries.op3_langmodel(spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and r.base_score == pytest.approx(w[4], rel=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_score_against_a_plain_scorer(spark, sf_dir):
    """The model's probability of every token, one at a time, from the weight table and plain counts."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    w = langmodel.train(df.where(~held))
    got = {r.doc_id: r.score for r in langmodel.score(df, w, held).collect()}
    words, count, leaf, texts = {}, Counter(), {}, {}
    for d, t in rows:
        col = pa.array([t])
        h, c, own = langmodel.tokens(*common.flat_text(col), 0, 1)
        texts[d] = h, c
        for x, y, z in zip(h.tolist(), c.tolist(), langmodel.leaves(h, c).tolist()):
            words[x] = y
            leaf[x] = z
        if zlib.crc32(str(d).encode()) % 10:
            count.update(h.tolist())
    in_leaf, kinds = Counter(), Counter()
    for x, n in count.items():
        in_leaf[leaf[x]] += n
        kinds[leaf[x]] += 1
    mask, bits = (1 << 64) - 1, P.bits

    def softmax(features, node):
        z = w[(1 << bits) + node].astype(np.float64)
        for f in features:
            z = z + w[((f ^ (node * 0xD6E8FEB86659FD93 & mask)) * 0x9E3779B97F4A7C15 & mask) >> (64 - bits)]
        z = np.exp(z - z.max())
        return z / z.sum()

    for d, (h, c) in list(texts.items())[:12]:
        total = 0.0
        feats = [f.tolist() for f in langmodel.contexts(h, np.zeros(len(h), int))]
        for k, x in enumerate(h.tolist()[:400]):
            a, b, e = leaf[x] >> 8, leaf[x] >> 4 & 15, leaf[x] & 15
            f = [g[k] for g in feats]
            total += math.log10(softmax(f, 0)[a])
            if a < 15:
                total += math.log10(softmax(f, 1 + a)[b]) + math.log10(softmax(f, 17 + (leaf[x] >> 4))[e])
            total += math.log10((count[x] + 0.1) / (in_leaf[leaf[x]] + 0.1 * (kinds[leaf[x]] + 1)))
        if len(h) <= 400:
            assert got[d] == pytest.approx(total, rel=1e-4)


def test_paths_are_a_distribution():
    """Over all classes, the probabilities of all paths add up to one."""
    rng = np.random.default_rng(0)
    w = rng.normal(0, 1, (P.rows, langmodel.WAYS)).astype(np.float32)
    f = [rng.integers(0, 1 << 63, 1, dtype=np.uint64) for _ in range(3)]

    def p(node):
        z, total = langmodel.exp_scores(w, langmodel.table_rows(f, np.array([node]), P))
        return z[0] / total[0]

    total = p(0)[15]
    for a in range(15):
        for b in range(16):
            total += p(0)[a] * p(1 + a)[b] * p(17 + 16 * a + b).sum()
    assert total == pytest.approx(1, abs=1e-4)


def test_training_lowers_loss():
    text = b"red fox runs home . blue hen sits here . " * 200
    buf = np.frombuffer(text, np.uint8)
    h, c, own = langmodel.tokens(buf, np.array([0, len(buf)]), 0, 1)
    w, heat = np.zeros((P.rows, langmodel.WAYS), np.float32), np.zeros(P.rows, np.float32)
    loss = lambda: -langmodel.log_paths(w, h, c, own, P).mean()
    before = loss()
    for _ in range(8):
        langmodel.train_pass(w, heat, h, c, own, P)
    assert loss() < 0.3 * before


def test_tables_meet_in_any_grouping():
    rng = np.random.default_rng(1)
    tables = [langmodel._pack_rows(rng.normal(0, 1, (5, 16)), h := rng.random(5) * (rng.random(5) > 0.3), h**2) for _ in range(9)]
    a = langmodel._open_rows(langmodel._together(tables))
    b = langmodel._open_rows(langmodel._together([langmodel._together(tables[:4]), langmodel._together(tables[4:])]))
    assert all(np.allclose(x, y, atol=2e-3) for x, y in zip(a, b))


def test_held_out_gain(spark):
    """Context must tell words apart: well beyond the unigram scores on texts left out."""
    held = [r for r in queries.op3_langmodel(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    n = sum(r.n_tokens for r in held)
    assert sum(r.score - r.base_score for r in held) / n > 0.3


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, "A a  a"), (4, "b"), (5, "a " * 300_000), (None, "b")]
    df = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, n_tokens int")
    held = F.coalesce(F.col("doc_id") == 4, F.lit(False))
    w = langmodel.train(df.where(~held))
    got = {r.doc_id: r for r in langmodel.score(df, w, held).collect()}
    assert got[1].n_tokens == got[2].n_tokens == 1 and got[3].n_tokens == 4 and got[5].n_tokens == 300_001
    assert got[4].held_out and got[4].n_known == 2 and got[4].train_tokens == 1 + 1 + 4 + 300_001 + 2
    assert all(math.isfinite(r.score) and r.score < 0 for r in got.values())
    again = {(r.doc_id, r.n_known): r.score for r in langmodel.score(df.union(df.where("doc_id = 3")), w, held).collect()}
    assert len(again) == 6  # a repeated row counts again, and both are scored alike
    empty = langmodel.score(df.limit(0), langmodel.train(df.limit(0)), held)
    assert empty.count() == 0
    none = langmodel.score(df, langmodel.train(df.limit(0)), F.lit(True)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in none)


def test_shards_follow_the_bytes(spark):
    """Many shards give the counts and scores of few."""
    rows = [(k, f"w{k % 7} w{k % 5} common " * (1 + k % 3)) for k in range(60)] + [(61, "x " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held, w = F.col("doc_id") % 4 == 0, np.zeros((P.rows, langmodel.WAYS), np.float32)
    few = sorted(map(tuple, langmodel.score(df, w, held, langmodel.Params(block=500)).collect()))
    many = sorted(map(tuple, langmodel.score(df, w, held, langmodel.Params(block=500, shard=100)).collect()))
    assert many == few


def test_null_ids_are_held_out_in_the_query(spark, tmp_path):
    spark.createDataFrame([(None, "only here")] + [(k, "a b c") for k in range(1, 9)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r for r in queries.op3_langmodel(spark, str(tmp_path)).collect() if r.doc_id is None]
    assert len(got) == 1 and got[0].held_out and got[0].n_known == 1  # the end
