"""Repeated passages against a brute-force search of all strings of 50 bytes."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import check
from tidemark.llm import queries, suffix


def brute(rows, length=50):
    first, out = {}, {}
    for d, t in sorted((d, t) for d, t in rows if d is not None):
        b = (t or "").encode()
        cov = np.zeros(len(b) + 1, bool)
        keys = [b[j : j + length] for j in range(len(b) - length + 1)]
        for j, w in enumerate(keys):
            if first.get(w, d) < d:
                cov[j : j + length] = True
        for w in keys:
            first.setdefault(w, d)
        kept = bytes(x for x, c in zip(b, cov) if not c)
        out[d] = (len(b), int(cov.sum()), int((np.diff(np.r_[0, cov.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = result(queries.op2_suffix(spark, sf_dir))
    want = brute(rows)
    assert got == want and any(v[1] for v in want.values())


def cases():
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("abcdé "), n))
    passage, other = word(120), word(300)
    rows = [word(80) + passage + word(200), word(400), passage, word(30) + passage[:50], word(30) + passage[:49], other, other, "a" * 500, "a" * 120, "b" * 49, "", None]
    rows += [word(60) + passage + other[40:160] + word(10) for _ in range(6)]
    rows += [other[:200] + other[200:].upper(), passage + passage]
    return list(enumerate(rows))


@pytest.mark.parametrize("params", [suffix.Params(), suffix.Params(chunk=64, block=50), suffix.Params(hot=1), suffix.Params(hot=1, kmer=12)])
def test_cases(spark, params):
    rows = cases()
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, marks string").repartition(3)
    assert result(suffix.repeats(df, params)) == brute(rows)


def test_null_ids_and_empty_table(spark):
    t = "the same passage of text that is longer than fifty bytes by far"
    df = spark.createDataFrame([(None, t), (1, t), (2, t)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix.repeats(df).collect()}
    assert got == {None: 0, 1: 0, 2: len(t)}
    assert suffix.repeats(df.limit(0)).count() == 0


def test_text_output(spark):
    p = "a passage that both documents hold and that has many bytes, é included"
    df = spark.createDataFrame([(1, "x " + p, "en"), (2, p + " tail", "fr"), (3, None, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.text, r.lang) for r in suffix.repeats(df, output="text", extra=("lang",)).collect()}
    assert got == {1: ("x " + p, "en"), 2: (" tail", "fr"), 3: (None, None)}


def test_family_scans_levels():
    """Each batch meets the levels that are there: what it settles equals a plain search, and a
    batch that shares nothing is compared with nothing."""
    f, rng = suffix.SuffixFamily(), np.random.default_rng(0)
    rows = []
    for k in range(11):
        h, c = rng.integers(0, 20, 30).astype(np.uint32), rng.integers(0, 3, 30).astype(np.uint64) << np.uint64(int(rng.integers(0, 2)) * 20)
        d, p = rng.integers(0, 50, 30), np.arange(30) + 30 * k
        rows += list(zip(h.tolist(), c.tolist(), d.tolist(), p.tolist()))
        before = f.compared
        f.add(h, c, d, p)
        assert (f.compared > before) == (k > 0)
    assert [x is not None for x in f.levels] == [True, True, False, True]
    least, contexts = {}, {}
    for h, c, d, _ in rows:
        least[h, c] = min(least.get((h, c), d), d)
        contexts.setdefault(h, set()).add(c)
    want = {(d, p): 0 if d > least[h, c] else len(contexts[h]) for h, c, d, p in rows}
    got = {(d, p): n for d, p, n in zip(*(x.tolist() for x in f.verdicts()))}
    assert got == {k: n for k, n in want.items() if n != 1}
    at = f.compared
    f.add(np.arange(100, 130).astype(np.uint32), np.zeros(30, np.uint64), np.arange(30), np.arange(30))
    assert f.compared == at


@pytest.mark.parametrize("params", [suffix.Params(), suffix.Params(block=50, hot=1)])
def test_repeated_ids(spark, params):
    """Rows of one doc_id, with equal and with other texts, have results of their own and don't remove
    each other."""
    rng = np.random.default_rng(6)
    word = lambda n: "".join(rng.choice(list("abcde "), n))
    p, q = word(90), word(70)
    rows = [(1, word(20) + p), (1, word(200) + q), (1, None), (2, p + word(30)), (2, word(300) + q + word(50) + p), (2, "short"), (3, q), (3, q), (3, p + q), (0, q[:60])]
    want = []
    for d, t in rows:
        b = (t or "").encode()
        low = {x[j : j + 50] for e, u in rows if e < d for x in [(u or "").encode()] for j in range(len(x) - 49)}
        cov = np.zeros(len(b) + 1, bool)
        for j in range(len(b) - 49):
            if b[j : j + 50] in low:
                cov[j : j + 50] = True
        want.append((d, len(b), int(cov.sum()), hashlib.sha256(bytes(x for x, c in zip(b, cov) if not c)).hexdigest()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix.repeats(df, params).collect())
    assert got == sorted(want) and any(w[2] for w in want)


def test_shards_follow_the_bytes(spark):
    rows = cases()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(suffix.repeats(df, suffix.Params(shard=100))) == brute(rows)


def test_matches_sql(spark, sf_dir):
    assert check(queries.QUERIES["op2_suffix"], queries.ORACLE_SQL["op2_suffix"], spark, sf_dir) is None


def test_many_null_ids_match_nothing_and_stay(spark):
    """A third of all rows and more without an id; their texts go through no join."""
    text = "a passage that many rows hold and that is longer than fifty bytes "
    df = spark.createDataFrame([(None if k % 3 else k, text * 2) for k in range(60)] + [(None, None)], "doc_id long, text string")
    got = suffix.repeats(df).collect()
    none = [r for r in got if r.doc_id is None]
    assert len(got) == 61 and len(none) == 41 and all(r.n_removed == 0 and r.n_spans == 0 for r in none)
    assert sorted(r.n_removed for r in got if r.doc_id is not None)[:2] == [0, 132]
    texts = suffix.repeats(df.withColumn("lang", F.lit("x")), output="text", extra=("lang",)).collect()
    assert sorted(str(r.text) for r in texts if r.doc_id is None) == sorted([text * 2] * 40 + ["None"])
