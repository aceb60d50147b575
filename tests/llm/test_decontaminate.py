"""Planted and edited copies of items, and clean documents."""

from __future__ import annotations

import numpy as np
import pytest

from tidemark.llm import decontaminate, queries

VOCAB = ["".join(np.random.default_rng(k).choice(list("abcdefghijklmnop"), 5)) for k in range(3000)]


def prose(rng, n):
    return list(rng.choice(VOCAB, n))


def test_query_finds_whole_items(spark):
    sf = "/root/testdata/sf0.01"
    items = {r.item_id: " ".join(decontaminate_words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    docs = {r.doc_id: f" {' '.join(decontaminate_words(r.text))} " for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    exact = {(d, i) for d, t in docs.items() for i, x in items.items() if f" {x} " in t}
    got = {(r.doc_id, r.item_id): r.similarity for r in queries.op8_decontaminate(spark, sf).collect()}
    assert exact and exact <= set(got) and all(got[k] == 1.0 for k in exact)


def decontaminate_words(text):
    return "".join(chr(decontaminate._NORMAL[ord(c)]) if ord(c) < 128 else c for c in (text or "")).split()


def test_edited_and_clean(spark):
    rng = np.random.default_rng(1)
    items = [prose(rng, n) for n in (30, 25, 60, 400, 2)]
    docs, want = [], set()
    for k in range(60):
        w = prose(rng, 300)
        if k < 30:
            item = list(items[k % 4])
            for p in rng.choice(len(item), len(item) // 8, replace=False):
                item[p] = "edited"
            if k % 5 == 0:
                del item[3]
            at = int(rng.integers(0, 200))
            w[at:at] = item
            want.add((k, k % 4))
        docs.append((k, " ".join(w).upper() if k % 3 == 0 else ", ".join(w)))
    docs += [(100, " ".join(items[4])), (101, None), (102, ""), (None, " ".join(items[0]))]
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, score int")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(50, None), (51, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(df, bench).collect()}
    assert got == want | {(100, 4), (None, 0)}
    blocks = decontaminate.matches(df, bench, params=decontaminate.Params(block_chars=500))
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == got
    assert decontaminate.matches(df.limit(0), bench).count() == 0 and decontaminate.matches(df, bench.limit(0)).count() == 0


def smith_waterman(q, s, p):
    h = np.zeros((len(q) + 1, len(s) + 1), int)
    for i in range(1, len(q) + 1):
        for j in range(1, len(s) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (p.match if q[i - 1] == s[j - 1] else p.mismatch), h[i - 1, j] + p.gap, h[i, j - 1] + p.gap)
    return h.max()


@pytest.mark.parametrize("seed", range(3))
def test_alignment_scores(seed):
    rng = np.random.default_rng(seed)
    p = decontaminate.Params()
    q = [rng.integers(2, 6, rng.integers(1, 12)).astype(np.uint64) for _ in range(40)]
    s = [rng.integers(2, 6, rng.integers(1, 20)).astype(np.uint64) for _ in range(40)]
    assert decontaminate.align(q, s, p).tolist() == [smith_waterman(a, b, p) for a, b in zip(q, s)]


def test_every_alignment_is_found(spark):
    """Against the alignment of all pairs: common items, halves, and edits that leave no three words."""
    rng = np.random.default_rng(6)
    items = [prose(rng, n) for n in (3, 4, 5, 12, 20, 36, 60, 61)]
    docs = []

    def plant(w):
        d = prose(rng, 150)
        d[70:70] = w
        docs.append(d)

    for item in items:
        m = len(item)
        third = ["edited" if k % 3 == 2 else w for k, w in enumerate(item)]
        for _ in range(8):
            plant(item)
            plant(item[m // 2 :])
            plant(third[: m // 2] + item[m // 2 :])
        plant(third)
        plant([w for k, w in enumerate(item) if k % 3 < 2])
        plant([w for x in item for w in (x, "more")][:-1])
        plant(item[: m // 2] + prose(rng, m // 4) + item[m // 2 :])
        for share in (0.2, 0.3, 0.4):
            plant([w if rng.random() > share else "edited" for w in item])
            plant([w for w in item if rng.random() > share])
    docs.append(items[3] * 20)
    p = decontaminate.Params()
    hashed = decontaminate._item_words([" ".join(w) for w in items + docs])
    q, s = hashed[: len(items)], hashed[len(items) :]
    want = {}
    for i, x in enumerate(q):
        for d, score in enumerate(decontaminate.align([x] * len(s), s, p).tolist()):
            if score >= p.threshold * p.match * len(x):
                want[d, i] = score
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    assert len(want) > 200
    for p in (p, decontaminate.Params(min_seeds=1)):
        assert {(r.doc_id, r.item_id): r.score for r in decontaminate.matches(df, bench, params=p).collect()} == want


def test_query_against_all_pairs(spark, sf_dir):
    """Every document of the table against every item, aligned in whole."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()
    p = decontaminate.Params()
    q, s = decontaminate._item_words([r.text for r in items]), decontaminate._item_words([r.text for r in docs])
    want = {}
    for item, x in zip(items, q):
        for d, score in zip(docs, decontaminate.align([x] * len(s), s, p).tolist()):
            if len(x) and score >= p.threshold * p.match * len(x):
                want[d.doc_id, item.item_id] = score
    got = {(r.doc_id, r.item_id): r.score for r in queries.op8_decontaminate(spark, sf_dir).collect()}
    assert got == want and want


def test_repeated_items_and_documents(spark):
    rng = np.random.default_rng(4)
    a, b = prose(rng, 20), prose(rng, 30)
    docs = spark.createDataFrame([(1, " ".join(a)), (1, " ".join(a)), (2, " ".join(prose(rng, 200_000) + b + prose(rng, 10)))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(a)), (8, " ".join(a)), (None, " ".join(a)), (9, " ".join(b)), (9, " ".join(b))], "item_id long, text string")
    for p in (decontaminate.Params(), decontaminate.Params(block_chars=10)):
        got = sorted(((r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench, params=p).collect()), key=str)
        assert got == sorted([(1, 7), (1, 8), (1, None)] * 2 + [(2, 9)] * 2, key=str)
