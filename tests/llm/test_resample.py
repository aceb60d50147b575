"""Importance resampling against a plain count of all n-grams."""

from __future__ import annotations

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.compare import check
from tidemark.llm import queries, resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def grams(text, n=2):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)], len(words)


def plain(docs, target, p=resample.Params()):
    bucket = lambda f: zlib.crc32(f.encode()) % p.buckets
    s, t = Counter(), Counter()
    feats = [grams(text, p.max_n) for _, text in docs]
    for f, _ in feats:
        s.update(map(bucket, f))
    for x in target:
        t.update(map(bucket, grams(x, p.max_n)[0]))
    whole_s, whole_t = sum(s.values()) + p.buckets, sum(t.values()) + p.buckets
    gain = lambda b: math.floor(p.scale * math.log((t[b] + 1) * whole_s / ((s[b] + 1) * whole_t)))
    out = []
    for (i, _), (f, n) in zip(docs, feats):
        w = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{p.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), w, w + math.floor(-p.scale * math.log(-math.log((h + 0.5) / 4294967296))), n, None])
    able = sorted((x for x in out if x[4] >= p.min_words), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1], x[2]))
    for k, x in enumerate(able[: p.percent * len(able) // 100]):
        x[5] = k + 1
    return sorted([(*x[:4], x[5]) for x in out], key=repr)


def got(df):
    return sorted([(r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in df.collect()], key=repr)


def test_query_matches_a_plain_count(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = plain(docs, target)
    assert got(queries.op13_resample(spark, sf_dir)) == want and sum(x[4] is not None for x in want) > 20


ODD = [(1, None), (2, ""), (3, " .,;\n"), (4, "One"), (5, "one ONE one-one"), (6, "Straße ÄÖ ９ 𝄞x y"), (7, "a b " * 30_000), (8, "x" * 100_000 + " y"), (9, " ".join(f"w{k}" for k in range(19))), (10, " ".join(f"w{k}" for k in range(20)))]
ODD += [(k, f"shared words of copy group {k % 3} " * 6) for k in range(20, 60)] + [(20, "shared words of copy " * 9), (20, "shared words of copy " * 9), (None, "no id at all " * 8), (None, "no id at all " * 8)]
TARGET = ["shared words of group", None, "", "w1 w2 w3", "one one", "Ä ß"]


def frames(spark, docs, target):
    return spark.createDataFrame([(*d, "c", 0) for d in docs], "doc_id long, text string, weight string, rank int").repartition(3), spark.createDataFrame([(k, x, 1) for k, x in enumerate(target)], "item_id long, text string, score int")


@pytest.mark.parametrize("params", [resample.Params(), resample.Params(buckets=7, max_n=4, percent=50, min_words=1, seed=3), resample.Params(max_n=1)])
def test_odd_rows(spark, params):
    assert got(resample.resample(*frames(spark, ODD, TARGET), params)) == plain(ODD, TARGET, params)


def test_blocks_change_no_count(monkeypatch):
    text = [("a b c a b " * 9 + "é" * k).encode() for k in range(9)] + [b"", b"one"]
    buf, off = np.frombuffer(b"".join(text), np.uint8), np.cumsum([0, *map(len, text)])
    p = resample.Params(buckets=97, max_n=3)
    whole = [sorted(zip(*map(np.ndarray.tolist, x[:2]))) for x in resample.features(buf, off, p)]
    for chunk, block in ((1, 1), (60, 7), (10**6, 5)):
        monkeypatch.setattr(resample, "CHUNK", chunk)
        monkeypatch.setattr(resample, "BLOCK", block)
        assert sorted(y for x in resample.features(buf, off, p) for y in zip(x[0].tolist(), x[1].tolist())) == sorted(y for x in whole for y in x)


def test_checksums_append():
    rng = np.random.default_rng(3)
    a = [rng.bytes(int(k)) for k in rng.integers(0, 50, 300)]
    b = [rng.bytes(int(k)) for k in [*rng.integers(0, 40, 298), 5_000, 70_001]]
    crc = lambda x: np.array([zlib.crc32(y) for y in x], np.uint32)
    assert (resample.Append()(crc(a), crc(b), np.array([len(x) for x in b])) == crc([x + y for x, y in zip(a, b)])).all()


def test_suffix_array():
    seq = np.random.default_rng(1).integers(0, 4, 400)
    for depth in (1, 2, 5):
        order, shared = resample.suffix_array(seq, depth)
        keys = [(*seq[i : i + depth].tolist(), *[0] * (depth - len(seq[i : i + depth]))) for i in order]
        assert keys == sorted(keys) and sorted(order) == list(range(400))
        assert all(shared[k] == next((d for d in range(depth) if keys[k][d] != keys[k - 1][d]), depth) for k in range(1, 400))


def test_empty_tables(spark):
    docs, target = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert resample.resample(docs, target).count() == 0
    one = spark.createDataFrame([(1, "w " * 25)], "doc_id long, text string")
    assert got(resample.resample(one, target)) == plain([(1, "w " * 25)], [])


def test_matches_sql(spark, sf_dir):
    assert check(queries.op13_resample, queries.ORACLE_SQL["op13_resample"], spark, sf_dir) is None


def test_odd_rows_match_sql(spark, tmp_path):
    docs, target = frames(spark, ODD, TARGET)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    target.write.parquet(f"{tmp_path}/benchmark.parquet")
    for t in "region nation customer supplier part orders lineitem events embeddings pages labels conversations".split():
        os.symlink(f"/root/testdata/sf0.001/{t}.parquet", f"{tmp_path}/{t}.parquet")
    assert check(queries.op13_resample, queries.ORACLE_SQL["op13_resample"], spark, str(tmp_path)) is None
