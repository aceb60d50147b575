"""The pipeline on planted cases and odd rows, stage by stage."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _words(rng, vocab, n):
    return " ".join(rng.choice(vocab, n))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    vocab = ["".join(rng.choice(list("abcdefghijklmnopqrst"), 6)) for _ in range(3000)]
    docs, labels = [], []
    for k in range(120):  # clean
        docs.append((k, _words(rng, vocab, 120)))
        labels.append((k, 1, 0))
    for k in range(200, 260):  # toxic
        docs.append((k, _words(rng, vocab, 60) + " zzyzxfoul zzyzxfoul " + _words(rng, vocab, 60)))
        labels.append((k, 1, 1))
    docs += [(300 + k, docs[k][1]) for k in range(10)]  # exact copies
    for k in range(10):  # near copies
        w = docs[20 + k][1].split()
        w[60] = "changed"
        docs.append((320 + k, " ".join(w)))
    passage = _words(rng, vocab, 60)
    docs += [(340 + k, _words(rng, vocab, 150) + " " + passage + " " + _words(rng, vocab, 150)) for k in range(5)]
    items = [(k, _words(rng, vocab, 30)) for k in range(3)]
    docs += [(360 + k, _words(rng, vocab, 100) + " " + items[k][1] + " " + _words(rng, vocab, 100)) for k in range(3)]
    docs += [(400, None), (401, ""), (402, None), (None, _words(rng, vocab, 80)), (403, _words(rng, vocab, 60_000))]
    rows = [(d, t, None if d is None or d % 2 else "en", None, None if t is None else len(t)) for d, t in docs]
    sf = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items + [(9, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return str(sf), passage


def test_stages(spark, planted, tmp_path):
    sf, passage = planted
    df, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, df, sf).write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        if k < 4:
            assert df.columns == list(cp.COLUMNS)
        seen.append(df.collect())
    ids = [{r.doc_id for r in rows} for rows in seen]
    toxic, copies, leaks = set(range(200, 260)), set(range(300, 310)) | set(range(320, 330)), set(range(360, 363))
    clean = set(range(120)) | set(range(340, 345)) | {400, 403, None}
    assert not ids[0] & toxic and clean | copies | leaks <= ids[0]
    assert not ids[1] & copies and clean | leaks <= ids[1] and len(ids[1] & {400, 401, 402}) == 1
    texts = {r.doc_id: r.text for r in seen[2]}
    assert clean | leaks <= ids[2] and passage in texts[340] and not any(passage in texts[k] for k in range(341, 345))
    assert all(r.text is None or r.n_chars == len(r.text) for r in seen[2])
    assert ids[3] == ids[2] - leaks
    assert ids[4] == ids[3]
    n = {}
    for r in seen[4]:
        n[r.doc_id] = n.get(r.doc_id, 0) + r.length
    assert all(n[r.doc_id] == r.doc_tokens for r in seen[4])
    got = sorted(map(str, cp.run(spark, sf).drop("sequence_id", "offset", "start", "length", "ids_crc32").distinct().collect()))
    assert got == sorted({str(x) for x in df.drop("sequence_id", "offset", "start", "length", "ids_crc32").distinct().collect()})


def test_empty_and_clashing_columns(spark, planted):
    sf, _ = planted
    df = spark.read.parquet(f"{sf}/documents.parquet").withColumns({c: df_lit() for c in ("score", "had", "marks", "component_id", "z", "item_id", "part")})
    for _, stage in cp.STAGES:
        assert stage(spark, df.limit(0), sf).count() == 0
        assert stage(spark, df.where("doc_id < 3"), sf).select("doc_id").distinct().count() == 3


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")
