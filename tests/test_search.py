"""Clauses and codes by index against plain loops, on both sides of every switch."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import hv
from tidemark.operators import clauses, search

VECTORS = [(0, [1, 2, 3, 4]), (1, None), (2, []), (3, [1, 2, 3]), (4, [-1, -1, -1, -1]), (5, [0, 0, 0, 0]), (6, [1, None, 3, 4]), (7, [1, 2, 3, 4]), (8, [1, 2, 3, 4, 5])]


def frame(spark, rows=VECTORS):
    return spark.createDataFrame(rows, "id int, literals array<bigint>").repartition(3)


def mask(k: int) -> list[int]:
    return [0, 0, 0, 0] if k % 10 == 9 else [k % 4, k % 3, 0, (k // 7) % 8]


def table(spark, n):
    rows = [(k, mask(k), k % 3 + 1) for k in range(n)] + [(n, None, 1)]
    return spark.createDataFrame(rows, "clause int, include array<bigint>, weight int")


def whole(v):
    return v is not None and len(v) == 4 and None not in v


def fires(n, empty=True):
    return sorted((i, k) for i, v in VECTORS if whole(v) for k in range(n) if all(m & x == m for m, x in zip(mask(k), v)) and (empty or any(mask(k))))


@pytest.mark.parametrize("n", [10, 100, 3000])
@pytest.mark.parametrize("empty", [True, False])
def test_the_number_of_clauses_changes_nothing(spark, n, empty):
    got = clauses.fire(frame(spark), table(spark, n), empty_fires=empty).select("id", "clause").collect()
    assert sorted(map(tuple, got)) == fires(n, empty)


@pytest.mark.parametrize("n", [10, 100])
def test_matrix_fires_alike(spark, n):
    assert sorted(map(tuple, clauses.fire_numpy(frame(spark), table(spark, n)).select("id", "clause").collect())) == fires(n)


def test_index_that_is_dealt_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(search, "BROADCAST", 0)
    monkeypatch.setattr(search, "ROWS", 2)
    got = search.containing(frame(spark, VECTORS * 3), table(spark, 300))
    assert "_salt" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.select("id", "clause").collect())) == sorted(fires(300) * 3)


def test_no_clauses_and_no_rows(spark):
    none = spark.createDataFrame([], "clause int, include array<bigint>, weight int")
    for run in (clauses.fire, search.containing):
        assert run(frame(spark), none).count() == 0
        assert run(frame(spark).limit(0), table(spark, 100)).count() == 0
    assert clauses.fire_numpy(frame(spark).limit(0), table(spark, 100)).count() == 0


@pytest.mark.parametrize(("n", "most"), [(10, 10_000), (100, 10_000), (100, 30), (100, 80)])
def test_fuzzy_scores_of_any_table(spark, monkeypatch, n, most):
    monkeypatch.setattr(clauses, "MAX_CLAUSES", most)
    got = {r.id: r.score for r in clauses.fuzzy_score(frame(spark), table(spark, n), 2, 50).collect()}
    count = lambda v: sum((x & (1 << 64) - 1).bit_count() for x in v)
    for i, v in VECTORS:
        if not whole(v):
            assert got[i] is None
            continue
        total = sum(max(0, min(count(mask(k)), 2) - count([m & ~x for m, x in zip(mask(k), v)])) * (k % 3 + 1) * (1 if k % 2 == 0 else -1) for k in range(n))
        assert got[i] == max(-50, min(50, total))


def distance(a, b):
    return sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b))


@pytest.mark.parametrize("most", [5, 4096])
@pytest.mark.parametrize("n", [1, 10, 100])
def test_nearest_defines_nulls_on_all_ways(spark, n, most):
    rng = np.random.default_rng(n)
    codes = [(k, [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 4)]) for k in range(n)]
    codes = [*codes, *[(k + 1000, c) for k, c in codes[:3]]]
    rows = [*VECTORS, *[(20 + k, [c[0] ^ 5, *c[1:]]) for k, (_, c) in enumerate(codes)]]
    book = spark.createDataFrame([*codes, (-1, None)], "level int, code array<bigint>")
    got = {r.id: (r.level, r.distance) for r in hv.nearest(frame(spark, rows), book, "literals", max_levels=most).collect()}
    for i, v in rows:
        want = min((distance(v, c), k) for k, c in codes) if whole(v) else (None, None)
        assert got[i] == (want[1], want[0])
    empty = hv.nearest(frame(spark), book.limit(0), "literals").collect()
    assert len(empty) == len(VECTORS) and {(r.level, r.distance) for r in empty} == {(None, None)}


@pytest.mark.parametrize(("broadcast", "flips"), [(1 << 24, 3), (0, 3), (1 << 24, 40)])
def test_hashing_settles_near_and_far_codes(spark, monkeypatch, broadcast, flips):
    monkeypatch.setattr(search, "BROADCAST", broadcast)
    monkeypatch.setattr(search, "ROWS", 50)
    monkeypatch.setattr(search, "BLOCK", 60)
    rng = np.random.default_rng(flips)
    codes = [(k, [int(x) for x in rng.integers(0, 1 << 32, 4)]) for k in range(400)]
    rows = []
    for k in range(120):
        v = list(codes[k % 200][1])
        for b in rng.choice(128, rng.integers(0, flips + 1), replace=False):
            v[b // 32] ^= 1 << int(b % 32)
        rows.append((k, v))
    book = spark.createDataFrame([(k, c, 0) for k, c in codes], "level bigint, code array<bigint>, id int")
    got = {r.id: (r.distance, r.level) for r in search.nearest_indexed(frame(spark, rows), book, "literals", width=4, bits=32).collect()}
    assert got == {i: min((distance(v, c), k) for k, c in codes) for i, v in rows}
    other = {r.id: (r.distance, r.level) for r in search.nearest_indexed(frame(spark, rows), book, "literals", width=4, bits=32, other_than="id").collect()}
    assert other == {i: min((distance(v, c), k) for k, c in codes if k != i) for i, v in rows}


def test_workers_without_the_path_get_the_package(tmp_path):
    """A session whose Python workers can't see the repository, as on a cluster."""
    import os
    import subprocess
    import sys
    import textwrap

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
    import sys
    sys.path.insert(0, {root!r})
    from pyspark.sql import SparkSession
    from tidemark.functions import hv
    from tidemark.operators import clauses
    s = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
    df = s.createDataFrame([(1, [1, 2])], "id int, literals array<bigint>")
    many = s.createDataFrame([(k, [k % 2, k % 3], 1) for k in range(100)], "clause int, include array<bigint>, weight int")
    assert clauses.fire_numpy(df, many).count() and clauses.fuzzy_score(df, many, 2, 9).first().score is not None
    assert hv.nearest(df, many.selectExpr("clause AS level", "include AS code"), "literals").first().distance == 0
    print("DONE")
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "DONE" in out.stdout, out.stderr[-2000:]


def test_strengths_send_no_table_whole(spark, tmp_path):
    """Weights of few bytes on disk may be many rows; they are sorted and met, not broadcast."""
    rng = np.random.default_rng(5)
    rows = [(k, [int(x) & 0xFFFFFFFF for x in rng.integers(0, 1 << 62, 4)]) for k in range(60)] + [(60, None), (61, [0, 0, 0, 0]), (62, [-1, None, 3, 1 << 31])]
    c = spark.createDataFrame(rows, "clause int, include array<bigint>")
    w = spark.createDataFrame([(k % 2, k, k % 7 - 3) for k in range(63)], "class int, clause int, weight int")
    w.write.parquet(f"{tmp_path}/w")
    w = spark.read.parquet(f"{tmp_path}/w")
    for shape in (hv.Shape(4, 32, 12), hv.Shape(4, 64, 12), hv.Shape(4, 12, 12)):
        got = clauses.feature_strength(c, w, 0, shape)
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
        want: dict[int, int] = {}
        for k, v in rows[::2]:
            for i in range(len(v or []) * shape.bits):
                if v[i // shape.bits] is not None and v[i // shape.bits] >> i % shape.bits & 1:
                    want[i] = want.get(i, 0) + k % 7 - 3
        assert {r.literal: r.strength for r in got.collect()} == want


def test_clauses_of_parts_are_made_in_many_tasks(spark, sf_dir, monkeypatch):
    """The table of parts is one small file, its clauses are not."""
    from tidemark.plans import vector_queries

    monkeypatch.setattr(vector_queries, "PARTS", 50, raising=False)
    n = spark.read.parquet(f"{sf_dir}/part.parquet").count()
    got = vector_queries._part_clauses(spark, sf_dir)
    assert got.rdd.getNumPartitions() == -(-n // 50) > 1
    assert got.count() == n * vector_queries.PER_PART


def test_include_counts_need_no_fold_for_masks_of_one_width(spark, sf_dir):
    """Whole masks are counted word by word in generated code; other widths and nulls give what the fold gives."""
    from tidemark.operators import clauses
    from tidemark.plans import vector_queries

    plan = vector_queries.include_counts(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("bit_count") == vector_queries.LITERALS.words + 1 and "CASE WHEN (size(include" in plan
    rows = [(0, [1, 3, 7, -1]), (1, [0, 0, 0, 0]), (2, [-1, None, 0, 0]), (3, [5, 5]), (4, [1, 2, 4, 8, 15]), (5, []), (6, None), (7, [None, 1]), (None, [1, 1, 1, -(1 << 63)])]
    c = spark.createDataFrame(rows, "clause int, include array<bigint>")
    want = {k: None if v is None or None in v else sum((x & (1 << 64) - 1).bit_count() for x in v) for k, v in rows}
    for words in (None, 4):
        got = clauses.include_counts(c, words)
        assert got.schema == clauses.include_counts(c).schema and got.dtypes == [("clause", "int"), ("n_includes", "int")]
        assert {r.clause: r.n_includes for r in got.collect()} == want


def test_ranking_of_part_clauses_keeps_no_masks(spark, sf_dir, monkeypatch):
    """What is sorted and written is what ranks are made of."""
    from tidemark import session
    from tidemark.plans import vector_queries

    written, kept = [], session.kept
    monkeypatch.setattr(session, "kept", lambda df, label: (written.append(df.columns), kept(df, label))[1])
    vector_queries.clause_ranking(spark, sf_dir)
    assert written and not any("include" in c for c in written)


@pytest.mark.parametrize(("probe", "broadcast"), [(0, 1 << 24), (0, 0), (1, 0), (64, 0)])
def test_nearest_codes_send_no_table_whole(spark, monkeypatch, probe, broadcast):
    """By look-ups alone, by both ways and by blocks alone; rows meet what was found without a broadcast."""
    monkeypatch.setattr(search, "BROADCAST", broadcast)
    monkeypatch.setattr(search, "PROBE", probe, raising=False)
    monkeypatch.setattr(search, "SHARE", 40, raising=False)
    rng = np.random.default_rng(probe)
    rows = [(k, [int(x) for x in rng.integers(0, 1 << 16, 2)]) for k in range(150)]
    book = spark.createDataFrame([*rows, (500, rows[3][1]), (501, None)], "level bigint, code array<bigint>")
    got = search.nearest_indexed(frame(spark, rows), book, "literals", width=2, bits=16, other_than="id")
    assert "BroadcastHashJoin [_row" not in got._jdf.queryExecution().executedPlan().toString()  # ranges of places are, a row each
    codes = [*rows, (500, rows[3][1])]
    assert {r.id: (r.distance, r.level) for r in got.collect()} == {i: min((distance(v, c), k) for k, c in codes if k != i) for i, v in rows}


@pytest.mark.parametrize(("n", "masks", "empty"), [(10, 65_536, True), (300, 65_536, False), (300, 7, True)])
def test_tally_counts_what_fires(spark, monkeypatch, n, masks, empty):
    """As the fired pairs counted, with vectors and clauses that aren't whole, in one block of masks or several."""
    monkeypatch.setattr(search, "MASKS", masks)
    monkeypatch.setattr(search, "SHARE", 4)
    odd = spark.createDataFrame([(900, [1, None, 0, 0], 1), (901, [0, 0, 0], 1), (902, [], 1), (None, [0, 0, 0, 0], 1)], "clause int, include array<bigint>, weight int")
    got = search.tally(frame(spark), table(spark, n).unionByName(odd), empty_fires=empty)
    want: dict[int, list[int]] = {}
    for i, k in fires(n, empty) + ([(2, 902), (3, 901)] if empty else []):
        want.setdefault(i, []).append(k)
    assert sorted((r.id, r.n_fired, r.clause_sum) for r in got.collect()) == sorted((i, len(k), sum(k)) for i, k in want.items())
    assert search.tally(frame(spark).limit(0), table(spark, n)).count() == 0 == search.tally(frame(spark), table(spark, n).limit(0)).count()


def test_fired_clauses_of_parts_are_counted_by_mask(spark, sf_dir):
    """No row for each pair, nor for each clause that meets a literal."""
    from tidemark.plans import vector_queries

    plan = vector_queries.clause_fire_indexed(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Generate explode(array_intersect" not in plan
