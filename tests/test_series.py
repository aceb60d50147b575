"""Places, chunks and carries against whole-table windows and loops."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import features, hmm, labels, ordering, splits, strategy
from tidemark.operators.series import Series

T0, HOUR = dt.datetime(2024, 1, 1), dt.timedelta(hours=1)
SYMBOLS = ("MAIN", "EUR", "EURJPY", "AUDJPY", "IEF", "JGB", "WTI")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_places_over_many_ranges(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("x"), (F.col("id") % 3).alias("tie"), F.lit("s").alias("_p1")).repartition(7)
    out = ordering.numbered(df, ["x"], ranges=20)
    assert not any(k in plan(out) for k in ("Python", "SinglePartition", "Window"))
    rows = out.orderBy("x").collect()
    assert [r["_i"] for r in rows] == list(range(5000)) and {r["_n"] for r in rows} == {5000}
    down = ordering.numbered(df, [F.col("tie").desc(), "x"], place="at", size="of", ranges=20).orderBy(F.col("tie").desc(), "x").collect()
    assert [r["at"] for r in down] == list(range(5000))


@pytest.mark.parametrize("ranges", [1, 3, 20])
def test_places_within_groups(spark, ranges):
    """One group with most rows, groups of one row, a null group, all in the same ranges."""
    keys = ["a"] * 2000 + [f"k{k}" for k in range(200)] + ["m"] * 300 + [None] * 50 + ["z"] * 1
    df = spark.createDataFrame([(k, (i * 31) % 9973) for i, k in enumerate(keys)], "k string, x int").repartition(5)
    w = Window.partitionBy("k")
    want = sorted(df.select("k", "x", (F.row_number().over(w.orderBy("x")) - 1).alias("i"), F.count("*").over(w).alias("n")).collect(), key=str)
    got = sorted(ordering.numbered(df, ["x"], ["k"], ranges=ranges).select("k", "x", F.col("_i").cast("int").alias("i"), F.col("_n").alias("n")).collect(), key=str)
    assert got == want


def test_places_of_ties_and_of_nothing(spark):
    same = spark.createDataFrame([(1, "x")] * 500 + [(None, "y")] * 10, "v int, s string")
    assert sorted(r["_i"] for r in ordering.numbered(same, ["v"], ranges=9).collect()) == list(range(510))
    assert ordering.numbered(same.limit(0), ["v"]).count() == 0 and ordering.numbered(same.limit(0), ["v"], ["s"]).count() == 0


def wide(spark, groups=("g",), n=170, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for g in groups:
        for k in range(n if g != "short" else 3):
            rows.append((g, T0 + k * HOUR, *[round(float(x), 4) if rng.random() < 0.6 else None for x in rng.uniform(0, 3, len(SYMBOLS))]))
    return spark.createDataFrame(rows, "g string, ts timestamp_ntz, " + ", ".join(f"{s} double" for s in SYMBOLS)).repartition(3)


def sortable(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("by", [(), ("g",)])
def test_assemble_does_not_depend_on_chunks(spark, by):
    df = wide(spark, ("g", "short", None) if by else ("g",))
    df = df if by else df.drop("g")
    out = [features.assemble(df, features.Roles(main="MAIN"), by=by, chunks=k) for k in (1, 3, 16)]
    first, *rest = [sortable(x.collect()) for x in out]
    assert len(first) > 80 and all(x == first for x in rest)  # to the last digit
    assert all("SinglePartition" not in plan(x) for x in out)


def test_assemble_equals_whole_windows(spark):
    df = wide(spark).drop("g")
    w = Window.partitionBy().orderBy("ts")
    whole = df.withColumns({f"f{s}": features.forward_fill(s, w) for s in SYMBOLS}).withColumns({"i": F.row_number().over(w) - 1, "late": features.delayed_fill("IEF", w, 25)})
    whole = features.with_efficiency(whole.withColumns({"atr": features.normalized_atr("fMAIN", w), "ret": features.log_return("fMAIN", w)}), "MAIN", "er")
    whole = whole.withColumns({"da": features.delta("atr", w), "de": features.delta("er", w)}).where("i >= 25 AND MAIN IS NOT NULL")
    want = sortable(tuple(r) for r in whole.select("ts", "ret", "atr", "er", "late", "da", "de").collect())
    got = features.assemble(df, features.Roles(main="MAIN"), chunks=9).select("ts", "usdjpy_price", "usdjpy_atr", "usdjpy_er", "us_bond_level", "atr_delta", "er_delta")
    assert sortable(tuple(r) for r in got.collect()) == want


@pytest.mark.parametrize("chunks", [3, 16, 400])
def test_labels_and_strategy_do_not_depend_on_chunks(spark, chunks):
    ret = np.random.default_rng(1).normal(0, 0.1, 400).round(4).tolist()
    df = spark.createDataFrame([(g, T0 + k * HOUR, x) for g in ("a", "b") for k, x in enumerate(ret[: 400 if g == "a" else 130])], "g string, ts timestamp_ntz, ret_pct double")

    def run(k):
        lab = labels.labelled(df, by=("g",), chunks=k)
        lag = labels.lagged_label(lab)
        return [sortable(x.collect()) for x in (lag, strategy.momentum_sortino(df, by=("g",), chunks=k), splits.chronological(lab, params=splits.Params(20, 10, 5)), splits.sequential(lab), hmm.transitions(lab))]

    assert run(chunks) == run(1)


def test_fill_carries_over_empty_chunks(spark):
    values = [None, 1.0, *[None] * 20, 2.0, *[None] * 9]
    df = spark.createDataFrame([(T0 + k * HOUR, v, None) for k, v in enumerate(values)], "ts timestamp_ntz, x double, never double")
    got = Series.of(df, chunks=8).filled({"f": F.col("x"), "n": F.col("never"), "late": F.when(F.col("_i") >= 5, F.col("x"))}).frame().orderBy("ts").collect()
    assert [r.f for r in got] == [None, *[1.0] * 21, *[2.0] * 10] and {r.n for r in got} == {None}
    assert [r.late for r in got] == [*[None] * 22, *[2.0] * 10]
    assert Series.of(df.limit(0)).filled({"f": F.col("x")}, 0.0).frame().count() == 0


def test_rounds_equal_a_window_for_each_class(spark):
    df = spark.range(900).select("id", F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id") % 10).cast("int").alias("label"))
    w = Window.partitionBy("label").orderBy(splits.hash_place(F.col("id")), "id")
    want = sortable(df.withColumn("round", F.row_number().over(w) - 1).where("round < 90").collect())
    got = splits.balanced_rounds(df, "label", "id")
    assert sortable(got.select("id", "label", "round").collect()) == want


# As-of with hot keys, and sequences in blocks ------------------------------------------------


@pytest.mark.parametrize("chunks", [None, 1, 16])
def test_as_of_with_a_hot_key_equals_asof(spark, chunks):
    import duckdb
    import pandas as pd

    from tidemark.operators import graph

    rng = np.random.default_rng(4)
    key = lambda n: [None if x < 0.03 else "hot" if x < 0.9 else f"k{int(x * 1000) % 7}" for x in rng.random(n)]
    lhs = pd.DataFrame({"id": range(900), "k": key(900), "t": rng.integers(0, 3000, 900)})
    rhs = pd.DataFrame({"k": key(700), "t": rng.integers(0, 3000, 700), "v": rng.normal(size=700).round(3)}).drop_duplicates(["k", "t"])
    want = sorted((a, None if b is None or b != b else b) for a, b in duckdb.sql("SELECT id, v FROM lhs ASOF LEFT JOIN rhs USING (k, t)").fetchall())
    a, b = (spark.createDataFrame(x.astype(object).where(x.notna(), None), s).repartition(3) for x, s in ((lhs, "id long, k string, t long"), (rhs, "k string, t long, v double")))
    out = graph.as_of(a, b, ["k"], "t", "v", chunks)
    assert sorted((r.id, r.v) for r in out.collect()) == want
    assert graph.as_of(a.limit(0), b, ["k"], "t", "v", chunks).count() == 0
    assert {r.v for r in graph.as_of(a, b.limit(0), ["k"], "t", "v", chunks).collect()} == {None}


def plain_viterbi(tokens, model):
    ls, lt, le = (hmm.whole_logs(x).tolist() for x in model)
    n, v, back = len(ls), [ls[k] + le[k][tokens[0]] for k in range(len(ls))], []
    for x in tokens[1:]:
        back.append([max(range(n), key=lambda i: (v[i] + lt[i][j], -i)) for j in range(n)])
        v = [max(v[i] + lt[i][j] for i in range(n)) + le[j][x] for j in range(n)]
    path = [max(range(n), key=lambda k: (v[k], -k))]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1]


def models():
    rng = np.random.default_rng(2)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    rare = norm(rng.random((4, 27)) ** 4 + 1e-6)
    tied = (np.full(4, 0.25), norm(np.eye(4) + 1), norm(np.ones((4, 27))))  # every step ties
    never = (np.array([0.5, 0.5, 0.0, 0.0]), norm(np.triu(np.ones((4, 4)))), norm(rng.random((4, 27))))
    return {0: (norm(rng.random(4)), norm(rng.random((4, 4)) + 3 * np.eye(4)), rare), 1: tied, 2: never}


@pytest.mark.parametrize("chunks", [1, 7, 100, 300])
@pytest.mark.parametrize("which", [0, 1, 2])
def test_blocks_decode_as_one_sequence(spark, chunks, which):
    tokens = np.random.default_rng(which).integers(0, 27, 300).tolist()
    df = spark.createDataFrame([(k, x) for k, x in enumerate(tokens)], "ts int, token int").repartition(3)
    got = [r.state for r in hmm.decode(df, models()[which], chunks=chunks).orderBy("ts").collect()]
    assert got == plain_viterbi(tokens, models()[which]) == hmm.viterbi(np.array(tokens), *models()[which]).tolist()


def test_groups_and_configurations_decode_alone(spark):
    rng, rows = np.random.default_rng(9), []
    for g, n in (("a", 150), ("b", 1), (None, 40)):
        for c in (0, 1, 2):
            rows += [(g, c, k, int(x)) for k, x in enumerate(rng.integers(0, 27, n))]
    df = spark.createDataFrame(rows, "g string, c int, ts int, token int")
    got = hmm.decode(df, models(), by=["g", "c"], chunks=20, config="c").collect()
    for g in ("a", "b", None):
        for c in (0, 1, 2):
            mine = sorted((r.ts, r.token, r.state) for r in got if r.g == g and r.c == c)
            assert [m[2] for m in mine] == plain_viterbi([m[1] for m in mine], models()[c])
    assert hmm.decode(df.limit(0), models(), by=["g", "c"], config="c").count() == 0


def test_sweep_against_a_loop(spark):
    rng = np.random.default_rng(6)
    rows, state = [], 0
    for k in range(260):
        state = int(rng.choice(4)) if rng.random() < 0.1 else state
        rows.append((k, round(float(rng.gamma(2 + state, 0.2)), 4), round(float(rng.normal(0.02 * (state - 1.5), 0.06)), 4), state if rng.random() < 0.95 else -1, "train" if k < 160 else "test" if k >= 180 else None))
    df = spark.createDataFrame(rows, "ts int, atr double, er_delta double, label int, split string").repartition(4)
    train = [r for r in rows if r[4] == "train"]
    test = [r for r in rows if r[4] == "test"]
    mean = round(sum(r[1] for r in train) / len(train), 6)
    quant = lambda r, c: (0 if r[1] < mean * c[0] else 2 if r[1] > mean * c[1] else 1) * 9 + (0 if r[2] < -c[2] else 2 if r[2] > c[2] else 1) * 3 + 1
    a = np.zeros((4, 4))
    for x, y in zip(train, train[1:]):
        if x[3] >= 0 and y[3] >= 0:
            a[x[3], y[3]] += 1
    got = {r.config: r for r in hmm.sweep(df, chunks=5).collect()}
    assert len(got) == 27
    for k, c in enumerate(hmm.SWEEP):
        b = np.zeros((4, 27))
        for r in train:
            if r[3] >= 0:
                b[r[3], quant(r, c)] += 1
        path = plain_viterbi([quant(r, c) for r in test], hmm.from_counts(a, b))
        hits = [p == r[3] for p, r in zip(path, test) if r[3] >= 0]
        assert got[k].n_test == len(hits) and got[k].accuracy == pytest.approx(sum(hits) / len(hits)) and (got[k].low, got[k].high, got[k].er) == c
    assert hmm.sweep(df.limit(0)).count() == 0


def test_what_was_kept_can_be_cleared(spark):
    import os

    from tidemark import session

    kept = session.kept(spark.range(5), "cleared")
    folder = session.shared_dir(spark).removeprefix("file://")
    assert kept.count() == 5 and any(x.startswith("cleared-") for x in os.listdir(folder))
    session.clear(spark)
    assert not any(x.startswith(("cleared-", "ordered-", "files-")) for x in os.listdir(folder))
