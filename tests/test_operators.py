"""Goldens, boundaries and properties of the operators."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import arrays, codebooks, hv
from tidemark.operators import baselines, clauses, events, features, graph, hmm, labels, learner, metrics, splits, strategy
from tidemark.plans import flows, fx_graph
from tidemark.sources import synthetic

HOUR = dt.timedelta(hours=1)
T0 = dt.datetime(2017, 10, 10, 12)


def series(spark, values, name="ret_pct"):
    return spark.createDataFrame([(T0 + k * HOUR, float(v)) for k, v in enumerate(values)], f"ts timestamp_ntz, {name} double")


def column(df, name, key="ts"):
    return [r[name] for r in df.orderBy(key).collect()]


def test_shock_decay(spark):
    hours = series(spark, range(120), "price")
    event = [(dt.datetime(2017, 10, 11, 8), "CPI", "USD", 2.4, 2.1)]
    rel = spark.createDataFrame(event, "release_time timestamp_ntz, event_name string, currency string, actual double, consensus double")
    got = column(events.inject_shocks(hours, rel), "shock")
    assert got[19] == 0 and got[20] == 2 and got[21] == 2 and got[91] == 2 and got[92] == 0 and got[95] == 0
    assert set(column(events.inject_shocks(hours, rel, currencies=["JPY"]), "shock")) == {0}


def test_shock_between_hours(spark):
    rel = spark.createDataFrame([(T0 + dt.timedelta(minutes=30), "x", "USD", 1.0, 0.0)], "release_time timestamp_ntz, event_name string, currency string, actual double, consensus double")
    assert column(events.inject_shocks(series(spark, range(6), "price"), rel, hours=2), "shock") == [0, 2, 2, 0, 0, 0]


def test_shock_classes_compare_doubles(spark):
    rows = spark.createDataFrame([(0.3, 0.2), (0.25, 0.0), (0.1, 0.0), (0.0, 0.09)], "a double, c double")
    assert [r[0] for r in rows.select(events.shock(F.col("a"), F.col("c"))).collect()] == [0 if 0.3 - 0.2 < 0.10 else 1, 2, 1, 0]


def test_release_filter(spark):
    rows = [("2020-01-01 08:30:00", "US", "Core CPI", 1.0, 2.0), ("2020-01-01", "US", "CPI", 1.0, 2.0), ("2020-01-01 08:30:00", "DE", "CPI", 1.0, 2.0), ("2020-01-01 08:30:00", "JP", "inflation rate", None, 2.0), ("2020-01-01 08:30:00", "JP", "Inflation", 1.0, 1.5)]
    df = spark.createDataFrame(rows, "date string, country string, event string, actual double, estimate double")
    assert sorted(r.currency for r in events.inflation_releases(df).collect()) == ["JPY", "USD"]


def brute_labels(ret, vol=0.08, eff=0.35, ahead=72, period=20):
    def er(k):
        w = ret[max(0, k - period + 1) : k + 1]
        path = sum(map(abs, w))
        return 0.0 if path == 0 else min(1.0, abs(sum(w)) / path)

    reg = [2 * (abs(x) >= vol) + (round(er(k), 6) >= eff) for k, x in enumerate(ret)]
    out = []
    for t in range(len(ret)):
        if t < period or t + ahead >= len(ret):
            out.append(-1)
        else:
            n = [sum(r == c for r in reg[t + 1 : t + ahead + 1]) for c in range(4)]
            out.append(n.index(max(n)))
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_labels_against_loop(spark, seed):
    ret = np.random.default_rng(seed).normal(0, 0.1, 160).round(4).tolist()
    assert column(labels.look_ahead(series(spark, ret)), "label") == brute_labels(ret)


def test_label_bounds(spark):
    got = column(labels.look_ahead(series(spark, [0.08] * 93)), "label")
    assert [k for k, x in enumerate(got) if x != -1] == [20] and got[20] == 3
    flat = column(labels.look_ahead(series(spark, [0.0] * 93)), "label")
    assert flat[20] == 0


def test_fill_kinds(spark):
    df = spark.createDataFrame([(T0 + k * HOUR, v) for k, v in enumerate([None, 2.0, None, 4.0])], "ts timestamp_ntz, x double")
    w = features.ordered()
    assert column(df.select("ts", features.forward_fill("x", w).alias("f")), "f") == [0.0, 2.0, 2.0, 4.0]
    assert column(df.select("ts", features.delayed_fill("x", w, 2).alias("f")), "f") == [0.0, 0.0, 0.0, 4.0]


def test_atr_and_ratio(spark):
    df = series(spark, [1, 2, 4, 3], "p")
    w = features.ordered()
    atr = column(df.select("ts", features.normalized_atr("p", w, 2).alias("a")), "a")
    assert atr == [0.0, 0.25, 3 / 8, 0.5]
    er = column(features.with_efficiency(df, "p", "er", period=2), "er")
    assert er == [0.0, 0.0, 1.0, 1 / 3]
    assert column(df.select("ts", features.log_return("p", w).alias("r")), "r")[:2] == [0.0, math.log(2) * 100]


def test_strategy_against_loop(spark):
    ret = np.random.default_rng(3).normal(0, 1, 80).round(3).tolist()
    got = strategy.momentum_sortino(series(spark, ret), lookback=6, window=24).orderBy("ts").collect()
    own = []
    for k, x in enumerate(ret):
        pos = 0 if k < 6 else 1 if round(sum(ret[k - 6 : k]), 6) >= 0 else -1
        own.append(pos * x)
        want = 0.0
        if k >= 24:
            last = own[-24:]
            down = math.sqrt(sum(v * v for v in last if v < 0) / 24)
            want = sum(last) / 24 / down if down else (1.0 if sum(last) > 0 else -1.0)
        assert got[k].position == pos and got[k].sortino == pytest.approx(want)


def test_split_has_gaps(spark):
    df = series(spark, range(1000), "x").withColumn("label", F.when(F.col("x") < 950, 1).otherwise(-1))
    got = column(splits.chronological(df), "split")
    where = {s: [k for k, x in enumerate(got) if x == s] for s in ("train", "validation", "test")}
    assert (where["train"][0], where["train"][-1]) == (500, 527)
    assert (where["validation"][0], where["validation"][-1]) == (624, 727)
    assert (where["test"][0], where["test"][-1]) == (824, 949)
    assert where["train"][-1] + 72 < where["validation"][0]


def test_empty_class_probability(spark):
    df = spark.createDataFrame([(0,), (0,), (2,)], "label int")
    got = {r.class_id: r.probability for r in splits.update_probability(df).collect()}
    assert got == {0: 0.5, 1: math.inf, 2: 1.0, 3: math.inf}


def test_risk_of_nothing(spark):
    cells = spark.createDataFrame([], "actual int, predicted int, n long")
    assert metrics.trading_risk(cells).first().risk == 0.0
    one = spark.createDataFrame([(2, 3, 5)], "actual int, predicted int, n long")
    assert metrics.trading_risk(one).first().risk == 10.0


def test_scores_without_predictions(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (9, 9)], "a int, p int")
    got = {r.class_id: r for r in metrics.class_scores(df, "a", "p").collect()}
    assert got[0].precision == 0.5 and got[0].recall == 1.0 and got[3].f1 == 0.0 and got[0].accuracy == pytest.approx(1 / 3)


words = st.lists(st.integers(-(2**63), 2**63 - 1), min_size=3, max_size=3)
S3 = hv.Shape(3, 64, 10)


@settings(max_examples=5, deadline=None)
@given(rows=st.lists(st.tuples(words, words, words, st.integers(-500, 500)), min_size=1, max_size=6))
def test_vector_properties(spark, rows):
    shift = rows[0][3]
    df = spark.createDataFrame([(a, b, c) for a, b, c, _ in rows], "a array<bigint>, b array<bigint>, c array<bigint>")
    a, b, c = map(F.col, "abc")
    r = df.select(
        "a", hv.bind(hv.bind(a, b), b).alias("back"), hv.unpermute(hv.permute(a, shift, S3), shift, S3).alias("turn"), hv.hamming(a, b).alias("ab"), hv.hamming(b, a).alias("ba"), hv.hamming(b, c).alias("bc"), hv.hamming(a, c).alias("ac"),
        hv.join_words(hv.split_words(a)).alias("halves"), hv.popcount(hv.complement(a, S3)).alias("zeros"), hv.popcount(a).alias("ones"), hv.from_indices(hv.indices(a, S3), S3).alias("packed"), hv.contains(a, hv.union(a, b)).alias("inside"),
    ).collect()
    for x in r:
        assert x.back == x.a == x.turn == x.halves == x.packed and x.inside
        assert x.ab == x.ba and x.ac <= x.ab + x.bc and x.zeros + x.ones == 192


def test_packing_round_trip(spark):
    golden = [0, -1, 0x0123456789ABCDEF, -(2**63), 2**63 - 1]
    df = spark.createDataFrame([(golden,)], "v array<bigint>")
    r = df.select(hv.split_words(F.col("v")).alias("h"), hv.join_words(hv.split_words(F.col("v"))).alias("v")).first()
    assert r.v == golden and r.h[4] == 0x89ABCDEF and r.h[5] == 0x01234567


def test_empty_vectors(spark):
    df = spark.createDataFrame([([0, 0],)], "v array<bigint>")
    r = df.select(hv.jaccard_distance(F.col("v"), F.col("v")).alias("j"), hv.overlap(F.col("v"), F.col("v")).alias("o"), hv.is_zero(F.col("v")).alias("z"), hv.contains(F.col("v"), F.col("v")).alias("c")).first()
    assert (r.j, r.o, r.z, r.c) == (1.0, 0.0, True, True)


def test_codebooks(spark):
    for book in (codebooks.linear_levels(20), codebooks.interval_levels(20), codebooks.fixed_levels(20), codebooks.roles(4), codebooks.rank_roles(5)):
        assert book.any(1).all()
    lin = codebooks.linear_levels(20)
    near, far = int((lin[0] ^ lin[1]).sum()), int((lin[0] ^ lin[19]).sum())
    assert near < far
    assert (codebooks.linear_levels(20) == lin).all()
    t = codebooks.table(spark, lin)
    got = hv.nearest(t.withColumnRenamed("code", "hv").withColumnRenamed("level", "want"), t).collect()
    assert all(r.level == r.want and r.distance == 0 for r in got)


def test_bucket_ends(spark):
    xs = [-1.0, 0.0, 0.499, 1.0, 1.001, 1.5]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [r[0] for r in df.select(codebooks.bucket(F.col("x"), 0.0, 1.0, 10)).collect()] == [0, 0, 4, 9, 9, 9]


def test_counters_saturate():
    s = np.array([0, 255, 127, 128], np.uint8)
    learner.step(s, np.ones(4, bool), np.zeros(4, bool))
    assert s.tolist() == [1, 255, 128, 129]
    learner.step(s, np.zeros(4, bool), np.array([True, False, True, True]))
    learner.step(s, np.zeros(4, bool), np.array([True, False, False, False]))
    assert s.tolist() == [0, 255, 127, 128]


def test_layout_words():
    assert learner.Layout(1600).literal_words == 100
    with pytest.raises(ValueError):
        learner.Layout(30)


def numbers(n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 20, (n, 3))
    bits = np.arange(32)[None, None] < x[:, :, None]
    return learner.literals(bits.reshape(n, 96)), np.digitize(x.sum(1), [20, 40])


def test_shared_clauses_learn():
    x, y = numbers(500)
    x4 = x[:, None, None]
    m = learner.SharedClauses(3, learner.Layout(96), learner.Config(clauses=80, threshold=25, epochs=6)).fit(x4[:400], y[:400])
    guess = m.predict(x4[400:])
    majority = np.bincount(y[400:]).max() / 100
    assert (guess == y[400:]).mean() > majority + 0.1
    assert m.state.min() >= 0 and m.state.max() <= 255


def test_fuzzy_and_counts_learn():
    rng = np.random.default_rng(1)
    bits = rng.random((400, 8)) < 0.5
    x, y = learner.literals(bits), (bits[:, 0] & ~bits[:, 3]).astype(int)
    m = learner.FuzzyClauses(8, learner.Config(clauses=20, threshold=10, specificity=10, epochs=8), limit=3).fit(x, y)
    assert ((np.array([m.score(v) for v in x]) >= 0) == y).mean() > 0.85
    counts = np.where(bits[:, 1], 6, 1)
    c = learner.CountRegression(8, learner.Config(clauses=20, threshold=40, specificity=10, epochs=6), limit=2).fit(x, counts)
    mu = np.array([c.mean(v) for v in x])
    assert mu[bits[:, 1]].mean() > 1.5 * mu[~bits[:, 1]].mean()


def test_two_layers_gate():
    m = learner.SharedClauses(2, learner.Layout(32, 3, 2), learner.Config(clauses=4))
    x = np.zeros((2, 3, 64), bool)
    m.state[0, :, 0] = 255  # wants a feature that is off everywhere
    fired, _ = m._where(x)
    assert not fired.any()


def test_search_beats_majority(spark):
    df = synthetic.three_integers(spark, 500)
    r = learner.best(learner.search(spark, df, learner.grid(clauses=[80], threshold=[25], epochs=[4], seed=[1, 2]), 3, learner.Layout(96))).first()
    test = df.where("split = 'test'").groupBy("label").count().collect()
    assert r.accuracy > max(t["count"] for t in test) / sum(t["count"] for t in test)


def test_viterbi_known():
    start, trans = np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.4, 0.6]])
    emit = np.array([[0.5, 0.4, 0.1], [0.1, 0.3, 0.6]])
    assert hmm.viterbi(np.array([0, 1, 2]), start, trans, emit).tolist() == [0, 0, 1]
    assert hmm.viterbi(np.zeros(0, int), start, trans, emit).tolist() == []


def test_fx_graph(spark):
    v, e = fx_graph.vertices(spark), fx_graph.edges(spark)
    assert v.count() == 11 and e.count() == 16
    deg = {r.vertex: r.in_degree for r in graph.degrees(v, e).collect()}
    assert deg["USDJPY_PRICE"] == 8 and deg["USDJPY_ATR"] == 6 and sum(x == 0 for x in deg.values()) == 7
    assert fx_graph.codes(spark).count() == sum(spec[3] for _, _, spec, _ in fx_graph.VERTICES)
    v2, e2 = graph.remove_vertices(v, e, v.where("vertex = 'USD_NEWS_SHOCK'"))
    assert v2.count() == 10 and e2.count() == 13
    v3, e3 = graph.merge_graphs((v2, e2), (v, e))
    assert v3.count() == 11 and e3.count() == 16
    assert {r.opposite for r in graph.opposite(e, "ER_DELTA").collect()} == {"USDJPY_PRICE", "YIELD_SPREAD_DELTA"}


def test_snapshots(spark):
    nodes = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "node_id int, graph_id int")
    edges = spark.createDataFrame([(1, 1, 2, 1), (2, 1, 3, 0)], "edge_idx int, src int, dst int, available_at int")
    line = spark.createDataFrame([(1, 0, 5), (2, 2, 6), (2, 3, 7), (3, 0, 8)], "node_id int, time int, label int")
    states, links = graph.snapshots(nodes, edges, line, 3)
    got = {(r.node_id, r.time): r.label for r in states.collect()}
    assert got[2, 2] == 6 and got[2, 3] == 7 and (2, 1) not in got and got[1, 3] == 5
    assert sorted(r.time for r in links.collect()) == [2, 3]


def test_co_sort(spark):
    df = spark.createDataFrame([([3, 1, 3, 2], ["a", "b", "c", "d"]), ([], [])], "k array<int>, v array<string>")
    got = [r[0] for r in df.select(arrays.co_sort(F.col("k"), F.col("v"))).collect()]
    assert got[0].keys == [1, 2, 3, 3] and got[0]["values"] == ["b", "d", "a", "c"] and got[1].keys == []
    assert [tuple(r) for r in arrays.by_count(spark.createDataFrame([("x",), ("y",), ("y",)], "c string"), "c").collect()] == [("y", 2), ("x", 1)]


def test_decode_undoes_a_role(spark):
    book = codebooks.table(spark, codebooks.interval_levels(6))
    role = codebooks._words(codebooks.roles(1)[0], hv.PRODUCTION)
    bound = book.select(F.col("level").alias("want"), hv.bind(F.col("code"), F.array(*[F.lit(w).cast("long") for w in role])).alias("hv"))
    got = hv.decode(bound, book, role).collect()
    assert all(r.level == r.want and r.similarity == 1.0 for r in got)


def test_top_literals(spark):
    counts = spark.createDataFrame([(1, 5, 3), (1, 2, 3), (1, 9, 7)], "sample int, literal int, total int")
    got = {(r.sample, r.literal) for r in clauses.top_literals(counts, 2).collect()}
    assert got == {(1, 9), (1, 2)}


def test_importance_vectors(spark):
    v, e = graph.importance_vectors(fx_graph.vertices(spark), fx_graph.edges(spark))
    assert v.count() == 11 and e.count() == 16 and set(v.columns) == {"vertex", "hv"}


def _market(spark, n=260):
    """Assembled rows of generated prices."""
    h = synthetic.hours(spark, T0, n)
    names = ("MAIN", "EUR", "EURJPY", "AUDJPY", "IEF", "JGB", "WTI")
    wide = h.select("ts", *[(F.col("price") * (1 + k / 10) + F.cos(F.hour("ts") * (k + 1.0))).alias(s) for k, s in enumerate(names)])
    return features.assemble(wide, features.Roles(main="MAIN"))


def test_own_model_end_to_end(spark):
    df = flows.label_rows(_market(spark), labels.Params(volatility=0.3, efficiency=0.2))
    known = df.where("label >= 0")
    assert known.count() == df.count() - 20 - 72
    lv = fx_graph.levels(df)
    assert lv.count() == 11 * df.count()
    layer = fx_graph.encode(lv, fx_graph.codes(spark))
    assert layer.where(F.size("hv") == 25).count() == lv.count()
    split = splits.chronological(df, params=splits.Params(0, 4, 4))
    r = flows.fx_search(spark, split, [learner.Config(clauses=10, epochs=1, threshold=10)], max_rows=1000).first()
    assert r.n_test > 0 and 0 <= r.accuracy <= 1


def test_baselines(spark):
    df = synthetic.one_integer(spark, 300)
    from pyspark.ml.functions import array_to_vector

    data = df.select(array_to_vector(F.col("bits").cast("array<double>")).alias("features"), "label", "split")
    model = baselines.boosted_trees(data.where("split = 'train'"), trees=2, depth=2)
    out = model.transform(data.where("split = 'test'"))
    assert out.where("prediction = label").count() == out.count()
    row = features.feature_vector(spark.createDataFrame([(1.0, 2.0, 1)], "a double, b double, label int"), ["a", "b"]).first()
    assert row.features.toArray().tolist() == [1.0, 2.0]


def test_label_file(spark, tmp_path):
    p = tmp_path / "d.csv"
    p.write_text("timestamp,usdjpy_price\n" + "".join(f"{(T0 + k * HOUR).isoformat()},{0.1 if k % 2 else -0.1}\n" for k in range(100)))
    assert flows.label_file(spark, str(p)).where("label >= 0").count() == 100 - 20 - 72


def _graph_samples(n, seed=0):
    """Two layers, three vertices, 32 features: class 1 has bit 3 at some vertex and bit 9 in its message."""
    rng = np.random.default_rng(seed)
    x = rng.random((n, 2, 3, 32)) < 0.2
    y = np.arange(n) % 2
    v = rng.integers(0, 3, n)
    x[:, 0, :, 3], x[:, 1, :, 9] = False, rng.random((n, 3)) < 0.5
    x[np.arange(n), 0, v, 3] = y == 1
    x[np.arange(n), 1, v, 9] |= y == 1
    return x, y


@pytest.mark.parametrize("focused", [False, True])
def test_graph_automata_for_each_class(focused):
    x, y = _graph_samples(300)
    lit = learner.literals(x)
    m = learner.GraphClasses(2, learner.Layout(32, 3, 2), learner.Config(clauses=20, threshold=10, specificity=5.0, epochs=6), focused).fit(lit[:200], y[:200])
    assert np.mean(m.predict(lit[200:]) == y[200:]) > 0.9
    assert m.shares().sum() == pytest.approx(1) and all((k.weight >= 1).all() for k in m.models)


def test_an_empty_clause_scores_nothing():
    m = learner.VertexClauses(learner.Layout(32, 3, 1), learner.Config(clauses=4))
    x = learner.literals(np.zeros((1, 3, 32), bool))
    assert m.score(x) == 0
    m.state[0, 0, 40] = learner.INCLUDE  # the negation of feature 8
    assert m.score(x) == 1
    m.state[0, 1, 1] = learner.INCLUDE  # feature 1, which no vertex has
    assert m.score(x) == 1


def test_focused_negatives_follow_the_weights():
    rng = np.random.default_rng(0)
    shares = np.array([0.1, 0.2, 0.7])
    drawn = np.bincount([learner.other_class(0, shares, 3, rng) for _ in range(900)], minlength=3)
    assert drawn[0] == 0 and 550 < drawn[2] < 800
    assert np.bincount([learner.other_class(1, None, 3, rng) for _ in range(900)], minlength=3)[[0, 2]].min() > 350
    assert learner.other_class(0, shares[:1], 1, rng) is None and learner.other_class(0, np.array([1.0, 0.0]), 2, rng) == 1


def test_focused_fuzzy_classes():
    rng = np.random.default_rng(1)
    x = rng.random((240, 32)) < 0.5
    y = np.where(x[:, 4], 0, np.where(x[:, 7], 1, 2))
    lit = learner.literals(x)
    m = learner.FuzzyClasses(3, 32, learner.Config(clauses=20, threshold=10, epochs=12), focused=True).fit(lit[:180], y[:180])
    assert np.mean(m.predict(lit[180:]) == y[180:]) > np.mean(y == 0) + 0.1


def _table(spark, x, y, train):
    rows = [(k, int(y[k]), "train" if k < train else "test", x[k].astype(int).ravel().tolist()) for k in range(len(y))]
    return spark.createDataFrame(rows, "key long, label int, split string, bits array<int>").repartition(3)


def test_search_of_no_samples(spark):
    none = spark.createDataFrame([], "key int, label int, split string, bits array<int>")
    rows = learner.search(spark, none, learner.grid(clauses=[10], seed=[1, 2]), 3, learner.Layout(32)).collect()
    assert [(r.n_test, r.accuracy) for r in rows] == [(0, 0.0)] * 2


def test_search_with_other_learners(spark):
    x, y = _graph_samples(240)
    layout = learner.Layout(32, 3, 2)
    build = lambda classes, shape, config: learner.GraphClasses(classes, shape, config, True)
    configs = learner.grid(clauses=[20], threshold=[10], specificity=[5.0], epochs=[4], seed=[1, 2])
    got = learner.search(spark, _table(spark, x, y, 180), configs, 2, layout, build=build).collect()
    assert {r.config for r in got} == {0, 1} and all(r.n_test == 60 for r in got) and max(r.accuracy for r in got) > 0.8
    with pytest.raises(ValueError):
        learner.search(spark, _table(spark, x, y, 180), configs, 2, layout, max_bytes=100)


def test_ensemble_takes_any_number(spark):
    x, y = _graph_samples(600)
    got = learner.ensemble(_table(spark, x, y, 450), learner.Config(clauses=20, threshold=10, specificity=5.0, epochs=6), 2, learner.Layout(32, 3, 2), 3).collect()
    assert len(got) == 150 and np.mean([r.label == r.predicted for r in got]) > 0.8


def test_dropout_and_random_configurations():
    x, y = _graph_samples(200)
    lit = learner.literals(x)
    m = learner.SharedClauses(2, learner.Layout(32, 3, 2), learner.Config(clauses=40, threshold=15, epochs=5, dropout=0.3)).fit(lit, y)
    assert m.on.all() and np.mean(m.predict(lit) == y) > 0.8
    a, b = learner.random_configs(20), learner.random_configs(20)
    assert a == b and len({c.seed for c in a}) == 20 and all(c.clauses % 2 == 0 and 1.5 <= c.specificity <= 15 for c in a)


def test_model_search_tries_three_families(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (120, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)  # no line divides it
    df = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y)], "f array<double>, label int").select(array_to_vector("f").alias("features"), "label")
    name, score, model = baselines.model_search(df, folds=2, depths=(3,))
    assert name in ("forest", "boosted") and score > 0.6 and model.transform(df).select("prediction").count() == 120


@pytest.mark.parametrize("shift", [0, 1, 31, 32, 33, 63, -1, -40, 1000])
def test_permute_moves_every_bit(spark, shift):
    for shape in (hv.SMALL, hv.Shape(3, 64, 8)):
        rng = np.random.default_rng(3)
        bits = rng.random((4, shape.size)) < 0.5
        rows = [(k, codebooks._words(b, shape)) for k, b in enumerate(bits)]
        df = spark.createDataFrame([*rows, (9, None)], "k int, hv array<bigint>").withColumn("hv", hv.permute(F.col("hv"), shift, shape))
        got = {r.k: r.hv for r in df.collect()}
        assert got == {**{k: codebooks._words(np.roll(b, shift), shape) for k, b in enumerate(bits)}, 9: None}


def test_half_bits_and_splits():
    rng = np.random.default_rng(0)
    top, low = codebooks.half_bits(rng, hv.PRODUCTION, True), codebooks.half_bits(rng, hv.PRODUCTION, False)
    assert top.sum() == low.sum() == 160 and not top[: 12 * 64].any() and not low[12 * 64 :].any()


def test_a_split_by_hash_is_even(spark):
    got = {r.split: r["count"] for r in splits.shuffled(spark.range(20_000), "id", 0.8).groupBy("split").count().collect()}
    assert 15_500 < got["train"] < 16_500
    a, b = (splits.shuffled(spark.range(5000), "id", 0.5, seed=k) for k in (1, 2))
    same = a.join(b.withColumnRenamed("split", "other"), "id").where("split = other").count()
    assert 1500 < same < 3500
