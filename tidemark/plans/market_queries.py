"""Queries over time series: the hourly event series stands for quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events, features, hmm, labels, metrics, regression, splits, strategy
from ..operators.series import Series
from .base import Registry, r, rounded, table

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql

SYMBOLS = ("click", "error", "purchase", "signup", "view")
MAIN = "purchase"
ROLES = features.Roles(main=MAIN, eur="click", eurjpy="signup", audjpy="view", ief="error", jgb="click", wti="view")
LABELS = labels.Params(volatility=20.0, efficiency=0.05)  # moves of the event series are large
SPLIT = splits.Params(warm_up=50, purge=72, embargo=24)


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.hourly(table(spark, sf_dir, "events"))


def _returns(spark: SparkSession, sf_dir: str) -> Series:
    return Series.of(_hourly(spark, sf_dir)).windowed(lambda df, w: df.withColumn("ret_pct", r(features.log_return("price", w))), behind=1)


def _labelled(spark: SparkSession, sf_dir: str) -> Series:
    return labels.labelled(_returns(spark, sf_dir), params=LABELS)


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_type = features.hourly(table(spark, sf_dir, "events"), by=("event_type",))
    return features.align(by_type, SYMBOLS, symbol="event_type")


def _filled(spark: SparkSession, sf_dir: str) -> Series:
    return Series.of(_wide(spark, sf_dir)).filled({f"f_{s}": F.col(s) for s in SYMBOLS}, 0.0)


BEHIND = features.Params().atr_period + 1  # what changes of means of steps look back


def _measured(spark: SparkSession, sf_dir: str, add) -> Series:
    """The filled series with columns of windows over chunks."""
    return _filled(spark, sf_dir).windowed(add, behind=BEHIND)


_H = "h AS (SELECT date_trunc('hour', ts) AS ts, round(sum(value) / count(value), 6) AS price FROM events GROUP BY 1)"
_RET = _H + """, q AS (SELECT ts, price, lag(price) OVER (ORDER BY ts) AS prev FROM h),
t AS (SELECT ts, price, CASE WHEN prev IS NULL OR prev = 0 OR price = 0 THEN 0.0 ELSE round(ln(price / prev) * 100, 6) + 0.0 END AS ret_pct FROM q)"""
_LAB = _RET + """, e0 AS (SELECT *, sum(abs(ret_pct)) OVER w20 AS path, abs(sum(ret_pct) OVER w20) AS net, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n
  FROM t WINDOW w20 AS (ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
e1 AS (SELECT *, CASE WHEN path = 0 THEN 0.0 ELSE round(least(1.0, net / path), 6) END AS er FROM e0),
e2 AS (SELECT *, CAST(2 * CAST(abs(ret_pct) >= 20.0 AS INTEGER) + CAST(er >= 0.05 AS INTEGER) AS INTEGER) AS regime FROM e1),
e3 AS (SELECT *, count(*) FILTER (regime = 0) OVER a AS c0, count(*) FILTER (regime = 1) OVER a AS c1, count(*) FILTER (regime = 2) OVER a AS c2, count(*) FILTER (regime = 3) OVER a AS c3
  FROM e2 WINDOW a AS (ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 72 FOLLOWING)),
lab AS (SELECT *, CAST(CASE WHEN i < 20 OR i + 72 >= n THEN -1 WHEN c0 = greatest(c0, c1, c2, c3) THEN 0 WHEN c1 = greatest(c0, c1, c2, c3) THEN 1
  WHEN c2 = greatest(c0, c1, c2, c3) THEN 2 ELSE 3 END AS INTEGER) AS label FROM e3)"""
_WIDE = "w AS (SELECT date_trunc('hour', ts) AS ts, " + ", ".join(f"round(sum(value) FILTER (event_type = '{s}') / nullif(count(value) FILTER (event_type = '{s}'), 0), 6) AS {s}" for s in SYMBOLS) + " FROM events GROUP BY 1)"
_FILL = _WIDE + ", f AS (SELECT *, " + ", ".join(f"coalesce(last_value({s} IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS f_{s}" for s in SYMBOLS) + ", row_number() OVER (ORDER BY ts) - 1 AS i FROM w)"


def _atr_sql(s: str) -> str:
    return f"CASE WHEN f_{s} = 0 THEN 0.0 ELSE sum(coalesce(abs(f_{s} - p_{s}), 0.0)) OVER (ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) / 14 / f_{s} END"


_PREV = _FILL + ", g AS (SELECT *, " + ", ".join(f"lag(f_{s}) OVER (ORDER BY ts) AS p_{s}" for s in SYMBOLS) + ", coalesce(purchase, 0.0) AS raw FROM f)"
_ER = _PREV + """, g1 AS (SELECT *, coalesce(abs(raw - lag(raw) OVER (ORDER BY ts)), 0.0) AS stp, coalesce(abs(raw - lag(raw, 10) OVER (ORDER BY ts)), 0.0) AS net FROM g),
g2 AS (SELECT *, sum(stp) OVER (ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS path FROM g1),
k AS (SELECT *, """ + _atr_sql("purchase") + """ AS atr, CASE WHEN path = 0 THEN 0.0 ELSE net / path END AS er FROM g2)"""


@_R.add(f"WITH {_H} SELECT ts, price FROM h")
def hourly_snapshot(spark, sf_dir):
    return _hourly(spark, sf_dir)


@_R.add("""SELECT event_id, ts, round((value + value * 1.01) / 2, 6) AS mid FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00' AND minute(ts) = 0""")
def top_of_hour_mid(spark, sf_dir):
    import datetime as dt

    df = features.at_top_of_hour(table(spark, sf_dir, "events"), dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 25))
    df = df.withColumns({"bid_close": F.col("value"), "ask_close": F.col("value") * 1.01})
    return df.select("event_id", "ts", F.round(features.mid_price(), 6).alias("mid"))


@_R.add(f"WITH {_WIDE} SELECT * FROM w")
def symbol_pivot(spark, sf_dir):
    return _wide(spark, sf_dir)


@_R.add(f"WITH {_FILL} SELECT ts, {', '.join('f_' + s for s in SYMBOLS)} FROM f")
def forward_fill(spark, sf_dir):
    return _filled(spark, sf_dir).select("ts", *[f"f_{s}" for s in SYMBOLS])


@_R.add(f"WITH {_FILL} SELECT ts, coalesce(last_value(CASE WHEN i >= 25 THEN error END IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS filled FROM f")
def delayed_fill(spark, sf_dir):
    first = features.Params().first
    return Series.of(_wide(spark, sf_dir)).filled({"filled": F.when(F.col("_i") >= first, F.col("error"))}, 0.0).select("ts", "filled")


@_R.add(f"WITH {_PREV} SELECT ts, round({_atr_sql('purchase')}, 6) + 0.0 AS atr FROM g")
def normalized_atr(spark, sf_dir):
    return _measured(spark, sf_dir, lambda df, w: df.withColumn("atr", r(features.normalized_atr(f"f_{MAIN}", w)))).select("ts", "atr")


@_R.add(f"WITH {_ER} SELECT ts, round(er, 6) + 0.0 AS er FROM k")
def efficiency_ratio(spark, sf_dir):
    series = Series.of(_wide(spark, sf_dir)).windowed(lambda df, w: features.with_efficiency(df, MAIN, "er", w=w), behind=BEHIND)
    return series.select("ts", r(F.col("er")).alias("er"))


@_R.add(f"WITH {_RET} SELECT ts, ret_pct FROM t")
def log_return(spark, sf_dir):
    return _returns(spark, sf_dir).select("ts", "ret_pct")


@_R.add(f"WITH {_ER} SELECT ts, round(atr - coalesce(lag(atr) OVER (ORDER BY ts), 0.0), 6) + 0.0 AS atr_delta, round(er - coalesce(lag(er) OVER (ORDER BY ts), 0.0), 6) + 0.0 AS er_delta FROM k")
def feature_deltas(spark, sf_dir):
    def add(df, w):
        df = features.with_efficiency(df, MAIN, "er", w=w).withColumn("atr", features.normalized_atr(f"f_{MAIN}", w))
        return df.withColumns({"atr_delta": r(features.delta("atr", w)), "er_delta": r(features.delta("er", w))})

    return _measured(spark, sf_dir, add).select("ts", "atr_delta", "er_delta")


@_R.add(f"""WITH {_PREV} SELECT ts, CASE WHEN coalesce(p_error, 0) = 0 OR coalesce(p_click, 0) = 0 THEN 0.0
ELSE round(f_error - f_click - (p_error - p_click), 6) + 0.0 END AS spread_delta FROM g""")
def spread_delta(spark, sf_dir):
    return _measured(spark, sf_dir, lambda df, w: df.withColumn("spread_delta", r(features.spread_delta("f_error", "f_click", "f_error", "f_click", w)))).select("ts", "spread_delta")


def _delayed(s: str, name: str) -> str:
    return f"coalesce(last_value(CASE WHEN i >= 25 THEN {s} END IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS {name}"


@_R.add(f"""WITH {_ER}, m AS (SELECT *, {_delayed('error', 'us')}, {_delayed('click', 'jp')}, {_delayed('view', 'oil')}, {_atr_sql('click')} AS eur, {_atr_sql('view')} AS aud, {_atr_sql('signup')} AS ej,
  lag(atr) OVER (ORDER BY ts) AS patr, lag(er) OVER (ORDER BY ts) AS per FROM k)
SELECT ts, CASE WHEN p_purchase IS NULL OR p_purchase = 0 OR f_purchase = 0 THEN 0.0 ELSE round(ln(f_purchase / p_purchase) * 100, 6) + 0.0 END AS usdjpy_price,
 round(atr, 6) + 0.0 AS usdjpy_atr, round(er, 6) + 0.0 AS usdjpy_er, round(us, 6) + 0.0 AS us_bond_level, round(jp, 6) + 0.0 AS jp_bond_level, round(oil, 6) + 0.0 AS wti_oil,
 round(atr - coalesce(patr, 0.0), 6) + 0.0 AS atr_delta, round(er - coalesce(per, 0.0), 6) + 0.0 AS er_delta,
 CASE WHEN coalesce(p_error, 0) = 0 OR coalesce(p_click, 0) = 0 THEN 0.0 ELSE round(us - jp - (p_error - p_click), 6) + 0.0 END AS yield_spread_delta,
 round(eur, 6) + 0.0 AS eurusd_atr, round(aud, 6) + 0.0 AS audjpy_atr, round(ej, 6) + 0.0 AS eurjpy_atr
FROM m WHERE i >= 25 AND purchase IS NOT NULL""")
def assemble(spark, sf_dir):
    df = features.assemble(_wide(spark, sf_dir), ROLES)
    return rounded(df, [c for c in df.columns if c != "ts"])


@_R.add(f"WITH {_LAB} SELECT ts, ret_pct, er, regime, label FROM lab")
def regime_labels(spark, sf_dir):
    return _labelled(spark, sf_dir).select("ts", "ret_pct", "er", "regime", "label")


@_R.add(f"WITH {_LAB} SELECT label, count(*) AS n FROM lab GROUP BY label")
def label_distribution(spark, sf_dir):
    return labels.distribution(_labelled(spark, sf_dir).frame())


@_R.add(f"WITH {_LAB} SELECT ts, label FROM lab WHERE label BETWEEN 0 AND 3")
def valid_labels(spark, sf_dir):
    return labels.valid(_labelled(spark, sf_dir).frame()).select("ts", "label")


@_R.add(f"WITH {_LAB} SELECT ts, CAST(greatest(0, coalesce(lag(label, 72) OVER (ORDER BY ts), first_value(label) OVER (ORDER BY ts))) AS INTEGER) AS news_level FROM lab")
def lagged_label(spark, sf_dir):
    return labels.lagged_label(_labelled(spark, sf_dir)).select("ts", "news_level")


@_R.add(f"""WITH {_LAB}, c AS (SELECT k.class_id, count(lab.label) AS n FROM (SELECT unnest([0, 1, 2, 3]) AS class_id) k LEFT JOIN lab ON lab.label = k.class_id GROUP BY 1)
SELECT CAST(class_id AS INTEGER) AS class_id, n, CASE WHEN n = 0 THEN CAST('inf' AS DOUBLE) ELSE round((SELECT min(n) FROM c WHERE n > 0) / n, 6) END AS probability FROM c""")
def class_update_probability(spark, sf_dir):
    df = splits.update_probability(_labelled(spark, sf_dir).frame())
    return df.select("class_id", "n", F.when(F.isnan("probability") | (F.col("probability") == float("inf")), F.col("probability")).otherwise(F.round("probability", 6)).alias("probability"))


_LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@_R.add(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(min({c}), 6) + 0.0 AS min_value, round(max({c}), 6) + 0.0 AS max_value, round(avg({c}), 4) + 0.0 AS mean_value FROM lineitem" for c in _LINE))
def feature_stats(spark, sf_dir):
    df = metrics.feature_stats(table(spark, sf_dir, "lineitem"), _LINE)
    return df.select("feature", r(F.col("min_value")).alias("min_value"), r(F.col("max_value")).alias("max_value"), (F.round("mean_value", 4) + 0.0).alias("mean_value"))


@_R.add(f"""WITH {_LAB}, z AS (SELECT ts, label, i, n, floor(n * 0.6) AS a, floor(n * 0.8) AS b, max(CASE WHEN label <> -1 THEN i END) OVER () AS last FROM lab)
SELECT ts, label, CASE WHEN i >= 50 AND i < a - 72 THEN 'train' WHEN i >= a + 24 AND i < b - 72 THEN 'validation' WHEN i >= b + 24 AND i <= last THEN 'test' END AS split FROM z""")
def chronological_split(spark, sf_dir):
    return splits.chronological(_labelled(spark, sf_dir), params=SPLIT).select("ts", "label", "split")


@_R.add(f"WITH {_LAB} SELECT ts, CASE WHEN i < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM lab")
def sequential_split(spark, sf_dir):
    return splits.sequential(_labelled(spark, sf_dir)).select("ts", "split")


@_R.add("""SELECT vec_id, label % 4 AS label FROM embeddings WHERE (vec_id * 7919 + 13) % 100 < CASE label % 4 WHEN 0 THEN 9 WHEN 1 THEN 95 WHEN 2 THEN 95 ELSE 100 END""")
def downsample_hash(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 4).alias("label"))
    return splits.downsample(df, "vec_id", "label", {0: 9, 1: 95, 2: 95})


_PLACE = "((vec_id % 1000003) * (7919 * 7919 + 2 * 104729 * 42) + 13) % 1000003"


@_R.add(f"SELECT vec_id, label, CASE WHEN {_PLACE} < 0.8 * 1000003 THEN 'train' ELSE 'test' END AS split FROM embeddings")
def shuffled_split(spark, sf_dir):
    return splits.shuffled(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")


@_R.add(f"""WITH k AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {_PLACE}, vec_id) - 1 AS rn FROM embeddings)
SELECT vec_id, label, CAST(rn AS INTEGER) AS round FROM k WHERE rn < (SELECT min(n) FROM (SELECT count(*) AS n FROM embeddings GROUP BY label))""")
def balanced_rounds(spark, sf_dir):
    return splits.balanced_rounds(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", "vec_id")


def _releases(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    e = e.withColumn("consensus", F.lag("value").over(w)).where("consensus IS NOT NULL")
    return e.select(F.col("ts").alias("release_time"), F.col("event_type").alias("event_name"), F.lit("USD").alias("currency"), F.col("value").alias("actual"), "consensus")


@_R.add(f"""WITH {_H}, e AS (SELECT ts, value AS actual, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS consensus FROM events WHERE event_type = 'error'),
s AS (SELECT ts, CASE WHEN abs(actual - consensus) >= 200.0 THEN 2 WHEN abs(actual - consensus) >= 150.0 THEN 1 ELSE 0 END AS shock FROM e WHERE consensus IS NOT NULL)
SELECT h.ts, h.price, CAST(coalesce(max(s.shock), 0) AS INTEGER) AS shock FROM h LEFT JOIN s ON h.ts >= s.ts AND h.ts < s.ts + INTERVAL 3 HOUR GROUP BY 1, 2""")
def shock_interval_join(spark, sf_dir):
    return events.inject_shocks(_hourly(spark, sf_dir), _releases(spark, sf_dir), hours=3, moderate=150.0, large=200.0)


@_R.add("""WITH e AS (SELECT event_id, value AS actual, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS consensus FROM events)
SELECT event_id, CAST(CASE WHEN abs(actual - consensus) >= 0.25 THEN 2 WHEN abs(actual - consensus) >= 0.10 THEN 1 ELSE 0 END AS INTEGER) AS shock FROM e WHERE consensus IS NOT NULL""")
def shock_class(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("consensus", F.lag("value").over(w)).where("consensus IS NOT NULL")
    return e.select("event_id", events.shock(F.col("value"), F.col("consensus")).alias("shock"))


@_R.add(f"""WITH {_RET}, a AS (SELECT ts, ret_pct, row_number() OVER (ORDER BY ts) - 1 AS i, round(coalesce(sum(ret_pct) OVER (ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 0.0), 6) AS past FROM t),
b AS (SELECT *, CASE WHEN i < 6 THEN 0 WHEN past >= 0 THEN 1 ELSE -1 END AS position FROM a),
c AS (SELECT *, position * ret_pct AS sr FROM b),
d AS (SELECT *, sum(sr) OVER w / 24 AS mean, sqrt(sum(CASE WHEN sr < 0 THEN sr * sr ELSE 0.0 END) OVER w / 24) AS down FROM c WINDOW w AS (ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
SELECT ts, CAST(position AS INTEGER) AS position, round(sr, 6) + 0.0 AS strategy_return, CASE WHEN i < 24 THEN 0.0 WHEN down = 0 THEN CASE WHEN mean > 0 THEN 1.0 ELSE -1.0 END ELSE round(mean / down, 6) + 0.0 END AS sortino FROM d""")
def strategy_sortino(spark, sf_dir):
    df = strategy.momentum_sortino(_returns(spark, sf_dir))
    return rounded(df, ["strategy_return", "sortino"]).select("ts", "position", "strategy_return", "sortino")


def _tokens(spark, sf_dir) -> DataFrame:
    def add(df, w):
        df = features.with_efficiency(df, MAIN, "er", w=w).withColumns({"atr": r(features.normalized_atr(f"f_{MAIN}", w)), "er": r(F.col("er"))})
        return df.withColumn("er_delta", r(features.delta("er", w)))

    df, lab = _measured(spark, sf_dir, add).select("ts", "atr", "er_delta"), _labelled(spark, sf_dir).select("ts", "label")
    return hmm.with_tokens(df, "atr", "er_delta", digits=6).join(lab, "ts")


_TOK = _ER + "," + _LAB + """, k1 AS (SELECT ts, round(atr, 6) + 0.0 AS atr, round(er, 6) + 0.0 AS er FROM k),
k2 AS (SELECT ts, atr, round(er - coalesce(lag(er) OVER (ORDER BY ts), 0.0), 6) + 0.0 AS ed FROM k1),
k3 AS (SELECT *, round((SELECT avg(atr) FROM k2), 6) AS m FROM k2),
tok AS (SELECT ts, label, CAST(CASE WHEN atr < m * 0.7 THEN 0 WHEN atr > m * 1.3 THEN 2 ELSE 1 END * 9 + CASE WHEN ed < -0.05 THEN 0 WHEN ed > 0.05 THEN 2 ELSE 1 END * 3 + 1 AS INTEGER) AS token FROM k3 JOIN lab USING (ts))"""


@_R.add(f"WITH {_TOK} SELECT ts, token FROM tok")
def hmm_tokens(spark, sf_dir):
    return _tokens(spark, sf_dir).select("ts", "token")


@_R.add(f"""WITH {_LAB}, p AS (SELECT lag(label) OVER (ORDER BY ts) AS from_state, label AS to_state FROM lab)
SELECT from_state, to_state, count(*) AS n FROM p WHERE from_state BETWEEN 0 AND 3 AND to_state BETWEEN 0 AND 3 GROUP BY 1, 2""")
def hmm_transitions(spark, sf_dir):
    return hmm.transitions(_labelled(spark, sf_dir))


@_R.add(f"WITH {_TOK} SELECT label AS state, token, count(*) AS n FROM tok WHERE label BETWEEN 0 AND 3 GROUP BY 1, 2")
def hmm_emissions(spark, sf_dir):
    return hmm.emissions(_tokens(spark, sf_dir))


#: The decoder as a recursion over rows in order; a state's best path is carried as a list.
_VITERBI = f"""WITH RECURSIVE {_TOK}, o AS MATERIALIZED (SELECT ts, label, token, row_number() OVER (ORDER BY ts) AS i FROM tok),
sid AS (SELECT unnest([0, 1, 2, 3]) AS s), tid AS (SELECT unnest(range(0, 27)) AS x),
tc AS (SELECT f, t, count(*) AS n FROM (SELECT lag(label) OVER (ORDER BY ts) AS f, label AS t FROM o) WHERE f BETWEEN 0 AND 3 AND t BETWEEN 0 AND 3 GROUP BY 1, 2),
ec AS (SELECT label AS s, token AS x, count(*) AS n FROM o WHERE label BETWEEN 0 AND 3 GROUP BY 1, 2),
ta AS (SELECT a.s AS f, b.s AS t, 1.0::DOUBLE + coalesce(n, 0) AS n FROM sid a CROSS JOIN sid b LEFT JOIN tc ON tc.f = a.s AND tc.t = b.s),
ea AS (SELECT sid.s, tid.x, 1.0::DOUBLE + coalesce(n, 0) AS n FROM sid CROSS JOIN tid LEFT JOIN ec ON ec.s = sid.s AND ec.x = tid.x),
tl AS MATERIALIZED (SELECT t, list(CAST(round(ln(n / total) * 4294967296) AS BIGINT) ORDER BY f) AS l FROM (SELECT *, sum(n) OVER (PARTITION BY f) AS total FROM ta) GROUP BY 1),
trans AS MATERIALIZED (SELECT list(l ORDER BY t) AS m FROM tl),
emit AS MATERIALIZED (SELECT x, list(CAST(round(ln(n / total) * 4294967296) AS BIGINT) ORDER BY s) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY s) AS total FROM ea) GROUP BY 1),
start AS (SELECT list(CAST(round(ln(n / total) * 4294967296) AS BIGINT) ORDER BY s) AS p FROM (SELECT s, sum(n) AS n, (SELECT sum(n) FROM ea) AS total FROM ea GROUP BY 1)),
rec AS (
  SELECT o.i, [p[1] + e[1], p[2] + e[2], p[3] + e[3], p[4] + e[4]] AS v, [[0], [1], [2], [3]] AS paths FROM o JOIN emit ON x = token, start WHERE o.i = 1
  UNION ALL
  SELECT o.i, list_transform(range(1, 5), lambda j: list_max(list_transform(range(1, 5), lambda k: v[k] + m[j][k])) + e[j]),
    list_transform(range(1, 5), lambda j: list_append(paths[list_position(list_transform(range(1, 5), lambda k: v[k] + m[j][k]), list_max(list_transform(range(1, 5), lambda k: v[k] + m[j][k])))], CAST(j - 1 AS INTEGER)))
  FROM rec JOIN o ON o.i = rec.i + 1 JOIN emit ON x = token, trans),
fin AS (SELECT paths[list_position(v, list_max(v))] AS path FROM rec ORDER BY i DESC LIMIT 1)
SELECT o.ts, o.token, path[o.i] AS state FROM o, fin"""


@_R.add(_VITERBI)
def viterbi_path(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    return hmm.decode(t, hmm.fit(t))


_HALF = "z AS (SELECT ts, label, i, floor(n * 0.6) AS a, floor(n * 0.8) AS b, max(CASE WHEN label <> -1 THEN i END) OVER () AS last FROM lab), part AS (SELECT ts, label, CASE WHEN i >= 50 AND i < a - 72 THEN 'train' WHEN i >= b + 24 AND i <= last THEN 'test' END AS split FROM z)"


def _parts(spark, sf_dir) -> DataFrame:
    """(ts, atr, er_delta, label, split) for the search of thresholds."""
    return _tokens(spark, sf_dir).drop("token", "label").join(splits.chronological(_labelled(spark, sf_dir), params=SPLIT).select("ts", "label", "split"), "ts")


@_R.add(f"""WITH {_TOK}, {_HALF}, tr AS (SELECT k2.ts, k2.atr, k2.ed, part.label FROM k2 JOIN part USING (ts) WHERE split = 'train'), mean AS (SELECT round(avg(atr), 6) AS m FROM tr),
cf AS (SELECT CAST((a * 9 + b * 3 + c) AS INTEGER) AS config, [0.6, 0.7, 0.8][a + 1] AS low, [1.2, 1.3, 1.4][b + 1] AS high, [0.03, 0.05, 0.07][c + 1] AS er FROM range(0, 3) x(a), range(0, 3) y(b), range(0, 3) w(c))
SELECT config, label AS state, CAST(CASE WHEN atr < m * CAST(low AS DOUBLE) THEN 0 WHEN atr > m * CAST(high AS DOUBLE) THEN 2 ELSE 1 END * 9 + CASE WHEN ed < -CAST(er AS DOUBLE) THEN 0 WHEN ed > CAST(er AS DOUBLE) THEN 2 ELSE 1 END * 3 + 1 AS INTEGER) AS token, count(*) AS n
FROM tr, mean, cf WHERE label >= 0 GROUP BY 1, 2, 3""")
def hmm_sweep_counts(spark, sf_dir):
    """Emissions of the training rows under each of 27 sets of thresholds."""
    train = _parts(spark, sf_dir).where("split = 'train'")
    mean = train.agg(F.round(F.avg("atr"), 6).alias("m")).first().m
    return hmm.sweep_counts(train, mean or 0.0)


@_R.add()
def hmm_sweep(spark, sf_dir):
    """Accuracy on later rows for each of 27 sets of thresholds."""
    return hmm.sweep(_parts(spark, sf_dir))


def _scored(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 4).alias("actual"), (F.col("vec_id") % 4).cast("int").alias("predicted"))


_S = "s AS (SELECT vec_id, label % 4 AS actual, CAST(vec_id % 4 AS INTEGER) AS predicted FROM embeddings)"
_CELLS = _S + ", c AS (SELECT actual, predicted, count(*) AS n FROM s GROUP BY 1, 2)"
_K = "k AS (SELECT unnest([0, 1, 2, 3]) AS class_id)"
_PER = f"""{_CELLS}, {_K}, z AS (SELECT class_id, coalesce((SELECT sum(n) FROM c WHERE actual = class_id), 0) AS support, coalesce((SELECT sum(n) FROM c WHERE predicted = class_id), 0) AS q,
  coalesce((SELECT sum(n) FROM c WHERE actual = class_id AND predicted = class_id), 0) AS tp FROM k)"""


@_R.add(f"WITH {_CELLS} SELECT actual, predicted, n FROM c")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(_scored(spark, sf_dir), "actual", "predicted")


@_R.add(f"""WITH {_PER}, y AS (SELECT *, CASE WHEN q = 0 THEN 0.0 ELSE tp / q END AS p, CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS rc FROM z)
SELECT CAST(class_id AS INTEGER) AS class_id, CAST(support AS BIGINT) AS support, round(p, 6) AS precision, round(rc, 6) AS recall, CASE WHEN p + rc = 0 THEN 0.0 ELSE round(2 * p * rc / (p + rc), 6) END AS f1,
 (SELECT round(sum(CASE WHEN actual = predicted THEN 1 ELSE 0 END) / count(*), 6) FROM s) AS accuracy FROM y""")
def precision_recall_f1(spark, sf_dir):
    df = metrics.class_scores(_scored(spark, sf_dir), "actual", "predicted")
    return rounded(df, ["precision", "recall", "f1", "accuracy"]).withColumn("support", F.col("support").cast("long"))


@_R.add(f"""WITH {_S}, p AS (SELECT actual AS class_id, count(*) AS n, sum(CASE WHEN actual = predicted THEN 1 ELSE 0 END) AS hits FROM s GROUP BY 1)
SELECT class_id, n, CAST(hits AS BIGINT) AS hits, round(hits / n, 6) AS accuracy, (SELECT round(sum(hits) / sum(n), 6) FROM p) AS overall FROM p""")
def valid_accuracy(spark, sf_dir):
    return rounded(metrics.valid_accuracy(_scored(spark, sf_dir), "actual", "predicted"), ["accuracy", "overall"])


@_R.add(f"WITH {_CELLS} SELECT round(sum(n * " + "CASE " + " ".join(f"WHEN actual = {a} AND predicted = {p} THEN {metrics.RISK_COST[a][p]}" for a in range(4) for p in range(4)) + " END) / sum(n), 6) AS risk FROM c")
def risk_score(spark, sf_dir):
    return rounded(metrics.trading_risk(metrics.confusion(_scored(spark, sf_dir), "actual", "predicted")), ["risk"])


@_R.add("""WITH s AS (SELECT split_part('m' || (vec_id % 5) || '_AutoML_1_' || vec_id, '_AutoML_', 1) AS model_id, label % 4 AS class_id, CASE WHEN label % 4 = vec_id % 4 THEN 1.0 ELSE 0.0 END AS hit FROM embeddings),
p AS (SELECT model_id, class_id, sum(hit) / count(*) AS recall FROM s GROUP BY 1, 2)
SELECT model_id, round(coalesce(max(CASE WHEN class_id = 1 THEN recall * 100 END), 0.0), 6) AS recall_1, round(coalesce(max(CASE WHEN class_id = 2 THEN recall * 100 END), 0.0), 6) AS recall_2 FROM p GROUP BY 1""")
def recall_pivot(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    raw = F.concat(F.lit("m"), (F.col("vec_id") % 5).cast("string"), F.lit("_AutoML_1_"), F.col("vec_id").cast("string"))
    s = e.select(metrics.clean_model_id(raw).alias("model_id"), (F.col("label") % 4).alias("class_id"), F.when(F.col("label") % 4 == F.col("vec_id") % 4, 1.0).otherwise(0.0).alias("hit"))
    per = s.groupBy("model_id", "class_id").agg((F.sum("hit") / F.count("*")).alias("recall"))
    return rounded(metrics.recall_pivot(per), ["recall_1", "recall_2"])


_P = "p AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity * 3 AS BIGINT) % 40 - 20 AS score, greatest(l_discount + 0.01, 1e-12) AS exposure FROM lineitem), m AS (SELECT *, exp(greatest(-10.0, least(10.0, 0.1 * score + ln(exposure)))) AS mu FROM p)"


def _mu(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", ((F.col("l_quantity") * 3).cast("long") % 40 - 20).alias("score"), (F.col("l_discount") + 0.01).alias("exposure"))
    return df.withColumn("mu", regression.poisson_mean(F.col("score"), F.col("exposure")))


@_R.add(f"WITH {_P} SELECT l_orderkey, l_linenumber, l_partkey, round(mu, 6) AS mu, round(1 - exp(-mu), 6) + 0.0 AS occurrence FROM m")
def poisson_mu(spark, sf_dir):
    return _mu(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", r(F.col("mu")).alias("mu"), r(regression.occurrence(F.col("mu"))).alias("occurrence"))


@_R.add(f"""WITH {_P}, d AS (SELECT *, l_linenumber - 1 AS y FROM m) SELECT l_orderkey, l_linenumber, l_partkey,
round(CASE WHEN y = 0 THEN 2 * mu ELSE 2 * (y * ln(y / mu) - (y - mu)) END, 4) + 0.0 AS deviance, round((y - mu) / (1 + mu / 2.0), 6) + 0.0 AS residual FROM d""")
def poisson_deviance(spark, sf_dir):
    y = F.col("l_linenumber") - 1
    return _mu(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", (F.round(regression.poisson_deviance(y, F.col("mu")), 4) + 0.0).alias("deviance"), r(regression.negative_binomial_residual(y, F.col("mu"))).alias("residual"))
