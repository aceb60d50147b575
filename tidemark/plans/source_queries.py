"""Queries through files: tables are written in the formats that the sources read, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import events, features, ordering
from ..operators import graph as graphs_
from ..operators.series import Series
from ..sources import calendar, graphs, market
from . import flows
from .base import Registry, r, scratch, table
from .market_queries import _H, _LAB, _hourly

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql


@_R.add("""SELECT date_trunc('second', ts) AS ts, 'view' AS symbol, round((max(value) + (max(value) + 1.0)) / 2, 6) + 0.0 AS mid
FROM events WHERE event_type = 'view' AND value IS NOT NULL GROUP BY 1""")
def quote_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as positional quote files, one quote a second."""
    e = table(spark, sf_dir, "events").where("event_type = 'view' AND value IS NOT NULL").groupBy(F.date_trunc("second", "ts").alias("t")).agg(F.max("value").alias("v"))
    zero = [F.lit(0).alias(f"c{k}") for k in range(10)]
    rows = e.select(F.date_format("t", "yyyyMMdd HH:mm:ss").alias("time"), *zero[1:4], F.col("v"), *zero[5:9], (F.col("v") + 1.0).alias("ask"))
    path = scratch(spark)
    rows.write.csv(path, header=True)
    q = market.quotes(spark, path, "view")
    return q.select("ts", "symbol", r(F.col("mid")).alias("mid"))


@_R.add(f"""WITH {_H} SELECT ts, price AS usdjpy_price, CASE WHEN extract('hour' FROM ts) % 2 = 0 THEN CAST(0 AS DOUBLE) ELSE price END AS wti_oil, CAST(0.25 AS DOUBLE) AS usdjpy_er, CAST(0 AS DOUBLE) AS eurusd_atr
FROM h WHERE extract('day' FROM ts) <> 5""")
def dataset_files(spark, sf_dir):
    """Hours as dataset files: names with blanks and in other cases, blank cells, and rows that can't be read."""
    h = _hourly(spark, sf_dir)
    rows = h.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias(" timestamp "), F.col("price").alias("UsdJpy_Price"), F.when(F.hour("ts") % 2 == 1, F.col("price")).alias("WTI_OIL"),
        F.when(F.dayofmonth("ts") == 5, F.lit("x")).otherwise(F.lit(" 0.25 ")).alias(" USDJPY_ER"),
    )
    path = scratch(spark)
    rows.write.csv(path, header=True)
    return market.dataset(spark, path).select("ts", "usdjpy_price", "wti_oil", "usdjpy_er", "eurusd_atr")


_FILE_LAB = _LAB.replace("* 100, 6)", ", 6)").replace(">= 20.0", ">= 0.08").replace(">= 0.05", ">= 0.35")


@_R.add(f"WITH {_FILE_LAB} SELECT ts, regime, label, CAST(greatest(0, coalesce(lag(label, 72) OVER (ORDER BY ts), first_value(label) OVER (ORDER BY ts))) AS INTEGER) AS news_level FROM lab")
def label_file(spark, sf_dir):
    """A dataset file of hourly changes, labelled by its own thresholds."""
    h = Series.of(_hourly(spark, sf_dir)).windowed(lambda df, w: df.withColumn("x", r(features.log_return("price", w) / 100)), behind=1)
    path = scratch(spark)
    h.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("timestamp"), F.col("x").alias("usdjpy_price")).write.csv(path, header=True)
    return flows.label_file(spark, path).select("ts", "regime", "label", "news_level")


@_R.add(f"""WITH {_H} SELECT strftime(ts, '%Y-%m-%dT%H:%M') AS stamp, price AS usdjpy_price, round(price + 11, 6) AS er_delta, CAST(extract('hour' FROM ts) % 4 - 1 AS INTEGER) AS label
FROM h WHERE extract('hour' FROM ts) % 4 - 1 <> -1""")
def labelled_export(spark, sf_dir):
    """Labelled rows written and read back by the written header; rows without a label are not there."""
    h = _hourly(spark, sf_dir)
    rows = h.select("ts", *[r(F.col("price") + k).alias(c) for k, c in enumerate(market.EXPORT)], (F.hour("ts") % 4 - 1).alias("label"))
    path = scratch(spark)
    if not market.export_labelled(rows, path):
        return spark.createDataFrame([], "stamp string, usdjpy_price double, er_delta double, label int")
    back = spark.read.csv(path, header=True)
    return back.select(F.col("Timestamp").alias("stamp"), F.col("USDJPY_PRICE").cast("double").alias("usdjpy_price"), F.col("ER_DELTA").cast("double").alias("er_delta"), F.col("LABEL").cast("int").alias("label"))


_CAL = """c AS (SELECT date_trunc('second', ts) AS t, CASE user_id % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'JP' ELSE 'FR' END AS country,
  CASE event_id % 4 WHEN 0 THEN 'Core CPI m/m' WHEN 1 THEN 'inflation rate' WHEN 2 THEN 'GDP' END AS event, CASE WHEN event_id % 5 <> 0 THEN value END AS actual, event_id % 7 + 0.5 AS estimate
  FROM events WHERE event_type = 'error')"""


def _calendar_rows(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return e.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date"), F.when(F.col("user_id") % 3 == 0, "US").when(F.col("user_id") % 3 == 1, "JP").otherwise("FR").alias("country"),
        F.when(F.col("event_id") % 4 == 0, "Core CPI m/m").when(F.col("event_id") % 4 == 1, "inflation rate").when(F.col("event_id") % 4 == 2, "GDP").alias("event"),
        F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("actual"), (F.col("event_id") % 7 + 0.5).cast("double").alias("estimate"),
    )


@_R.add(f"""WITH {_CAL} SELECT t AS release_time, event AS event_name, CASE country WHEN 'US' THEN 'USD' ELSE 'JPY' END AS currency, actual, CAST(estimate AS DOUBLE) AS consensus
FROM c WHERE country <> 'FR' AND (upper(event) LIKE '%CPI%' OR upper(event) LIKE '%INFLATION%') AND actual IS NOT NULL""")
def calendar_files(spark, sf_dir):
    """Events as calendar files, one JSON object a line, filtered to releases of prices."""
    path = scratch(spark)
    _calendar_rows(spark, sf_dir).write.json(path)
    return events.inflation_releases(calendar.releases(spark, path, array=False))


def _landed(spark, sf_dir) -> str:
    """Events as bodies of a service, a folder for each quarter of 2024; the last quarter is missing."""
    rows = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.date_format(F.col("ts") + F.make_ym_interval(F.lit(0), (F.col("event_id") % 12).cast("int")), "yyyy-MM-dd HH:mm:ss").alias("date"), "event_id", "value")
    rows = rows.select("date", F.lit("US").alias("country"), F.concat(F.lit("e"), F.col("event_id")).alias("event"), F.lit("USD").alias("currency"), F.col("value").alias("actual"), (F.col("event_id") % 7 + 0.5).cast("double").alias("estimate"))
    start = F.trunc(F.to_date("date"), "quarter")
    rows = rows.withColumn("chunk", F.concat_ws("_", start, F.date_sub(F.add_months(start, 3), 1))).where("date < '2024-10-01'")
    path = scratch(spark)
    rows.write.partitionBy("chunk").json(path)
    return (path if path.startswith("file:") else f"file://{path}") + "/chunk={from}_{to}"


_LAND = "c AS (SELECT strftime(ts + to_months(CAST(event_id % 12 AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS date, 'e' || event_id AS event, value AS actual, CAST(event_id % 7 + 0.5 AS DOUBLE) AS estimate FROM events WHERE event_type = 'error')"


@_R.add(f"WITH {_LAND} SELECT date, event, actual, estimate FROM c WHERE date >= '2024-03-10' AND date < '2024-08-05'")
def calendar_ranges(spark, sf_dir):
    """The calendar source over landed bodies: one task a quarter, only quarters within the asked dates."""
    got = calendar.received(calendar.ranges(spark, _landed(spark, sf_dir), 2023, 2024))
    return got.where("date >= '2024-03-10' AND date < '2024-08-05'").select("date", "event", "actual", "estimate")


@_R.add("SELECT strftime(d, '%Y-%m-%d') AS chunk FROM (SELECT unnest([DATE '2023-01-01', DATE '2023-04-01', DATE '2023-07-01', DATE '2023-10-01', DATE '2024-10-01']) AS d), (SELECT count(*) AS n FROM events WHERE event_type = 'error') WHERE n > 0")
def calendar_failures(spark, sf_dir):
    """Ranges that can't be had are passed over and counted."""
    return calendar.failures(calendar.ranges(spark, _landed(spark, sf_dir), 2023, 2024)).select("chunk")


@_R.add("SELECT n_name AS event, CAST(n_nationkey AS DOUBLE) AS actual, CAST(NULL AS DOUBLE) AS estimate FROM nation")
def calendar_bodies(spark, sf_dir):
    """JSON array texts, as a service returns them: a table of one body for each region."""
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct(F.col("n_name").alias("event"), F.col("n_nationkey").cast("double").alias("actual")))).alias("body"))
    return calendar.parsed(n.select("body")).select("event", "actual", "estimate")


_NODE = "g AS (SELECT CAST(k + 1 AS INTEGER) AS node_id, CAST(c_nationkey + 1 AS INTEGER) AS graph_id, CAST(length(c_mktsegment) AS INTEGER) AS label, k, n FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS k, count(*) OVER () AS n FROM customer))"


def _collection(spark, sf_dir) -> dict[str, DataFrame]:
    """Customers as nodes of graphs by nation, in text files of several parts; node k links to node k + 5."""
    c = ordering.numbered(table(spark, sf_dir, "customer"), ["c_custkey"], place="k", size="n")
    rows = c.repartitionByRange(6, "k").sortWithinPartitions("k")  # part files are named in the order of k
    path, k, n = scratch(spark), F.col("k"), F.col("n")
    for name, line in (
        ("graph_indicator", (F.col("c_nationkey") + 1).cast("string")), ("A", F.concat_ws(", ", k + 1, (k + 5) % n + 1)), ("node_labels", F.length("c_mktsegment").cast("string")),
        ("edge_attributes", F.concat_ws(",", (k + 0.5).cast("string"), F.lit("9"))), ("node_attributes", F.concat_ws(", ", k, F.lit("-5"), n - k)),
    ):
        rows.select(line.alias("value")).write.text(f"{path}/N_{name}.txt")
    rows.select(F.concat_ws(",", F.lit(0), k % 3, k + 1, k % 5, F.lit(99)).alias("value")).write.text(f"{path}/N_timeline.txt")
    return graphs.load(spark, path, "N") | {"timeline": graphs.node_timeline(spark, f"{path}/N_timeline.txt")}


@_R.add(f"WITH {_NODE} SELECT node_id, graph_id, label FROM g")
def graph_file_nodes(spark, sf_dir):
    return _collection(spark, sf_dir)["nodes"].select("node_id", "graph_id", "label")


@_R.add(f"WITH {_NODE} SELECT node_id AS edge_idx, node_id AS src, CAST((k + 5) % n + 1 AS INTEGER) AS dst, 0 AS label, CAST(k + 0.5 AS DOUBLE) AS attr, CAST(k AS INTEGER) AS available_at FROM g")
def graph_file_edges(spark, sf_dir):
    return _collection(spark, sf_dir)["edges"].select("edge_idx", "src", "dst", "label", "attr", "available_at")


@_R.add(f"WITH {_NODE} SELECT a.node_id AS src, b.node_id AS dst, a.graph_id FROM g a JOIN g b ON b.node_id = (a.k + 5) % a.n + 1 WHERE a.graph_id = b.graph_id")
def graph_file_inner_edges(spark, sf_dir):
    c = _collection(spark, sf_dir)
    return graphs_.same_graph_edges(c["edges"].select("src", "dst"), c["nodes"]).select("src", "dst", "graph_id")


@_R.add(f"WITH {_NODE} SELECT DISTINCT graph_id, 0 AS label FROM g")
def graph_file_labels(spark, sf_dir):
    return _collection(spark, sf_dir)["graph_labels"].select("graph_id", "label")


@_R.add(f"WITH {_NODE} SELECT node_id, CAST(j AS INTEGER) AS k, CAST(round(CASE j WHEN 0 THEN k / (n - 1.0) WHEN 1 THEN 0.0 ELSE (n - k - 1) / (n - 1.0) END, 6) AS DOUBLE) AS x FROM (SELECT *, unnest([0, 1, 2]) AS j FROM g)")
def graph_file_attributes(spark, sf_dir):
    return graphs.normalized_attributes(_collection(spark, sf_dir)["nodes"]).select("node_id", "k", r(F.col("x")).alias("x"))


@_R.add(f"WITH {_NODE} SELECT node_id, 0 AS time, CAST(k % 3 AS INTEGER) AS label FROM g UNION ALL SELECT node_id, CAST(k + 1 AS INTEGER), CAST(k % 5 AS INTEGER) FROM g")
def graph_file_timeline(spark, sf_dir):
    return _collection(spark, sf_dir)["timeline"]


#: Each customer has a state from its number modulo 7 on, and another one four steps later.
_STEPS = 8
_TL = f"tl AS (SELECT node_id, graph_id, CAST(k % 7 AS INTEGER) AS first, CAST(k % 3 AS INTEGER) AS one, CAST(k % 5 AS INTEGER) AS two FROM g)"


@_R.add(f"WITH {_NODE}, {_TL} SELECT node_id, graph_id, CAST(t AS INTEGER) AS time, CASE WHEN t >= first + 4 THEN two ELSE one END AS label FROM tl, range(0, {_STEPS + 1}) x(t) WHERE t >= first")
def temporal_snapshot_nodes(spark, sf_dir):
    """Nodes of each snapshot: those that have a state by then, with the latest one."""
    c = ordering.numbered(table(spark, sf_dir, "customer"), ["c_custkey"], place="k", size="n")
    nodes = c.select((F.col("k") + 1).cast("int").alias("node_id"), (F.col("c_nationkey") + 1).cast("int").alias("graph_id"), "k", "n")
    first = F.col("k") % 7
    timeline = nodes.select("node_id", F.inline(F.array(F.struct(first.cast("int").alias("time"), (F.col("k") % 3).cast("int").alias("label")), F.struct((first + 4).cast("int").alias("time"), (F.col("k") % 5).cast("int").alias("label")))))
    edges = nodes.select(F.col("node_id").alias("src"), ((F.col("k") + 5) % F.col("n") + 1).cast("int").alias("dst"), F.lit(0).alias("available_at"))
    states, _ = graphs_.snapshots(nodes.select("node_id", "graph_id"), edges, timeline, _STEPS)
    return states.select("node_id", "graph_id", "time", "label")


@_R.add("""SELECT n_name AS model_id, CAST(n_regionkey AS INTEGER) AS class_id, CAST(round(n_nationkey / 7.0, 5) AS DOUBLE) AS precision, CAST(round(n_nationkey / 11.0, 5) AS DOUBLE) AS recall, CAST(0.5 AS DOUBLE) AS f1, CAST(round(n_regionkey / 3.0, 5) AS DOUBLE) AS accuracy FROM nation""")
def metrics_files(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    path, k = scratch(spark), F.col("n_nationkey")
    market.export_metrics(n.select(F.col("n_name").alias("model_id"), F.col("n_regionkey").cast("int").alias("class_id"), (k / 7.0).alias("precision"), (k / 11.0).alias("recall"), F.lit(0.5).alias("f1"), (F.col("n_regionkey") / 3.0).alias("accuracy")), path)
    return market.metrics(spark, path)


@_R.add("""SELECT date_trunc('hour', ts) AS ts, arg_max(value, (ts, event_id)) AS price FROM events WHERE value IS NOT NULL GROUP BY 1""")
def last_of_hour(spark, sf_dir):
    return market.last_of_hour(table(spark, sf_dir, "events").where("value IS NOT NULL"), "value", ["ts", "event_id"])


# Arrays and vectors ---------------------------------------------------------------------------


@_R.add("""SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber) - 1 AS INTEGER) AS pos, CAST(l_quantity AS DOUBLE) AS key, CAST(l_linenumber AS BIGINT) AS value FROM lineitem""")
def co_sorted(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").cast("long").alias("n"), F.col("l_quantity").cast("double").alias("q")))).alias("x"))
    both = rows.select("l_orderkey", arrays.co_sort(F.col("x.q"), F.col("x.n")).alias("s"))
    return both.select("l_orderkey", F.posexplode(F.arrays_zip("s.keys", "s.values")).alias("pos", "e")).select("l_orderkey", "pos", F.col("e.keys").alias("key"), F.col("e.values").alias("value"))


@_R.add("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark, sf_dir):
    return arrays.by_count(table(spark, sf_dir, "events"), "event_type")


@_R.add("""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS label, CAST(k AS INTEGER) AS k, CAST(CASE k WHEN 0 THEN l_quantity WHEN 1 THEN l_discount ELSE l_tax END AS DOUBLE) AS x
FROM (SELECT *, unnest([0, 1, 2]) AS k FROM lineitem)""")
def feature_vectors(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("n"), *[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_discount", "l_tax")])
    v = features.feature_vector(rows.withColumn("label", F.struct("l_orderkey", "n")), ("l_quantity", "l_discount", "l_tax"))
    return v.select("label.l_orderkey", F.col("label.n").alias("label"), F.posexplode(vector_to_array("features")).alias("k", "x"))
