"""Queries over graphs: suppliers, nations and regions; orders and lines; event timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codebooks, hv
from ..operators import graph
from . import fx_graph, market_queries
from .base import Registry, rounded, table

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql
MASK = 4294967295
NATION, REGION = 1_000_000, 2_000_000


def _word(x, k: int):
    return (x * 1103515245 + 12345 * (k + 1)).bitwiseAND(F.lit(MASK))


def _edge_word(k: int):
    return (F.col("src") * 40503 + F.col("dst") * 265443 + 97 * k).bitwiseAND(F.lit(MASK))


def _edges(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("src"), (F.col("s_nationkey").cast("long") + NATION).alias("dst"))
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey").cast("long") + NATION).alias("src"), (F.col("n_regionkey").cast("long") + REGION).alias("dst"))
    return s.union(n).withColumn("edge_hv", F.array(_edge_word(0), _edge_word(1)))


def _layer(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("vertex"))
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey").cast("long") + NATION).alias("vertex"))
    g = table(spark, sf_dir, "region").select((F.col("r_regionkey").cast("long") + REGION).alias("vertex"))
    return s.union(n).union(g).select("vertex", F.lit(0).alias("sample"), F.array(_word(F.col("vertex"), 0), _word(F.col("vertex"), 1)).alias("hv"))


_E = f"""e AS (SELECT src, dst, (src * 40503 + dst * 265443) & {MASK} AS e0, (src * 40503 + dst * 265443 + 97) & {MASK} AS e1 FROM (
  SELECT s_suppkey AS src, CAST(s_nationkey AS BIGINT) + {NATION} AS dst FROM supplier UNION ALL SELECT CAST(n_nationkey AS BIGINT) + {NATION}, CAST(n_regionkey AS BIGINT) + {REGION} FROM nation))"""
_L = f"""l AS (SELECT vertex, (vertex * 1103515245 + 12345) & {MASK} AS w0, (vertex * 1103515245 + 24690) & {MASK} AS w1 FROM (
  SELECT s_suppkey AS vertex FROM supplier UNION ALL SELECT CAST(n_nationkey AS BIGINT) + {NATION} FROM nation UNION ALL SELECT CAST(r_regionkey AS BIGINT) + {REGION} FROM region))"""


def _two(expr: str, src: str, keys: str, group: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {keys}, {w} AS word_index, CAST({expr.replace('#', str(w))} AS BIGINT) AS word FROM {src} {group}" for w in (0, 1))


@_R.add(f"WITH {_E}, {_L} " + _two("bit_or(xor(w#, e#))", "e JOIN l ON l.vertex = e.src", "dst, 0 AS sample", "GROUP BY dst"))
def in_neighbor_message(spark, sf_dir):
    return graph.messages(_edges(spark, sf_dir), _layer(spark, sf_dir))


def _on(spark, sf_dir) -> DataFrame:
    return _layer(spark, sf_dir).where("vertex % 3 = 0").select("vertex", "sample")


@_R.add(f"WITH {_E}, {_L} " + _two("bit_or(xor(w#, e#))", "e JOIN l ON l.vertex = e.src AND vertex % 3 = 0", "dst, 0 AS sample", "GROUP BY dst"))
def gated_message(spark, sf_dir):
    return graph.gated_messages(_edges(spark, sf_dir), _layer(spark, sf_dir), _on(spark, sf_dir))


@_R.add(f"WITH {_L} " + _two("CASE WHEN vertex % 3 = 0 THEN w# ELSE 0 END", "l", "vertex"))
def gated_layer(spark, sf_dir):
    return hv.exploded(graph.gate(_layer(spark, sf_dir), _on(spark, sf_dir)), ["vertex"])


@_R.add(f"WITH {_E}, {_L} " + _two("xor(xor(s.w#, e#), d.w#)", "e JOIN l s ON s.vertex = e.src JOIN l d ON d.vertex = e.dst", "src, dst"))
def edge_hypervector(spark, sf_dir):
    return hv.exploded(graph.edge_vectors(_edges(spark, sf_dir), _layer(spark, sf_dir)), ["src", "dst"])


@_R.add(f"""WITH {_E}, {_L}, x AS (SELECT xor(xor(s.w0, e0), d.w0) AS w0, xor(xor(s.w1, e1), d.w1) AS w1 FROM e JOIN l s ON s.vertex = e.src JOIN l d ON d.vertex = e.dst),
b AS (SELECT unnest(range(0, 64)) AS i, w0, w1 FROM x), c AS (SELECT CAST(i AS INTEGER) AS bit, CAST(sum((CASE WHEN i < 32 THEN w0 ELSE w1 END >> CAST(i % 32 AS INTEGER)) & 1) AS BIGINT) AS votes FROM b GROUP BY 1)
SELECT 0 AS sample, bit, votes FROM (SELECT *, row_number() OVER (ORDER BY votes DESC, bit) AS rn FROM c WHERE votes > 0) WHERE rn <= 12""")
def graph_hypervector(spark, sf_dir):
    return graph.graph_vector(_edges(spark, sf_dir), _layer(spark, sf_dir), shape=hv.SMALL)


@_R.add(f"""WITH {_E} SELECT src, dst, CAST(bit_count(xor(e0, 123456789)) + bit_count(xor(e1, 987654321)) AS INTEGER) AS distance FROM e ORDER BY distance, src, dst LIMIT 10""")
def nearest_edge_topk(spark, sf_dir):
    e = _edges(spark, sf_dir).withColumnRenamed("edge_hv", "hv")
    return graph.nearest_edges(e, [123456789, 987654321], 10).select("src", "dst", "distance")


@_R.add(f"WITH {_E} SELECT s_suppkey AS u, n_nationkey + {NATION} AS v FROM (SELECT s_suppkey, CAST(s_suppkey % 25 AS BIGINT) AS n_nationkey FROM supplier) WHERE EXISTS (SELECT 1 FROM e WHERE src = s_suppkey AND dst = n_nationkey + {NATION})")
def adjacency(spark, sf_dir):
    pairs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("u"), (F.col("s_suppkey") % 25 + NATION).alias("v"))
    return graph.adjacent(pairs, _edges(spark, sf_dir).drop("edge_hv"))


@_R.add(f"WITH {_E}, {_L} SELECT vertex, CAST((SELECT count(*) FROM e WHERE dst = vertex) AS BIGINT) AS in_degree, CAST((SELECT count(*) FROM e WHERE src = vertex) AS BIGINT) AS out_degree FROM l")
def degrees(spark, sf_dir):
    return graph.degrees(_layer(spark, sf_dir), _edges(spark, sf_dir)).select("vertex", F.col("in_degree").cast("long").alias("in_degree"), F.col("out_degree").cast("long").alias("out_degree"))


@_R.add(f"WITH {_E} SELECT src, dst FROM e WHERE src % 7 <> 0 AND dst % 7 <> 0")
def remove_vertices(spark, sf_dir):
    layer = _layer(spark, sf_dir)
    return graph.remove_vertices(layer, _edges(spark, sf_dir), layer.where("vertex % 7 = 0"))[1].select("src", "dst")


@_R.add("""SELECT l_partkey AS src, l_suppkey AS dst, CAST(l_partkey % 25 AS INTEGER) AS graph_id, l_orderkey, l_linenumber FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE l_partkey % 25 = s_nationkey""")
def same_graph_edges(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("node_id"), F.col("s_nationkey").alias("graph_id"))
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("node_id"), (F.col("p_partkey") % 25).cast("int").alias("graph_id"))
    e = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("dst"), "l_orderkey", "l_linenumber")
    out = graph.same_graph_edges(e, s.union(p))
    return out.select(F.substring("src", 2, 20).cast("long").alias("src"), F.substring("dst", 2, 20).cast("long").alias("dst"), "graph_id", "l_orderkey", "l_linenumber")


@_R.add("""WITH v AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT p.event_id, p.user_id, v.value AS value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def temporal_asof_state(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return graph.as_of(left, e.where("event_type = 'view'").select("user_id", "ts", "value"), ["user_id"], "ts", "value").select("event_id", "user_id", "value")


@_R.add("""WITH o AS (SELECT o_custkey AS src, o_orderkey AS dst, CAST(year(o_orderdate) - 1992 AS INTEGER) AS available_at FROM orders)
SELECT src, dst, available_at, CAST(unnest(range(greatest(available_at, 0), 9)) AS INTEGER) AS time FROM o WHERE available_at <= 8""")
def temporal_snapshot_edges(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), (F.year("o_orderdate") - 1992).alias("available_at"))
    return graph.snapshot_edges(o, 8)


@_R.add("""WITH m AS (SELECT min(l_quantity) a, max(l_quantity) b, min(l_tax) c, max(l_tax) d FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN a = b THEN 0.0 ELSE round((l_quantity - a) / (b - a), 6) + 0.0 END AS l_quantity, CASE WHEN c = d THEN 0.0 ELSE round((l_tax - c) / (d - c), 6) + 0.0 END AS l_tax FROM lineitem, m""")
def minmax_attributes(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax")
    return rounded(graph.min_max(df, ["l_quantity", "l_tax"]), ["l_quantity", "l_tax"])


@_R.add("SELECT p_partkey, p_size, CAST(dense_rank() OVER (ORDER BY p_size) - 1 AS INTEGER) AS dense_id FROM part")
def dense_class_ids(spark, sf_dir):
    return graph.dense_ids(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size").select("p_partkey", "p_size", "dense_id")


@_R.add("SELECT d.doc_id, CAST(coalesce(l.toxic, 0) AS INTEGER) AS label FROM (SELECT DISTINCT l_suppkey AS doc_id FROM lineitem) d LEFT JOIN labels l USING (doc_id)")
def default_class_join(spark, sf_dir):
    left = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id")).distinct()
    right = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return graph.with_default_class(left, right, "doc_id")


# Looking and editing ---------------------------------------------------------------------------


def _important(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation").select((F.col("n_nationkey").cast("long") + NATION).alias("vertex"), (F.col("n_nationkey") % 7).cast("double").alias("importance"))


_IMP = f"i AS (SELECT CAST(n_nationkey AS BIGINT) + {NATION} AS vertex, CAST(n_nationkey % 7 AS DOUBLE) AS importance FROM nation)"


@_R.add(f"WITH {_IMP} SELECT vertex, importance FROM i ORDER BY importance DESC, vertex LIMIT 9")
def most_important(spark, sf_dir):
    return graph.by_importance(_important(spark, sf_dir)).limit(9)


@_R.add(f"WITH {_IMP}, {_L} SELECT vertex, importance, w0, w1 FROM l JOIN i USING (vertex)")
def sample_vectors(spark, sf_dir):
    layers = _layer(spark, sf_dir).withColumn("layer", F.lit(0))
    both = layers.unionByName(layers.withColumn("sample", F.lit(1))).unionByName(layers.withColumn("layer", F.lit(1)))
    return graph.sample_vectors(both, _important(spark, sf_dir), 0).select("vertex", "importance", F.col("hv").getItem(0).alias("w0"), F.col("hv").getItem(1).alias("w1"))


@_R.add(f"WITH {_E} SELECT src, dst FROM e WHERE dst % 5 = 0")
def edges_into(spark, sf_dir):
    return graph.in_edges(_edges(spark, sf_dir), _layer(spark, sf_dir).where("vertex % 5 = 0")).select("src", "dst")


@_R.add(f"WITH {_E} SELECT src, dst FROM e WHERE src % 5 = 0")
def edges_out_of(spark, sf_dir):
    return graph.out_edges(_edges(spark, sf_dir), _layer(spark, sf_dir).where("vertex % 5 = 0")).select("src", "dst")


@_R.add(f"WITH {_E} SELECT src, dst, 1 AS old FROM e UNION ALL SELECT DISTINCT dst, src, 0 FROM e")
def inserted_edges(spark, sf_dir):
    """Every edge and its reverse, which isn't there yet; edges that are there are not added again."""
    e = _edges(spark, sf_dir).select("src", "dst", F.lit(1).alias("old"))
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0).alias("old"))
    return graph.insert_edges(e, back.unionByName(e.withColumn("old", F.lit(0))))


@_R.add(f"WITH {_E} SELECT CASE WHEN src = {NATION} THEN -1 ELSE src END AS src, CASE WHEN dst = {NATION} THEN -1 ELSE dst END AS dst FROM e")
def replaced_vertex(spark, sf_dir):
    return graph.replace_vertex(_layer(spark, sf_dir), _edges(spark, sf_dir).select("src", "dst"), NATION, -1)[1]


@_R.add(f"WITH {_IMP} SELECT CAST(importance AS INTEGER) AS key, min(vertex) AS vertex FROM i GROUP BY 1")
def unique_by_key(spark, sf_dir):
    """Vertices added by key one at a time, from the smallest: of equal keys the first stays."""
    v = _important(spark, sf_dir).select(F.col("importance").cast("int").alias("key"), "vertex")
    out = v.limit(0)
    for k in range(4):  # nations in four runs of names
        part = v.where(F.floor((F.col("vertex") - NATION) / 7) == k)
        out = graph.insert_vertices(out, part, "key")
    return out


@_R.add("""WITH i AS (SELECT s_suppkey AS src, CAST(s_nationkey AS BIGINT) + 1000000 AS dst, (s_suppkey % 20) / 10.0 AS x FROM supplier)
SELECT src, dst, CAST(160 + least(9, floor((x + 0.001) / (2.002 / 10))) AS INTEGER) AS n_bits, 160 AS src_bits, CAST(least(39, floor((x + 0.001) / (2.002 / 40))) AS BIGINT) AS src_level FROM i""")
def importance_codes(spark, sf_dir):
    """Vectors of importances: linear codes of edges have a bit more each level, codes of vertices are
    independent; suppliers of equal importance share theirs, so the code tells the level."""
    s = table(spark, sf_dir, "supplier").withColumn("importance", (F.col("s_suppkey") % 20) / 10.0)
    edges = s.select(F.col("s_suppkey").alias("src"), (F.col("s_nationkey").cast("long") + NATION).alias("dst"), "importance")
    v, e = graph.importance_vectors(s.select(F.col("s_suppkey").alias("vertex"), "importance"), edges)
    book = codebooks.table(spark, codebooks.interval_levels(40)).select(F.col("level").cast("long").alias("src_level"), "code")
    v = v.join(F.broadcast(book), v["hv"] == book["code"]).select(F.col("vertex").alias("src"), "src_level", hv.popcount(F.col("hv")).alias("src_bits"))  # forty rows
    return e.join(v, "src").select("src", "dst", hv.popcount(F.col("edge_hv")).alias("n_bits"), "src_bits", "src_level")


def _fx_sql() -> str:
    """Each vertex's level of the assembled rows, by its own bounds."""
    out = []
    for v, _, (kind, low, high, n), column in fx_graph.VERTICES:
        x = f"CAST({column} AS DOUBLE)"
        if kind == "fixed":
            level = f"greatest(0, least({n - 1}, {x}))"
        else:
            lo, hi = low - 0.001, high + 0.001
            inside = f"CASE WHEN {x} < {lo!r} THEN CAST({lo + 0.001!r} AS DOUBLE) WHEN {x} > {hi!r} THEN CAST({hi - 0.001!r} AS DOUBLE) ELSE {x} END"
            level = f"greatest(0, least({n - 1}, floor(({inside} - CAST({lo!r} AS DOUBLE)) / CAST({(hi - lo) / n!r} AS DOUBLE))))"
        out.append(f"SELECT ts AS sample, '{v}' AS vertex, CAST({level} AS INTEGER) AS level FROM asm")
    return f"WITH asm AS (SELECT *, extract('hour' FROM ts) % 4 AS news_level FROM ({market_queries.ORACLE_SQL['assemble']})) " + " UNION ALL ".join(out)


@_R.add(_fx_sql())
def fx_levels(spark, sf_dir):
    """The FX graph's vertices at each assembled row, as levels of their codebooks."""
    return fx_graph.levels(market_queries.assemble(spark, sf_dir).withColumn("news_level", F.hour("ts") % 4))
