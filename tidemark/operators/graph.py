"""Graphs as two tables, vertices and edges: joins, messages, whole-graph vectors, snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codebooks, hv
from .series import Series

# Editing -----------------------------------------------------------------------------------


def insert_vertices(vertices: DataFrame, new: DataFrame, key: str = "vertex") -> DataFrame:
    """Adds vertices whose key isn't there yet; what is there stays as it is."""
    return vertices.unionByName(new.dropDuplicates([key]).join(vertices.select(key), key, "left_anti").select(*vertices.columns))


def insert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Adds edges whose ends aren't linked yet in that direction."""
    return edges.unionByName(new.dropDuplicates(["src", "dst"]).join(edges.select("src", "dst"), ["src", "dst"], "left_anti").select(*edges.columns))


def remove_vertices(vertices: DataFrame, edges: DataFrame, gone: DataFrame, key: str = "vertex") -> tuple[DataFrame, DataFrame]:
    """Drops vertices and every edge that touches one."""
    g = gone.select(F.col(key)).distinct()
    left = edges.join(g.withColumnRenamed(key, "src"), "src", "left_anti").join(g.withColumnRenamed(key, "dst"), "dst", "left_anti")
    return vertices.join(g, key, "left_anti"), left.select(*edges.columns)


def replace_vertex(vertices: DataFrame, edges: DataFrame, old, new, key: str = "vertex") -> tuple[DataFrame, DataFrame]:
    """Renames a vertex wherever it occurs."""
    swap = lambda c: F.when(F.col(c) == old, F.lit(new)).otherwise(F.col(c))
    return vertices.withColumn(key, swap(key)), edges.withColumns({"src": swap("src"), "dst": swap("dst")})


def merge_graphs(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    return insert_vertices(a[0], b[0]), insert_edges(a[1], b[1])


# Looking -----------------------------------------------------------------------------------


def in_edges(edges: DataFrame, of: DataFrame, key: str = "vertex") -> DataFrame:
    return edges.join(of.select(F.col(key).alias("dst")).distinct(), "dst", "left_semi")


def out_edges(edges: DataFrame, of: DataFrame, key: str = "vertex") -> DataFrame:
    return edges.join(of.select(F.col(key).alias("src")).distinct(), "src", "left_semi")


def opposite(edges: DataFrame, vertex) -> DataFrame:
    """The other end of every edge that touches a vertex."""
    return edges.where((F.col("src") == vertex) | (F.col("dst") == vertex)).withColumn("opposite", F.when(F.col("src") == vertex, F.col("dst")).otherwise(F.col("src")))


def adjacent(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (u, v) with an edge from u to v."""
    return pairs.join(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct(), ["u", "v"], "left_semi")


def degrees(vertices: DataFrame, edges: DataFrame, key: str = "vertex") -> DataFrame:
    """(vertex, in_degree, out_degree)."""
    ends = edges.select(F.col("dst").alias(key), F.lit(1).alias("i"), F.lit(0).alias("o")).union(edges.select(F.col("src").alias(key), F.lit(0).alias("i"), F.lit(1).alias("o")))
    n = ends.groupBy(key).agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return vertices.select(key).join(n, key, "left").select(key, F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def by_importance(vertices: DataFrame) -> DataFrame:
    """Vertices of a graph from the most important down; ties by name."""
    return vertices.orderBy(F.desc("importance"), "vertex")


def sample_vectors(layers: DataFrame, vertices: DataFrame, sample) -> DataFrame:
    """One sample's layer-0 vectors in order of importance."""
    return layers.where((F.col("sample") == sample) & (F.col("layer") == 0)).join(vertices.select("vertex", "importance"), "vertex").orderBy(F.desc("importance"), "vertex")


def same_graph_edges(edges: DataFrame, nodes: DataFrame, node: str = "node_id", graph: str = "graph_id") -> DataFrame:
    """Edges whose ends are in one graph, with its id."""
    g = nodes.select(F.col(node), F.col(graph))
    a = edges.join(g.withColumnsRenamed({node: "src", graph: "_a"}), "src").join(g.withColumnsRenamed({node: "dst", graph: "_b"}), "dst")
    return a.where("_a = _b").withColumnRenamed("_a", graph).drop("_b")


def dense_ids(df: DataFrame, column: str, out: str = "dense_id") -> DataFrame:
    """Ranks of the distinct values from 0. Only the distinct values are ordered together; they
    are joined back."""
    ranks = df.select(column).distinct().withColumn(out, (F.dense_rank().over(Window.orderBy(column)) - 1).cast("int"))
    return df.join(ranks, column)


def min_max(df: DataFrame, columns: Sequence[str], digits: int | None = None) -> DataFrame:
    """Columns scaled to 0..1 over the table; 0 for a constant column."""
    row = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])  # one row
    out = df.join(F.broadcast(row))
    for c in columns:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        x = F.when(hi == lo, 0.0).otherwise((F.col(c) - lo) / (hi - lo))
        out = out.withColumn(c, F.round(x, digits) if digits is not None else x)
    return out.drop(*[f"_{n}_{c}" for c in columns for n in ("lo", "hi")])


def with_default_class(df: DataFrame, labels: DataFrame, key: str, label: str = "label", default: int = 0) -> DataFrame:
    return df.join(labels.select(key, label), key, "left").withColumn(label, F.coalesce(F.col(label), F.lit(default)))


# Messages ----------------------------------------------------------------------------------


def messages(edges: DataFrame, layer: DataFrame, keys: Sequence[str] = ("sample",), vector: str = "hv", edge_vector: str = "edge_hv") -> DataFrame:
    """(dst, keys, word_index, word): at each vertex the OR over its in-edges of source XOR edge.
    Vertices without an in-edge have no row, that is a zero vector."""
    m = edges.join(layer, edges["src"] == layer["vertex"]).select("dst", *keys, hv.bind(F.col(vector), F.col(edge_vector)).alias("hv"))
    return hv.bundle_or(m, ["dst", *keys], "hv")


def gated_messages(edges: DataFrame, layer: DataFrame, fired: DataFrame, keys: Sequence[str] = ("sample",), vector: str = "hv", edge_vector: str = "edge_hv") -> DataFrame:
    """messages() of those sources where some clause fires."""
    ok = fired.select("vertex", *keys).distinct()
    return messages(edges, layer.join(ok, ["vertex", *keys], "left_semi"), keys, vector, edge_vector)


def gate(layer: DataFrame, fired: DataFrame, keys: Sequence[str] = ("sample",), vector: str = "hv") -> DataFrame:
    """The vector of a vertex where any clause fires at it, else the zero vector."""
    ok = fired.select("vertex", *keys).distinct().withColumn("_on", F.lit(True))
    zero = F.transform(F.col(vector), lambda x: F.lit(0).cast("long"))
    return layer.join(ok, ["vertex", *keys], "left").withColumn(vector, F.when(F.col("_on"), F.col(vector)).otherwise(zero)).drop("_on")


def edge_vectors(edges: DataFrame, layer: DataFrame, embedding: DataFrame | None = None, keys: Sequence[str] = ("sample",), vector: str = "hv", edge_vector: str = "edge_hv") -> DataFrame:
    """(src, dst, keys, hv): source XOR edge XOR target, XOR the target's embedding if given."""
    s = layer.select(F.col("vertex").alias("src"), *keys, F.col(vector).alias("_s"))
    d = layer.select(F.col("vertex").alias("dst"), *keys, F.col(vector).alias("_d"))
    x = edges.join(s, "src").join(d, ["dst", *keys])
    out = hv.bind(hv.bind(F.col("_s"), F.col(edge_vector)), F.col("_d"))
    if embedding is not None:
        x = x.join(embedding.select(F.col("vertex").alias("dst"), F.col("hv").alias("_e")), "dst")
        out = hv.bind(out, F.col("_e"))
    return x.select("src", "dst", *keys, out.alias("hv"))


def graph_vector(edges: DataFrame, layer: DataFrame, embedding: DataFrame | None = None, keys: Sequence[str] = ("sample",), shape: hv.Shape = hv.PRODUCTION) -> DataFrame:
    """(keys, bit, votes): top-K bundle of a sample's edge vectors."""
    return hv.bundle_top(edge_vectors(edges, layer, embedding, keys), list(keys), "hv", shape)


def nearest_edges(edge_rows: DataFrame, target: Sequence[int], top: int) -> DataFrame:
    """The edges whose vectors are nearest to a recovered vector, ties to the first by name."""
    t = F.array(*[F.lit(int(x)).cast("long") for x in target])
    return edge_rows.withColumn("distance", hv.hamming(F.col("hv"), t)).orderBy("distance", "src", "dst").limit(top)


def importance_vectors(vertices: DataFrame, edges: DataFrame, low: float = 0.0, high: float = 2.0, edge_levels: int = 10, vertex_levels: int = 40, seed: int = 34) -> tuple[DataFrame, DataFrame]:
    """(vertex, hv) and (src, dst, edge_hv): vectors of importances, from independent codes for
    vertices and a linear codebook for edges."""
    spark = vertices.sparkSession
    out = []
    for df, keys, n, book, name in ((vertices, ["vertex"], vertex_levels, codebooks.interval_levels, "hv"), (edges, ["src", "dst"], edge_levels, codebooks.linear_levels, "edge_hv")):
        codes = codebooks.table(spark, book(n, seed))  # n rows
        out.append(df.withColumn("level", codebooks.bucket(F.col("importance"), low, high, n)).join(F.broadcast(codes), "level").select(*keys, F.col("code").alias(name)))
    return out[0], out[1]


# Time --------------------------------------------------------------------------------------


#: Rows of one key that are one ordered run; longer time lines are cut into chunks.
ONE_RUN = 1_000_000


def as_of(left: DataFrame, right: DataFrame, key: Sequence[str], time: str, value: str, chunks: int | None = None) -> DataFrame:
    """Adds the right side's latest non-null value at or before each left time. Both sides are one union,
    ordered by key and time; no pairs are made. Ties of time on the right take the largest value. A null
    key or time meets nothing. Where no key has many rows, an ordered run by key gives it in one
    shuffle; else (or with `chunks`) time lines are cut into chunks, and the last value of a chunk is
    carried over its border, so that a key with most of the rows is as many tasks as its share."""
    known = F.lit(True)
    for c in (*key, time):
        known = known & F.col(c).isNotNull()
    kind = dict(right.dtypes)[value]
    a = left.withColumn("_s", F.struct(*left.columns))
    b = right.where(known).groupBy(*key, time).agg(F.max(value).alias("_v"))
    b = b.select(*key, time, F.lit(None).cast(a.schema["_s"].dataType).alias("_s"), "_v", F.lit(0).alias("_o"))
    both = a.where(known).select(*key, time, "_s", F.lit(None).cast(kind).alias("_v"), F.lit(1).alias("_o")).unionByName(b)
    longest = (both.groupBy(*key).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n or 0) if chunks is None else None
    if longest is not None and longest <= ONE_RUN:
        w = Window.partitionBy(*key).orderBy(time, "_o").rowsBetween(Window.unboundedPreceding, 0)
        out = both.withColumn("_found", F.last("_v", ignorenulls=True).over(w))
    else:
        out = Series.of(both, time, key, chunks, ties=["_o"]).filled({"_found": F.col("_v")}).rows
    out = out.where("_o = 1").select("_s.*", F.col("_found").alias(value))
    return out.unionByName(a.where(~known).select("_s.*", F.lit(None).cast(kind).alias(value)))


def snapshot_edges(edges: DataFrame, max_time: int, available: str = "available_at") -> DataFrame:
    """Adds time: an edge is in every snapshot from when it is available to max_time."""
    first = F.greatest(F.col(available), F.lit(0))
    return edges.where(F.col(available) <= max_time).withColumn("time", F.explode(F.sequence(first, F.lit(max_time))))


def snapshots(nodes: DataFrame, edges: DataFrame, timeline: DataFrame, max_time: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, graph_id, time, label) and edges (graph_id, src, dst, time) of each snapshot:
    a node is there once it has a label, an edge once it is available and both its ends are."""
    grid = nodes.select("node_id", "graph_id", F.explode(F.sequence(F.lit(0), F.lit(max_time))).alias("time"))
    states = as_of(grid, timeline, ["node_id"], "time", "label").where("label IS NOT NULL")
    e = snapshot_edges(same_graph_edges(edges, nodes), max_time)
    alive = states.select("node_id", "time")
    e = e.join(alive.withColumnRenamed("node_id", "src"), ["src", "time"], "left_semi").join(alive.withColumnRenamed("node_id", "dst"), ["dst", "time"], "left_semi")
    return states, e.select("graph_id", "src", "dst", "time")
