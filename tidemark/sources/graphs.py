"""Graph collections in text files, where an item's number is its line number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no from 1, value) of a text file, or of a folder's files in the order of their names. Lines stay
    in the splits that they are read in and are numbered there; the sizes of the splits, one row each,
    give what to add. The table is kept first, as splits follow the number of cores of the moment."""
    where = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    df = session.kept(spark.read.text(path).select("value", where.alias("_split"), F.monotonically_increasing_id().alias("_at")), "lines")
    splits = sorted(df.groupBy("_split").agg(F.min("_at").alias("first"), F.count("*").alias("n")).collect(), key=lambda r: tuple(r["_split"]))
    before, offsets = 0, []
    for r in splits:
        offsets.append((r["_split"], before - r["first"]))
        before += r["n"]
    add = spark.createDataFrame(offsets, df.select("_split", "_at").schema).withColumnRenamed("_at", "_add")
    return df.join(F.broadcast(add), "_split").select((F.col("_at") + F.col("_add") + 1).alias("line_no"), "value")  # a row a split


def _optional(spark: SparkSession, path: str) -> DataFrame | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return lines(spark, path) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None  # noqa: SLF001


def load(spark: SparkSession, folder: str, name: str) -> dict[str, DataFrame]:
    """nodes(node_id, graph_id, label, attrs), edges(edge_idx, src, dst, label, attr, available_at)
    and graph_labels(graph_id, label); missing labels are 0, missing attributes null."""
    base = f"{folder.rstrip('/')}/{name}_"
    number = lambda x, t="int": F.trim(x).try_cast(t)
    nodes = lines(spark, base + "graph_indicator.txt").select(F.col("line_no").cast("int").alias("node_id"), number(F.col("value")).alias("graph_id"))
    ends = F.split("value", ",")
    edges = lines(spark, base + "A.txt").select(F.col("line_no").cast("int").alias("edge_idx"), number(ends[0]).alias("src"), number(ends[1]).alias("dst"))

    def attach(df: DataFrame, key: str, file: str, column: str, value) -> DataFrame:
        more = _optional(spark, base + file)
        if more is None:
            return df.withColumn(column, F.lit(None).cast("int") if column != "attrs" else F.lit(None).cast("array<double>"))
        return df.join(more.select(F.col("line_no").cast("int").alias(key), value.alias(column)), key, "left")

    numbers = F.transform(F.split("value", ","), lambda x: F.trim(x).try_cast("double"))
    nodes = attach(nodes, "node_id", "node_labels.txt", "label", number(F.col("value"))).withColumn("label", F.coalesce("label", F.lit(0)))
    nodes = attach(nodes, "node_id", "node_attributes.txt", "attrs", numbers)
    edges = attach(edges, "edge_idx", "edge_labels.txt", "label", number(F.col("value"))).withColumn("label", F.coalesce("label", F.lit(0)))
    edges = attach(edges, "edge_idx", "edge_attributes.txt", "attr", number(F.split("value", ",")[0], "double"))
    edges = edges.withColumn("available_at", F.col("attr").cast("int"))
    labels = _optional(spark, base + "graph_labels.txt")
    labels = nodes.select("graph_id", F.lit(0).alias("label")).distinct() if labels is None else labels.select(F.col("line_no").cast("int").alias("graph_id"), number(F.col("value")).alias("label"))
    return {"nodes": nodes, "edges": edges, "graph_labels": labels}


def node_timeline(spark: SparkSession, path: str) -> DataFrame:
    """(node_id, time, label) of lines `t,label,t,label,...`; an odd rest is ignored."""
    parts = F.transform(F.split("value", ","), lambda x: F.trim(x).try_cast("int"))
    df = lines(spark, path).select(F.col("line_no").cast("int").alias("node_id"), parts.alias("p")).where("size(p) >= 2")
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("p") / 2).cast("int") - 1), lambda k: F.struct(F.get("p", 2 * k).alias("time"), F.get("p", 2 * k + 1).alias("label")))
    return df.select("node_id", F.explode(pairs).alias("x")).select("node_id", "x.time", "x.label")


def normalized_attributes(nodes: DataFrame) -> DataFrame:
    """Attributes scaled to 0..1 by position over all nodes, 0 where one is constant."""
    long = nodes.select("node_id", F.posexplode("attrs").alias("k", "x"))
    ends = long.groupBy("k").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    scaled = F.when(F.col("hi") == F.col("lo"), 0.0).otherwise((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return long.join(ends, "k").select("node_id", "k", scaled.alias("x"))
