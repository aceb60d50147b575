"""Connected components over an edge table, without gathering it anywhere.

Alternating large-star and small-star steps: each is one grouped aggregate, after which the
longest path has shrunk by a constant factor, so a few rounds suffice even for long chains.
Every round's edges are written to the shared folder, which cuts the lineage and survives a
lost executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a > b). Large star links every larger neighbour, small star every
    smaller one and the node itself, to the smallest of the node and its neighbours."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(low, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the edges (a, b), long ids; the component is its
    smallest node. Self-links and repeated edges are allowed; no edges give no rows."""
    cur = edges.where("a is not null and b is not null and a <> b")
    cur = cur.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    cur = common.materialize(cur, "edges")
    before = None
    for _ in range(max_rounds):
        nxt = common.materialize(_star(_star(cur, True), False), "edges")
        # a fixed point has one smaller neighbour per node; its size and sum then stay as they are
        now = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        common.forget(cur)
        cur = nxt
        if (now.n, now.s) == before:
            break
        before = (now.n, now.s)
    else:
        raise RuntimeError("components did not converge")
    roots = cur.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
