"""End-to-end flows: label a file, and train the graph learner on labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labels, learner
from ..sources import market
from . import fx_graph

SHAPE_BITS = 1600


def label_rows(df: DataFrame, params: labels.Params = labels.Params()) -> DataFrame:
    """Assembled rows with their regime, label and the lagged label that stands for news."""
    out = labels.look_ahead(df.withColumn("ret_pct", F.col("usdjpy_price")), "ret_pct", params)
    return labels.lagged_label(out, params.ahead)


def label_file(spark: SparkSession, path: str, params: labels.Params = labels.Params()) -> DataFrame:
    return label_rows(market.dataset(spark, path), params)


class _Samples:
    """Literals of samples, made one at a time from their level indices: (layer, vertex, literal).
    Layer 1 is each vertex's message, the OR over its in-edges of source XOR edge."""

    def __init__(self, levels: np.ndarray, codes: list[np.ndarray], edges: list[tuple[int, int, np.ndarray]]):
        self.levels, self.codes, self.edges = levels, codes, edges

    def __len__(self):
        return len(self.levels)

    def __getitem__(self, i: int) -> np.ndarray:
        v = np.stack([c[k] for c, k in zip(self.codes, self.levels[i], strict=True)])
        m = np.zeros_like(v)
        for s, d, e in self.edges:
            m[d] |= v[s] ^ e
        return learner.literals(np.stack([v, m]))

    def __iter__(self):
        return (self[i] for i in range(len(self)))


def fx_search(spark: SparkSession, df: DataFrame, configs: list[learner.Config], seed: int = 34, max_rows: int = 100_000) -> DataFrame:
    """(config columns, n_test, accuracy): trains the two-layer graph learner on the rows whose split
    is `train` and scores it on the others, one task for each configuration. What travels are
    eleven level indices a row; vectors are rebuilt from the codebooks in the task."""
    names = [v for v, *_ in fx_graph.VERTICES]
    at = {v: k for k, v in enumerate(names)}
    lv = fx_graph.levels(df).groupBy("sample").agg(F.map_from_entries(F.collect_list(F.struct("vertex", "level"))).alias("m"))
    order = F.array(*[F.col("m")[v] for v in names])
    rows = lv.select(F.col("sample").alias("ts"), order.alias("levels")).join(df.where("label >= 0 AND split IS NOT NULL").select("ts", "label", "split"), "ts")
    if (n := rows.limit(max_rows + 1).count()) > max_rows:
        raise ValueError(f"a learner takes at most {max_rows} samples, not {n}")
    code_rows = fx_graph.codes(spark, seed).collect()  # a few hundred codes
    codes = [np.unpackbits(np.array([r.code for r in sorted((x for x in code_rows if x.vertex == v), key=lambda x: x.level)], np.int64).view(np.uint8), axis=1, bitorder="little").astype(bool) for v in names]
    rng = np.random.default_rng(seed)
    edges = []
    for s, d, _ in fx_graph.EDGES:
        bits = np.zeros(SHAPE_BITS, bool)
        bits[rng.choice(SHAPE_BITS, SHAPE_BITS // 10, replace=False)] = True
        edges.append((at[s], at[d], bits))
    sent = spark.sparkContext.broadcast(rows.toArrow().sort_by("ts"))  # checked above; eleven numbers a row

    def train(k: int) -> tuple[int, float]:
        t = sent.value
        levels = np.array(t.column("levels").to_pylist(), np.int64).reshape(t.num_rows, len(names))
        y, own = t.column("label").to_numpy().astype(np.int64), np.array(t.column("split").to_pylist()) == "train"
        model = learner.SharedClauses(4, learner.Layout(SHAPE_BITS, len(names), 2), configs[k])
        model.fit(_Samples(levels[own], codes, edges), y[own])
        guess = model.predict(_Samples(levels[~own], codes, edges))
        return len(guess), float((guess == y[~own]).mean()) if len(guess) else 0.0

    return learner.each_config(spark, configs, train)
