"""Regime labels: instantaneous regimes and the majority of those ahead."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import Series

UNLABELLED = -1


@dataclass(frozen=True)
class Params:
    volatility: float = 0.08
    efficiency: float = 0.35
    ahead: int = 72
    er_period: int = 20
    digits: int = 6  # the ratio is rounded before it meets its threshold


def regime(high_vol: Column, high_eff: Column) -> Column:
    """0 stagnant, 1 grind, 2 choppy, 3 trend."""
    return (2 * high_vol.cast("int") + high_eff.cast("int")).cast("int")


def return_efficiency(df: DataFrame, ret: str, out: str, params: Params = Params(), by: Sequence[str] = (), ts: str = "ts", w=None) -> DataFrame:
    """|sum| / sum of |returns| over the last rows, between 0 and 1; 0 without movement. In windows of w
    or of whole groups."""
    w = (Window.partitionBy(*by).orderBy(ts) if w is None else w).rowsBetween(-(params.er_period - 1), 0)
    path = F.sum(F.abs(F.col(ret))).over(w)
    ratio = F.when(path == 0, 0.0).otherwise(F.least(F.lit(1.0), F.abs(F.sum(ret).over(w)) / path))
    return df.withColumn(out, F.round(ratio, params.digits))


def majority(counts: Sequence[Column]) -> Column:
    """Class with the largest count, ties to the lowest."""
    best = F.greatest(*counts)
    out = F.lit(len(counts) - 1)
    for k in range(len(counts) - 2, -1, -1):
        out = F.when(counts[k] == best, F.lit(k)).otherwise(out)
    return out.cast("int")


def labelled(df: DataFrame | Series, ret: str = "ret_pct", params: Params = Params(), by: Sequence[str] = (), ts: str = "ts", chunks: int | None = None) -> Series:
    """look_ahead() as a series, for what goes on with it."""
    p, series = params, Series.of(df, ts, by, chunks)

    def add(rows: DataFrame, w) -> DataFrame:
        rows = return_efficiency(rows, ret, "er", p, w=w)
        rows = rows.withColumn("regime", regime(F.abs(F.col(ret)) >= p.volatility, F.col("er") >= p.efficiency))
        near = w.rowsBetween(1, p.ahead)
        counts = [F.sum(F.when(F.col("regime") == k, 1).otherwise(0)).over(near) for k in range(4)]
        early, late = F.col("_i") < p.er_period, F.col("_i") + p.ahead >= F.col("_n")
        return rows.withColumn("label", F.when(early | late, UNLABELLED).otherwise(majority(counts)).cast("int"))

    return series.windowed(add, behind=p.er_period, ahead=p.ahead)


def look_ahead(df: DataFrame | Series, ret: str = "ret_pct", params: Params = Params(), by: Sequence[str] = (), ts: str = "ts", chunks: int | None = None) -> DataFrame:
    """Adds the regime of each row and its label, the majority of the regimes of the next rows;
    -1 without enough rows behind or ahead. The rolling ratio is computed once for each row, so
    the work is linear in the sum of both windows."""
    return labelled(df, ret, params, by, ts, chunks).frame()


def distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def lagged_label(df: DataFrame | Series, rows: int = 72, label: str = "label", by: Sequence[str] = (), ts: str = "ts", chunks: int | None = None) -> DataFrame:
    """The label of the row some rows before, that of the first row where there is none; as a
    level, so that no label is level 0."""

    def add(df: DataFrame, w) -> DataFrame:
        first = F.first(label).over(w.rowsBetween(-rows, 0))  # the group's first row wherever the lag has none
        return df.withColumn("news_level", F.greatest(F.lit(0), F.when(F.col("_i") < rows, first).otherwise(F.lag(label, rows).over(w)).cast("int")).cast("int"))

    return Series.of(df, ts, by, chunks).windowed(add, behind=rows).frame()


def valid(df: DataFrame, label: str = "label", classes: int = 4) -> DataFrame:
    return df.where(F.col(label).between(0, classes - 1))
