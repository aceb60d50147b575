"""Rolling momentum strategy and its Sortino ratio."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .series import Series


def momentum_sortino(df: DataFrame | Series, ret: str = "ret_pct", lookback: int = 6, window: int = 24, by: Sequence[str] = (), ts: str = "ts", digits: int = 6, chunks: int | None = None) -> DataFrame:
    """Adds position, strategy_return and sortino. The position is the sign of the previous
    returns' sum (long at zero); rows without enough history return 0 and count as 0. Sums are
    rounded before their sign is taken, so that engines that add in another order agree."""

    def add(rows: DataFrame, w) -> DataFrame:
        past = F.round(F.coalesce(F.sum(ret).over(w.rowsBetween(-lookback, -1)), F.lit(0.0)), digits)
        rows = rows.withColumn("position", F.when(F.col("_i") < lookback, 0).when(past >= 0, 1).otherwise(-1))
        rows = rows.withColumn("strategy_return", F.col("position") * F.col(ret))
        near = w.rowsBetween(-(window - 1), 0)
        r = F.col("strategy_return")
        mean = F.sum("strategy_return").over(near) / window
        down = F.sqrt(F.sum(F.when(r < 0, r * r).otherwise(0.0)).over(near) / window)
        ratio = F.when(down == 0, F.when(mean > 0, 1.0).otherwise(-1.0)).otherwise(mean / down)
        return rows.withColumn("sortino", F.when(F.col("_i") < window, 0.0).otherwise(ratio))

    return Series.of(df, ts, by, chunks).windowed(add, behind=lookback + window).frame()
