"""Features of synchronised series: alignment, filling, volatility, efficiency, deltas.

Rows are ordered by time within optional partition columns (`by`). The column functions take a window;
`series.Series` gives windows over chunks, so that neither a long group nor a series without groups is
one task. `assemble` works on chunks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import Series


@dataclass(frozen=True)
class Params:
    atr_period: int = 14
    er_period: int = 10
    first: int = 25  # rows of history before the first assembled row


def ordered(by: Sequence[str] = (), ts: str = "ts"):
    return Window.partitionBy(*by).orderBy(ts)


def mid_price(bid: str = "bid_close", ask: str = "ask_close") -> Column:
    return (F.col(bid) + F.col(ask)) / 2


def at_top_of_hour(df: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    """Rows between two times, both included, whose minute is 0 (seconds are not looked at)."""
    return df.where(F.col(ts).between(F.lit(start), F.lit(end)) & (F.minute(ts) == 0))


def hourly(df: DataFrame, value: str = "value", ts: str = "ts", by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """(by, ts, price): the mean value of each hour; partial sums are made before the shuffle."""
    hour = F.date_trunc("hour", ts).cast("timestamp_ntz").alias(ts)
    return df.groupBy(*by, hour).agg(F.round(F.sum(value) / F.count(value), digits).alias("price"))


def align(df: DataFrame, symbols: Sequence[str], symbol: str = "symbol", value: str = "price", ts: str = "ts", by: Sequence[str] = ()) -> DataFrame:
    """Full outer alignment: one row per time, one column per listed symbol, null where absent."""
    return df.groupBy(*by, ts).pivot(symbol, list(symbols)).agg(F.first(value, ignorenulls=True))


def forward_fill(x: str | Column, w) -> Column:
    """The latest non-null value so far, else 0."""
    c = F.col(x) if isinstance(x, str) else x
    return F.coalesce(F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))


def delayed_fill(x: str, w, first: int = 25) -> Column:
    """forward_fill() that doesn't see rows before index `first`."""
    return forward_fill(F.when(F.row_number().over(w) > first, F.col(x)), w)


def normalized_atr(filled: str, w, period: int = 14) -> Column:
    """Mean absolute change of a filled series over some rows, relative to its current value."""
    step = F.coalesce(F.abs(F.col(filled) - F.lag(filled).over(w)), F.lit(0.0))
    return F.when(F.col(filled) == 0, 0.0).otherwise(F.sum(step).over(w.rowsBetween(-(period - 1), 0)) / period / F.col(filled))


def efficiency_ratio(raw: str, w, period: int = 10) -> Column:
    """Net change over the path of a series whose gaps are 0; 0 where there is no path."""
    path = F.sum(f"_step_{raw}").over(w.rowsBetween(-(period - 1), 0))
    net = F.abs(F.col(f"_raw_{raw}") - F.lag(f"_raw_{raw}", period).over(w))
    return F.when((path == 0) | path.isNull(), 0.0).otherwise(F.coalesce(net, F.lit(0.0)) / path)


def with_efficiency(df: DataFrame, raw: str, out: str, by: Sequence[str] = (), ts: str = "ts", period: int = 10, w=None) -> DataFrame:
    """Adds the ratio, in windows of w or of whole groups; it looks `period` rows behind."""
    w = ordered(by, ts) if w is None else w
    df = df.withColumn(f"_raw_{raw}", F.coalesce(F.col(raw), F.lit(0.0)))
    df = df.withColumn(f"_step_{raw}", F.coalesce(F.abs(F.col(f"_raw_{raw}") - F.lag(f"_raw_{raw}").over(w)), F.lit(0.0)))
    return df.withColumn(out, efficiency_ratio(raw, w, period)).drop(f"_raw_{raw}", f"_step_{raw}")


def log_return(filled: str, w) -> Column:
    """100 times the log change; 0 where the value before is 0 or missing."""
    prev = F.lag(filled).over(w)
    return F.when(prev.isNull() | (prev == 0) | (F.col(filled) == 0), 0.0).otherwise(F.log(F.col(filled) / prev) * 100)


def delta(x: str, w) -> Column:
    return F.col(x) - F.coalesce(F.lag(x).over(w), F.lit(0.0))


def spread_delta(a: str, b: str, prev_a: str, prev_b: str, w) -> Column:
    """Change of a - b against the filled values of the row before; 0 where either of those is 0."""
    pa, pb = F.coalesce(F.lag(prev_a).over(w), F.lit(0.0)), F.coalesce(F.lag(prev_b).over(w), F.lit(0.0))
    return F.when((pa == 0) | (pb == 0), 0.0).otherwise(F.col(a) - F.col(b) - (pa - pb))


@dataclass(frozen=True)
class Roles:
    """Which symbol plays which part of an assembled row."""

    main: str
    eur: str = "EUR"
    eurjpy: str = "EURJPY"
    audjpy: str = "AUDJPY"
    ief: str = "IEF"
    jgb: str = "JGB"
    wti: str = "WTI"


def assemble(wide: DataFrame | Series, roles: Roles, params: Params = Params(), ts: str = "ts", by: Sequence[str] = (), chunks: int | None = None) -> DataFrame:
    """Assembled rows: from row `first` on, where the main pair has traded. Changes refer to the
    row before on the whole timeline, whether it is emitted or not."""
    p, series = params, Series.of(wide, ts, by, chunks)
    used = sorted({roles.main, roles.eur, roles.eurjpy, roles.audjpy, roles.ief, roles.jgb})
    late = {"us_bond_level": roles.ief, "jp_bond_level": roles.jgb, "wti_oil": roles.wti}  # don't see the first rows
    series = series.filled({f"_f_{s}": F.col(s) for s in used} | {name: F.when(F.col("_i") >= p.first, F.col(s)) for name, s in late.items()}, 0.0)

    def add(df: DataFrame, w) -> DataFrame:
        atr = {"usdjpy_atr": roles.main, "eurusd_atr": roles.eur, "eurjpy_atr": roles.eurjpy, "audjpy_atr": roles.audjpy}
        df = df.withColumns({"usdjpy_price": log_return(f"_f_{roles.main}", w)} | {name: normalized_atr(f"_f_{s}", w, p.atr_period) for name, s in atr.items()})
        df = with_efficiency(df, roles.main, "usdjpy_er", period=p.er_period, w=w)
        return df.withColumns({"atr_delta": delta("usdjpy_atr", w), "er_delta": delta("usdjpy_er", w), "yield_spread_delta": spread_delta("us_bond_level", "jp_bond_level", f"_f_{roles.ief}", f"_f_{roles.jgb}", w)})

    # a change looks at the row before, whose mean looks back over a period of steps
    df = series.windowed(add, behind=max(p.atr_period, p.er_period) + 1).rows
    df = df.where((F.col("_i") >= p.first) & F.col(roles.main).isNotNull())
    return df.select(*series.by, series.ts, "usdjpy_price", "usdjpy_atr", "usdjpy_er", "us_bond_level", "jp_bond_level", "wti_oil", "atr_delta", "er_delta", "yield_spread_delta", "eurusd_atr", "audjpy_atr", "eurjpy_atr")


FEATURES = ("usdjpy_price", "usdjpy_atr", "usdjpy_er", "eurusd_atr", "audjpy_atr", "eurjpy_atr", "us_bond_level", "jp_bond_level", "wti_oil", "yield_spread_delta", "atr_delta", "er_delta")


def feature_vector(df: DataFrame, columns: Sequence[str] = FEATURES, label: str = "label") -> DataFrame:
    """(features, label): the columns in fixed order as one vector for a learner."""
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="keep").transform(df).select("features", label)
