"""Macro releases: filtering, surprise classes, and their effect on later hours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CURRENCIES = {"US": "USD", "JP": "JPY"}


def inflation_releases(df: DataFrame) -> DataFrame:
    """Releases of prices or inflation in the listed countries with both figures and a full time."""
    name = F.upper("event")
    ok = F.col("country").isin(*CURRENCIES) & (name.contains("CPI") | name.contains("INFLATION")) & F.col("actual").isNotNull() & F.col("estimate").isNotNull() & (F.length("date") >= 19)
    currency = F.coalesce(*[F.when(F.col("country") == k, F.lit(v)) for k, v in CURRENCIES.items()])
    return df.where(ok).select(
        F.to_timestamp_ntz(F.substring("date", 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")).alias("release_time"), F.col("event").alias("event_name"), currency.alias("currency"),
        F.col("actual").cast("double").alias("actual"), F.col("estimate").cast("double").alias("consensus"),
    )


def shock(actual: Column, consensus: Column, moderate: float = 0.10, large: float = 0.25) -> Column:
    """2 for a large surprise, 1 for a moderate one, else 0; compared as doubles."""
    gap = F.abs(actual - consensus)
    return F.when(gap >= large, 2).when(gap >= moderate, 1).otherwise(0).cast("int")


def affected_hours(releases: DataFrame, hours: int = 72, time: str = "release_time") -> DataFrame:
    """A row for each hour in [release, release + hours): the first whole hour at or after the
    release, and the ones that follow. Turns the interval join into an equi-join."""
    first = F.expr(f"CASE WHEN date_trunc('hour', {time}) = {time} THEN {time} ELSE date_trunc('hour', {time}) + INTERVAL 1 HOUR END").cast("timestamp_ntz")
    last = F.expr(f"date_trunc('hour', {time} + INTERVAL {hours} HOURS - INTERVAL 1 MICROSECOND)").cast("timestamp_ntz")
    return releases.withColumn("ts", F.explode(F.sequence(first, last, F.expr("INTERVAL 1 HOUR"))))


def inject_shocks(hourly: DataFrame, releases: DataFrame, hours: int = 72, moderate: float = 0.10, large: float = 0.25, currencies: Sequence[str] | None = None) -> DataFrame:
    """Adds the strongest shock whose window covers each hour, 0 if none. The hourly table keeps
    its partitioning; releases are reduced to one row per hour before they meet it. Times of the
    hourly table are whole hours. currencies: only these count (all by default)."""
    r = releases if currencies is None else releases.where(F.col("currency").isin(*currencies))
    r = r.withColumn("shock", shock(F.col("actual"), F.col("consensus"), moderate, large)).where("shock > 0")
    by_hour = affected_hours(r, hours).groupBy("ts").agg(F.max("shock").alias("shock"))
    return hourly.join(by_hour, "ts", "left").withColumn("shock", F.coalesce("shock", F.lit(0)).cast("int"))
