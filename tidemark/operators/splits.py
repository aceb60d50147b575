"""Splits, class balance and sampling, all deterministic."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordering
from .series import Series


@dataclass(frozen=True)
class Params:
    warm_up: int = 500
    purge: int = 72
    embargo: int = 24
    train: float = 0.6
    validation: float = 0.8


def indexed(df: DataFrame | Series, ts: str = "ts", by: Sequence[str] = ()) -> DataFrame:
    """Adds `_i`, a row's place in its group, and `_n`, the group's rows; a series has them already."""
    return df.rows if isinstance(df, Series) else ordering.numbered(df, [ts], by)


def chronological(df: DataFrame | Series, label: str = "label", params: Params = Params(), ts: str = "ts", by: Sequence[str] = ()) -> DataFrame:
    """Adds split: train, validation, test or null. What looks ahead across a border is purged, the
    rows after it are embargoed, and the test part ends at the last labelled row."""
    p, by, df = params, df.by if isinstance(df, Series) else tuple(by), indexed(df, ts, by)
    i, n = F.col("_i"), F.col("_n")
    last = df.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(F.max(F.when(F.col(label) != -1, i)).alias("_last"))
    if by:
        same = [df[c].eqNullSafe(last[f"_by_{c}"]) for c in by]
        df = df.join(last, same, "left").drop(*[f"_by_{c}" for c in by])
    else:
        df = df.join(F.broadcast(last))  # one row
    end_train, end_val = F.floor(n * p.train), F.floor(n * p.validation)
    split = (
        F.when((i >= p.warm_up) & (i < end_train - p.purge), "train")
        .when((i >= end_train + p.embargo) & (i < end_val - p.purge), "validation")
        .when((i >= end_val + p.embargo) & (i <= F.col("_last")), "test")
    )
    return df.withColumn("split", split).drop("_i", "_n", "_last")


def sequential(df: DataFrame | Series, ratio: float = 0.8, ts: str = "ts", by: Sequence[str] = ()) -> DataFrame:
    df = indexed(df, ts, by)
    return df.withColumn("split", F.when(F.col("_i") < F.floor(F.col("_n") * ratio), "train").otherwise("test")).drop("_i", "_n")


def hash_percent(key: Column) -> Column:
    """A number from 0 to 99 that any engine can compute from an integer key."""
    return F.pmod(key * 7919 + 13, F.lit(100))


def hash_place(key: Column, seed: int = 42) -> Column:
    """A whole number below a prime of about a million that any engine can compute from an integer
    key; it orders keys without a pattern that splits care about."""
    prime = F.lit(1_000_003)
    return F.pmod(F.pmod(key, prime) * (7919 * 7919 + 2 * 104_729 * seed) + 13, prime)


def shuffled(df: DataFrame, key: str, ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """A split by a seeded hash of an integer key: repeatable, and without a shuffle."""
    return df.withColumn("split", F.when(hash_place(F.col(key), seed) < F.lit(ratio * 1_000_003), "train").otherwise("test"))


def downsample(df: DataFrame, key: str, label: str, keep_percent: Mapping[int, int]) -> DataFrame:
    """Keeps the given share (in percent) of each class; classes not listed are kept."""
    limit = F.lit(100)
    for k, v in keep_percent.items():
        limit = F.when(F.col(label) == k, F.lit(v)).otherwise(limit)
    return df.where(hash_percent(F.col(key)) < limit)


def update_probability(df: DataFrame, label: str = "label", classes: int = 4) -> DataFrame:
    """(class_id, n, probability): the rarest non-empty class's count over each class's; infinite
    for an empty class."""
    # one row with one count for each class, which needs no distinct and no second pass
    row = df.agg(*[F.sum(F.when(F.col(label) == k, 1).otherwise(0)).alias(f"c{k}") for k in range(classes)])
    row = row.select(F.posexplode(F.array(*[F.coalesce(F.col(f"c{k}"), F.lit(0)).cast("long") for k in range(classes)])).alias("class_id", "n"), *[F.col(f"c{k}") for k in range(classes)])
    rarest = F.least(*[F.when(F.col(f"c{k}") > 0, F.col(f"c{k}")) for k in range(classes)])
    return row.select("class_id", "n", F.when(F.col("n") == 0, F.lit(float("inf"))).otherwise(rarest / F.col("n")).alias("probability"))


def balanced_rounds(df: DataFrame, label: str, key: str, seed: int = 42, rounds: int | None = None) -> DataFrame:
    """Adds round: in each, every class has one example, in hashed order. Stops with the rarest
    class unless `rounds` is given. A class of any size is dealt over many tasks."""
    df = ordering.numbered(df, [hash_place(F.col(key), seed), F.col(key)], [label], place="round")
    if rounds is None:
        rounds = df.agg(F.min("_n").alias("n")).first().n or 0
    return df.where(F.col("round") < rounds).withColumn("round", F.col("round").cast("int")).drop("_n")
