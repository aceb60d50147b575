"""Generated inputs: deterministic functions of a row's number, made by the executors."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import splits


def draw(key: str, n: int, *salt: int) -> Column:
    """A number from 0 to n - 1, drawn from a hash of the key."""
    return F.pmod(F.xxhash64(key, *map(F.lit, salt)), F.lit(n)).cast("int")


def thermometer(x: Column, size: int = 32) -> Column:
    """`size` bits of which the first x are set."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda b: (b < x).cast("int"))


def three_integers(spark: SparkSession, n: int = 900, seed: int = 5) -> DataFrame:
    """(key, label, split, bits): three numbers under 20; the class is by their sum: under 20, under
    40, or more."""
    ids = spark.range(n).withColumnRenamed("id", "key")
    xs = [draw("key", 20, seed, k) for k in range(3)]
    total = reduce(lambda a, b: a + b, xs)
    df = ids.select("key", F.when(total < 20, 0).when(total < 40, 1).otherwise(2).alias("label"), F.concat(*map(thermometer, xs)).alias("bits"))
    return splits.shuffled(df, "key")


def one_integer(spark: SparkSession, n: int = 600, seed: int = 6) -> DataFrame:
    """(key, label, split, bits): one number under 20, labelled by whether it exceeds 10."""
    x = draw("key", 20, seed)
    df = spark.range(n).withColumnRenamed("id", "key").select("key", (x > 10).cast("int").alias("label"), thermometer(x).alias("bits"))
    return splits.shuffled(df, "key")


def letters(spark: SparkSession, n: int = 500, length: int = 8) -> DataFrame:
    """(key, text, label): strings of A and B, labelled by whether they hold AAA; n of each class, or
    as many as there are."""
    text = F.concat(*[F.when(draw("id", 2, k) == 0, "A").otherwise("B") for k in range(length)])
    df = spark.range(4 * n).select(F.col("id").alias("key"), text.alias("text"))
    return splits.balanced_rounds(df.withColumn("label", F.col("text").contains("AAA").cast("int")), "label", "key", rounds=n).drop("round")


def hours(spark: SparkSession, first: dt.datetime, n: int) -> DataFrame:
    """(ts, price): successive hours with a price that wanders by a fixed formula."""
    ts = (F.lit(first).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).cast("timestamp_ntz")
    return spark.range(n).select(ts.alias("ts"), (100 + F.sin(F.col("id") / 7.0) + draw("id", 100) / 1000.0).alias("price"))
