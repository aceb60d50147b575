"""Sorting of arrays that belong together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def co_sort(keys: Column, values: Column) -> Column:
    """Struct of the keys in order and the values carried along; equal keys keep their order."""
    rows = F.transform(keys, lambda x, k: F.struct(x.alias("key"), k.alias("at"), F.get(values, k).alias("value")))
    ordered = F.array_sort(rows)
    return F.struct(F.transform(ordered, lambda x: x["key"]).alias("keys"), F.transform(ordered, lambda x: x["value"]).alias("values"))


def by_count(df: DataFrame, column: str) -> DataFrame:
    """(value, n) from the most frequent down; ties by value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
