"""What the query modules share: tables, a registry, rounding."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session

DIGITS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share."""
    return session.made(f"{session.shared_dir(spark)}/files-{uuid.uuid4().hex}")


def rounded(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rounds doubles, and turns a negative zero into zero, so that engines agree."""
    return df.withColumns({c: F.round(c, DIGITS) + F.lit(0.0) for c in columns})


def r(x: Column) -> Column:
    return F.round(x, DIGITS) + F.lit(0.0)


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        """Registers a query under its function's name."""

        def put(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql.strip()
            return f

        return put
