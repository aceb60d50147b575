"""Ordered series over many tasks: rows by place, cut into chunks that overlap as far as a window looks.

A chunk is a run of places within one group of `by`; a group of any length, or a series without groups,
is as many tasks as it has chunks. A window that looks some rows back or ahead is evaluated in chunks that
hold so many rows of their neighbours (the halo), which are dropped after. What looks back without an
end (the latest known value) is a scan within chunks and a carry over their borders, a row a chunk.
Results don't depend on where chunks begin: a window of rows sees the same rows in the same order.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from . import ordering

#: Rows that a chunk has at least where the number of chunks isn't given.
LEAST = 4096


class Series:
    """Rows with `_i`, the place within the group, and `_n`, the group's rows."""

    def __init__(self, rows: DataFrame, by: Sequence[str], ts: str, size: int, total: int):
        self.rows, self.by, self.ts, self.size, self.total = rows, tuple(by), ts, size, total

    @classmethod
    def of(cls, df: DataFrame | Series, ts: str = "ts", by: Sequence[str] = (), chunks: int | None = None, ties: Sequence[str | Column] = ()) -> Series:
        """The series of a table, ordered by ts (and what orders ties) within groups; a series is given back
        as it is. `chunks` is how many a table is cut into about; by default as many as there are shuffle
        partitions."""
        if isinstance(df, Series):
            return df
        rows, total = ordering.placed(df, [ts, *ties], by, "_i", "_n")
        size = -(-total // (chunks or ordering.partitions(df)))
        return cls(rows, by, ts, max(1 if chunks else LEAST, size), total)

    def _with(self, rows: DataFrame) -> Series:
        return Series(rows, self.by, self.ts, self.size, self.total)

    def _own(self) -> Column:
        return F.floor(F.col("_i") / self.size)

    def chunked(self) -> DataFrame:
        """The rows with `_chunk`, the chunk of their group that they are in."""
        return self.rows.withColumn("_chunk", self._own())

    def frame(self) -> DataFrame:
        return self.rows.drop("_i", "_n")

    def select(self, *columns: str | Column) -> DataFrame:
        return self.rows.select(*columns)

    def windowed(self, add: Callable[[DataFrame, WindowSpec], DataFrame], behind: int = 0, ahead: int = 0) -> Series:
        """add(rows, w), where w is the order within a chunk; no expression may depend on more than so many
        rows behind and ahead, counted through all windows that build on each other. The start of a group
        is seen as such by each row that is less than `behind` away from it."""
        w = Window.partitionBy(*self.by, "_chunk").orderBy("_i")
        if self.size < self.total and (behind or ahead):
            lo = F.greatest(F.lit(0).cast("long"), F.floor((F.col("_i") - ahead) / self.size))
            hi = F.least(F.floor((F.col("_n") - 1) / self.size), F.floor((F.col("_i") + behind) / self.size))
            rows = self.rows.withColumn("_chunk", F.explode(F.sequence(lo, hi)))
        else:
            rows = self.rows.withColumn("_chunk", self._own())
        return self._with(add(rows, w).where(F.col("_chunk") == self._own()).drop("_chunk"))

    def filled(self, columns: Mapping[str, Column], default: float | None = None) -> Series:
        """Adds columns: the latest non-null value of each expression so far, else the default."""
        rows = self.chunked()
        w = Window.partitionBy(*self.by, "_chunk").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumns({name: F.last(x, ignorenulls=True).over(w) for name, x in columns.items()})
        carried = self._carries(columns) if self.size < self.total else None
        if carried is not None:
            same = [rows[c].eqNullSafe(carried[f"_by_{c}"]) for c in self.by]
            rows = rows.join(F.broadcast(carried), [*same, rows["_chunk"] == carried["_to"]] if same else rows["_chunk"] == carried["_to"], "left")
            rows = rows.withColumns({name: F.coalesce(F.col(name), F.col(f"_carry_{k}")) for k, name in enumerate(columns)})
            rows = rows.drop("_to", *[f"_by_{c}" for c in self.by], *[f"_carry_{k}" for k in range(len(columns))])
        if default is not None:
            rows = rows.withColumns({name: F.coalesce(F.col(name), F.lit(default)) for name in columns})
        return self._with(rows.drop("_chunk"))

    def _carries(self, columns: Mapping[str, Column]) -> DataFrame | None:
        """What each chunk starts with; a row for each chunk of the groups that have several."""
        last = [F.max_by(x, F.when(x.isNotNull(), F.col("_i"))).alias(f"_carry_{k}") for k, x in enumerate(columns.values())]
        keys = [F.col(c).alias(f"_by_{c}") for c in self.by]
        ends = self.rows.where(F.col("_n") > self.size).groupBy(*keys, self._own().alias("_to")).agg(*last)
        n, width = len(self.by), len(columns)
        groups: dict[tuple, list] = {}
        for r in ends.collect():
            groups.setdefault(tuple(r)[:n], []).append(tuple(r)[n:])
        out = []
        for key, found in groups.items():
            now: tuple = (None,) * width
            for at, *values in sorted(found, key=lambda x: x[0]):
                out.append((*key, at, *now))
                now = tuple(b if b is not None else a for a, b in zip(now, values))
        return self.rows.sparkSession.createDataFrame(out, ends.schema) if out else None
