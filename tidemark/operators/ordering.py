"""Places in a total order, over many tasks.

`numbered` deals rows by ranges of the order, sorts each range and numbers the rows of a range by
where they stand in it; the sizes of the ranges, one row each, give what to add. No window looks at
all rows, and one group (or no group at all) may hold any share of them. Ranges are drawn from a
sample, so the sorted table is kept before it is counted: a second look finds the same ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import session

_ROW_BITS = 33  # of monotonically_increasing_id(): the row within its partition


def _columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranged(df: DataFrame, order: Sequence[str | Column], ranges: int | None = None) -> DataFrame:
    """df kept in sorted ranges, with `_p`, the range, and `_r`, the row within it from 0."""
    cols = _columns(order)
    at = F.monotonically_increasing_id()
    df = df.repartitionByRange(ranges or partitions(df), *cols).sortWithinPartitions(*cols).withColumn("_at", at)
    df = session.kept(df, "ordered")
    return df.withColumns({"_p": F.shiftrightunsigned("_at", _ROW_BITS), "_r": F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))}).drop("_at")


def numbered(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), place: str = "_i", size: str = "_n", ranges: int | None = None) -> DataFrame:
    """Adds each row's place (from 0) in the order, and how many rows there are; within groups of equal
    `by` where that is given. Rows that tie throughout stand in any order, which stays as it is."""
    return placed(df, order, by, place, size, ranges)[0]


def placed(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), place: str = "_i", size: str = "_n", ranges: int | None = None) -> tuple[DataFrame, int]:
    """numbered() and the number of all rows."""
    table = ranged(df, [*by, *_columns(order)], ranges)
    runs = table.groupBy("_p", *by).agg(F.min("_r").alias("lo"), F.max("_r").alias("hi"))
    edge = F.struct("lo", "hi", *by)
    found = sorted(runs.groupBy("_p").agg(F.min(edge).alias("first"), F.max(edge).alias("last")).collect(), key=lambda r: r["_p"])  # a row a range
    start, borders, total = {}, [], 0
    for r in found:
        start[r["_p"]] = total
        total += r["last"]["hi"] + 1
    group = lambda e: tuple(e)[2:]
    # where the group that a range starts with began, and where the one that it ends with ends
    began: list[int] = []
    for k, r in enumerate(found):
        before = found[k - 1] if k else None
        same = before is not None and group(before["last"]) == group(r["first"])
        whole = before is not None and group(before["first"]) == group(before["last"])
        began.append((began[k - 1] if whole else start[before["_p"]] + before["last"]["lo"]) if same else start[r["_p"]])
    ended: list[int] = [0] * len(found)
    for k in range(len(found) - 1, -1, -1):
        r, after = found[k], found[k + 1] if k + 1 < len(found) else None
        same = after is not None and group(after["first"]) == group(r["last"])
        whole = after is not None and group(after["first"]) == group(after["last"])
        ended[k] = (ended[k + 1] if whole else start[after["_p"]] + after["first"]["hi"]) if same else start[r["_p"]] + r["last"]["hi"]
    for k, r in enumerate(found):
        borders.append((r["_p"], start[r["_p"]], r["first"]["hi"], r["last"]["lo"], began[k], ended[k]))
    border = F.broadcast(session.rows(df.sparkSession, borders, "_p bigint,_start bigint,_fh bigint,_ll bigint,_began bigint,_ended bigint"))  # a row a range
    table = table.join(border, "_p")
    if by:
        w = Window.partitionBy("_p", *by)  # at most one range's rows
        table = table.withColumns({"_lo": F.min("_r").over(w), "_hi": F.max("_r").over(w)})
        lo = F.when(F.col("_lo") == 0, F.col("_began")).otherwise(F.col("_start") + F.col("_lo"))
        hi = F.when(F.col("_lo") == F.col("_ll"), F.col("_ended")).otherwise(F.col("_start") + F.col("_hi"))
    else:
        lo, hi = F.lit(0), F.lit(total - 1)
    table = table.withColumns({place: F.col("_start") + F.col("_r") - lo, size: (hi - lo + 1).cast("long")})
    return table.drop("_p", "_r", "_start", "_fh", "_ll", "_began", "_ended", "_lo", "_hi"), total
