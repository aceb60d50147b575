"""Economic calendar: JSON landed in files, and a client for a service if there is a network."""

from __future__ import annotations

import datetime as dt
import json
import os
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .. import session

EVENT_SCHEMA = "date string, country string, event string, currency string, actual double, estimate double, previous double, impact string"


def releases(spark: SparkSession, path: str, array: bool = True) -> DataFrame:
    """Raw calendar rows of JSON files (arrays of objects, or one object a line)."""
    return spark.read.schema(EVENT_SCHEMA).json(path, multiLine=array)


def parse(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Raw calendar rows of JSON array texts."""
    return parsed(spark.createDataFrame([(t,) for t in texts], "body string"))


def parsed(bodies: DataFrame) -> DataFrame:
    """Raw calendar rows of a table of JSON array texts (body)."""
    from pyspark.sql import functions as F

    return bodies.select(F.explode(F.from_json("body", f"array<struct<{EVENT_SCHEMA.replace(' string', ':string').replace(' double', ':double')}>>")).alias("e")).select("e.*")


def chunks(first_year: int, last_year: int, months: int = 3) -> Iterator[tuple[dt.date, dt.date]]:
    """Ranges of some months from the first day of one year to the last of another."""
    start, end = dt.date(first_year, 1, 1), dt.date(last_year, 12, 31)
    while start <= end:
        n = start.year * 12 + start.month - 1 + months
        after = dt.date(n // 12, n % 12 + 1, 1)
        yield start, min(end, after - dt.timedelta(days=1))
        start = after


def _get(url: str) -> str:
    with urllib.request.urlopen(url, timeout=30) as r:  # noqa: S310
        return r.read().decode()


def fetch(base_url: str, key: str, first_year: int, last_year: int, get: Callable[[str], str] = _get, pause: float = 0.15) -> list[str]:
    """Bodies of all ranges; a range that fails is passed over. `get` can be replaced by a reader
    of landed files, as in tests."""
    out = []
    for a, b in chunks(first_year, last_year):
        try:
            out.append(get(f"{base_url}?{urllib.parse.urlencode({'from': a, 'to': b, 'apikey': key})}"))
        except OSError:
            continue
        finally:
            time.sleep(pause)
    return out


# A source of ranges -------------------------------------------------------------------------


class _Range(InputPartition):
    def __init__(self, first: dt.date | None, last: dt.date | None):
        super().__init__(None)
        self.first, self.last = first, last


def _body(url: str, timeout: float) -> str:
    """The text at an address; of a landed folder (file:), that of all its files."""
    if url.startswith("file:"):
        path = urllib.request.url2pathname(urllib.parse.urlsplit(url).path)
        if os.path.isdir(path):
            names = sorted(x for x in os.listdir(path) if x[0] not in "._")
            return "\n".join(open(os.path.join(path, x), encoding="utf-8").read() for x in names)
    with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
        return r.read().decode()


def _objects(text: str) -> Iterator[dict]:
    """The objects of a JSON array, or of one JSON value a line."""
    text = text.strip()
    for found in [json.loads(text)] if text.startswith("[") else map(json.loads, filter(None, text.splitlines())):
        yield from (x for x in (found if isinstance(found, list) else [found]) if isinstance(x, dict))


class CalendarReader(DataSourceReader):
    """One input partition for each range of months; ranges that a filter on `date` rules out aren't asked for."""

    def __init__(self, options):
        self.url, self.key = options["url"], options.get("key", "")
        self.first, self.last = int(options["firstyear"]), int(options["lastyear"])
        self.months, self.timeout, self.tries = int(options.get("months", 3)), float(options.get("timeout", 30)), int(options.get("tries", 2))
        self.since, self.until = "", "~"  # dates as text, whose order is that of time

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) == ("date",) and isinstance(getattr(f, "value", None), str):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.since = max(self.since, f.value)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.until = min(self.until, f.value)
            yield f  # Spark still applies it to the rows

    def partitions(self):
        kept = [_Range(a, b) for a, b in chunks(self.first, self.last, self.months) if f"{b}~" >= self.since and f"{a}" <= self.until]
        return kept or [_Range(None, None)]

    def read(self, partition):
        a, b = partition.first, partition.last
        if a is None:  # no range is asked for
            return
        url = self.url.replace("{from}", str(a)).replace("{to}", str(b)).replace("{key}", urllib.parse.quote(self.key))
        for left in range(self.tries, 0, -1):
            try:
                rows = list(_objects(_body(url, self.timeout)))
                break
            except (OSError, ValueError) as e:
                if left == 1:
                    yield (*[None] * 8, str(a), f"{type(e).__name__}: {e}"[:200])
                    return
        number = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None
        text = lambda x: None if x is None else str(x)
        for x in rows:
            yield (*[text(x.get(c)) for c in ("date", "country", "event", "currency")], *[number(x.get(c)) for c in ("actual", "estimate", "previous")], text(x.get("impact")), str(a), None)


class CalendarSource(DataSource):
    """`calendar`: rows of a service that answers for ranges of dates. Options: url with {from}, {to} and {key}
    in it, key, firstYear, lastYear, months (3), timeout, tries. Besides the event's columns a row has
    `chunk`, the first day of its range, and `error`: a range that can't be had is one row that says why."""

    @classmethod
    def name(cls):
        return "calendar"

    def schema(self):
        return f"{EVENT_SCHEMA}, chunk string, error string"

    def reader(self, schema):
        return CalendarReader({k.lower(): v for k, v in self.options.items()})


def ranges(spark: SparkSession, url: str, first_year: int, last_year: int, key: str = "", **options) -> DataFrame:
    """What CalendarSource reads; a task for each range, and nothing through the driver."""
    session.ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the planner asks for it when the query runs
    spark.dataSource.register(CalendarSource)
    return spark.read.format("calendar").options(url=url, firstYear=first_year, lastYear=last_year, key=key, **options).load()


def received(df: DataFrame) -> DataFrame:
    """The rows of ranges that were had."""
    return df.where("error IS NULL").drop("chunk", "error")


def failures(df: DataFrame) -> DataFrame:
    """(chunk, error) of the ranges that weren't."""
    return df.where("error IS NOT NULL").select("chunk", "error")
