"""Streaming forms of the hourly aggregation and of the rolling strategy."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import session


def hourly_stream(events: DataFrame, lateness: str = "2 hours", ts: str = "ts", value: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, ts, price) of each whole hour once the watermark has passed it. Event times without a
    zone are taken as UTC."""
    src = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", lateness)
    agg = src.groupBy(*by, F.window("_t", "1 hour")).agg(F.round(F.sum(value) / F.count(value), 6).alias("price"))
    return agg.select(*by, F.col("window.start").alias("ts"), "price")


class RollingStrategy(StatefulProcessor):
    """Momentum position and Sortino ratio of one instrument, an hour at a time. The state is the
    last returns and the last strategy returns, so it is of fixed size."""

    def __init__(self, lookback: int = 6, window: int = 24):
        self.lookback, self.window = lookback, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("rolling", "n long, returns array<double>, strategy array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, past, own = self.state.get() if self.state.exists() else (0, [], [])
        past, own, out = deque(past, self.lookback), deque(own, self.window), []
        pdf = pd.concat(list(rows)).sort_values("ts", kind="stable")
        for t, x in zip(pdf["ts"], pdf["ret_pct"], strict=True):
            position = 0 if n < self.lookback else 1 if round(sum(past), 6) >= 0 else -1
            own.append(position * x)
            past.append(x)
            out.append((key[0], t, position, sortino(own, self.window) if n >= self.window else 0.0))
            n += 1
        self.state.update((n, list(past), list(own)))
        yield pd.DataFrame(out, columns=["instrument", "ts", "position", "sortino"])

    def close(self) -> None:
        pass


def sortino(returns, window: int) -> float:
    mean = sum(returns) / window
    down = (sum(r * r for r in returns if r < 0) / window) ** 0.5
    return mean / down if down else 1.0 if mean > 0 else -1.0


def strategy_stream(returns: DataFrame, lookback: int = 6, window: int = 24) -> DataFrame:
    """(instrument, ts, position, sortino) of a stream of (instrument, ts, ret_pct) in order."""
    session.ship(returns.sparkSession)
    return returns.groupBy("instrument").transformWithStateInPandas(
        RollingStrategy(lookback, window), outputStructType="instrument string, ts timestamp, position int, sortino double", outputMode="Append", timeMode="None"
    )
