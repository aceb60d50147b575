"""Streaming forms give what the batch forms give."""

from __future__ import annotations

import numpy as np
import pytest

from tidemark.operators import features
from tidemark.streaming import RollingStrategy, hourly_stream, sortino, strategy_stream


def test_hourly_stream(spark, sf_dir, tmp_path):
    src = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "value")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = hourly_stream(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("hours").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.ts.replace(tzinfo=None): r.price for r in spark.sql("SELECT CAST(ts AS TIMESTAMP_NTZ) AS ts, price FROM hours").collect()}
    want = {r.ts: r.price for r in features.hourly(src).collect()}
    assert len(got) >= len(want) - 4
    assert all(want[t] == pytest.approx(p) for t, p in got.items())


def test_rolling_state_is_bounded():
    """The state machine, fed in pieces, against the definition."""
    import pandas as pd

    class State:
        def __init__(self):
            self.v = None

        def exists(self):
            return self.v is not None

        def get(self):
            return self.v

        def update(self, v):
            self.v = v

    p = RollingStrategy(3, 5)
    p.state = State()
    ret = np.random.default_rng(0).normal(0, 1, 30).tolist()
    pdf = pd.DataFrame({"ts": pd.date_range("2020-01-01", periods=30, freq="h"), "ret_pct": ret})
    out = pd.concat([x for a in range(0, 30, 7) for x in p.handleInputRows(("i",), iter([pdf.iloc[a : a + 7]]), None)])
    own = [0 if k < 3 else (1 if round(sum(ret[k - 3 : k]), 6) >= 0 else -1) * ret[k] for k in range(30)]
    assert out["sortino"].tolist() == pytest.approx([0.0 if k < 5 else sortino(own[k - 4 : k + 1], 5) for k in range(30)])
    assert len(p.state.v[1]) == 3 and len(p.state.v[2]) == 5


def test_strategy_stream(spark, tmp_path):
    """The stream, over several files, against the state machine fed with the same rows in order."""
    import pandas as pd

    rng = np.random.default_rng(1)
    rows = [(i, t.to_pydatetime(), float(x)) for i in ("A", "B") for t, x in zip(pd.date_range("2024-01-01", periods=40, freq="h"), rng.normal(0, 1, 40))]
    schema = "instrument string, ts timestamp, ret_pct double"
    for k in range(4):
        part = [r for r in rows if 10 * k <= (r[1] - rows[0][1]).total_seconds() / 3600 < 10 * k + 10]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = strategy_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 3, 5)
        q = out.writeStream.format("memory").queryName("strategy").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
        q.processAllAvailable()
        q.stop()
        got = {(r.instrument, r.ts): (r.position, r.sortino) for r in spark.sql("SELECT * FROM strategy").collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert len(got) == 80
    for i in ("A", "B"):
        ret = [r[2] for r in rows if r[0] == i]
        pos = [0 if k < 3 else 1 if round(sum(ret[k - 3 : k]), 6) >= 0 else -1 for k in range(40)]
        own = [p * x for p, x in zip(pos, ret)]
        mine = [v for _, v in sorted((k[1], v) for k, v in got.items() if k[0] == i)]
        assert [m[0] for m in mine] == pos
        assert [m[1] for m in mine] == pytest.approx([0.0 if k < 5 else sortino(own[k - 4 : k + 1], 5) for k in range(40)])
