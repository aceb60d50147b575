"""Hidden Markov baseline: tokens, supervised counts, a Viterbi decoder and a search of thresholds.

Log probabilities are whole numbers of 2^-32, so that a sum doesn't depend on the order in which blocks
are put together, and ties are ties: to the lowest state, as in one pass over the whole sequence. A long
sequence is decoded in blocks: each gives the best scores from every state before it to every state at
its end, a product in which sums are products and maxima are sums; a scan over the products gives the
scores at each border; from these each block gives the state before it for every state at its end, and a
scan from the last block back gives the states at the borders, between which blocks are traced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import session
from .series import Series


def token(atr: Column, er_delta: Column, mean_atr: Column, low: float = 0.7, high: float = 1.3, er: float = 0.05, shock: Column | int = 1) -> Column:
    """9 a + 3 e + s: volatility against its mean, change of efficiency, and the shock class."""
    a = F.when(atr < mean_atr * low, 0).when(atr > mean_atr * high, 2).otherwise(1)
    e = F.when(er_delta < -er, 0).when(er_delta > er, 2).otherwise(1)
    return (a * 9 + e * 3 + (F.lit(shock) if isinstance(shock, int) else shock)).cast("int")


def with_tokens(df: DataFrame, atr: str, er_delta: str, fit_on: Column | None = None, digits: int = 9, **limits) -> DataFrame:
    """Adds token; the mean volatility is one number, from the rows of `fit_on` if given."""
    src = df if fit_on is None else df.where(fit_on)
    mean = src.agg(F.round(F.avg(atr), digits).alias("_mean"))  # one row
    return df.join(F.broadcast(mean)).withColumn("token", token(F.col(atr), F.col(er_delta), F.col("_mean"), **limits)).drop("_mean")


def transitions(df: DataFrame | Series, state: str = "label", ts: str = "ts", by: Sequence[str] = (), states: int = 4, chunks: int | None = None) -> DataFrame:
    """(from_state, to_state, n) of successive rows whose states are both known."""
    series = Series.of(df, ts, by, chunks).windowed(lambda rows, w: rows.withColumn("from_state", F.lag(state).over(w)), behind=1)
    pairs = series.select("from_state", F.col(state).alias("to_state"))
    known = F.col("from_state").between(0, states - 1) & F.col("to_state").between(0, states - 1)
    return pairs.where(known).groupBy("from_state", "to_state").agg(F.count("*").alias("n"))


def emissions(df: DataFrame, state: str = "label", symbol: str = "token", states: int = 4) -> DataFrame:
    return df.where(F.col(state).between(0, states - 1)).groupBy(F.col(state).alias("state"), F.col(symbol).alias("token")).agg(F.count("*").alias("n"))


Model = tuple[np.ndarray, np.ndarray, np.ndarray]


def fit(df: DataFrame | Series, state: str = "label", symbol: str = "token", ts: str = "ts", by: Sequence[str] = (), states: int = 4, symbols: int = 27, smooth: float = 1.0):
    """(start, transition, emission) probabilities from smoothed counts; the driver gets
    states * (states + symbols) numbers."""
    a, b = np.zeros((states, states)), np.zeros((states, symbols))
    for r in transitions(df, state, ts, by, states).collect():
        a[r.from_state, r.to_state] = r.n
    for r in emissions(df.frame() if isinstance(df, Series) else df, state, symbol, states).collect():
        b[r.state, r.token] = r.n
    return from_counts(a, b, smooth)


def from_counts(a: np.ndarray, b: np.ndarray, smooth: float = 1.0) -> Model:
    """A model from counts of transitions and of emissions."""
    a, b = a + smooth, b + smooth
    return b.sum(1) / b.sum(), a / a.sum(1, keepdims=True), b / b.sum(1, keepdims=True)


#: Below any sum of log probabilities that can be reached; what can't happen.
_NEVER = np.int64(-(1 << 61))


def whole_logs(p: np.ndarray) -> np.ndarray:
    """Log probabilities in whole numbers of 2^-32."""
    with np.errstate(divide="ignore"):
        x = np.log(np.asarray(p, float)) * 4294967296.0
    return np.where(np.isfinite(x), np.round(x), float(_NEVER)).astype(np.int64)


def _logs(model: Model) -> Model:
    return tuple(map(whole_logs, model))


def _forward(tokens: np.ndarray, v: np.ndarray, lt: np.ndarray, le: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores after some tokens, from scores before them, and for each token and state the best state before."""
    back = np.zeros((len(tokens), len(v)), np.int64)
    for t, x in enumerate(tokens):
        scores = v[:, None] + lt
        back[t] = scores.argmax(0)
        v = scores.max(0) + le[:, x]
        v = np.maximum(v - v.max(), _NEVER)  # only differences matter
    return v, back


def _trace(back: np.ndarray, state: int) -> np.ndarray:
    """The states at the places of a block that ends in a state, after the state before the block."""
    path = np.empty(len(back) + 1, np.int64)
    path[-1] = state
    for t in range(len(back), 0, -1):
        path[t - 1] = back[t - 1, path[t]]
    return path


def _first(token: int, ls: np.ndarray, le: np.ndarray) -> np.ndarray:
    v = ls + le[:, token]
    return np.maximum(v - v.max(), _NEVER)


def viterbi(tokens: np.ndarray, start: np.ndarray, trans: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """The most likely states of a sequence of tokens; ties to the lowest state."""
    if not len(tokens):
        return np.zeros(0, np.int64)
    ls, lt, le = _logs((start, trans, emit))
    v, back = _forward(tokens[1:], _first(tokens[0], ls, le), lt, le)
    return _trace(back, int(v.argmax()))


def _product(tokens: np.ndarray, lt: np.ndarray, le: np.ndarray) -> np.ndarray:
    """The best score from each state before a block to each state at its end, less the largest."""
    m = np.full(lt.shape, _NEVER)
    np.fill_diagonal(m, 0)
    for x in tokens:
        m = (m[:, :, None] + lt[None]).max(1) + le[None, :, x]
        m = np.maximum(m - m.max(), _NEVER)
    return m


def decode(df: DataFrame | Series, model: Model | Mapping[int, Model], symbol: str = "token", ts: str = "ts", by: Sequence[str] = (), chunks: int | None = None, config: str | None = None) -> DataFrame:
    """Adds state: one sequence for each group, decoded in the chunks of its series. With `config`, one of
    the columns of `by`, `model` is a model for each of its values."""
    series = Series.of(df, ts, by, chunks)
    by = series.by
    spark = series.rows.sparkSession
    session.ship(spark)
    models = {None: _logs(model)} if config is None else {k: _logs(m) for k, m in model.items()}
    key = F.to_json(F.struct(*by)) if by else F.lit("")
    which = F.col(config).cast("long") if config else F.lit(None).cast("long")
    rows = series.chunked().select(key.alias("_key"), "_chunk", "_i", which.alias("_config"), F.col(symbol).cast("int").alias("_token"), "_n")
    many = rows.where(F.col("_n") > series.size)
    logs = lambda pdf: models[None if config is None else int(pdf["_config"].iloc[0])]

    def ordered(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        pdf = pdf.sort_values("_i", kind="stable")
        return pdf, pdf["_token"].to_numpy()

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, x = ordered(pdf)
        ls, lt, le = logs(pdf)
        at = int(pdf["_chunk"].iloc[0])
        m = _product(x, lt, le) if at else _forward(x[1:], _first(x[0], ls, le), lt, le)[0]
        return pd.DataFrame({"_key": [pdf["_key"].iloc[0]], "_chunk": [at], "m": [m.ravel().tolist()]})

    borders: dict[tuple[str, int], np.ndarray] = {}  # scores before a block
    if series.total > series.size:  # some group has more than one chunk; blocks of such groups are at most twice the chunks
        found = many.groupBy("_key", "_chunk").applyInPandas(products, "_key string, _chunk long, m array<bigint>").collect()
        v = None
        for r in sorted(found, key=lambda r: (r["_key"], r["_chunk"])):
            m = np.array(r["m"], np.int64)
            if r["_chunk"]:
                borders[r["_key"], r["_chunk"]] = v
                v = (v[:, None] + m.reshape(len(v), -1)).max(0)
            else:
                v = m
            v = np.maximum(v - v.max(), _NEVER)

    def before(pdf: pd.DataFrame) -> pd.DataFrame:
        """For each state at a block's end, the state before the block; and the best state at its end."""
        pdf, x = ordered(pdf)
        ls, lt, le = logs(pdf)
        key, at = pdf["_key"].iloc[0], int(pdf["_chunk"].iloc[0])
        v, back = _forward(x, borders[key, at], lt, le) if at else _forward(x[1:], _first(x[0], ls, le), lt, le)
        come = [int(_trace(back, k)[0]) for k in range(len(v))] if at else []
        return pd.DataFrame({"_key": [key], "_chunk": [at], "come": [come], "best": [int(v.argmax())]})

    ends: dict[tuple[str, int], int] = {}  # states at the ends of blocks
    if borders:
        found = many.groupBy("_key", "_chunk").applyInPandas(before, "_key string, _chunk long, come array<bigint>, best long").collect()
        last: tuple[str, int] | None = None
        for r in sorted(found, key=lambda r: (r["_key"], -r["_chunk"])):
            state = last[1] if last is not None and last[0] == r["_key"] else r["best"]
            ends[r["_key"], r["_chunk"]] = state
            last = (r["_key"], r["come"][state]) if r["_chunk"] else None

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, x = ordered(pdf)
        ls, lt, le = logs(pdf)
        key, at = pdf["_key"].iloc[0], int(pdf["_chunk"].iloc[0])
        if at:
            path = _trace(_forward(x, borders[key, at], lt, le)[1], ends[key, at])[1:]
        else:
            v, back = _forward(x[1:], _first(x[0], ls, le), lt, le)
            path = _trace(back, ends.get((key, at), int(v.argmax())))
        return pd.DataFrame({"_key": pdf["_key"], "_i": pdf["_i"], "state": path.astype("int32")})

    paths = rows.groupBy("_key", "_chunk").applyInPandas(trace, "_key string, _i long, state int")
    out = series.rows.withColumn("_key", key).join(paths, ["_key", "_i"])
    return out.select(*by, series.ts, symbol, "state")


# Search of thresholds -----------------------------------------------------------------------

#: Low and high limits of volatility and the limit of a change of efficiency.
SWEEP = tuple((low, high, er) for low in (0.6, 0.7, 0.8) for high in (1.2, 1.3, 1.4) for er in (0.03, 0.05, 0.07))


def quantised(df: DataFrame, mean_atr: float, atr: str = "atr", er_delta: str = "er_delta", configs: Sequence[tuple[float, float, float]] = SWEEP) -> DataFrame:
    """A row for each row and configuration, with config and token."""
    each = [F.struct(F.lit(k).alias("config"), token(F.col(atr), F.col(er_delta), F.lit(mean_atr), low, high, er).alias("token")) for k, (low, high, er) in enumerate(configs)]
    return df.select("*", F.inline(F.array(*each)))


def sweep_counts(train: DataFrame, mean_atr: float, state: str = "label", configs: Sequence[tuple[float, float, float]] = SWEEP, **columns) -> DataFrame:
    """(config, state, token, n): emissions under every configuration, in one pass."""
    q = quantised(train, mean_atr, configs=configs, **columns)
    return q.where(F.col(state) >= 0).groupBy("config", F.col(state).alias("state"), "token").agg(F.count("*").alias("n"))


def sweep(df: DataFrame, split: str = "split", state: str = "label", ts: str = "ts", digits: int = 6, configs: Sequence[tuple[float, float, float]] = SWEEP, states: int = 4, symbols: int = 27, chunks: int | None = None) -> DataFrame:
    """(config, low, high, er, n_test, accuracy) of every configuration: rows (ts, atr, er_delta, label,
    split) of `train` give counts and the mean volatility, those of `test` are decoded as one sequence for
    each configuration, in blocks. Test rows without a label are decoded and not counted. The driver gets
    the counts, of fixed size for each configuration."""
    spark = df.sparkSession
    train, test = df.where(F.col(split) == "train"), df.where(F.col(split) == "test")
    mean = train.agg(F.round(F.avg("atr"), digits).alias("m")).first().m
    if mean is None:
        return spark.createDataFrame([], "config int, low double, high double, er double, n_test long, accuracy double")
    a = np.zeros((states, states))
    for r in transitions(train, state, ts, (), states, chunks).collect():
        a[r.from_state, r.to_state] = r.n
    b = np.zeros((len(configs), states, symbols))
    for r in sweep_counts(train, mean, state, configs).where(F.col("state") < states).collect():
        b[r.config, r.state, r.token] = r.n
    models = {k: from_counts(a, b[k]) for k in range(len(configs))}
    q = quantised(test.select(ts, "atr", "er_delta"), mean, configs=configs).select("config", ts, "token")
    decoded = decode(q, models, ts=ts, by=["config"], chunks=chunks, config="config").select("config", ts, "state")
    known = decoded.join(test.where(F.col(state).between(0, states - 1)).select(ts, F.col(state).alias("_actual")), ts)
    scores = known.groupBy("config").agg(F.count("*").alias("n_test"), F.avg((F.col("state") == F.col("_actual")).cast("double")).alias("accuracy"))
    table = spark.createDataFrame([(k, *map(float, c)) for k, c in enumerate(configs)], "config int, low double, high double, er double")
    return table.join(scores, "config", "left").select("config", "low", "high", "er", F.coalesce("n_test", F.lit(0)).alias("n_test"), "accuracy")
