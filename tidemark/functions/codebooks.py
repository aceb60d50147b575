"""Codebooks: seeded tables of random bit vectors for levels, roles and categories.

They are small, made on the driver and meant to be stored: the same seed always gives the
same table, whatever else has been made before.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .hv import PRODUCTION, Shape


def _words(bits: np.ndarray, shape: Shape) -> list[int]:
    w = np.packbits(bits.reshape(shape.words, shape.bits), axis=1, bitorder="little")
    out = np.zeros((shape.words, 8), np.uint8)
    out[:, : w.shape[1]] = w
    return out.view(np.int64).ravel().tolist()


def random_bits(rng: np.random.Generator, shape: Shape, segments: range | None = None, count: int | None = None) -> np.ndarray:
    """A vector with `count` random bits, within the given words if any."""
    segments = segments if segments is not None else range(shape.words)
    room = np.concatenate([np.arange(s * shape.bits, (s + 1) * shape.bits) for s in segments])
    bits = np.zeros(shape.size, bool)
    bits[rng.choice(room, min(count or shape.top, len(room)), replace=False)] = True
    return bits


def half_bits(rng: np.random.Generator, shape: Shape, top: bool) -> np.ndarray:
    """Random bits in the upper or the lower half of the words."""
    mid = shape.words // 2
    return random_bits(rng, shape, range(mid, shape.words) if top else range(mid))


def linear_levels(n: int, seed: int = 34, shape: Shape = PRODUCTION, fresh: float = 0.07) -> np.ndarray:
    """Each level is the one before with 1/n of its bits moved and a share of new bits."""
    rng = np.random.default_rng(seed)
    out = [random_bits(rng, shape)]
    for _ in range(1, n):
        b = out[-1].copy()
        on = np.flatnonzero(b)
        move = max(1, len(on) // n)
        b[rng.choice(on, move, replace=False)] = False
        b[rng.choice(np.flatnonzero(~b), move + int(fresh * shape.top / n), replace=False)] = True
        out.append(b)
    return np.array(out)


def interval_levels(n: int, seed: int = 34, shape: Shape = PRODUCTION) -> np.ndarray:
    """Independent vectors."""
    rng = np.random.default_rng(seed)
    return np.array([random_bits(rng, shape) for _ in range(n)])


def fixed_levels(n: int, seed: int = 34, shape: Shape = PRODUCTION) -> np.ndarray:
    """Level i is the base with i/n of all positions flipped, in one fixed order."""
    rng = np.random.default_rng(seed)
    base, order = random_bits(rng, shape), rng.permutation(shape.size)
    out = np.repeat(base[None], n, 0)
    for i in range(n):
        out[i, order[: shape.size // n * i]] ^= True
    return out


def roles(n: int, candidates: int = 32, seed: int = 34, shape: Shape = PRODUCTION) -> np.ndarray:
    """Vectors far from each other: each is the best of some candidates by its least distance."""
    rng = np.random.default_rng(seed)
    out = [random_bits(rng, shape)]
    for _ in range(1, n):
        tries = [random_bits(rng, shape) for _ in range(candidates)]
        out.append(max(tries, key=lambda t: min(int((t ^ o).sum()) for o in out)))
    return np.array(out)


def rank_roles(n: int, seed: int = 34, shape: Shape = PRODUCTION) -> np.ndarray:
    """Vectors whose bits lie in different words, in turn."""
    rng = np.random.default_rng(seed)
    per = max(1, shape.words // n)
    return np.array([random_bits(rng, shape, range(k * per % shape.words, min(shape.words, k * per % shape.words + per)), min(shape.top, per * shape.bits // 2)) for k in range(n)])


def table(spark: SparkSession, vectors: np.ndarray, shape: Shape = PRODUCTION, **columns: str) -> DataFrame:
    """(level, code) and constant columns, such as the feature's name."""
    df = spark.createDataFrame([(k, _words(v, shape)) for k, v in enumerate(vectors)], "level int, code array<bigint>")
    return df.withColumns({c: F.lit(v) for c, v in columns.items()}) if columns else df


#: Bytes of a table of categories with their codes.
MAX_BYTES = 64 << 20


def categories(df: DataFrame, column: str, seed: int = 34, shape: Shape = PRODUCTION, max_values: int = 100_000) -> DataFrame:
    """(value, level, code): one independent vector for each distinct value, in their order."""
    values = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(max_values + 1).collect()]
    if len(values) > max_values:
        raise ValueError(f"more than {max_values} categories")
    if (size := len(values) * shape.words * 8 + sum(len(str(v)) for v in values)) > MAX_BYTES:  # callers broadcast the table
        raise ValueError(f"a table of categories takes {size} bytes, more than {MAX_BYTES}")
    codes = interval_levels(len(values), seed, shape) if values else []
    return df.sparkSession.createDataFrame([(v, k, _words(b, shape)) for k, (v, b) in enumerate(zip(values, codes, strict=True))], f"value {dict(df.dtypes)[column]}, level int, code array<bigint>")


def bucket(x: Column, low: float, high: float, levels: int, slack: float = 0.001) -> Column:
    """Index of the interval of a value between low and high, both widened by the slack. Values
    outside belong to the first or last; so does a value at the very end."""
    lo, hi = low - slack, high + slack
    step = (hi - lo) / levels
    inside = F.when(x < lo, F.lit(lo + slack)).when(x > hi, F.lit(hi - slack)).otherwise(x)
    return F.least(F.greatest(F.floor((inside - F.lit(lo)) / F.lit(step)), F.lit(0)), F.lit(levels - 1)).cast("int")


def bucket_value(level: Column, low: float, high: float, levels: int, slack: float = 0.001) -> Column:
    """The lower edge of a level, slack included."""
    lo, hi = low - slack, high + slack
    return F.lit(lo) + level * F.lit((hi - lo) / levels)


def clamp_level(x: Column, levels: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(levels - 1), x)).cast("int")
