"""Helpers shared by the corpus operators: tables, shared storage, text buffers, hashing.

Text is handled as one flat byte buffer per Arrow batch, so that the per-character work is
numpy on arrays and memory is bounded by the chunk size rather than by the partition.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import local, shared_dir  # noqa: F401
from ..session import ship as ship_code

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
#: White space as the contracts define it: space and 0x09-0x0D.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE_BYTES)] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_OPEN: list[list[str]] = []  # tables made within the scratch() blocks that are open


def materialize(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Cuts the lineage: writes df as a table in the shared folder and reads it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path  # noqa: SLF001
    return out


def _delete(spark: SparkSession, path: str) -> None:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


def forget(df: DataFrame) -> None:
    """Deletes a table made by materialize() that no later plan reads."""
    _delete(df.sparkSession, df._tidemark_path)  # noqa: SLF001


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """Deletes the tables that are materialized inside of the block when it ends, but for those
    made by the function that it gives, which takes the arguments of materialize(). Shuffle
    files of plans that are gone are released too."""
    kept: list[DataFrame] = []

    def keep(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
        kept.append(materialize(df, label, compression))
        return kept[-1]

    _OPEN.append([])
    try:
        yield keep
    finally:
        paths, mine = _OPEN.pop(), {k._tidemark_path for k in kept}  # noqa: SLF001
        for path in paths:
            if path not in mine:
                _delete(spark, path)
        if _OPEN:
            _OPEN[-1] += sorted(mine)
        release(spark)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of plans that nothing refers to any more; it
    learns of them by garbage collection on the driver only."""
    gc.collect()
    spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(doc_id: Column | str, n: int) -> Column:
    """crc32(doc_id as text) mod n; the fold of a document (a null id counts as fold 0)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % n, F.lit(0))


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and their offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off


def spans(off: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cuts documents [0, n) into runs of about `limit` bytes, at least one document each."""
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser: turns a polynomial hash into evenly spread bits."""
    h = h ^ (h >> U64(31))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(29)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(32)
    return h


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i mod 2**64 for i in [0, n]."""
    if len(_POWERS[0]) <= n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(n + 1, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][: n + 1], _POWERS[1][: n + 1]


_BYTE = np.random.default_rng(20240229).integers(1, 1 << 62, 256, dtype=np.uint64) * U64(2) + U64(1)


class Hasher:
    """64-bit hashes of arbitrary substrings of one buffer, in constant time each."""

    def __init__(self, buf: np.ndarray):
        self.pow, self.inv = powers(len(buf))
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * self.pow[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inv[start] + (end - start).astype(np.uint64))


def words_of(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of other than white space) in a buffer."""
    blank = np.ones(len(buf) + 2, bool)
    blank[1:-1] = IS_SPACE[buf]
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    return edge[::2], edge[1::2]


def padded(buf: np.ndarray, off: np.ndarray, i: int, j: int, pad: int, fill: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents i..j-1 with `pad` bytes of `fill` after each: the buffer, their starts and ends."""
    lens = np.diff(off[i : j + 1])
    starts = np.zeros(j - i, np.int64)
    np.cumsum(lens[:-1] + pad, out=starts[1:])
    out = np.full(int(lens.sum()) + pad * (j - i), fill, np.uint8)
    for k in range(j - i):
        out[starts[k] : starts[k] + lens[k]] = buf[off[i + k] : off[i + k + 1]]
    return out, starts, starts + lens


def trim() -> None:
    """Gives freed memory back to the system: an idle Python worker would keep it otherwise, beside
    the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def tidy(run):
    """A function over Arrow batches that trims its worker when its task ends."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return tidied


def tidy_group(run):
    """A function of one group that trims its worker afterwards."""

    def tidied(table):
        try:
            return run(table)
        finally:
            trim()

    return tidied


def binary_array(values: list) -> pa.Array:
    return pa.array(values, pa.binary())


#: Rows of whole texts in one Arrow batch: bounds the buffers on both sides of a Python worker.
BATCH_ROWS = 500


def ship(spark: SparkSession) -> None:
    """Bounds Arrow batches (a setting that stays, as plans read it when they run), and on a cluster
    sends this package to Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    ship_code(spark)
