"""Hashed character n-grams of whole texts, computed on flat code-point arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import common

#: Separator code point between texts; no gram that touches it is used.
_PAD = 16


def code_points(column: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of documents: (first, last + 1, lower-cased code points, starts, ends). A text
    longer than `limit` is a run of its own; it is never cut."""
    buf, off = common.flat_text(column)
    sep = "\x00" * _PAD
    for i, j in common.spans(off, limit):
        texts = [buf[off[k] : off[k + 1]].tobytes().decode("utf-8", "replace").lower() for k in range(i, j)]
        lens = np.fromiter(map(len, texts), np.int64, j - i)
        starts = np.zeros(j - i, np.int64)
        np.cumsum(lens[:-1] + _PAD, out=starts[1:])
        cps = np.frombuffer((sep.join(texts) + sep).encode("utf-32-le", "surrogatepass"), np.uint32)
        yield i, j, cps, starts, starts + lens


def buckets(cps: np.ndarray, orders: tuple[int, ...], bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each order n: (n, bucket of the n-gram that starts at each code point). The last
    n - 1 positions of a text touch the separator; callers leave them out."""
    n = len(cps)
    h = np.full(n, 0x811C9DC5, np.uint32)
    for k in range(1, max(orders) + 1):
        h *= np.uint32(0x01000193)
        h[: n - k + 1] += cps[k - 1 :] * np.uint32(0x9E3779B1)
        if k in orders:
            x = h ^ (h >> np.uint32(15))
            x *= np.uint32((0x2C1B3C6D + 2 * k * 0x1F123BB5) & 0xFFFFFFFF | 1)
            yield k, x >> np.uint32(32 - bits)


def owners(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """The document of each position, -1 between documents."""
    out = np.full(size, -1, np.int32)
    for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        out[a:b] = k
    return out
