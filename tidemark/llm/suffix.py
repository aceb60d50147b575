"""Suffix-array dedup: a logarithmic family of sparse suffix arrays.

A byte of a document is removed if a string of `length` bytes around it also starts in a
document with a smaller id. Suffixes are indexed at content-defined anchors only: the
smallest hash of a k-mer in every window of `length` bytes, so that equal windows have equal
anchors at equal offsets. An entry is ordered by the hash of its k-mer and the hash of its
context (all bytes that any window with this anchor can reach), then by document.

Entries are dealt to shards by k-mer. Within a shard every block of documents is a new batch: it
gets its own sorted array and is merge-scanned against the levels that are there. Where an
entry's whole context starts in a smaller document, all its bytes go; such entries, of the batch
and of the levels, are settled and leave the family. Then the batch becomes a level, and levels
of equal size merge geometrically. What is left open at the end are k-mers with several
contexts; these alone are looked at window by window.

Strings are told apart by hashes of their bytes (a k-mer by 32 bits within its shard, a context by
48, a window by 64); the bytes themselves are not compared.

A shard's k-mer that has very many contexts (a common passage with different surroundings) is
not compared in one place: its windows are dealt out by their own hash. Copies within a
block of documents are settled before anything is shuffled, of entries and of such windows, so
a hot passage sends one entry a block. The number of shards follows the bytes of text, which
bounds what one holds.

Defined cases: null and empty texts and texts shorter than `length` lose nothing; equal texts
lose all but the one of the smallest id; rows that repeat a doc_id don't remove each other, and
each has its own result, whether their texts are equal or not; rows with a null doc_id neither
lose nor remove anything. Extra columns are kept by the text output and ignored otherwise.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import common

U64 = np.uint64
_MAX = U64(2**64 - 1)
_SETTLED = 255  # in place of the bytes to the left: the window starts in a smaller document of its batch


@dataclass(frozen=True)
class Params:
    length: int = 50
    kmer: int = 26
    chunk: int = 1 << 18  # bytes scanned at once
    block: int = 400_000  # entries of one batch of the family
    hot: int = 50_000  # contexts of one k-mer beyond which its windows are dealt out singly
    shard: int = 8 << 20  # bytes of text for each shard at most, on average

    @property
    def window(self) -> int:  # k-mers in one string of `length` bytes
        return self.length - self.kmer + 1

    @property
    def context(self) -> int:  # bytes that windows with one anchor can reach
        return self.length + self.window - 1


def _slide(x: np.ndarray, w: int, op, fill, ahead: bool) -> np.ndarray:
    """op over x[i : i + w] (ahead) or x[i - w + 1 : i + 1]."""

    def step(a, d):
        out = np.full(len(a), fill, a.dtype)
        if d < len(a):
            if ahead:
                op(a[:-d], a[d:], out=out[:-d])
            else:
                op(a[d:], a[:-d], out=out[d:])
                out[:d] = a[:d]
        elif not ahead:
            out[:] = a
        return out

    done = 1
    while 2 * done <= w:
        x, done = step(x, done), 2 * done
    return step(x, w - done) if done < w else x


def scan(text: np.ndarray, off: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, position, k-mer hash, context hash) of the anchors of a run of documents."""
    n, lens = len(text), np.diff(off)
    none = np.zeros(0, np.int64)
    if n < p.length:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    hasher = common.Hasher(text)
    m = n - p.kmer + 1
    r = np.full(n, _MAX, np.uint64)
    r[:m] = common.mix((hasher.sums[p.kmer :] - hasher.sums[:m]) * hasher.inv[:m])
    left = np.repeat(off[1:], lens) - np.arange(off[0], off[-1])  # bytes to the end of the document
    r[left < p.kmer] = _MAX
    low = _slide(r, p.window, np.minimum, U64(0), True)
    low[left < p.length] = 0
    high = _slide(low, p.window, np.maximum, U64(0), False)
    at = np.flatnonzero((high == r) & (r != _MAX))
    doc = np.searchsorted(off - off[0], at, "right") - 1
    first, last = (off - off[0])[doc], (off - off[0])[doc + 1]
    lo, hi = np.maximum(at - p.window + 1, first), np.minimum(at + p.length, last)
    c = common.mix(hasher(lo, hi) + (at - lo).astype(np.uint64) * U64(0xD6E8FEB86659FD93))
    return doc, at - first, common.mix(r[at] * U64(0xA24BAED4963EE407) + U64(1)), c


def anchors(buf: np.ndarray, off: np.ndarray, p: Params):
    """scan() over chunks; a document longer than two chunks is scanned in overlapping parts,
    which gives the same anchors as in one."""
    before, after = p.context, p.context + p.length
    for i, j in common.spans(off, p.chunk):
        size = int(off[j] - off[i])
        if j - i > 1 or size <= 2 * p.chunk:
            d, pos, h, c = scan(buf[off[i] : off[j]], off[i : j + 1], p)
            yield d + i, pos, h, c
            continue
        for a in range(0, size, p.chunk):
            lo, hi = max(0, a - before), min(size, a + p.chunk + after)
            d, pos, h, c = scan(buf[off[i] + lo : off[i] + hi], np.array([0, hi - lo]), p)
            pos = pos + lo
            keep = (pos >= a) & (pos < a + p.chunk)
            yield d[keep] + i, pos[keep], h[keep], c[keep]


def _planes(x: np.ndarray, width: int | None = None) -> bytes:
    """An integer array as byte planes, lowest first; constant planes compress to nothing."""
    b = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)
    return b[:, : width or b.shape[1]].T.tobytes()


def _unplanes(data: memoryview, n: int, width: int, dtype) -> np.ndarray:
    out = np.zeros((n, np.dtype(dtype).itemsize), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width).reshape(width, n).T
    return out.view(dtype).ravel()


def _pack(doc: np.ndarray, pos: np.ndarray, *columns: tuple[np.ndarray, int]) -> bytes:
    """Rows ordered by document as one value: documents as differences, then positions, then
    further columns of the given widths."""
    u, n = np.unique(doc, return_counts=True)
    return b"".join([struct.pack("<II", len(u), len(doc)), _planes(np.diff(u, prepend=0).astype(np.int64)), _planes(n.astype(np.uint32)), _planes(pos.astype(np.uint32)), *(_planes(c, w) for c, w in columns)])


def _unpack(blob: bytes, *widths: tuple[int, type]) -> list[np.ndarray]:
    m, n = struct.unpack_from("<II", blob)
    view, at = memoryview(blob), 8
    u = np.cumsum(_unplanes(view[at:], m, 8, np.int64))
    at += 8 * m
    k = _unplanes(view[at:], m, 4, np.uint32)
    at += 4 * m
    out = [np.repeat(u, k), _unplanes(view[at:], n, 4, np.uint32).astype(np.int64)]
    at += 4 * n
    for w, dtype in widths:
        out.append(_unplanes(view[at:], n, w, dtype))
        at += w * n
    return out


def index_entries(docs: DataFrame, shards: int, p: Params) -> DataFrame:
    """(shard, kind, blob): kind 0 are the entries of one block for one shard, kind 1 are
    positions whose context starts in a smaller document of the same block."""

    def blocks(doc, pos, h, c):
        order = np.lexsort((pos, doc, c, h))
        doc, pos, h, c = doc[order], pos[order], h[order], c[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]
        least = doc[np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))]
        copy = doc > least
        rows = []
        keep = np.flatnonzero(~copy)
        shard = (h[keep] % U64(shards)).astype(np.int64)
        keep = keep[np.lexsort((pos[keep], doc[keep], shard))]
        shard = (h[keep] % U64(shards)).astype(np.int64)
        cut = np.flatnonzero(np.diff(shard, prepend=-1, append=shards))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            at = keep[a:b]
            rows.append((int(shard[a]), 0, _pack(doc[at], pos[at], ((h[at] // U64(shards)).astype(np.uint32), 4), (c[at], 6))))
        at = np.flatnonzero(copy)
        at = at[np.lexsort((pos[at], doc[at]))]
        for part in np.array_split(at, -(-len(at) // 200_000)) if len(at) else []:
            rows.append((int(doc[part[0]] * 7919 % shards), 1, _pack(doc[part], pos[part])))
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), common.binary_array(list(cols[2]))], names=["shard", "kind", "blob"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids, base = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for d, pos, h, c in anchors(*common.flat_text(batch.column(1)), p):
                held.append((ids[d], (pos + base[d]).astype(np.uint32), h, c))
                size += len(d)
                if size >= p.block:
                    yield blocks(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, size = [], 0
        if held:
            yield blocks(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return docs.select("doc_id", "text", "base").mapInArrow(common.tidy(run), "shard int, kind int, blob binary")


class SuffixFamily:
    """The levels of one shard. A level is sorted by k-mer, context and document; level k holds what
    is open of 2**k batches. `settled` are the entries whose context starts in a smaller document."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, ...] | None] = []
        self.settled: list[tuple[np.ndarray, np.ndarray]] = []
        self.compared = 0  # entries of levels that scans have met

    def add(self, h: np.ndarray, c: np.ndarray, doc: np.ndarray, pos: np.ndarray):
        # a sort key of the k-mer and the top of the context, and the rest of the context
        key, rest = h.astype(np.uint64) << U64(32) | c >> U64(16), (c & U64(0xFFFF)).astype(np.uint16)
        order = np.lexsort((doc, rest, key))
        run = tuple(x[order] for x in (key, rest, doc, pos))
        new = self._classes(run)
        least = run[2][np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        run = self._settle(run, run[2] > least)
        for k, level in enumerate(self.levels):
            if level is not None and len(run[0]):
                gone, below = self._scan(level, run)
                self.levels[k], run = self._settle(level, below), self._settle(run, gone)
        k = 0
        while k < len(self.levels) and self.levels[k] is not None:
            run, self.levels[k] = self._merge(self.levels[k], run), None
            k += 1
        self.levels += [None] * (k + 1 - len(self.levels))
        self.levels[k] = run

    @staticmethod
    def _classes(run) -> np.ndarray:
        """Where another k-mer or context begins."""
        return np.r_[True, (run[0][1:] != run[0][:-1]) | (run[1][1:] != run[1][:-1])][: len(run[0])]

    def _settle(self, run, gone: np.ndarray):
        if not gone.any():
            return run
        self.settled.append((run[2][gone], run[3][gone]))
        return tuple(x[~gone] for x in run)

    def _scan(self, level, run) -> tuple[np.ndarray, np.ndarray]:
        """Merge-scans a new run against a level: which entries of each start, with their whole
        context, in a smaller document of the other."""
        gone, below = np.zeros(len(run[0]), bool), np.zeros(len(level[0]), bool)
        first = np.flatnonzero(self._classes(run))  # the least document of each context
        lo = np.searchsorted(level[0], run[0][first])
        hi = np.searchsorted(level[0], run[0][first], "right")
        met = np.flatnonzero(hi > lo)
        if not len(met):
            return gone, below
        n = (hi - lo)[met]
        self.compared += int(n.sum())
        at = np.repeat(lo[met] - np.cumsum(n) + n, n) + np.arange(n.sum())
        same = level[1][at] == np.repeat(run[1][first[met]], n)
        below[at[same & (level[2][at] > np.repeat(run[2][first[met]], n))]] = True
        least = np.minimum.reduceat(np.where(same, level[2][at], np.iinfo(np.int64).max), np.cumsum(n) - n)
        ends = np.r_[first[1:], len(run[0])]
        size = (ends - first)[met]
        mine = np.repeat(first[met] - np.cumsum(size) + size, size) + np.arange(size.sum())
        gone[mine] = run[2][mine] > np.repeat(least, size)
        return gone, below

    @staticmethod
    def _merge(a, b):
        """Merges two sorted levels by a linear merge of their sort keys; ties are sorted again."""
        key = np.concatenate([a[0], b[0]])
        order = np.argsort(key, kind="stable")
        key, rest, doc, pos = key[order], *(np.concatenate([x, y])[order] for x, y in zip(a[1:], b[1:], strict=True))
        if ((key[1:] == key[:-1]) & ((rest[1:] < rest[:-1]) | (rest[1:] == rest[:-1]) & (doc[1:] < doc[:-1]))).any():
            order = np.lexsort((doc, rest, key))
            key, rest, doc, pos = key[order], rest[order], doc[order], pos[order]
        return key, rest, doc, pos

    def merged(self):
        run = tuple(np.zeros(0, t) for t in (np.uint64, np.uint16, np.int64, np.int64))
        for level in self.levels:
            if level is not None:
                run = self._merge(level, run)
        return run

    def verdicts(self) -> tuple[np.ndarray, ...]:
        """(document, position, contexts): of each entry, 0 if it is settled, else how many contexts
        its k-mer has, if it has several."""
        run = self.merged()
        new_c = self._classes(run)
        kmer = run[0] >> U64(32)
        group = np.cumsum(np.r_[True, kmer[1:] != kmer[:-1]][: len(kmer)]) - 1
        classes = np.bincount(group, new_c, minlength=1)[group].astype(np.int64)
        at = np.flatnonzero(classes > 1)
        parts = [*((d, p, np.zeros(len(d), np.int64)) for d, p in self.settled), (run[2][at], run[3][at], classes[at])]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def shard_verdicts(entries: DataFrame, p: Params) -> DataFrame:
    """(doc_id, mark): four times the position plus 0 if its context is settled, 1 if it is open,
    2 if it is open and hot."""

    def run(table: pa.Table) -> pa.Table:
        family, docs, marks = SuffixFamily(), [], []
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob"), strict=True):
            if kind:
                doc, pos = _unpack(blob.as_py())
                docs.append(doc)
                marks.append(pos * 4)
            else:
                doc, pos, h, c = _unpack(blob.as_py(), (4, np.uint32), (6, np.uint64))
                family.add(h, c, doc, pos)
        doc, pos, contexts = family.verdicts()
        docs.append(doc)
        marks.append(pos * 4 + np.where(contexts > p.hot, 2, np.minimum(contexts, 1)))
        return pa.table({"doc_id": np.concatenate(docs), "mark": np.concatenate(marks)})

    return entries.groupBy("shard").applyInArrow(common.tidy_group(run), "doc_id long, mark long")


def _own(marks: np.ndarray, shift: int, base: int, size: int) -> np.ndarray:
    """Those marks of a doc_id (position above `shift` bits) that are of the row whose text of `size`
    bytes begins at `base`, with positions in that text."""
    at = (marks >> shift) - base
    return marks[(at >= 0) & (at < size)] - (base << shift)


def open_contexts(joined: DataFrame, shards: int, p: Params) -> DataFrame:
    """(shard, blob): the context bytes of open entries, by the shard of their k-mer (of their
    window if hot)."""
    reach, width = p.window - 1, p.context

    def batch_rows(doc_id, pos, left, right, key, ctx, hot):
        shard = (key % U64(shards)).astype(np.int64)
        if hot.any():
            at = np.flatnonzero(hot)
            at = at[np.lexsort((doc_id[at], key[at]))]
            first = np.maximum.accumulate(np.where(np.r_[True, key[at][1:] != key[at][:-1]], np.arange(len(at)), 0))
            gone = at[doc_id[at] > doc_id[at[first]]]
            left[gone], ctx[gone], shard[gone] = _SETTLED, 0, doc_id[gone] % shards
        order = np.lexsort((pos, doc_id, shard))
        doc_id, pos, left, right, ctx, shard = doc_id[order], pos[order], left[order], right[order], ctx[order], shard[order]
        cut = np.flatnonzero(np.diff(shard, prepend=-1, append=shards))
        out = []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            out.append((int(shard[a]), _pack(doc_id[a:b], pos[a:b], (left[a:b], 1), (right[a:b], 1)) + ctx[a:b].tobytes()))
        return out

    def one(doc_id: int, base: int, text: np.ndarray, marks: np.ndarray):
        wide = np.zeros(len(text) + 2 * width, np.uint8)
        wide[width : width + len(text)] = text
        hasher = common.Hasher(text)
        kind, pos = marks & 3, marks >> 2
        at = np.unique(pos[kind == 1])
        left, right = np.minimum(at, reach), np.minimum(len(text) - at, p.length)
        key, n = hasher(at, at + p.kmer), len(at)
        if (kind == 2).any():
            j = np.unique((pos[kind == 2][:, None] - np.arange(p.window)).ravel())
            j = j[(j >= 0) & (j <= len(text) - p.length)]
            at, left, right = np.r_[at, j], np.r_[left, np.zeros(len(j), np.int64)], np.r_[right, np.full(len(j), p.length)]
            key = np.r_[key, hasher(j, j + p.length)]
        ctx = wide[(at + width - reach)[:, None] + np.arange(width)]
        return np.full(len(at), doc_id, np.int64), at + base, left.astype(np.uint8), right.astype(np.uint8), key, ctx, np.arange(len(at)) >= n

    def run(batches):
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            held = []
            for doc_id, z, base, marks in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(3).to_pylist(), batch.column(batch.num_columns - 1), strict=True):
                if not marks.is_valid:
                    continue
                m = marks.values.to_numpy()
                m = m[(m & 3) > 0]
                if not len(m):
                    continue
                text = np.frombuffer(unzip.decompress(z.as_py()), np.uint8)
                m = _own(m, 2, base, len(text))
                if len(m):
                    held.append(one(doc_id, base, text, m))
            if held:
                cols = list(zip(*batch_rows(*(np.concatenate(x) for x in zip(*held, strict=True))), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), common.binary_array(list(cols[1]))], names=["shard", "blob"])

    # all columns are read here as in the last step, so that both share one exchange of the texts
    return joined.mapInArrow(common.tidy(run), "shard int, blob binary")


def window_verdicts(contexts: DataFrame, p: Params) -> DataFrame:
    """(doc_id, mask): the position shifted by the window count, and a bit for each window (by its
    offset before the position) that also starts in a smaller document."""
    reach, width = p.window - 1, p.context

    def run(table: pa.Table) -> pa.Table:
        parts = []
        for blob in table.column("blob"):
            b = blob.as_py()
            doc, pos, left, right = _unpack(b, (1, np.uint8), (1, np.uint8))
            parts.append((doc, pos, left, right, np.frombuffer(b, np.uint8, len(doc) * width, len(b) - len(doc) * width)))
        doc, pos, left, right, ctx = (np.concatenate(x) for x in zip(*parts, strict=True))
        hasher = common.Hasher(ctx)
        row = np.arange(len(doc)) * width + reach
        keys, rows, bits = [], [], []
        for k in range(p.window):
            ok = np.flatnonzero((left >= k) & (left != _SETTLED) & (right.astype(np.int64) >= p.length - k))
            keys.append(hasher(row[ok] - k, row[ok] - k + p.length))
            rows.append(ok)
            bits.append(np.full(len(ok), k, np.int64))
        key, rows, bits = np.concatenate(keys), np.concatenate(rows), np.concatenate(bits)
        d = doc[rows]
        order = np.lexsort((d, key))
        new = np.r_[True, key[order][1:] != key[order][:-1]] if len(order) else np.zeros(0, bool)
        least = d[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else d
        hit = order[d[order] > least]
        mask = np.bincount(rows[hit], np.ldexp(1.0, bits[hit]), minlength=len(doc)).astype(np.int64)
        mask[left == _SETTLED] = 1
        at = np.flatnonzero(mask)
        return pa.table({"doc_id": doc[at], "mask": (pos[at] << p.window) | mask[at]})

    return contexts.groupBy("shard").applyInArrow(common.tidy_group(run), "doc_id long, mask long")


def covered(size: int, marks: np.ndarray | None, masks: np.ndarray | None, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the removed runs of a text of `size` bytes."""
    starts, ends = [], []
    if marks is not None:
        at = (marks >> 2)[(marks & 3) == 0]
        starts.append(np.maximum(at - p.window + 1, 0))
        ends.append(np.minimum(at + p.length, size))
    if masks is not None:
        at = masks >> p.window
        for k in range(p.window):
            hit = at[(masks >> k & 1) == 1] - k
            starts.append(hit)
            ends.append(hit + p.length)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    depth = np.bincount(np.concatenate(starts), minlength=size + 1) - np.bincount(np.concatenate(ends), minlength=size + 1)
    gone = np.r_[0, np.cumsum(depth)[:size] > 0, 0].astype(np.int8)
    edge = np.diff(gone)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _based(src: DataFrame) -> DataFrame:
    """Adds `base`: where a row's positions begin. That is 0 but for doc_ids that several rows have:
    their different texts are given ranges of positions of their own, one after the other."""
    again = common.materialize(src.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id"), "repeated")
    if again.isEmpty():
        common.forget(again)
        return src.withColumn("base", F.lit(0).cast("long"))
    kind = F.xxhash64("text")
    texts = src.select("doc_id", kind.alias("kind"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n")).join(again, "doc_id", "left_semi").distinct()
    before = F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("kind", "n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = common.materialize(texts.select("doc_id", "kind", before.alias("base")), "bases")
    return src.withColumn("kind", kind).join(bases, ["doc_id", "kind"], "left").withColumn("base", F.coalesce("base", F.lit(0).cast("long"))).drop("kind")


def repeats(docs: DataFrame, params: Params = Params(), output: str = "digest", extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per document. output "digest": doc_id, n_bytes, n_removed, n_spans, kept_sha256 and
    spans; "text": doc_id, text (kept bytes; a character that was cut is left out) and the extra
    columns, which can't be named as this module's own (base, kind, marks, masks, present, z)."""
    p = params
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)
    size = src.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    shards = max(4 * common.partitions(spark), -(-size // p.shard))
    src = _based(src)
    marks = shard_verdicts(index_entries(src.where("doc_id is not null"), shards, p), p)
    marks = marks.groupBy("doc_id").agg(F.collect_list("mark").alias("marks"))

    def squeeze(batches):
        zip_ = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            buf, off = common.flat_text(batch.column(1))
            z = [zip_.compress(buf[off[k] : off[k + 1]].tobytes()) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), common.binary_array(z), batch.column(1).is_valid(), *batch.columns[2:]], names=["doc_id", "z", "present", "base", *extra])

    kinds = dict(src.dtypes)
    more = "".join(f", `{c}` {kinds[c]}" for c in extra)
    # rows without an id match nothing: they pass no join and no worker, however many there are
    known, none = src.where("doc_id is not null"), src.where("doc_id is null")
    packed = known.select("doc_id", "text", "base", *extra).mapInArrow(common.tidy(squeeze), f"doc_id long, z binary, present boolean, base long{more}")
    joined = packed.join(marks, "doc_id", "left")
    masks = window_verdicts(open_contexts(joined, shards, p), p).groupBy("doc_id").agg(F.collect_list("mask").alias("masks"))
    full = joined.join(masks, "doc_id", "left").select("doc_id", "z", "present", "base", "marks", "masks", *extra)

    def finish(batches):
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            for z, present, base, m, w in zip(*(batch.column(k) for k in range(1, 6)), strict=True):
                text = unzip.decompress(z.as_py())
                m, w = (_own(x.values.to_numpy(), shift, base.as_py(), len(text)) if x.is_valid else None for x, shift in ((m, 2), (w, p.window)))
                a, b = covered(len(text), m, w, p)
                kept = text if not len(a) else b"".join(text[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(text)], strict=True))
                if output == "text":
                    cols[0].append(kept.decode("utf-8", "ignore") if present.as_py() else None)
                else:
                    row = (len(text), int((b - a).sum()), len(a), hashlib.sha256(kept).hexdigest(), [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            if output == "text":
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.string()), *batch.columns[6:]], names=["doc_id", "text", *extra])
            else:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    if output == "text":
        return full.mapInArrow(common.tidy(finish), f"doc_id long, text string{more}").unionByName(none.select("doc_id", "text", *extra))
    spans = "array<struct<start:bigint,end:bigint>>"
    whole, zero = F.coalesce("text", F.lit("")), F.lit(0).cast("long")
    whole = none.select("doc_id", F.octet_length(whole).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(whole, 256).alias("kept_sha256"), F.array().cast(spans).alias("spans"))
    return full.mapInArrow(common.tidy(finish), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans {spans}").unionByName(whole)


#: All strings of 50 bytes as hexadecimal digits, cut from pieces so that each cut is short.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
q AS (SELECT doc_id, n, j * 256 AS o, substr(h, j * 512 + 1, 512 + 98) AS part FROM (SELECT *, unnest(range(0, (n + 255) // 256)) AS j FROM d)),
b AS (SELECT doc_id, o + k AS i, CASE WHEN o + k + 50 <= n THEN substr(part, 2 * k + 1, 100) END AS w, substr(part, 2 * k + 1, 2) AS c FROM (SELECT *, unnest(range(0, least(256, n - o))) AS k FROM q)),
s AS (SELECT w, min(doc_id) AS low FROM b WHERE w IS NOT NULL GROUP BY w HAVING min(doc_id) < max(doc_id)),
f AS (SELECT DISTINCT b.doc_id, unnest(range(b.i, b.i + 50)) AS i FROM b JOIN s ON s.w = b.w AND s.low < b.doc_id),
g AS (SELECT b.doc_id, b.i, b.c, CASE WHEN f.i IS NULL THEN 0 ELSE 1 END AS gone FROM b LEFT JOIN f ON f.doc_id = b.doc_id AND f.i = b.i),
e AS (SELECT *, CASE WHEN gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 THEN 1 ELSE 0 END AS begins FROM g),
a AS (SELECT doc_id, sum(gone) AS r, sum(begins) AS s, coalesce(string_agg(c, '' ORDER BY i) FILTER (gone = 0), '') AS kept FROM e GROUP BY 1)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(a.r, 0) AS BIGINT) AS n_removed, CAST(coalesce(a.s, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(a.kept, ''))) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)
"""
