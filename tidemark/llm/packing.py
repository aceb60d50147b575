"""Packing: order-preserving dynamic programming over cut points.

Documents are tokenised and laid end to end in the order in which their partition reads
them. A sequence may end at a document's end (free), at a sentence's end (a small penalty)
or, where neither comes for a while, inside a sentence (a larger one). The cuts minimise
padding plus penalties; as padding is linear in a sequence's length, the best predecessor of
each cut is the minimum of a sliding window, kept in a monotone queue.

Each partition is packed by itself, so nothing is shuffled and a lost task is repeated alone;
a partition's rest, wherever it is best begun, is split into powers of two, which need no padding.
A partition is read in stretches of `FLUSH` tokens. The last cut of a stretch is free: it lies
where it is best, within a sequence of the stretch's end, and what follows it begins the next one,
so that stretches force no padding.

Defined cases: a null or empty text is the end token alone; a document longer than a sequence
is cut; equal rows are packed separately; a null doc_id stays null; of equally good cuts the
latest is taken. Extra columns are ignored.
"""

from __future__ import annotations

import os
from array import array
from bisect import bisect_left
from collections import deque
from itertools import repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CAPACITY = 4096
SENTENCE_PENALTY = 2
BREAK_PENALTY = 12
STRIDE = 16  # tokens between cut points inside a sentence
FLUSH = 1 << 20  # tokens of a stretch, which bounds what is held
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")  # the tokenizer's own pattern
_SIMPLE = regex.compile(r"[\x21-\x7e¡-ɏ]+")
_MARKS = b".,;:!?"
_ID = attrgetter("id")
_MAX_WORDS = 350_000  # words that a worker remembers; then it keeps the most frequent


def _stops(word: bytes) -> bool:
    """Whether a sentence ends with this word."""
    return word[-1] in b".!?" or word[-1] in b"\"')]}" and word.rstrip(b"\"')]}")[-1:] in (b".", b"!", b"?")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, others for 256 upward."""
    same = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: b for b in same} | {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in same)}


class WordIds(dict):
    """Maps words (as bytes) to rows of a growing table of token ids.

    Words are separated by white space, which this tokenizer drops, so a text's ids are its
    words' ids in order. Plain Latin words are cut into the tokenizer's pieces and each piece
    is tokenised once; any other word goes through the whole tokenizer."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # each piece is asked for once
        self.letters = _byte_letters()
        self.end_id = end_id
        self.reset()

    def reset(self):
        self.clear()
        self.pieces: dict[bytes, bytes] = {}
        self.flat = np.array([self.end_id], np.uint32)
        self.starts, self.lens = np.zeros(1, np.int64), np.ones(1, np.int64)
        self.stops = np.zeros(1, bool)
        self.hits = np.zeros(1, np.int64)
        self[None] = 0

    def shrink(self):
        """Forgets all but the quarter of the words that occurred most often; ids don't change by it."""
        keep = 1 + np.sort(np.argsort(-self.hits[1:], kind="stable")[: _MAX_WORDS // 4])
        keep = np.r_[0, keep[self.hits[keep] > 1]]
        names, lens = list(self), self.lens[keep]
        ends = np.cumsum(lens)
        self.flat = self.flat[np.repeat(self.starts[keep] - ends + lens, lens) + np.arange(ends[-1])]
        self.starts, self.lens, self.stops, self.hits = ends - lens, lens, self.stops[keep], self.hits[keep] // 2
        self.clear()
        self.pieces.clear()
        self.update((names[k], row) for row, k in enumerate(keep.tolist()))

    def _piece(self, piece: str) -> bytes:
        """The ids of one lower-case piece as 32-bit numbers."""
        key = piece.encode()
        ids = self.pieces.get(key)
        if ids is None:
            ids = self.pieces[key] = array("I", map(_ID, self.model.tokenize(key.decode("latin-1").translate(self.letters)))).tobytes()
        return ids

    def _ids(self, word: bytes) -> bytes:
        """The word's ids as 32-bit numbers."""
        s = word.decode()
        if not _SIMPLE.fullmatch(s) or "<|" in s:
            return array("I", self.tokenizer.encode(s, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self._piece, _PIECE.findall(s.lower())))

    def _all_ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word. ASCII letters, and such with a mark at the end, take a short way, since
        they are most of what a large corpus adds."""
        pieces, tokenize, out = self.pieces, self.model.tokenize, []
        marks = {m: self._piece(chr(m)) for m in _MARKS}
        for word in words:
            mark = b""
            if word.isalpha():
                key = word.lower()
            else:
                mark = marks.get(word[-1])
                key = word[:-1].lower()
                if mark is None or not key.isalpha():
                    out.append(self._ids(word))
                    continue
            ids = pieces.get(key)
            if ids is None:
                ids = pieces[key] = array("I", map(_ID, tokenize(key.decode()))).tobytes()
            out.append(ids + mark)
        return out

    def learn(self, words: list[bytes]):
        """Tokenises new words, which follow the known ones."""
        if words:
            self.update(zip(words, range(len(self.lens), len(self.lens) + len(words)), strict=True))
            ids = self._all_ids(words)
            lens = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            flat = np.frombuffer(b"".join(ids), np.uint32)
            starts = len(self.flat) + np.cumsum(lens) - lens
            stops = np.fromiter(map(_stops, words), bool, len(ids))
            self.flat, self.lens = np.concatenate([self.flat, flat]), np.concatenate([self.lens, lens])
            self.starts, self.stops = np.concatenate([self.starts, starts]), np.concatenate([self.stops, stops])
            self.hits = np.concatenate([self.hits, np.zeros(len(ids), np.int64)])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the texts laid end to end, each with the end token; where texts end; where
        sentences end."""
        if len(self) > _MAX_WORDS:
            self.shrink()
        words: list = []
        counts = np.empty(len(texts), np.int64)
        for k, t in enumerate(texts):
            w = t.split()
            counts[k] = len(w) + 1
            words += w
            words.append(None)
        at = np.fromiter(map(self.get, words, repeat(-1)), np.int64, len(words))
        if (new := np.flatnonzero(at < 0)).size:
            met = [words[k] for k in new.tolist()]
            self.learn(list(dict.fromkeys(met)))
            at[new] = np.fromiter(map(self.__getitem__, met), np.int64, len(met))
        self.hits += np.bincount(at, minlength=len(self.lens))
        lens = self.lens[at]
        ends = np.cumsum(lens)
        ids = self.flat[np.repeat(self.starts[at] - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, ends[np.cumsum(counts) - 1], ends[self.stops[at]]


_TOKENIZERS: dict[tuple[str, int], WordIds] = {}


def word_ids(path: str, end_id: int) -> WordIds:
    """One table for each worker process, kept between its tasks."""
    if (path, end_id) not in _TOKENIZERS:
        _TOKENIZERS[path, end_id] = WordIds(path, end_id)
    return _TOKENIZERS[path, end_id]


def cut_points(ends: np.ndarray, sentences: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a sequence may end and their penalties; no gap exceeds the stride."""
    known = np.union1d(ends, sentences)
    gaps = np.diff(known, prepend=0)
    wide = np.flatnonzero(gaps > stride)
    n = (gaps[wide] - 1) // stride  # further cuts in each wide gap
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
    pos = np.concatenate([known, np.repeat((known - gaps)[wide], n) + step * stride])
    pos.sort(kind="stable")
    pen = np.full(len(pos), BREAK_PENALTY, np.int64)
    pen[np.searchsorted(pos, sentences)] = SENTENCE_PENALTY
    pen[np.searchsorted(pos, ends)] = 0
    return pos, pen


class Cuts:
    """The best cuts of a growing stream, by dynamic programming with a monotone queue.

    cost(i) = pen(i) + capacity - (pos(i) - pos(j)) + cost(j) over the cuts j within capacity;
    with g(j) = cost(j) + pos(j) it is g(i) = pen(i) + capacity + min g(j). Cut 0 is the beginning."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self._begin(0)

    def _begin(self, at: int):
        self.pos, self.pen, self.g, self.back = [at], [0], [at], [0]
        self.queue = deque([0])

    def extend(self, pos: np.ndarray, pen: np.ndarray):
        """Positions, in order and after those before, where a sequence may end, and their penalties."""
        p, g, back, queue, capacity = self.pos, self.g, self.back, self.queue, self.capacity
        i, first = len(p), queue[0]
        p += pos.tolist()
        costs = pen.tolist()
        self.pen += costs
        for c in costs:
            at = p[i]
            while at - p[first] > capacity:
                queue.popleft()
                first = queue[0]
            v = g[first] + c + capacity
            g.append(v)
            back.append(first)
            while queue and g[queue[-1]] >= v:
                queue.pop()
            queue.append(i)
            first = queue[0]
            i += 1

    def path(self, i: int) -> list[int]:
        """The positions of cut i and those before it."""
        out = []
        while i:
            out.append(self.pos[i])
            i = self.back[i]
        return out[::-1]

    def final(self) -> int:
        """The best last cut if what follows it, a sequence's capacity at most, costs nothing."""
        first = bisect_left(self.pos, self.pos[-1] - self.capacity)
        return min(range(first, len(self.pos)), key=lambda k: (self.g[k] - self.pos[k], -k))

    def drop(self, i: int):
        """Makes cut i the beginning; the cuts after it start from there."""
        pos, pen = np.array(self.pos[i + 1 :], np.int64), np.array(self.pen[i + 1 :], np.int64)
        self._begin(self.pos[i])
        self.extend(pos, pen)


def best_cuts(pos: np.ndarray, pen: np.ndarray, capacity: int = CAPACITY) -> list[int]:
    """Cut positions, the last of pos included, that minimise padding plus penalties."""
    cuts = Cuts(capacity)
    cuts.extend(pos, pen)
    return cuts.path(len(cuts.pos) - 1)


def _powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class _Packer:
    """Packs one partition; holds the documents whose sequences aren't settled yet."""

    def __init__(self, first_sequence: int, capacity: int, flush: int = FLUSH):
        self.next, self.flush = first_sequence, flush
        self.cuts = Cuts(capacity)
        self.ids = [np.zeros(0, np.uint16)]
        self.begin, self.end = 0, 0  # tokens before the held ones, and with them
        self.docs: list = []
        self.sizes: list[int] = []  # tokens of each held document
        self.begun = 0  # tokens of the first held document that are already out
        self.rows: list[tuple] = []

    def add(self, docs: list, ids: np.ndarray, ends: np.ndarray, sentences: np.ndarray):
        self.ids.append(ids.astype(np.uint16) if ids.max(initial=0) < 1 << 16 else ids)
        pos, pen = cut_points(ends, sentences)
        self.cuts.extend(pos + self.end, pen)
        self.end += len(ids)
        self.docs += docs
        self.sizes += np.diff(ends, prepend=0).tolist()

    def settle(self, last: bool):
        if self.end == self.begin:
            return
        i = self.cuts.final()
        cuts = self.cuts.path(i)
        if last:
            head = cuts[-1] if cuts else self.begin
            for n in _powers(self.end - head):
                cuts.append(head + n)
                head += n
        else:
            self.cuts.drop(i)
        ids = np.concatenate(self.ids)
        a, k, done = 0, 0, self.begun
        for cut in cuts:
            offset, cut = 0, cut - self.begin
            while a < cut:
                n = min(cut - a, self.sizes[k] - done)
                self.rows.append((self.docs[k], done, n, common.crc32(ids[a : a + n].astype("<u4").tobytes()), self.sizes[k], self.next, offset))
                a, done, offset = a + n, done + n, offset + n
                if done == self.sizes[k]:
                    k, done = k + 1, 0
            self.next += 1
        self.docs, self.sizes, self.begun = self.docs[k:], self.sizes[k:], done
        self.ids, self.begin = [ids[a:].copy()], self.begin + a


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    where = path or tokenizer_path()

    def run(batches):
        packer = None
        for batch in batches:
            if packer is None and batch.num_rows:
                packer = _Packer(batch.column(2)[0].as_py() << 36, capacity)
            buf, off = common.flat_text(batch.column(1))
            for i, j in common.spans(off, 1 << 20):
                texts = [buf[off[k] : off[k + 1]].tobytes() for k in range(i, j)]
                packer.add(batch.column(0).slice(i, j - i).to_pylist(), *word_ids(where, end_id).encode(texts))
                if packer.end - packer.begin >= packer.flush:
                    packer.settle(False)
                    yield from emit(packer)
        if packer is not None:
            packer.settle(True)
            yield from emit(packer)

    def emit(packer):
        if packer.rows:
            cols = list(zip(*packer.rows, strict=True))
            packer.rows = []
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.spark_partition_id().alias("part"))
    return src.mapInArrow(common.tidy(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
