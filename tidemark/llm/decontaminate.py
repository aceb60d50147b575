"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The benchmark is the query set, taken in blocks of bounded size; every block is run against
all documents. A seed is a pair of words with at most one word between them, at a position of
an item; its hits are the same two words with at most one between them. Seeds are counted over
all documents; passages with enough hits of an item's rarer seeds are candidates, and a local
alignment of words scores each against the whole item, so edited or paraphrased copies score
high and chance seeds score low.

No alignment at or above the threshold is lost: of M matches and E errors in an item of m words,
2 M - E >= 2 t m, and M <= m, so at least M - 1 - E / 2 >= t m - 1 of the steps between matches have
at most one error, and each is a hit at another position of the item (default scores; needed_hits() has
the general bound). A passage needs hits at so many positions, less those passed over.

Defined cases: null and empty texts or items match nothing; an item of fewer than n words is
its own seed; equal items are aligned once and reported each; repeated and very long documents
each match, as often as they have rows; an empty benchmark gives no rows; null ids stay null. Seeds too common to help are passed over only at so many positions of
an item that half of the needed ones, and at least `min_seeds`, are left. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

U64 = np.uint64
_STEP = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9))
#: Letters and digits in lower case, every other ASCII byte blank, bytes of other scripts kept.
_NORMAL = np.full(256, 32, np.uint8)
for _b in range(256):
    if _b >= 128 or chr(_b).isalnum():
        _NORMAL[_b] = common.LOWER[_b]


@dataclass(frozen=True)
class Params:
    n: int = 3  # items of fewer words are their own seed
    block_chars: int = 4_000_000  # benchmark text handled at once
    min_seeds: int = 8
    rare_share: float = 1e-4  # seeds in at most this share of documents are rare
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    threshold: float = 0.5


def most_errors(lens: np.ndarray, p: Params) -> np.ndarray:
    """How many mismatches and gaps an alignment at the threshold can have."""
    return p.match * lens * (1 - p.threshold) / min(-p.mismatch, -p.gap)


def needed_hits(lens: np.ndarray, p: Params) -> np.ndarray:
    """At how many positions of an item any alignment at the threshold has a hit: the fewest of the
    shortest and the longest possible run of matches, as the bound is linear in it."""
    least = np.minimum(p.threshold * lens - 1, lens - 1 - most_errors(lens, p) / 2)
    return np.where(lens < p.n, 1, np.maximum(1, np.ceil(least - 1e-9))).astype(np.int64)


def word_stream(column: pa.Array, limit: int = 1 << 20):
    """For runs of documents: (first, last + 1, hash of each word, its document)."""
    buf, off = common.flat_text(column)
    for i, j in common.spans(off, limit):
        text, starts, _ = common.padded(buf, off, i, j, 1, 32)
        text = _NORMAL[text]
        s, e = common.words_of(text)
        yield i, j, common.Hasher(text)(s, e), np.searchsorted(starts, s, "right") - 1


def word_grams(h: np.ndarray, own: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n successive words of one document and the index of their first word."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(h) - n + 1
    g = np.full(m, U64(n), np.uint64)
    for k in range(n):
        g = (g ^ h[k : k + m]) * _STEP[k % 3]
    at = np.flatnonzero(own[:m] == own[n - 1 :])
    return common.mix(g[at]), at


def word_pairs(h: np.ndarray, own: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word and the one `step` words on in the same document, whatever the step,
    and the index of the first."""
    m = max(0, len(h) - step)
    at = np.flatnonzero(own[:m] == own[step:])
    return common.mix((h[at] * _STEP[0]) ^ (h[at + step] * _STEP[1])), at


class Seeds:
    """Sorted seed hashes with their postings (item, position), and a small filter before them.
    `need`: how many positions of each item have a hit in any passage that reaches the threshold."""

    def __init__(self, items: list[np.ndarray], n: int, p: Params = Params()):
        self.items = items
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for k, h in enumerate(items):
            own = np.zeros(len(h), np.int64)
            if len(h) < n:
                got = [(len(h), word_grams(h, own, len(h)))] if len(h) else []
            else:
                got = [(0, word_pairs(h, own, 1)), (0, word_pairs(h, own, 2))]
            for m, (g, at) in got:
                for c, x in zip(cols, (g, np.full(len(g), m), np.full(len(g), k), at), strict=True):
                    c.append(x)
        key, size, item, position = (np.concatenate([np.zeros(0, t), *c]).astype(t) for c, t in zip(cols, (np.uint64, np.int64, np.int64, np.int64), strict=True))
        order = np.lexsort((position, item, size, key))
        self.item, self.position = item[order], position[order]
        self.need = needed_hits(np.array([len(x) for x in items], np.int64), p)
        self._index(key[order], size[order])

    def _index(self, key: np.ndarray, size: np.ndarray):
        self.posting_key, self.size = key, size
        self.key, self.first, self.count = np.unique(key, return_index=True, return_counts=True)
        self.sizes = sorted(set(size.tolist()))
        self.filter = np.zeros(1 << 18, bool)
        self.filter[(self.key & U64((1 << 18) - 1)).astype(np.int64)] = True

    def only(self, keep: np.ndarray, need: np.ndarray) -> Seeds:
        out = object.__new__(Seeds)
        out.items, out.need, out.item, out.position = self.items, need, self.item[keep], self.position[keep]
        out._index(self.posting_key[keep], self.size[keep])
        return out

    def hits(self, h: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(seed, index of its first word) of all seeds in a word stream."""
        seeds, ats = [], []
        for g, at in [x for n in self.sizes for x in ([word_grams(h, own, n)] if n else [word_pairs(h, own, 1), word_pairs(h, own, 2)])]:
            ok = np.flatnonzero(self.filter[(g & U64((1 << 18) - 1)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.key, g[ok]), len(self.key) - 1)
            good = self.key[k] == g[ok]
            seeds.append(k[good])
            ats.append(at[ok[good]])
        return np.concatenate(seeds or [np.zeros(0, np.int64)]), np.concatenate(ats or [np.zeros(0, np.int64)])


def align(queries: list[np.ndarray], passages: list[np.ndarray], p: Params) -> np.ndarray:
    """Smith-Waterman scores of many pairs at once; rows of the matrices are done together, and
    the run of gaps within a row is a running maximum."""
    out = np.zeros(len(queries), np.int32)
    order = np.argsort([len(q) * 100_000 + len(s) for q, s in zip(queries, passages, strict=True)], kind="stable")
    at = 0
    while at < len(order):
        rows = max(1, 400_000 // max(1, max(len(passages[k]) for k in order[at : at + 256])))
        part = order[at : at + min(rows, 256)]
        at += len(part)
        nq, ns = max(len(queries[k]) for k in part), max(len(passages[k]) for k in part)
        q, s = np.zeros((len(part), nq), np.uint64), np.ones((len(part), ns), np.uint64)
        real = np.zeros((len(part), nq), bool)
        for r, k in enumerate(part):
            q[r, : len(queries[k])], s[r, : len(passages[k])] = queries[k], passages[k]
            real[r, : len(queries[k])] = True
        h = np.zeros((len(part), ns + 1), np.int32)
        best = np.zeros(len(part), np.int32)
        slope = np.arange(ns + 1, dtype=np.int32) * -p.gap
        for c in range(nq):
            t = h + p.gap
            t[:, 1:] = np.maximum(t[:, 1:], h[:, :-1] + np.where(s == q[:, c : c + 1], p.match, p.mismatch).astype(np.int32))
            np.maximum(t, 0, out=t)
            t[:, 0] = 0
            t = np.maximum.accumulate(t + slope, axis=1) - slope
            h = np.where(real[:, c : c + 1], t, h)
            np.maximum(best, h.max(1), out=best)
        out[part] = best
    return out


def _item_words(texts: list[str | None]) -> list[np.ndarray]:
    col = pa.array(texts, pa.string())
    out: list[np.ndarray] = []
    for i, j, h, own in word_stream(col):
        cut = np.searchsorted(own, np.arange(j - i + 1))
        out += [h[cut[k] : cut[k + 1]] for k in range(j - i)]
    return out


def document_frequency(docs: DataFrame, seeds: Seeds) -> tuple[np.ndarray, int]:
    """In how many documents each seed occurs, over all documents, and their number."""
    shared = docs.sparkSession.sparkContext.broadcast(seeds)

    def run(batches):
        seeds = shared.value
        df, n = np.zeros(len(seeds.key), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for i, j, h, own in word_stream(batch.column(0)):
                k, at = seeds.hits(h, own)
                pair = np.unique(own[at] * len(seeds.key) + k)
                df += np.bincount(pair % len(seeds.key), minlength=len(seeds.key))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[n, df[at]])], names=["seed", "n"])

    # one row for each seed of the block at most: bounded by block_chars
    got = docs.select(F.col("text").cast("string")).mapInArrow(common.tidy(run), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(len(seeds.key), np.int64), 0
    for r in got:
        if r.seed < 0:
            n = r.n
        else:
            df[r.seed] = r.n
    return df, n


def rare(seeds: Seeds, df: np.ndarray, n_docs: int, p: Params) -> Seeds:
    """Passes over the most common positions of each item that aren't rare outright: of the needed
    positions at most half, and so many that min_seeds are still needed."""
    d = df[np.searchsorted(seeds.key, seeds.posting_key)]
    # a position has two seeds; it is as common as both together
    place = seeds.item * (1 + seeds.position.max(initial=0)) + seeds.position
    _, first, at = np.unique(place, return_index=True, return_inverse=True)
    total, item = np.bincount(at, d, len(first)), seeds.item[first]
    order = np.lexsort((-total, item))
    rank = np.empty(len(first), np.int64)
    rank[order] = np.arange(len(first)) - np.searchsorted(item[order], item[order])
    most = np.maximum(0, np.minimum(seeds.need // 2, seeds.need - p.min_seeds))
    out = (rank < most[item]) & (total > max(5, p.rare_share * n_docs))
    return seeds.only(~out[at], seeds.need - np.bincount(item[out], minlength=len(seeds.items)))


#: Hits times items handled at once.
_POSTINGS = 2_000_000


def _candidates(seeds: Seeds, h: np.ndarray, own: np.ndarray, p: Params):
    """(document, item, first word, last word + 1, hits) of passages to align."""
    k, at = seeds.hits(h, own)
    order = np.argsort(at, kind="stable")
    k, at = k[order], at[order]
    doc = own[at]
    load = np.cumsum(seeds.count[k]) if len(k) else np.zeros(0, np.int64)
    out, a = [], 0
    while a < len(k):
        # whole documents, so many that their postings fit
        b = int(np.searchsorted(load, (load[a - 1] if a else 0) + _POSTINGS, "right"))
        b = int(np.searchsorted(doc, doc[b])) if b < len(k) else b
        b = b if b > a else int(np.searchsorted(doc, doc[a], "right"))
        out += _passages(seeds, k[a:b], at[a:b], own, p)
        a = b
    return out


def _passages(seeds: Seeds, k: np.ndarray, at: np.ndarray, own: np.ndarray, p: Params):
    n = seeds.count[k]
    post = np.repeat(seeds.first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
    item, at = seeds.item[post], np.repeat(at, n)
    place = own[at] * len(seeds.items) + item
    order = np.lexsort((at, place))
    place, at, item, position = place[order], at[order], item[order], seeds.position[post][order]
    lens = np.array([len(x) for x in seeds.items], np.int64)
    # an alignment has at most `lens` matches and this many errors
    reach = lens + np.ceil(most_errors(lens, p)).astype(np.int64)
    # hits from which as many as needed follow within reach; one position may count repeatedly
    last = np.arange(len(place)) + seeds.need[item] - 1
    good = last < len(place)
    last = np.minimum(last, len(place) - 1)
    start = np.flatnonzero(good & (place[last] == place) & (at[last] - at < reach[item]))
    if not len(start):
        return []
    last, where, what = last[start], place[start], item[start]
    lo, hi = at[last] - reach[what], at[start] + reach[what] + 1  # holds every alignment with all of these hits
    new = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]) | (lo[1:] > at[last][:-1] + 2)])
    ends = np.r_[new[1:], len(start)] - 1
    doc = where[new] // len(seeds.items)
    lo = np.maximum(lo[new], np.searchsorted(own, doc))
    hi = np.minimum(hi[ends], np.searchsorted(own, doc, "right"))
    return list(zip(doc.tolist(), what[new].tolist(), lo.tolist(), hi.tolist(), (last[ends] - start[new] + 1).tolist(), strict=True))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", params: Params = Params()) -> DataFrame:
    """(doc_id, item_id, n_seeds, score, similarity) of every document and item whose best
    alignment reaches the threshold. Nothing of the documents is shuffled."""
    p = params
    total = benchmark.select("text").distinct().agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-total // p.block_chars))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return reduce(DataFrame.unionByName, (_block(src, benchmark, item_col, b, blocks, p) for b in range(blocks)))


def _block(src: DataFrame, benchmark: DataFrame, item_col: str, b: int, blocks: int, p: Params) -> DataFrame:
    """The matches of the items whose texts are dealt to block b: different texts of about block_chars
    in all, each with the ids that have it."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    chosen = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).groupBy("text").agg(F.sort_array(F.collect_list(F.struct("item_id"))).alias("ids"))
    rows = sorted(chosen.collect(), key=lambda r: r.text)
    ids = [[x.item_id for x in r.ids] for r in rows]
    seeds = Seeds(_item_words([r.text for r in rows]), p.n, p)
    schema = "doc_id long, item_id long, n_seeds int, score int, similarity double"
    if not len(seeds.key):
        return src.sparkSession.createDataFrame([], schema)
    seeds = rare(seeds, *document_frequency(src, seeds), p)
    shared = src.sparkSession.sparkContext.broadcast((seeds, ids))  # about block_chars

    def run(batches):
        seeds, ids = shared.value
        for batch in batches:
            out: dict[tuple[int, int], tuple[int, int]] = {}
            for i, j, h, own in word_stream(batch.column(1)):
                cands = _candidates(seeds, h, own, p)
                got = align([seeds.items[c[1]] for c in cands], [h[c[2] : c[3]] for c in cands], p)
                for (d, item, _, _, n), s in zip(cands, got.tolist(), strict=True):
                    if s >= p.threshold * p.match * len(seeds.items[item]):
                        key = (i + d, item)
                        out[key] = max(out.get(key, (0, 0)), (s, n))
            rows = [(batch.column(0)[d].as_py(), item, n, s, round(s / (p.match * len(seeds.items[k])), 6)) for (d, k), (s, n) in sorted(out.items()) for item in ids[k]]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "n_seeds", "score", "similarity"])

    return src.mapInArrow(common.tidy(run), schema)
