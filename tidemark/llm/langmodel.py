"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

A word is reached by three choices of 16 and a last one: a class by its ending, a class by its
beginning and length within that, a class by its hash within those, and the word within the
last class. Each choice among classes is a maximum-entropy model of its own whose features are
hashed: the word before (bigram), the two before together (trigram) and the one before that
alone (skip), each together with the classes chosen so far. So n-grams and skips tell some 3,600
last classes apart; the softmax over the words of one, 25 or so of 100,000 words, has unigram
features only, whose smoothed maximum is known in closed form from the counts.

Weights are learnt by distributed gradient updates: every task runs one pass of adaptive
mini-batch steps with an L2 penalty over its own texts from the current weights. What the tasks
changed in a row is averaged by the squared gradients that each has seen there, so that a context
that one task alone has met keeps its weights; where all have seen little, changes add up
instead. Tables meet in two steps, so that no task reads those of all tasks.

Counts cover all training texts and are never gathered in one place: blocks of documents
send their distinct words to shards by hash, shards sum them and answer each block, and the
block's texts, which are exchanged once, meet the answers. Texts are scored by sparse numpy
batches: a row of the weight table for each feature of each choice.

The counts grow with the input; the weight table, which is broadcast, has a fixed size (`bits`).

Defined cases: null and empty texts hold the end token alone; without training texts every
count is zero and probabilities are uniform over classes; repeated rows count each; a null
doc_id is scored, and held out or not as the caller says (by crc_mod, as in the query, it is held out). Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

U64 = np.uint64
#: The end token's hash; no word has it but by a collision of 64 bits.
END = U64(0x5851F42D4C957F2D)
_BEFORE = U64(0x14057B7EF767814F)
#: Outcomes of a choice. The last one of the first choice is the end token's, which has no others.
WAYS = 16
LEAVES = WAYS**3
#: Choices that have a bias of their own: the first, one for each class, one for each pair of classes.
_BIASES = 1 + WAYS + WAYS * WAYS
_PARTS = 64
_ALONE = 3.0  # squared gradients of a row by which the changes of several tasks go over from sum to mean


@dataclass(frozen=True)
class Params:
    bits: int = 17  # rows of the hashed weight table
    rate: float = 0.5
    l2: float = 1e-5
    batch: int = 4096  # tokens of one gradient step
    passes: int = 1
    smooth: float = 0.1
    block: int = 4 << 20  # bytes of text that ask for counts together
    shard: int = 128 << 20  # bytes of text at most for each shard of the counts, which one group holds

    @property
    def rows(self) -> int:
        return (1 << self.bits) + _BIASES


def tokens(buf: np.ndarray, off: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, class by spelling, document) of the tokens of documents i..j-1, each with its end token."""
    text, starts, ends = common.padded(buf, off, i, j, 1, 32)
    text = common.LOWER[text]
    s, e = common.words_of(text)
    h = common.Hasher(text)(s, e)
    last, before = text[e - 1], np.where(e - s > 1, text[np.maximum(e - 2, 0)], 0)
    end = ((last.astype(np.int64) * 31 + before * 7 + 3) * 2654435761 >> 9) % (WAYS - 1)
    start = ((text[s].astype(np.int64) * 5 + np.minimum(e - s, 12) // 3) * 2654435761 >> 9) % WAYS
    own = np.searchsorted(starts, s, "right") - 1
    # the end token follows a document's words
    n = j - i
    place = np.searchsorted(own, np.arange(n), "right")
    return np.insert(h, place, END), np.insert(end * WAYS + start, place, (WAYS - 1) * WAYS), np.insert(own, place, np.arange(n))


def leaves(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The last class of tokens, by all three choices."""
    c = c.astype(np.int64)
    return c * WAYS + np.where(c < (WAYS - 1) * WAYS, (common.mix(h.copy()) >> U64(60)).astype(np.int64), 0)


def contexts(h: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
    """Hashes of each token's features: the word before, the one before that, both."""
    one, two = np.full(len(h), _BEFORE, np.uint64), np.full(len(h), _BEFORE, np.uint64)
    one[1:] = np.where(own[1:] == own[:-1], h[:-1], _BEFORE)
    two[2:] = np.where(own[2:] == own[:-2], h[:-2], _BEFORE)
    both = one * U64(3) + two * U64(0x27D4EB2F165667C5)
    return [common.mix(x * U64(k)) for x, k in ((one, 0x9E3779B97F4A7C15), (two, 0xC2B2AE3D27D4EB4F), (both, 0x165667B19E3779F9))]


def choices(leaf: np.ndarray):
    """For each of the three choices: which tokens make it, at which node, with what outcome."""
    word = np.flatnonzero(leaf < (WAYS - 1) * WAYS * WAYS)
    yield np.arange(len(leaf)), np.zeros(len(leaf), np.int64), leaf // (WAYS * WAYS)
    yield word, 1 + leaf[word] // (WAYS * WAYS), leaf[word] // WAYS % WAYS
    yield word, 1 + WAYS + leaf[word] // WAYS, leaf[word] % WAYS


def table_rows(features: list[np.ndarray], node: np.ndarray, p: Params) -> list[np.ndarray]:
    """Rows of the weight table that the features select at a node; the last is the node's bias."""
    salt = node.astype(np.uint64) * U64(0xD6E8FEB86659FD93)
    return [*(((f ^ salt) * U64(0x9E3779B97F4A7C15) >> U64(64 - p.bits)).astype(np.int64) for f in features), (1 << p.bits) + node]


def exp_scores(w: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of each outcome's score and their sums."""
    z = w.take(rows[0], axis=0)
    for r in rows[1:]:
        z += w.take(r, axis=0)
    np.exp(np.clip(z, -40, 40, out=z), out=z)
    return z, z @ np.ones(z.shape[1], z.dtype)


def log_paths(w: np.ndarray, h: np.ndarray, c: np.ndarray, own: np.ndarray, p: Params) -> np.ndarray:
    """The natural logarithm of each token's probability of its last class."""
    out, leaf, feats = np.zeros(len(h)), leaves(h, c), contexts(h, own)
    for a in range(0, len(h), p.batch):
        part = slice(a, a + p.batch)
        for at, node, outcome in choices(leaf[part]):
            z, total = exp_scores(w, table_rows([f[part][at] for f in feats], node, p))
            out[a + at] += np.log(z[np.arange(len(at)), outcome] / total)
    return out


def train_pass(w: np.ndarray, heat: np.ndarray, h: np.ndarray, c: np.ndarray, own: np.ndarray, p: Params) -> None:
    """One pass over some tokens. heat sums the squared gradients of each row, by which its steps
    shrink."""
    leaf, feats = leaves(h, c), contexts(h, own)
    for a in range(0, len(h), p.batch):
        part = slice(a, a + p.batch)
        for at, node, outcome in choices(leaf[part]):
            if not len(at):
                continue
            rows = table_rows([f[part][at] for f in feats], node, p)
            g, total = exp_scores(w, rows)
            g /= total[:, None]
            g[np.arange(len(at)), outcome] -= 1
            for r in rows:
                order = np.argsort(r)
                r = r[order]
                first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                idx = r[first]
                s = g.take(order[first], axis=0)
                size = np.diff(first, append=len(r))
                if (many := np.flatnonzero(size > 1)).size:  # rows that several tokens select
                    n = size[many]
                    begin = np.cumsum(n) - n
                    s[many] = np.add.reduceat(g.take(order[np.repeat(first[many] - begin, n) + np.arange(n.sum())], axis=0), begin, axis=0)
                own = w.take(idx, axis=0)
                s += p.l2 * own
                hot = heat[idx] + np.einsum("ij,ij->i", s, s) / WAYS
                heat[idx] = hot
                s *= (p.rate / np.sqrt(hot + 1))[:, None]
                own -= s
                w[idx] = own


def _pack_rows(change: np.ndarray, heat: np.ndarray, squares: np.ndarray) -> bytes:
    return np.stack([heat, squares]).astype(np.float32).tobytes() + change.astype(np.float16).tobytes()


def _open_rows(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(b) // (8 + 2 * WAYS)
    heat, squares = np.frombuffer(b, np.float32, 2 * n).reshape(2, n).astype(np.float64)
    return np.frombuffer(b, np.float16, offset=8 * n).reshape(n, WAYS).astype(np.float64), heat, squares


def _together(tables: list[bytes]) -> bytes:
    """Changes of several tasks or groups of tasks to the same rows: their mean by heat, the heat,
    and the sum of the tasks' squared heat."""
    total, heat, squares = 0.0, 0.0, 0.0
    for b in tables:
        change, k, q = _open_rows(b)
        total, heat, squares = total + k[:, None] * change, heat + k, squares + q
    return _pack_rows(total / np.maximum(heat, 1e-30)[:, None], heat, squares)


def _changed(w: np.ndarray, b: bytes) -> np.ndarray:
    """Rows after the changes of all tasks: the mean change, times the number of tasks that share a
    row's heat where that is little."""
    change, heat, squares = _open_rows(b)
    tasks = np.maximum(heat * heat / np.maximum(squares, 1e-30), 1)
    return (w + (1 + (tasks - 1) / (1 + _ALONE * heat))[:, None] * np.where(heat > 0, 1, 0)[:, None] * change).astype(np.float32)


def train(docs: DataFrame, params: Params = Params()) -> np.ndarray:
    """The weight table learnt from all given texts. Each pass sends one table of fixed size per
    task to be averaged, by parts of its rows and for groups of tasks first (as many groups as the
    root of the number of tasks), and one table to the driver."""
    p = params
    w = np.zeros((p.rows, WAYS), np.float32)
    src = docs.select(F.col("text").cast("string"), F.spark_partition_id().alias("task"))
    edges = np.linspace(0, p.rows, _PARTS + 1).astype(int)

    for _ in range(p.passes):
        start = w

        def run(batches, start=start):
            own_w, heat, task = None, None, 0
            for batch in batches:
                if own_w is None and batch.num_rows:
                    own_w, heat, task = start.copy(), np.zeros(len(start), np.float32), batch.column(1)[0].as_py()
                buf, off = common.flat_text(batch.column(0))
                for i, j in common.spans(off, 1 << 20):
                    train_pass(own_w, heat, *tokens(buf, off, i, j), p)
            if own_w is not None:
                own_w -= start
                parts = [_pack_rows(own_w[a:b], heat[a:b], heat[a:b] ** 2) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(range(_PARTS), pa.int32()), pa.array([math.isqrt(task)] * _PARTS, pa.int32()), common.binary_array(parts)], names=["part", "salt", "table"])

        def together(t: pa.Table) -> pa.Table:
            return pa.table({"part": t.column("part").slice(0, 1), "table": common.binary_array([_together([x.as_py() for x in t.column("table")])])})

        tables = src.mapInArrow(common.tidy(run), "part int, salt int, table binary")
        for keys in (["part", "salt"], ["part"]):
            tables = tables.groupBy(*keys).applyInArrow(common.tidy_group(together), "part int, table binary")
        w = w.copy()
        for r in tables.collect():  # p.rows in all
            a, b = edges[r.part], edges[r.part + 1]
            w[a:b] = _changed(w[a:b], r.table)
    return w


def blocks(docs: DataFrame, held_out: Column, p: Params) -> DataFrame:
    """(block, ids, held, off, z): documents packed into blocks of about p.block bytes of text."""

    def run(batches):
        part, k, held, size = None, 0, [], 0
        zip_ = zstandard.ZstdCompressor(level=1)

        def out():
            ids = pa.array([x for h in held for x in h[0]], pa.int64())
            out_of = np.concatenate([h[1] for h in held])
            lens = np.concatenate([h[2] for h in held])
            z = zip_.compress(b"".join(h[3] for h in held))
            kinds = pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([(part << 24) + k], pa.int64()), pa.array([ids.to_pylist()], kinds[0]), pa.array([out_of.tolist()], kinds[1]), pa.array([lens.tolist()], kinds[2]), common.binary_array([z])], names=["block", "ids", "held", "lens", "z"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(3)[0].as_py()
            buf, off = common.flat_text(batch.column(1))
            ids, fold = batch.column(0).to_pylist(), np.array(batch.column(2).to_pylist(), bool)
            for i, j in common.spans(off, 1 << 20):
                held.append((ids[i:j], fold[i:j], np.diff(off[i : j + 1]), buf[off[i] : off[j]].tobytes()))
                size += int(off[j] - off[i])
                if size >= p.block:
                    yield out()
                    k, held, size = k + 1, [], 0
        if held:
            yield out()

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held"), F.spark_partition_id().alias("part"))
    return src.mapInArrow(common.tidy(run), "block long, ids array<long>, held array<boolean>, lens array<long>, z binary")


def _open_block(row: dict):
    """(ids, held, token hashes, classes, documents) of one block."""
    text = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["z"]), np.uint8)
    off = np.r_[0, np.cumsum(row["lens"])].astype(np.int64)
    parts = [(i, *tokens(text, off, i, j)) for i, j in common.spans(off, 1 << 20)]
    h, c, own = (np.concatenate([x[k] for x in parts]) for k in (1, 2, 3))
    return row["ids"], np.array(row["held"], bool), h, c, np.concatenate([x[3] + x[0] for x in parts])


def _rows(batch: pa.RecordBatch):
    """The rows of a batch as dicts, one at a time."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def _distinct(h: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct token hashes ordered by shard, and where each shard's begin."""
    u = np.unique(h)
    shard = (u % U64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    return u[order], np.searchsorted(shard[order], np.arange(shards + 1))


def asked(packed: DataFrame, shards: int, p: Params) -> DataFrame:
    """(shard, block, hashes, n, class): each block's distinct tokens for each shard that has some, how
    often they occur in its training texts, and their class by spelling."""

    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                _, held, h, c, own = _open_block(row)
                u, cut = _distinct(h, shards)
                train_h = np.sort(h[~held[own]])
                n = np.searchsorted(train_h, u, "right") - np.searchsorted(train_h, u)
                # a token's class is that of any of its occurrences
                order = np.argsort(h, kind="stable")
                kind = c[order][np.searchsorted(h[order], u)]
                some = [(s, slice(cut[s], cut[s + 1])) for s in np.flatnonzero(np.diff(cut)).tolist()]
                cols = list(zip(*((s, row["block"], u[x].tobytes(), n[x].astype(np.uint32).tobytes(), kind[x].astype(np.uint8).tobytes()) for s, x in some), strict=True))
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=["shard", "block", "hashes", "n", "class"])

    return packed.mapInArrow(common.tidy(run), "shard int, block long, hashes binary, n binary, class binary")


def answered(questions: DataFrame, p: Params) -> DataFrame:
    """(shard, block, n): the counts in all training texts for each question, in its order; with block
    -1 the shard's tokens and distinct tokens by last class."""

    def run(t: pa.Table) -> pa.Table:
        hs = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("hashes")]
        ns = [np.frombuffer(x.as_py(), np.uint32) for x in t.column("n")]
        cs = [np.frombuffer(x.as_py(), np.uint8) for x in t.column("class")]
        u, first, inv = np.unique(np.concatenate(hs), return_index=True, return_inverse=True)
        total = np.bincount(inv, np.concatenate(ns), minlength=len(u)).astype(np.int64)
        kind = leaves(u, np.concatenate(cs)[first])
        at, rows = 0, []
        shard = t.column("shard")[0].as_py()
        for block, h in zip(t.column("block").to_pylist(), hs, strict=True):
            rows.append((shard, block, total[inv[at : at + len(h)]].astype(np.uint32 if total.max(initial=0) < 1 << 32 else np.uint64).tobytes()))
            at += len(h)
        rows.append((shard, -1, np.stack([np.bincount(kind, total, minlength=LEAVES), np.bincount(kind[total > 0], minlength=LEAVES)]).astype(np.int64).tobytes()))
        cols = list(zip(*rows, strict=True))
        return pa.table([pa.array(x, k) for x, k in zip(cols, (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["shard", "block", "n"])

    return questions.groupBy("shard").applyInArrow(common.tidy_group(run), "shard int, block long, n binary")


def leaf_sums(answers: DataFrame) -> np.ndarray:
    """Tokens and distinct tokens by last class, of all shards; they are added in two steps, so that no
    task reads the sums of all shards."""

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in t.column("n"))
        return pa.table({"part": t.column("part").slice(0, 1), "n": common.binary_array([total.tobytes()])})

    own = answers.where("block = -1")
    for part in (F.floor(F.sqrt("shard")), F.lit(0)):
        own = own.select(part.cast("int").alias("part"), "n").groupBy("part").applyInArrow(common.tidy_group(add), "part int, n binary")
    got = own.toArrow().column("n").to_pylist()  # one row
    return np.frombuffer(got[0], np.int64).reshape(2, LEAVES).astype(np.float64) if got else np.zeros((2, LEAVES))


def score(docs: DataFrame, weights: np.ndarray, held_out: Column, params: Params = Params()) -> DataFrame:
    """One row per document with the counts and both scores of its whole text."""
    p = params
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0)).alias("n")).first().n
    shards = max(common.partitions(spark), -(-size // p.shard))
    packed = blocks(docs, held_out, p)
    answers = common.materialize(answered(asked(packed, shards, p), p), "counts")
    class_n, class_v = leaf_sums(answers)
    total, distinct = class_n.sum(), class_v.sum()
    replies = answers.where("block >= 0").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("replies"))
    w = spark.sparkContext.broadcast(weights)  # of fixed size

    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                ids, held, h, c, own = _open_block(row)
                u, cut = _distinct(h, shards)
                counts = np.zeros(len(u), np.int64)
                for reply in row["replies"]:
                    a, b = cut[reply["shard"]], cut[reply["shard"] + 1]
                    counts[a:b] = np.frombuffer(reply["n"], np.uint32 if len(reply["n"]) == 4 * (b - a) else np.uint64)
                order = np.argsort(u)
                n = counts[order][np.searchsorted(u[order], h)]
                size = len(ids)
                base = np.log10((n + p.smooth) / (total + p.smooth * (distinct + 1)))
                leaf = leaves(h, c)
                word = np.log10((n + p.smooth) / (class_n[leaf] + p.smooth * (class_v[leaf] + 1))) + log_paths(w.value, h, c, own, p) / np.log(10)
                cols = (ids, held, np.bincount(own, minlength=size), np.bincount(own[n > 0], minlength=size), np.full(size, int(total)), np.bincount(own, base, minlength=size), np.bincount(own, word, minlength=size))
                kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    joined = packed.join(replies, "block").select("ids", "held", "lens", "z", "replies")
    return joined.mapInArrow(common.tidy(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
