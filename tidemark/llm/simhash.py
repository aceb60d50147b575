"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint of 8 bytes is indexed by its bytes at their positions. Two fingerprints that
differ in at most 3 bits share at least 5 of the 8 positional bytes, so pairs are tallied by
shared bytes, those below 5 are dropped and the rest verified by Hamming distance. To keep
posting lists short, a list is keyed by four bytes at four positions; the 22 position sets
are such that any 5 shared positions contain one of them, so no pair is lost.

`near_groups` finds documents whose sets of word shingles are similar (0.8 by default), which
one fingerprint of 64 bits can't separate: such pairs differ in about 10 bits. There a
fingerprint has a byte for each of 256 positions or more: a shingle's hash picks a position and turns
one bit of its byte, so that sets that differ in d shingles share at least 256 - d positional
bytes and differ in d bits at most. Posting lists are keyed by each set's first shingles in one common
order, rarest first (prefix filtering; similar sets of any size meet in one), since lists
keyed by bytes of so many positions would be no shorter. The shared positional bytes of each
pair of a list are tallied, pairs below the guaranteed minimum drop out, and the rest are
verified on whole sets.

Equal fingerprints are one index entry, however many documents have them. Within a posting
list fingerprints are linked to earlier ones by blocks, and only a spanning forest of the
links leaves the task, so a large group of near copies yields as many rows as members. A very
long list is not compared in pairs: labels are spread over the cube of the bits that vary in it.

Defined cases: null and empty texts have fingerprint zero and link like any other; fewer
words than a shingle are one shingle; equal rows link; a null doc_id is kept and takes part
with its fingerprint, yet never names a component. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import common
from .components import connected

U64 = np.uint64
#: Bytes spread to the eight lanes of a word: lane k of row b is bit k of b.
_LANES = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.uint8)).copy().view(np.uint64).ravel()
_PAIRS = ((0, 1), (2, 3))
_ALL = tuple(combinations(range(4), 2))
#: Position sets of four: all of one half, or two of each half where one pair is a fixed one.
POSITIONS = sorted({(0, 1, 2, 3), (4, 5, 6, 7)} | {(*a, *(4 + x for x in b)) for a in _ALL for b in _ALL if a in _PAIRS or b in _PAIRS})


def shingle_hashes(text: bytes, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of `width` words, repeats included; A-Z in lower case."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) <= width:
        return np.array([xxh64_intdigest(b" ".join(w), seed)], np.uint64)
    line = b" ".join(w)
    lens = np.fromiter(map(len, w), np.int64, len(w)) + 1
    ends = np.cumsum(lens)
    starts = (ends - lens)[: len(w) - width + 1].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    return np.fromiter((xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))


def bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many hashes of each run (beginning at `starts`) have each of the 64 bits."""
    lanes = _LANES[hashes.view(np.uint8).reshape(-1, 8)]  # n x 8 words of 8 byte lanes
    out = np.zeros((len(starts), 64), np.int64)
    ends = np.r_[starts[1:], len(hashes)]
    for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        for c in range(a, b, 255):  # a byte lane holds 255 at most
            out[k] += lanes[c : min(b, c + 255)].sum(0, dtype=np.uint64).view(np.uint8)
    return out


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; none give zero."""
    if not len(hashes):
        return 0
    bits = 2 * bit_counts(hashes, np.zeros(1, np.int64))[0] > len(hashes)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""

    def run(batches):
        for batch in batches:
            buf, off = common.flat_text(batch.column(1))
            fp = np.fromiter((fingerprint(shingle_hashes(buf[off[k] : off[k + 1]].tobytes(), width)) for k in range(batch.num_rows)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(common.tidy(run), "doc_id long, fp long")


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """How many of the 8 bytes of each exclusive or are zero: shared positional bytes of a pair."""
    y = x | (x >> U64(4))
    y |= y >> U64(2)
    y |= y >> U64(1)
    return 8 - popcount(y & U64(0x0101010101010101))


#: Fingerprints of a list that are compared in pairs at most; a longer one shares five bytes, so that at
#: most 24 bits vary in it.
_PAIRWISE = 2048


def _cube_labels(fps: np.ndarray, radius: int) -> np.ndarray:
    """The smallest row that links reach from each row: labels spread over the cube of the varying
    bits by `radius` steps along every axis, and again until none changes. Its time and memory
    depend on the number of bits only, not on the square of the rows."""
    mixed = fps ^ fps[0]
    vary = np.flatnonzero([(mixed >> U64(b) & U64(1)).any() for b in range(64)])
    place = np.zeros(len(fps), np.int64)
    for k, b in enumerate(vary.tolist()):
        place |= (fps >> U64(b) & U64(1)).astype(np.int64) << k
    none = np.int32(np.iinfo(np.int32).max)
    label = np.arange(len(fps), dtype=np.int32)
    while True:
        cube = np.full(1 << len(vary), none, np.int32)
        np.minimum.at(cube, place, label)
        for _ in range(radius):
            low = cube.copy()
            for k in range(len(vary)):
                a, b = cube.reshape(-1, 2, 1 << k), low.reshape(-1, 2, 1 << k)
                np.minimum(b, a[:, ::-1], out=b)
            cube = low
        low = cube[place]
        low = low[low]
        if (low == label).all():
            return label.astype(np.int64)
        label = low


def _pair_labels(fps: np.ndarray, radius: int, block: int) -> np.ndarray:
    """The smallest row that links reach from each row, by all pairs: the tally of shared bytes
    keeps a pair, then its distance is taken."""
    n = len(fps)
    label, changed = np.arange(n), True
    links = []
    for i in range(0, n, block):
        for j in range(0, i + block, block):
            x = fps[i : i + block, None] ^ fps[None, j : j + block]
            r, c = np.nonzero(shared_bytes(x) >= 8 - radius)
            near = popcount(x[r, c]) <= radius
            links.append(np.stack([r[near] + i, c[near] + j]))
    a, b = np.concatenate(links, axis=1)
    while changed:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        changed = bool((low != label).any())
        label = low
    return label


def _link(fps: np.ndarray, radius: int, used: tuple[int, ...], block: int = 512, pairwise: int = _PAIRWISE) -> list[tuple[int, int]]:
    """Links within one posting list, whose fingerprints share the bytes at the positions `used`: a
    spanning forest of the pairs within the radius.

    A long list is first cut by one more shared byte, which every wanted pair has."""
    n = len(fps)
    if n > pairwise and len(used) == 4:
        out = []
        b = fps.view(np.uint8).reshape(-1, 8)
        for pos in set(range(8)) - set(used):
            order = np.argsort(b[:, pos], kind="stable")
            cuts = np.flatnonzero(np.diff(b[order, pos])) + 1
            for part in np.split(order, cuts):
                if len(part) > 1:
                    out += _link(fps[part], radius, (*used, pos), block, pairwise)
        return out
    label = _cube_labels(fps, radius) if n > pairwise else _pair_labels(fps, radius, block)
    return [(int(fps[k]), int(fps[label[k]])) for k in np.flatnonzero(label != np.arange(n)).tolist()]


def fingerprint_links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): links between different fingerprints (column fp) that connect exactly what the
    pairs within the radius connect."""
    if radius > 3:
        raise ValueError("four shared bytes are guaranteed up to a radius of 3 only")
    byte = [F.shiftrightunsigned("fp", 8 * k).bitwiseAND(255) for k in range(8)]
    keys = []
    for s, pos in enumerate(POSITIONS):
        key = F.lit(s).cast("long") * (1 << 32)
        for k, p in enumerate(pos):
            key = key + byte[p] * (1 << 8 * k)
        keys.append(key)
    posting = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))

    def run(batches):
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def links(key, fp):
            cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[cut, len(key)])
            rows = []
            for a, n in zip(cut[size > 1].tolist(), size[size > 1].tolist(), strict=True):
                rows += _link(fp[a : a + n].copy(), radius, POSITIONS[int(key[a]) >> 32])
            v = np.array(rows, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(v[:, 0]), pa.array(v[:, 1])], names=["a", "b"])

        for batch in batches:
            key = np.r_[held_k, batch.column(0).to_numpy()]
            fp = np.r_[held_f, batch.column(1).to_numpy().view(np.uint64)]
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last list may go on
            if last:
                yield links(key[:last], fp[:last])
            held_k, held_f = key[last:], fp[last:]
        if len(held_k):
            yield links(held_k, held_f)

    parts = posting.repartition(common.partitions(distinct.sparkSession), "key").sortWithinPartitions("key").select("key", "fp")
    return parts.mapInArrow(common.tidy(run), "a long, b long").distinct()


def simhash_components(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document: its fingerprint in hex and the
    smallest doc_id that links reach. The result is a table of the shared folder."""
    with common.scratch(docs.sparkSession) as keep:
        fps = common.materialize(fingerprints(docs, width), "fingerprints")
        distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
        comp = connected(fingerprint_links(distinct.select("fp"), radius))
        # components are named by fingerprints until here; now by their smallest document
        named = distinct.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
        smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
        by_fp = named.join(smallest, "component").select("fp", "component_id")
        return keep(fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"), "components")


@dataclass(frozen=True)
class NearParams:
    width: int = 5
    similarity: float = 0.8
    heavy: int = 1 << 17  # shingles at most that are known to be common and indexed last
    heavy_count: int = 32  # documents at least that hold a common shingle


#: Positions of a set's fingerprint; those of a large set are a power of two from a quarter of its size.
_POSITIONS = 256
#: Shingle hashes counted at once to find common ones, and the count there from which it is passed on.
_COUNTED, _SEVERAL = 2_000_000, 3
#: Members of a posting list up to which all of its pairs are tallied at once, not many more than
#: members; longer lists are linked by two partners a member first.
_SHORT = 4
_STEP = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9))


def _at_least(x):
    """The smallest whole number not below x, up to rounding."""
    return np.ceil(x - 1e-9).astype(np.int64)


def word_shingles(column: pa.Array, width: int, limit: int = 1 << 19):
    """For each text its distinct shingle hashes, sorted. Fewer words than a shingle are one
    shingle, no words none. Words are hashed, and shingles from the hashes of their words."""
    buf, off = common.flat_text(column)
    for i, j in common.spans(off, limit):
        text, starts, _ = common.padded(buf, off, i, j, 1, 32)
        text = common.LOWER[text]
        s, e = common.words_of(text)
        h = common.Hasher(text)(s, e)
        own = np.searchsorted(starts, s, "right") - 1
        first = np.searchsorted(own, np.arange(j - i + 1)).tolist()
        m = max(0, len(h) - width + 1)
        g = np.full(m, U64(width), np.uint64)
        for k in range(width):
            g = (g ^ h[k : k + m]) * _STEP[k % 3]
            g ^= g >> U64(29)
        g = common.mix(g)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= width:
                yield np.unique(g[a : b - width + 1])
            else:
                x = np.full(min(1, b - a), U64(b - a), np.uint64)
                for k in range(a, b):
                    x = (x ^ h[k]) * _STEP[(k - a) % 3]
                    x ^= x >> U64(29)
                yield common.mix(x)


def positional_bytes(hashes: np.ndarray, positions: int = _POSITIONS) -> np.ndarray:
    """The fingerprint of a set: each hash picks a position and turns one bit of its byte."""
    out = np.zeros(positions, np.uint8)
    np.bitwise_xor.at(out, (hashes & U64(positions - 1)).astype(np.int64), (U64(1) << (hashes >> U64(61))).astype(np.uint8))
    return out


def long_bytes(hashes: np.ndarray) -> bytes | None:
    """The longer fingerprint of a large set, or None."""
    positions = 1 << (-(-len(hashes) // 4) - 1).bit_length() if len(hashes) else 1
    return positional_bytes(hashes, positions).tobytes() if positions > _POSITIONS else None


def folded(marks: np.ndarray, positions: int) -> np.ndarray:
    """A fingerprint as it would be with fewer positions."""
    return np.bitwise_xor.reduce(marks.reshape(-1, positions), axis=0)


def set_name(hashes: np.ndarray) -> int:
    """A signed 64-bit hash of the whole set."""
    return int(np.bitwise_xor.reduce(common.mix(hashes.copy()), initial=U64(len(hashes))).view(np.int64))


def prefix_keys(hashes: np.ndarray, heavy: np.ndarray, p: NearParams) -> np.ndarray:
    """Index keys of a set of shingle hashes (sorted, distinct). All sets are put in one order,
    common shingles (sorted, in `heavy`) last; two sets of the wanted similarity share at least
    one of their first n - ceil(similarity * n) + 1. Which ones count as common decides the
    length of the lists only."""
    n = len(hashes)
    last = np.isin(hashes, heavy, assume_unique=True)
    return np.concatenate([hashes[~last], hashes[last]])[: n - _at_least(p.similarity * n) + 1] if n else hashes


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")


def sketches(docs: DataFrame, p: NearParams) -> DataFrame:
    """(doc_id, node, n, bytes, long): of each document's set of shingles its name, size and positional
    bytes, of a large one with more positions too. Rows without a doc_id are of shingles that several documents of a task hold: node is
    the shingle, n their number."""

    def counted(seen):
        h, n = np.unique(np.concatenate(seen), return_counts=True)
        h, n = h[n >= _SEVERAL], n[n >= _SEVERAL]
        return pa.RecordBatch.from_arrays([pa.nulls(len(h), pa.int64()), pa.array(h.view(np.int64)), pa.array(n), pa.nulls(len(h), pa.binary()), pa.nulls(len(h), pa.binary())], names=["doc_id", "node", "n", "bytes", "long"])

    def run(batches):
        seen, held = [np.zeros(0, np.uint64)], 0
        for batch in batches:
            found, sizes, marks, more = [], [], [], []
            for h in word_shingles(batch.column(1), p.width):
                found.append(set_name(h))
                sizes.append(len(h))
                marks.append(positional_bytes(h).tobytes())
                more.append(long_bytes(h))
                seen.append(h)
                held += len(h)
                if held > _COUNTED:
                    yield counted(seen)
                    seen, held = [np.zeros(0, np.uint64)], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64()), pa.array(sizes, pa.int64()), common.binary_array(marks), common.binary_array(more)], names=["doc_id", "node", "n", "bytes", "long"])
        yield counted(seen)

    return _source(docs).mapInArrow(common.tidy(run), "doc_id long, node long, n long, bytes binary, long binary")


def _heavy(rows: DataFrame, p: NearParams) -> np.ndarray:
    """The most common shingles, sorted; at most p.heavy of them."""
    total = rows.where("doc_id is null").groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") >= p.heavy_count)
    return np.sort(total.orderBy(F.desc("n"), "node").limit(p.heavy).select("node").toArrow().column(0).to_numpy().view(np.uint64))


#: Names of sets that a task remembers, so that it posts the copies of a large group once.
_REMEMBERED = 1 << 18


def postings(docs: DataFrame, heavy: np.ndarray, p: NearParams) -> DataFrame:
    """(key, node): the index keys of each set; equal sets of one task are posted once."""

    def run(batches):
        known: set[int] = set()
        for batch in batches:
            keys, nodes, sizes = [np.zeros(0, np.uint64)], [], []
            for h in word_shingles(batch.column(1), p.width):
                node = set_name(h)
                if node not in known:
                    if len(known) >= _REMEMBERED:
                        known.clear()
                    known.add(node)
                    keys.append(prefix_keys(h, heavy, p))
                    nodes.append(node)
                    sizes.append(len(keys[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), np.array(sizes, np.int64)))], names=["key", "node"])

    return _source(docs).mapInArrow(common.tidy(run), "key long, node long")


class ListPairs:
    """Turns posting lists (rows ordered by key and node, in batches of any size) into rows
    (key, a, b). Without a key they are pairs a > b: all of a short list; of a longer one each
    member with the list's first and with the member before it, and then a row (key, a) for each
    member too, since its other pairs are still open. What is held is bounded."""

    def __init__(self, short: int = _SHORT):
        self.short = short
        self.key, self.node, self.begun = np.zeros(0, np.int64), np.zeros(0, np.int64), False
        self.pairs: list[np.ndarray] = []
        self.members: list[np.ndarray] = []
        self.size = 0

    def _emit(self, x: np.ndarray, y: np.ndarray):
        self.pairs.append(np.stack([np.maximum(x, y), np.minimum(x, y)], 1))
        self.size += len(x)

    def _long(self, key: np.ndarray, node: np.ndarray, carried: int):
        at = np.arange(max(1, carried), len(node))
        self._emit(node[at], np.full(len(at), node[0]))
        other = node[at - 1] != node[0]
        self._emit(node[at][other], node[at - 1][other])
        self.members.append(np.stack([key[carried:], node[carried:]], 1))
        self.size += len(node)

    def add(self, key: np.ndarray, node: np.ndarray):
        key, node, carried = np.r_[self.key, key], np.r_[self.node, node], len(self.key) if self.begun else 0
        new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]  # rows of equal sets are one member
        key, node = key[new], node[new]
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[cut, len(key)])
        self._lists(key, node, cut[:-1], size[:-1], carried)
        a, begun = cut[-1], self.begun and len(cut) == 1
        if begun or size[-1] > self.short:
            self._long(key[a:], node[a:], carried if begun else 0)
            key, node, a, begun = key[[a, -1]], node[[a, -1]], 0, True
        self.key, self.node, self.begun = key[a:], node[a:], begun

    def _lists(self, key, node, cut, size, carried):
        for s in np.unique(size[size > 1]).tolist():
            at = cut[size == s]
            if carried and len(at) and at[0] == 0:  # a long list that ends here
                self._long(key[:s], node[:s], carried)
                at = at[1:]
            if s > self.short:
                for a in at.tolist():
                    self._long(key[a : a + s], node[a : a + s], 0)
            else:
                x, y = np.triu_indices(s, 1)
                rows = max(1, 1_000_000 // len(x))
                for k in range(0, len(at), rows):
                    m = node[at[k : k + rows, None] + np.arange(s)]
                    self._emit(m[:, x].ravel(), m[:, y].ravel())
                    if self.size > 4_000_000:
                        self._shrink()

    def _shrink(self):
        v = np.concatenate(self.pairs)
        v = v[np.lexsort((v[:, 1], v[:, 0]))]
        v = v[np.r_[True, (v[1:] != v[:-1]).any(1)]] if len(v) else v
        self.pairs, self.size = [v], len(v) + sum(map(len, self.members))

    def take(self) -> pa.RecordBatch:
        """The rows so far; equal pairs of several lists are one."""
        if self.pairs:
            self._shrink()
        v = self.pairs[0] if self.pairs else np.zeros((0, 2), np.int64)
        m = np.concatenate(self.members) if self.members else np.zeros((0, 2), np.int64)
        self.pairs, self.members, self.size = [], [], 0
        key = pa.concat_arrays([pa.nulls(len(v), pa.int64()), pa.array(m[:, 0])])
        a = pa.array(np.r_[v[:, 0], m[:, 1]])
        return pa.RecordBatch.from_arrays([key, a, pa.concat_arrays([pa.array(v[:, 1]), pa.nulls(len(m), pa.int64())])], names=["key", "a", "b"])

    def end(self):
        if len(self.key) and not self.begun:
            self._lists(self.key, self.node, np.zeros(1, np.int64), np.array([len(self.key)]), 0)
        self.key, self.node, self.begun = self.key[:0], self.node[:0], False


def list_pairs(posted: DataFrame) -> DataFrame:
    """(key, a, b): see ListPairs."""

    def run(batches):
        lists = ListPairs()
        for batch in batches:
            if batch.num_rows:
                lists.add(batch.column(0).to_numpy(), batch.column(1).to_numpy())
                if lists.size > 500_000:
                    lists._shrink()
                    if lists.size > 400_000:
                        yield lists.take()
        lists.end()
        yield lists.take()

    dealt = posted.repartition(common.partitions(posted.sparkSession), "key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(common.tidy(run), "key long, a long, b long")


def _spare(na: np.ndarray, nb: np.ndarray, p: NearParams) -> np.ndarray:
    """How many elements similar sets of these sizes have at most that are in one of them only;
    negative if they can't be similar."""
    spare = na + nb - 2 * _at_least(p.similarity / (1 + p.similarity) * (na + nb))
    return np.where(np.abs(na - nb) <= spare, spare, -1)


def _near(x: np.ndarray, y: np.ndarray, na: np.ndarray, nb: np.ndarray, p: NearParams) -> tuple[np.ndarray, np.ndarray]:
    """The tally of shared positional bytes of pairs of fingerprints, and whether it reaches the
    minimum that similar sets of these sizes have for certain, and their bits too."""
    mixed = x ^ y
    shared = (mixed == 0).sum(-1, dtype=np.int64)
    spare = _spare(na, nb, p)
    return shared, (spare >= 0) & (shared >= x.shape[-1] - spare) & (popcount(mixed).sum(-1, dtype=np.int64) <= spare)


def _byte_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), _POSITIONS)


def _beside(pairs: DataFrame, known: DataFrame, *cols: str) -> DataFrame:
    """Pairs (a, b) with these columns of both."""
    for x in "ab":
        pairs = pairs.join(known.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in cols)), x)
    return pairs.select("a", "b", *(f"{c}_{x}" for c in cols for x in "ab"))


def tallied(pairs: DataFrame, known: DataFrame, p: NearParams) -> DataFrame:
    """(a, b, shared): pairs whose tally of shared positional bytes reaches the guaranteed minimum.
    Pairs that their sizes rule out don't meet the bytes."""

    def run(batches):
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            shared, ok = _near(_byte_rows(batch.column(4)), _byte_rows(batch.column(5)), na, nb, p)
            large = ok & batch.column(6).is_valid().to_numpy(zero_copy_only=False) & batch.column(7).is_valid().to_numpy(zero_copy_only=False)
            for k in np.flatnonzero(large).tolist():
                x, y = (np.frombuffer(batch.column(c)[k].as_py(), np.uint8) for c in (6, 7))
                n = min(len(x), len(y))
                ok[k] = _near(folded(x, n), folded(y, n), na[k], nb[k], p)[1]
            ok = pa.array(ok)
            yield pa.RecordBatch.from_arrays([x.filter(ok) for x in (batch.column(0), batch.column(1), pa.array(shared))], names=["a", "b", "shared"])

    share = p.similarity / (1 + p.similarity)
    sized = _beside(pairs, known, "n").where(f"abs(n_a - n_b) <= n_a + n_b - 2 * ceil({share!r}D * (n_a + n_b) - 1e-9D)").select("a", "b")
    return _beside(sized, known, "n", "bytes", "long").mapInArrow(common.tidy(run), "a long, b long, shared long")


def _cross(node: np.ndarray, comp: np.ndarray, size: np.ndarray, marks: np.ndarray, nearest: bool, p: NearParams, block: int = 128):
    """(a, b) of the pairs of one posting list that are in different components and share enough
    positional bytes. `nearest`: only the likeliest partner of each member outside of the largest
    component."""
    kinds, n = np.unique(comp, return_counts=True)
    minor = np.flatnonzero(comp != kinds[n.argmax()])
    for i in range(0, len(minor), block):
        x = minor[i : i + block]
        best, who = np.full(len(x), -1), np.zeros(len(x), np.int64)
        for j in range(0, len(node), block):
            y = np.arange(j, min(j + block, len(node)))
            shared, ok = _near(marks[x][:, None], marks[y][None], size[x][:, None], size[y][None], p)
            ok &= comp[x][:, None] != comp[y][None]
            if nearest:
                shared = np.where(ok, shared, -1)
                k = shared.argmax(1)
                top = shared[np.arange(len(x)), k]
                who, best = np.where(top > best, y[k], who), np.maximum(best, top)
            else:
                r, c = np.nonzero(ok)
                yield np.stack([node[x[r]], node[y[c]]], 1)
        if nearest:
            yield np.stack([node[x], node[who]], 1)[best >= 0]


def _over(x: np.ndarray, total: np.ndarray, p: NearParams) -> np.ndarray:
    """Whether so many shared elements make sets of that total size similar."""
    return _at_least(p.similarity / (1 + p.similarity) * total) <= x


def _through_parts(node: np.ndarray, comp: np.ndarray, size: np.ndarray, marks: np.ndarray, part: np.ndarray, common: np.ndarray, nearest: bool, p: NearParams, block: int = 128):
    """(a, b) for a list whose key is a common shingle, where members differ in
    component. Members have all of their other shingles in lists of their own, so what is
    left are pairs that share common shingles only. Members with one common part (`part`, of `common`
    shingles) are similar by their sizes alone, and then to the smallest of them too; of two parts the
    smallest are compared, and what is too large for the smallest of its own part is compared with
    smaller ones of others. So a header that all members have costs one pass over them."""
    order = np.lexsort((node, size, part))
    node, comp, size, marks, part, common = (x[order] for x in (node, comp, size, marks, part, common))
    first = np.r_[True, part[1:] != part[:-1]]
    reps = np.flatnonzero(first)
    own = reps[np.cumsum(first) - 1]
    linked = _over(common, size + size[own], p)
    star = linked & (comp != comp[own])
    yield np.stack([node[star], node[own[star]]], 1)
    if len(reps) > 1:
        yield from _cross(node[reps], comp[reps], size[reps], marks[reps], nearest, p, block)
    y = reps[np.argsort(size[reps], kind="stable")]
    least = size[y[0]]
    x = np.flatnonzero(~linked & ~first & (size[own] > least) & _over(common, size + least, p))
    for i in range(0, len(x), block):
        a = x[i : i + block]
        for j in range(0, len(y), block):
            b = y[j : j + block]
            if size[b[0]] >= size[own[a]].max():
                break
            ok = (size[b][None] < size[own[a]][:, None]) & (comp[a][:, None] != comp[b][None]) & _over(np.minimum(common[a][:, None], common[b][None]), size[a][:, None] + size[b][None], p)
            r, c = np.nonzero(ok)
            near = _near(marks[a[r]], marks[b[c]], size[a[r]], size[b[c]], p)[1]
            yield np.stack([node[a[r[near]]], node[b[c[near]]]], 1)


def common_parts(docs: DataFrame, heavy: np.ndarray, p: NearParams) -> DataFrame:
    """(node, part, common) of sets that consist of common shingles as far as a similar set has to share: the
    name and size of the part that is common. Only these are in lists of common shingles."""

    def run(batches):
        known: set[int] = set()
        for batch in batches:
            rows = []
            for h in word_shingles(batch.column(1), p.width):
                mine = h[np.isin(h, heavy, assume_unique=True)]
                if len(mine) and len(mine) >= _at_least(p.similarity * len(h)) and (node := set_name(h)) not in known:
                    if len(known) >= _REMEMBERED:
                        known.clear()
                    known.add(node)
                    rows.append((node, set_name(mine), len(mine)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["node", "part", "common"])

    return _source(docs).mapInArrow(common.tidy(run), "node long, part long, common long").dropDuplicates(["node"])


def _whole_lists(batches):
    """The columns of each posting list (key, node, component, n, bytes, part, common) of batches sorted by
    key; common is 0 without a part."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in range(4)]
        cols.append(_byte_rows(batch.column(4)))
        cols += [batch.column(k).fill_null(0).to_numpy() for k in (5, 6)]
        if held and held[0][0][0] == cols[0][-1]:
            held.append(cols)
            continue
        cols = [np.concatenate(c) for c in zip(*held, cols, strict=True)]
        cut = np.r_[0, np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1]
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            yield [c[a:b] for c in cols]
        held = [[c[cut[-1] :] for c in cols]]
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _placed(rows: DataFrame, comp: DataFrame, col: str, name: str) -> DataFrame:
    """Rows with the component of the node in a column, by default the node itself."""
    found = comp.select(F.col("node").alias(col), F.col("component").alias(name))
    return rows.join(found, col, "left").withColumn(name, F.coalesce(name, col))


def _across(members: DataFrame, comp: DataFrame, known: DataFrame, parts: DataFrame, heavy: np.ndarray, nearest: bool, p: NearParams) -> DataFrame:
    """(a, b) of members of one long posting list whose components differ: see _through_parts() where the
    list's key is a common shingle, else _cross()."""
    placed = _placed(members, comp, "node", "component")
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")

    def run(batches):
        rows, n = [np.zeros((0, 2), np.int64)], 0

        def out():
            v = np.unique(np.concatenate(rows), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(v.max(1, initial=-(1 << 63))), pa.array(v.min(1, initial=(1 << 63) - 1))], names=["a", "b"])

        for key, *cols, part, shared in _whole_lists(batches):
            k = np.searchsorted(heavy, key[:1].view(np.uint64))[0]
            is_common = k < len(heavy) and heavy[k] == key[:1].view(np.uint64)[0] and shared.all()
            for v in _through_parts(*cols, part, shared, nearest, p) if is_common else _cross(*cols, nearest, p):
                rows.append(v)
                n += len(v)
                if n > 200_000:
                    yield out()
                    rows, n = [np.zeros((0, 2), np.int64)], 0
        yield out()

    dealt = placed.join(mixed, "key", "left_semi").join(known, "node").join(parts, "node", "left").repartition(common.partitions(members.sparkSession), "key").sortWithinPartitions("key", "node")
    return dealt.select("key", "node", "component", "n", "bytes", "part", "common").mapInArrow(common.tidy(run), "a long, b long").where("a <> b").distinct()


def _similar(a: np.ndarray, b: np.ndarray, p: NearParams) -> bool:
    """Whether two whole sets (sorted) are similar."""
    na, nb = len(a), len(b)
    if min(na, nb) < _at_least(p.similarity * max(na, nb)):
        return False
    both = np.sort(np.concatenate([a, b]), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return bool(shared >= _at_least(p.similarity * (na + nb - shared)))


def _pack_set(hashes: np.ndarray) -> bytes:
    """The upper 48 bits of each hash, which keep the order."""
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack_set(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(">u8").ravel().astype(np.uint64)


def shingle_sets(docs: DataFrame, p: NearParams) -> DataFrame:
    """(node, shingles): the whole set of each document, 48 bits a shingle."""

    def run(batches):
        for batch in batches:
            found = [(set_name(h), _pack_set(h)) for h in word_shingles(batch.column(1), p.width)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), common.binary_array([x[1] for x in found])], names=["node", "shingles"])

    return _source(docs).mapInArrow(common.tidy(run), "node long, shingles binary")


def verified(pairs: DataFrame, known: DataFrame, docs: DataFrame, p: NearParams) -> DataFrame:
    """Those pairs (a, b) whose whole sets are similar. Sets are made of one document for each node
    in a pair, and written once."""

    def run(batches):
        for batch in batches:
            keep = [_similar(_unpack_set(x.as_py()), _unpack_set(y.as_py()), p) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            ok = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = common.materialize(known.join(nodes, "node").select(F.col("first").alias("doc_id")).distinct(), "wanted")
    sets = common.materialize(shingle_sets(docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi"), p), "sets")
    # the rows of a repeated doc_id may give a node twice, hence distinct
    links = common.materialize(_beside(pairs, sets, "shingles").mapInArrow(common.tidy(run), "a long, b long").distinct(), "links")
    common.forget(sets)
    common.forget(wanted)
    common.release(docs.sparkSession)  # sets are the largest rows that are shuffled here
    return links


def near_groups(docs: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """(doc_id, component_id) of every row with a non-null id; similar documents and those linked
    through them share a component, named by its smallest doc_id. Rows that repeat a doc_id with
    another text are placed each. The result is a table of the shared folder."""
    p = params
    with common.scratch(docs.sparkSession) as keep:
        rows = common.materialize(sketches(docs, p), "sketches")
        placed = rows.where("doc_id is not null")
        known = common.materialize(placed.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("bytes").alias("bytes"), F.first("long").alias("long")), "nodes")
        heavy = _heavy(rows, p)
        lists = common.materialize(list_pairs(postings(docs, heavy, p)), "lists")
        parts = common.materialize(common_parts(docs, heavy, p), "parts")
        members = lists.where("key is not null").select("key", F.col("a").alias("node"))
        marked = known.select("node", "n", "bytes")
        found = common.materialize(tallied(lists.where("key is null").select("a", "b").distinct(), known, p), "candidates")
        # the likeliest partner of each set links most of a large group
        best = found.groupBy("a").agg(F.max_by("b", F.struct("shared", F.xxhash64("a", "b"))).alias("b"))
        links = verified(best, known, docs, p)
        comp = common.materialize(connected(links), "joined")
        tried = common.materialize(best, "tried")
        for nearest in (True, False):
            # pairs whose ends are still apart: first with the nearest of each long list, then all
            apart = _placed(_placed(found.select("a", "b"), comp, "a", "ca"), comp, "b", "cb").where("ca <> cb").select("a", "b")
            across = _across(members, comp, marked, parts, heavy, nearest, p).join(tried.union(found.select("a", "b")), ["a", "b"], "left_anti")
            more = apart.union(tallied(across, known, p).select("a", "b")).join(tried, ["a", "b"], "left_anti")
            more = common.materialize(more.select("a", "b"), "more")
            if more.isEmpty():
                continue
            new = verified(more, known, docs, p)
            tried = tried.union(more)
            if not new.isEmpty():
                links = links.union(new)
                comp = common.materialize(connected(links), "joined")
        by_node = _placed(known.select("node", "first"), comp, "node", "component")
        smallest = by_node.groupBy("component").agg(F.min("first").alias("component_id"))
        by_node = by_node.join(smallest, "component").select("node", "component_id")
        return keep(placed.select("doc_id", "node").join(by_node, "node").select("doc_id", "component_id"), "groups")
