"""Importance resampling towards a target distribution of hashed n-gram features.

Each chunk of a partition gets a suffix array over word ids, sorted as deep as the longest n-gram. In it
equal n-grams are neighbours: a run whose common prefixes (LCP) are at least n words long is one
n-gram with all its occurrences. A run is hashed once, from the words' own checksums, and its bucket
is scattered back to the occurrences. A first pass counts buckets over all documents and over the target;
a bucket's gain is a floored scaled log ratio of both; a second pass averages the gains of each
document's features. Scores add seeded Gumbel noise, and the highest are drawn, so that a document is
drawn with odds that follow its weight.

What tasks send is a row for each bucket and task, then a row for each document. The gains are a table of
fixed size (`Params.buckets`). Ranks come from sorted ranges and their sizes, not from one task.

Defined cases: a null text has no words; without words there are no features and the weight is 0, as are
all gains where both tables are empty; a null doc_id is '' in the hash and stands last in ties; rows that
repeat a doc_id are rows of their own, whose ties stand by n_features and weight; documents of fewer than
`min_words` words are never drawn. Long texts are cut into blocks of words that overlap by one word
less than the longest n-gram, which changes no count. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ordering
from . import common


@dataclass(frozen=True)
class Params:
    buckets: int = 10_000
    max_n: int = 2
    min_words: int = 20
    percent: int = 25
    scale: int = 1000
    seed: int = 7


#: Bytes of text and words that are sorted together.
CHUNK, BLOCK = 4 << 20, 1 << 20
#: Digits, small letters and all bytes from 128 up make words, once A-Z are lower-cased.
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True


def words_in(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all words of documents buf[off[k]:off[k + 1]] one after another, the words'
    ends in them with a 0 before, and the document of each word; words end with their document."""
    low = common.LOWER[buf[off[0] : off[-1]]]
    cut = off - off[0]
    word = IN_WORD[low]
    before = np.zeros(len(low), bool)
    before[1:] = word[:-1]
    before[cut[:-1][cut[:-1] < len(low)]] = False
    starts = np.flatnonzero(word & ~before)
    after = np.zeros(len(low), bool)
    after[:-1] = word[1:]
    after[cut[1:][cut[1:] > 0] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    edges = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=edges[1:])
    return low[word], edges, np.searchsorted(cut, starts, "right") - 1, starts


def _byte_step() -> np.ndarray:
    """The table of one byte of CRC-32, from its polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


class Append:
    """Checksums of a text and more bytes from the checksums of both: the first one passes as many zero
    bytes as are appended, which is linear; tables for 1, 2, 4, ... bytes are composed."""

    def __init__(self):
        byte = _byte_step()
        place = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
        self.tables = [np.stack([byte[p & np.uint32(255)] ^ (p >> np.uint32(8)) for p in place])]

    def _zeros(self, crc: np.ndarray, power: int) -> np.ndarray:
        while len(self.tables) <= power:
            self.tables.append(np.stack([self._through(row, len(self.tables) - 1) for row in self.tables[-1]]))
        return self._through(crc, power)

    def _through(self, crc: np.ndarray, power: int) -> np.ndarray:
        t = self.tables[power]
        return t[0][crc & 255] ^ t[1][crc >> 8 & 255] ^ t[2][crc >> 16 & 255] ^ t[3][crc >> 24]

    def __call__(self, crc: np.ndarray, more: np.ndarray, length: np.ndarray) -> np.ndarray:
        crc, power, left = crc.copy(), 0, length.copy()
        while left.any():
            odd = np.flatnonzero(left & 1)
            crc[odd] = self._zeros(crc[odd], power)
            left >>= 1
            power += 1
        return crc ^ more


def suffix_array(seq: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a sequence of ids from 0 ordered by the first `depth` ids from there (past the end:
    0), and how many of them each shares with the one before, `depth` at most."""
    ranks, wide = [seq.astype(np.int64)], int(seq.max(initial=0)) + 1
    order = np.argsort(ranks[0], kind="stable") if depth == 1 else None
    for d in range(1, depth):
        ahead = np.zeros(len(seq), np.int64)
        ahead[: len(seq) - d] = seq[d:]
        key = ranks[-1] * wide + ahead
        order = np.argsort(key, kind="stable")
        rank = np.zeros(len(seq), np.int64)
        rank[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        ranks.append(rank)
    shared = np.zeros(len(seq), np.int64)
    for r in ranks:
        shared[1:] += r[order[1:]] == r[order[:-1]]
    return order, shared


def features(buf: np.ndarray, off: np.ndarray, params: Params) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of words: the documents and buckets of all occurrences of n-grams of 1 to max_n words,
    and the documents of the words."""
    append, n = Append(), params.max_n
    for i, j in common.spans(off, CHUNK):
        data, edges, docs, _ = words_in(buf, off[i : j + 1])
        for a in range(0, len(docs), BLOCK):
            b, tail = min(len(docs), a + BLOCK), min(len(docs), a + BLOCK + n - 1)
            part = edges[a : tail + 1]
            own = pa.Array.from_buffers(pa.large_binary(), tail - a, [None, pa.py_buffer(part - part[0]), pa.py_buffer(data[part[0] : part[-1]])]).dictionary_encode()
            ids, different = own.indices.to_numpy(), own.dictionary.to_pylist()
            alone = np.array([zlib.crc32(w) for w in different], np.uint32)
            spaced = np.array([zlib.crc32(b" " + w) for w in different], np.uint32)
            length = np.array([len(w) + 1 for w in different], np.int64)
            doc = docs[a:tail]
            at = np.arange(tail - a) + np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])])  # a 0 stands between documents
            seq = np.zeros(at[-1] + 2, np.int64)
            seq[at] = ids + 1
            order, shared = suffix_array(seq, n)
            word_at = np.zeros(len(seq), np.int64)
            word_at[at] = np.arange(tail - a)
            owner, where = [], []
            for k in range(1, n + 1):
                head = np.flatnonzero(shared < k)
                run = np.cumsum(shared < k) - 1
                first = order[head]
                whole = np.ones(len(head), bool)  # no end of a document within the n-gram
                for d in range(k):
                    whole &= seq[np.minimum(first + d, len(seq) - 1)] > 0
                crc = np.zeros(len(head), np.uint32)
                crc[whole] = alone[seq[first[whole]] - 1]
                for d in range(1, k):
                    nxt = seq[first[whole] + d] - 1
                    crc[whole] = append(crc[whole], spaced[nxt], length[nxt])
                bucket = (crc % np.uint32(params.buckets)).astype(np.int64)
                use = whole[run] & (word_at[order] < b - a)
                owner.append(doc[word_at[order[use]]] + i)
                where.append(bucket[run[use]])
            yield np.concatenate(owner), np.concatenate(where), docs[a:b] + i


def counts(texts: DataFrame, params: Params = Params()) -> DataFrame:
    """(bucket, n): occurrences of features by bucket over all texts; a row for each bucket and task is
    all that is shuffled."""

    def run(batches):
        total = np.zeros(params.buckets, np.int64)
        for batch in batches:
            for _, where, _ in features(*common.flat_text(batch.column(0)), params):
                total += np.bincount(where, minlength=params.buckets)
        hit = np.flatnonzero(total)
        yield pa.record_batch([pa.array(hit.astype(np.int32)), pa.array(total[hit])], ["bucket", "n"])

    found = texts.select(F.col("text").cast("string")).mapInArrow(common.tidy(run), "bucket int, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame, params: Params = Params()) -> np.ndarray:
    """The gain of each bucket; as many rows as there are buckets reach the driver."""
    both = []
    for df in (documents, target):
        n = np.zeros(params.buckets, np.int64)
        for r in counts(df, params).collect():
            n[r.bucket] = r.n
        both.append(n)
    s, t = both
    whole_s, whole_t = float(int(s.sum()) + params.buckets), float(int(t.sum()) + params.buckets)
    ratio = [(float(b + 1) * whole_s) / (float(a + 1) * whole_t) for a, b in zip(s.tolist(), t.tolist())]
    return np.array([math.floor(params.scale * math.log(x)) for x in ratio], np.int64)


def weights(documents: DataFrame, gain: np.ndarray, params: Params = Params()) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of each document's features."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            words, many, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for doc, where, own in features(*common.flat_text(batch.column(1)), params):
                words += np.bincount(own, minlength=n)
                many += np.bincount(doc, minlength=n)
                total += np.bincount(doc, gain[where], n).astype(np.int64)  # whole numbers far below 2^53
            yield pa.record_batch([batch.column(0), pa.array(words), pa.array(many), pa.array(total // np.maximum(many, 1))], ["doc_id", "n_words", "n_features", "weight"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(common.tidy(run), "doc_id long, n_words long, n_features long, weight long")


def resample(documents: DataFrame, target: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null where it isn't drawn."""
    spark = documents.sparkSession
    with common.scratch(spark) as keep:
        weighted = keep(weights(documents, gains(documents, target, params), params), "weights")
    part = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{params.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.log(-F.log((part + 0.5) / F.lit(4294967296.0))) * F.lit(-float(params.scale)))
    scored = weighted.withColumn("score", F.col("weight") + noise)
    able = F.col("n_words") >= params.min_words
    placed = ordering.numbered(scored.where(able), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")])
    drawn = F.col("_i") < F.floor(F.col("_n") * params.percent / 100)
    out = ["doc_id", "n_features", "weight", "score"]
    return placed.select(*out, F.when(drawn, F.col("_i") + 1).alias("rank")).unionByName(scored.where(~able).select(*out, F.lit(None).cast("long").alias("rank")))


#: CRC-32 byte by byte, with its table made from the polynomial.
ORACLE_SQL = r"""
WITH tbl AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(b))),
src AS (SELECT 0 AS kind, row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
  UNION ALL SELECT 1, -row_number() OVER (), NULL, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
wl AS (SELECT kind, row, doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM src),
u AS (SELECT row, kind, i, w[i] AS a, CASE WHEN i < len(w) THEN w[i + 1] END AS b FROM (SELECT row, kind, w, unnest(range(1, len(w) + 1)) AS i FROM wl)),
f AS (SELECT row, kind, a AS f FROM u UNION ALL SELECT row, kind, a || ' ' || b FROM u WHERE b IS NOT NULL),
n AS (SELECT row, kind, f, count(*) AS n FROM f GROUP BY 1, 2, 3),
d AS (SELECT DISTINCT f FROM n),
h AS (SELECT f, hex(encode(f)) AS x FROM d),
k AS (SELECT f, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(t[CAST(xor(c, b) & 255 AS INTEGER) + 1], c >> 8))) % 10000 AS bucket FROM h, tbl),
c AS (SELECT n.row, n.kind, k.bucket, sum(n.n) AS n FROM n JOIN k USING (f) GROUP BY 1, 2, 3),
bk AS (SELECT bucket, sum(n) FILTER (kind = 0) AS s, sum(n) FILTER (kind = 1) AS t FROM c GROUP BY 1),
tot AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM bk),
g AS (SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(bk.t, 0) + 1 AS DOUBLE) * CAST(tot.s + 10000 AS DOUBLE)) / (CAST(coalesce(bk.s, 0) + 1 AS DOUBLE) * CAST(tot.t + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM bk, tot),
w AS (SELECT row, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight FROM c JOIN g USING (bucket) WHERE kind = 0 GROUP BY 1),
sc AS (SELECT wl.row, wl.doc_id, len(wl.w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  CAST('0x' || substr(sha256('7:' || coalesce(CAST(wl.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM wl LEFT JOIN w USING (row) WHERE kind = 0),
sd AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM sc),
rk AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id, n_features, weight) AS rank, count(*) OVER () AS n FROM sd WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN rk.rank <= floor(25 * rk.n / 100) THEN rk.rank END AS BIGINT) AS rank FROM sd LEFT JOIN rk USING (row)
""".strip()
