"""Hypervector functions: column expressions over bit vectors held as ARRAY<BIGINT>.

A vector is `words` words of `bits` bits each, lowest word and lowest bit first. The width is a
parameter: 25 words of 64 bits for production codebooks, two of 32 bits where a vector is
compared with SQL engines that lack an unsigned 64-bit shift. Functions of columns stay in the
JVM and need no shuffle; only large codebooks go through Arrow batches.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .. import session


@dataclass(frozen=True)
class Shape:
    """Width of a vector and the number of bits a bundle keeps."""

    words: int = 25
    bits: int = 64
    top: int = 160

    @property
    def size(self) -> int:
        return self.words * self.bits

    @property
    def word_mask(self) -> int:
        return -1 if self.bits == 64 else (1 << self.bits) - 1


PRODUCTION = Shape()
SMALL = Shape(2, 32, 12)


def bind(a: Column, b: Column) -> Column:
    """XOR of two vectors; it is its own inverse."""
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def union(a: Column, b: Column) -> Column:
    """OR of two vectors."""
    return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))


def both(a: Column, b: Column) -> Column:
    """AND of two vectors."""
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def complement(a: Column, shape: Shape = PRODUCTION) -> Column:
    """NOT of a vector, within its words."""
    return F.transform(a, lambda x: F.bitwise_not(x).bitwiseAND(F.lit(shape.word_mask)))


def literals(a: Column, shape: Shape = PRODUCTION) -> Column:
    """The vector followed by its complement."""
    return F.concat(a, complement(a, shape))


def popcount(a: Column, words: int | None = None) -> Column:
    """Number of set bits; null where a word is. Vectors of `words` words, if that is given, are counted in
    generated code; a fold, which is interpreted word by word, is left to those of any other width."""
    fold = F.aggregate(a, F.lit(0), lambda n, x: n + F.bit_count(x))
    if not words:
        return fold
    return F.when(F.size(a) == words, reduce(lambda n, x: n + x, [F.bit_count(F.get(a, F.lit(w))) for w in range(words)])).otherwise(fold)


def hamming(a: Column, b: Column) -> Column:
    return popcount(bind(a, b))


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 - |a and b| / |a or b|; 1 where both are empty."""
    n = popcount(union(a, b))
    return F.when(n == 0, 1.0).otherwise(1.0 - popcount(both(a, b)) / n)


def overlap(a: Column, b: Column) -> Column:
    """Share of a's bits that b has; 0 where a is empty."""
    n = popcount(a)
    return F.when(n == 0, 0.0).otherwise(popcount(both(a, b)) / n)


def similarity(a: Column, b: Column, shape: Shape = PRODUCTION) -> Column:
    return 1.0 - hamming(a, b) / shape.size


def is_zero(a: Column) -> Column:
    return F.forall(a, lambda x: x == 0)


def contains(include: Column, x: Column) -> Column:
    """Whether every bit of include is set in x; an empty include is contained everywhere."""
    return F.forall(F.zip_with(include, x, lambda i, v: i.bitwiseAND(v) == i), lambda ok: ok)


def bit(a: Column, index: Column, shape: Shape = PRODUCTION) -> Column:
    """The bit at an index, as 0 or 1."""
    word = F.element_at(a, F.floor(index / shape.bits).cast("int") + 1)
    return F.call_function("shiftright", word, F.pmod(index, F.lit(shape.bits)).cast("int")).bitwiseAND(F.lit(1)).cast("int")


def indices(a: Column, shape: Shape = PRODUCTION) -> Column:
    """Indices of the bits that are set, in order."""
    return F.filter(F.sequence(F.lit(0), F.size(a) * shape.bits - 1), lambda k: bit(a, k, shape) == 1)


def to_bits(a: Column, shape: Shape = PRODUCTION) -> Column:
    """The vector as an array of 0 and 1."""
    return F.transform(F.sequence(F.lit(0), F.size(a) * shape.bits - 1), lambda k: bit(a, k, shape))


def from_indices(index_array: Column, shape: Shape = PRODUCTION) -> Column:
    """Packs an array of bit indices; duplicates are harmless."""

    def word(w: int) -> Column:
        mine = F.filter(index_array, lambda k: F.floor(k / shape.bits) == w)
        return F.aggregate(mine, F.lit(0).cast("long"), lambda acc, k: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(k, F.lit(shape.bits)).cast("int"))))

    return F.array(*map(word, range(shape.words)))


def permute(a: Column, shift: int, shape: Shape = PRODUCTION) -> Column:
    """Moves every bit `shift` places up, cyclically; a negative shift moves down. Each word is put
    together from two neighbours by shifts, without bit indices. The input is evaluated once."""
    q, r = divmod(shift % shape.size, shape.bits)

    def moved(v: Column) -> Column:
        def word(w: int) -> Column:
            own = F.get(v, F.lit((w - q) % shape.words))
            if not r:
                return own
            below = F.get(v, F.lit((w - q - 1) % shape.words))
            x = F.call_function("shiftleft", own, F.lit(r)).bitwiseOR(F.call_function("shiftrightunsigned", below, F.lit(shape.bits - r)))
            return x if shape.bits == 64 else x.bitwiseAND(F.lit(shape.word_mask))

        return F.when(v.isNotNull(), F.array(*map(word, range(shape.words))))

    return F.transform(F.array(a), moved)[0]


def unpermute(a: Column, shift: int, shape: Shape = PRODUCTION) -> Column:
    return permute(a, -shift, shape)


def split_words(a: Column) -> Column:
    """64-bit words as 32-bit ones, low half first."""
    half = lambda x, n: F.call_function("shiftrightunsigned", x, F.lit(n)).bitwiseAND(F.lit(0xFFFFFFFF)).cast("long")
    return F.flatten(F.transform(a, lambda x: F.array(half(x, 0), half(x, 32))))


def join_words(a: Column) -> Column:
    """32-bit words, low half first, as 64-bit ones."""
    n = F.floor(F.size(a) / 2).cast("int")
    return F.transform(F.sequence(F.lit(1), n), lambda k: F.element_at(a, 2 * k - 1).bitwiseOR(F.call_function("shiftleft", F.element_at(a, 2 * k), F.lit(32))))


def pack_msb_first(bits: Column, width: int = 32) -> Column:
    """Folds an array of 0 and 1 into words whose first element is the highest bit."""
    n = F.ceil(F.size(bits) / width).cast("int")

    def word(k: Column) -> Column:
        part = F.slice(bits, (k - 1) * width + 1, F.lit(width))
        folded = F.aggregate(part, F.lit(0).cast("long"), lambda acc, b: F.call_function("shiftleft", acc, F.lit(1)).bitwiseOR(b.cast("long")))
        return F.call_function("shiftleft", folded, (width - F.size(part)).cast("int"))

    return F.transform(F.sequence(F.lit(1), n), word)


def sign_words(values: Column, shape: Shape = SMALL) -> Column:
    """The signs of an array of numbers as a vector: bit k is set where value k is positive."""
    words = []
    for w in range(shape.words):
        terms = [F.when(F.element_at(values, w * shape.bits + b + 1) > 0, F.lit(1 << b)).otherwise(F.lit(0)).cast("long") for b in range(shape.bits)]
        words.append(reduce(lambda x, y: x + y, terms))
    return F.array(*words)


# Bundles: many vectors of a group into one -------------------------------------------------


def exploded(df: DataFrame, keys: list[str], hv: str = "hv") -> DataFrame:
    """(keys, word_index, word): one row for each word."""
    return df.select(*keys, F.posexplode(hv).alias("word_index", "word"))


def bundle_or(df: DataFrame, keys: list[str], hv: str = "hv") -> DataFrame:
    """(keys, word_index, word): OR of the vectors of each group; partial sums come first."""
    return exploded(df, keys, hv).groupBy(*keys, "word_index").agg(F.bit_or("word").alias("word"))


def votes(df: DataFrame, keys: list[str], hv: str = "hv", shape: Shape = PRODUCTION) -> DataFrame:
    """(keys, bit, votes): how many vectors of each group have each bit."""
    bits = df.select(*keys, F.explode(indices(F.col(hv), shape)).alias("bit"))
    return bits.groupBy(*keys, "bit").agg(F.count("*").alias("votes"))


def repack(bits: DataFrame, keys: list[str], shape: Shape = PRODUCTION) -> DataFrame:
    """(keys, word_index, word) of a table of bit indices; words without a bit are left out."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("bit", F.lit(shape.bits)).cast("int"))
    return bits.groupBy(*keys, F.floor(F.col("bit") / shape.bits).cast("int").alias("word_index")).agg(F.bit_or(one).alias("word"))


def bundle_top(df: DataFrame, keys: list[str], hv: str = "hv", shape: Shape = PRODUCTION, zero_fill: bool = False) -> DataFrame:
    """(keys, bit, votes): the shape.top most voted bits of each group, ties to the lowest index.
    With zero_fill, bits without a vote fill up to that number."""
    counted = votes(df, keys, hv, shape)
    if zero_fill:
        every = df.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(shape.size - 1))).alias("bit"))
        counted = every.join(counted, [*keys, "bit"], "left").select(*keys, "bit", F.coalesce("votes", F.lit(0)).cast("long").alias("votes"))
    w = Window.partitionBy(*keys).orderBy(F.desc("votes"), F.asc("bit"))
    return counted.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= shape.top).drop("_k")


def bundle_majority(df: DataFrame, keys: list[str], hv: str = "hv", shape: Shape = PRODUCTION) -> DataFrame:
    """(keys, bit, votes): bits that more than half (by whole numbers) of a group's vectors have."""
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return votes(df, keys, hv, shape).join(n, keys).where(F.col("votes") > F.floor(F.col("_n") / 2)).drop("_n")


def whole(a: Column, width: int) -> Column:
    """Whether a vector is there, with so many words and no null among them."""
    return F.coalesce((F.size(a) == width) & F.forall(a, lambda x: x.isNotNull()), F.lit(False))


def as_matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A column of vectors as rows of unsigned words (bits of negative numbers would be counted by their
    absolute value), and which rows hold a whole() vector; others are zeros."""
    ok = pc.equal(pc.fill_null(pc.list_value_length(column), -1), width).to_numpy(zero_copy_only=False)
    kept = column.filter(pa.array(ok)).flatten()
    known = kept.is_valid().to_numpy(zero_copy_only=False).reshape(-1, width).all(1)
    out = np.zeros((len(column), width), np.int64)
    out[ok] = pc.fill_null(kept, 0).to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)
    ok[np.flatnonzero(ok)[~known]] = False
    out[~ok] = 0
    return out.view(np.uint64), ok


def in_batches(df: DataFrame, run, added: str) -> DataFrame:
    """df with the columns that run(batch) gives for each Arrow batch: arrays, or rows to take and
    arrays."""
    session.ship(df.sparkSession)
    names = df.columns

    def batches(it):
        for batch in it:
            if batch.num_rows:
                take, new = run(batch)
                cols = batch.columns if take is None else [c.take(pa.array(take)) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*cols, *new], names=[*names, *(c.split()[0] for c in added.split(", "))])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(batches, f"{schema}, {added}")


#: Codes or clauses that are written out in one expression; more are a matrix that batches of rows meet.
MAX_IN_EXPRESSION = 64


def word_distance(a: Column, words: Sequence[int]) -> Column:
    """Hamming distance to a constant vector, word by word."""
    return reduce(lambda x, y: x + y, [F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.lit(int(w)).cast("long"))) for k, w in enumerate(words)]).cast("int")


def nearest(df: DataFrame, codebook: DataFrame, hv: str = "hv", level: str = "level", code: str = "code", max_levels: int = 4096) -> DataFrame:
    """df with the level and distance of its nearest code, ties to the lowest level.

    A few codes are one expression, more are a matrix for Arrow batches, and a codebook of more than
    max_levels codes is searched by an index (search.nearest_indexed); in none of these a cross join is
    made. Null codes are passed over; a vector that is null, has another number of words than the codes
    or a null among them gets a null level and distance."""
    codebook = codebook.where(F.col(code).isNotNull() & F.col(level).isNotNull())
    rows = sorted((r[0], list(r[1])) for r in codebook.select(level, code).limit(max_levels + 1).collect())
    df = df.drop(level, "distance")
    kind = dict(codebook.dtypes)[level]
    if not rows:
        return df.withColumns({level: F.lit(None).cast(kind), "distance": F.lit(None).cast("int")})
    if len({len(w) for _, w in rows}) > 1:
        raise ValueError("the codes of a codebook have one width")
    width = len(rows[0][1])
    if len(rows) > max_levels:
        from ..operators import search

        return search.nearest_indexed(df, codebook, hv, level, code, width)
    if len(rows) <= MAX_IN_EXPRESSION:
        best = F.least(*[F.struct(word_distance(F.col(hv), words).alias("distance"), F.lit(k).cast(kind).alias(level)) for k, words in rows])
        df = df.withColumn("_best", F.when(whole(F.col(hv), width), best))
        return df.withColumns({level: F.col(f"_best.{level}"), "distance": F.col("_best.distance")}).drop("_best")
    codes, at = np.array([w for _, w in rows], np.int64).view(np.uint64), df.columns.index(hv)
    levels = pa.array([k for k, _ in rows], to_arrow_type(codebook.schema[level].dataType))

    def run(batch):
        (x, ok), best, who = as_matrix(batch.column(at), width), np.full(batch.num_rows, np.iinfo(np.int32).max, np.int32), np.zeros(batch.num_rows, np.int64)
        for a in range(0, len(codes), 256):
            d = np.zeros((len(x), min(256, len(codes) - a)), np.int32)
            for w in range(width):
                d += np.bitwise_count(x[:, w, None] ^ codes[None, a : a + 256, w])
            low = d.min(1)
            who, best = np.where(low < best, a + d.argmin(1), who), np.minimum(best, low)
        return None, [levels.take(pa.array(who, mask=~ok)), pa.array(best, mask=~ok)]

    return in_batches(df, run, f"{level} {kind}, distance int")


def decode(df: DataFrame, codebook: DataFrame, role: Sequence[int], hv: str = "hv", level: str = "level", shape: Shape = PRODUCTION) -> DataFrame:
    """Unbinds a role and adds the level of the nearest code and its similarity."""
    free = df.withColumn(hv, bind(F.col(hv), F.array(*[F.lit(int(w)).cast("long") for w in role])))
    return nearest(free, codebook, hv, level).withColumn("similarity", 1.0 - F.col("distance") / shape.size)
