"""Searches by index among bit vectors: clauses that a vector contains, and nearest codes.

`containing` keys each clause by its included literal that the fewest rows have, joins rows by the key
literals that they have set, and checks what meets. `nearest_indexed` is multi-index hashing: codes are
keyed by the chunks of their bits, rows look up chunks that differ in 0, 1, 2, ... bits, and a row is
settled once no code out of sight can be nearer or as near. Both are equi-joins. An index of checked size is
broadcast; a larger one is dealt by key and salt, rows by key and a salt of their own, so that a literal
that half of all rows have is many tasks.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import session
from ..functions import hv as vectors
from . import ordering

#: Bytes of an index that are sent to every task; more is dealt by key.
BROADCAST = 16 << 20
#: Rows of one key that meet in one task of a dealt index.
ROWS = 200_000
#: Rows that meet one block of codes or masks in one task.
SHARE = 20_000


def _bits(v: Column) -> Column:
    """Indices of the bits that are set, 64 to a word; words of fewer bits leave the upper ones empty."""
    every = F.sequence(F.lit(0), F.lit(63))
    own = lambda w: F.filter(every, lambda b: F.call_function("shiftrightunsigned", w, b).bitwiseAND(F.lit(1)) == 1)
    return F.flatten(F.transform(v, lambda w, k: F.transform(own(w), lambda b: k * 64 + b)))


def _dealt(df: DataFrame) -> DataFrame:
    """A side of a join that is never sent whole: the files of a kept table are far smaller than its rows, and
    by their size it would be broadcast through the driver."""
    return df.hint("merge")


def _joined(rows: DataFrame, index: DataFrame, keys: list[str], where: Column, index_bytes: int, n_rows: int, spread: Column) -> DataFrame:
    """Rows with the index's rows of the same keys that pass a test. n_rows: at most so many rows share a key;
    spread: a hash that tells them apart, the same one when a task is run again."""
    if index_bytes <= BROADCAST:
        return rows.join(F.broadcast(index), keys).where(where)  # size checked
    salts = max(1, math.ceil(n_rows / ROWS))
    index = index.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = rows.withColumn("_salt", F.pmod(spread, F.lit(salts)).cast("int"))
    return rows.join(_dealt(index), [*keys, "_salt"]).drop("_salt").where(where)


def literal_index(rows: DataFrame, clauses: DataFrame, literal: str) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(_literal, clause, include): each clause with its included literal that the fewest rows have, ties
    to the lowest. Also the index's literals and in how many rows each is, as many at most as a vector
    has bits."""
    have = rows.select(F.explode(_bits(F.col(literal))).alias("_literal")).groupBy("_literal").agg(F.count("*").alias("_rows"))
    have = session.kept(have, "literals")
    each = clauses.select("clause", "include", F.explode(_bits(F.col("include"))).alias("_literal")).join(F.broadcast(have), "_literal", "left")  # a row a bit
    best = F.min(F.struct(F.coalesce("_rows", F.lit(0)).alias("_rows"), "_literal"))
    index = each.groupBy("clause", "include").agg(best.alias("_b")).select(F.col("_b._literal").alias("_literal"), "clause", "include", F.col("_b._rows").alias("_rows"))
    index = session.kept(index, "clauses")
    used = index.groupBy("_literal").agg(F.max("_rows").alias("_rows"))
    return index.drop("_rows"), [(r["_literal"], r["_rows"]) for r in used.collect()]


def containing(df: DataFrame, clauses: DataFrame, literal: str = "literals", empty_fires: bool = True) -> DataFrame:
    """One row for each row and clause whose bits it has all (column clause), for clause tables of any size."""
    clauses = clauses.where("include IS NOT NULL AND clause IS NOT NULL").select("clause", "include")
    index, used = literal_index(df, clauses, literal)
    names = df.columns
    keys = F.array(*[F.lit(k) for k, _ in used]).cast("array<int>")
    probes = df.withColumn("_literal", F.explode(F.array_intersect(_bits(F.col(literal)), keys)))
    size = index.agg(F.sum(F.size("include") * 8 + 24).alias("n")).first().n or 0
    fits = vectors.whole(F.col(literal), F.size("include")) & vectors.contains(F.col("include"), F.col(literal))
    spread = F.xxhash64(*[F.col(c) for c, t in df.dtypes if "map<" not in t])
    out = _joined(probes, index, ["_literal"], fits, size, max((n for _, n in used), default=0), spread).select(*names, "clause")
    if empty_fires:  # each fires in every whole row, which is that many results
        empty = clauses.where(vectors.is_zero(F.col("include"))).groupBy(F.size("include").alias("_width")).agg(F.collect_list("clause").alias("_ids"))
        for width, ids in empty.collect():
            out = out.unionByName(df.where(vectors.whole(F.col(literal), F.lit(width))).withColumn("clause", F.explode(F.lit(ids))))
    return out


#: Distinct masks in one block of a tally.
MASKS = 65_536


def tally(df: DataFrame, clauses: DataFrame, literal: str = "literals", empty_fires: bool = True) -> DataFrame:
    """df with n_fired and clause_sum: how many of the clauses each row's vector contains, and the sum of their
    ids; rows in which none fires are left out. The fired pairs are never rows.

    Clauses are first counted by mask, as clauses of one mask fire together. Blocks of masks then meet shares of
    the rows: a block has a bitmap of its masks for each bit, and a row passes over the masks in the bitmaps of
    the bits that it lacks."""
    masks = clauses.where("include IS NOT NULL AND clause IS NOT NULL").groupBy("include").agg(F.count("*").alias("_n"), F.sum(F.col("clause").cast("long")).alias("_s"))
    if not empty_fires:
        masks = masks.where(~vectors.is_zero(F.col("include")))
    masks = session.kept(masks.where(F.forall("include", lambda w: w.isNotNull())), "masks")
    blocks = max(1, -(-masks.count() // MASKS))
    rows = session.kept(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    shares = max(1, -(-rows.count() // SHARE))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.where(vectors.whole(F.col(literal), F.size(literal))).select("_row", F.col(literal).alias("_v"), F.pmod(F.xxhash64("_row"), F.lit(shares)).cast("int").alias("_share"), every(blocks).alias("_block"))
    right = masks.select("include", "_n", "_s", F.pmod(F.xxhash64("include"), F.lit(blocks)).cast("int").alias("_block"), every(shares).alias("_share"))
    session.ship(df.sparkSession)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        size_a, size_b = (pc.list_value_length(t.column(c)).to_numpy() for t, c in ((a, "_v"), (b, "include")))
        out = [(np.zeros(0, np.int64),) * 3]
        for width in np.intersect1d(size_a, size_b):
            x, m = a.filter(pa.array(size_a == width)), b.filter(pa.array(size_b == width))
            bits = lambda t, c, w=width: np.unpackbits(t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint8).reshape(t.num_rows, 8 * w), axis=1, bitorder="little")
            has = np.packbits(bits(m, "include").T, axis=1)  # a bitmap of the masks for each bit
            met = np.flatnonzero(has.any(1))
            has, lacks = has[met], bits(x, "_v")[:, met] == 0
            number, total = (m.column(c).to_numpy() for c in ("_n", "_s"))
            n, ids = np.zeros(x.num_rows, np.int64), np.zeros(x.num_rows, np.int64)
            for k, gone in enumerate(lacks):
                fired = np.flatnonzero(np.unpackbits(~np.bitwise_or.reduce(has[gone], axis=0, initial=0), count=m.num_rows)) if len(met) else slice(None)
                n[k], ids[k] = number[fired].sum(), total[fired].sum()
            out.append((x.column("_row").to_numpy(), n, ids))
        row, n, ids = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"_row": row[n > 0], "_n": n[n > 0], "_s": ids[n > 0]})

    met = left.groupBy("_block", "_share").cogroup(right.groupBy("_block", "_share")).applyInArrow(run, "_row long, _n long, _s long")
    found = met.groupBy("_row").agg(F.sum("_n").alias("n_fired"), F.sum("_s").alias("clause_sum"))
    return rows.join(_dealt(found), "_row").drop("_row")


def _chunks(v: Column, width: int, bits: int, of: int) -> Column:
    """The chunks of a vector: structs of place and value. A word's `bits` bits are cut into chunks of `of`
    bits, the last one with the rest."""
    each = -(-bits // of)

    def chunk(k: Column) -> Column:
        value = F.call_function("shiftrightunsigned", F.get(v, F.floor(k / each).cast("int")), (F.pmod(k, F.lit(each)) * of).cast("int"))
        return F.struct(k.alias("place"), value.bitwiseAND(F.lit((1 << of) - 1)).alias("value"))

    return F.transform(F.sequence(F.lit(0), F.lit(width * each - 1)), chunk)


#: Codes in one block of what is compared as a whole.
BLOCK = 16_384
#: Comparisons in a block that cost as much as one look-up.
PROBE = 512


def _in_blocks(left: DataFrame, book: DataFrame, n_left: int) -> DataFrame:
    """(_row, _best) of rows against all codes, a block of codes and a share of the rows at a time."""
    placed, total = ordering.placed(book, ["_level"], place="_at", size="_of")
    salts = max(1, math.ceil(n_left / min(ROWS, SHARE)))
    blocks = placed.select("_level", "_code", F.floor(F.col("_at") / BLOCK).alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    rows = left.select("_row", "_v", "_not", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((total - 1) // BLOCK).cast("long"))).alias("_block"), F.pmod(F.xxhash64("_row"), F.lit(salts)).cast("int").alias("_salt"))
    session.ship(left.sparkSession)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        words = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(t.num_rows, -1)
        if not (a.num_rows and b.num_rows):
            return pa.table({"_row": pa.array([], pa.int64()), "_distance": pa.array([], pa.int32()), "_level": pa.array([], pa.int64())})
        b = b.sort_by("_level")
        x, codes, levels = words(a, "_v"), words(b, "_code"), b.column("_level").to_numpy()
        own = a.column("_not").fill_null(-(1 << 63)).to_numpy()
        best, who = np.empty(len(x), np.int32), np.empty(len(x), np.int64)
        step = max(1, (1 << 18) // len(codes))
        for k in range(0, len(x), step):
            part = x[k : k + step]
            d = np.zeros((len(part), len(codes)), np.int32)
            for w in range(x.shape[1]):
                d += np.bitwise_count(part[:, w, None] ^ codes[None, :, w])
            d[own[k : k + step, None] == levels[None]] = np.iinfo(np.int32).max
            at = d.argmin(1)
            who[k : k + step], best[k : k + step] = levels[at], d[np.arange(len(part)), at]
        seen = best < np.iinfo(np.int32).max
        return pa.table({"_row": a.column("_row").filter(pa.array(seen)), "_distance": best[seen], "_level": who[seen]})

    met = rows.groupBy("_block", "_salt").cogroup(blocks.groupBy("_block", "_salt")).applyInArrow(run, "_row long, _distance int, _level long")
    return met.groupBy("_row").agg(F.min(F.struct(F.col("_distance").alias("distance"), F.col("_level").alias("level"))).alias("_best"))


def nearest_indexed(df: DataFrame, codebook: DataFrame, hv: str = "hv", level: str = "level", code: str = "code", width: int = 25, bits: int = 64, other_than: str | None = None) -> DataFrame:
    """df with the level (a whole number) and distance of its nearest code, ties to the lowest level;
    vectors that aren't whole get nulls. With `other_than`, codes whose level equals that column are passed
    over. `bits` is how many bits of a word are in use.

    Codes are cut into chunks of about log2(codes) bits, so that few codes share a chunk's value. In round
    r rows look up the values that differ from their chunks in r bits: after it, every code that is nearer
    than chunks * (r + 1) has been seen, so rows whose best is nearer are settled and leave. Before a round's
    look-ups would cost as much as comparisons with all codes do, the rows that are left are compared with all
    codes, in blocks: these are as many comparisons as rows left times codes, but nothing is held whole."""
    kind = dict(codebook.dtypes)[level]
    if other_than in (level, "distance") or level == other_than:
        raise ValueError("the column to pass over needs a name of its own")
    book = codebook.select(F.col(level).cast("long").alias("_level"), F.col(code).alias("_code")).where(F.col("_level").isNotNull() & vectors.whole(F.col("_code"), width))
    book = session.kept(book, "codes")
    n = book.count()
    own = F.col(other_than).cast("long") if other_than else F.lit(None).cast("long")
    rows = session.kept(df.drop(level, "distance").withColumn("_row", F.monotonically_increasing_id()), "vectors")
    left = rows.where(vectors.whole(F.col(hv), width)).select("_row", F.col(hv).alias("_v"), own.alias("_not"), F.lit(None).cast("struct<distance:int,level:bigint>").alias("_best"))
    of = max(4, min(16, round(math.log2(max(2, n)))))
    many = width * -(-bits // of)
    index = session.kept(book.select("_level", "_code", F.inline(_chunks(F.col("_code"), width, bits, of))), "chunks")
    done, n_left = [], left.count() if n else 0
    for r in range(of + 1):
        if not n_left or many * math.comb(of, r) * PROBE >= n:
            break
        masks = F.array(*[F.lit(sum(1 << b for b in c)).cast("long") for c in itertools.combinations(range(of), r)])
        probes = left.select("_row", "_v", "_not", F.inline(_chunks(F.col("_v"), width, bits, of)))
        probes = probes.select("_row", "_v", "_not", "place", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("value")))).alias("value"))
        found = _joined(probes, index, ["place", "value"], F.col("_not").isNull() | (F.col("_level") != F.col("_not")), n * many * (8 * width + 48), n_left, F.xxhash64("_row"))
        distance = vectors.hamming(F.col("_v"), F.col("_code"))
        found = found.groupBy("_row").agg(F.min(F.struct(distance.alias("distance"), F.col("_level").alias("level"))).alias("_now"))
        left = left.join(_dealt(found), "_row", "left").withColumn("_best", F.least("_best", "_now")).drop("_now")
        left = session.kept(left, f"round{r}")
        settled = F.coalesce(F.col("_best.distance") < many * (r + 1), F.lit(False))
        done.append(left.where(settled).select("_row", "_best"))
        left = left.where(~settled)
        n_left = left.count()
    if n_left:
        done.append(_in_blocks(left, book, n_left))
    out = rows
    if done:
        best = done[0]
        for more in done[1:]:
            best = best.unionByName(more)
        out = rows.join(_dealt(best), "_row", "left")
    else:
        out = rows.withColumn("_best", F.lit(None).cast("struct<distance:int,level:bigint>"))
    return out.withColumns({level: F.col("_best.level").cast(kind), "distance": F.col("_best.distance")}).drop("_row", "_best")
