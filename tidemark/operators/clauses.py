"""Conjunctive clauses over literal vectors: firing, votes, predictions, readings.

A clause is a bit mask; it fires where all its bits are set in [v, not v]. A few clauses are
checked inside one expression; tables of any size are an index by rarest literal that rows are joined
with (`search`). No way makes a cross join, and all give the same rows: a vector that is null, has
another number of words than a clause or a null among them fires nothing and has no score, not even by
an empty clause; clauses whose mask is null are passed over.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hv
from . import ordering, search

MAX_CLAUSES = 10_000


def _few(clauses: DataFrame, columns: Sequence[str], limit: int) -> list | None:
    """The rows of a clause table in order, or None if there are more than `limit`."""
    rows = clauses.where("include IS NOT NULL AND clause IS NOT NULL").select(*columns).limit(limit + 1).collect()
    return None if len(rows) > limit else sorted((r[0], list(r[1]), *r[2:]) for r in rows)


def clause_rows(clauses: DataFrame, limit: int = MAX_CLAUSES) -> list[tuple[int, list[int]]]:
    """(clause, include words) of a clause table, of checked size."""
    rows = _few(clauses, ["clause", "include"], limit)
    if rows is None:
        raise ValueError(f"more than {limit} clauses")
    return rows


def _met(words: Sequence[int], x: Column) -> Column:
    """Whether a constant include mask is met; only its words that aren't zero are looked at."""
    tests = [F.get(x, F.lit(w)).bitwiseAND(F.lit(v).cast("long")) == F.lit(v).cast("long") for w, v in enumerate(words) if v]
    return reduce(lambda a, b: a & b, tests, hv.whole(x, len(words)))


def fire(df: DataFrame, clauses: DataFrame, literal: str = "literals", empty_fires: bool = True) -> DataFrame:
    """One row for each row and clause that fires in it (column clause). A few clauses are one
    expression; more are an index."""
    rows = _few(clauses, ["clause", "include"], hv.MAX_IN_EXPRESSION)
    if rows is None:
        return search.containing(df, clauses, literal, empty_fires)
    tests = [F.when(_met(inc, F.col(literal)) if any(inc) or empty_fires else F.lit(False), F.lit(k)) for k, inc in rows]
    if not tests:
        return df.withColumn("clause", F.lit(None).cast("int")).limit(0)
    return df.withColumn("clause", F.explode(F.array(*tests))).where("clause IS NOT NULL")


def _matrix(rows: list) -> tuple[np.ndarray, np.ndarray]:
    if len({len(r[1]) for r in rows}) > 1:
        raise ValueError("a matrix needs clauses of one width")
    return np.array([r[0] for r in rows], np.int32), np.array([r[1] for r in rows], np.int64).reshape(len(rows), -1).view(np.uint64)


def fire_numpy(df: DataFrame, clauses: DataFrame, literal: str = "literals", empty_fires: bool = True) -> DataFrame:
    """As fire(), on Arrow batches that meet a matrix of checked size."""
    ids, inc = _matrix(clause_rows(clauses))
    at = df.columns.index(literal)

    def run(batch):
        (x, ok), found = hv.as_matrix(batch.column(at), inc.shape[1]), []
        for a in range(0, len(ids), 512):
            part = inc[a : a + 512]
            hit = np.repeat(ok[:, None], len(part), 1)
            for w in range(x.shape[1]):
                hit &= (x[:, w, None] & part[None, :, w]) == part[None, :, w]
            if not empty_fires:
                hit &= (part != 0).any(1)[None]
            r, c = np.nonzero(hit)
            found.append((r, c + a))
        r, c = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        return r, [pa.array(ids[c])]

    return hv.in_batches(df, run, "clause int")


def class_sums(fired: DataFrame, weights: DataFrame, keys: Sequence[str] = ("sample",), clamp: int | None = None) -> DataFrame:
    """(keys, class, class_sum) of distinct fired clauses per key. The weight table has one row for
    each class and clause and is joined by clause."""
    on = fired.select(*keys, "clause").distinct()
    s = on.join(weights, "clause").groupBy(*keys, "class").agg(F.sum("weight").alias("class_sum"))
    return s if clamp is None else s.withColumn("class_sum", F.greatest(F.lit(-clamp), F.least(F.lit(clamp), F.col("class_sum"))))


def predict(sums: DataFrame, keys: Sequence[str] = ("sample",)) -> DataFrame:
    """(keys, predicted): the class with the largest sum, ties to the lowest class."""
    return sums.groupBy(*keys).agg(F.max_by("class", F.struct("class_sum", -F.col("class"))).alias("predicted"))


def probability(pos: Column, neg: Column) -> Column:
    return F.least(F.lit(1.0), 0.5 + pos - neg)


def include_counts(clauses: DataFrame, words: int | None = None) -> DataFrame:
    """(clause, n_includes): masks of any width; those of `words` words are counted faster."""
    return clauses.select("clause", hv.popcount(F.col("include"), words).alias("n_includes"))


def included_literals(clauses: DataFrame, shape: hv.Shape) -> DataFrame:
    """(clause, literal) of every included literal; k and size + k are a feature and its negation."""
    return clauses.select("clause", F.explode(hv.indices(F.col("include"), shape)).alias("literal"))


def literal_counts(fired: DataFrame, weights: DataFrame, clauses: DataFrame, top: DataFrame, shape: hv.Shape, keys: Sequence[str] = ("sample",)) -> DataFrame:
    """(keys, literal, total): weights of the predicted class summed over the literals of the
    clauses that fired."""
    on = fired.select(*keys, "clause").distinct().join(top, list(keys))
    w = on.join(weights.withColumnRenamed("class", "predicted"), ["clause", "predicted"])
    return w.join(included_literals(clauses, shape), "clause").groupBy(*keys, "literal").agg(F.sum("weight").alias("total"))


def top_literals(counts: DataFrame, top: int = 160, keys: Sequence[str] = ("sample",)) -> DataFrame:
    """The literals of each key with the largest totals, ties to the lowest."""
    w = Window.partitionBy(*keys).orderBy(F.desc("total"), "literal")
    return counts.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= top).drop("_k")


def mean_bits(codes: DataFrame, code: str = "code") -> int:
    """The mean number of bits of the codes of a book, 1 at least."""
    n = codes.agg(F.avg(hv.popcount(F.col(code))).alias("n")).first().n
    return max(1, int(n or 0))


def recovered(counts: DataFrame, bits: int, shape: hv.Shape = hv.PRODUCTION, keys: Sequence[str] = ("sample",)) -> DataFrame:
    """(keys, hv): the vector that literal counts (keys, literal, total) speak of. A feature's counts as it is
    and negated are added, and the `bits` features with the most are its bits; features without a count
    stand at 0, above negative ones, and ties go to the lowest."""
    folded = counts.groupBy(*keys, F.pmod("literal", F.lit(shape.size)).cast("int").alias("bit")).agg(F.sum("total").alias("total"))
    every = counts.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(shape.size - 1))).alias("bit"))
    same = [every[k].eqNullSafe(folded[k]) for k in keys]
    full = every.join(folded, [*same, every["bit"] == folded["bit"]], "left").select(*[every[k] for k in keys], every["bit"], F.coalesce(folded["total"], F.lit(0)).alias("total"))
    w = Window.partitionBy(*keys).orderBy(F.desc("total"), "bit")  # a vector's bits
    top = full.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= bits)
    return top.groupBy(*keys).agg(hv.from_indices(F.collect_list("bit"), shape).alias("hv"))


def telling(counts: DataFrame, book: DataFrame, shape: hv.Shape = hv.PRODUCTION, keys: Sequence[str] = ("sample",), level: str = "level", code: str = "code") -> DataFrame:
    """(keys, level, distance): the code (an edge's, say) that is nearest to what each key's literal counts
    speak of, with as many bits as codes have in the mean; ties to the lowest level."""
    found = hv.nearest(recovered(counts, mean_bits(book, code), shape, keys), book, "hv", level, code)
    return found.select(*keys, level, "distance")


def telling_vertex(counts: DataFrame, layer: DataFrame, bits: int, shape: hv.Shape = hv.PRODUCTION, keys: Sequence[str] = ("sample",)) -> DataFrame:
    """(keys, vertex, distance): the vertex of the same sample (layer: keys, vertex, hv) whose vector is
    nearest to what its literal counts speak of; ties to the lowest vertex."""
    x = recovered(counts, bits, shape, keys).withColumnRenamed("hv", "_r").join(layer.where("hv IS NOT NULL"), list(keys))
    best = F.min(F.struct(hv.hamming(F.col("_r"), F.col("hv")).alias("distance"), "vertex"))
    return x.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.vertex", "_b.distance")


def feature_strength(clauses: DataFrame, weights: DataFrame, class_id: int, shape: hv.Shape) -> DataFrame:
    """(literal, strength) of one class: negated literals have indices of their own. Masks meet their weights
    as they are; weights are summed by place and value of the masks' bytes, and only these sums, as many at
    most as bytes have values, are taken apart to bits."""
    own = weights.where(F.col("class") == class_id).select("clause", "weight")
    # sorted on both sides: by the size of its files a large table of weights would be taken for a small one and sent whole
    met = clauses.select("clause", "include").join(own.hint("merge"), "clause")
    n = -(-shape.bits // 8)
    cut = lambda w, k: F.array(*[F.struct((k * n + b).alias("_at"), F.call_function("shiftrightunsigned", w, F.lit(8 * b)).bitwiseAND(F.lit(255)).alias("_byte")) for b in range(n)])
    sums = met.select("weight", F.inline(F.flatten(F.transform("include", cut)))).where("_byte <> 0").groupBy("_at", "_byte").agg(F.sum("weight").alias("_sum"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda b: F.call_function("shiftright", F.col("_byte"), b).bitwiseAND(F.lit(1)) == 1)
    each = sums.select("_at", "_sum", F.explode(bits).alias("_bit")).where(F.pmod("_at", F.lit(n)) * 8 + F.col("_bit") < shape.bits)
    literal = (F.floor(F.col("_at") / n) * shape.bits + F.pmod("_at", F.lit(n)) * 8 + F.col("_bit")).cast("int")
    return each.groupBy(literal.alias("literal")).agg(F.sum("_sum").alias("strength"))


def residual(include: Column, literals: Column, limit: int) -> Column:
    """Fuzzy match: at most `limit` included literals, less those that are unmet; 0 at least."""
    unmet = hv.popcount(F.zip_with(include, literals, lambda i, x: i.bitwiseAND(F.bitwise_not(x))))
    return F.greatest(F.lit(0), F.least(hv.popcount(include), F.lit(limit)) - unmet)


def fuzzy_score(df: DataFrame, clauses: DataFrame, limit: int, clamp: int, literal: str = "literals") -> DataFrame:
    """Adds score: residuals of even clauses less those of odd ones, times their weights, clamped; null
    without a whole vector. A few clauses (clause, include, weight) are one expression, more are a matrix
    that Arrow batches of rows meet, and a table beyond the matrix's limit meets the rows in blocks of
    that size, whose sums are added."""
    df = df.drop("score")
    table = clauses.where("include IS NOT NULL AND clause IS NOT NULL").select("clause", "include", "weight")
    got = _few(table, ["clause", "include", "weight"], MAX_CLAUSES)
    if got is None:
        placed, total = ordering.placed(table, ["clause"], place="_at", size="_of")
        df = df.withColumn("_sum", F.lit(0).cast("long"))
        for a in range(0, total, MAX_CLAUSES):  # each block is of checked size
            block = placed.where(F.col("_at").between(a, a + MAX_CLAUSES - 1))
            df = _scored(df, _few(block, ["clause", "include", "weight"], MAX_CLAUSES), limit, literal, "_block")
            df = df.withColumn("_sum", F.col("_sum") + F.col("_block")).drop("_block")
    else:
        df = _scored(df, got, limit, literal, "_sum")
    return df.withColumn("score", F.when(F.col("_sum").isNotNull(), F.greatest(F.lit(-clamp), F.least(F.lit(clamp), F.col("_sum")))).cast("long")).drop("_sum")


def _scored(df: DataFrame, got: list, limit: int, literal: str, out: str) -> DataFrame:
    """df with the sum of the residuals of some clauses, times their signed weights."""
    rows = [(k, inc, int(w) * (1 if k % 2 == 0 else -1)) for k, inc, w in got]
    if len(rows) > hv.MAX_IN_EXPRESSION:
        at = df.columns.index(literal)
        _, inc = _matrix(rows)
        weight, full = np.array([r[2] for r in rows], np.int64), np.minimum(np.bitwise_count(inc).sum(1, dtype=np.int64), limit)

        def run(batch):
            (x, ok), total = hv.as_matrix(batch.column(at), inc.shape[1]), np.zeros(batch.num_rows, np.int64)
            for a in range(0, len(inc), 512):
                unmet = np.zeros((len(x), len(inc[a : a + 512])), np.int64)
                for w in range(x.shape[1]):
                    unmet += np.bitwise_count(inc[None, a : a + 512, w] & ~x[:, w, None])
                total += np.maximum(0, full[None, a : a + 512] - unmet) @ weight[a : a + 512]
            return None, [pa.array(total, mask=~ok)]

        return hv.in_batches(df, run, f"{out} long")
    x, total = F.col(literal), F.lit(0).cast("long")
    for _, inc, weight in rows:
        unmet = [F.bit_count(F.bitwise_not(F.get(x, F.lit(w))).bitwiseAND(F.lit(v).cast("long"))) for w, v in enumerate(inc) if v]
        full = min(limit, sum((v & (1 << 64) - 1).bit_count() for v in inc))
        total = total + F.greatest(F.lit(0), F.lit(full) - (reduce(lambda a, b: a + b, unmet) if unmet else F.lit(0))) * weight
    ok = reduce(lambda a, b: a & b, [hv.whole(x, w) for w in sorted({len(inc) for _, inc, _ in rows})], x.isNotNull())
    return df.withColumn(out, F.when(ok, total))


def ranked(clauses: DataFrame, weight: str = "weight") -> DataFrame:
    """Adds rank: clauses by weight from the largest down; ties by id."""
    return ordering.numbered(clauses, [F.desc(weight), F.col("clause")], place="rank", size="_n").withColumn("rank", (F.col("rank") + 1).cast("int")).drop("_n")


def coverage(fired: DataFrame, vertices: int, keys: Sequence[str] = ("sample",)) -> DataFrame:
    """(keys, clause, coverage): share of a sample's vertices where a clause fires."""
    return fired.groupBy(*keys, "clause").agg((F.count_distinct("vertex") / vertices).alias("coverage"))


def composite(layer1: DataFrame, layer2: DataFrame, keys: Sequence[str] = ("sample", "vertex")) -> DataFrame:
    """Clauses that fire in both layers."""
    return layer1.select(*keys, "clause").join(layer2.select(*keys, "clause"), [*keys, "clause"], "left_semi").distinct()


def weight_sum(fired: DataFrame, weights: DataFrame, keys: Sequence[str] = ("sample",)) -> DataFrame:
    """(keys, share): weights of the clauses that fired over the weights of all."""
    total = weights.agg(F.sum(F.abs("weight")).alias("_t"))  # one row
    on = fired.select(*keys, "clause").distinct().join(weights, "clause").groupBy(*keys).agg(F.sum(F.abs("weight")).alias("_s"))
    return on.join(F.broadcast(total)).select(*keys, F.when(F.col("_t") == 0, 0.0).otherwise(F.col("_s") / F.col("_t")).alias("share"))
