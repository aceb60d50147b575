"""Filter interaction audit: what each filter removes at each place of every order of filters.

A document that fails some filters is removed by the first of them that is applied. Whether a filter
removes it depends on the set of filters applied before and not on their order, so the 120 orders of
five filters are paths through a lattice of 32 sets with 80 edges (already-applied subset, next
filter). Documents are counted by part and by the set of filters that they fail, which is
pre-aggregated before anything is shuffled; each such class contributes to the 80 edges, edges are
summed, and the 600 steps of the 120 orders look their edge up. Texts are read once and never
shuffled: what is joined is an id, a digest and five bits.

Defined cases: a null text is empty, a null source is part ''; a null doc_id is smaller than none,
larger than none, and has no labels; rows that repeat a doc_id with the same text don't remove each
other (neither id is smaller), other rows are compared by id; a doc_id with several label rows is
good (toxic) if any of them says so; empty texts fail A alone, and E after the smallest id. Empty
tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

FILTERS = "ABCDE"
#: The lattice has k 2^(k-1) edges and k! paths of k steps; 7 filters have 35,280 steps.
MAX_FILTERS = 7
_GAP = r"[\x20\x09-\x0D]+"


def text_fails(text: Column, words: Column) -> Column:
    """Bits 0 to 3: a text fails A (under 50 words), B (under 65 % of them different), C (over 5 % of
    the code points in A-Z), D (holds any of #$%&*|)."""
    n, different = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    tests = (n < 50, different * 100 < n * 65, capitals * 100 > F.length(text).cast("long") * 5, text.rlike("[#$%&*|]"))
    return sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))


def measured(documents: DataFrame) -> DataFrame:
    """(doc_id, part, digest, fails): the bits of A to D and what tells equal texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    df = df.withColumn("words", F.array_remove(F.split("text", _GAP, -1), ""))
    return df.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), text_fails(F.col("text"), F.col("words")).alias("fails"))


def classes(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, n, good, toxic) of measured() rows, with bit 4 set on rows whose text a smaller
    doc_id has too. The rows that pass E are those at their text's smallest id, so the join back is
    by id and not by text: many copies of a text are no hot key."""
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = rows.where("doc_id IS NOT NULL").join(first, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    known = known.select("part", (F.col("fails") + F.when(F.col("first"), 0).otherwise(16)).alias("fails"), "good", "toxic")
    unknown = rows.where("doc_id IS NULL").select("part", "fails", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return known.unionByName(unknown).groupBy("part", "fails").agg(F.count("*").alias("n"), total("good"), total("toxic"))


def edges(counted: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """(part, done, next, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley):
    sums of classes (part, fails, n, good, toxic) over the edges of the lattice. `done` is the set of
    filters applied before as bits, `next` the place of the filter that is applied."""
    if not 1 <= filters <= MAX_FILTERS:
        raise ValueError(f"1 to {MAX_FILTERS} filters")
    lattice = " ".join(f"{s},{f}" for s in range(1 << filters) for f in range(filters) if not s >> f & 1)
    edge = F.transform(F.split(F.lit(lattice), " "), lambda e: F.transform(F.split(e, ","), lambda x: x.cast("int")))
    df = counted.select("part", "fails", "n", "good", "toxic", F.explode(edge).alias("e"))
    done, following = F.col("e")[0], F.col("e")[1]
    bit = F.call_function("shiftleft", F.lit(1), following)
    fails, earlier, here = F.col("fails"), F.col("fails").bitwiseAND(done) != 0, F.col("fails").bitwiseAND(bit) != 0
    count = lambda c, name, when: F.sum(F.when(when, F.col(c)).otherwise(0)).cast("long").alias(name)
    df = df.groupBy("part", done.alias("done"), following.alias("next")).agg(
        count("n", "kept", ~earlier & ~here), count("n", "removed", here & ~earlier), count("n", "redundant", here & earlier), count("n", "unique_fails", fails == bit),
        count("good", "good_lost", here & ~earlier), count("toxic", "toxic_lost", here & ~earlier),
    )
    # an edge lies on |S|! (k - 1 - |S|)! of the orders
    paths = F.element_at(F.array(*[F.lit(math.factorial(s) * math.factorial(filters - 1 - s)) for s in range(filters)]), F.bit_count("done") + 1)
    shares = df.groupBy("part", "next").agg(F.sum(F.col("removed") * paths).cast("long").alias("shapley"))
    return df.join(shares, ["part", "next"])


def steps(spark, names: str = FILTERS) -> DataFrame:
    """(filter_order, step, done, next): every step of every order; k k! rows, 600 for five filters."""
    place = {c: k for k, c in enumerate(names)}
    rows = [f"('{''.join(p)}', {k + 1}, {sum(1 << place[c] for c in p[:k])}, {place[p[k]]})" for p in itertools.permutations(names) for k in range(len(names))]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(filter_order, step, done, next)")


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order and step, with the counts of the step's edge."""
    spark = documents.sparkSession
    with common.scratch(spark) as keep:
        rows = common.materialize(measured(documents), "measured")
        counted = keep(classes(rows, labels), "classes")
    return edges(counted).join(F.broadcast(steps(spark)), ["done", "next"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
firsts AS (SELECT text, min(doc_id) AS doc_id FROM d GROUP BY text),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    concat(CASE WHEN len(words) < 50 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END,
      CASE WHEN 100 * length(regexp_replace(w.text, '[^A-Z]+', '', 'g')) > 5 * length(w.text) THEN 'C' ELSE '' END,
      CASE WHEN regexp_matches(w.text, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN w.doc_id > firsts.doc_id THEN 'E' ELSE '' END) AS failed
  FROM w JOIN firsts ON w.text = firsts.text LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, failed),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)),
g AS (
  SELECT part, filter_order, step, own, n, good, toxic, failed, contains(failed, own) AS here,
    CASE WHEN before = '' THEN false ELSE regexp_matches(failed, '[' || CASE WHEN before = '' THEN 'Z' ELSE before END || ']') END AS earlier
  FROM c, s),
t AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN NOT here AND NOT earlier THEN n ELSE 0 END) AS kept, sum(CASE WHEN here AND NOT earlier THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN here AND earlier THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN here AND NOT earlier THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN here AND NOT earlier THEN toxic ELSE 0 END) AS toxic_lost
  FROM g GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM t
""".strip()
