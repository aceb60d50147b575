"""Secret scans with an incremental blob ledger, with DataFrame functions only.

Every historical version of every path is content-addressed: its SHA-256 is its blob. A ledger, a
folder of two tables, holds the versions (path, version, blob) and the scans (blob, the rules that
were run on it as `name@version`, the spans found). `add` scans only the pairs of blob and rule
version that the ledger lacks, one copy of each text, and `report` joins findings back to all paths.
A rule that gets a new version is run again on blobs that come by again, no other rule is.

A span is the whole match, in code points with the end excluded; matches of a rule are the leftmost
that don't overlap, and one whose group is too short is dropped after matching (it still uses up what
it matched). The spans of a text are ordered by start, then by the place of the rule in the list.

Digests are grouped with partial sums, and texts are dealt by (path, version, blob), so that many
copies of a text are no hot key there; findings meet the versions in a left join, which Spark splits
where one blob has many. A write is one table in a new batch folder: what a lost job leaves behind
isn't read, and adding the batch again is safe.

Defined cases: a null text is empty; null paths and versions are values like others; rows that repeat
a path are repeated in the report; empty texts and texts without secrets have no spans and are in the
ledger as scanned; an empty batch adds nothing. Extra columns of a batch are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    """A pattern of Java's regular expressions. Matches whose `group` is shorter than `shortest` are
    dropped. Give a changed rule a new version."""

    name: str
    version: int
    pattern: str
    group: int = 0
    shortest: int = 0

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


# The base rules. Runs of a class are maximal, so a least length can stand in the pattern.
_ASSIGNED = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    Rule("assign", 1, r"(?i:(password|passwd|secret|token|api_?key))" + _ASSIGNED, 2, 6),
    Rule("access", 1, "AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, "[0-9a-f]{24,}"),
)
#: Further rules, for forms of keys that services document publicly.
MORE = (
    Rule("private_key", 1, "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("github", 1, "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE
_BLOCK = 128
_SPANS = "array<struct<start:bigint,place:int,rule:string,until:bigint>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def _sums_before(numbers: Column) -> Column:
    """For each number of an array, the sum of those before it: by blocks, so that the work for m
    numbers is m times a block and the square of the number of blocks."""

    def of_blocks(blocks: Column) -> Column:
        def with_sums(sums: Column) -> Column:
            def block(b: Column, k: Column) -> Column:
                return _let(_total(F.slice(sums, 1, k)), lambda start: F.transform(b, lambda _, i: start + _total(F.slice(b, 1, i))))

            return F.flatten(F.transform(blocks, block))

        return _let(F.transform(blocks, _total), with_sums)

    cut = lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / _BLOCK).cast("int")), lambda k: F.slice(n, k * _BLOCK + 1, _BLOCK))
    return _let(numbers, lambda n: _let(cut(n), of_blocks))


def rule_spans(text: Column, rule: Rule, place: int) -> Column:
    """Spans of one rule: a text is what lies between its matches, in turn with the matches."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    parts = F.arrays_zip(
        F.transform(F.slice(F.split(text, rule.pattern, -1), 1, F.size(matches)), lambda x: F.length(x).cast("long")).alias("gap"),
        F.transform(matches, lambda x: F.length(x).cast("long")).alias("own"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length).alias("part"),
    )

    def placed(p: Column) -> Column:
        before = _sums_before(F.transform(p, lambda x: x["gap"] + x["own"]))
        found = F.zip_with(p, before, lambda x, b: F.struct((b + x["gap"]).alias("start"), F.lit(place).alias("place"), F.lit(rule.key).alias("rule"), (b + x["gap"] + x["own"]).alias("until"), x["part"].alias("part")))
        return F.transform(F.filter(found, lambda x: x["part"] >= rule.shortest), lambda x: F.struct(x["start"], x["place"], x["rule"], x["until"]))

    return F.when(text.rlike(rule.pattern), _let(parts, placed)).otherwise(F.array().cast(_SPANS))


def text_spans(text: Column, rules: Sequence[Rule] = RULES, todo: Column | None = None) -> Column:
    """All spans of a text, in order: of those rules whose keys are in the array `todo`, or of all."""
    none = F.array().cast(_SPANS)
    each = [rule_spans(text, r, k) for k, r in enumerate(rules)]
    if todo is not None:
        each = [F.when(F.array_contains(todo, r.key), s).otherwise(none) for r, s in zip(rules, each)]
    return F.array_sort(F.concat(*each).cast(_SPANS))


def joined(spans: Column, names: Sequence[str]) -> Column:
    """The spans of the rules of some names as `name:start:end`, comma-joined."""
    name = lambda s: F.substring_index(s["rule"], "@", 1)
    own = F.filter(spans, lambda s: name(s).isin(*names))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["until"].cast("string"))), ",")


class Ledger:
    """A ledger in a folder that Spark reads and writes; a new folder is an empty ledger."""

    def __init__(self, spark: SparkSession, folder: str, rules: Sequence[Rule] = RULES):
        if len({r.name for r in rules}) < len(rules) or any(set("@:,") & set(r.name) for r in rules):
            raise ValueError("rules need different names without any of @ : ,")
        self.spark, self.folder, self.rules = spark, folder.rstrip("/"), tuple(rules)

    def _read(self, name: str, schema: str) -> DataFrame:
        """Batches of a table that were written to their end."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/*/_SUCCESS")  # noqa: SLF001
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []  # noqa: SLF001
        batches = [str(s.getPath().getParent()) for s in found]
        return self.spark.read.schema(schema).parquet(*batches) if batches else self.spark.createDataFrame([], schema)

    def versions(self, path: str = "string", version: str = "string") -> DataFrame:
        """(path, version, blob) of all batches; give the types of path and version that were added."""
        return self._read("versions", f"path {path}, version {version}, blob binary")

    def scans(self) -> DataFrame:
        """(blob, rules, spans): a row for each batch in which a blob had rules to run."""
        return self._read("scans", f"blob binary, rules array<string>, spans {_SPANS}")

    def pending(self, addresses: DataFrame) -> DataFrame:
        """(path, version, blob, todo): for each blob that lacks scans, one place where its text is and
        the rules to run."""
        first = addresses.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("at"))
        done = self.scans().groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("done"))
        keys = F.array(*[F.lit(r.key) for r in self.rules])
        todo = F.array_except(keys, F.coalesce("done", F.array().cast("array<string>"))).alias("todo")
        return first.join(done, "blob", "left").select("at.path", "at.version", "blob", todo).where(F.size("todo") > 0)

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds the versions of a batch (path, version, text) and scans what is unseen of it; gives the
        batch's (path, version, blob)."""
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        rows = batch.select("path", "version", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("blob"))
        name = uuid.uuid4().hex
        rows.drop("text").write.parquet(f"{self.folder}/versions/{name}")
        addresses = self.spark.read.schema(rows.drop("text").schema).parquet(f"{self.folder}/versions/{name}")
        todo = self.pending(addresses).hint("shuffle_hash").alias("p")
        same = F.col("t.path").eqNullSafe(F.col("p.path")) & F.col("t.version").eqNullSafe(F.col("p.version")) & (F.col("t.blob") == F.col("p.blob"))
        texts = rows.alias("t").join(todo, same).select("p.blob", "p.todo", "t.text")
        found = texts.select("blob", F.col("todo").alias("rules"), text_spans(F.col("text"), self.rules, F.col("todo")).alias("spans"))
        # a row that is repeated as a whole is scanned as often, and written once
        found.groupBy("blob").agg(F.first("rules").alias("rules"), F.first("spans").alias("spans")).write.parquet(f"{self.folder}/scans/{name}")
        return addresses

    def report(self, versions: DataFrame) -> DataFrame:
        """versions (..., blob) with `spans`: what the ledger's rules, in the versions it has now, found."""
        keys, place = [r.key for r in self.rules], F.create_map(*[F.lit(x) for k, r in enumerate(self.rules) for x in (r.key, k)])
        own = F.transform(F.filter("spans", lambda s: s["rule"].isin(*keys)), lambda s: F.struct(s["start"], F.element_at(place, s["rule"]).alias("place"), s["rule"], s["until"]))
        found = self.scans().select("blob", own.alias("spans")).where(F.size("spans") > 0)
        found = found.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
        return versions.join(found, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(_SPANS)))


def scan(documents: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(doc_id, n_<name> for each base rule, base_sha256, spans) of every document, by a new ledger."""
    ledger = Ledger(documents.sparkSession, f"{common.shared_dir(documents.sparkSession)}/secrets-{uuid.uuid4().hex}", rules)
    added = ledger.add(documents.select(F.col("doc_id").alias("path"), F.lit(0).alias("version"), "text"))
    base, names = [r.name for r in BASE], [r.name for r in rules]
    count = lambda name: F.size(F.filter("spans", lambda s: F.substring_index(s["rule"], "@", 1) == name)).cast("long").alias(f"n_{name}")
    return ledger.report(added).select(F.col("path").alias("doc_id"), *[count(b) for b in base], F.sha2(joined(F.col("spans"), base), 256).alias("base_sha256"), joined(F.col("spans"), names).alias("spans"))


def _sql() -> str:
    """DuckDB SQL of scan(); letters in either case are spelled out, as engines fold case differently."""
    either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    words = "|".join(either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    patterns = [r.pattern.replace("(?i:(password|passwd|secret|token|api_?key))", f"({words})").replace("'", "''") for r in RULES]
    each = "\nUNION ALL\n".join(
        f"SELECT doc_id, row, {k} AS place, '{r.name}' AS kind, {r.shortest} AS shortest, regexp_split_to_array(text, '{p}') AS gaps, regexp_extract_all(text, '{p}', 0) AS own, regexp_extract_all(text, '{p}', {r.group}) AS part FROM d"
        for k, (r, p) in enumerate(zip(RULES, patterns))
    )
    base = ", ".join(f"'{r.name}'" for r in BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.name}') AS n_{r.name}" for r in BASE)
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents),
m AS ({each}),
s AS (
  SELECT row, place, kind, shortest, unnest(range(1, len(own) + 1)) AS i, list_transform(gaps, lambda x: length(x)) AS gaps, list_transform(own, lambda x: length(x)) AS own, part FROM m),
e AS (SELECT row, place, kind, CAST(list_sum(gaps[1:i]) + coalesce(list_sum(own[1:i - 1]), 0) AS BIGINT) AS start, own[i] AS n FROM s WHERE length(part[i]) >= shortest),
t AS (SELECT row, place, kind, start, concat(kind, ':', start, ':', start + n) AS span FROM e),
g AS (
  SELECT row, {counts}, string_agg(span, ',' ORDER BY start, place) FILTER (kind IN ({base})) AS base, string_agg(span, ',' ORDER BY start, place) AS spans
  FROM t GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{r.name}, 0) AS n_{r.name}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.row = g.row
""".strip()


ORACLE_SQL = _sql()
