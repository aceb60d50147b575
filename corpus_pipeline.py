"""The corpus pipeline: toxicity, near-dedup, repeats, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its
result is written and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, decontaminate, packing, simhash, suffix, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score reaches 0.7. The classifier learns from the labels of
    all folds but one, as its own query does; labels are not used to decide. Null and empty texts get
    the classifier's intercept and stay, unless most labelled documents are toxic; without labels
    every document gets the same middling score and stays; rows with a null id stay if their text does."""
    common.ship(spark)
    labels = common.table(spark, sf_dir, "labels").where(common.crc_mod("doc_id", 3) != 1)
    p = toxicity.Params()
    scored = toxicity.score(_documents(docs), toxicity.fit(docs, labels, params=p))
    return _documents(scored.where(F.col("score") < p.threshold))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of copies and near copies (five-word
    shingles, similarity 0.8). Documents without an id are kept; those without a word are copies of
    one another; rows that share an id stay or go together."""
    common.ship(spark)
    with common.scratch(spark) as keep:
        # written first, so that its size decides whether the join below broadcasts it
        copies = keep(simhash.near_groups(docs).where("component_id < doc_id").select("doc_id").distinct(), "near-copies")
    return _documents(docs.join(copies, "doc_id", "left_anti"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 50 bytes or more that a document of a smaller id holds, and then
    documents of which nothing is left. n_chars is that of the text that is left. Null texts and texts
    that were empty before stay, and so do rows without an id."""
    common.ship(spark)
    known = _documents(docs).withColumn("had", F.length("text") > 0)
    kept = suffix.repeats(known, output="text", extra=("lang", "source", "n_chars", "had"))
    kept = kept.where(F.col("text").isNull() | (F.length("text") > 0) | ~F.col("had"))
    return _documents(kept.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item or an edited copy of one. Null and empty texts hold
    none; rows without an id are kept."""
    common.ship(spark)
    found = common.materialize(decontaminate.matches(docs, common.table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    return _documents(docs.join(found, "doc_id", "left_anti"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens: one row per piece. A null or empty text is the
    end token alone; repeated rows are packed each; a null id stays null."""
    common.ship(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_dedup", drop_repeats),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: SQL can't express the learnt and hashed stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is a Parquet table in the shared folder."""
    common.ship(spark)
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialize(docs, name)
    return docs
