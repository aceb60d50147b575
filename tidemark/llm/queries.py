"""The registered queries of the corpus operators, one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, chat, common, decontaminate, langid, langmodel, media, packing, resample, secrets, simhash, suffix, toxicity, warc


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.ship(spark)
    return media.documents_as_media(common.table(spark, sf_dir, "documents"))


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.ship(spark)
    return suffix.repeats(common.table(spark, sf_dir, "documents")).drop("spans")


def op3_langmodel(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.ship(spark)
    docs = common.table(spark, sf_dir, "documents")
    held = common.crc_mod("doc_id", 10) == 0
    weights = langmodel.train(docs.where(~held))
    return langmodel.score(docs, weights, held)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.ship(spark)
    docs = common.table(spark, sf_dir, "documents")
    labels = common.table(spark, sf_dir, "labels").where(common.crc_mod("doc_id", 3) != 1)
    p = toxicity.Params()
    out = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels, params=p))
    return out.select("doc_id", (common.crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.ship(spark)
    docs = common.table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(common.crc_mod("doc_id", 3) != 1))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (common.crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.ship(spark)
    return simhash.simhash_components(common.table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.ship(spark)
    return packing.pack(common.table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.ship(spark)
    return decontaminate.matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.ship(spark)
    return warc.pages_to_warc(common.table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preferences(common.table(spark, sf_dir, "conversations"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(common.table(spark, sf_dir, "documents"))


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.ship(spark)
    return resample.resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_media": op1_media,
    "op2_suffix": op2_suffix,
    "op3_langmodel": op3_langmodel,
    "op4_toxicity": op4_toxicity,
    "op5_langid": op5_langid,
    "op6_simhash": op6_simhash,
    "op7_packing": op7_packing,
    "op8_decontaminate": op8_decontaminate,
    "op9_warc": op9_warc,
    "op10_chat": op10_chat,
    "op11_secrets": op11_secrets,
    "op12_audit": op12_audit,
    "op13_resample": op13_resample,
}
ORACLE_SQL: dict[str, str] = {"op2_suffix": suffix.ORACLE_SQL, "op9_warc": warc.ORACLE_SQL, "op10_chat": chat.ORACLE_SQL, "op11_secrets": secrets.ORACLE_SQL, "op12_audit": audit.ORACLE_SQL, "op13_resample": resample.ORACLE_SQL}
