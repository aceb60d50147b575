"""Files of quotes, datasets and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTE_SCHEMA = "ts_text string, bid_open double, bid_high double, bid_low double, bid_close double, ask_open double, ask_high double, ask_low double, extra double, ask_close double"
#: Columns of a dataset file, and of the labelled export with their names there.
DATASET = ("usdjpy_price", "usdjpy_atr", "usdjpy_er", "us_bond_level", "jp_bond_level", "wti_oil", "atr_delta", "er_delta", "yield_spread_delta", "eurusd_atr", "audjpy_atr", "eurjpy_atr")
EXPORT = ("usdjpy_price", "usdjpy_atr", "usdjpy_er", "eurusd_atr", "audjpy_atr", "eurjpy_atr", "us_bond_level", "jp_bond_level", "wti_oil", "yield_spread_delta", "atr_delta", "er_delta")
METRICS_SCHEMA = "Model_ID string, Class int, Precision double, Recall double, F1_Score double, Overall_Accuracy double"


def quotes(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """(ts, symbol, mid) of a positional quote file: the header is skipped, rows without a readable
    time or price are left out, and of rows of one time the last of the file stays."""
    raw = spark.read.csv(path, schema=QUOTE_SCHEMA, header=True, enforceSchema=True)
    raw = raw.withColumn("_order", F.monotonically_increasing_id())  # rises within a file
    ts = F.try_to_timestamp("ts_text", F.lit("yyyyMMdd HH:mm:ss")).cast("timestamp_ntz")
    df = raw.select(ts.alias("ts"), ((F.col("bid_close") + F.col("ask_close")) / 2).alias("mid"), "_order").where("ts IS NOT NULL AND mid IS NOT NULL")
    return df.groupBy("ts").agg(F.max_by("mid", "_order").alias("mid")).select("ts", F.lit(symbol).alias("symbol"), "mid")


def in_hours(df: DataFrame, start, end) -> DataFrame:
    from ..operators.features import at_top_of_hour

    return at_top_of_hour(df, start, end)


def dataset(spark: SparkSession, path: str, columns: Sequence[str] = DATASET) -> DataFrame:
    """A dataset file by its header, whose names are trimmed and taken without regard to case. A
    missing column or a blank cell is 0; a row with any other cell that can't be read is left out."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    raw = raw.toDF(*[c.strip().upper() for c in raw.columns])
    time = F.coalesce(F.try_to_timestamp("TIMESTAMP", F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp("TIMESTAMP", F.lit("yyyy-MM-dd'T'HH:mm"))).cast("timestamp_ntz")
    cells, readable = [time.alias("ts")], time.isNotNull()
    for c in columns:
        if c.upper() not in raw.columns:
            cells.append(F.lit(0.0).alias(c))
            continue
        text = F.trim(F.coalesce(F.col(c.upper()), F.lit("")))
        number = text.try_cast("double")
        cells.append(F.when(text == "", 0.0).otherwise(number).alias(c))
        readable &= (text == "") | number.isNotNull()
    return raw.where(readable).select(*cells)


def export_labelled(df: DataFrame, path: str) -> bool:
    """Writes labelled rows as CSV with the label last; writes nothing where there are none."""
    rows = df.where("label <> -1")
    if rows.isEmpty():
        return False
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("Timestamp")
    rows.select(stamp, *[F.col(c).alias(c.upper()) for c in EXPORT], F.col("label").alias("LABEL")).write.mode("overwrite").csv(path, header=True)
    return True


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """(model_id, class_id, precision, recall, f1, accuracy) of a metrics file."""
    df = spark.read.csv(path, schema=METRICS_SCHEMA, header=True)
    return df.toDF("model_id", "class_id", "precision", "recall", "f1", "accuracy")


def export_metrics(df: DataFrame, path: str) -> None:
    """One row for each model and class, numbers with five decimals."""
    num = [F.format_string("%.5f", F.col(c)).alias(n) for c, n in (("precision", "Precision"), ("recall", "Recall"), ("f1", "F1_Score"), ("accuracy", "Overall_Accuracy"))]
    df.select(F.col("model_id").alias("Model_ID"), F.col("class_id").alias("Class"), *num).write.mode("overwrite").csv(path, header=True)


def last_of_hour(df: DataFrame, value: str, order: Sequence[str], ts: str = "ts", by: Sequence[str] = ()) -> DataFrame:
    """(by, ts, price): the last value of each hour in a full order."""
    w = Window.partitionBy(*by, "_h").orderBy(*[F.desc(c) for c in order])
    df = df.withColumn("_h", F.date_trunc("hour", ts).cast("timestamp_ntz")).withColumn("_k", F.row_number().over(w))
    return df.where("_k = 1").select(*by, F.col("_h").alias(ts), F.col(value).alias("price"))
