"""The FX graph: vertices with their encodings, and weighted edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Vertex, importance, codebook (kind, low, high, levels), source column.
_ATR = ("linear", 0.0001, 0.008, 20)
VERTICES = (
    ("USDJPY_PRICE", 1.1, ("linear", -0.50, 0.50, 50), "usdjpy_price"),
    ("USDJPY_ATR", 1.2, _ATR, "usdjpy_atr"),
    ("US_BOND_LEVEL", 0.83, ("linear", 50.0, 120.0, 40), "us_bond_level"),
    ("JP_BOND_LEVEL", 0.84, ("linear", 40.0, 70.0, 40), "jp_bond_level"),
    ("WTI_OIL", 0.75, ("linear", 10.0, 130.0, 30), "wti_oil"),
    ("ATR_DELTA", 0.96, ("linear", -0.002, 0.002, 20), "atr_delta"),
    ("ER_DELTA", 0.97, ("linear", -1.0, 1.0, 20), "er_delta"),
    ("YIELD_SPREAD_DELTA", 0.98, ("linear", -4.0, 5.0, 20), "yield_spread_delta"),
    ("EURUSD_ATR", 0.71, _ATR, "eurusd_atr"),
    ("AUDJPY_VOL", 0.82, _ATR, "audjpy_atr"),
    ("USD_NEWS_SHOCK", 0.91, ("fixed", 0.0, 3.0, 4), "news_level"),
)
EDGES = (
    ("US_BOND_LEVEL", "USDJPY_PRICE", 0.81),
    ("JP_BOND_LEVEL", "USDJPY_PRICE", 0.82),
    ("YIELD_SPREAD_DELTA", "USDJPY_PRICE", 0.953),
    ("WTI_OIL", "USDJPY_PRICE", 0.74),
    ("ER_DELTA", "USDJPY_PRICE", 0.855),
    ("ATR_DELTA", "USDJPY_PRICE", 0.756),
    ("USDJPY_ATR", "USDJPY_PRICE", 0.77),
    ("USD_NEWS_SHOCK", "USDJPY_PRICE", 0.88),
    ("YIELD_SPREAD_DELTA", "USDJPY_ATR", 0.87),
    ("ATR_DELTA", "USDJPY_ATR", 0.97),
    ("AUDJPY_VOL", "USDJPY_ATR", 0.856),
    ("EURUSD_ATR", "USDJPY_ATR", 0.757),
    ("USDJPY_PRICE", "USDJPY_ATR", 0.64),
    ("USD_NEWS_SHOCK", "USDJPY_ATR", 0.96),
    ("YIELD_SPREAD_DELTA", "ER_DELTA", 0.623),
    ("USD_NEWS_SHOCK", "YIELD_SPREAD_DELTA", 0.843),
)


def vertices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(v, i) for v, i, _, _ in VERTICES], "vertex string, importance double")


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, d, w) for s, d, w in EDGES], "src string, dst string, importance double")


def levels(df: DataFrame, key: str = "ts") -> DataFrame:
    """(sample, vertex, level): the codebook level of each vertex for each assembled row. Only
    level indices travel; vectors are looked up where they are used."""
    from pyspark.sql import functions as F

    from ..functions import codebooks

    parts = []
    for v, _, (kind, low, high, n), column in VERTICES:
        c = F.col(column)
        level = codebooks.clamp_level(c, n) if kind == "fixed" else codebooks.bucket(c, low, high, n)
        parts.append(F.struct(F.lit(v).alias("vertex"), level.alias("level")))
    return df.select(F.col(key).alias("sample"), F.explode(F.array(*parts)).alias("x")).select("sample", "x.vertex", "x.level")


def codes(spark: SparkSession, seed: int = 34) -> DataFrame:
    """(vertex, level, code): the stored codebooks of all vertices; shared encodings share codes."""
    from functools import reduce

    from ..functions import codebooks

    tables, known = [], {}
    for k, (v, _, spec, _) in enumerate(VERTICES):
        if spec not in known:
            known[spec] = codebooks.fixed_levels(spec[3], seed + k) if spec[0] == "fixed" else codebooks.linear_levels(spec[3], seed + k)
        tables.append(codebooks.table(spark, known[spec], vertex=v))
    return reduce(DataFrame.unionByName, tables)


def encode(levels_table: DataFrame, code_table: DataFrame) -> DataFrame:
    """(sample, vertex, layer, hv): layer-0 vectors by a lookup of (vertex, level). The codebooks
    have a few hundred rows and are broadcast."""
    from pyspark.sql import functions as F

    found = levels_table.join(F.broadcast(code_table), ["vertex", "level"])
    return found.select("sample", "vertex", F.lit(0).alias("layer"), F.col("code").alias("hv"))
