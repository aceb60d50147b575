"""Statistics of features and scores of classifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows are actual regimes, columns predicted ones.
RISK_COST = ((0.0, 1.0, 3.0, 1.0), (4.0, 0.0, 4.0, 2.0), (8.0, 10.0, 0.0, 10.0), (5.0, 2.0, 4.0, 0.0))


def feature_stats(df: DataFrame, columns: Sequence[str], label: str | None = None) -> DataFrame:
    """(feature, min_value, max_value, mean_value) over labelled rows, in one pass."""
    src = df if label is None else df.where(F.col(label) != -1)
    row = src.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])
    stack = ", ".join(f"'{c}', min_{c}, max_{c}, mean_{c}" for c in columns)
    return row.selectExpr(f"stack({len(columns)}, {stack}) AS (feature, min_value, max_value, mean_value)")


def confusion(df: DataFrame, actual: str, predicted: str, classes: int = 4) -> DataFrame:
    """(actual, predicted, n) of rows whose classes are both known."""
    ok = F.col(actual).between(0, classes - 1) & F.col(predicted).between(0, classes - 1)
    return df.where(ok).groupBy(F.col(actual).cast("int").alias("actual"), F.col(predicted).cast("int").alias("predicted")).agg(F.count("*").alias("n"))


def _share(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def class_scores(df: DataFrame, actual: str, predicted: str, classes: int = 4) -> DataFrame:
    """(class_id, support, precision, recall, f1, accuracy): zero where a denominator is zero;
    accuracy is over all rows, unknown classes included. One pass of conditional sums."""
    a, p = F.col(actual), F.col(predicted)
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    cells = [x for k in range(classes) for x in (one((a == k) & (p == k)).alias(f"tp{k}"), one((a == k) & p.between(0, classes - 1)).alias(f"s{k}"), one((p == k) & a.between(0, classes - 1)).alias(f"q{k}"))]
    row = df.agg(F.count("*").alias("n"), *cells)
    hits = sum((F.col(f"tp{k}") for k in range(1, classes)), F.col("tp0"))
    rows = F.array(*[F.struct(F.lit(k).alias("class_id"), F.col(f"s{k}").alias("support"), F.col(f"tp{k}").alias("tp"), F.col(f"q{k}").alias("q")) for k in range(classes)])
    out = row.select(_share(hits, F.col("n")).alias("accuracy"), F.explode(rows).alias("r")).select("accuracy", "r.*")
    out = out.withColumn("precision", _share(F.col("tp"), F.col("q"))).withColumn("recall", _share(F.col("tp"), F.col("support")))
    f1 = _share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.select("class_id", "support", "precision", "recall", f1.alias("f1"), "accuracy")


def valid_accuracy(df: DataFrame, actual: str, predicted: str, classes: int = 4) -> DataFrame:
    """(class_id, n, hits, accuracy, overall): rows with an unknown actual class are left out."""
    src = df.where(F.col(actual).between(0, classes - 1))
    per = src.groupBy(F.col(actual).cast("int").alias("class_id")).agg(F.count("*").alias("n"), F.sum((F.col(actual) == F.col(predicted)).cast("long")).alias("hits"))
    whole = per.agg(F.sum("hits").alias("h"), F.sum("n").alias("m"))  # one row
    return per.join(F.broadcast(whole)).select("class_id", "n", "hits", _share(F.col("hits"), F.col("n")).alias("accuracy"), _share(F.col("h"), F.col("m")).alias("overall"))


def trading_risk(cells: DataFrame, cost: Sequence[Sequence[float]] = RISK_COST) -> DataFrame:
    """(risk): mean cost of a row of a confusion table; 0 if it is empty."""
    c = F.element_at(F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in cost])[F.col("actual")], F.col("predicted") + 1)
    row = cells.agg(F.sum(F.col("n") * c).alias("s"), F.sum("n").alias("n"))
    return row.select(F.when(F.coalesce("n", F.lit(0)) == 0, 0.0).otherwise(F.col("s") / F.col("n")).alias("risk"))


def recall_pivot(df: DataFrame, model: str = "model_id", class_col: str = "class_id", recall: str = "recall") -> DataFrame:
    """(model, recall_1, recall_2) in percent, 0 where a model has no such class."""
    at = lambda k: F.coalesce(F.max(F.when(F.col(class_col) == k, F.col(recall) * 100)), F.lit(0.0)).alias(f"recall_{k}")
    return df.groupBy(model).agg(at(1), at(2))


def clean_model_id(x: Column) -> Column:
    return F.substring_index(x, "_AutoML_", 1)
