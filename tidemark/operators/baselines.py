"""Reference classifiers from the machine-learning library, for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def boosted_trees(train: DataFrame, trees: int = 20, depth: int = 5, step: float = 0.1, sample: float = 0.63, seed: int = 42):
    """Gradient boosting for several classes, one against the rest; takes (features, label)."""
    from pyspark.ml.classification import GBTClassifier, OneVsRest

    gbt = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=sample, seed=seed)
    return OneVsRest(classifier=gbt).fit(train.withColumn("label", F.col("label").cast("double")))


def model_search(train: DataFrame, folds: int = 5, seed: int = 42, metric: str = "accuracy", depths: tuple[int, ...] = (3, 5)):
    """The best of a linear model, a forest and boosted trees by cross-validation; returns the
    name, the score and the fitted model."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    data = train.withColumn("label", F.col("label").cast("double"))
    evaluator = MulticlassClassificationEvaluator(metricName=metric)
    found, ovr = [], OneVsRest()
    trees = [GBTClassifier(maxIter=20, maxDepth=d, stepSize=0.1, subsamplingRate=0.63, seed=seed) for d in depths]
    for name, est, grid in (
        ("linear", lr := LogisticRegression(maxIter=50), ParamGridBuilder().addGrid(lr.regParam, [0.0, 0.01]).build()),
        ("forest", rf := RandomForestClassifier(numTrees=20, seed=seed), ParamGridBuilder().addGrid(rf.maxDepth, [4, 8]).build()),
        ("boosted", ovr, ParamGridBuilder().addGrid(ovr.classifier, trees).build()),
    ):
        cv = CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=evaluator, numFolds=folds, seed=seed).fit(data)
        found.append((max(cv.avgMetrics), name, cv.bestModel))
    score, name, model = max(found, key=lambda x: x[0])
    return name, score, model
