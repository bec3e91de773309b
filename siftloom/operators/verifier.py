"""Pair verifier: scaling, logistic scores, threshold calibration, and a model refitted on the history of labelled pairs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftloom.operators.features import FEATURES
from siftloom.sources import files


def feature_scales(training: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """One row: each column's population deviation, 1 where it is 0; columns are scaled, not centred."""
    one = lambda c: F.when(F.coalesce(F.stddev_pop(c), F.lit(0.0)) > 0, F.stddev_pop(c)).otherwise(F.lit(1.0)).alias(c)
    return training.agg(*(one(c) for c in columns))


def logistic_score(weights: dict[str, float], bias: float) -> Column:
    """1 / (1 + exp(-(w x + b)))."""
    total = F.lit(float(bias))
    for name, w in weights.items():
        total = total + F.lit(float(w)) * F.col(name)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def youden_threshold(scored: DataFrame) -> DataFrame:
    """(threshold, low, high) of (score, y): the score with the greatest true minus false positive rate, the greatest such score, 0.5 at least.

    With one class only it is 0.5. The bands are 0.05 to both sides within 0 and 1. Sums run over distinct scores.
    """
    by_score = scored.groupBy("score").agg(F.sum((F.col("y") == 1).cast("long")).alias("pos"), F.sum((F.col("y") != 1).cast("long")).alias("neg"))
    down = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rates = by_score.select("score", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"), F.sum("pos").over(every).alias("p"), F.sum("neg").over(every).alias("n"))
    gain = F.col("tp") * F.col("n") - F.col("fp") * F.col("p")
    best = rates.agg(F.max(F.struct(gain.alias("g"), "score")).alias("best"), F.max("p").alias("p"), F.max("n").alias("n"))
    # no score may beat labelling nothing: the curve's first point, which stands for "no pair"
    t = F.when((F.coalesce("p", F.lit(0)) == 0) | (F.coalesce("n", F.lit(0)) == 0), F.lit(0.5)).otherwise(F.greatest(F.when(F.col("best.g") > 0, F.col("best.score")).otherwise(F.lit(1.0)), F.lit(0.5)))
    return best.select(t.alias("threshold")).select("threshold", F.greatest(F.col("threshold") - 0.05, F.lit(0.0)).alias("low"), F.least(F.col("threshold") + 0.05, F.lit(1.0)).alias("high"))


class Verifier:
    """A logistic model over FEATURES, refitted on all labelled pairs so far: the same history gives the same model."""

    def __init__(self, weights: dict[str, float], bias: float, threshold: float, updates: int, pairs: int):
        self.weights, self.bias, self.threshold, self.updates, self.pairs = weights, bias, threshold, updates, pairs

    @classmethod
    def fit(cls, history: DataFrame, penalty: float = 1e-4, previous: Verifier | None = None) -> Verifier | None:
        """Fit on rows of FEATURES, y and w; None (or `previous`) if there is nothing or one class to learn from."""
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import VectorAssembler

        if history.select("y").distinct().count() < 2:
            return previous
        scales = feature_scales(history).first().asDict()
        scaled = history.select("y", "w", *((F.col(c) / scales[c]).alias(c) for c in FEATURES))
        data = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(scaled)
        model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=penalty, standardization=False).fit(data)
        weights = {c: float(v) / scales[c] for c, v in zip(FEATURES, model.coefficients, strict=True)}
        out = cls(weights, float(model.intercept), 0.5, (previous.updates if previous else 0) + 1, history.count())
        out.threshold = float(youden_threshold(out.score(history).select(F.col("p").alias("score"), "y")).first()["threshold"])
        return out

    def score(self, features: DataFrame) -> DataFrame:
        return features.withColumn("p", logistic_score(self.weights, self.bias))

    def save(self, spark: SparkSession, path: str) -> None:
        """One JSON line, replacing what is there."""
        spark.createDataFrame([(json.dumps(vars(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Verifier | None:
        """None where there is no model or one over other features."""
        if not files.exists(spark, path):
            return None
        state = json.loads(spark.read.text(path).first()["value"])
        return cls(**state) if set(state["weights"]) == set(FEATURES) else None

    def remember(self, fresh: DataFrame, path: str) -> None:
        """Keep the labelled rows that this update has added, for the next run's fit. Each update has a folder of its own, so nothing is rewritten."""
        fresh.write.mode("overwrite").parquet(f"{path}-history/update={self.updates}")

    @staticmethod
    def history(spark: SparkSession, path: str) -> DataFrame | None:
        """All labelled rows that were kept beside the model; None where there are none."""
        return spark.read.parquet(f"{path}-history").drop("update") if files.exists(spark, f"{path}-history") else None
