"""Gradient-boosting challenger on MLlib, one fit; `histogram.py` has the held-out fits.

Missing values keep their meaning through an indicator column next to a sentinel.  MLlib
trees have no L2 term on leaf values, so probabilities differ from a ridge-shrunken
booster; depth, rounds, step and leaf size are the same.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintagerisk import params as P
from vintagerisk.sources.storage import ensure_checkpoints

SENTINEL = -1e6


def class_weights(rows: DataFrame, y: str = "y") -> DataFrame:
    """Balanced weight per class: all rows over twice the rows of the class (never below one row)."""
    counts = rows.groupBy(F.col(y).cast("int").alias("y")).agg(F.count("*").alias("n"))
    # two rows: a window without partition is safe
    return counts.selectExpr("y", "n", "cast(sum(n) OVER () as double) / (2D * greatest(n, 1)) AS weight")


def with_class_weight(rows: DataFrame, y: str = "y") -> DataFrame:
    return rows.join(F.broadcast(class_weights(rows, y).select(F.col("y").alias(y), "weight")), y)  # two rows


def _vectors(rows: DataFrame, features: list[str]) -> DataFrame:
    filled = rows.selectExpr(
        "*", *[f"coalesce({f}, {SENTINEL!r}D) AS v_{f}" for f in features], *[f"cast({f} IS NULL as double) AS m_{f}" for f in features]
    )
    names = [f"v_{f}" for f in features] + [f"m_{f}" for f in features]
    return VectorAssembler(inputCols=names, outputCol="x").transform(filled).drop(*names)


def fit_booster(rows: DataFrame, features: list[str] = P.FEATURES, rounds: int = P.GBT_ROUNDS, seed: int = P.SEED):
    ensure_checkpoints(rows.sparkSession)
    booster = GBTClassifier(
        featuresCol="x", labelCol="y", weightCol="weight", maxDepth=P.GBT_DEPTH, maxIter=rounds, stepSize=P.GBT_STEP,
        minInstancesPerNode=P.GBT_MIN_LEAF, maxBins=255, seed=seed, checkpointInterval=10,
    )
    return booster.fit(_vectors(with_class_weight(rows), features))


def predict(model, rows: DataFrame, features: list[str] = P.FEATURES) -> DataFrame:
    scored = model.transform(_vectors(rows, features)).withColumn("gbt_pd", vector_to_array("probability")[1])
    return scored.drop("x", "rawPrediction", "probability", "prediction")
