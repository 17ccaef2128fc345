"""AUC, Gini, KS and ROC points, all read from one ladder of distinct scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintagerisk.operators.prefix import score_ladder


def separation(ladder: DataFrame) -> DataFrame:
    """One row from a score ladder: classes, AUC with ties counted half, Gini and KS; NULL when only one class is present."""
    pairs = F.sum(F.col("pos") * (F.col("neg_before") + 0.5 * F.col("neg")))
    gap = F.expr("abs((pos_before + pos) / nullif(cast(pos_total as double), 0D) - (neg_before + neg) / nullif(cast(neg_total as double), 0D))")
    return (
        ladder.agg(pairs.alias("pairs"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.max(gap).alias("ks"))
        .selectExpr("n_pos", "n_neg", "pairs / nullif(cast(n_pos as double) * n_neg, 0D) AS auc", "ks")
        .selectExpr("n_pos", "n_neg", "auc", "2 * auc - 1 AS gini", "ks")
    )


def auc(scored: DataFrame, score: str = "p", y: str = "y") -> DataFrame:
    return separation(score_ladder(scored, score, y)).drop("ks")


def ks_statistic(scored: DataFrame, score: str = "p", y: str = "y") -> DataFrame:
    """Largest gap between the cumulative score distributions of the two classes."""
    return separation(score_ladder(scored, score, y)).select("ks")


def roc_points(scored: DataFrame, score: str = "p", y: str = "y") -> DataFrame:
    """Points of the ROC curve from strict to lenient thresholds, starting at (0, 0)."""
    return roc_of(score_ladder(scored, score, y))


def roc_of(ladder: DataFrame) -> DataFrame:
    points = ladder.selectExpr(
        "score AS threshold",
        "(neg_total - neg_before) / nullif(cast(neg_total as double), 0D) AS fpr",
        "(pos_total - pos_before) / nullif(cast(pos_total as double), 0D) AS tpr",
    )
    start = ladder.sparkSession.sql("SELECT cast(NULL AS double) AS threshold, 0D AS fpr, 0D AS tpr")
    return points.unionByName(start)
