"""Population stability index of features between an early and a late window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagerisk import params as P
from vintagerisk.operators.prefix import exact_quantiles


def to_long(df: DataFrame, features: list[str], late: Column) -> DataFrame:
    pairs = ", ".join(f"'{f}', cast(`{f}` as double)" for f in features)
    return (
        df.withColumn("is_late", late.cast("boolean"))
        .selectExpr("is_late", f"stack({len(features)}, {pairs}) AS (feature, value)")
        .where("value IS NOT NULL AND NOT isnan(value)")
    )


def reading(psi: str) -> Column:
    low, high = P.PSI_CUTS
    return F.expr(
        f"CASE WHEN {psi} IS NULL THEN 'insufficient data' WHEN {psi} < {low}D THEN 'stable' "
        f"WHEN {psi} < {high}D THEN 'moderate shift' ELSE 'material shift' END"
    )


def psi_by_feature(df: DataFrame, features: list[str], late: Column, buckets: int = P.PSI_BUCKETS) -> DataFrame:
    """PSI of every feature in one pass: decile edges of the early window, shares in both windows.

    Edges are one small array per feature, so counting goes through a broadcast and one
    partially aggregated shuffle.
    """
    long = to_long(df, features, late)
    probabilities = [i * (1.0 / buckets) for i in range(buckets)] + [1.0]
    cuts = (
        exact_quantiles(long.where("NOT is_late"), ["feature"], "value", probabilities)
        .groupBy("feature").agg(F.array_sort(F.collect_set("quantile")).alias("edges"))
        .withColumn("inner", F.expr("slice(edges, 2, greatest(size(edges) - 2, 0))"))
    )
    counted = (
        long.join(F.broadcast(cuts), "feature")  # one row per feature
        .withColumn("bucket", F.expr("size(filter(inner, e -> e <= value))"))
        .groupBy("feature", "edges", "bucket")
        .agg(F.count_if(~F.col("is_late")).alias("early"), F.count_if("is_late").alias("late"))
    )
    every = cuts.selectExpr("feature", "edges", "explode(sequence(0, size(inner))) AS bucket")
    floor = f"{P.PSI_FLOOR!r}D"
    shares = (
        every.join(counted.drop("edges"), ["feature", "bucket"], "left")
        .selectExpr("feature", "edges", "coalesce(early, 0) AS early", "coalesce(late, 0) AS late")
        .selectExpr(
            "feature", "edges",
            f"greatest(early / cast(sum(early) OVER (PARTITION BY feature) as double), {floor}) AS e",
            f"CASE WHEN sum(late) OVER (PARTITION BY feature) > 0 THEN greatest(late / cast(sum(late) OVER (PARTITION BY feature) as double), {floor}) END AS a",
        )
    )
    per_feature = shares.groupBy("feature").agg(
        F.max(F.size("edges")).alias("n_edges"), F.sum(F.expr("(a - e) * ln(a / e)")).alias("raw")
    )
    named = df.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return (
        named.join(per_feature, "feature", "left")
        .withColumn("psi", F.expr("CASE WHEN raw IS NULL THEN NULL WHEN n_edges < 3 THEN 0D ELSE raw END"))
        .select("feature", "psi", reading("psi").alias("reading"))
    )
