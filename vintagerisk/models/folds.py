"""Stratified group folds: every issuer sits in one fold per repeat, positives spread evenly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintagerisk import params as P
from vintagerisk.functions.hashing import MODULUS, mix
from vintagerisk.operators.prefix import range_count, running_totals


def fold_count(rows: DataFrame, group: str = "group_id", y: str = "y", folds: int = P.CV_FOLDS) -> int:
    """As many folds as asked for, but never more than there are groups with a positive (and at least two)."""
    positive = rows.where(F.col(y) == 1).agg(F.count_distinct(group)).first()[0]
    return min(folds, max(positive, 2))


def group_folds(rows: DataFrame, k: int, repeats: int = 1, seed: int = P.SEED, group: str = "group_id", y: str = "y") -> DataFrame:
    """(group, repeat, fold).  Groups are dealt round-robin in hash order within each stratum.

    The hash is uniform, so its equal-width ranges are balanced and the rank in a stratum
    comes from running totals over ranges instead of one sorted task.
    """
    groups = rows.groupBy(group).agg(F.max(y).cast("int").alias("stratum"))
    dealt = (
        groups.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        .withColumn("h", mix(F.col(group), F.col("repeat") + 1, seed))
        .withColumn("one", F.lit(1).cast("bigint"))
    )
    ranges = range_count(groups.count() * repeats)
    splits = [i * MODULUS / ranges for i in range(1, ranges)]
    ranked = running_totals(dealt, "h", ["one"], splits, by=["repeat", "stratum"], order=f"h, {group}")
    return ranked.select(group, "repeat", (F.col("one_before") % k).cast("int").alias("fold"))


def held_out(rows: DataFrame, folds: DataFrame, group: str = "group_id") -> DataFrame:
    """Attach `hold`: per repeat, the fold this row is tested in (one small array per group)."""
    arrays = folds.groupBy(group).agg(F.expr("transform(array_sort(collect_list(struct(repeat, fold))), s -> s.fold)").alias("hold"))
    return rows.join(arrays, group)
