"""Discrimination, calibration and stability queries over scored obligors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagerisk.functions.numeric import tidy
from vintagerisk.operators import calibration_tests, discrimination, portfolio, stability
from vintagerisk.plans.core import query
from vintagerisk.sources import tape


@query
def q_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(discrimination.auc(tape.scored(spark, sf_dir)), auc=9, gini=9)


@query
def q_ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(discrimination.ks_statistic(tape.scored(spark, sf_dir)), ks=9)


@query
def q_roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(discrimination.roc_points(tape.scored(spark, sf_dir)), threshold=9, fpr=9, tpr=9)


@query
def q_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = calibration_tests.brier_decomposition(tape.scored(spark, sf_dir))
    return tidy(out, brier=9, reliability=9, resolution=9, uncertainty=9)


@query
def q_hosmer_lemeshow(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = calibration_tests.hosmer_lemeshow(tape.scored(spark, sf_dir), n_groups=10)
    return tidy(out, statistic=6, p_value=8)


@query
def q_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On probabilities rounded to one decimal, so a few values are shared by most rows."""
    coarse = tape.scored(spark, sf_dir).withColumn("p", F.round("p", 1))
    fine = calibration_tests.reliability_table(tape.scored(spark, sf_dir)).withColumn("scores", F.lit("fine"))
    tied = calibration_tests.reliability_table(coarse).withColumn("scores", F.lit("tied"))
    return tidy(fine.unionByName(tied), mean_predicted_pd=9, observed_default_rate=9)


@query
def q_annual_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = calibration_tests.annual_backtest(tape.scored(spark, sf_dir), F.col("yr"))
    return tidy(out, expected_defaults=2, z=2)


@query
def q_prior_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = tape.scored(spark, sf_dir)
    rate = scored.agg(F.avg("y")).scalar()
    out = scored.withColumn("rate", rate).withColumn("pd", portfolio.prior_correct("p", "rate", "0.02D"))
    return tidy(out.select("id", "pd"), pd=9)


@query
def q_pd_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = tape.scored(spark, sf_dir)
    return tidy(portfolio.pd_sensitivity(scored, scored.agg(F.avg("y")).scalar()), mean_pd=9, max_pd=9)


@query
def q_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tape.table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_extendedprice", "l_shipdate")
    features = ["l_quantity", "l_discount", "l_extendedprice"]
    return tidy(stability.psi_by_feature(lines, features, F.year("l_shipdate") >= 1998), psi=9)


@query
def q_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = tape.scored(spark, sf_dir).withColumn("pd", F.expr("CASE WHEN id % 97 <> 0 THEN p END"))
    return scored.select("id", portfolio.grade("pd").alias("grade"))


@query
def q_grade_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = portfolio.grade_table(tape.scored(spark, sf_dir), pd="p")
    return tidy(table.drop("position"), mean_pd=9, observed_default_rate=9)


@query
def q_monotonicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of one grade are turned round, so the check has an inversion to find."""
    bent = tape.scored(spark, sf_dir).withColumn("y", F.expr("CASE WHEN p > 0.003 AND p <= 0.01 THEN 1 - y ELSE y END"))
    table = portfolio.grade_table(bent, pd="p")
    return tidy(portfolio.monotonicity(table, min_bucket=1500), observed_default_rate=9, from_rate=9)
