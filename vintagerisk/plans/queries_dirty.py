"""Queries over tables with missing values of the kinds that real filings and tapes hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagerisk.functions.numeric import tidy
from vintagerisk.operators import asof, calibration_tests, facts, portfolio, universe
from vintagerisk.plans.core import observations, query
from vintagerisk.sources import tape


def facts_without_some_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = F.when(F.day("filed") % 5 != 0, F.col("filed"))
    return tape.facts(spark, sf_dir).withColumn("filed", lost)


@query
def q_epochs_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts by the first grid date that sees them, by both forms of the mapping, with filing dates missing."""
    rows, obs = facts_without_some_dates(spark, sf_dir), observations(spark, sf_dir)
    grid = [r.as_of for r in obs.select("as_of").distinct().collect()]  # a date a year
    count = lambda dates: asof.with_epoch(rows, obs, dates).groupBy("epoch").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    both = count(grid).withColumn("form", F.lit("case")).unionByName(count(None).withColumn("form", F.lit("calendar")))
    return tidy(both, total=4)


@query
def q_source_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second producer with NaN values and rows without a filing date."""
    raw = facts_without_some_dates(spark, sf_dir).withColumn("value", F.when(F.month("filed") == 4, F.lit(float("nan"))).otherwise(F.col("value")))
    kept = facts.normalise_source(raw.select("cik", "field", "period_end", "filed", "value"), "second")
    out = kept.groupBy("field").agg(F.count("*").alias("n"), F.count("value").alias("n_values"), F.sum("value").alias("total"))
    return tidy(out, total=4)


@query
def q_universe_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issuers whose verification or whose weights are not known."""
    issuers = tape.issuers(spark, sf_dir).selectExpr(
        "ticker", "cik", "default_date", "CASE WHEN issuer_id % 3 <> 1 THEN verified END AS verified",
        "CASE WHEN issuer_id % 5 = 2 AND exposure IS NOT NULL THEN map('senior_secured', cast(NULL as double)) ELSE exposure END AS exposure",
    )
    return universe.universe_violations(issuers)


@query
def q_portfolio_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over a tape on which some mixes hold an unknown weight and some amounts are missing."""
    loans = tape.loan_tape(spark, sf_dir).withColumn("drawn", F.expr("CASE WHEN facility_id % 11 <> 0 THEN drawn END"))
    loans = portfolio.facility_ead(loans).withColumn("w", F.expr("CASE WHEN facility_id % 9 <> 0 THEN (facility_id % 10) / 10D END"))
    rated = portfolio.mix_lgd(loans.withColumn("mix", F.expr("map('senior_secured', w, 'senior_unsecured', 1 - w)")), "mix")
    out = portfolio.portfolio_totals(rated, by=["sector"], maturity="maturity_years")
    return tidy(
        out, total_ead=2, expected_loss=2, expected_loss_rate=8, capital_requirement=2, rwa=2, exposure_weighted_pd=8,
        exposure_weighted_lgd=8, refused_ead=2,
    )


@query
def q_refusals_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons why facilities have no EAD or no LGD."""
    loans = tape.loan_tape(spark, sf_dir).selectExpr(
        "* EXCEPT (drawn, undrawn)", "CASE WHEN facility_id % 11 <> 0 THEN drawn END AS drawn",
        "CASE WHEN facility_id % 7 = 0 THEN double('NaN') ELSE undrawn END AS undrawn",
        "CASE WHEN facility_id % 9 <> 0 THEN (facility_id % 10) / 10D END AS w",
    )
    mixed = portfolio.mix_lgd(portfolio.facility_ead(loans).withColumn("mix", F.expr("map('senior_secured', w, 'senior_unsecured', 1 - w)")), "mix", problems=True)
    return mixed.groupBy("ead_problem", "lgd_problem").agg(F.count("*").alias("facilities"), F.count("ead").alias("with_ead"), F.count("lgd").alias("with_lgd"))


@query
def q_hosmer_lemeshow_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred groups: the p-value of some hundred degrees of freedom."""
    return tidy(calibration_tests.hosmer_lemeshow(tape.scored(spark, sf_dir), n_groups=100), statistic=5, p_value=7)
