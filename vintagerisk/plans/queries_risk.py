"""Loss, exposure and capital queries over the loan tape and the issuer panel."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagerisk.functions.numeric import tidy
from vintagerisk.operators import portfolio, scores
from vintagerisk.plans.core import issuer_panel, issuer_snapshots, query
from vintagerisk.sources import tape


def rated_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loan tape with EAD and a blended LGD per facility."""
    loans = portfolio.facility_ead(tape.loan_tape(spark, sf_dir)).withColumn("w", F.expr("(facility_id % 10) / 10D"))
    return portfolio.mix_lgd(loans.withColumn("mix", F.expr("map('senior_secured', w, 'senior_unsecured', 1 - w)")), "mix")


@query
def q_expected_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rated_tape(spark, sf_dir).withColumn("el", portfolio.expected_loss()).groupBy("sector", "instrument").agg(
        F.count("*").alias("facilities"), F.sum("ead").alias("ead"), F.sum("el").alias("expected_loss"), F.max("el").alias("largest")
    )
    return tidy(out, ead=1, expected_loss=2, largest=3)


@query
def q_irb_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tape.loan_tape(spark, sf_dir).selectExpr(
        "facility_id",
        f"{portfolio.asset_correlation()} AS correlation",
        f"{portfolio.firm_size_adjusted(portfolio.asset_correlation(), 'sales_eur_millions')} AS size_adjusted",
        f"{portfolio.maturity_adjustment()} AS maturity_adjustment",
    )
    return tidy(out, correlation=8, size_adjusted=8, maturity_adjustment=8)


@query
def q_irb_capital(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = portfolio.with_irb(rated_tape(spark, sf_dir), maturity="maturity_years", sales="sales_eur_millions")
    out = out.withColumn("rwa", portfolio.risk_weighted_assets())
    return tidy(out.select("facility_id", "irb_conditional_pd", "irb_k", "rwa"), irb_conditional_pd=8, irb_k=8, rwa=4)


@query
def q_facility_ead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EAD per instrument, on a tape with some unknown instruments and negative amounts."""
    loans = tape.loan_tape(spark, sf_dir).selectExpr(
        "* EXCEPT (instrument, drawn)",
        "CASE WHEN facility_id % 50 = 0 THEN 'guarantee' ELSE instrument END AS instrument",
        "CASE WHEN facility_id % 41 = 0 THEN -drawn ELSE drawn END AS drawn",
    )
    out = portfolio.facility_ead(loans).groupBy("instrument", "ead_problem").agg(
        F.count("*").alias("facilities"), F.sum("drawn").alias("drawn"), F.sum("undrawn").alias("undrawn"), F.sum("ead").alias("ead")
    )
    return tidy(out, drawn=2, undrawn=3, ead=3)


@query
def q_ead_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = issuer_snapshots(spark, sf_dir, null_values=True)
    return tidy(snap.selectExpr("cik", "as_of", f"{portfolio.BALANCE_SHEET_EAD} AS ead"), ead=4)


@query
def q_lgd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blended LGD per issuer, normal and in a distressed industry, with mixes that must be refused."""
    mixes = tape.issuers(spark, sf_dir).selectExpr(
        "ticker",
        """CASE issuer_id % 7
             WHEN 0 THEN map('senior_secured', 0.6D)
             WHEN 1 THEN map('bank_loan_secured', 0.5D, 'senior_unsecured', 0.5D)
             WHEN 2 THEN map('mezzanine', 0.25D, 'senior_secured', 0.75D)
             WHEN 3 THEN map('senior_subordinated', 0.3D, 'subordinated', 0.7D)
             WHEN 4 THEN map('bank_loan_secured', 1D)
             ELSE exposure END AS mix""",
    )
    plain = portfolio.mix_lgd(mixes, "mix", problems=True)
    distressed = portfolio.mix_lgd(mixes, "mix", industry_distress=True, haircut_enabled=True).select(
        "ticker", F.col("lgd").alias("lgd_distressed")
    )
    out = plain.join(distressed, "ticker").select("ticker", "lgd_problem", "lgd", "lgd_downturn", "lgd_distressed")
    return tidy(out, lgd=6, lgd_downturn=6, lgd_distressed=6)


def o_score_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = issuer_snapshots(spark, sf_dir).withColumn("o_score", scores.o_score()).where("o_score IS NOT NULL")
    rated = snap.withColumn("pd", scores.o_score_pd(F.col("o_score"))).withColumn("grade", portfolio.grade("pd"))
    return rated.select("ticker", "name", "sector", "as_of", "label", "total_debt", "pd", "grade")


EXPOSURE_PLACES = {"pd": 8, "lgd": 6, "lgd_downturn": 6, "ead": 4}


@query
def q_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = portfolio.build_exposures(o_score_predictions(spark, sf_dir), tape.issuers(spark, sf_dir))
    return tidy(out, **EXPOSURE_PLACES)


@query
def q_cross_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The portfolio of one date: every issuer observed then."""
    out = portfolio.build_exposures(o_score_predictions(spark, sf_dir), tape.issuers(spark, sf_dir), dt.date(1999, 6, 30))
    return tidy(out, **EXPOSURE_PLACES)


@query
def q_latest_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = issuer_panel(spark, sf_dir).select("ticker", "as_of", "label", "total_debt", "net_margin", "wc_ta")
    return tidy(portfolio.latest_observation(panel), total_debt=4, net_margin=6, wc_ta=6)


@query
def q_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portfolio totals by sector with the grand total."""
    out = portfolio.portfolio_totals(rated_tape(spark, sf_dir), by=["sector"], maturity="maturity_years")
    return tidy(
        out.drop("refused_facilities", "refused_ead"), total_ead=2, expected_loss=2, expected_loss_rate=8, capital_requirement=2, rwa=2,
        exposure_weighted_pd=8, exposure_weighted_lgd=8,
    )
