"""Point-in-time queries: visibility, vintages, snapshots, ratios, labels, scores, diagnostics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagerisk import params as P
from vintagerisk.functions.numeric import tidy
from vintagerisk.operators import asof, diagnostics, labels, scores
from vintagerisk.operators.codes import decode
from vintagerisk.operators.panel import build_panel
from vintagerisk.plans.core import issuer_panel, issuer_snapshots, observations, query
from vintagerisk.sources import storage, tape
from vintagerisk.streaming import vintages

GRID = labels.grid_dates(tape.WINDOW)
RATIO_PLACES = {f: 6 for f in P.FEATURES}


@query
def q_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = scores.score_panel(issuer_panel(spark, sf_dir))
    return tidy(panel, **RATIO_PLACES, z_double_prime=6, total_assets=4, total_debt=4)


@query
def q_tag_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = tape.facts(spark, sf_dir, book=tape.fact_words(spark, sf_dir)).select("cik", "field", "period_end", "filed", "form", "fiscal_year", "value", "tag")
    return tidy(facts, value=4)


@query
def q_visible_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(asof.visible_summary(tape.facts(spark, sf_dir), observations(spark, sf_dir)), total_value=4)


@query
def q_latest_vintage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with gaps: a newest row without a value keeps the older value under the newer date."""
    book = tape.fact_words(spark, sf_dir)
    vintage = asof.latest_vintage(tape.facts(spark, sf_dir, True, book), observations(spark, sf_dir), GRID, book)
    return tidy(vintage.select("cik", "as_of", "field", "period_end", "filed", "value", "tag", "form"), value=4)


ARRIVAL_DAYS = 120


@query
def q_stream_vintage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest vintages once more, from facts that land in four deliveries, each up to 120 days after its filing."""
    waits = [(later - day).days for day, later in zip(GRID, GRID[1:], strict=False)]
    lateness = ARRIVAL_DAYS + max(waits) + 1
    feed, folder, target, checkpoint = (storage.scratch_path(spark, name) for name in ("feed", "landing", "versions", "progress"))
    book = tape.fact_words(spark, sf_dir)
    arrives = F.expr(f"date_add(filed, pmod(hash(cik, field, period_end, filed), {ARRIVAL_DAYS}))")
    cuts = [GRID[len(GRID) * k // 4] for k in (1, 2, 3)]
    delivery = sum(F.coalesce(arrives > F.lit(day), F.lit(False)).cast("int") for day in cuts)
    facts = tape.facts(spark, sf_dir, True, book).select(*storage.FACT_SCHEMA.fieldNames())
    facts.withColumn("delivery", delivery).write.partitionBy("delivery").parquet(feed)
    for k in range(len(cuts) + 1):
        spark.read.parquet(feed).where(F.col("delivery") == k).select(*storage.FACT_SCHEMA.fieldNames()).write.mode("append").parquet(folder)
        if k == len(cuts):
            vintages.heartbeat(spark, folder, GRID[-1] + dt.timedelta(days=lateness + 1))
        vintages.update_versions(spark, folder, target, checkpoint, GRID, lateness, book=book)
    out = decode(asof.vintage_of_versions(vintages.read_versions(spark, target), observations(spark, sf_dir)), asof.WORD_COLUMNS, book)
    return tidy(out.select("cik", "as_of", "field", "period_end", "filed", "value", "tag", "form"), value=4)


@query
def q_anchor_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    periods = asof.observed_periods(tape.facts(spark, sf_dir), observations(spark, sf_dir), GRID)
    return periods.where(F.col("period_end") == F.col("anchor")).select(
        "cik", "as_of", "anchor", "anchored_by", F.col("n_fields").cast("bigint").alias("n_fields")
    )


PRIORS = ["prior_net_income", "prior_revenue", "prior_total_assets"]


@query
def q_prior_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = asof.anchored_snapshots(tape.facts(spark, sf_dir), observations(spark, sf_dir), GRID, max_staleness_days=None)
    return tidy(snap.select("cik", "as_of", "period_end", "prior_period_end", *PRIORS), **{c: 4 for c in PRIORS})


@query
def q_asof_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As reported, on facts with gaps, through the general calendar (dates not known beforehand)."""
    snap = asof.anchored_snapshots(tape.facts(spark, sf_dir, null_values=True), observations(spark, sf_dir))
    columns = ["cik", "as_of", "period_end", "filed", "report_lag_days", "source", "anchored_by", "prior_period_end"]
    return tidy(snap.select(*columns, *P.FIELDS, *PRIORS), **{c: 4 for c in P.FIELDS + PRIORS})


@query
def q_min_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots that may only use periods from a given date on."""
    snap = asof.anchored_snapshots(
        tape.facts(spark, sf_dir), observations(spark, sf_dir), GRID, min_period_end=dt.date(1999, 1, 1)
    )
    return tidy(snap.select("cik", "as_of", "period_end", "prior_period_end", "total_assets"), total_assets=4)


@query
def q_stale_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = asof.anchored_snapshots(tape.facts(spark, sf_dir), observations(spark, sf_dir), GRID, max_staleness_days=None)
    age = F.date_diff("as_of", "period_end")
    return snap.select(
        "cik", "as_of", "period_end", age.alias("age_days"),
        (age <= P.MAX_STALENESS_DAYS).alias("kept_default"), (age <= 365).alias("kept_365"),
    )


@query
def q_derived_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = issuer_snapshots(spark, sf_dir, null_values=True)
    out = snap.select(
        "cik", "as_of", "gross_profit", "ebit", "total_liabilities", F.array_join("derived_fields", ",").alias("derived")
    )
    return tidy(out, gross_profit=4, ebit=4, total_liabilities=4)


@query
def q_total_debt(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = issuer_snapshots(spark, sf_dir, null_values=True).select(
        "cik", "as_of", "long_term_debt", "current_debt", "total_debt_reported", "total_debt"
    )
    return tidy(out, long_term_debt=4, current_debt=4, total_debt_reported=4, total_debt=4)


@query
def q_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = issuer_snapshots(spark, sf_dir, null_values=True).select("cik", "as_of", "ebitda", "interest_burden", *P.FEATURES)
    return tidy(out, ebitda=4, interest_burden=4, **RATIO_PLACES)


@query
def q_obs_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = labels.observation_grid(tape.issuers(spark, sf_dir), tape.WINDOW)
    return grid.select("ticker", "cik", "as_of", "default_date")


@query
def q_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).select("ticker", "as_of", "label", "days_to_default", "is_default_issuer")


@query
def q_altman(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scores.score_panel(issuer_panel(spark, sf_dir)).withColumn("em_score", scores.z_double_prime(include_constant=True))
    return tidy(out.select("ticker", "as_of", "z_double_prime", "em_score", "z_zone"), z_double_prime=6, em_score=6)


@query
def q_altman_zprime(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = issuer_snapshots(spark, sf_dir).withColumn(
        "sales_ta", F.expr("CASE WHEN abs(total_assets) >= 1e-6D THEN revenue / total_assets END")
    )
    out = snap.withColumn("z_prime", scores.z_prime()).withColumn("zone", scores.zone("z_prime", P.Z1_ZONES))
    return tidy(out.select("ticker", "as_of", "sales_ta", "z_prime", "zone"), sales_ta=6, z_prime=6)


@query
def q_ohlson(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = issuer_snapshots(spark, sf_dir).withColumn("o_score", scores.o_score())
    out = out.withColumn("o_score_pd", scores.o_score_pd(F.col("o_score")))
    return tidy(out.select("ticker", "as_of", "o_score", "o_score_pd"), o_score=6, o_score_pd=8)


@query
def q_panel_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(diagnostics.panel_diagnostics(issuer_panel(spark, sf_dir)), sample_default_rate=8, median_report_lag_days=2)


@query
def q_top_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(diagnostics.worst_missing(issuer_panel(spark, sf_dir)), missing_share=3)


@query
def q_coverage_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(diagnostics.coverage_warnings(issuer_panel(spark, sf_dir), max_missing=0.2), value=6)


@query
def q_hardness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(
        diagnostics.control_group_hardness(issuer_panel(spark, sf_dir)),
        speculative_share=8, speculative_share_survivors=8,
    )


@query
def q_speculative_issuers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.speculative_issuers(issuer_panel(spark, sf_dir))


@query
def q_defaulters_without_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under a tight staleness limit, so that late filers lose their last observation."""
    issuers = tape.issuers(spark, sf_dir)
    fresh = build_panel(issuers, tape.facts(spark, sf_dir), tape.WINDOW, max_staleness_days=200)
    return diagnostics.defaulters_without_positive(issuers, fresh)


@query
def q_missing_by_issuer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(diagnostics.missing_by_issuer(issuer_panel(spark, sf_dir)), missing_share=4)


@query
def q_missing_by_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(diagnostics.missing_by_cohort(issuer_panel(spark, sf_dir)), survivors=4, defaulters=4)


@query
def q_positive_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.positive_gaps(issuer_panel(spark, sf_dir))


@query
def q_z_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = diagnostics.z_medians(scores.score_panel(issuer_panel(spark, sf_dir)))
    return tidy(out, wc_ta=6, re_ta=6, ebit_ta=6, equity_tl=6, z_double_prime=6)


@query
def q_gap_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = diagnostics.gap_fields(issuer_snapshots(spark, sf_dir))
    return gaps.select(
        "ticker", "as_of", "period_end", F.array_join("derived_fields", ",").alias("derived"),
        F.array_join("missing_fields", ",").alias("missing"), "is_positive",
    )


@query
def q_gap_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = tape.statement_entries(spark, sf_dir).where("taxonomy = 'us-gaap' AND unit LIKE 'USD%'")
    return tidy(diagnostics.gap_tags(issuer_snapshots(spark, sf_dir), entries), value=4)


@query
def q_tag_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = tape.statement_entries(spark, sf_dir).where("taxonomy = 'us-gaap' AND unit LIKE 'USD%'")
    return diagnostics.tag_census(entries)
