"""Source, ingest and universe queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagerisk.functions.numeric import tidy
from vintagerisk.operators import facts as fact_ops
from vintagerisk.operators import universe
from vintagerisk.plans.core import query
from vintagerisk.sources import companyfacts, storage, submissions, tape


@query
def q_facts_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = companyfacts.scan_company_facts(tape.company_documents(spark, sf_dir))
    return tidy(raw.select("cik", "field", "period_end", "filed", "form", "fiscal_year", "value", "tag", "tag_rank"), value=4)


@query
def q_annual_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = companyfacts.known_entries(companyfacts.explode_entries(tape.company_documents(spark, sf_dir)))
    return entries.where("is_duration").groupBy("field").agg(
        F.count("*").alias("seen"), F.count("start").alias("with_start"), F.count_if(companyfacts.is_annual()).alias("kept")
    )


@query
def q_source_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    preferred = fact_ops.normalise_source(tape.second_producer(spark, sf_dir), "second")
    chosen = fact_ops.prefer_source(preferred, tape.facts(spark, sf_dir))
    out = chosen.groupBy("cik", "source").agg(
        F.count("*").alias("n_facts"), F.count("form").alias("n_forms"), F.sum("value").alias("total_value")
    )
    return tidy(out, total_value=4)


@query
def q_filing_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = tape.claimed_defaults(spark, sf_dir)
    return submissions.list_filings(
        tape.filing_pages(spark, sf_dir), claims, window_days=2, keep=("form", "filing_date", "items")
    )


@query
def q_resolve_cik(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = tape.table(spark, sf_dir, "customer").selectExpr("concat('s', cast(c_custkey as string)) AS ticker")
    return universe.resolve_by_ticker(wanted, tape.issuers(spark, sf_dir))


@query
def q_verify_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = tape.registrants(spark, sf_dir)
    expected = known.select("cik", "ticker", "expected_name")
    checked = universe.verify_names(expected, known.select("cik", "registrant_name", "former_names"))
    return checked.select("cik", "ticker", "registrant_name", "verified_name")


@query
def q_facts_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts written and read back as Parquet and as CSV."""
    folder = f"{storage.shared_folder(spark)}/facts-{uuid.uuid4().hex}"
    facts = tape.facts(spark, sf_dir)
    storage.write_facts(facts, f"{folder}/parquet")
    stored = storage.read_facts(spark, f"{folder}/parquet")
    storage.write_csv(stored.select(*storage.FACT_SCHEMA.fieldNames()), f"{folder}/csv")
    as_csv = storage.read_facts_csv(spark, f"{folder}/csv")

    def digest(df: DataFrame, form: str) -> DataFrame:
        return df.groupBy("field").agg(
            F.count("*").alias("n_facts"), F.min("cik").alias("first_cik"), F.min("filed").alias("first_filed"),
            F.max("filed").alias("last_filed"), F.sum("value").alias("total_value"),
        ).withColumn("stored_as", F.lit(form))

    return tidy(digest(stored, "parquet").unionByName(digest(as_csv, "csv")), total_value=4)


@query
def q_param_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    scales, classes = tape.parameter_tables(spark, sf_dir)
    return universe.scale_violations(scales).unionByName(universe.recovery_violations(classes))


@query
def q_cik_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = tape.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        """CASE c_custkey % 6 WHEN 0 THEN concat('000', cast(c_custkey as string)) WHEN 1 THEN cast(c_custkey as string)
           WHEN 2 THEN '' WHEN 3 THEN 'null' WHEN 4 THEN concat('12345678901', cast(c_custkey as string)) END AS raw_cik""",
    )
    return raw.withColumn("cik", universe.normalise_cik(F.col("raw_cik"))).select("c_custkey", "cik")


@query
def q_default_confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    filings = tape.filings(spark, sf_dir).where("upper(form) = '8-K'")
    out = universe.confirm_defaults(filings, tape.claimed_defaults(spark, sf_dir), window_days=1)
    return out.select(
        "cik", "default_date", "confirmed", "n_filings",
        F.array_join(F.transform("dates", lambda d: d.cast("string")), ", ").alias("dates"),
    )


@query
def q_cohort_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.cohort_summary(tape.issuers(spark, sf_dir))


@query
def q_universe_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issuers with some weights broken and some identifiers lost, as a hand-kept list has them."""
    issuers = tape.issuers(spark, sf_dir).selectExpr(
        "ticker", "CASE WHEN issuer_id % 17 <> 5 THEN cik END AS cik", "default_date", "verified",
        """CASE WHEN issuer_id % 13 = 4 THEN map_filter(exposure, (k, v) -> k = 'senior_secured')
                WHEN issuer_id % 13 = 9 THEN NULL ELSE exposure END AS exposure""",
    )
    return universe.universe_violations(issuers)


@query
def q_universe_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    external = tape.table(spark, sf_dir, "customer").selectExpr("concat('s', cast(c_custkey * 3 as string)) AS ticker")
    return universe.sync_universe(external, tape.issuers(spark, sf_dir))


@query
def q_universe_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = tape.claimed_defaults(spark, sf_dir)
    confirmed = universe.confirm_defaults(tape.filings(spark, sf_dir).where("upper(form) = '8-K'"), claims, window_days=1)
    updates = confirmed.where("confirmed").select("cik", F.lit(True).alias("verified"))
    _, changes = universe.apply_updates(claims, updates, "cik", ["verified"])
    return changes
