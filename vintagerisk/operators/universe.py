"""Issuer universe: identifiers, verification, validation gate, synchronisation."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagerisk import params as P
from vintagerisk.sources.storage import shared_folder


def normalise_cik(raw: Column) -> Column:
    """Ten digits, zero-padded; null-like text becomes NULL; longer identifiers are left whole."""
    bare = F.ltrim(raw.cast("string"), F.lit("0"))
    padded = F.when(F.length(bare) >= 10, bare).otherwise(F.lpad(bare, 10, "0"))
    return F.when(raw.isNotNull() & ~raw.cast("string").isin("", "null"), padded)


def resolve_by_ticker(wanted: DataFrame, ticker_map: DataFrame) -> DataFrame:
    """CIK per requested ticker, case-insensitive; NULL where the map does not know it."""
    known = ticker_map.select(F.upper("ticker").alias("key"), normalise_cik(F.col("cik")).alias("cik"))
    known = known.groupBy("key").agg(F.min("cik").alias("cik"))
    return wanted.withColumn("key", F.upper("ticker")).join(known, "key", "left").drop("key")


def verify_names(issuers: DataFrame, registrants: DataFrame) -> DataFrame:
    """Does the registrant behind each CIK carry, or did it carry, the expected name?"""
    former = F.concat_ws(" ", F.coalesce(F.col("former_names"), F.array().cast("array<string>")))
    known = registrants.select("cik", "registrant_name", F.upper(F.concat_ws(" ", "registrant_name", former)).alias("haystack"))
    needle = F.trim(F.regexp_replace(F.upper("expected_name"), '"', ""))
    return issuers.join(known, "cik", "left").withColumn(
        "verified_name", F.coalesce(F.contains(F.col("haystack"), needle), F.lit(False))
    ).drop("haystack")


def confirm_defaults(filings: DataFrame, claims: DataFrame, window_days: int = 30) -> DataFrame:
    """Is a bankruptcy item reported within `window_days` of each claimed default date?

    Hits are counted per registrant and day before the interval join, so a registrant
    with any number of filings brings at most one row per day, and the collected dates
    are bounded by the window.
    """
    hits = (
        filings.where(F.col("items").rlike(P.BANKRUPTCY_ITEM))
        .groupBy("cik", "filing_date").agg(F.count("*").alias("n"))
        .withColumnRenamed("cik", "filer")
    )
    near = F.expr(
        f"cik = filer AND filing_date BETWEEN date_sub(default_date, {window_days}) AND date_add(default_date, {window_days})"
    )
    return (
        claims.join(hits, near, "left")
        .groupBy("cik", "default_date", "verified")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_filings"),
            F.sort_array(F.collect_set("filing_date")).alias("dates"),
        )
        .withColumn("confirmed", F.col("n_filings") > 0)
    )


def cohort_summary(issuers: DataFrame) -> DataFrame:
    default = F.col("default_date").isNotNull()
    return issuers.agg(
        F.count("*").alias("issuers"),
        F.count_if(default).alias("defaults"),
        F.count_if(~default).alias("non_defaults"),
        F.count_if(default & F.col("verified")).alias("verified_defaults"),
    )


def universe_violations(issuers: DataFrame, require_verified: bool = True) -> DataFrame:
    """First failed rule per issuer, all issuers at once; an empty result opens the gate."""
    total = F.aggregate(F.map_values("exposure"), F.lit(0.0), lambda a, x: a + x)
    default = F.col("default_date").isNotNull()
    empty = F.col("exposure").isNull() | (F.size("exposure") == 0)
    problem = (
        F.when(F.col("cik").isNull() | (F.col("cik") == ""), "cik unresolved")
        .when(default & empty, "defaulted issuer has no exposure mix")
        .when(default & (total.isNull() | F.isnan(total)), "exposure weight missing")
        .when(default & (F.abs(total - 1) > P.WEIGHT_TOLERANCE), "exposure weights do not sum to 1")
    )
    if require_verified:
        problem = problem.when(default & ~F.coalesce("verified", F.lit(False)), "default event unverified")
    return issuers.withColumn("problem", problem).where(F.col("problem").isNotNull()).select("ticker", "cik", "default_date", "problem")


def require_valid(issuers: DataFrame, require_verified: bool = True, shown: int = 20) -> None:
    """Stop a run whose universe is not fit to train on.

    All violations go to a table in the shared folder; the error names it, counts them by
    problem, and quotes the first `shown`.
    """
    path = f"{shared_folder(issuers.sparkSession)}/universe-violations-{uuid.uuid4().hex}"
    universe_violations(issuers, require_verified).write.parquet(path)
    found = issuers.sparkSession.read.parquet(path)
    counts = found.groupBy("problem").count().orderBy("problem").collect()
    if counts:
        total = ", ".join(f"{r['count']} x {r.problem}" for r in counts)
        first = "; ".join(f"{r.ticker}: {r.problem}" for r in found.orderBy("ticker").take(shown))
        raise ValueError(f"universe is not ready ({total}; all in {path}): {first}")


def sync_universe(external: DataFrame, present: DataFrame) -> DataFrame:
    """Tickers of an external list: which are already here and which are missing."""
    theirs = external.select(F.upper("ticker").alias("ticker"))
    ours = present.select(F.upper("ticker").alias("ticker"))
    missing = theirs.subtract(ours).withColumn("status", F.lit("missing"))
    shared = theirs.intersect(ours).withColumn("status", F.lit("present"))
    return missing.unionByName(shared)


def apply_updates(universe: DataFrame, updates: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Set fields for the named issuers only; returns the new universe and the list of changes."""
    renamed = updates.select(key, *[F.col(f).alias(f"new_{f}") for f in fields])
    joined = universe.join(renamed, key, "left")
    changes = reduce(
        DataFrame.unionByName,
        [
            joined.where(F.col(f"new_{f}").isNotNull() & ~F.col(f).eqNullSafe(F.col(f"new_{f}"))).select(
                key, F.lit(f).alias("field"), F.col(f).cast("string").alias("old"), F.col(f"new_{f}").cast("string").alias("new")
            )
            for f in fields
        ],
    )
    updated = joined.withColumns({f: F.coalesce(f"new_{f}", f) for f in fields}).drop(*[f"new_{f}" for f in fields])
    return updated, changes


def scale_violations(bands: DataFrame) -> DataFrame:
    """Masterscale checks per scale: bounds rise, are unique, and the last one is 1."""
    in_order = "PARTITION BY scale_id ORDER BY position"
    steps = bands.selectExpr(
        "scale_id", "position", "pd_upper",
        f"lag(pd_upper) OVER ({in_order}) AS before",
        f"lead(pd_upper) OVER ({in_order}) AS after",
    )
    rule = (
        F.when(F.col("before") > F.col("pd_upper"), "bounds must increase")
        .when(F.col("before") == F.col("pd_upper"), "bounds must be unique")
        .when(F.col("after").isNull() & (F.abs(F.col("pd_upper") - 1) > 1e-9), "last bound must be 1")
    )
    return steps.withColumn("rule", rule).where(F.col("rule").isNotNull()).select(
        F.col("scale_id").cast("string").alias("subject"), F.col("position").cast("string").alias("item"), "rule"
    )


def recovery_violations(classes: DataFrame) -> DataFrame:
    """Recovery inputs must be sourced, cited, on a known basis and within [0, 1]."""
    mean = F.col("recovery_mean")
    rule = (
        F.when(~F.col("status").eqNullSafe("SOURCED"), "status must be SOURCED")
        .when(F.col("citation").isNull(), "citation missing")
        .when(~F.coalesce(F.col("basis").isin(*P.RECOVERY_BASES), F.lit(False)), "unknown recovery basis")
        .when(mean.isNull() | (mean < 0) | (mean > 1), "recovery outside [0, 1]")
    )
    return classes.withColumn("rule", rule).where(F.col("rule").isNotNull()).select(
        F.lit("recovery").alias("subject"), F.col("seniority").alias("item"), "rule"
    )
