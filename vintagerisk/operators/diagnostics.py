"""What a reviewer asks about a panel before believing any score on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagerisk import params as P


def panel_diagnostics(panel: DataFrame) -> DataFrame:
    """One row.  The lag median is exact: lags are whole days, so its histogram is small."""
    years = F.array_join(F.transform(F.sort_array(F.collect_set(F.year("as_of"))), lambda y: y.cast("string")), ",")
    positive = F.when(F.col("label") == 1, F.col("ticker"))
    per_source = panel.groupBy("source").agg(F.count("*").alias("n"))
    mix = per_source.agg(
        F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "source", F.col("n").cast("string")))), ",").alias("mix")
    ).scalar()
    return panel.agg(
        F.count("*").alias("observations"),
        F.count_distinct("ticker").alias("issuers"),
        F.sum("label").cast("bigint").alias("positive_labels"),
        F.avg("label").alias("sample_default_rate"),
        years.alias("observation_years"),
        F.count_distinct(positive).alias("defaulted_issuers"),
        F.percentile("report_lag_days", F.lit(0.5)).alias("median_report_lag_days"),
    ).withColumn("source_mix", mix)


def _long_missing(panel: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    pairs = ", ".join(f"'{f}', CASE WHEN `{f}` IS NULL THEN 1 ELSE 0 END" for f in features)
    return panel.selectExpr(*keys, f"stack({len(features)}, {pairs}) AS (feature, gap)")


def missing_shares(panel: DataFrame, features: list[str] = P.FEATURES) -> DataFrame:
    return _long_missing(panel, [], features).groupBy("feature").agg(F.avg("gap").alias("missing_share"))


def worst_missing(panel: DataFrame, n: int = 5) -> DataFrame:
    return missing_shares(panel).orderBy(F.desc("missing_share"), "feature").limit(n)


def coverage_warnings(
    panel: DataFrame,
    min_positive: int = P.MIN_POSITIVE_ROWS,
    max_missing: float = P.MAX_MISSING_SHARE,
    min_issuers: int = P.MIN_POSITIVE_ISSUERS,
) -> DataFrame:
    """Rows (warning, subject, value); empty when the panel carries enough information."""
    totals = panel.agg(
        F.coalesce(F.sum("label"), F.lit(0)).alias("positives"),
        F.count_distinct(F.when(F.col("label") == 1, F.col("ticker"))).alias("positive_issuers"),
        F.count("*").alias("n"),
    )

    def warn(name: str, subject: str, value: str, rule: str, source: DataFrame) -> DataFrame:
        return source.where(rule).selectExpr(f"'{name}' AS warning", f"{subject} AS subject", f"cast({value} as double) AS value")

    return (
        warn("panel is empty", "'panel'", "n", "n = 0", totals)
        .unionByName(warn("too few positive observations", "'panel'", "positives", f"n > 0 AND positives < {min_positive}", totals))
        .unionByName(warn("too few defaulted issuers", "'panel'", "positive_issuers", f"n > 0 AND positive_issuers < {min_issuers}", totals))
        .unionByName(warn("feature mostly imputed", "feature", "missing_share", f"missing_share > {max_missing}D", missing_shares(panel)))
    )


def speculative(leverage: float = P.AGGRESSIVE_LEVERAGE, coverage: float = P.WEAK_COVERAGE) -> Column:
    """Leverage above or cover below the speculative-grade mark; a missing ratio does not count."""
    return F.expr(f"coalesce(debt_ebitda > {leverage}D, false) OR coalesce(interest_cover < {coverage}D, false)")


def hardness_verdict(share: str) -> Column:
    easy, hard = P.HARDNESS_CUTS
    return F.expr(
        f"CASE WHEN {share} IS NULL THEN 'not computable' WHEN {share} < {easy}D THEN 'easy task' "
        f"WHEN {share} < {hard}D THEN 'partially hard' ELSE 'hard task' END"
    )


def control_group_hardness(panel: DataFrame) -> DataFrame:
    flag = speculative().cast("int")
    survivor = F.col("is_default_issuer") == 0
    return (
        panel.where("label = 0")
        .agg(
            F.count("*").alias("control_observations"),
            F.avg(flag).alias("speculative_share"),
            F.avg(F.when(survivor, flag)).alias("speculative_share_survivors"),
            F.count_distinct(F.when(survivor & speculative(), F.col("ticker"))).alias("speculative_issuers"),
        )
        .withColumn("verdict", hardness_verdict("speculative_share_survivors"))
    )


def speculative_issuers(panel: DataFrame) -> DataFrame:
    return panel.where("label = 0 AND is_default_issuer = 0").where(speculative()).groupBy("ticker").agg(F.count("*").alias("n_observations"))


def defaulters_without_positive(issuers: DataFrame, panel: DataFrame) -> DataFrame:
    positive = panel.where("label = 1").select("ticker")
    return issuers.where("default_date IS NOT NULL").join(positive, "ticker", "left_anti").select("ticker", "default_date")


def missing_by_issuer(panel: DataFrame) -> DataFrame:
    """Share missing per issuer, for the columns that have any gap at all."""
    columns = P.FEATURES + ["total_debt"]
    rows = _long_missing(panel, ["ticker", "is_default_issuer"], columns)
    shares = rows.groupBy("ticker", "feature").agg(
        F.max("is_default_issuer").alias("defaulter"), F.count("*").alias("observations"), F.avg("gap").alias("missing_share")
    )
    gappy = shares.groupBy("feature").agg(F.max("missing_share").alias("worst")).where("worst > 0").select("feature")
    return shares.join(F.broadcast(gappy), "feature", "left_semi")  # one row per column of the panel at most


def missing_by_cohort(panel: DataFrame) -> DataFrame:
    rows = _long_missing(panel, ["is_default_issuer"], P.FEATURES)
    return (
        rows.groupBy("feature")
        .agg(
            F.avg(F.when(F.col("is_default_issuer") == 0, F.col("gap"))).alias("survivors"),
            F.avg(F.when(F.col("is_default_issuer") == 1, F.col("gap"))).alias("defaulters"),
        )
        .where("survivors > 0 OR defaulters > 0")
    )


def positive_gaps(panel: DataFrame) -> DataFrame:
    """Positive observations that would enter the fit with an imputed feature."""
    gaps = F.expr("array_compact(array(" + ", ".join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in P.FEATURES) + "))")
    return (
        panel.where("label = 1").withColumn("gaps", gaps).where(F.size("gaps") > 0)
        .select("ticker", "as_of", F.array_join("gaps", ",").alias("missing"))
    )


def z_medians(scored: DataFrame) -> DataFrame:
    """Median Z'' inputs per issuer; an issuer has one row per year, so groups stay small."""
    inputs = list(P.Z2_WEIGHTS) + ["z_double_prime"]
    return scored.groupBy("ticker").agg(
        F.max("is_default_issuer").alias("defaulter"), *[F.percentile(c, F.lit(0.5)).alias(c) for c in inputs]
    )


def gap_fields(snapshots: DataFrame) -> DataFrame:
    """Observations with a missing ratio, and the canonical fields missing behind it."""
    any_gap = " OR ".join(f"{f} IS NULL" for f in P.FEATURES)
    missing = F.expr("array_compact(array(" + ", ".join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in P.FIELDS) + "))")
    return snapshots.where(any_gap).withColumn("missing_fields", missing).withColumn("is_positive", F.col("label") == 1)


def gap_tags(snapshots: DataFrame, entries: DataFrame, per_gap: int | None = None, near_days: int = 7) -> DataFrame:
    """Tags reported close to the period of a field that is still missing.

    Each (issuer, field) is explained once, at its first gap; `per_gap` keeps only that many of
    its tags, by `position`, for a printed report.  Entries are reduced to
    distinct values before the join, which matches on issuer and on a +/- one-week window.
    """
    probes = ", ".join(f"'{f}', {f}, '{pattern}'" for f, pattern in P.GAP_PROBES.items())
    first_gap = (
        gap_fields(snapshots)
        .selectExpr("cik", "ticker", "as_of", "period_end AS gap_period", f"stack({len(P.GAP_PROBES)}, {probes}) AS (field, known, pattern)")
        .where("known IS NULL")
        .groupBy("cik", "ticker", "field", "pattern")
        .agg(F.min_by("gap_period", "as_of").alias("gap_period"))
        .withColumnRenamed("cik", "gap_cik")
    )
    annual = F.expr(f"CASE WHEN span_days BETWEEN {P.ANNUAL_SPAN_DAYS[0]} AND {P.ANNUAL_SPAN_DAYS[1]} THEN 0 ELSE 1 END")
    any_probe = "|".join(P.GAP_PROBES.values())
    reported = (
        entries.where("form LIKE '10-K%' AND start IS NOT NULL").where(F.col("tag").rlike(any_probe))
        .withColumn("span_days", F.date_diff("period_end", "start"))
        .select("cik", "tag", "period_end", "span_days", "value", "filed").distinct()
    )
    close = F.expr(f"cik = gap_cik AND abs(date_diff(period_end, gap_period)) <= {near_days} AND tag RLIKE pattern")
    hits = (
        reported.join(first_gap, close)
        .select("ticker", "field", "gap_period", "tag", "span_days", "value", "filed").distinct()
        .withColumn("off_span", annual)
    )
    ranked = hits.selectExpr(
        "*", "row_number() OVER (PARTITION BY ticker, field ORDER BY off_span, tag, span_days, value, filed) AS position"
    )
    known = [t for tags in (P.INSTANT_FIELDS | P.DURATION_FIELDS).values() for t in tags]
    if per_gap is not None:
        ranked = ranked.where(F.col("position") <= per_gap)
    return ranked.select(
        "ticker", "field", "gap_period", "position", "tag", "span_days", "value", "filed", F.col("tag").isin(*known).alias("in_schema")
    )


def tag_census(entries: DataFrame, top: int | None = None) -> DataFrame:
    """Debt and interest tags each issuer reports, by number of annual period ends; `top` cuts the list for print."""
    known = [t for tags in (P.INSTANT_FIELDS | P.DURATION_FIELDS).values() for t in tags]
    per_period = (
        entries.where("form LIKE '10-K%'").where(F.col("tag").rlike(P.TAG_CENSUS_PATTERN))
        .groupBy("cik", "tag", "period_end").agg(F.count("*").alias("n"))
    )
    per_tag = per_period.groupBy("cik", "tag").agg(
        F.count("*").alias("period_ends"), F.year(F.min("period_end")).alias("first_year"), F.year(F.max("period_end")).alias("last_year")
    )
    ranked = per_tag.selectExpr("*", "row_number() OVER (PARTITION BY cik ORDER BY period_ends DESC, tag) AS position")
    if top is not None:
        ranked = ranked.where(F.col("position") <= top)
    return ranked.withColumn("in_schema", F.col("tag").isin(*known))
