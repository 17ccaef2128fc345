"""Grades, LGD, EAD, expected loss and regulatory capital, as column arithmetic over loan tapes."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagerisk import params as P
from vintagerisk.functions.normal import add_norm_cdf, add_norm_quantile
from vintagerisk.functions.numeric import dbl, num
from vintagerisk.sources.storage import materialise

# ---- calibration to the population -------------------------------------------------


def prior_correct(p: str, sample_rate: str, population_rate: str) -> Column:
    """Move a probability from the sampled default rate to the population rate, on the odds."""
    q = f"greatest({dbl(P.PROBABILITY_EPS)}, least({dbl(1 - P.PROBABILITY_EPS)}, {p}))"
    odds = f"({q} / (1 - {q}) * ({population_rate} / (1 - {population_rate})) * ((1 - {sample_rate}) / {sample_rate}))"
    rates = f"{sample_rate} > 0 AND {sample_rate} < 1 AND {population_rate} > 0 AND {population_rate} < 1"
    bad = "raise_error('default rates must lie strictly between 0 and 1')"
    return F.expr(f"CASE WHEN {p} IS NULL THEN NULL WHEN {rates} THEN {odds} / (1 + {odds}) ELSE double({bad}) END")


def pd_sensitivity(scored: DataFrame, sample_rate: float | Column, p: str = "p", grid: tuple[float, ...] = P.POPULATION_GRID) -> DataFrame:
    """Mean and largest corrected PD under each assumed population rate."""
    rates = ", ".join(dbl(t) for t in grid)
    rows = scored.withColumn("rate", sample_rate if isinstance(sample_rate, Column) else num(sample_rate))
    rows = rows.selectExpr(p, "rate", f"explode(array({rates})) AS population_rate")
    corrected = rows.withColumn("pd", prior_correct(p, "rate", "population_rate"))
    return corrected.groupBy("population_rate").agg(F.avg("pd").alias("mean_pd"), F.max("pd").alias("max_pd"))


# ---- grades ------------------------------------------------------------------------


def grade(pd: str, scale: list[tuple[str, str, float]] = P.MASTERSCALE) -> Column:
    """First band whose upper bound is not exceeded; missing PDs are unrated."""
    bands = " ".join(f"WHEN {pd} <= {dbl(upper)} THEN '{name}'" for name, _, upper in scale)
    return F.expr(f"CASE WHEN {pd} IS NULL OR isnan({pd}) THEN 'unrated' {bands} ELSE '{scale[-1][0]}' END")


def grade_table(scored: DataFrame, pd: str = "pd", y: str = "y", scale: list[tuple[str, str, float]] = P.MASTERSCALE) -> DataFrame:
    """Counts, mean PD and observed default rate per grade, with its place on the scale."""
    table = scored.withColumn("grade", grade(pd, scale)).groupBy("grade").agg(
        F.count("*").alias("n"), F.sum(F.col(y).cast("bigint")).alias("observed_defaults"), F.avg(pd).alias("mean_pd")
    )
    labels = " ".join(f"WHEN '{g}' THEN '{label}'" for g, label, _ in scale)
    places = " ".join(f"WHEN '{g}' THEN {i}" for i, (g, _, _) in enumerate(scale))
    return table.selectExpr(
        "*", "observed_defaults / cast(n as double) AS observed_default_rate",
        f"CASE grade {labels} END AS label", f"CASE grade {places} ELSE {len(scale)} END AS position",
    )


def monotonicity(table: DataFrame, min_bucket: int = P.MIN_GRADE_BUCKET) -> DataFrame:
    """Grades with their status; a tested grade whose rate falls below its tested neighbour violates.

    The table has one row per grade, so the ordered window is a handful of rows.
    """
    tested = table.where(f"n >= {min_bucket}").selectExpr(
        "grade", "n", "observed_default_rate", "position",
        "lag(grade) OVER (ORDER BY position) AS from_grade",
        "lag(observed_default_rate) OVER (ORDER BY position) AS from_rate",
    ).withColumn("status", F.expr("CASE WHEN observed_default_rate < from_rate - 1e-12D THEN 'violation' ELSE 'ok' END"))
    excluded = table.where(f"n < {min_bucket}").selectExpr(
        "grade", "n", "observed_default_rate", "position", "cast(NULL as string) AS from_grade",
        "cast(NULL as double) AS from_rate", "'excluded_small_n' AS status",
    )
    return tested.unionByName(excluded).drop("position")


# ---- loss given default ------------------------------------------------------------


def class_lgd_sql(recovery: str, seniority: str, industry_distress: bool, enabled: bool = P.DISTRESS_ENABLED) -> str:
    if industry_distress and enabled:
        classes = ", ".join(f"'{c}'" for c in P.DISTRESS_CLASSES)
        recovery = f"CASE WHEN {seniority} IN ({classes}) THEN greatest(0D, {recovery} - {dbl(P.DISTRESS_HAIRCUT)}) ELSE {recovery} END"
    return f"greatest({dbl(P.LGD_FLOOR)}, least({dbl(P.LGD_CAP)}, 1D - ({recovery})))"


def downturn_lgd_sql(recovery: str, haircut: float = P.DOWNTURN_HAIRCUT) -> str:
    return f"greatest({dbl(P.LGD_FLOOR)}, least({dbl(P.LGD_CAP)}, 1D - greatest(0D, {recovery} - {dbl(haircut)})))"


def mix_lgd(
    df: DataFrame,
    mix: str = "exposure",
    industry_distress: bool = False,
    haircut_enabled: bool = P.DISTRESS_ENABLED,
    classes: list[tuple] = P.RECOVERY_CLASSES,
    problems: bool = False,
) -> DataFrame:
    """Blended and downturn LGD of an exposure map, plus what makes a mix unusable.

    Recovery classes are a handful of parameters, so they become literal maps and the
    blend is one projection: no explode, no join, no shuffle.
    """
    lookup = {name: (recovery, basis) for name, recovery, basis, _ in classes}

    def literal_map(values: dict[str, str], kind: str) -> str:
        inner = ", ".join(f"'{k}', {v}" for k, v in values.items())
        return f"map({inner})" if values else f"cast(map() as map<string,{kind}>)"

    normal = literal_map({c: class_lgd_sql(dbl(r), f"'{c}'", industry_distress, haircut_enabled) for c, (r, _) in lookup.items()}, "double")
    stressed = literal_map({c: downturn_lgd_sql(dbl(r)) for c, (r, _) in lookup.items()}, "double")
    basis = literal_map({c: f"'{b}'" for c, (_, b) in lookup.items()}, "string")
    total = f"aggregate(map_values({mix}), 0D, (a, w) -> a + w)"

    def blend(lgds: str) -> str:
        return f"aggregate(map_entries({mix}), 0D, (a, e) -> a + e.value * try_element_at({lgds}, e.key))"

    problem = f"""CASE WHEN {mix} IS NULL OR size({mix}) = 0 THEN 'no exposure mix'
        WHEN {total} IS NULL OR isnan({total}) THEN 'weight missing'
        WHEN abs({total} - 1) > {dbl(P.WEIGHT_TOLERANCE)} THEN 'weights do not sum to 1'
        WHEN exists(map_keys({mix}), k -> try_element_at({basis}, k) IS NULL) THEN 'unknown seniority class'
        WHEN size(array_distinct(transform(map_keys({mix}), k -> try_element_at({basis}, k)))) > 1 THEN 'mixed recovery bases' END"""
    out = df.withColumn("lgd_problem", F.expr(problem)).selectExpr(
        "*",
        f"CASE WHEN lgd_problem IS NULL THEN {blend(normal)} END AS lgd",
        f"CASE WHEN lgd_problem IS NULL THEN {blend(stressed)} END AS lgd_downturn",
    )
    return out if problems else out.drop("lgd_problem")


# ---- exposure at default -----------------------------------------------------------


def facility_ead(tape: DataFrame, factors: dict[str, float] = P.CREDIT_CONVERSION) -> DataFrame:
    """Drawn plus converted undrawn amount; unknown instruments and missing or negative amounts get no EAD but a reason."""
    cases = " ".join(f"WHEN '{k}' THEN {dbl(v)}" for k, v in factors.items())
    return tape.selectExpr(
        "*", f"CASE instrument {cases} END AS ccf"
    ).selectExpr(
        "*",
        "CASE WHEN drawn < 0 OR undrawn < 0 THEN 'negative amount' WHEN ccf IS NULL THEN 'no conversion factor' "
        "WHEN drawn IS NULL OR undrawn IS NULL OR isnan(drawn) OR isnan(undrawn) THEN 'amount missing' END AS ead_problem",
    ).selectExpr(
        "*", "CASE WHEN ead_problem IS NULL THEN drawn + ccf * undrawn END AS ead",
    )


BALANCE_SHEET_EAD = "coalesce(long_term_debt, 0D) + coalesce(current_debt, 0D)"

# ---- expected loss and capital -----------------------------------------------------


def checked(value: str, pd: str = "pd", lgd: str = "lgd", ead: str = "ead") -> Column:
    """Guard a risk formula: a PD or LGD outside [0, 1] or a negative exposure stops the job."""
    fine = f"({pd} BETWEEN 0 AND 1) AND ({lgd} BETWEEN 0 AND 1) AND {ead} >= 0"
    return F.expr(f"CASE WHEN {fine} THEN {value} WHEN {pd} IS NULL OR {lgd} IS NULL OR {ead} IS NULL THEN NULL "
                  f"ELSE double(raise_error('PD and LGD must lie in [0, 1] and EAD must not be negative')) END")


def expected_loss(pd: str = "pd", lgd: str = "lgd", ead: str = "ead") -> Column:
    return checked(f"{pd} * {lgd} * {ead}", pd, lgd, ead)


def floored_pd(pd: str = "pd") -> str:
    return f"greatest({pd}, {dbl(P.IRB_PD_FLOOR)})"


def asset_correlation(pd: str = "pd") -> str:
    return correlation_of(floored_pd(pd))


def correlation_of(floored: str) -> str:
    """Falls from 0.24 to 0.12 as the (floored) PD rises."""
    return f"(0.24D - 0.12D * ((1 - exp(-50 * {floored})) / {dbl(1 - math.exp(-50))}))"


def firm_size_adjusted(correlation: str, sales: str) -> str:
    """Smaller firms (turnover between EUR 5m and 50m) carry less systematic risk; no turnover, no change."""
    return (
        f"CASE WHEN {sales} IS NULL THEN {correlation} "
        f"ELSE {correlation} - 0.04D * (1 - (least(greatest({sales}, 5D), 50D) - 5D) / 45D) END"
    )


def maturity_adjustment(pd: str = "pd") -> str:
    return maturity_slope(floored_pd(pd))


def maturity_slope(floored: str) -> str:
    return f"power(0.11852D - 0.05478D * ln({floored}), 2)"


def with_irb(df: DataFrame, maturity: str | None = None, sales: str | None = None, pd: str = "pd", lgd: str = "lgd") -> DataFrame:
    """Add correlation, maturity factor, conditional PD and the capital requirement K per unit of EAD.

    The floored PD and the roots are projected once; columns of the way are dropped as soon as they are spent.
    """
    m = maturity or dbl(P.IRB_MATURITY)
    worst = dbl(NormalDist().inv_cdf(P.IRB_CONFIDENCE))
    correlation = correlation_of("irb_pd") if sales is None else firm_size_adjusted(correlation_of("irb_pd"), sales)
    out = df.selectExpr("*", f"{floored_pd(pd)} AS irb_pd").selectExpr("*", f"{correlation} AS irb_correlation", f"{maturity_slope('irb_pd')} AS irb_maturity")
    arg = f"(irb_g + sqrt(irb_correlation) * {worst}) / sqrt(1 - irb_correlation) AS irb_arg"
    out = add_norm_quantile(out, "irb_pd", "irb_g").selectExpr("* EXCEPT (irb_g)", arg)
    out = add_norm_cdf(out, "irb_arg", "irb_conditional_pd")
    k = f"greatest(0D, {lgd} * (irb_conditional_pd - irb_pd) * (1 + ({m} - 2.5D) * irb_maturity) / (1 - 1.5D * irb_maturity))"
    return out.withColumn("irb_k", checked(k, pd, lgd, "1D")).drop("irb_arg", "irb_pd")


def risk_weighted_assets(ead: str = "ead") -> Column:
    return F.expr(f"irb_k * {dbl(P.RWA_MULTIPLE)} * {ead}")


def portfolio_totals(df: DataFrame, by: list[str] | None = None, maturity: str | None = None) -> DataFrame:
    """Portfolio sums over columns pd, lgd, ead; `by` breaks them down with subtotals (rollup).

    Every sum and weight runs over one set of rows, the facilities with PD, LGD and EAD.
    Facilities without one of them are counted in `refused_facilities`, and what is known
    of their exposure stands in `refused_ead`.  A value out of range stops the job.
    """
    missing = {"pd", "lgd", "ead"} - set(df.columns)
    if missing:
        raise KeyError(f"portfolio frame lacks {sorted(missing)}")
    usable = "pd IS NOT NULL AND lgd IS NOT NULL AND ead IS NOT NULL AND NOT isnan(pd) AND NOT isnan(lgd) AND NOT isnan(ead)"
    needed = {"pd", "lgd", "ead", maturity, *(by or [])}
    marked = df.select(*[c for c in df.columns if c in needed]).withColumn("usable", F.expr(usable))
    own = [F.when(F.col("usable"), F.col(c)).alias(c) for c in ("pd", "lgd", "ead")]
    kept = [c for c in marked.columns if c not in ("pd", "lgd", "ead")]
    rows = marked.select(*kept, *own, F.when(~F.col("usable") & ~F.isnan("ead"), F.col("ead")).alias("unused_ead"))
    rows = with_irb(rows, maturity).withColumn("el", expected_loss())
    grouped = rows.rollup(*by) if by else rows.groupBy()
    sums = grouped.agg(
        F.count_if("usable").alias("facilities"), F.count_if(~F.col("usable")).alias("refused_facilities"), F.sum("unused_ead").alias("unused"),
        F.sum("ead").alias("total_ead"), F.sum("el").alias("expected_loss"),
        F.sum(F.expr("irb_k * ead")).alias("capital_requirement"),
        F.sum(F.expr("pd * ead")).alias("pd_ead"), F.sum(F.expr("lgd * ead")).alias("lgd_ead"),
    )
    return sums.selectExpr(
        *(by or []), "facilities", "total_ead", "expected_loss", "expected_loss / nullif(total_ead, 0D) AS expected_loss_rate",
        "capital_requirement", f"capital_requirement * {dbl(P.RWA_MULTIPLE)} AS rwa",
        "pd_ead / nullif(total_ead, 0D) AS exposure_weighted_pd", "lgd_ead / nullif(total_ead, 0D) AS exposure_weighted_lgd",
        "refused_facilities", "coalesce(unused, 0D) AS refused_ead",
    )


# ---- issuer exposures --------------------------------------------------------------


def latest_observation(predictions: DataFrame) -> DataFrame:
    """Per issuer its newest observation; each column keeps its last non-null value."""
    columns = [c for c in predictions.columns if c not in ("ticker", "as_of")]
    return predictions.groupBy("ticker").agg(
        F.max("as_of").alias("as_of"),
        *[F.expr(f"max_by(`{c}`, CASE WHEN `{c}` IS NOT NULL THEN as_of END)").alias(c) for c in columns],
    )


def build_exposures(predictions: DataFrame, issuers: DataFrame, portfolio_date=None) -> DataFrame:
    """Issuer-level PD, LGD and EAD (reported debt as a fully drawn proxy).

    With a date the portfolio is the cross-section observed then; without one every
    issuer stands at its latest observation.  Missing debt takes the median of the rest.
    """
    from vintagerisk.operators.prefix import exact_quantiles

    chosen = predictions.where(F.col("as_of") == F.lit(portfolio_date)) if portfolio_date is not None else latest_observation(predictions)
    mix_rows = issuers.select("ticker", F.col("exposure").alias("own_mix"))
    default_mix = "map(" + ", ".join(f"'{k}', {dbl(v)}" for k, v in P.DEFAULT_MIX.items()) + ")"
    debt = "CASE WHEN total_debt > 0 AND NOT isnan(total_debt) AND total_debt < double('Infinity') THEN total_debt END"
    rows = chosen.join(mix_rows, "ticker", "left").selectExpr(
        "*", f"CASE WHEN size(own_mix) > 0 THEN own_mix ELSE {default_mix} END AS mix", f"{debt} AS known_ead",
        "CASE WHEN size(own_mix) > 0 THEN 'issuer mix' ELSE 'default 50/50 secured/unsecured' END AS lgd_mix_basis",
    )
    rows = materialise(mix_lgd(rows, "mix"))  # read for the median and for the exposures
    middle = exact_quantiles(rows.withColumn("all", F.lit(1)), ["all"], "known_ead", [0.5]).agg(F.max("quantile")).scalar()
    return rows.withColumn("median_ead", middle).selectExpr(
        "ticker", "name", "sector", "as_of", "pd", "lgd", "lgd_downturn",
        "coalesce(known_ead, median_ead, 1D) AS ead",
        "CASE WHEN median_ead IS NULL THEN 'proxy: equal weights' ELSE 'proxy: reported debt, fully drawn' END AS ead_basis",
        "lgd_mix_basis", "grade", "label AS defaulted_within_12m",
    )
