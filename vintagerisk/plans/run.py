"""The whole chain on one issuer panel, from the universe gate to capital and the report tables.

Held-out probabilities are made first; everything after them (validation, calibration,
grades, loss, capital) reads these and never a probability of a model's own training rows.
What several steps read is stored once in the shared folder, the rest is lazy.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagerisk import params as P
from vintagerisk.functions.numeric import dbl
from vintagerisk.models import bootstrap, calibrate, logit, resampling
from vintagerisk.operators import calibration_tests, diagnostics, discrimination, portfolio, scores, stability, universe
from vintagerisk.operators.prefix import exact_quantiles, score_ladder
from vintagerisk.sources.storage import materialise, write_csv, write_json


@dataclass
class Settings:
    folds: int = P.CV_FOLDS
    repeats: int = P.CV_REPEATS
    draws: int = P.BOOTSTRAP_DRAWS
    seed: int = P.SEED
    split_year: int | None = None
    portfolio_date: dt.date | None = None
    calibration: str = "isotonic"
    population_rate: float = P.POPULATION_RATE
    prior_correction: bool = True
    leave_one_out: bool = True
    require_verified: bool = True  # the gate refuses defaults that nobody has verified
    boosting_repeats: int = P.CV_REPEATS  # 0 leaves the challenger out
    boosting_rounds: int = P.GBT_ROUNDS


@dataclass
class RunResult:
    panel: DataFrame
    warnings: DataFrame
    diagnostics: DataFrame
    hardness: DataFrame
    missing: DataFrame
    defaulters_without_positive: DataFrame
    discrimination: DataFrame | None = None
    benchmark: DataFrame | None = None
    coefficients: DataFrame | None = None
    sign_violations: DataFrame | None = None
    predictions: DataFrame | None = None
    calibration: DataFrame | None = None
    reliability: DataFrame | None = None
    sensitivity: DataFrame | None = None
    stability: DataFrame | None = None
    grade_table: DataFrame | None = None
    monotonicity: DataFrame | None = None
    backtest: DataFrame | None = None
    exposures: DataFrame | None = None
    portfolio: DataFrame | None = None
    extra: dict[str, str] = field(default_factory=dict)


def coefficient_table(spark: SparkSession, fit: logit.Fitted) -> DataFrame:
    """Standardised coefficients with the sign credit theory expects."""
    rows = [(f, float(fit.beta[0, j + 1]), P.EXPECTED_SIGN.get(f, 0)) for j, f in enumerate(fit.features)]
    return spark.createDataFrame(rows, "feature string, coefficient double, expected_sign int").selectExpr(
        "*", "CASE WHEN abs(coefficient) > 1e-8D THEN cast(sign(coefficient) as int) ELSE 0 END AS actual_sign"
    ).selectExpr("*", "expected_sign = 0 OR actual_sign = 0 OR expected_sign = actual_sign AS sign_consistent")


def sign_violations(table: DataFrame, smallest: float = P.SIGN_MATERIALITY) -> DataFrame:
    return table.where(f"NOT sign_consistent AND abs(coefficient) >= {smallest}")


def _with_risk_score(panel: DataFrame) -> DataFrame:
    """Z'' with risk orientation; unscored rows take the cohort median so both models face the same rows."""
    scored = materialise(scores.score_panel(panel))  # read for the median and for the rows
    middle = exact_quantiles(scored.withColumn("cohort", F.lit(1)), ["cohort"], "z_double_prime", [0.5]).select("quantile").scalar()
    return scored.withColumn("risk_score", -F.coalesce("z_double_prime", middle))


def _discrimination_row(name: str, scored: DataFrame, score: str, settings: Settings, interval: bool = True) -> DataFrame:
    whole = discrimination.separation(score_ladder(scored, score))
    if not interval:
        return whole.selectExpr(f"'{name}' AS model", "auc", "cast(NULL as double) AS lower", "cast(NULL as double) AS upper", "0L AS n_draws", "gini", "ks")
    found = bootstrap.bootstrap_auc(scored, score, "y", "group_id", settings.draws, settings.seed)
    return found.withColumn("ks", whole.select("ks").scalar()).selectExpr(f"'{name}' AS model", "auc", "lower", "upper", "n_draws", "2 * auc - 1 AS gini", "ks")


def run(panel: DataFrame, issuers: DataFrame, settings: Settings | None = None) -> RunResult:
    s = settings or Settings()
    spark = panel.sparkSession
    universe.require_valid(issuers, s.require_verified)
    panel = materialise(_with_risk_score(panel))
    result = RunResult(
        panel=panel,
        warnings=diagnostics.coverage_warnings(panel),
        diagnostics=diagnostics.panel_diagnostics(panel),
        hardness=diagnostics.control_group_hardness(panel),
        missing=diagnostics.worst_missing(panel),
        defaulters_without_positive=diagnostics.defaulters_without_positive(issuers, panel),
    )
    if not panel.where("label = 1").head(1):
        return result  # nothing can be validated without a positive

    rows = resampling.training_rows(panel)
    whole = resampling.whole_fit(rows)
    result.coefficients = coefficient_table(spark, whole)
    result.sign_violations = sign_violations(result.coefficients)

    oof, _ = resampling.grouped_oof(rows, s.folds, s.repeats, s.seed)
    meta = panel.select("ticker", "as_of", "name", "sector", "total_debt", "z_double_prime", "z_zone", "risk_score")
    oof = materialise(oof.where("raw_pd IS NOT NULL").join(meta, ["ticker", "as_of"]))

    found = [
        _discrimination_row("logistic_oof", oof, "raw_pd", s),
        _discrimination_row("altman_zpp", rows.select("ticker", "as_of", "group_id", "y").join(meta, ["ticker", "as_of"]), "risk_score", s),
    ]
    if s.leave_one_out:
        left_out = materialise(resampling.leave_one_issuer_out(rows, whole=whole))
        found.append(_discrimination_row("logistic_leave_one_issuer_out", left_out, "raw_pd", s, interval=False))
    if s.boosting_repeats:
        boosted, _ = resampling.boosted_oof(rows, s.folds, s.boosting_repeats, s.seed, rounds=s.boosting_rounds)
        boosted = materialise(boosted.where("gbt_pd IS NOT NULL"))
        found.append(_discrimination_row("gbm_oof", boosted, "gbt_pd", s))
    if s.split_year is not None:
        late, _ = resampling.out_of_time(rows, s.split_year)
        found.append(_discrimination_row("logistic_out_of_time", materialise(late), "raw_pd", s, interval=False))
        result.stability = stability.psi_by_feature(panel, P.FEATURES, F.year("as_of") >= s.split_year)
    result.discrimination = materialise(reduce(DataFrame.unionByName, found))
    result.benchmark = bootstrap.paired_difference(oof, "raw_pd", "risk_score", "y", "group_id", s.draws, s.seed)

    # calibration, cross-fitted by issuer, then the shift to the population rate
    calibrated, method = calibrate.cross_fitted_calibration(oof, s.calibration, s.folds, s.seed, p="raw_pd")
    rate = float(oof.agg(F.avg("y")).first()[0])
    shift = portfolio.prior_correct("calibrated", dbl(rate), dbl(s.population_rate)) if s.prior_correction else F.col("calibrated")
    predictions = materialise(
        calibrated.withColumn("pd", shift).withColumn("grade", portfolio.grade("pd")).withColumn("row_id", F.xxhash64("ticker", "as_of"))
    )
    result.extra = {"calibration_method": method}
    slope = calibrate.calibration_slope(predictions, "calibrated")
    brier = calibration_tests.brier_decomposition(predictions, p="calibrated")
    test = calibration_tests.hosmer_lemeshow(predictions, p="calibrated", key="row_id")
    levels = predictions.agg(
        F.avg("y").alias("sample_default_rate"), F.avg("calibrated").alias("mean_pd_before_correction"), F.avg("pd").alias("mean_pd_after_correction")
    )
    result.calibration = reduce(
        DataFrame.unionByName,
        [
            metric_rows(levels, 6), metric_rows(brier, 6), metric_rows(test, 6, prefix="hosmer_lemeshow_"),
            spark.createDataFrame(
                [(6, "calibration_slope", slope.slope), (6, "calibration_intercept", slope.intercept), (6, "population_default_rate", s.population_rate)],
                "section int, metric string, value double",
            ).selectExpr("*", "cast(NULL as string) AS text"),
            text_rows(spark, 6, {"calibration_method": method}),
        ],
    )
    result.reliability = calibration_tests.reliability_table(predictions, p="calibrated", key="row_id")
    result.sensitivity = portfolio.pd_sensitivity(predictions, rate, p="calibrated")
    result.predictions = predictions.selectExpr(
        "ticker", "name", "sector", "as_of", "y AS label", "total_debt", "raw_pd", "calibrated AS calibrated_pd", "pd", "z_double_prime", "z_zone", "grade"
    )
    result.backtest = calibration_tests.annual_backtest(result.predictions, F.year("as_of"), "calibrated_pd", "label")
    result.grade_table = portfolio.grade_table(result.predictions, "pd", "label")
    result.monotonicity = portfolio.monotonicity(result.grade_table)
    result.exposures = materialise(portfolio.build_exposures(result.predictions, issuers, s.portfolio_date))
    result.portfolio = portfolio.portfolio_totals(result.exposures)
    return result


# ---- report tables -----------------------------------------------------------------


def metric_rows(one_row: DataFrame, section: int, prefix: str = "") -> DataFrame:
    """A one-row frame of numbers and labels as long (section, metric, value, text) rows."""
    numeric = {"bigint", "int", "double"}
    parts = []
    for f in one_row.schema.fields:
        value, text = (f"cast(`{f.name}` as double)", "cast(NULL as string)") if f.dataType.simpleString() in numeric else ("cast(NULL as double)", f"cast(`{f.name}` as string)")
        parts.append(f"struct('{prefix}{f.name}' AS metric, {value} AS value, {text} AS text)")
    return one_row.selectExpr(f"{section} AS section", f"inline(array({', '.join(parts)}))")


def text_rows(spark: SparkSession, section: int, texts: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([(section, k, None, v) for k, v in texts.items()], "section int, metric string, value double, text string")


def labelled_rows(table: DataFrame, section: int, label: str, columns: list[str]) -> DataFrame:
    """A table as long rows named `<label>.<column>`."""
    parts = ", ".join(f"struct(concat({label}, '.{c}') AS metric, cast({c} as double) AS value, cast(NULL as string) AS text)" for c in columns)
    return table.selectExpr(f"{section} AS section", f"inline(array({parts}))")


def report_tables(result: RunResult) -> DataFrame:
    """Every report figure as (section, metric, value, text): limitations first, sourced inputs last."""
    spark = result.panel.sparkSession
    rows = [
        metric_rows(result.diagnostics.select("observations", "issuers", "positive_labels", "defaulted_issuers", "sample_default_rate"), 1),
        result.warnings.selectExpr("1 AS section", "concat('warning: ', warning, ' ', subject) AS metric", "value", "cast(NULL as string) AS text"),
        result.defaulters_without_positive.selectExpr(
            "1 AS section", "concat('no usable observation: ', ticker) AS metric", "cast(NULL as double) AS value", "cast(default_date as string) AS text"
        ),
        metric_rows(result.hardness, 1),
        metric_rows(result.diagnostics.select("median_report_lag_days", "source_mix", "observation_years"), 2),
        labelled_rows(result.missing, 2, "feature", ["missing_share"]),
    ]
    if result.discrimination is not None:
        rows += [
            labelled_rows(result.discrimination, 3, "model", ["auc", "lower", "upper", "gini", "ks"]),
            metric_rows(result.benchmark.selectExpr("difference", "lower", "upper", "n_draws", "verdict"), 4, prefix="paired_"),
            labelled_rows(result.coefficients, 5, "feature", ["coefficient", "expected_sign", "actual_sign"]),
            result.sign_violations.selectExpr("5 AS section", "concat('sign violation: ', feature) AS metric", "coefficient AS value", "cast(NULL as string) AS text"),
            result.calibration,
            labelled_rows(result.reliability, 6, "concat('bucket ', cast(bucket as string))", ["n", "mean_predicted_pd", "observed_default_rate"]),
            labelled_rows(result.sensitivity, 6, "concat('population rate ', cast(population_rate as string))", ["mean_pd", "max_pd"]),
        ]
        if result.stability is not None:
            rows.append(labelled_rows(result.stability, 7, "feature", ["psi"]))
        rows += [
            labelled_rows(result.grade_table, 8, "concat('grade ', grade)", ["n", "observed_defaults", "mean_pd", "observed_default_rate"]),
            result.monotonicity.selectExpr("8 AS section", "concat('grade ', grade, '.status') AS metric", "cast(NULL as double) AS value", "status AS text"),
            labelled_rows(result.backtest, 9, "cast(year as string)", ["issuers", "expected_defaults", "realised_defaults", "z"]),
            metric_rows(result.portfolio, 9),
        ]
    rows.append(text_rows(spark, 10, {name: source for name, _, _, source in P.RECOVERY_CLASSES}))
    return reduce(DataFrame.unionByName, rows)


def write_outputs(result: RunResult, folder: str) -> None:
    """Panel, predictions, exposures and report tables as files."""
    write_csv(result.panel, f"{folder}/panel")
    if result.predictions is not None:
        write_csv(result.predictions, f"{folder}/predictions")
    if result.exposures is not None:
        write_csv(result.exposures, f"{folder}/exposures")
    write_json(report_tables(result), f"{folder}/report")
