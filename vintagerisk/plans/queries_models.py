"""Model queries: fits, resampling, calibration maps, bootstrap, the end-to-end run."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagerisk import params as P
from vintagerisk.functions.numeric import tidy
from vintagerisk.models import boosting, bootstrap, calibrate, folds, logit, resampling
from vintagerisk.operators import scores
from vintagerisk.operators.panel import design_columns
from vintagerisk.operators.prefix import exact_quantiles
from vintagerisk.plans.core import issuer_panel, query
from vintagerisk.plans.run import RunResult, Settings, coefficient_table, report_tables, run, sign_violations
from vintagerisk.sources import tape


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.training_rows(issuer_panel(spark, sf_dir))


@query
def q_winsorise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clip bounds of every feature, and how many values they move."""
    fit_rows = resampling.materialise(issuer_panel(spark, sf_dir).select(*P.FEATURES))  # read for the bounds and for the clipping
    pairs = ", ".join(f"'{f}', `{f}`" for f in P.FEATURES)
    long = fit_rows.selectExpr(f"stack({len(P.FEATURES)}, {pairs}) AS (feature, value)").where("value IS NOT NULL")
    bounds = exact_quantiles(long, ["feature"], "value", list(P.WINSOR_QUANTILES)).groupBy("feature").agg(
        F.max(F.expr("CASE WHEN i = 0 THEN quantile END")).alias("low"), F.max(F.expr("CASE WHEN i = 1 THEN quantile END")).alias("high")
    ).selectExpr("feature", "CASE WHEN low < high THEN low END AS low", "CASE WHEN low < high THEN high END AS high")
    clipped = long.join(F.broadcast(bounds), "feature").selectExpr(
        "feature", "low", "high", "value", "CASE WHEN low IS NULL THEN value ELSE greatest(low, least(high, value)) END AS clipped"
    )
    out = clipped.groupBy("feature", "low", "high").agg(
        F.count("*").alias("n"), F.count_if(F.col("clipped") != F.col("value")).alias("n_clipped"), F.avg("clipped").alias("mean_clipped")
    )
    return tidy(out, low=6, high=6, mean_clipped=6)


@query
def q_preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, mean and deviation each feature is imputed and scaled with."""
    rows = model_rows(spark, sf_dir).withColumn("hold", F.array(F.lit(-1)))
    fit = logit.scale_and_weights(logit.quantile_bounds(rows, P.FEATURES, [(0, 0)]), rows)
    table = [(f, float(fit.middle[0, j]), float(fit.mean[0, j]), float(fit.scale[0, j]), int(fit.n_train[0])) for j, f in enumerate(P.FEATURES)]
    out = spark.createDataFrame(table, "feature string, median double, mean double, deviation double, n_rows long")
    return tidy(out, median=6, mean=6, deviation=6)


@query
def q_design_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a fit gets to see: keys, label and every feature as a double."""
    return tidy(design_columns(issuer_panel(spark, sf_dir)), **{f: 6 for f in P.FEATURES})


@query
def q_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(boosting.class_weights(tape.scored(spark, sf_dir)), weight=9)


@query
def q_risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z'' turned to risk orientation; unscored rows take the cohort median instead of dropping out."""
    panel = scores.score_panel(issuer_panel(spark, sf_dir)).withColumn("cohort", F.lit(1))
    middle = exact_quantiles(panel, ["cohort"], "z_double_prime", [0.5]).select("quantile").scalar()
    out = panel.withColumn("risk_score", -F.coalesce("z_double_prime", middle))
    return tidy(out.select("ticker", "as_of", "risk_score"), risk_score=6)


def own_gradient(rows: DataFrame, fit: logit.Fitted, m: int = 0) -> DataFrame:
    """Gradient of the objective at the fitted coefficients, written out as column arithmetic."""
    def bound(x: float) -> str:
        return f"double('{'-' if x < 0 else ''}Infinity')" if abs(x) == float("inf") else f"{float(x)!r}D"

    z = {
        f: f"((coalesce(greatest({bound(fit.low[m, j])}, least({bound(fit.high[m, j])}, {f})) * CASE WHEN {f} IS NULL THEN NULL ELSE 1 END, "
        f"{float(fit.middle[m, j])!r}D) - {float(fit.mean[m, j])!r}D) / {float(fit.scale[m, j])!r}D)"
        for j, f in enumerate(fit.features)
    }
    names = ["intercept", *fit.features]
    beta = [float(b) for b in fit.beta[m]]
    scaled = rows.selectExpr("y", *[f"{z[f]} AS {f}" for f in fit.features])
    eta = " + ".join([f"{beta[0]!r}D", *[f"{b!r}D * {f}" for b, f in zip(beta[1:], fit.features)]])
    weight = f"CASE WHEN y = 1 THEN {float(fit.weight_pos[m])!r}D ELSE {float(fit.weight_neg[m])!r}D END"
    residual = f"({weight}) * (1D / (1D + exp(-({eta}))) - y)"
    sums = scaled.withColumn("residual", F.expr(residual)).agg(
        F.sum("residual").alias("intercept"), *[F.sum(F.expr(f"residual * {f}")).alias(f) for f in fit.features], F.count("*").alias("n_train")
    )
    pairs = ", ".join(f"'{n}', `{n}` + {0.0 if i == 0 else beta[i] / P.LOGIT_C!r}D" for i, n in enumerate(names))
    return sums.selectExpr("n_train", f"stack({len(names)}, {pairs}) AS (term, gradient)")


@query
def q_logit_foc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the fitted coefficients the gradient of every term vanishes."""
    rows = model_rows(spark, sf_dir)
    gradient = own_gradient(rows, resampling.whole_fit(rows))
    return gradient.selectExpr("term", "n_train", "abs(gradient) < 1e-5D AS at_optimum")


@query
def q_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = coefficient_table(spark, resampling.whole_fit(model_rows(spark, sf_dir)))
    return tidy(table.orderBy(F.desc(F.abs("coefficient"))), coefficient=6)


@query
def q_sign_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = coefficient_table(spark, resampling.whole_fit(model_rows(spark, sf_dir)))
    return tidy(sign_violations(table), coefficient=6)


@query
def q_group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = issuer_panel(spark, sf_dir).selectExpr("cast(cik as bigint) AS group_id", "label AS y")
    return folds.group_folds(rows, P.CV_FOLDS, repeats=P.CV_REPEATS)


@query
def q_fold_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and positives each fold tests, and issuers found on both sides of it (none)."""
    rows = issuer_panel(spark, sf_dir).selectExpr("cast(cik as bigint) AS group_id", "ticker", "as_of", "label AS y")
    dealt = folds.group_folds(rows, P.CV_FOLDS, repeats=P.CV_REPEATS)
    placed = rows.join(dealt, "group_id")
    sides = placed.groupBy("repeat", "ticker").agg(F.count_distinct("fold").alias("folds_of_issuer"))
    leaks = sides.groupBy("repeat").agg(F.count_if(F.col("folds_of_issuer") > 1).alias("leaked_issuers"))
    tested = placed.groupBy("repeat", "fold").agg(
        F.count("*").alias("n_test"), F.sum("y").cast("bigint").alias("positives"), F.count_distinct("ticker").alias("issuers")
    )
    return tested.join(leaks, "repeat")


_OOF: dict[tuple[str, str], DataFrame] = {}


def oof_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold probabilities, fitted once per session and data set and kept in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OOF:
        scored, _ = resampling.grouped_oof(model_rows(spark, sf_dir))
        _OOF[key] = resampling.materialise(scored)
    return _OOF[key]


@query
def q_oof_pd(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = oof_predictions(spark, sf_dir)
    return scored.selectExpr("ticker", "as_of", "y", "n_models", "raw_pd > 0 AND raw_pd < 1 AS in_range")


@query
def q_loio_pd(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = resampling.leave_one_issuer_out(model_rows(spark, sf_dir))
    return scored.selectExpr("ticker", "as_of", "y", "n_models", "raw_pd > 0 AND raw_pd < 1 AS in_range")


@query
def q_out_of_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = resampling.out_of_time(model_rows(spark, sf_dir), split_year=2000)
    return scored.selectExpr("ticker", "as_of", "y", "raw_pd > 0 AND raw_pd < 1 AS in_range")


@query
def q_gbm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Challenger fitted on the whole panel, scored on it."""
    rows = model_rows(spark, sf_dir)
    scored = boosting.predict(boosting.fit_booster(rows), rows)
    return tidy(scored.select("ticker", "as_of", "y", "gbt_pd"), gbt_pd=6)


@query
def q_gbm_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out probabilities of the boosted challenger: all repeats and folds, grown together."""
    scored, _ = resampling.boosted_oof(model_rows(spark, sf_dir))
    return tidy(scored.select("ticker", "as_of", "y", "n_models", "gbt_pd"), gbt_pd=6)


@query
def q_bootstrap_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(bootstrap.bootstrap_auc(tape.scored(spark, sf_dir)), auc=8, lower=8, upper=8)


@query
def q_paired_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = tape.scored(spark, sf_dir).withColumn("p2", F.expr("-abs(p - 0.2D)"))
    return tidy(bootstrap.paired_difference(scored, "p", "p2"), difference=8, lower=8, upper=8)


def _line(spark: SparkSession, line: calibrate.Line) -> DataFrame:
    out = spark.createDataFrame([(line.intercept, line.slope, line.n, line.positives)], "intercept double, slope double, n long, positives long")
    return tidy(out, intercept=6, slope=6)


@query
def q_platt_foc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line(spark, calibrate.platt(tape.scored(spark, sf_dir)))


@query
def q_calibration_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line(spark, calibrate.calibration_slope(tape.scored(spark, sf_dir)))


@query
def q_isotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isotonic rate at every distinct score."""
    scored = tape.scored(spark, sf_dir)
    levels = scored.groupBy("p").agg(F.count("*").alias("n"))
    out = calibrate.isotonic_apply(calibrate.isotonic_fit(scored), levels)
    return tidy(out.select("p", "n", "isotonic"), p=12, isotonic=8)


@query
def q_crossfit_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Platt and isotonic maps cross-fitted by group: calibrated probabilities of each fold."""
    found = None
    for method in ("platt", "isotonic"):
        out, used = calibrate.cross_fitted_calibration(tape.scored(spark, sf_dir), method=method, group="grp")
        folded = out.groupBy("fold").agg(
            F.count("*").alias("n"), F.sum("y").cast("bigint").alias("defaults"), F.avg("calibrated").alias("mean_calibrated"), F.max("calibrated").alias("max_calibrated"),
            F.avg(F.col("calibrated") ** 2).alias("mean_square"),
        ).withColumn("method", F.lit(used))
        found = folded if found is None else found.unionByName(folded)
    return tidy(found, mean_calibrated=6, max_calibrated=6, mean_square=6)


_RUNS: dict[tuple[str, str], RunResult] = {}


def full_run(spark: SparkSession, sf_dir: str) -> RunResult:
    """The end-to-end run, once per session and data set; its frames live in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RUNS:
        # the stand-in issuers are partly unverified; the boosted challenger has a query of its own
        settings = Settings(split_year=2000, portfolio_date=dt.date(1999, 6, 30), require_verified=False, boosting_repeats=0)
        _RUNS[key] = run(issuer_panel(spark, sf_dir), tape.issuers(spark, sf_dir), settings)
    return _RUNS[key]


@query
def q_discrimination_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(full_run(spark, sf_dir).discrimination, auc=6, lower=6, upper=6, gini=6, ks=6)


@query
def q_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(full_run(spark, sf_dir).predictions, total_debt=4, raw_pd=6, calibrated_pd=6, pd=8, z_double_prime=6)


@query
def q_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline figures: sample, discrimination, benchmark verdict, loss and capital."""
    result = full_run(spark, sf_dir)
    return tidy(report_tables(result).where("section IN (1, 3, 4, 9)"), value=6)


@query
def q_report_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(report_tables(full_run(spark, sf_dir)).orderBy("section", "metric"), value=6)
