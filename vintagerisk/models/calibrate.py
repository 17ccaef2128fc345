"""Calibration maps (Platt, isotonic), cross-fitted by issuer, and the calibration slope."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintagerisk import params as P
from vintagerisk.functions.numeric import clamp_sql, dbl, logit_sql
from vintagerisk.models import folds
from vintagerisk.models.isotonic import StepMaps, fit_steps
from vintagerisk.sources.storage import materialise


@dataclass
class Line:
    """Logistic line on a logit: y ~ intercept + slope * logit(p)."""

    intercept: float
    slope: float
    n: int
    positives: int

    @property
    def fitted(self) -> bool:
        return 0 < self.positives < self.n

    def sql(self, p: str) -> str:
        eta = f"({dbl(self.intercept)} + {dbl(self.slope)} * ({logit_sql(p, P.PROBABILITY_EPS)}))"
        return f"(1D / (1D + exp(-{eta})))"


def fit_lines(scored: DataFrame, train: list[str], ridge: float, p: str = "p", y: str = "y", max_steps: int = 60) -> list[Line]:
    """One logistic line per training condition, all in the same passes.

    Rows are first counted per distinct probability and condition pattern; every Newton
    step is then one aggregation of five sums per model, on the JVM.
    """
    wanted = ", ".join(f"CASE WHEN {t} THEN {m} END" for m, t in enumerate(train))
    counted = (
        scored.where(f"{p} IS NOT NULL")
        .selectExpr(f"{logit_sql(p, P.PROBABILITY_EPS)} AS x", f"cast({y} as double) AS y", f"array_compact(array({wanted})) AS models")
        .groupBy("x", "models").agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("k"))
        .selectExpr("x", "n", "k", "explode(models) AS m")
        .persist()
    )
    spark = scored.sparkSession
    totals = {r.m: (int(r.n), int(r.k)) for r in counted.groupBy("m").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).collect()}
    lines = [Line(0.0, 0.0, *totals.get(m, (0, 0))) for m in range(len(train))]
    before = [math.inf] * len(lines)
    last, step = [(0.0, 0.0)] * len(lines), [(0.0, 0.0)] * len(lines)
    done = [not line.fitted for line in lines]
    eta, q = "(a + b * x)", "(1D / (1D + exp(-(a + b * x))))"
    terms = {
        "loss": f"n * (greatest({eta}, 0D) + ln(1D + exp(-abs({eta})))) - k * {eta}",
        "g0": f"n * {q} - k", "g1": f"(n * {q} - k) * x",
        "h00": f"n * {q} * (1D - {q})", "h01": f"n * {q} * (1D - {q}) * x", "h11": f"n * {q} * (1D - {q}) * x * x",
    }
    sums = [F.sum(F.expr(sql)).alias(name) for name, sql in terms.items()]
    while not all(done) and max_steps > 0:
        max_steps -= 1
        current = ", ".join(f"({m}, {dbl(line.intercept)}, {dbl(line.slope)})" for m, line in enumerate(lines) if not done[m])
        # the coefficients travel as rows, one per model, so every step runs the same compiled plan
        betas = spark.sql(f"SELECT * FROM VALUES {current} AS betas(m, a, b)")
        for row in counted.join(F.broadcast(betas), "m").groupBy("m").agg(*sums).collect():
            m, line = row.m, lines[row.m]
            loss = row.loss + 0.5 * ridge * line.slope**2
            if loss > before[m] * (1 + 1e-12) + 1e-12:  # overshot: halve the step
                step[m] = (step[m][0] / 2, step[m][1] / 2)
            else:
                g0, g1 = row.g0, row.g1 + ridge * line.slope
                if max(abs(g0), abs(g1)) / line.n < 1e-11:
                    done[m] = True
                    continue
                h00, h01, h11 = row.h00, row.h01, row.h11 + ridge
                det = h00 * h11 - h01 * h01
                before[m], last[m] = loss, (line.intercept, line.slope)
                step[m] = (-(h11 * g0 - h01 * g1) / det, -(h00 * g1 - h01 * g0) / det)
            line.intercept, line.slope = last[m][0] + step[m][0], last[m][1] + step[m][1]
    counted.unpersist()
    return lines


def platt(scored: DataFrame, p: str = "p", y: str = "y", c: float = P.LOGIT_C) -> Line:
    """Logistic map with a ridge on the slope (not plain Platt scaling)."""
    return fit_lines(scored, ["true"], 1.0 / c, p, y)[0]


def calibration_slope(scored: DataFrame, p: str = "p", y: str = "y") -> Line:
    """Unpenalised regression of the outcome on the predicted logit: slope 1, intercept 0 is perfect."""
    return fit_lines(scored, ["true"], 0.0, p, y)[0]


def isotonic_fit(scored: DataFrame, p: str = "p", y: str = "y") -> StepMaps:
    """Monotone map from probability to observed rate; rows are first counted per distinct probability."""
    rows = scored.selectExpr(f"nanvl({p}, NULL) AS score", f"cast({y} as bigint) AS y").where("score IS NOT NULL")
    return fit_steps(rows.groupBy("score").agg(F.array(F.count("*")).alias("n"), F.array(F.sum("y")).alias("k")), 1)


def isotonic_apply(model: StepMaps, scored: DataFrame, p: str = "p") -> DataFrame:
    """Adds `isotonic`. Each distinct probability is looked up once."""
    levels = scored.selectExpr(f"nanvl({p}, NULL) AS score").where("score IS NOT NULL").distinct().withColumn("m", F.lit(0))
    rates = model.rates(levels).selectExpr("score AS level_score", "rate AS isotonic")
    return scored.join(rates, F.col(p) == F.col("level_score"), "left").drop("level_score")


def cross_fitted_calibration(
    scored: DataFrame, method: str = "isotonic", n_folds: int = P.CV_FOLDS, seed: int = P.SEED,
    p: str = "p", y: str = "y", group: str = "group_id", min_positives: int = P.MIN_POSITIVES_ISOTONIC,
) -> tuple[DataFrame, str]:
    """Calibrate every issuer by a map learned on other issuers only.

    Isotonic needs enough positives in its training folds, else Platt; a training set of
    one class leaves its fold as it is.  Returns the frame with `calibrated` and the
    method most folds used.  The input is read once: the maps of all folds are fitted
    together from the counts per probability and fold.
    """
    keyed = materialise(scored.withColumn("group_id", F.col(group).cast("bigint")).withColumn("y_int", F.col(y).cast("int")))
    k = folds.fold_count(keyed, y="y_int", folds=n_folds)
    dealt = folds.group_folds(keyed, k, 1, seed, y="y_int").select("group_id", "fold")
    bounded = clamp_sql(f"nanvl({p}, NULL)", dbl(P.PROBABILITY_EPS), dbl(1 - P.PROBABILITY_EPS))
    rows = materialise(keyed.join(dealt, "group_id").drop("y_int").withColumn("level_score", F.expr(bounded)))
    lines = fit_lines(rows, [f"fold <> {f}" for f in range(k)], 1.0 / P.LOGIT_C, "level_score", y)
    stepped = [f for f, line in enumerate(lines) if method == "isotonic" and line.fitted and line.positives >= min_positives]
    straight = [f for f, line in enumerate(lines) if line.fitted and f not in stepped]
    whens = " ".join([f"WHEN fold = {f} THEN {lines[f].sql('level_score')}" for f in straight])
    if stepped:
        held = lambda value: ", ".join(f"sum({value}) - coalesce(sum(CASE WHEN fold = {f} THEN {value} END), 0)" for f in range(k))
        counted = rows.where("level_score IS NOT NULL").groupBy(F.col("level_score").alias("score")).agg(
            F.expr(f"array({held('1L')})").alias("n"), F.expr(f"array({held(f'cast({y} as bigint)')})").alias("k")
        )
        levels = rows.where(F.col("fold").isin(stepped) & F.col("level_score").isNotNull()).selectExpr("fold AS m", "level_score AS score").distinct()
        rates = fit_steps(counted, k).rates(levels).selectExpr("m AS fold", "score AS level_score", "rate AS isotonic_rate")
        rows = rows.join(rates, ["fold", "level_score"], "left").select(*rows.columns, "isotonic_rate")
        whens += f" WHEN fold IN ({', '.join(map(str, stepped))}) THEN isotonic_rate"
    calibrated = f"CASE {whens} ELSE level_score END" if whens else "level_score"
    out = rows.withColumn("calibrated", F.expr(calibrated)).drop("level_score", "isotonic_rate")
    used = Counter({"isotonic": len(stepped), "platt": len(straight)})
    clipped = clamp_sql("calibrated", dbl(P.PROBABILITY_EPS), dbl(1 - P.PROBABILITY_EPS))
    return out.withColumn("calibrated", F.expr(clipped)), (used.most_common(1)[0][0] if stepped or straight else "none")
