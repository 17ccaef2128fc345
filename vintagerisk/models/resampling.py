"""Out-of-fold, leave-one-issuer-out and out-of-time predictions."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagerisk import params as P
from vintagerisk.models import expansion, folds, histogram, left_out, logit
from vintagerisk.operators.panel import require_features
from vintagerisk.operators.prefix import range_splits, running_totals, values_near_ranks
from vintagerisk.sources.storage import materialise

KEYS = ["ticker", "as_of", "group_id"]
EXPAND_FROM = 5_000  # issuers; with fewer a model without one of them is often too far from the whole fit


def training_rows(panel: DataFrame, features: list[str] = P.FEATURES) -> DataFrame:
    """Keys, outcome and features, spread over the cluster and cut from the panel's lineage."""
    require_features(panel, features)
    rows = panel.select(
        "ticker", "as_of", F.col("cik").cast("bigint").alias("group_id"), F.col("label").cast("int").alias("y"),
        *[F.col(f).cast("double").alias(f) for f in features],
    )
    return materialise(rows.repartition(panel.sparkSession.sparkContext.defaultParallelism, "ticker", "as_of"))


def whole_fit(rows: DataFrame, features: list[str] = P.FEATURES) -> logit.Fitted:
    """One model on every row."""
    return logit.fit_models(rows.withColumn("hold", F.array(F.lit(-1))), [(0, 0)], features)


def oof(
    rows: DataFrame, fit: Callable[[DataFrame, list[logit.Model]], Any], score: Callable[[DataFrame, Any, list[str]], DataFrame],
    n_folds: int = P.CV_FOLDS, repeats: int = P.CV_REPEATS, seed: int = P.SEED,
) -> tuple[DataFrame, Any]:
    """Repeated stratified group folds around any model.

    `fit(held, models)` gets the rows with `hold`, per repeat the fold a row is held out of, and the (repeat, fold) of every
    model wanted, so that it can fit them in the same passes; `score(held, fitted, keys)` returns the held-out predictions.
    """
    k = folds.fold_count(rows, folds=n_folds)
    held = materialise(folds.held_out(rows, folds.group_folds(rows, k, repeats, seed)))
    fitted = fit(held, [(r, f) for r in range(repeats) for f in range(k)])
    return score(held, fitted, KEYS), fitted


def grouped_oof(rows: DataFrame, n_folds: int = P.CV_FOLDS, repeats: int = P.CV_REPEATS, seed: int = P.SEED) -> tuple[DataFrame, logit.Fitted]:
    """Out-of-fold probabilities of the logistic pipeline."""
    return oof(rows, logit.fit_models, logit.out_of_fold, n_folds, repeats, seed)


def boosted_oof(rows: DataFrame, n_folds: int = P.CV_FOLDS, repeats: int = P.CV_REPEATS, seed: int = P.SEED, **options: Any) -> tuple[DataFrame, histogram.Forest]:
    """Out-of-fold probabilities of the boosted challenger, `gbt_pd`."""
    return oof(rows, partial(histogram.fit_forest, **options), histogram.out_of_fold, n_folds, repeats, seed)


def out_of_time(rows: DataFrame, split_year: int, year: Column | None = None) -> tuple[DataFrame, logit.Fitted]:
    """Train before the split year, predict from it on."""
    late = F.when((F.year("as_of") if year is None else year) >= split_year, 1).otherwise(0)
    held = rows.withColumn("hold", F.array(late))
    fit = logit.fit_models(held, [(0, 1)])
    return logit.out_of_fold(held, fit, KEYS).where("n_models > 0"), fit


def leave_one_issuer_out(
    rows: DataFrame, batch: int = 1000, features: list[str] = P.FEATURES, expand_from: int = EXPAND_FROM, whole: logit.Fitted | None = None
) -> DataFrame:
    """Predict every issuer from a model that never saw it; `whole` is the fit on all rows, if it is known.

    Leaving an issuer out moves a training quantile by at most its own number of rows, so the bounds of
    every model come from the few values around each overall quantile.  From `expand_from` issuers on the
    models are fitted from sums over all rows (`expansion`).  Those that it cannot settle, and all models of fewer
    issuers, go in batches of `batch` models, each batch a handful of passes of matrix products over all rows (`left_out`).
    """
    held = _indexed(rows, rows.select("group_id").distinct())
    n_issuers, largest = held.where("issuer_index >= 0").groupBy("issuer_index").agg(F.count("*").alias("n")).agg(F.count("*"), F.max("n")).first()
    bands = _bands(held, features, largest)
    whole = whole or whole_fit(held, features)
    curvature = left_out.hessian(whole, held)
    out = None
    if n_issuers >= expand_from and whole.usable[0]:
        sums = expansion.shared_sums(held, whole, _widest_bounds(held, features, bands), held.count())
        if sums is not None:
            scored = materialise(expansion.predictions(held, whole, curvature, sums, partial(_models_without, features=features, bands=bands), KEYS))
            out = scored.where("settled").drop("settled", "issuer_index")
            left = scored.where("NOT settled").select("group_id").distinct()
            n_issuers = left.count()
            held = _indexed(rows, left) if n_issuers else held
    for start in range(0, n_issuers, batch):
        models = [(0, i) for i in range(start, min(start + batch, n_issuers))]
        fit = _bounds_without(held, features, models, bands)
        fit = left_out.settle(left_out.scale_and_weights(fit, whole, held), whole, curvature, held)
        mine = held.where(F.col("issuer_index").between(start, start + batch - 1))
        part = logit.out_of_fold(mine, fit, KEYS)
        out = part if out is None else out.unionByName(part)
    return out


def _indexed(rows: DataFrame, issuers: DataFrame) -> DataFrame:
    """Rows with the place of their issuer among `issuers`, -1 if it is none of them, also as the fold they are held out of."""
    issuers = materialise(issuers.withColumn("one", F.lit(1).cast("bigint")))
    indexed = running_totals(issuers, "group_id", ["one"], range_splits(issuers, "group_id"))
    placed = rows.join(indexed.select("group_id", F.col("one_before").alias("issuer_index")), "group_id", "left")
    return materialise(placed.withColumn("issuer_index", F.expr("coalesce(issuer_index, -1L)")).withColumn("hold", F.array("issuer_index")))


def _quantiles() -> list[float]:
    return [P.WINSOR_QUANTILES[0], 0.5, P.WINSOR_QUANTILES[1]]


def _bands(rows: DataFrame, features: list[str], largest: int) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray, int]]:
    """Per (feature, quantile): values around the quantile, count up to each, and the overall count.

    `largest` is the most rows any issuer has (one per observation date), so a band holds
    a few times that many values.
    """
    pairs = ", ".join(f"{j}, `{f}`" for j, f in enumerate(features))
    long = rows.selectExpr(f"stack({len(features)}, {pairs}) AS (j, value)").where("value IS NOT NULL AND NOT isnan(value)")
    near = values_near_ranks(long, ["j"], "value", _quantiles(), slack=largest)
    picks = []
    for i, q in enumerate(_quantiles()):
        first, last = f"floor((n - 1 - {largest}) * {q!r}D)", f"ceil((n - 1) * {q!r}D) + {largest}"
        picks.append(near.where(f"i IN (-1, {i}) AND v IS NOT NULL AND upto > {first} AND upto - c <= {last}").selectExpr("j", f"{i} AS i", "n", "v", "upto"))
    found = picks[0].unionByName(picks[1]).unionByName(picks[2]).toPandas()
    bands = {}
    for (j, i), part in found.groupby(["j", "i"]):
        part = part.sort_values("v")
        bands[int(j), int(i)] = (part["v"].to_numpy(), part["upto"].to_numpy(), int(part["n"].iloc[0]))
    return bands


def _without(pdf: pd.DataFrame, features: list[str], bands: dict) -> tuple[np.ndarray, np.ndarray]:
    """Issuers of the rows, and for each the quantiles of everyone else's: (quantiles, issuers, features)."""
    pdf = pdf.sort_values("issuer_index")
    issuer, starts = np.unique(pdf["issuer_index"].to_numpy(), return_index=True)
    got = np.empty((3, len(issuer), len(features)))
    got[0], got[1], got[2] = -np.inf, 0.0, np.inf
    for j, name in enumerate(features):
        own = pdf[name].to_numpy(dtype="float64")
        known = np.add.reduceat((~np.isnan(own)).astype("int64"), starts)
        for i, q in enumerate(_quantiles()):
            if (j, i) not in bands:
                continue
            values, upto, n = bands[j, i]
            left = n - known
            remaining = upto - np.add.reduceat((own[:, None] <= values).astype("int64"), starts)
            position = (left - 1) * q
            lower = values[np.argmax(remaining > np.floor(position)[:, None], axis=1)]
            higher = values[np.argmax(remaining > np.ceil(position)[:, None], axis=1)]
            got[i, :, j] = np.where(left > 0, lower + (higher - lower) * (position - np.floor(position)), got[i, :, j])
    return issuer, got


def _models_without(pdf: pd.DataFrame, features: list[str], bands: dict) -> tuple[np.ndarray, logit.Fitted]:
    """Issuers of the rows, and the bounds of their models."""
    issuer, bounds = _without(pdf, features, bands)
    return issuer, logit.bounded(features, [(0, int(i)) for i in issuer], *bounds)


def _dealt(rows: DataFrame, features: list[str]):
    """Whole issuers, some thousand rows a call."""
    return rows.select("issuer_index", *features).groupBy(F.expr("issuer_index DIV 256"))


def _widest_bounds(rows: DataFrame, features: list[str], bands: dict) -> logit.Fitted:
    """The least and the largest bounds of all models, as two models."""

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        fit = _models_without(pdf, features, bands)[1]
        return pd.DataFrame({"j": range(len(features)), "a": fit.low.min(0), "b": fit.low.max(0), "c": fit.high.min(0), "d": fit.high.max(0)})

    found = _dealt(rows, features).applyInPandas(ends, "j int, a double, b double, c double, d double")
    got = found.groupBy("j").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("c").alias("c"), F.max("d").alias("d")).toPandas().sort_values("j")
    low, high = got[["a", "b"]].to_numpy().T, got[["c", "d"]].to_numpy().T
    return logit.Fitted(features, [(0, 0), (0, 1)], low, high, np.zeros_like(low))


def _bounds_without(rows: DataFrame, features: list[str], models: list[logit.Model], bands: dict) -> logit.Fitted:
    """Quantiles of everyone else, for each issuer of the batch."""
    start, stop = models[0][1], models[-1][1]

    def without(pdf: pd.DataFrame) -> pd.DataFrame:
        issuer, bounds = _without(pdf, features, bands)
        i, m, j = np.indices(bounds.shape)
        return pd.DataFrame({"m": issuer[m.ravel()], "i": i.ravel(), "j": j.ravel(), "q": bounds.ravel()})

    table = _dealt(rows.where(F.col("issuer_index").between(start, stop)), features).applyInPandas(without, "m long, i int, j int, q double").toPandas()
    bounds = np.zeros((3, len(models), len(features)))
    bounds[table["i"].to_numpy(), table["m"].to_numpy() - start, table["j"].to_numpy()] = table["q"].to_numpy()
    return logit.bounded(features, models, *bounds)
