"""Many logistic models fitted together, one distributed pass per Newton step.

A row carries, per repeat, the fold it is held out of.  In each pass every task folds its
rows into the gradient and Hessian of every model that trains on them; Spark adds the
partial sums up and the driver solves one small system per model (features squared
numbers each, whatever the data size).  Folds never multiply the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintagerisk import params as P
from vintagerisk.operators.prefix import order_statistics
from vintagerisk.sources.storage import materialise

Model = tuple[int, int]  # (repeat, held-out fold)


@dataclass
class Fitted:
    """Preprocessing and coefficients of a batch of models; arrays are (models, features)."""

    features: list[str]
    models: list[Model]
    low: np.ndarray
    high: np.ndarray
    middle: np.ndarray
    mean: np.ndarray = field(default=None)
    scale: np.ndarray = field(default=None)
    weight_pos: np.ndarray = field(default=None)
    weight_neg: np.ndarray = field(default=None)
    beta: np.ndarray = field(default=None)  # intercept first
    usable: np.ndarray = field(default=None)  # False where training saw one class only
    steps: int = 0
    gradient: float = float("nan")
    n_train: np.ndarray = field(default=None)

    def standardised(self, x: np.ndarray, m: int) -> np.ndarray:
        z = np.clip(x, self.low[m], self.high[m])
        z = np.where(np.isnan(z), self.middle[m], z)
        return (z - self.mean[m]) / self.scale[m]

    def predict(self, x: np.ndarray, m: int) -> np.ndarray:
        eta = self.beta[m, 0] + self.standardised(x, m) @ self.beta[m, 1:]
        return 1.0 / (1.0 + np.exp(-np.clip(eta, -700, 700)))


def _matrix(pdf: pd.DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = pdf[features].to_numpy(dtype="float64")
    hold = np.array(pdf["hold"].tolist(), dtype="int64").reshape(len(pdf), -1)
    return x, pdf["y"].to_numpy(dtype="float64"), hold


def _summed(rows: DataFrame, features: list[str], models: list[Model], width: int, contribution) -> np.ndarray:
    """Sum of `contribution(m, x, y)` over the training rows of every model, as (models, width)."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(models), width))
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x, y, hold = _matrix(pdf, features)
            for m, (repeat, fold) in enumerate(models):
                train = hold[:, repeat] != fold
                total[m] += contribution(m, x[train], y[train])
        index = np.indices(total.shape)
        yield pd.DataFrame({"m": index[0].ravel(), "j": index[1].ravel(), "s": total.ravel()})

    sums = rows.select(*features, "y", "hold").mapInPandas(partial, "m long, j long, s double").groupBy("m", "j").agg(F.sum("s").alias("s"))
    got = sums.toPandas()  # models x width numbers
    out = np.zeros((len(models), width))
    out[got["m"].to_numpy(), got["j"].to_numpy()] = got["s"].to_numpy()
    return out


OFFSETS = [0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128]
CELL_STEPS = 512
SORTED_AT_ONCE = 100_000


def _cells(rows: DataFrame, features: list[str], quantiles: list[float]) -> list[np.ndarray]:
    """Ascending edges per feature, close together around the wanted quantiles of all rows.  Some 80 numbers a feature."""
    near = {round(q * CELL_STEPS) + side * o for q in quantiles for o in OFFSETS for side in (-1, 1)}
    probabilities = sorted(k / CELL_STEPS for k in near if 0 <= k <= CELL_STEPS)
    found = rows.agg(*[F.percentile_approx(F.expr(f"nanvl(`{f}`, NULL)"), probabilities, 10 * CELL_STEPS).alias(f"e{j}") for j, f in enumerate(features)]).first()
    return [np.unique(np.array(found[j] or [], dtype="float64")) for j in range(len(features))]


def _cell_of(edges: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Odd cells hold the rows that equal an edge, even ones those between two edges (or outside all)."""
    return np.searchsorted(edges, x) + np.searchsorted(edges, x, side="right")


def _cell_counts(rows: DataFrame, features: list[str], edges: list[np.ndarray], repeats: int, folds: int) -> list[np.ndarray]:
    """Per feature: rows of each (cell, repeat, fold), the last fold being "held out of nothing that is fitted"."""
    shapes = [(2 * len(e) + 1, repeats, folds + 1) for e in edges]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = [np.zeros(s, dtype="int64") for s in shapes]
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x, _, hold = _matrix(pdf, features)
            hold = np.where((hold < 0) | (hold >= folds), folds, hold)
            for j, total in enumerate(totals):
                known = ~np.isnan(x[:, j])
                cell = _cell_of(edges[j], x[known, j])
                for r in range(repeats):
                    total[:, r] += np.bincount(cell * (folds + 1) + hold[known, r], minlength=total[:, r].size).reshape(-1, folds + 1)
        for j, total in enumerate(totals):
            at = np.flatnonzero(total)
            yield pd.DataFrame({"j": j, "k": at, "n": total.ravel()[at]})

    got = rows.select(*features, "y", "hold").mapInPandas(partial, "j long, k long, n long").groupBy("j", "k").agg(F.sum("n").alias("n")).toPandas()
    out = [np.zeros(s, dtype="int64") for s in shapes]
    for j, part in got.groupby("j"):
        out[j].ravel()[part["k"].to_numpy()] = part["n"].to_numpy()
    return out


def _rows_of_cells(rows: DataFrame, features: list[str], edges: list[np.ndarray], cells: dict, schema: str, made) -> DataFrame:
    """What `made(j, cell, values, hold)` gives for the rows of each wanted cell of a batch."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x, _, hold = _matrix(pdf, features)
            places = [np.where(np.isnan(x[:, j]), -1, _cell_of(edges[j], x[:, j])) for j in range(len(features))]
            for j, cell in cells:
                at = np.flatnonzero(places[j] == cell)
                if len(at):
                    yield made(j, cell, x[at, j], hold[at])

    return rows.select(*features, "y", "hold").mapInPandas(deal, schema)


def _ranks_of_cells(rows: DataFrame, features: list[str], edges: list[np.ndarray], models: list[Model], cells: dict) -> dict:
    """Ranks within cells of bounded size: each cell is sorted once for all models."""
    if not cells:
        return {}

    def sent(j: int, cell: int, values: np.ndarray, hold: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"j": j, "cell": cell, "v": values, "hold": list(hold.astype("int32"))})

    def ranked(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        values, hold = pdf["v"].to_numpy(), np.array(pdf["hold"].tolist(), dtype="int32").reshape(len(pdf), -1)
        own: dict[int, list[tuple[int, int, int]]] = {}
        for m, i, side, rank in cells[int(key[0]), int(key[1])]:
            own.setdefault(m, []).append((i, side, rank))
        got = []
        for m, asked in own.items():
            trains = values[hold[:, models[m][0]] != models[m][1]]
            got += [(m, int(key[0]), i, side, trains[rank]) for i, side, rank in asked]
        return pd.DataFrame(got, columns=["m", "j", "i", "side", "v"])

    sent_once = _rows_of_cells(rows, features, edges, cells, "j int, cell int, v double, hold array<int>", sent)
    got = sent_once.groupBy("j", "cell").applyInPandas(ranked, "m int, j int, i int, side int, v double").collect()  # models x features x 6 numbers
    return {(e.m, e.j, e.i, e.side): e.v for e in got}


def _ranks_of_models(rows: DataFrame, features: list[str], edges: list[np.ndarray], models: list[Model], cells: dict) -> dict:
    """Ranks within cells of any size: each model gets its own rows of a cell."""
    if not cells:
        return {}

    def sent(j: int, cell: int, values: np.ndarray, hold: np.ndarray) -> pd.DataFrame:
        own = sorted({m for m, *_ in cells[j, cell]})
        trains = [np.flatnonzero(hold[:, models[m][0]] != models[m][1]) for m in own]
        return pd.DataFrame({"m": np.repeat(own, list(map(len, trains))), "j": j, "cell": cell, "v": values[np.concatenate(trains)]})

    near = materialise(_rows_of_cells(rows, features, edges, cells, "m int, j int, cell int, v double", sent))
    asked = [(m, j, cell, 2 * i + side, rank) for (j, cell), own in cells.items() for m, i, side, rank in own]
    table = rows.sparkSession.createDataFrame(asked, "m int, j int, cell int, i int, rank long")  # models x features x 6 numbers
    return {(e.m, e.j, e.i // 2, e.i % 2): e.a for e in order_statistics(near, ["m", "j", "cell"], table).collect()}


def quantile_bounds(rows: DataFrame, features: list[str], models: list[Model], quantiles: tuple[float, float] = P.WINSOR_QUANTILES) -> Fitted:
    """Winsor bounds and median of every feature on each model's training rows.  Missing values are skipped.

    What trains a model is all rows but a fold, so its order statistics lie close to those of all rows.  One pass counts the
    rows of every fold in cells around these; all less the fold's own says in which cell a rank of a model lies.
    A rank among rows that equal an edge is that edge, however many they are.  Of the other cells, each of about one row
    in 500, the rows are sent once: their task sorts a cell and reads off the ranks of every model.  Cells of more
    than `SORTED_AT_ONCE` rows are given to the models row by row and their ranks found in a few passes.  A rank may
    lie in any cell, the two outermost included, so the bounds are exact whatever the folds hold.
    """
    wanted = [quantiles[0], 0.5, quantiles[1]]
    repeats, folds = max(r for r, _ in models) + 1, max(f for _, f in models) + 1
    edges = _cells(rows, features, wanted)
    counts = _cell_counts(rows, features, edges, repeats, folds)
    found: dict[tuple[int, int, int, int], float] = {}  # (model, feature, quantile, 0 for the rank below and 1 for the one above)
    shares: dict[tuple[int, int, int], float] = {}
    cells: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}  # (feature, cell) -> (model, quantile, below or above, rank in the cell)
    for j, count in enumerate(counts):
        every = count[:, 0].sum(axis=1)
        for m, (r, f) in enumerate(models):
            upto = np.cumsum(every - count[:, r, f])
            if upto[-1] == 0:
                continue
            for i, q in enumerate(wanted):
                position = (upto[-1] - 1) * q
                shares[m, j, i] = position - np.floor(position)
                for side, rank in enumerate((int(np.floor(position)), int(np.ceil(position)))):
                    cell = int(np.searchsorted(upto, rank, side="right"))
                    if cell % 2:
                        found[m, j, i, side] = float(edges[j][cell // 2])
                    else:
                        cells.setdefault((j, cell), []).append((m, i, side, rank - (int(upto[cell - 1]) if cell else 0)))
    held = {(j, cell): int(counts[j][cell, 0].sum()) for j, cell in cells}
    small = {at: own for at, own in cells.items() if held[at] <= SORTED_AT_ONCE}
    large = {at: own for at, own in cells.items() if held[at] > SORTED_AT_ONCE}
    found |= _ranks_of_cells(rows, features, edges, models, small) | _ranks_of_models(rows, features, edges, models, large)
    shape = (len(models), len(features))
    low, middle, high = np.full(shape, -np.inf), np.zeros(shape), np.full(shape, np.inf)
    for (m, j, i), share in shares.items():
        a, b = found[m, j, i, 0], found[m, j, i, 1]
        (low, middle, high)[i][m, j] = a + (b - a) * share if share < 0.5 else b - (b - a) * (1 - share)
    return bounded(features, models, low, middle, high)


def bounded(features: list[str], models: list[Model], low: np.ndarray, middle: np.ndarray, high: np.ndarray) -> Fitted:
    """A flat column must not be clipped to one value; the median follows the clip."""
    flat = low >= high
    low, high = np.where(flat, -np.inf, low), np.where(flat, np.inf, high)
    return Fitted(features, models, low, high, np.clip(middle, low, high))


def scale_and_weights(fit: Fitted, rows: DataFrame, balanced: bool = True, standardise: bool = True) -> Fitted:
    """Mean and population deviation after clipping and imputing; balanced class weights."""
    d = len(fit.features)
    low, high, middle = fit.low, fit.high, fit.middle

    def moments(m: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = np.clip(x, low[m], high[m])
        z = np.where(np.isnan(z), middle[m], z) - middle[m]
        return np.concatenate([[len(y), y.sum()], z.sum(axis=0), (z * z).sum(axis=0)])

    s = _summed(rows, fit.features, fit.models, 2 + 2 * d, moments)
    n, pos = s[:, 0], s[:, 1]
    safe = np.maximum(n, 1)[:, None]
    shift = s[:, 2 : 2 + d] / safe
    variance = np.maximum(s[:, 2 + d :] / safe - shift**2, 0.0)
    if standardise:
        fit.mean = middle + shift
        fit.scale = np.where(variance > 1e-20, np.sqrt(variance), 1.0)
    else:
        fit.mean, fit.scale = np.zeros_like(shift), np.ones_like(shift)
    fit.usable = (pos > 0) & (pos < n)
    fit.n_train = n.astype("int64")
    fit.weight_pos = n / (2 * np.maximum(pos, 1)) if balanced else np.ones(len(n))
    fit.weight_neg = n / (2 * np.maximum(n - pos, 1)) if balanced else np.ones(len(n))
    return fit


def newton(fit: Fitted, rows: DataFrame, c: float = P.LOGIT_C, tolerance: float = 1e-9, max_steps: int = 50) -> Fitted:
    """Minimise weighted log-loss + ridge on the slopes; a step that raises the loss is halved."""
    d = len(fit.features) + 1
    ridge = np.diag([0.0] + [1.0 / c] * (d - 1))
    upper = np.triu_indices(d)
    beta = np.zeros((len(fit.models), d))
    previous, step, loss_before = beta.copy(), np.zeros_like(beta), np.full(len(beta), np.inf)
    done = ~fit.usable

    for fit.steps in range(1, max_steps + 1):
        active = [m for m in range(len(beta)) if not done[m]]
        if not active:
            break
        fit.beta = beta
        current = fit
        chosen = [fit.models[m] for m in active]

        def derivatives(a: int, x: np.ndarray, y: np.ndarray, active=active, current=current) -> np.ndarray:
            m = active[a]
            z = np.column_stack([np.ones(len(y)), current.standardised(x, m)])
            eta = z @ current.beta[m]
            p = 1.0 / (1.0 + np.exp(-np.clip(eta, -700, 700)))
            w = np.where(y == 1, current.weight_pos[m], current.weight_neg[m])
            loss = float((w * (np.logaddexp(0.0, eta) - y * eta)).sum())
            hessian = z.T @ (z * (w * p * (1 - p))[:, None])
            return np.concatenate([[loss], z.T @ (w * (p - y)), hessian[upper]])

        s = _summed(rows, fit.features, chosen, 1 + d + len(upper[0]), derivatives)
        worst = 0.0
        for a, m in enumerate(active):
            loss = s[a, 0] + 0.5 * float(beta[m, 1:] @ beta[m, 1:]) / c
            gradient = s[a, 1 : 1 + d] + ridge @ beta[m]
            if loss > loss_before[m] * (1 + 1e-12) + 1e-12:
                step[m] *= 0.5
                beta[m] = previous[m] + step[m]
                worst = max(worst, 1.0)
                continue
            size = float(np.abs(gradient).max()) / max(float(fit.n_train[m]), 1.0)
            worst = max(worst, size)
            if size < tolerance:
                done[m] = True
                continue
            hessian = np.zeros((d, d))
            hessian[upper] = s[a, 1 + d :]
            hessian = hessian + np.triu(hessian, 1).T + ridge
            previous[m], loss_before[m] = beta[m].copy(), loss
            step[m] = -np.linalg.solve(hessian + 1e-12 * np.eye(d), gradient)
            beta[m] = previous[m] + step[m]
        fit.gradient = worst
    fit.beta = beta
    return fit


def fit_models(rows: DataFrame, models: list[Model], features: list[str] = P.FEATURES, c: float = P.LOGIT_C) -> Fitted:
    """The full pipeline (winsorise, impute the median, scale, balanced ridge logit) for every model at once.

    `rows` has the features, `y` and `hold`, and should be materialised: it is read once per step.
    """
    return newton(scale_and_weights(quantile_bounds(rows, features, models), rows), rows, c=c)


def out_of_fold(rows: DataFrame, fit: Fitted, keys: list[str]) -> DataFrame:
    """Mean held-out probability per row over the repeats that scored it; NULL if none did."""
    features = fit.features
    place = {model: m for m, model in enumerate(fit.models)}

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, _, hold = _matrix(pdf, features)
            total, count = np.zeros(len(pdf)), np.zeros(len(pdf), dtype="int64")
            for (repeat, fold), m in place.items():
                mine = hold[:, repeat] == fold
                if fit.usable[m] and mine.any():
                    total[mine] += fit.predict(x[mine], m)
                    count[mine] += 1
            out = pdf[[*keys, "y"]].copy()
            out["raw_pd"] = np.where(count > 0, total / np.maximum(count, 1), np.nan)
            out["n_models"] = count
            yield out

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([f"{k} {types[k]}" for k in [*keys, "y"]] + ["raw_pd double", "n_models long"])
    scored = rows.select(*keys, "y", "hold", *features).mapInPandas(score, schema)
    return scored.withColumn("raw_pd", F.expr("CASE WHEN n_models > 0 THEN raw_pd END"))
