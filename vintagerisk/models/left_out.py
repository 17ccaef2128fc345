"""Leave-one-issuer-out logistic fits that share their sums.

Leaving one issuer out moves a clip bound by a few ranks, so a value is clipped low, clipped high, missing or kept alike in all
models of a batch, but for the few that lie between two models' bounds. Of all other rows the linear predictor of every model is one
matrix product of the same columns: kept values and three flags a feature. Rows with a value between bounds are worked out model by
model, and an issuer's own rows are taken out of its model. The fits start from the whole fit and keep its Hessian; only gradients
are summed, until they vanish. A model that does not settle so goes through the Newton steps of `logit.newton`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintagerisk import params as P
from vintagerisk.models import logit
from vintagerisk.models.logit import Fitted

CELLS = 1 << 21  # numbers of a task's largest array


class Columns:
    """The columns that the models of a batch share, around the middle and scale of the whole fit."""

    def __init__(self, fit: Fitted, whole: Fitted) -> None:
        self.centre = whole.middle[0]
        self.spread = whole.scale[0]
        self.low, self.high, self.middle = fit.low, fit.high, fit.middle
        self.low_ends = fit.low.min(0), fit.low.max(0)
        self.high_ends = fit.high.min(0), fit.high.max(0)

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which rows are alike in all models, their columns: kept values, clipped low, clipped high, missing)."""
        missing = np.isnan(x)
        low, high = x <= self.low_ends[0], x >= self.high_ends[1]
        kept = (x >= self.low_ends[1]) & (x <= self.high_ends[0]) & ~low & ~high
        alike = ((missing | kept | (low ^ high)) & ~np.isinf(x)).all(1)
        value = np.where(kept, (x - self.centre) / self.spread, 0.0)
        return alike, np.hstack([value, low, high, missing])[alike]

    def steps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What a flag adds to the centre in each model; a bound that clips nothing has no flags."""
        return tuple(np.where(np.isinf(b), 0.0, b - self.centre) for b in (self.low, self.high, self.middle))

    def clipped(self, x: np.ndarray, m: np.ndarray | slice) -> np.ndarray:
        z = np.clip(x, self.low[m], self.high[m])
        return np.where(np.isnan(z), self.middle[m], z)


def _totals(rows: DataFrame, features: list[str], shape: tuple[int, int], task: Callable[[Iterator[tuple]], np.ndarray]) -> np.ndarray:
    """Sum over all tasks of the (models, width) numbers that `task` makes of its (x, y, issuer_index) batches."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = task((pdf[features].to_numpy("float64"), pdf["y"].to_numpy("float64"), pdf["issuer_index"].to_numpy()) for pdf in batches if len(pdf))
        index = np.indices(shape)
        yield pd.DataFrame({"m": index[0].ravel(), "j": index[1].ravel(), "s": total.ravel()})

    sums = rows.select(*features, "y", "issuer_index").mapInPandas(partial, "m long, j long, s double").groupBy("m", "j").agg(F.sum("s").alias("s"))
    got = sums.toPandas()  # models x width numbers
    out = np.zeros(shape)
    out[got["m"].to_numpy(), got["j"].to_numpy()] = got["s"].to_numpy()
    return out


def _pieces(n: int, width: int) -> Iterator[slice]:
    step = max(1, CELLS // width)
    return (slice(at, at + step) for at in range(0, n, step))


def scale_and_weights(fit: Fitted, whole: Fitted, rows: DataFrame) -> Fitted:
    """`logit.scale_and_weights` of a batch of models, model i without issuer i of the batch."""
    columns, (n_models, d), first = Columns(fit, whole), fit.low.shape, fit.models[0][1]

    def task(batches: Iterator[tuple]) -> np.ndarray:
        count, value, square, flags = np.zeros(2), np.zeros(d), np.zeros(d), np.zeros(3 * d)
        total = np.zeros((n_models, 2 + 2 * d))
        for x, y, issuer in batches:
            alike, a = columns.split(x)
            count += alike.sum(), y[alike].sum()
            value += a[:, :d].sum(0)
            square += (a[:, :d] ** 2).sum(0)
            flags += a[:, d:].sum(0)
            odd, own = np.flatnonzero(~alike), np.flatnonzero((issuer >= first) & (issuer < first + n_models))
            for piece in _pieces(len(odd), n_models * d):
                at = odd[piece]
                u = columns.clipped(x[at, None, :], slice(None)) - columns.centre
                total += np.hstack([np.tile([len(at), y[at].sum()], (n_models, 1)), u.sum(0), (u * u).sum(0)])
            m = issuer[own] - first
            u = columns.clipped(x[own], m) - columns.centre
            np.subtract.at(total, m, np.column_stack([np.ones(len(own)), y[own], u, u * u]))
        total[:, :2] += count
        total[:, 2 : 2 + d] += value * columns.spread
        total[:, 2 + d :] += square * columns.spread**2
        for k, step in enumerate(columns.steps()):
            n = flags[k * d : (k + 1) * d]
            total[:, 2 : 2 + d] += n * step
            total[:, 2 + d :] += n * step**2
        return total

    s = _totals(rows, fit.features, (n_models, 2 + 2 * d), task)
    n, pos = np.rint(s[:, 0]), np.rint(s[:, 1])
    shift = s[:, 2 : 2 + d] / np.maximum(n, 1)[:, None]
    variance = np.maximum(s[:, 2 + d :] / np.maximum(n, 1)[:, None] - shift**2, 0.0)
    return replace(
        fit, mean=columns.centre + shift, scale=np.where(variance > 1e-20, np.sqrt(variance), 1.0), usable=(pos > 0) & (pos < n), n_train=n.astype("int64"),
        weight_pos=n / (2 * np.maximum(pos, 1)), weight_neg=n / (2 * np.maximum(n - pos, 1)),
    )


def gradients(fit: Fitted, whole: Fitted, rows: DataFrame) -> np.ndarray:
    """Gradient of the log-loss of every model at its coefficients."""
    columns, (n_models, d), first = Columns(fit, whole), fit.low.shape, fit.models[0][1]
    slope = fit.beta[:, 1:] / fit.scale
    steps = columns.steps()
    intercept = fit.beta[:, 0] + (slope * (columns.centre - fit.mean)).sum(1)
    coefficients = np.hstack([slope * columns.spread, *(slope * step for step in steps)]).T
    weights = np.stack([fit.weight_neg, fit.weight_pos])

    def residual(eta: np.ndarray, y: np.ndarray, issuer: np.ndarray) -> np.ndarray:
        np.clip(eta, -700, 700, out=eta)
        np.negative(eta, out=eta)
        np.exp(eta, out=eta)
        eta += 1.0
        np.reciprocal(eta, out=eta)
        eta -= y[:, None]
        for c in (0, 1):
            eta[y == c] *= weights[c]
        own = np.flatnonzero((issuer >= first) & (issuer < first + n_models))
        eta[own, issuer[own] - first] = 0.0
        return eta

    def task(batches: Iterator[tuple]) -> np.ndarray:
        level, shared, odd_sums = np.zeros(n_models), np.zeros((4 * d, n_models)), np.zeros((n_models, d))
        for x, y, issuer in batches:
            alike, a = columns.split(x)
            y_a, issuer_a = y[alike], issuer[alike]
            for piece in _pieces(len(a), n_models):
                r = residual(a[piece] @ coefficients + intercept, y_a[piece], issuer_a[piece])
                level += r.sum(0)
                shared += a[piece].T @ r
            odd = np.flatnonzero(~alike)
            for piece in _pieces(len(odd), n_models * d):
                at = odd[piece]
                u = columns.clipped(x[at, None, :], slice(None)) - columns.centre
                r = residual(np.einsum("nmd,md->nm", u, slope) + intercept, y[at], issuer[at])
                level += r.sum(0)
                odd_sums += np.einsum("nm,nmd->md", r, u)
        u_sums = odd_sums + shared[:d].T * columns.spread
        for k, step in enumerate(steps):
            u_sums += shared[(k + 1) * d : (k + 2) * d].T * step
        return np.column_stack([level, (u_sums + level[:, None] * (columns.centre - fit.mean)) / fit.scale])

    return _totals(rows, fit.features, (n_models, 1 + d), task)


def hessian(whole: Fitted, rows: DataFrame, c: float = P.LOGIT_C) -> np.ndarray:
    """Hessian of the whole fit's objective at its coefficients."""
    d = len(whole.features) + 1
    upper = np.triu_indices(d)

    def curvature(m: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.ones(len(y)), whole.standardised(x, 0)])
        p = whole.predict(x, 0)
        w = np.where(y == 1, whole.weight_pos[0], whole.weight_neg[0]) * p * (1 - p)
        return (z.T @ (z * w[:, None]))[upper]

    out = np.zeros((d, d))
    out[upper] = logit._summed(rows.withColumn("hold", F.array(F.lit(-1))), whole.features, whole.models, len(upper[0]), curvature)[0]
    return out + np.triu(out, 1).T + np.diag([0.0] + [1.0 / c] * (d - 1))


def settle(fit: Fitted, whole: Fitted, curvature: np.ndarray, rows: DataFrame, c: float = P.LOGIT_C, tolerance: float = 1e-12, max_steps: int = 12) -> Fitted:
    """Coefficients of every model: steps with one Hessian as long as each shrinks the gradient tenfold, Newton steps for the rest."""
    n_models, d = fit.low.shape
    fit = replace(fit, beta=np.tile(whole.beta[0], (n_models, 1)))
    ridge = np.r_[0.0, np.full(d, 1.0 / c)]
    done, last = ~fit.usable, np.full(n_models, np.inf)
    slow = np.zeros(n_models, bool)
    for fit.steps in range(1, max_steps + 1):
        at = np.flatnonzero(~done & ~slow)
        if not len(at):
            break
        gradient = gradients(fit, whole, rows)[at] + ridge * fit.beta[at]
        size = np.abs(gradient).max(1) / np.maximum(fit.n_train[at], 1.0)
        done[at] |= size < tolerance
        slow[at] = ~done[at] & (size > 0.1 * last[at])
        last[at] = size
        moving = ~done[at] & ~slow[at]
        fit.beta[at[moving]] -= np.linalg.solve(curvature, gradient[moving].T).T
    fit.gradient = float(last[done & fit.usable].max(initial=0.0))
    rest = np.flatnonzero(~done)
    if len(rest):
        pick = lambda v: v[rest]
        part = Fitted(
            fit.features, [fit.models[m] for m in rest], *map(pick, (fit.low, fit.high, fit.middle, fit.mean, fit.scale, fit.weight_pos, fit.weight_neg)),
            usable=fit.usable[rest], n_train=fit.n_train[rest],
        )
        fit.beta[rest] = logit.newton(part, rows, c).beta
    return fit
