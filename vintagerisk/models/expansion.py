"""Leave-one-issuer-out fits whose work grows with the rows and the issuers, not with their product.

In the columns of `left_out` all rows but a few have one form for all models, and the linear predictor of a model is their product
with its coefficients, which lie close to the whole fit's.  The residuals are expanded in the difference up to its third power: the
sums of products of up to four columns, taken once over all rows, give the gradient of every model. The rows with a value
between two models' bounds and an issuer's own rows are worked out as they are. Tasks then fit a group of issuers each.

What the expansion leaves out is bounded per model.  A model is settled only if its gradient vanishes and that bound is
below `REMAINDER` a row, far under the tolerance of the other fits; the caller fits the others on all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintagerisk import params as P
from vintagerisk.models import logit
from vintagerisk.models.left_out import Columns, _pieces
from vintagerisk.models.logit import Fitted

REMAINDER = 1e-11
FOURTH = 0.128  # no fourth derivative of the logistic function is larger
MOST_ODD = 20_000  # rows with a value between bounds; there are some per issuer date and bound unless a column is nearly flat
ROWS_PER_TASK = 20_000
ISSUERS_PER_CALL = 256
BLOCK = 1 << 14  # numbers of a partial sum's row

Without = Callable[[pd.DataFrame], tuple[np.ndarray, Fitted]]  # rows -> issuers and their bounds


@dataclass
class Sums:
    """What all models share; arrays lead with the outcome."""

    columns: Columns
    centre: np.ndarray  # coefficients of the whole fit in these columns
    active: np.ndarray  # columns that are not zero throughout
    largest: np.ndarray  # absolute value of a kept value, by feature
    plain: np.ndarray  # products of two columns
    odd: tuple[np.ndarray, np.ndarray]
    powers: list[np.ndarray] | None = None  # coefficients of the powers 0 to 3


def _coefficients(fit: Fitted, columns: Columns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slopes, intercepts, coefficients of all columns) of every model."""
    slope = fit.beta[:, 1:] / fit.scale
    intercept = fit.beta[:, 0] + (slope * (columns.centre - fit.mean)).sum(1)
    return slope, intercept, np.hstack([intercept[:, None], slope * columns.spread, *(slope * s for s in columns.steps())])


def _design(columns: Columns, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    alike, a = columns.split(x)
    return alike, np.column_stack([np.ones(len(a)), a])


def _added(rows: DataFrame, features: list[str], sizes: list[int], task: Callable[[Iterator[tuple]], list[np.ndarray]]) -> list[np.ndarray]:
    """Element-wise sums over all tasks of the arrays that `task` makes of its (x, y) batches."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flat = np.concatenate([v.ravel() for v in task((pdf[features].to_numpy("float64"), pdf["y"].to_numpy("int64")) for pdf in batches if len(pdf))])
        for k, at in enumerate(range(0, len(flat), BLOCK)):
            yield pd.DataFrame({"k": [k], "s": [flat[at : at + BLOCK].tobytes()]})

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [key[0]], "s": [sum(np.frombuffer(s) for s in pdf["s"]).tobytes()]})

    got = rows.select(*features, "y").mapInPandas(partial, "k int, s binary").groupBy("k").applyInPandas(add, "k int, s binary").collect()
    flat = np.concatenate([np.frombuffer(r.s) for r in sorted(got, key=lambda r: r.k)])
    return np.split(flat, np.cumsum(sizes)[:-1])


def _odd_rows(rows: DataFrame, features: list[str], columns: Columns) -> DataFrame:
    def odd(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[~columns.split(pdf[features].to_numpy("float64"))[0]]

    chosen = rows.select(*features, "y")
    return chosen.mapInPandas(odd, chosen.schema)


def shared_sums(rows: DataFrame, whole: Fitted, ends: Fitted, n_rows: int) -> Sums | None:
    """Sums over all rows, `ends` being the least and the largest bounds of all models; None if these leave many rows between them."""
    features, d = whole.features, len(whole.features)
    width = 1 + 4 * d
    columns = Columns(ends, whole)
    odd = _odd_rows(rows, features, columns)
    if odd.count() > MOST_ODD:
        return None
    odd = odd.toPandas()
    rows = rows.coalesce(max(1, min(rows.rdd.getNumPartitions(), n_rows // ROWS_PER_TASK)))

    def products(batches: Iterator[tuple]) -> list[np.ndarray]:
        total = np.zeros((2, width, width))
        for x, y in batches:
            alike, a = _design(columns, x)
            for c in (0, 1):
                mine = a[y[alike] == c]
                total[c] += mine.T @ mine
        return [total]

    plain = _added(rows, features, [2 * width * width], products)[0].reshape(2, width, width)
    centre = _coefficients(whole, Columns(whole, whole))[2][0]
    kept = [F.when(F.col(f).between(float(columns.low_ends[1][j]), float(columns.high_ends[0][j])), F.abs(F.col(f) - float(columns.centre[j])) / float(columns.spread[j])) for j, f in enumerate(features)]
    largest = np.array([v or 0.0 for v in rows.agg(*[F.max(v).alias(f) for v, f in zip(kept, features, strict=True)]).first()])
    sums = Sums(columns, centre, np.flatnonzero(np.diagonal(plain.sum(0)) > 0), largest, plain, (odd[features].to_numpy("float64"), odd["y"].to_numpy("int64")))
    active, k = sums.active, len(sums.active)
    first, second = np.triu_indices(k)
    pairs = len(first)

    def expanded(batches: Iterator[tuple]) -> list[np.ndarray]:
        out = [np.zeros((2, k)), np.zeros((2, k, k)), np.zeros((2, pairs, k)), np.zeros((2, pairs, pairs))]
        for x, y in batches:
            alike, a = _design(columns, x)
            p = 1 / (1 + np.exp(-np.clip(a @ centre, -700, 700)))
            y, a = y[alike], a[:, active]
            for c in (0, 1):
                of = np.flatnonzero(y == c)
                for piece in _pieces(len(of), pairs):
                    b, s = a[of[piece]], p[of[piece], None]
                    q = s * (1 - s)
                    both = b[:, first] * b[:, second]
                    out[0][c] += ((s - c) * b).sum(0)
                    out[1][c] += b.T @ (q * b)
                    out[2][c] += both.T @ (q * (1 - 2 * s) / 2 * b)
                    out[3][c] += both.T @ (q * (1 - 6 * q) / 6 * both)
        return out

    shapes = [(2, k), (2, k, k), (2, pairs, k), (2, pairs, pairs)]
    found = _added(rows, features, [int(np.prod(s)) for s in shapes], expanded)
    return replace(sums, powers=[v.reshape(s) for v, s in zip(found, shapes, strict=True)])


def _scaled(fit: Fitted, columns: Columns, sums: Sums, x: np.ndarray, y: np.ndarray, at: np.ndarray) -> Fitted:
    """`left_out.scale_and_weights` from the shared sums; row i belongs to the issuer of model at[i]."""
    n_models, d = fit.low.shape
    every = sums.plain.sum(0)
    total = np.zeros((n_models, 2 + 2 * d))
    total[:, 0], total[:, 1] = every[0, 0], sums.plain[1, 0, 0]
    total[:, 2 : 2 + d] = every[0, 1 : 1 + d] * columns.spread
    total[:, 2 + d :] = np.diagonal(every)[1 : 1 + d] * columns.spread**2
    for i, step in enumerate(columns.steps()):
        n = every[0, 1 + (i + 1) * d : 1 + (i + 2) * d]
        total[:, 2 : 2 + d] += n * step
        total[:, 2 + d :] += n * step**2
    odd_x, odd_y = sums.odd
    for piece in _pieces(len(odd_y), n_models * d):
        u = columns.clipped(odd_x[piece, None, :], slice(None)) - columns.centre
        total += np.hstack([np.tile([len(u), odd_y[piece].sum()], (n_models, 1)), u.sum(0), (u * u).sum(0)])
    u = columns.clipped(x, at) - columns.centre
    np.subtract.at(total, at, np.column_stack([np.ones(len(y)), y, u, u * u]))
    n, pos = np.rint(total[:, 0]), np.rint(total[:, 1])
    shift = total[:, 2 : 2 + d] / np.maximum(n, 1)[:, None]
    variance = np.maximum(total[:, 2 + d :] / np.maximum(n, 1)[:, None] - shift**2, 0.0)
    return replace(
        fit, mean=columns.centre + shift, scale=np.where(variance > 1e-20, np.sqrt(variance), 1.0), usable=(pos > 0) & (pos < n), n_train=n.astype("int64"),
        weight_pos=n / (2 * np.maximum(pos, 1)), weight_neg=n / (2 * np.maximum(n - pos, 1)),
    )


def _gradients(fit: Fitted, columns: Columns, sums: Sums, x: np.ndarray, y: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gradient of the log-loss of every model at its coefficients, difference of its column coefficients from the whole fit's)."""
    n_models, d = fit.low.shape
    slope, intercept, coefficients = _coefficients(fit, columns)
    difference = coefficients - sums.centre
    near = difference[:, sums.active]
    k = near.shape[1]
    first, second = np.triu_indices(k)
    squares = near[:, first] * near[:, second] * np.where(first == second, 1.0, 2.0)
    matrix = np.zeros((k, k), dtype="int64")
    matrix[first, second] = matrix[second, first] = np.arange(len(first))
    weights = np.stack([fit.weight_neg, fit.weight_pos])
    shared = np.zeros((n_models, 1 + 4 * d))
    for c in (0, 1):
        zeroth, linear, square, cube = (v[c] for v in sums.powers)
        cubic = np.einsum("mij,mj->mi", (squares @ cube)[:, matrix], near)
        shared[:, sums.active] += weights[c][:, None] * (zeroth + near @ linear + squares @ square + cubic)

    def residual(eta: np.ndarray, of: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return weight * (1 / (1 + np.exp(-np.clip(eta, -700, 700))) - of)

    level = shared[:, 0].copy()
    u_sums = shared[:, 1 : 1 + d] * columns.spread
    for i, step in enumerate(columns.steps()):
        u_sums += shared[:, 1 + (i + 1) * d : 1 + (i + 2) * d] * step
    odd_x, odd_y = sums.odd
    for piece in _pieces(len(odd_y), n_models * d):
        u = columns.clipped(odd_x[piece, None, :], slice(None)) - columns.centre
        r = residual(np.einsum("nmd,md->nm", u, slope) + intercept, odd_y[piece, None], weights[odd_y[piece]])
        level += r.sum(0)
        u_sums += np.einsum("nm,nmd->md", r, u)
    u = columns.clipped(x, at) - columns.centre
    r = residual((u * slope[at]).sum(1) + intercept[at], y, weights[y, at])
    np.subtract.at(level, at, r)
    np.subtract.at(u_sums, at, r[:, None] * u)
    return np.column_stack([level, (u_sums + level[:, None] * (columns.centre - fit.mean)) / fit.scale]), difference


def _remainder(fit: Fitted, columns: Columns, sums: Sums, difference: np.ndarray) -> np.ndarray:
    """Bound of what the fourth and higher powers add to a gradient, a row."""
    d = fit.low.shape[1]
    value, *flags = (np.abs(difference[:, 1 + i * d : 1 + (i + 1) * d]) for i in range(4))
    furthest = np.abs(difference[:, 0]) + np.maximum.reduce([value * sums.largest, *flags]).sum(1)
    spread = sum(w * np.einsum("mi,ij,mj->m", difference, plain, difference) for w, plain in zip((fit.weight_neg, fit.weight_pos), sums.plain, strict=True))
    u = np.maximum.reduce([np.broadcast_to(sums.largest * columns.spread, fit.low.shape), *map(np.abs, columns.steps())])
    z = ((u + np.abs(columns.centre - fit.mean)) / fit.scale).max(1, initial=1.0)
    return FOURTH / 24 * furthest**2 * spread * z / np.maximum(fit.n_train, 1)


def fitted(fit: Fitted, whole: Fitted, curvature: np.ndarray, sums: Sums, x: np.ndarray, y: np.ndarray, at: np.ndarray,
           c: float = P.LOGIT_C, tolerance: float = 1e-12, max_steps: int = 12) -> tuple[Fitted, np.ndarray]:
    """(models with their bounds fitted, which of them are settled); x, y and at: the rows of their issuers and whose they are."""
    columns = Columns(fit, whole)
    fit = _scaled(fit, columns, sums, x, y, at)
    n_models, d = fit.low.shape
    fit.beta = np.tile(whole.beta[0], (n_models, 1))
    ridge = np.r_[0.0, np.full(d, 1.0 / c)]
    done, last = ~fit.usable, np.full(n_models, np.inf)
    slow = np.zeros(n_models, bool)
    for fit.steps in range(1, max_steps + 1):
        gradient, difference = _gradients(fit, columns, sums, x, y, at)
        gradient += ridge * fit.beta
        size = np.abs(gradient).max(1) / np.maximum(fit.n_train, 1.0)
        done |= size < tolerance
        slow |= ~done & ~(size <= 0.1 * last)
        last = size
        moving = ~done & ~slow
        if not moving.any():
            break
        fit.beta[moving] -= np.linalg.solve(curvature, gradient[moving].T).T
    return fit, ~fit.usable | (done & (_remainder(fit, columns, sums, difference) < REMAINDER))


def predictions(rows: DataFrame, whole: Fitted, curvature: np.ndarray, sums: Sums, without: Without, keys: list[str]) -> DataFrame:
    """keys, y, issuer_index, raw_pd, n_models of all rows, and whether the model of their issuer is settled."""
    features = whole.features

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        issuer, fit = without(pdf)
        x, y, at = pdf[features].to_numpy("float64"), pdf["y"].to_numpy("int64"), np.searchsorted(issuer, pdf["issuer_index"].to_numpy())
        fit, settled = fitted(fit, whole, curvature, sums, x, y, at)
        columns = Columns(fit, whole)
        slope, intercept, _ = _coefficients(fit, columns)
        eta = ((columns.clipped(x, at) - columns.centre) * slope[at]).sum(1) + intercept[at]
        out = pdf[[*keys, "y", "issuer_index"]].copy()
        out["raw_pd"] = np.where(fit.usable[at], 1 / (1 + np.exp(-np.clip(eta, -700, 700))), np.nan)
        out["n_models"], out["settled"] = fit.usable[at].astype("int64"), settled[at]
        return out

    types = dict(rows.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in [*keys, "y", "issuer_index"]), "raw_pd double, n_models long, settled boolean"])
    chosen = rows.select(*keys, "y", "issuer_index", *features)
    scored = chosen.groupBy(F.expr(f"issuer_index DIV {ISSUERS_PER_CALL}")).applyInPandas(group, schema)
    return scored.withColumn("raw_pd", F.expr("CASE WHEN n_models > 0 THEN raw_pd END"))
