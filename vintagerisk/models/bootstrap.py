"""Issuer-clustered bootstrap of the AUC.

A draw of `bootstrap_auc` picks as many issuers as there are, with replacement. The picks are a hash of (draw, slot): every task
works out by itself how often each issuer is picked, and nothing is multiplied by the number of draws in a shuffle.
In the draws of `paired_difference` each issuer weighs as often as a Poisson variable of mean one says, a hash of (draw, issuer):
resampling with replacement up to the size of the resample.

Scores are cut into ranges; each range yields, per draw, its weighted positives, negatives and ordered pairs, and the ranges of
a draw are chained in score order. A score that very many rows share is a range of its own, whose rows are dealt to several
tasks: its positives and negatives add up, and its pairs follow from the sums. Several scores go through the same pass.

Rows without group, and NULL or NaN scores, take no part.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintagerisk import params as P
from vintagerisk.functions.hashing import MODULUS
from vintagerisk.operators import prefix
from vintagerisk.operators.discrimination import auc
from vintagerisk.sources.storage import materialise

# P(weight <= j) on the scale of the hash; a hash at or above the last bound weighs as many times as there are bounds
BOUNDS = [math.floor(MODULUS * math.exp(-1) * sum(1 / math.factorial(i) for i in range(j + 1))) for j in range(12)]
PARTS = "which int, range_id double, draw int, pos double, neg double, pairs double"


def _terms(b: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """What the hash of (a, b) takes of b alone, for any a."""
    m = np.int64(MODULUS)
    b = b.astype("int64") % m
    return (b * 69621 + (seed * 7919 + 12345)) % m, (b * 104729 + 1) % m


def _fold(x: np.ndarray, spare: np.ndarray) -> None:
    """x modulo 2**31 - 1, in place, for 0 <= x < 2**63: the bits above the 31st are worth as much as those below."""
    for _ in range(2):
        np.right_shift(x, 31, out=spare)
        x &= MODULUS
        x += spare
    np.subtract(x, MODULUS, out=spare)  # negative, so very large without sign, where x is small enough
    np.minimum(x.view("uint64"), spare.view("uint64"), out=x.view("uint64"))


def _hashed(a: int, terms: tuple[np.ndarray, np.ndarray], chunk: int = 1 << 14) -> np.ndarray:
    """`functions.hashing.mix` of a and the b of the terms."""
    one, two = a % MODULUS * 40503 % MODULUS, a % MODULUS * 31
    out = np.empty(len(terms[0]), "int64")
    spare, first = np.empty((2, min(chunk, len(out))), "int64")
    for at in range(0, len(out), chunk):
        x = out[at : at + chunk]
        f, s = first[: len(x)], spare[: len(x)]
        np.add(terms[0][at : at + chunk], one, out=f)
        _fold(f, s)
        np.multiply(f, f, out=x)
        x += terms[1][at : at + chunk]
        x += two
        _fold(x, s)
        np.add(x, 48271, out=s)
        x *= s
        x += f
        _fold(x, s)
    return out


def _mix(a: int, b: np.ndarray, seed: int) -> np.ndarray:
    """`functions.hashing.mix` on arrays."""
    return _hashed(a, _terms(b, seed))


def _weight(hashed: np.ndarray) -> np.ndarray:
    return np.searchsorted(BOUNDS, hashed, side="right")


def weights(draw: int, groups: np.ndarray, seed: int) -> np.ndarray:
    """How often each group counts in a draw."""
    return _weight(_mix(draw, groups, seed))


def _picked(hashed: np.ndarray) -> np.ndarray:
    """How often each group is picked by the hashes of as many slots as there are groups."""
    n = len(hashed)
    # both are below 2**31, so the quotient of the doubles has the right floor
    hashed -= n * np.floor(hashed / n).astype("int64")
    return np.bincount(hashed, minlength=n)


def multiplicities(draw: int, n_groups: int, seed: int) -> np.ndarray:
    """How often each group is picked in one draw of `n_groups` slots."""
    return _picked(_mix(draw, np.arange(n_groups), seed))


def indexed_groups(scored: DataFrame, group: str) -> tuple[DataFrame, int]:
    """Distinct groups with a dense index in group order, and how many there are."""
    groups = materialise(scored.selectExpr(f"cast({group} as bigint) AS g").where("g IS NOT NULL").distinct().withColumn("one", F.lit(1).cast("bigint")))
    ranked = prefix.running_totals(groups, "g", ["one"], prefix.range_splits(groups, "g"))
    return ranked.select("g", F.col("one_before").alias("gi")), groups.count()


def _cuts(counted: DataFrame) -> tuple[list[float], dict[float, int]]:
    """Cut points, and the tasks for each range that is one heavy score.

    A score with more rows than half a range holds; there are at most twice as many as ranges, and only these reach the driver.
    """
    limit = prefix.ROWS_PER_RANGE // 2
    heavy = {r.score: r.n for r in counted.groupBy("score").agg(F.count("*").alias("n")).where(F.col("n") > limit).collect()}
    cuts = {*prefix.range_splits(counted, "score"), *heavy, *(math.nextafter(s, math.inf) for s in heavy)}
    splits = sorted(cuts)
    return splits, {float(splits.index(s) + 1): -(-n // limit) for s, n in heavy.items()}


def bootstrap_draws(
    scored: DataFrame, scores: list[str], y: str = "y", group: str = "grp", draws: int = P.BOOTSTRAP_DRAWS, seed: int = P.SEED, resampled: bool = False
) -> DataFrame:
    """(draw, auc_0, auc_1, ...) of every draw in which all scores meet both classes.

    `resampled` draws pick as many groups as there are, with replacement; the others weigh each group by itself.
    """
    pairs = ", ".join(f"{k}, nanvl(cast({s} as double), NULL)" for k, s in enumerate(scores))
    long = scored.selectExpr(f"cast({group} as bigint) AS g", f"cast({y} as bigint) AS y", f"stack({len(scores)}, {pairs}) AS (which, score)")
    counted = long.where("score IS NOT NULL AND g IS NOT NULL").groupBy("which", "g", "score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    if resampled:
        index, n_groups = indexed_groups(scored, group)
        counted = counted.join(index, "g").drop("g").withColumnRenamed("gi", "g")
    counted = materialise(counted)
    ranged = None
    for k in range(len(scores)):
        mine = counted.where(F.col("which") == k)
        splits, tasks = _cuts(mine)
        dealt = " ".join(f"WHEN range_id = {r}D THEN pmod(xxhash64(g), {n})" for r, n in tasks.items())
        part = prefix.with_range(mine, "score", splits).withColumn("deal", F.expr(f"CASE {dealt} ELSE 0 END" if dealt else "0").cast("long"))
        ranged = part if ranged is None else ranged.unionByName(part)

    def chain(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("score", kind="stable")
        pos, neg, score = (pdf[c].to_numpy() for c in ("pos", "neg", "score"))
        groups, at = np.unique(pdf["g"].to_numpy(), return_inverse=True)
        starts = np.flatnonzero(np.r_[True, np.diff(score) > 0])
        out = np.empty((draws, 3))
        terms = _terms(np.arange(n_groups) if resampled else groups, seed)
        for b in range(draws):
            hashed = _hashed(b, terms)
            w = (_picked(hashed)[groups] if resampled else _weight(hashed))[at]
            p_here = np.add.reduceat(w * pos, starts)
            n_here = np.add.reduceat(w * neg, starts)
            below = np.cumsum(n_here) - n_here
            out[b] = p_here.sum(), n_here.sum(), float((p_here * below).sum() + 0.5 * (p_here * n_here).sum() * (len(starts) > 1))
        return pd.DataFrame({"which": key[0], "range_id": key[1], "draw": np.arange(draws), "pos": out[:, 0], "neg": out[:, 1], "pairs": np.where(len(starts) > 1, out[:, 2], np.nan)})

    parts = ranged.groupBy("which", "range_id", "deal").applyInPandas(chain, PARTS)
    # of a range of one score the pairs are half the product of what its tasks add up to
    whole = parts.groupBy("which", "range_id", "draw").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max(F.expr("nanvl(pairs, NULL)")).alias("pairs"))
    earlier = "(PARTITION BY which, draw ORDER BY range_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    chained = whole.selectExpr("which", "draw", "pos", "neg", f"coalesce(pairs, 0.5D * pos * neg) + pos * coalesce(sum(neg) OVER {earlier}, 0D) AS pairs")
    each = chained.groupBy("draw", "which").agg((F.sum("pairs") / F.expr("nullif(sum(pos) * sum(neg), 0D)")).alias("auc"))
    aucs = [F.max(F.expr(f"CASE WHEN which = {k} THEN auc END")).alias(f"auc_{k}") for k in range(len(scores))]
    return each.groupBy("draw").agg(*aucs).where(" AND ".join(f"auc_{k} IS NOT NULL" for k in range(len(scores))))


def _interval(draws: DataFrame, value: str, alpha: float) -> DataFrame:
    """Percentile interval over the draws, a few thousand numbers at most."""
    return draws.agg(
        F.percentile(value, F.lit(alpha / 2)).alias("lower"), F.percentile(value, F.lit(1 - alpha / 2)).alias("upper"),
        F.count("*").alias("n_draws"),
    )


def bootstrap_auc(scored: DataFrame, score: str = "p", y: str = "y", group: str = "grp", draws: int = P.BOOTSTRAP_DRAWS,
                  seed: int = P.SEED, alpha: float = P.BOOTSTRAP_ALPHA) -> DataFrame:
    point = auc(scored, score, y).select("auc").scalar()
    return _interval(bootstrap_draws(scored, [score], y, group, draws, seed, resampled=True), "auc_0", alpha).withColumn("auc", point)


def paired_difference(scored: DataFrame, score_a: str, score_b: str, y: str = "y", group: str = "grp", draws: int = P.BOOTSTRAP_DRAWS,
                      seed: int = P.SEED, alpha: float = P.BOOTSTRAP_ALPHA) -> DataFrame:
    """AUC of A minus AUC of B under the same resamples, with a verdict from the interval."""
    both = bootstrap_draws(scored, [score_a, score_b], y, group, draws, seed)
    point = (auc(scored, score_a, y).select("auc").scalar(), auc(scored, score_b, y).select("auc").scalar())
    out = _interval(both.withColumn("gap", F.col("auc_0") - F.col("auc_1")), "gap", alpha)
    return out.withColumn("difference", point[0] - point[1]).selectExpr(
        "difference", "lower", "upper", "n_draws", "coalesce(lower > 0 OR upper < 0, false) AS significant",
        "CASE WHEN difference IS NULL THEN 'not computable' WHEN lower > 0 OR upper < 0 THEN "
        "CASE WHEN difference > 0 THEN 'first beats second' ELSE 'second beats first' END ELSE 'no distinguishable difference' END AS verdict",
    )
