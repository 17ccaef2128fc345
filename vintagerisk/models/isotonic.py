"""Isotonic maps of many training sets at once, without a list of levels in one place.

The isotonic rate of a score is the slope of the lower hull of the running totals (rows, positives). The hull of a range of
scores does not depend on what lies before it, so it is kept as blocks (first score, last score, rows, positives) of
rising rates; two neighbouring hulls are merged by putting their blocks in a row and pooling again. Each range of about a
million scores gives the blocks of all models in one pass, and the ranges are merged in a tree. Rates are compared
as fractions of integers, so ties are exact. Of n rows a hull keeps no more than about n^(2/3) blocks, which is
what the root of the tree holds.

Scores between two blocks get the straight line between them, scores outside the nearest rate. NULL and NaN scores take no part and get NULL.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintagerisk.operators.prefix import range_splits, with_range
from vintagerisk.sources.storage import materialise

BLOCKS = "m int, node bigint, lo double, hi double, w bigint, s bigint"
STEPS = "m int, range_id double, start double, hi double, rate double, next_lo double, next_rate double"
FAN_IN = 16


def pooled(blocks: Iterable[tuple[float, float, int, int]]) -> list[tuple[float, float, int, int]]:
    """Blocks (lo, hi, w, s) in score order, neighbours merged until the rates s / w rise."""
    out: list[tuple[float, float, int, int]] = []
    for lo, hi, w, s in blocks:
        while out and out[-1][3] * w >= s * out[-1][2]:
            first, _, before, positives = out.pop()
            lo, w, s = first, w + before, s + positives
        out.append((lo, hi, w, s))
    return out


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in schema.split(", ")])


@dataclass
class StepMaps:
    """steps: the blocks of every model, found again in each range of scores that they reach."""

    steps: DataFrame
    splits: list[float]

    def rates(self, levels: DataFrame) -> DataFrame:
        """(m, score, rate) of distinct (m, score): the last block that starts at or before each score, by range."""
        asked = with_range(levels.select(F.col("m").cast("int").alias("m"), "score"), "score", self.splits).selectExpr(
            "m", "range_id", "score AS start", "true AS asked", "named_struct('hi', 0D, 'rate', 0D, 'next_lo', 0D, 'next_rate', 0D) AS step"
        )
        known = self.steps.selectExpr("m", "range_id", "start", "false AS asked", "struct(hi, rate, next_lo, next_rate) AS step")
        order = "(PARTITION BY m, range_id ORDER BY start, asked ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        placed = asked.unionByName(known).selectExpr("m", "start AS score", "asked", f"last(CASE WHEN NOT asked THEN step END, true) OVER {order} AS at")
        return placed.where("asked").selectExpr(
            "m", "score",
            "CASE WHEN score <= at.hi OR at.next_lo IS NULL THEN at.rate "
            "ELSE at.rate + (at.next_rate - at.rate) * ((score - at.hi) / (at.next_lo - at.hi)) END AS rate",
        )


def fit_steps(counted: DataFrame, models: int) -> StepMaps:
    """counted: score, and arrays n, k of rows and positives of each model's training set there."""
    counted = materialise(counted.select(F.col("score").cast("double").alias("score"), "n", "k"))
    splits = range_splits(counted, "score")

    def of_range(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("score")
        score, n, k = pdf["score"].tolist(), pdf["n"].tolist(), pdf["k"].tolist()
        rows = []
        for m in range(models):
            present = ((x, x, int(a[m]), int(b[m])) for x, a, b in zip(score, n, k, strict=True) if a[m])
            rows += [(m, int(key[0]), *block) for block in pooled(present)]
        return _frame(rows, BLOCKS)

    def together(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = pdf.sort_values("lo")[["lo", "hi", "w", "s"]].itertuples(index=False, name=None)
        return _frame([(key[0], key[1], *block) for block in pooled(parts)], BLOCKS)

    blocks = with_range(counted, "score", splits).groupBy("range_id").applyInPandas(of_range, BLOCKS)
    width = len(splits) + 1
    while width > 1:
        width = -(-width // FAN_IN)
        blocks = blocks.withColumn("node", F.expr(f"node DIV {FAN_IN}")).groupBy("m", "node").applyInPandas(together, BLOCKS)

    def reach(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Where a block starts, and at the start of each further range before the next block; the first also in all ranges before."""
        pdf = pdf.sort_values("lo")
        lo, hi, rate = pdf["lo"].tolist(), pdf["hi"].tolist(), (pdf["s"] / pdf["w"]).tolist()
        rows, at = [], [bisect_right(splits, x) for x in lo]
        for i, x in enumerate(lo):
            last = i + 1 == len(lo)
            step = (hi[i], rate[i], None if last else lo[i + 1], None if last else rate[i + 1])
            rows.append((key[0], float(at[i]), x, *step))
            to = len(splits) if last else at[i + 1]
            rows += [(key[0], float(r), float("-inf"), *step) for r in [*(range(at[i] + 1) if i == 0 else []), *range(at[i] + 1, to + 1)]]
        return _frame(rows, STEPS).astype({"next_lo": "float64", "next_rate": "float64"})

    found = blocks.groupBy("m").applyInPandas(reach, STEPS).replace(float("nan"), None, ["next_lo", "next_rate"])
    return StepMaps(materialise(found), splits)
