"""Null-safe arithmetic, as columns and as Spark SQL text.  Missing is always NULL here, never NaN.

Long formulas are written as SQL text: the plan is the same, and the driver sends one
string instead of hundreds of small calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def num(x: float) -> Column:
    return F.lit(float(x))


def dbl(x: float) -> str:
    """A double literal in SQL text (a bare 0.1 would be a decimal)."""
    return f"{float(x)!r}D"


def no_nan(col: Column | str) -> Column:
    """NaN orders above every number in Spark and poisons quantiles, so it becomes NULL at the source."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(~F.isnan(col), col)


def ratio(top: str, bottom: str, smallest: float = 1e-6) -> str:
    """`top / bottom`, NULL when either is missing or the denominator is effectively zero."""
    return f"CASE WHEN abs({bottom}) >= {dbl(smallest)} THEN ({top}) / ({bottom}) END"


def clamp(col: Column, low: float, high: float) -> Column:
    """Clip that keeps NULL as NULL (`greatest`/`least` alone would skip it)."""
    return F.when(col.isNotNull(), F.greatest(num(low), F.least(num(high), col)))


def clamp_sql(value: str, low: str, high: str) -> str:
    return f"CASE WHEN ({value}) IS NOT NULL THEN greatest({low}, least({high}, {value})) END"


def logit_sql(p: str, eps: float = 1e-9) -> str:
    q = clamp_sql(p, dbl(eps), dbl(1 - eps))
    return f"ln(({q}) / (1D - ({q})))"


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def rounded(col: Column | str, places: int = 6) -> Column:
    """Round for output; adding zero folds -0.0 into 0.0."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col.cast("double"), places) + num(0)


def tidy(df: DataFrame, **places: int) -> DataFrame:
    """Round the named columns for output, keeping the column order."""
    return df.selectExpr(
        *[f"round(cast(`{c}` as double), {places[c]}) + 0D AS `{c}`" if c in places else f"`{c}`" for c in df.columns]
    )
