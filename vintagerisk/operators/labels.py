"""Observation grid and default labels."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagerisk import params as P


def grid_dates(window: tuple[dt.date, dt.date], month_day: tuple[int, int] = P.OBSERVATION_MONTH_DAY) -> list[dt.date]:
    days = [dt.date(year, *month_day) for year in range(window[0].year, window[1].year + 1)]
    return [d for d in days if window[0] <= d <= window[1]]


def observation_grid(
    issuers: DataFrame,
    window: tuple[dt.date, dt.date],
    month_day: tuple[int, int] = P.OBSERVATION_MONTH_DAY,
) -> DataFrame:
    """Every issuer on every annual date of the window, until its default."""
    days = F.array(*[F.lit(d) for d in grid_dates(window, month_day)])
    alive = F.col("default_date").isNull() | (F.col("as_of") < F.col("default_date"))
    return issuers.withColumn("as_of", F.explode(days)).where(alive)


def label(horizon_days: int = P.HORIZON_DAYS) -> Column:
    """1 defaults within the horizon, 0 survives it, NULL at or after the default (row is invalid)."""
    day, default = F.col("as_of"), F.col("default_date")
    return (
        F.when(default.isNull(), 0)
        .when(day >= default, F.lit(None))
        .when(default <= F.date_add(day, horizon_days), 1)
        .otherwise(0)
    )


def days_to_default() -> Column:
    return F.date_diff("default_date", "as_of")


def labelled_observations(
    issuers: DataFrame, window: tuple[dt.date, dt.date], horizon_days: int = P.HORIZON_DAYS
) -> DataFrame:
    return (
        observation_grid(issuers, window)
        .withColumns(
            {
                "label": label(horizon_days),
                "days_to_default": days_to_default(),
                "is_default_issuer": F.when(F.col("default_date").isNotNull(), 1).otherwise(0),
            }
        )
        .where(F.col("label").isNotNull())
    )
