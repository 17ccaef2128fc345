"""Registration of queries and the frames several of them start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vintagerisk.operators import labels
from vintagerisk.operators.panel import build_panel, snapshots
from vintagerisk.sources import tape

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def issuer_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_panel(tape.issuers(spark, sf_dir), tape.facts(spark, sf_dir), tape.WINDOW)


def issuer_snapshots(spark: SparkSession, sf_dir: str, null_values: bool = False) -> DataFrame:
    return snapshots(tape.issuers(spark, sf_dir), tape.facts(spark, sf_dir, null_values), tape.WINDOW)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.labelled_observations(tape.issuers(spark, sf_dir), tape.WINDOW).drop("exposure")
