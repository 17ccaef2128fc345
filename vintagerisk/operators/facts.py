"""Long facts: tag preference, source fallback, and compact marks for the tags that matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagerisk import params as P
from vintagerisk.functions.numeric import no_nan
from vintagerisk.operators.codes import decode, encode

FACT_KEY = ["cik", "field", "period_end", "filed"]
FACT_COLUMNS = ["cik", "source", "field", "period_end", "filed", "form", "fiscal_year", "value", "tag"]

INCLUSIVE_LTD, CURRENT_MATURITY = 1, 2
APPROXIMATE_BIT = {tag: 4 << i for i, tag in enumerate(P.APPROXIMATE_TAGS)}


def tag_marks(tag: Column) -> Column:
    """Bit set of what a tag says about its value; an int aggregates in place where a string would not."""
    marks = F.when(tag.isin(*P.LTD_INCLUSIVE_TAGS), INCLUSIVE_LTD).when(
        tag.isin(*P.CURRENT_MATURITY_TAGS), CURRENT_MATURITY
    )
    for name, bit in APPROXIMATE_BIT.items():
        marks = marks.when(tag == name, bit)
    return F.when(tag.isNotNull(), marks.otherwise(0))


def resolve_tag_preference(raw: DataFrame, book: DataFrame | None = None) -> DataFrame:
    """One fact per (issuer, field, period, filing date): the tag of best rank.

    `row_key` (non-negative, below 2**60) breaks ties between equal ranks.  Rank and key
    are packed into one long so each attribute is a plain `min_by`; attributes a query
    does not read are pruned.  Rows are dealt once by issuer, field and period: hardly any share a whole key, so nothing
    is gained by combining before the shuffle, and what follows per epoch or version finds them in place.
    With a code book of form and tag no row is sorted, also where these are read.
    """
    order = F.shiftleft(F.col("tag_rank").cast("bigint"), 60) + F.col("row_key")
    kept = [c for c in FACT_COLUMNS if c not in FACT_KEY + ["source"] and c in raw.columns]
    words = [c for c in ("form", "tag") if c in kept]
    marked = raw.withColumn("pick", order).withColumn("marks", tag_marks(F.col("tag")))
    coded = marked if book is None else encode(marked, words, book)
    picked = coded.repartition("cik", "field", "period_end").groupBy(*FACT_KEY, "source").agg(*[F.min_by(c, "pick").alias(c) for c in kept + ["marks"]])
    return picked if book is None else decode(picked, words, book)


REQUIRED_COLUMNS = {"cik", "field", "period_end", "value", "filed"}


def normalise_source(raw: DataFrame, source: str) -> DataFrame | None:
    """Bring a second producer's table to the fact columns; None when it cannot be trusted.

    Without a filing date there is no point-in-time guarantee: a table without the column is
    refused, and so is a single row without the date.  NaN becomes NULL.
    """
    lowered = raw.toDF(*[c.lower() for c in raw.columns])
    if not REQUIRED_COLUMNS <= set(lowered.columns):
        return None
    types = {"form": "string", "fiscal_year": "int", "tag": "string"}
    for name, kind in types.items():
        if name not in lowered.columns:
            lowered = lowered.withColumn(name, F.lit(None).cast(kind))
    return lowered.select(
        "cik",
        F.lit(source).alias("source"),
        "field",
        F.to_date("period_end").alias("period_end"),
        F.to_date("filed").alias("filed"),
        "form",
        "fiscal_year",
        no_nan(F.col("value").cast("double")).alias("value"),
        "tag",
    ).where("filed IS NOT NULL")


def prefer_source(preferred: DataFrame | None, fallback: DataFrame) -> DataFrame:
    """Per issuer: the preferred producer where it reports anything, the fallback elsewhere."""
    if preferred is None:
        return fallback.select(*FACT_COLUMNS)
    covered = preferred.select("cik").distinct()
    rest = fallback.join(covered, "cik", "left_anti")
    return preferred.select(*FACT_COLUMNS).unionByName(rest.select(*FACT_COLUMNS))
