"""Company-facts documents: nested JSON of reported values, flattened to fact rows in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintagerisk import params as P
from vintagerisk.functions.numeric import no_nan

ENTRY = T.StructType(
    [
        T.StructField("start", T.StringType()),
        T.StructField("end", T.StringType()),
        T.StructField("filed", T.StringType()),
        T.StructField("val", T.DoubleType()),
        T.StructField("form", T.StringType()),
        T.StructField("fy", T.IntegerType()),
    ]
)
UNITS = T.StructType([T.StructField("units", T.MapType(T.StringType(), T.ArrayType(ENTRY)))])
DOCUMENT = T.StructType(
    [
        T.StructField("cik", T.StringType()),
        T.StructField("facts", T.MapType(T.StringType(), T.MapType(T.StringType(), UNITS))),
    ]
)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Landed documents, one per file."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("document"))


def tag_dictionary(spark: SparkSession) -> DataFrame:
    """(tag, field, tag_rank, is_duration): a fixed vocabulary of a few dozen rows."""
    rows = [
        (tag, field, rank, kind)
        for kind, fields in ((False, P.INSTANT_FIELDS), (True, P.DURATION_FIELDS))
        for field, tags in fields.items()
        for rank, tag in enumerate(tags)
    ]
    return spark.createDataFrame(rows, "tag string, field string, tag_rank int, is_duration boolean")


def explode_entries(documents: DataFrame) -> DataFrame:
    """Every reported US-GAAP value in a USD unit, as one row."""
    parsed = documents.select(F.from_json("document", DOCUMENT).alias("d"))
    tags = parsed.select(F.col("d.cik").alias("cik"), F.explode(F.col("d.facts")["us-gaap"]).alias("tag", "block"))
    units = tags.select("cik", "tag", F.explode("block.units").alias("unit", "entries")).where(F.col("unit").startswith("USD"))
    return units.select("cik", "tag", "unit", F.inline("entries")).select(
        "cik", "tag", "unit",
        F.to_date("start").alias("start"),
        F.to_date("end").alias("period_end"),
        F.to_date("filed").alias("filed"),
        no_nan("val").alias("value"),
        "form",
        F.col("fy").alias("fiscal_year"),
    )


def known_entries(entries: DataFrame) -> DataFrame:
    """Annual-report values of wanted tags that carry both dates, with the span a flow covers."""
    wanted = F.broadcast(tag_dictionary(entries.sparkSession))
    return (
        entries.where(F.upper("form").isin(*P.ANNUAL_FORMS) & F.col("period_end").isNotNull() & F.col("filed").isNotNull())
        .join(wanted, "tag")
        .withColumn("span_days", F.when(F.col("is_duration"), F.date_diff("period_end", "start")))
    )


def is_annual() -> Column:
    """Flow values must span about a year."""
    return ~F.col("is_duration") | F.col("span_days").between(*P.ANNUAL_SPAN_DAYS)


def annual_only(entries: DataFrame) -> DataFrame:
    """Quarterly values of the same tag are dropped."""
    return entries.where(is_annual())


def scan_company_facts(documents: DataFrame, source: str = "filings") -> DataFrame:
    """Unresolved facts from documents, with a repeatable key to break ties between equal tags."""
    tie = F.pmod(F.xxhash64("unit", "form", "value", "fiscal_year", "start"), F.lit(1 << 58))
    return annual_only(known_entries(explode_entries(documents))).select(
        "cik", F.lit(source).alias("source"), "field", "period_end", "filed", "form", "fiscal_year",
        "value", "tag", "tag_rank", tie.alias("row_key"),
    )
