"""Filing index pages: parallel arrays per page, read only where a page can matter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = "form array<string>, filingDate array<string>, items array<string>, accessionNumber array<string>"


def list_filings(
    pages: DataFrame,
    around: DataFrame | None = None,
    form: str | None = "8-K",
    window_days: int = 60,
    keep: tuple[str, ...] = ("form", "filing_date", "items", "accession"),
) -> DataFrame:
    """Filing rows of every registrant, de-duplicated.

    `pages` has (cik, is_recent, filing_from, filing_to, page); `around` names one date
    per registrant.  The date test runs on page metadata, before any page is parsed; the
    recent block is always read.
    """
    if around is not None:
        near = around.select("cik", F.col("default_date").alias("centre"))
        overlaps = F.expr(
            f"is_recent OR (filing_to >= date_sub(centre, {window_days}) AND filing_from <= date_add(centre, {window_days}))"
        )
        pages = pages.join(near, "cik").where(overlaps)
    rows = (
        pages.select("cik", F.from_json("page", PAGE).alias("p"))
        .select("cik", F.inline(F.arrays_zip("p.form", "p.filingDate", "p.items", "p.accessionNumber")))
        .select(
            "cik", "form", F.to_date("filingDate").alias("filing_date"), "items", F.col("accessionNumber").alias("accession")
        )
    )
    if form:
        rows = rows.where(F.upper("form") == form.upper())
    return rows.select("cik", *keep).dropDuplicates()
