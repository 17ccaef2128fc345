"""Views that give the driver's star-schema tables the shapes the credit operators expect.

Suppliers play issuers, line items play filed facts, orders play scored obligors and
line items again play loan facilities.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vintagerisk import params as P
from vintagerisk.functions.numeric import dbl, num
from vintagerisk.operators.codes import code_book
from vintagerisk.operators.facts import resolve_tag_preference

WINDOW = (dt.date(1996, 1, 1), dt.date(2002, 12, 31))

# rule for the stand-in value of a field: multiplier and shift applied to the price
VALUE_RULES = {
    "total_assets": (4.0, 0.0),
    "total_liabilities": (2.0, 0.0),
    "revenue": (3.0, 0.0),
    "interest_expense": (0.1, 0.0),
    "rnd_expense": (0.1, 0.0),
    "sga_expense": (0.3, 0.0),
    "net_interest": (-0.1, 0.0),
    "net_income": (0.5, -35000.0),
    "ebit": (0.6, -30000.0),
    "pretax_income": (0.5, -30000.0),
    "retained_earnings": (1.0, -30000.0),
    "equity": (1.0, -25000.0),
    "cfo": (0.5, -20000.0),
    "depreciation_amortisation": (0.2, 0.0),
}
# stand-in tags that carry meaning downstream: (field, rank) -> tag
MEANINGFUL_TAGS = {
    ("long_term_debt", 0): "LongTermDebt",
    ("current_debt", 0): "LongTermDebtCurrent",
    ("net_income", 2): "NetIncomeLossAvailableToCommonStockholdersBasic",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def padded_cik(key: Column) -> Column:
    return F.lpad(key.cast("string"), 10, "0")


def _worded(lines: DataFrame) -> DataFrame:
    """Lines with the field, tag and form of the fact they play."""
    names = ", ".join(f"'{f}'" for f in P.FIELDS)
    tags = " ".join(f"WHEN field = '{f}' AND tag_rank = {k} THEN '{tag}'" for (f, k), tag in MEANINGFUL_TAGS.items())
    return lines.selectExpr(
        "*",
        f"element_at(array({names}), cast(l_partkey % {len(P.FIELDS)} as int) + 1) AS field",
        "cast(l_linenumber % 3 as int) AS tag_rank",
        "CASE WHEN l_linestatus = 'F' THEN '10-K' ELSE '10-K/A' END AS form",
    ).withColumn("tag", F.expr(f"CASE {tags} ELSE concat_ws('_', field, cast(tag_rank as string)) END"))


def facts_raw(spark: SparkSession, sf_dir: str, null_values: bool = False) -> DataFrame:
    """Unresolved facts: several tags and filings may report one field of one period."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_linestatus", "l_quantity"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("fiscal_year"))
    rules = " ".join(f"WHEN '{f}' THEN (l_extendedprice + {dbl(b)}) * {dbl(a)}" for f, (a, b) in VALUE_RULES.items())
    value = f"CASE field {rules} ELSE l_extendedprice END"
    if null_values:
        value = f"CASE WHEN l_quantity <> 50 THEN {value} END"
    return (
        _worded(lines.join(orders, lines.l_orderkey == orders.o_orderkey))
        .withColumn("period_end", F.expr("make_date(fiscal_year, 12, 31)"))
        .selectExpr(
            "lpad(cast(l_suppkey as string), 10, '0') AS cik",
            "'tape' AS source",
            "field",
            "period_end",
            "date_add(period_end, cast(30 + (l_orderkey * 7 + l_linenumber * 13) % 400 as int)) AS filed",
            "form",
            "cast(fiscal_year as int) AS fiscal_year",
            f"{value} AS value",
            "tag",
            "tag_rank",
            "pmod((l_orderkey * 8 + l_linenumber) * 16777216 + cast(round(l_extendedprice * 100) as bigint), 1152921504606846976) AS row_key",
        )
    )


def facts(spark: SparkSession, sf_dir: str, null_values: bool = False, book: DataFrame | None = None) -> DataFrame:
    return resolve_tag_preference(facts_raw(spark, sf_dir, null_values), book)


def fact_words(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """Code book of the words that facts repeat; lines alone have them, so no join is made for them."""
    return code_book(_worded(table(spark, sf_dir, "lineitem")).selectExpr("tag", "form", "'tape' AS source"), ["tag", "form", "source"])


def issuers(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier")
    nations = table(spark, sf_dir, "nation")
    regions = table(spark, sf_dir, "region")
    key = F.col("s_suppkey")
    defaulted = F.col("s_acctbal") < 2000
    secured = (key % 10).cast("double") / 10
    return (
        suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            padded_cik(key).alias("cik"),
            F.col("s_name").alias("name"),
            F.concat(F.lit("S"), key.cast("string")).alias("ticker"),
            F.col("r_name").alias("sector"),
            F.when(defaulted, F.date_add(F.lit(dt.date(1997, 1, 1)), ((key * 97) % 1500).cast("int"))).alias("default_date"),
            (key % 7 != 3).alias("verified"),
            F.when(
                defaulted,
                F.create_map(F.lit("senior_secured"), secured, F.lit("senior_unsecured"), 1 - secured),
            ).alias("exposure"),
            key.cast("bigint").alias("issuer_id"),
        )
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Obligors with a probability that is calibrated by construction, and an outcome."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    p = F.pow((((key * 7919 + 17) % 10007).cast("double") + 0.5) / num(10007), num(3)) * num(0.6)
    u = ((((key * key) % 1000003) * 31 + cust * 104729 + 5) % 10009).cast("double") / num(10009)
    return (
        table(spark, sf_dir, "orders")
        .select(
            key.alias("id"),
            (cust % 200).alias("grp"),
            F.year("o_orderdate").cast("int").alias("yr"),
            p.alias("p"),
            u.alias("u"),
        )
        .withColumn("y", F.when(F.col("u") < F.col("p"), 1).otherwise(0))
        .drop("u")
    )


def loan_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    instrument = (
        F.when(F.col("l_returnflag") == "R", "revolving_credit_facility")
        .when(F.col("l_returnflag") == "A", "term_loan")
        .otherwise("bond")
    )
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("facility_id"),
            instrument.alias("instrument"),
            F.col("l_extendedprice").alias("drawn"),
            (F.col("l_extendedprice") * F.col("l_discount") * num(5)).alias("undrawn"),
            (num(1) + F.col("l_quantity") / num(12.5)).alias("maturity_years"),
            (F.col("l_tax") / num(4) + num(0.0002)).alias("pd"),
            (F.col("o_totalprice") / num(5000)).alias("sales_eur_millions"),
            F.col("c_mktsegment").alias("sector"),
        )
    )


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = (
        F.when((F.col("event_type") == "error") & (F.col("value") > 20), "1.03,7.01,9.01")
        .when(F.col("event_type") == "error", "10.3,2.02")
        .otherwise("2.02,9.01")
    )
    return table(spark, sf_dir, "events").select(
        padded_cik(F.col("user_id")).alias("cik"),
        F.to_date("ts").alias("filing_date"),
        F.when(F.col("event_type") == "view", "10-Q").otherwise("8-K").alias("form"),
        items.alias("items"),
        F.col("event_id").cast("string").alias("accession"),
    )


def claimed_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One claimed default date per registrant seen in the filing index."""
    day = ((F.col("user_id") * 7) % 30).cast("int")
    return (
        table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n_events"))
        .select(
            padded_cik(F.col("user_id")).alias("cik"),
            F.date_add(F.lit(dt.date(2024, 1, 1)), day).alias("default_date"),
            (F.col("user_id") % 2 == 0).alias("verified"),
        )
    )


def statement_entries(spark: SparkSession, sf_dir: str, by_filing: bool = False) -> DataFrame:
    """Raw reported values with real tag names, and the noise a filings feed carries:
    share units, quarterly forms and spans, foreign taxonomies, unknown tags.

    `by_filing` brings the lines of an order together and in order, by one shuffle and one sort of the lines as stored.
    """
    vocabulary = ", ".join(
        f"array({', '.join(repr(t) for t in tags)})" for tags in (P.INSTANT_FIELDS | P.DURATION_FIELDS).values()
    )
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"
    )
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "cast(year(o_orderdate) as int) AS fy")
    lines = lines.repartition("l_orderkey") if by_filing else lines
    dated = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    dated = dated.sortWithinPartitions("l_orderkey", "l_suppkey", "l_linenumber") if by_filing else dated
    return (
        dated.selectExpr(
            "*",
            f"element_at(array({vocabulary}), cast(l_partkey % {len(P.FIELDS)} as int) + 1) AS tags",
            "make_date(fy, 12, 31) AS period_end",
            "CASE WHEN l_quantity <> 3 THEN date_sub(make_date(fy, 12, 31), CASE WHEN l_linenumber % 4 = 0 THEN 90 ELSE 364 END) END AS start",
        )
        .selectExpr(
            "lpad(cast(l_suppkey as string), 10, '0') AS cik",
            "CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN 'dei' ELSE 'us-gaap' END AS taxonomy",
            "CASE WHEN l_partkey % 29 = 0 THEN 'UnknownTag' ELSE element_at(tags, cast(l_linenumber % size(tags) as int) + 1) END AS tag",
            "CASE WHEN l_quantity = 1 THEN 'shares' WHEN l_quantity = 2 THEN 'USD/shares' ELSE 'USD' END AS unit",
            "start",
            "period_end",
            "date_add(period_end, cast(30 + (l_orderkey * 7 + l_linenumber * 13) % 400 as int)) AS filed",
            "l_extendedprice AS value",
            "CASE WHEN l_discount = 0 THEN '10-Q' WHEN l_linestatus = 'F' THEN '10-k' ELSE '10-K/A' END AS form",
            "fy AS fiscal_year",
            "l_orderkey AS filing_id",
            "l_suppkey AS issuer_id",
            "l_linenumber AS line",
        )
    )


def company_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One company-facts document per issuer and filing; an order has at most a handful of lines,
    so no document grows with the data."""
    text = {"start": "start", "end": "period_end", "filed": "filed"}
    entry = F.struct(
        *[F.date_format(c, "yyyy-MM-dd").alias(n) for n, c in text.items()],
        F.col("value").alias("val"), "form", F.col("fiscal_year").alias("fy"),
    )
    # a window takes the entries in the order they are in; collect_list in an aggregate would sort them anew, as text
    within = Window.partitionBy("filing_id", "issuer_id").orderBy("line")
    line = F.struct("taxonomy", "tag", "unit", entry.alias("entry"))
    filed = statement_entries(spark, sf_dir, by_filing=True).select(
        "cik", F.row_number().over(within).alias("nth"),
        F.collect_list(line).over(within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("lines"),
    ).where("nth = 1")

    def grouped(lines: Column, name: str, inner: Callable[[Column], Column]) -> Column:
        """Map from each value of a field to what `inner` makes of the lines that carry it."""
        part = lambda key: F.filter(lines, lambda line: line[name].eqNullSafe(key))
        return F.map_from_entries(F.transform(F.array_distinct(lines[name]), lambda key: F.struct(key, inner(part(key)))))

    units = lambda lines: F.struct(grouped(lines, "unit", lambda same: same["entry"]).alias("units"))
    facts = grouped(F.col("lines"), "taxonomy", lambda of: grouped(of, "tag", units))
    return filed.select("cik", facts.alias("facts")).select(F.to_json(F.struct("cik", "facts")).alias("document"))


def filing_pages(spark: SparkSession, sf_dir: str, page_size: int = 1000) -> DataFrame:
    """The filing index as pages of parallel arrays, at most `page_size` filings each."""
    page_no = F.floor(F.col("accession").cast("bigint") / page_size)
    iso = F.date_format("filing_date", "yyyy-MM-dd")
    packed = F.sort_array(F.collect_list(F.struct(F.col("accession").alias("accessionNumber"), "form", iso.alias("filingDate"), "items")))
    pages = (
        filings(spark, sf_dir).withColumn("page_no", page_no)
        .groupBy("cik", "page_no")
        .agg(packed.alias("rows"), F.min("filing_date").alias("filing_from"), F.max("filing_date").alias("filing_to"))
    )
    arrays = F.to_json(F.struct(*[F.col(f"rows.{c}").alias(c) for c in ("form", "filingDate", "items", "accessionNumber")]))
    latest = pages.groupBy("cik").agg(F.max("page_no").alias("latest"))
    return pages.join(latest, "cik").select(
        "cik", (F.col("page_no") == F.col("latest")).alias("is_recent"), "filing_from", "filing_to", arrays.alias("page")
    )


def second_producer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A differently shaped fundamentals table that covers every third issuer."""
    return (
        facts(spark, sf_dir).where(F.col("cik").cast("bigint") % 3 == 0)
        .select(
            F.col("cik").alias("CIK"), F.col("field").alias("Field"), F.col("period_end").alias("Period_End"),
            F.col("filed").alias("Filed"), (F.col("value") * 2).alias("Value"),
        )
    )


def registrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrant names with former names, and the name each issuer is expected to carry."""
    suppliers, nations = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr(
        "lpad(cast(s_suppkey as string), 10, '0') AS cik",
        "concat('S', cast(s_suppkey as string)) AS ticker",
        "s_name AS registrant_name",
        "CASE WHEN s_suppkey % 5 <> 0 THEN array(concat(n_name, ' Holdings'), concat('Old ', s_name)) END AS former_names",
        """CASE s_suppkey % 3 WHEN 0 THEN lower(s_name) WHEN 1 THEN concat(' "', n_name, '" holdings ') ELSE 'Unrelated Trading' END AS expected_name""",
    )


def parameter_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A masterscale per nation and a recovery class per part, good and bad ones."""
    scales = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(
        F.max(F.floor(F.abs("c_acctbal") / 100)).alias("top"), F.count("*").alias("n")
    ).selectExpr(
        "c_nationkey AS scale_id",
        "c_mktsegment AS position",
        "CASE WHEN c_mktsegment = 'MACHINERY' AND n % 2 = 0 THEN 1D ELSE top / 100D END AS pd_upper",
    )
    classes = table(spark, sf_dir, "part").selectExpr(
        "concat('class_', cast(p_partkey as string)) AS seniority",
        "CASE WHEN p_partkey % 11 <> 0 THEN p_retailprice / 1000D - 0.5D END AS recovery_mean",
        "CASE WHEN p_size % 10 = 0 THEN 'ASSUMPTION' ELSE 'SOURCED' END AS status",
        "CASE WHEN p_partkey % 7 <> 0 THEN p_name END AS citation",
        "CASE p_partkey % 4 WHEN 0 THEN 'trading_price' WHEN 1 THEN 'ultimate' WHEN 2 THEN 'trading_price' ELSE p_type END AS basis",
    )
    return scales, classes
