"""The bitemporal as-of join: what was known about each issuer on each observation date.

A literal join of observations to every earlier filing fans out by the number of dates.
Here each fact is first mapped to its *epoch*, the earliest observation date that can see
it.  Everything then collapses before any join on the issuer:

    facts --(epoch)--> newest value per (issuer, field, period, epoch) [hash aggregate where the facts lie]
          --(pivot)--> one delta row per (issuer, period, epoch)      [hash aggregate]
          --(running last)--> state of a period from epoch to epoch   [window over a handful of rows]
          --(interval join)--> one row per observation and visible period
          --(window)--> anchor period with its predecessor beside it

Resolved facts lie by (issuer, field, period), so a hot issuer is spread over its fields and periods, and shrinks to
fields x periods x epochs rows in the first step, whatever it filed.
Facts are never pruned by age: an old anchor must make its observation stale, not vanish.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintagerisk import params as P
from vintagerisk.operators.codes import decode, encode
from vintagerisk.operators.facts import tag_marks

ASSETS_BIT = 1 << P.FIELDS.index("total_assets")
MARKED_FIELDS = ["long_term_debt", "current_debt"] + sorted({n.split("~")[0] for n in P.APPROXIMATE_TAGS.values()})


def visible_facts(facts: DataFrame, obs: DataFrame, salts: int | None = None) -> DataFrame:
    """Facts filed on or before each observation date, one row per (observation, fact).

    The fan-out is the answer itself; `visible_summary` gives totals without it.  Facts are
    salted and the (small) observations replicated, so one issuer's facts spread over
    `salts` tasks, as many as there are shuffle partitions unless said otherwise.
    """
    salts = salts or int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = F.pmod(F.hash("field", "period_end", "filed"), F.lit(salts))
    left = facts.withColumn("salt", spread)
    right = obs.select("cik", "as_of").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = left.join(right, ["cik", "salt"]).where(F.col("filed") <= F.col("as_of"))
    return joined.drop("salt")


def visible_summary(facts: DataFrame, obs: DataFrame, dates: list[dt.date] | None = None) -> DataFrame:
    """Count, newest filing date and sum of the facts that each observation sees, without joining facts to observations.

    Facts collapse to one row per issuer and epoch; running totals over these meet the observations.
    """
    deltas = with_epoch(facts, obs, dates).groupBy("cik", "epoch").agg(
        F.count("*").alias("n"), F.max("filed").alias("newest"), F.sum("value").alias("total")
    )
    by_issuer = "PARTITION BY cik ORDER BY epoch"
    so_far = f"({by_issuer} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    states = deltas.selectExpr(
        "cik AS state_cik", "epoch", f"lead(epoch) OVER ({by_issuer}) AS next_epoch",
        f"sum(n) OVER {so_far} AS n_facts", f"max(newest) OVER {so_far} AS latest_filed", f"sum(total) OVER {so_far} AS total_value",
    )
    return obs.select("cik", "as_of").join(states, _current()).drop("state_cik", "epoch", "next_epoch")


VINTAGE_COLUMNS = ["value", "tag", "form", "fiscal_year", "source"]
WORD_COLUMNS = ["tag", "form", "source"]


def newest_version() -> list[Column]:
    """Aggregates of a group of facts: its newest filing date, and the last non-null of every other column."""
    last = [F.expr(f"max_by({c}, CASE WHEN {c} IS NOT NULL THEN filed END)").alias(c) for c in VINTAGE_COLUMNS]
    return [F.max("filed").alias("filed"), *last]


def latest_vintage(facts: DataFrame, obs: DataFrame, dates: list[dt.date] | None = None, book: DataFrame | None = None) -> DataFrame:
    """Newest version of each (field, period) per observation; each column keeps its last non-null.

    Versions collapse to one row per epoch before the issuer join, so each observation
    meets exactly one row per visible (field, period).  With a code book of tag, form and
    source (`codes.code_book`) they collapse in a hash aggregate; without one strings are sorted.
    """
    seen = with_epoch(facts, obs, dates)
    if book is not None:
        seen = encode(seen, WORD_COLUMNS, book)
    versions = seen.groupBy("cik", "field", "period_end", "epoch").agg(*newest_version())
    found = vintage_of_versions(versions, obs)
    return found if book is None else decode(found, WORD_COLUMNS, book)


def vintage_of_versions(versions: DataFrame, obs: DataFrame) -> DataFrame:
    """`latest_vintage` from one row per (cik, field, period_end, epoch), however these came about."""
    by_key = "PARTITION BY cik, field, period_end ORDER BY epoch"
    so_far = f"({by_key} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    states = versions.selectExpr(
        "cik AS state_cik", "field", "period_end", "epoch",
        f"lead(epoch) OVER ({by_key}) AS next_epoch",
        f"max(filed) OVER {so_far} AS filed",
        *[f"last({c}, true) OVER {so_far} AS {c}" for c in VINTAGE_COLUMNS],
    )
    return obs.select("cik", "as_of").join(states, _current()).drop("state_cik", "epoch", "next_epoch")


def _current() -> Column:
    """Join condition: the state that holds on the observation date."""
    return F.expr("cik = state_cik AND epoch <= as_of AND (next_epoch IS NULL OR as_of < next_epoch)")


def epoch_of(dates: list[dt.date]) -> Column:
    """The first of the dates that sees a fact, NULL after the last one; a CASE chain, for grids of modest length."""
    chain = None
    for day in sorted(set(dates)):
        seen = F.col("filed") <= F.lit(day)
        chain = F.when(seen, F.lit(day)) if chain is None else chain.when(seen, F.lit(day))
    return F.lit(None).cast("date") if chain is None else chain


def with_epoch(facts: DataFrame, obs: DataFrame, dates: list[dt.date] | None = None) -> DataFrame:
    """Attach the earliest observation date that sees each fact; facts no date sees are dropped.

    A fact without a filing date has no place in time and is never seen.  Known grids
    become a CASE chain.  Otherwise a day calendar is derived from the distinct dates; it
    has one row per day, so a century is 36,525 rows whatever the data size, and
    broadcasting it is safe.  Both forms give the same epochs.
    """
    facts = facts.where(F.col("filed").isNotNull())
    if dates is not None and len(dates) <= 64:
        return facts.withColumn("epoch", epoch_of(dates)).where(F.col("epoch").isNotNull())

    days = obs.select("as_of").distinct()
    previous = F.lag("as_of").over(Window.orderBy("as_of"))
    calendar = (
        days.withColumn("from_day", F.coalesce(F.date_add(previous, 1), F.col("as_of")))
        .select(F.col("as_of").alias("epoch"), F.explode(F.sequence("from_day", "as_of")).alias("seen_day"))
    )
    first = obs.select(F.min("as_of").alias("first")).scalar()
    return (
        facts.withColumn("seen_day", F.greatest(F.col("filed"), first))
        .join(F.broadcast(calendar), "seen_day")
        .drop("seen_day")
    )


def period_states(facts_with_epoch: DataFrame) -> DataFrame:
    """State of every fiscal period from each epoch that changed it until the next one."""
    known = ", ".join(f"'{f}'" for f in P.FIELDS)
    src = facts_with_epoch if "marks" in facts_with_epoch.columns else facts_with_epoch.withColumn("marks", tag_marks(F.col("tag")))
    newest = src.where(F.col("field").isin(P.FIELDS)).groupBy("cik", "source", "field", "period_end", "epoch").agg(
        F.max("filed").alias("filed"),
        F.expr("max_by(value, CASE WHEN value IS NOT NULL AND NOT isnan(value) THEN filed END)").alias("value"),
        F.expr("max_by(marks, CASE WHEN marks IS NOT NULL THEN filed END)").alias("marks"),
    )
    # some rows per field and epoch are left of each period; they meet before the wide aggregate, which then has a row per epoch
    slots = newest.selectExpr("*", f"cast(array_position(array({known}), field) as int) - 1 AS slot").repartition("cik", "period_end")

    def only(what: str, field: str) -> str:
        return f"max(CASE WHEN slot = {P.FIELDS.index(field)} THEN {what} END)"

    carried = P.FIELDS + [f"{f}_marks" for f in MARKED_FIELDS]
    deltas = slots.groupBy("cik", "source", "period_end", "epoch").agg(
        F.max("filed").alias("filed"),
        F.expr("bit_or(shiftleft(1L, slot))").alias("present"),
        *[F.expr(only("value", f)).alias(f) for f in P.FIELDS],
        *[F.expr(only("marks", f)).alias(f"{f}_marks") for f in MARKED_FIELDS],
    )
    by_period = "PARTITION BY cik, period_end ORDER BY epoch"
    so_far = f"({by_period} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return deltas.selectExpr(
        "cik", "source", "period_end", "epoch",
        f"lead(epoch) OVER ({by_period}) AS next_epoch",
        f"max(filed) OVER {so_far} AS filed",
        f"bit_or(present) OVER {so_far} AS present",
        *[f"last({c}, true) OVER {so_far} AS {c}" for c in carried],
    )


def observed_periods(
    facts: DataFrame,
    obs: DataFrame,
    dates: list[dt.date] | None = None,
    min_period_end: dt.date | None = None,
) -> DataFrame:
    """One row per observation and visible period, with the chosen anchor period alongside."""
    if min_period_end is not None:
        facts = facts.where(F.col("period_end") >= F.lit(min_period_end))
    states = period_states(with_epoch(facts, obs, dates)).withColumnRenamed("cik", "state_cik")
    known = obs.join(states, _current()).drop("state_cik", "epoch", "next_epoch")

    each = Window.partitionBy("cik", "as_of")
    in_order = each.orderBy("period_end")
    fullest = F.struct(F.bit_count("present").alias("n"), F.col("period_end").alias("d"))
    with_assets = F.when(F.col("present").bitwiseAND(F.lit(ASSETS_BIT).cast("bigint")) != 0, F.col("period_end"))
    return (
        known.withColumns(
            {
                "n_fields": F.bit_count("present"),
                "prior_period_end": F.lag("period_end").over(in_order),
                **{f"prior_{c}": F.lag(c).over(in_order) for c in ("net_income", "revenue", "total_assets")},
                "asset_anchor": F.max(with_assets).over(each),
                "fallback_anchor": F.max(fullest).over(each).getField("d"),
            }
        )
        .withColumn("anchor", F.coalesce("asset_anchor", "fallback_anchor"))
        .withColumn("anchored_by", F.when(F.col("asset_anchor").isNotNull(), "total_assets").otherwise("fullest_period"))
    )


def anchored_snapshots(
    facts: DataFrame,
    obs: DataFrame,
    dates: list[dt.date] | None = None,
    min_period_end: dt.date | None = None,
    max_staleness_days: int | None = P.MAX_STALENESS_DAYS,
) -> DataFrame:
    """Wide single-period snapshot per observation, as reported (nothing derived yet)."""
    snap = observed_periods(facts, obs, dates, min_period_end).where(F.col("period_end") == F.col("anchor"))
    gap = F.date_diff("period_end", "prior_period_end")
    yearly = gap.between(*P.PRIOR_GAP_DAYS)
    priors = ["prior_net_income", "prior_revenue", "prior_total_assets", "prior_period_end"]
    snap = snap.withColumns({c: F.when(yearly, F.col(c)) for c in priors}).withColumn(
        "report_lag_days", F.date_diff("filed", "period_end")
    )
    if max_staleness_days is not None:
        snap = snap.where(F.date_diff("as_of", "period_end") <= max_staleness_days)
    return snap.drop("asset_anchor", "fallback_anchor", "anchor")
