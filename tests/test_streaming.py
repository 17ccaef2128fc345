"""Vintages from files that land over time against the batch form."""

import datetime as dt
import random

import pytest

from vintagerisk.operators import asof
from vintagerisk.operators.codes import code_book, decode
from vintagerisk.sources import storage
from vintagerisk.streaming import vintages

DATES = [dt.date(year, 3, 31) for year in range(2004, 2009)]
LATENESS = 400


def history(seed, n=160):
    """Filings of three companies with missing values, tags and dates, and periods that are filed again and again."""
    pick = random.Random(seed)
    rows = {}
    for _ in range(n):
        end = dt.date(pick.randint(2002, 2007), 12, 31)
        filed = None if pick.random() < 0.05 else end + dt.timedelta(days=pick.randint(20, 900))
        key = (pick.choice("abc"), pick.choice(["cash", "revenue"]), end, filed)
        value = None if pick.random() < 0.3 else round(pick.uniform(-9, 9), 3)
        rows[key] = (key[0], "wire", key[1], end, filed, pick.choice(["20-F", None]), end.year, value, pick.choice(["T1", "T2", None]))
    return list(rows.values())


@pytest.fixture
def places(spark):
    return {name: storage.scratch_path(spark, name) for name in ("folder", "target", "checkpoint")}


def land(spark, places, rows):
    spark.createDataFrame(rows, storage.FACT_SCHEMA).coalesce(2).write.mode("append").parquet(places["folder"])


def update(spark, places, **options):
    vintages.update_versions(spark, **places, dates=DATES, lateness=LATENESS, **options)


def observations(spark):
    return spark.createDataFrame([(c, d) for c in "abcd" for d in DATES], "cik string, as_of date")


def rows_of(df):
    return sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


@pytest.mark.parametrize("files_per_batch", [1, 1000])
def test_deliveries_in_any_number_give_the_batch_vintages(spark, places, files_per_batch):
    facts = history(files_per_batch)
    delays = random.Random(5)
    arrival = {i: f[4] + dt.timedelta(days=delays.randint(0, 30)) for i, f in enumerate(facts) if f[4]}
    for after, until in zip([dt.date.min, *DATES[1:4]], [*DATES[1:4], dt.date.max], strict=True):
        rows = [facts[i] for i, day in arrival.items() if after < day <= until]
        land(spark, places, rows + rows[:5])  # some come twice
        update(spark, places, files_per_batch=files_per_batch)
    closed = vintages.read_versions(spark, places["target"]).selectExpr("max(epoch)").first()[0]
    assert closed is None or closed < DATES[-1]
    vintages.heartbeat(spark, places["folder"], DATES[-1] + dt.timedelta(days=LATENESS + 1))
    update(spark, places, files_per_batch=files_per_batch)
    got = rows_of(asof.vintage_of_versions(vintages.read_versions(spark, places["target"]), observations(spark)))
    assert got == rows_of(asof.latest_vintage(spark.createDataFrame(facts, storage.FACT_SCHEMA), observations(spark), DATES)) and len(got) > 50
    update(spark, places)  # nothing new: nothing is written twice
    assert rows_of(asof.vintage_of_versions(vintages.read_versions(spark, places["target"]), observations(spark))) == got


def test_a_fact_behind_a_closed_epoch_stops_the_job(spark, places):
    def fact(filed, value):
        return ("a", "wire", "cash", dt.date(2003, 12, 31), filed, "20-F", 2003, value, "T1")

    land(spark, places, [fact(dt.date(2004, 3, 1), 1.0), fact(dt.date(2007, 3, 1), 2.0)])
    update(spark, places)
    assert [r.value for r in vintages.read_versions(spark, places["target"]).collect()] == [1.0]
    land(spark, places, [fact(dt.date(2004, 3, 9), 3.0)])
    with pytest.raises(vintages.LateFacts):
        update(spark, places)


def test_a_landing_without_facts_writes_nothing(spark, places):
    land(spark, places, [])
    vintages.heartbeat(spark, places["folder"], DATES[0])
    update(spark, places)
    assert vintages.read_versions(spark, places["target"]).count() == 0


def test_a_book_of_words_gives_the_same_versions_without_a_sort(spark, places):
    facts = history(3)
    book = code_book(spark.createDataFrame(facts, storage.FACT_SCHEMA), asof.WORD_COLUMNS)
    for part in (facts[::2], facts[1::2]):
        land(spark, places, part)
    vintages.heartbeat(spark, places["folder"], DATES[-1] + dt.timedelta(days=LATENESS + 1))
    update(spark, places, book=book)
    versions = vintages.read_versions(spark, places["target"])
    got = decode(asof.vintage_of_versions(versions, observations(spark)), asof.WORD_COLUMNS, book)
    assert rows_of(got) == rows_of(asof.latest_vintage(spark.createDataFrame(facts, storage.FACT_SCHEMA), observations(spark), DATES))
    plain = vintages.version_stream(spark.createDataFrame(facts, storage.FACT_SCHEMA), DATES, LATENESS, book)
    assert "SortAggregate" not in plain._jdf.queryExecution().executedPlan().toString()


def test_a_word_that_is_not_in_the_book_stops_the_stream(spark, places):
    facts = history(3)
    book = code_book(spark.createDataFrame(facts, storage.FACT_SCHEMA).where("tag = 'T1' OR tag IS NULL"), asof.WORD_COLUMNS)
    land(spark, places, facts)
    with pytest.raises(Exception, match="no code for tag"):
        update(spark, places, book=book)
