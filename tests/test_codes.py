"""Code books, and the plans that need them."""

import datetime as dt

import pytest
from test_asof import random_history

from vintagerisk.operators import asof, codes
from vintagerisk.operators.facts import resolve_tag_preference

DAYS = [dt.date(2009, 4, 30), dt.date(2011, 4, 30), dt.date(2013, 4, 30)]


def test_words_come_back(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 'a', 'x'), (2, NULL, 'a'), (3, '', NULL), (4, 'a', 'é') AS t(k, one, two)")
    book = codes.code_book(df, ["one", "two"])
    assert book.count() == 5 and book.select("code").distinct().count() == 5
    coded = codes.encode(df, ["one", "two"], book)
    assert dict(coded.dtypes)["one"] == "int" and coded.where("one IS NULL").count() == 1
    assert sorted(codes.decode(coded, ["one", "two"], book).collect()) == sorted(df.collect())


def test_too_many_or_too_long_words_give_no_book(spark):
    df = spark.range(50).selectExpr("cast(id AS string) AS w")
    assert codes.code_book(df, ["w"], largest=49) is None and codes.code_book(df, ["w"], largest=50).count() == 50
    assert codes.code_book(spark.sql("SELECT repeat('x', 5000) AS w"), ["w"]) is None
    assert codes.code_book(df.where("false"), ["w"]).count() == 0


def test_an_unknown_word_stops_the_job(spark):
    book = codes.code_book(spark.sql("SELECT 'a' AS w"), ["w"])
    with pytest.raises(Exception, match="no code for w"):
        codes.encode(spark.range(1).selectExpr("'b' AS w"), ["w"], book).collect()


@pytest.mark.parametrize("seed", [3, 4])
def test_coded_plans_sort_nothing_and_agree_with_plain_ones(spark, reported, observe, seed, capsys):
    facts, obs = reported(random_history(seed)), observe(*DAYS)
    book = codes.code_book(facts, asof.WORD_COLUMNS)
    plain, coded = asof.latest_vintage(facts, obs, DAYS), asof.latest_vintage(facts, obs, DAYS, book)
    assert sorted(coded.select(plain.columns).collect(), key=str) == sorted(plain.collect(), key=str) and plain.count() > 0
    raw = facts.selectExpr("*", "cast(length(field) % 3 AS int) AS tag_rank", "pmod(hash(*), 1000003) AS row_key")
    best, coded_best = resolve_tag_preference(raw), resolve_tag_preference(raw, book)
    assert sorted(coded_best.select(best.columns).collect(), key=str) == sorted(best.collect(), key=str)
    capsys.readouterr()
    for plan in (coded, coded_best):
        plan.explain()
    assert "SortAggregate" not in capsys.readouterr().out
