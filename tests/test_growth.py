"""How often queries read, move and sort their rows: what decides their cost on large tables."""

import contextlib
import json
import re
from collections import Counter

import pytest

import __spark_entry__ as entrypoint
from vintagerisk.models import resampling
from vintagerisk.plans import core, run
from vintagerisk.sources import tape

SF = "/root/testdata/sf0.001"


@contextlib.contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): str(v) for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("broadcast", [-1, 10_000_000])
def test_documents_shuffle_the_lines_once_and_aggregate_nothing(spark, broadcast):
    with settings(spark, spark__sql__autoBroadcastJoinThreshold=broadcast):
        plan = plan_of(tape.company_documents(spark, SF))
    assert len(re.findall(r"Exchange hashpartitioning\(l_orderkey", plan)) == 1
    assert len(re.findall(r"Exchange hashpartitioning\((?!o_orderkey)", plan)) == 1 and "Aggregate" not in plan


def test_documents_hold_every_line_of_an_issuer_and_filing_once(spark):
    entries = tape.statement_entries(spark, SF)
    want = Counter((r.cik, r.filing_id) for r in entries.collect())
    docs = [json.loads(r.document) for r in tape.company_documents(spark, SF).collect()]
    sizes = Counter((d["cik"], sum(len(e) for tags in d["facts"].values() for b in tags.values() for e in b["units"].values())) for d in docs)
    assert sizes == Counter((cik, n) for (cik, _), n in want.items())


def test_annual_span_reads_the_documents_once(spark):
    plan = plan_of(entrypoint.queries()["q_annual_span"](spark, SF))
    assert len(re.findall(r"FileScan parquet \[l_orderkey", plan)) == 1


@pytest.mark.parametrize("name", ["q_winsorise", "q_exposures", "q_cross_section"])
def test_a_panel_read_twice_is_built_once(spark, name):
    """What a query still has to do after its own quantiles starts from stored rows, not from the facts."""
    assert "l_extendedprice" not in plan_of(entrypoint.queries()[name](spark, SF))


def test_the_run_builds_its_panel_once(spark):
    """neither the median of the scores nor the rows that it completes go back to the facts."""
    scored = run._with_risk_score(core.issuer_panel(spark, SF))
    plan = plan_of(scored)
    scored.collect()  # the scalar's plan is there once it has run
    assert "l_extendedprice" not in plan + plan_of(scored)


def test_the_run_fits_all_rows_once(spark, monkeypatch):
    """the left-out fits start from the fit whose coefficients are reported."""
    fits, whole_fit = [], resampling.whole_fit
    monkeypatch.setattr(resampling, "whole_fit", lambda *a: fits.append(1) or whole_fit(*a))
    settings = run.Settings(folds=2, repeats=1, draws=20, require_verified=False, boosting_repeats=0)
    run.run(core.issuer_panel(spark, SF), tape.issuers(spark, SF), settings)
    assert len(fits) == 1


def test_the_book_of_words_needs_no_orders(spark, monkeypatch):
    read = []
    table = tape.table
    monkeypatch.setattr(tape, "table", lambda spark, sf_dir, name: read.append(name) or table(spark, sf_dir, name))
    book = tape.fact_words(spark, SF)
    assert read == ["lineitem"]
    known = {(r.name, r.word) for r in book.collect()}
    facts = tape.facts_raw(spark, SF).select("tag", "form", "source").distinct().collect()
    assert {(c, r[c]) for r in facts for c in ("tag", "form", "source")} <= known


def test_the_panel_deals_wide_rows_only_once_they_are_few(spark):
    """The aggregate of all fields of a period takes its rows from one partition; what it sums up in part is not shuffled."""
    with settings(spark, spark__sql__adaptive__enabled=False, spark__sql__autoBroadcastJoinThreshold=-1):
        lines = plan_of(core.issuer_panel(spark, SF)).splitlines()
    wide = [k for k, line in enumerate(lines) if "HashAggregate" in line and "bit_or" in line]
    assert len(wide) == 2 and "Exchange" not in "".join(lines[wide[0] : wide[1]])
    dealt = [m for line in lines for m in re.findall(r"Exchange hashpartitioning\((\w+)#\w+, (\w+)#\w+(?:, (\w+)#\w+)?, \d", line)]
    assert dealt == [("cik", "period_end", ""), ("cik", "field", "period_end")]
