import datetime as dt
import re

import duckdb
import pytest

import __spark_entry__ as entrypoint
from tools.check import TABLES, canonical
from vintagerisk.operators.panel import build_panel
from vintagerisk.plans import run as end_to_end
from vintagerisk.sources import tape

SF = "/root/testdata/sf0.001"
QUICK = [
    "q_panel", "q_asof_snapshot", "q_latest_vintage", "q_facts_scan", "q_filing_index", "q_default_confirm", "q_universe_violations",
    "q_panel_diagnostics", "q_gap_tags", "q_hosmer_lemeshow", "q_reliability", "q_psi", "q_irb_capital", "q_lgd", "q_exposures",
    "q_group_folds", "q_crossfit_calibration", "q_tag_census", "q_facility_ead", "q_portfolio", "q_epochs_dirty", "q_source_dirty", "q_universe_dirty",
    "q_portfolio_dirty", "q_refusals_dirty", "q_hosmer_lemeshow_wide",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, duck, name):
    df = entrypoint.queries()[name](spark, SF)
    cursor = duck.execute(entrypoint.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cursor.fetchall(), names)


def test_every_statement_belongs_to_a_query():
    assert set(entrypoint.oracle_sql()) <= set(entrypoint.queries())
    assert len(entrypoint.queries()) >= 80


def test_entry_is_leak_free(spark):
    rows = entrypoint.entry(spark)
    assert rows.count() == 56 and rows.where("filed > as_of").count() == 0
    per_issuer = rows.where("label = 1").groupBy("ticker").count()
    assert per_issuer.where("count > 1").count() == 0


def test_panel_plan_has_no_row_level_fan_out(spark):
    panel = build_panel(tape.issuers(spark, SF), tape.facts(spark, SF), tape.WINDOW)
    plan = panel._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "SortAggregate" not in plan
    lines = re.search(r"ReadSchema: struct<l_orderkey[^>]*>", plan).group(0)
    assert "l_shipdate" not in lines and "l_tax" not in lines


def test_run_end_to_end(spark):
    issuers = tape.issuers(spark, "/root/testdata/sf0.01")
    panel = build_panel(issuers, tape.facts(spark, "/root/testdata/sf0.01"), tape.WINDOW)
    settings = end_to_end.Settings(repeats=2, draws=50, split_year=2000, portfolio_date=dt.date(1999, 6, 30), require_verified=False, boosting_repeats=1, boosting_rounds=3)
    result = end_to_end.run(panel, issuers, settings)
    report = result and end_to_end.report_tables(result).collect()
    assert {r.section for r in report} == set(range(1, 11))
    values = {r.metric: r.value for r in report if r.value is not None}
    assert values["mean_pd_after_correction"] < values["mean_pd_before_correction"]
    assert values["observations"] == 583 and values["paired_n_draws"] == 50
    assert {r.as_of for r in result.exposures.select("as_of").distinct().collect()} == {dt.date(1999, 6, 30)}
    models = {r.model for r in result.discrimination.collect()}
    assert models == {"logistic_oof", "altman_zpp", "logistic_leave_one_issuer_out", "logistic_out_of_time", "gbm_oof"}


def test_run_stops_without_positives(spark):
    issuers = tape.issuers(spark, SF)
    panel = build_panel(issuers, tape.facts(spark, SF), tape.WINDOW).where("label = 0")
    with pytest.raises(ValueError, match="universe is not ready"):
        end_to_end.run(panel, issuers)
    result = end_to_end.run(panel, issuers, end_to_end.Settings(require_verified=False))
    assert result.discrimination is None and {r.section for r in end_to_end.report_tables(result).collect()} == {1, 2, 10}
