import datetime as dt
import random

import pytest

from vintagerisk import params as P
from vintagerisk.operators import asof
from vintagerisk.operators.snapshot import compute_ratios, derive_fields

SPRING = [dt.date(y, 4, 30) for y in range(2005, 2013)]


def wide(facts, obs, **more):
    rows = derive_fields(asof.anchored_snapshots(facts, obs, **more)).collect()
    return {r.as_of: r for r in rows}


def literal(facts, day):
    """What a reader of the filings knows on a day: per period and field the newest filing's value, gaps filled from older ones."""
    known = {}
    for f in sorted((f for f in facts if f.filed and f.filed <= day), key=lambda f: f.filed):
        period = known.setdefault(f.period_end, {"filed": f.filed, "fields": set()})
        period["filed"] = max(period["filed"], f.filed)
        period["fields"].add(f.field)
        if f.value is not None:
            period[f.field] = f.value
    if not known:
        return None
    with_assets = [p for p in known if "total_assets" in known[p]["fields"]]
    anchor = max(with_assets) if with_assets else max(known, key=lambda p: (len(known[p]["fields"]), p))
    earlier = [p for p in known if p < anchor]
    prior = max(earlier) if earlier else None
    if prior and not P.PRIOR_GAP_DAYS[0] <= (anchor - prior).days <= P.PRIOR_GAP_DAYS[1]:
        prior = None
    return anchor, known[anchor], known[prior] if prior else {}


def random_history(seed):
    r = random.Random(seed)
    history = {}
    for year in range(2003, 2012):
        for field in ("total_assets", "net_income", "revenue", "cash"):
            if r.random() < 0.8:
                lags = sorted(r.sample(range(20, 900), r.choice([1, 1, 2, 4])))
                history[field, year] = [(None if r.random() < 0.1 else lag, None if r.random() < 0.2 else r.randrange(10_000) / 8) for lag in lags]
    return history


@pytest.mark.parametrize("seed", [11, 12, 13])
@pytest.mark.parametrize("dates", [None, SPRING])
def test_snapshots_of_random_histories_equal_a_literal_reading(reported, observe, seed, dates):
    facts = reported(random_history(seed))
    got = {r.as_of: r for r in asof.anchored_snapshots(facts, observe(*SPRING), dates, max_staleness_days=None).collect()}
    rows = facts.collect()
    for day in SPRING:
        want = literal(rows, day)
        if want is None:
            assert day not in got
            continue
        anchor, now, before = want
        assert got[day].period_end == anchor and got[day].filed == now["filed"]
        assert got[day].report_lag_days == (now["filed"] - anchor).days
        for field in ("total_assets", "net_income", "revenue", "cash"):
            assert got[day][field] == now.get(field), (day, field)
        assert got[day].prior_net_income == before.get("net_income")


def test_both_forms_of_the_epoch_agree_on_missing_dates(reported, observe):
    facts = reported({("total_assets", 2004): [(None, 9.0), (100, 4.0), (200, None)], ("cash", 2004): [(None, 1.0)]})
    both = [sorted((r.epoch, r.filed, str(r.value)) for r in asof.with_epoch(facts, observe(*SPRING), d).select("epoch", "filed", "value").collect()) for d in (None, SPRING)]
    assert both[0] == both[1] and len(both[0]) == 2
    got = wide(facts, observe(*SPRING))
    assert got[SPRING[0]].total_assets == 4.0 and got[SPRING[0]].cash is None


def test_age_limits(reported, observe):
    facts = reported({("total_assets", 2004): [(75, 31.0)], ("total_assets", 2006): [(75, 62.0)]})
    held = wide(facts, observe(*SPRING), max_staleness_days=500)
    assert sorted(d.year for d in held) == [2005, 2006, 2007, 2008] and held[SPRING[1]].total_assets == 31.0
    assert len(wide(facts, observe(*SPRING), max_staleness_days=None)) == len(SPRING)
    late = wide(facts, observe(*SPRING), min_period_end=dt.date(2005, 1, 1))
    assert min(late) == dt.date(2007, 4, 30)


def test_a_loose_balance_date_does_not_become_the_anchor(reported, observe):
    facts = reported({("total_assets", 2007): [(60, 820.0)], ("ebit", 2007): [(60, 33.0)], ("current_debt", dt.date(2008, 3, 31)): [(20, 12.5)]})
    got = wide(facts, observe(dt.date(2008, 4, 30)))[dt.date(2008, 4, 30)]
    assert (got.period_end, got.ebit, got.anchored_by) == (dt.date(2007, 12, 31), 33.0, "total_assets")


def test_no_balance_sheet_the_period_with_most_fields_anchors(reported, observe):
    history = {(f, y): [(45, float(y))] for y in (2006, 2007) for f in ("revenue", "cfo", "cash")} | {("cash", dt.date(2008, 2, 29)): [(10, 1.0)]}
    got = wide(reported(history), observe(dt.date(2008, 4, 30)))[dt.date(2008, 4, 30)]
    assert (got.period_end.year, got.cfo, got.anchored_by) == (2007, 2007.0, "fullest_period")


# operating result: what is reported, and the value and the list of derived fields it must lead to
EBIT_CASES = [
    ({"gross_profit": 250, "sga_expense": 90, "rnd_expense": 45, "pretax_income": 1, "interest_expense": 1}, 115, ["ebit"]),
    ({"gross_profit": 250, "sga_expense": 90}, 160, ["ebit"]),
    ({"revenue": 640, "cost_of_revenue": 410, "sga_expense": 130, "rnd_expense": 20}, 80, ["gross_profit", "ebit"]),
    ({"gross_profit": 250, "pretax_income": 17, "interest_expense": -6}, 23, ["ebit"]),
    ({"pretax_income": 17, "net_interest": -4}, 21, ["ebit"]),
    ({"pretax_income": 17}, None, []),
    ({"ebit": 5, "pretax_income": 17, "interest_expense": 6}, 5, []),
]


def test_operating_result_chain(spark, reported, observe):
    day = dt.date(2010, 4, 30)
    companies = [(f"c{k}", case) for k, (case, _, _) in enumerate(EBIT_CASES)]
    facts, obs = None, None
    for name, case in companies:
        f, o = reported({(field, 2009): [(80, v)] for field, v in case.items()}, name), observe(day, company=name)
        facts, obs = (f, o) if facts is None else (facts.unionByName(f), obs.unionByName(o))
    got = {r.cik: r for r in derive_fields(asof.anchored_snapshots(facts, obs)).collect()}
    for (name, _), (_, ebit, derived) in zip(companies, EBIT_CASES, strict=True):
        assert (got[name].ebit, got[name].derived_fields) == (ebit, derived)


def test_identity_and_stand_in_tags_are_listed(reported, observe):
    day = dt.date(2010, 4, 30)
    stand_in = {name.split("~")[0]: tag for tag, name in P.APPROXIMATE_TAGS.items()} if not any("~" in t for t in P.APPROXIMATE_TAGS) else {}
    history = {("total_assets", 2009): [(80, 512.0)], ("equity", 2009): [(80, 200.0)]}
    history |= {(field, 2009): [(80, 3.0, tag)] for field, tag in stand_in.items()}
    got = wide(reported(history), observe(day))[day]
    assert got.total_liabilities == 312.0 and "total_liabilities" in got.derived_fields
    assert {d.split("~")[0] for d in got.derived_fields if "~" in d} == set(stand_in)


def test_a_daily_refiler_collapses_before_the_join(spark, observe):
    days = [dt.date(2009, 4, 30), dt.date(2009, 10, 31)]
    facts = spark.range(330).selectExpr(
        "'7310042' AS cik", "'wire' AS source", "'total_assets' AS field", "date'2008-12-31' AS period_end", "date_add(date'2009-01-10', cast(id as int)) AS filed",
        "'20-F' AS form", "2008 AS fiscal_year", "cast(3 * id as double) AS value", "'T' AS tag",
    )
    assert asof.period_states(asof.with_epoch(facts, observe(*days), days)).count() == 2
    got = {r.as_of: r.total_assets for r in asof.anchored_snapshots(facts, observe(*days), days).collect()}
    assert got == {d: 3.0 * (d - dt.date(2009, 1, 10)).days for d in days}


@pytest.mark.parametrize("seed", [21, 22])
def test_latest_vintage_of_random_histories(reported, observe, seed):
    facts, days = reported(random_history(seed)), SPRING[2:6]
    rows, want = facts.collect(), {}
    for day in days:
        for f in sorted((f for f in rows if f.filed and f.filed <= day), key=lambda f: f.filed):
            value, _ = want.get((day, f.field, f.period_end), (None, None))
            want[day, f.field, f.period_end] = (value if f.value is None else f.value, f.filed)
    got = {(r.as_of, r.field, r.period_end): (r.value, r.filed) for r in asof.latest_vintage(facts, observe(*days)).collect()}
    assert got == want
    seen = asof.visible_facts(facts, observe(*days)).count()
    assert seen == sum(1 for d in days for f in rows if f.filed and f.filed <= d)


def test_cover_from_net_interest(reported, observe):
    day = dt.date(2010, 4, 30)
    facts = reported({("total_assets", 2009): [(80, 700.0)], ("ebit", 2009): [(80, 42.0)], ("net_interest", 2009): [(80, -6.0)]})
    assert compute_ratios(derive_fields(asof.anchored_snapshots(facts, observe(day)))).first().interest_cover == 7.0
