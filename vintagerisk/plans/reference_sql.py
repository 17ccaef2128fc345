"""Independent SQL statements of every registered query, in the plain form DuckDB runs.

Views are written the literal way (join every observation to every earlier filing, rank
with one global window, ...), so they check the distributed forms rather than repeat them.
"""

from __future__ import annotations

from vintagerisk import params as P

WINDOW_SQL = ("DATE '1996-01-01'", "DATE '2002-12-31'")


def _list(items) -> str:
    return ", ".join(f"'{i}'" for i in items)


def _pivot(expr: str) -> str:
    return ",\n".join(f"max({expr}) FILTER (WHERE field = '{f}') AS {f}" for f in P.FIELDS)


def _facts_raw(null_values: bool) -> str:
    value = (
        "CASE f WHEN 'total_assets' THEN p*4 WHEN 'total_liabilities' THEN p*2 WHEN 'revenue' THEN p*3 "
        "WHEN 'interest_expense' THEN p*0.1 WHEN 'rnd_expense' THEN p*0.1 WHEN 'sga_expense' THEN p*0.3 "
        "WHEN 'net_interest' THEN p*(-0.1) WHEN 'net_income' THEN (p-35000)*0.5 WHEN 'ebit' THEN (p-30000)*0.6 "
        "WHEN 'pretax_income' THEN (p-30000)*0.5 WHEN 'retained_earnings' THEN p-30000 WHEN 'equity' THEN p-25000 "
        "WHEN 'cfo' THEN (p-20000)*0.5 WHEN 'depreciation_amortisation' THEN p*0.2 ELSE p END"
    )
    if null_values:
        value = f"CASE WHEN l_quantity = 50 THEN NULL ELSE {value} END"
    return f"""
SELECT lpad(CAST(l_suppkey AS varchar), 10, '0') AS cik, f AS field, make_date(y, 12, 31) AS period_end,
       make_date(y, 12, 31) + CAST(30 + (l_orderkey*7 + l_linenumber*13) % 400 AS int) AS filed,
       CASE WHEN l_linestatus = 'F' THEN '10-K' ELSE '10-K/A' END AS form, y AS fiscal_year,
       CAST({value} AS double) AS value,
       CASE WHEN f = 'long_term_debt' AND l_linenumber % 3 = 0 THEN 'LongTermDebt'
            WHEN f = 'current_debt' AND l_linenumber % 3 = 0 THEN 'LongTermDebtCurrent'
            WHEN f = 'net_income' AND l_linenumber % 3 = 2 THEN 'NetIncomeLossAvailableToCommonStockholdersBasic'
            ELSE f || '_' || CAST(l_linenumber % 3 AS varchar) END AS tag,
       l_linenumber % 3 AS tag_rank, 'tape' AS source, l_orderkey, l_linenumber, p
FROM (SELECT *, [{_list(P.FIELDS)}][CAST(l_partkey % 23 AS int) + 1] AS f, l_extendedprice AS p,
             CAST(year(o_orderdate) AS int) AS y
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _resolved(raw: str) -> str:
    return f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik, field, period_end, filed
                                            ORDER BY tag_rank, l_orderkey, l_linenumber, p) AS rn FROM {raw})
WHERE rn = 1"""


VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name: str, needs: list[str], sql: str) -> None:
    VIEWS[name] = (needs, sql.strip())


def with_views(sql: str, *names: str) -> str:
    """Prefix a statement with the views it needs, in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in VIEWS[name][0]:
            visit(dep)
        ordered.append(name)

    for name in names:
        visit(name)
    head = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in ordered)
    return f"WITH RECURSIVE {head}\n{sql.strip()}"


view("facts_raw", [], _facts_raw(False))
view("facts", ["facts_raw"], _resolved("facts_raw"))
view("facts_raw_gaps", [], _facts_raw(True))
view("facts_gaps", ["facts_raw_gaps"], _resolved("facts_raw_gaps"))

view("issuers", [], """
SELECT lpad(CAST(s_suppkey AS varchar), 10, '0') AS cik, s_name AS name, 'S' || CAST(s_suppkey AS varchar) AS ticker,
       r_name AS sector, s_suppkey AS issuer_id, s_suppkey % 7 <> 3 AS verified,
       CASE WHEN s_acctbal < 2000 THEN DATE '1997-01-01' + CAST((s_suppkey*97) % 1500 AS int) END AS default_date,
       CASE WHEN s_acctbal < 2000 THEN CAST(s_suppkey % 10 AS double)/10 END AS w_secured
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")

view("grid", ["issuers"], f"""
SELECT i.*, make_date(y, 6, 30) AS as_of
FROM issuers i, (SELECT CAST(unnest(range(1996, 2003)) AS int) AS y)
WHERE make_date(y, 6, 30) BETWEEN {WINDOW_SQL[0]} AND {WINDOW_SQL[1]}
  AND (default_date IS NULL OR make_date(y, 6, 30) < default_date)""")

view("obs", ["grid"], f"""
SELECT *, CASE WHEN default_date IS NULL THEN 0 WHEN default_date <= as_of + {P.HORIZON_DAYS} THEN 1 ELSE 0 END AS label,
       date_diff('day', as_of, default_date) AS days_to_default,
       CASE WHEN default_date IS NULL THEN 0 ELSE 1 END AS is_default_issuer
FROM grid""")


def _asof_views(suffix: str, facts: str, staleness: int) -> None:
    view(f"vintage{suffix}", [facts, "obs"], f"""
SELECT o.cik, o.as_of, f.field, f.period_end, max(f.filed) AS filed,
       arg_max(f.value, f.filed) FILTER (WHERE f.value IS NOT NULL) AS value,
       arg_max(f.tag, f.filed) FILTER (WHERE f.tag IS NOT NULL) AS tag,
       arg_max(f.form, f.filed) AS form, arg_max(f.source, f.filed) AS source
FROM obs o JOIN {facts} f ON o.cik = f.cik AND f.filed <= o.as_of
GROUP BY ALL""")
    view(f"periods{suffix}", [f"vintage{suffix}"], f"""
SELECT cik, as_of, period_end, count(*) AS n_fields, max(filed) AS filed, min(source) AS source,
       bool_or(field = 'total_assets') AS has_assets,
       max(tag) FILTER (WHERE field = 'long_term_debt') AS ltd_tag,
       max(tag) FILTER (WHERE field = 'current_debt') AS cd_tag,
       max(tag) FILTER (WHERE field = 'net_income') AS ni_tag,
       max(tag) FILTER (WHERE field = 'interest_expense') AS ie_tag,
{_pivot('value')}
FROM vintage{suffix} GROUP BY cik, as_of, period_end""")
    view(f"anchors{suffix}", [f"periods{suffix}"], f"""
SELECT cik, as_of, max(period_end) FILTER (WHERE has_assets) AS asset_anchor,
       arg_max(period_end, n_fields * 1000000 + date_diff('day', DATE '1900-01-01', period_end)) AS fallback_anchor,
       coalesce(max(period_end) FILTER (WHERE has_assets),
                arg_max(period_end, n_fields * 1000000 + date_diff('day', DATE '1900-01-01', period_end))) AS anchor
FROM periods{suffix} GROUP BY cik, as_of""")
    view(f"priors{suffix}", [f"periods{suffix}", f"anchors{suffix}"], f"""
SELECT p.cik, p.as_of, max(p.period_end) AS candidate,
       CASE WHEN date_diff('day', max(p.period_end), any_value(a.anchor)) BETWEEN {P.PRIOR_GAP_DAYS[0]} AND {P.PRIOR_GAP_DAYS[1]}
            THEN max(p.period_end) END AS prior_period_end
FROM periods{suffix} p JOIN anchors{suffix} a USING (cik, as_of) WHERE p.period_end < a.anchor GROUP BY p.cik, p.as_of""")
    view(f"reported{suffix}", [f"periods{suffix}", f"anchors{suffix}", f"priors{suffix}", "obs"], f"""
SELECT o.ticker, o.name, o.sector, o.default_date, o.label, o.days_to_default, o.is_default_issuer, o.issuer_id, p.*,
       CASE WHEN a.asset_anchor IS NOT NULL THEN 'total_assets' ELSE 'fullest_period' END AS anchored_by,
       date_diff('day', p.period_end, p.filed) AS report_lag_days, r.prior_period_end,
       q.net_income AS prior_net_income, q.revenue AS prior_revenue, q.total_assets AS prior_total_assets
FROM obs o JOIN anchors{suffix} a USING (cik, as_of)
JOIN periods{suffix} p ON p.cik = o.cik AND p.as_of = o.as_of AND p.period_end = a.anchor
LEFT JOIN priors{suffix} r ON r.cik = o.cik AND r.as_of = o.as_of
LEFT JOIN periods{suffix} q ON q.cik = o.cik AND q.as_of = o.as_of AND q.period_end = r.prior_period_end
WHERE date_diff('day', p.period_end, o.as_of) <= {staleness}""")
    view(f"filled{suffix}", [f"reported{suffix}"], f"""
SELECT * REPLACE (gp AS gross_profit, eb AS ebit, tl AS total_liabilities),
       concat_ws(',',
           CASE WHEN ie_tag = 'InterestExpenseDebtExcludingAmortization' THEN 'interest_expense~excl_amortisation' END,
           CASE WHEN ni_tag = 'NetIncomeLossAvailableToCommonStockholdersBasic' THEN 'net_income~available_to_common' END,
           CASE WHEN gross_profit IS NULL AND gp IS NOT NULL THEN 'gross_profit' END,
           CASE WHEN ebit IS NULL AND eb IS NOT NULL THEN 'ebit' END,
           CASE WHEN total_liabilities IS NULL AND tl IS NOT NULL THEN 'total_liabilities' END) AS derived
FROM (SELECT *, CASE WHEN ebit IS NOT NULL THEN ebit
                     WHEN gp IS NOT NULL AND sga_expense IS NOT NULL THEN gp - sga_expense - coalesce(rnd_expense, 0)
                     WHEN pretax_income IS NULL THEN NULL
                     WHEN interest_expense IS NOT NULL THEN pretax_income + abs(interest_expense)
                     WHEN net_interest IS NOT NULL THEN pretax_income - net_interest END AS eb,
             CASE WHEN total_liabilities IS NOT NULL THEN total_liabilities ELSE total_assets - equity END AS tl
      FROM (SELECT *, CASE WHEN gross_profit IS NOT NULL THEN gross_profit ELSE revenue - cost_of_revenue END AS gp
            FROM reported{suffix}))""")

    def div(a: str, b: str) -> str:
        return f"CASE WHEN abs({b}) >= 1e-6 THEN ({a}) / ({b}) END"

    def cap(name: str, e: str) -> str:
        lo, hi = P.RATIO_BOUNDS.get(name, P.DEFAULT_BOUNDS)
        return f"CASE WHEN ({e}) IS NULL THEN NULL WHEN ({e}) < {lo} THEN {lo} WHEN ({e}) > {hi} THEN {hi} ELSE ({e}) END AS {name}"

    view(f"basis{suffix}", [f"filled{suffix}"], f"""
SELECT *,
  CASE WHEN long_term_debt IS NULL AND current_debt IS NULL THEN total_debt_reported
       WHEN long_term_debt IS NOT NULL AND current_debt IS NOT NULL AND ltd_tag IN ({_list(P.LTD_INCLUSIVE_TAGS)})
            AND cd_tag IN ({_list(P.CURRENT_MATURITY_TAGS)}) THEN long_term_debt
       ELSE coalesce(long_term_debt, 0) + coalesce(current_debt, 0) END AS total_debt,
  ebit + coalesce(depreciation_amortisation, 0) AS ebitda,
  CASE WHEN interest_expense IS NOT NULL THEN interest_expense WHEN net_interest < 0 THEN abs(net_interest) END AS interest_burden,
  coalesce(equity, total_assets - total_liabilities) AS eq
FROM filled{suffix}""")
    view(f"snaps{suffix}", [f"basis{suffix}"], f"""
SELECT *,
  {cap('wc_ta', div('current_assets - current_liabilities', 'total_assets'))},
  {cap('re_ta', div('retained_earnings', 'total_assets'))},
  {cap('ebit_ta', div('ebit', 'total_assets'))},
  {cap('equity_tl', div('eq', 'total_liabilities'))},
  {cap('current_ratio', div('current_assets', 'current_liabilities'))},
  {cap('debt_ebitda', f"CASE WHEN ebitda > 0 THEN {div('total_debt', 'ebitda')} WHEN ebitda <= 0 AND total_debt IS NOT NULL THEN 50.0 END")},
  {cap('interest_cover', f"CASE WHEN interest_burden <> 0 THEN {div('ebit', 'abs(interest_burden)')} WHEN interest_burden = 0 AND ebit IS NOT NULL THEN 50.0 END")},
  {cap('cfo_total_debt', div('cfo', 'total_debt'))},
  {cap('net_margin', div('net_income', 'revenue'))},
  CASE WHEN total_assets > 0 THEN ln(total_assets) END AS log_assets,
  CASE WHEN eq IS NULL THEN NULL WHEN eq < 0 THEN 1.0 ELSE 0.0 END AS negative_equity,
  CASE WHEN net_income IS NULL OR prior_net_income IS NULL THEN NULL
       WHEN net_income < 0 AND prior_net_income < 0 THEN 1.0 ELSE 0.0 END AS two_year_loss
FROM basis{suffix}""")


_asof_views("", "facts", P.MAX_STALENESS_DAYS)
_asof_views("_gaps", "facts_gaps", P.MAX_STALENESS_DAYS)
_asof_views("_any", "facts", 1000000)

Z2_SQL = " + ".join(f"{w}*{n}" for n, w in P.Z2_WEIGHTS.items())
Z1_SQL = " + ".join(f"{w}*{n}" for n, w in P.Z1_WEIGHTS.items())


def zone_sql(score: str, cuts=P.Z2_ZONES) -> str:
    return f"CASE WHEN ({score}) IS NULL THEN 'unscored' WHEN ({score}) > {cuts[0]} THEN 'safe' WHEN ({score}) < {cuts[1]} THEN 'distress' ELSE 'grey' END"


view("panel", ["snaps"], f"SELECT *, {Z2_SQL} AS z2, {zone_sql(Z2_SQL)} AS z_zone FROM snaps")

ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str, *views: str) -> None:
    ORACLES[name] = with_views(sql, *views) if views else sql.strip()


def r(expr: str, places: int = 6, alias: str | None = None) -> str:
    return f"round(CAST({expr} AS double), {places}) + 0.0 AS {alias or expr}"


FEATURES_SQL = ",\n".join(r(f) for f in P.FEATURES)

oracle("q_panel", f"""
SELECT ticker, cik, name, sector, as_of, period_end, filed, CAST(report_lag_days AS int) AS report_lag_days, source,
       is_default_issuer, CAST(days_to_default AS int) AS days_to_default, label,
       {r('total_assets', 4)}, {r('total_debt', 4)}, {FEATURES_SQL}, {r('z2', 6, 'z_double_prime')}, z_zone
FROM panel""", "panel")
