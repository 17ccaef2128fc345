"""SQL statements of the point-in-time and diagnostic queries."""

from __future__ import annotations

from vintagerisk import params as P
from vintagerisk.plans.reference_sql import FEATURES_SQL, Z1_SQL, oracle, r, view, zone_sql

INT = "CAST({} AS int) AS {}"


def rr(names, places: int) -> str:
    return ", ".join(r(n, places) for n in names)


oracle("q_tag_preference", f"SELECT cik, field, period_end, filed, form, fiscal_year, {r('value', 4)}, tag FROM facts", "facts")
oracle("q_visible_facts", f"""
SELECT o.cik, o.as_of, count(*) AS n_facts, max(filed) AS latest_filed, {r('sum(value)', 4, 'total_value')}
FROM obs o JOIN facts f ON o.cik = f.cik AND filed <= as_of GROUP BY o.cik, o.as_of""", "obs", "facts")
for name in ("q_latest_vintage", "q_stream_vintage"):
    oracle(name, f"SELECT cik, as_of, field, period_end, filed, {r('value', 4)}, tag, form FROM vintage_gaps", "vintage_gaps")
oracle("q_anchor_period", """
SELECT a.cik, a.as_of, a.anchor, CASE WHEN asset_anchor IS NOT NULL THEN 'total_assets' ELSE 'fullest_period' END AS anchored_by,
       p.n_fields
FROM anchors a JOIN periods p ON p.cik = a.cik AND p.as_of = a.as_of AND p.period_end = a.anchor""", "anchors", "periods")
PRIORS = ["prior_net_income", "prior_revenue", "prior_total_assets"]
oracle("q_prior_period", f"SELECT cik, as_of, period_end, prior_period_end, {rr(PRIORS, 4)} FROM reported_any", "reported_any")
oracle("q_asof_snapshot", f"""
SELECT cik, as_of, period_end, filed, {INT.format('report_lag_days', 'report_lag_days')}, source, anchored_by, prior_period_end,
       {rr(P.FIELDS, 4)}, {rr(PRIORS, 4)} FROM reported_gaps""", "reported_gaps")

view("facts_late", ["facts"], "SELECT * FROM facts WHERE period_end >= DATE '1999-01-01'")
view("periods_late", ["facts_late", "obs"], """
SELECT cik, as_of, period_end, count(*) AS n, bool_or(field = 'total_assets') AS has_assets,
       max(value) FILTER (WHERE field = 'total_assets') AS total_assets
FROM (SELECT o.cik, o.as_of, field, period_end, arg_max(value, filed) AS value
      FROM obs o JOIN facts_late f ON o.cik = f.cik AND filed <= as_of GROUP BY ALL) GROUP BY cik, as_of, period_end""")
oracle("q_min_period", f"""
SELECT cik, as_of, period_end, prior_period_end, {r('total_assets', 4)} FROM (
  SELECT *, (SELECT CASE WHEN date_diff('day', max(q.period_end), x.period_end) BETWEEN 270 AND 460 THEN max(q.period_end) END
             FROM periods_late q WHERE q.cik = x.cik AND q.as_of = x.as_of AND q.period_end < x.period_end) AS prior_period_end
  FROM (SELECT *, row_number() OVER (PARTITION BY cik, as_of ORDER BY has_assets DESC,
                                     CASE WHEN has_assets THEN 0 ELSE n END DESC, period_end DESC) AS k FROM periods_late) x
  WHERE k = 1 AND date_diff('day', period_end, as_of) <= 550)""", "periods_late")
oracle("q_stale_dropped", """
SELECT cik, as_of, period_end, CAST(date_diff('day', period_end, as_of) AS int) AS age_days,
       date_diff('day', period_end, as_of) <= 550 AS kept_default, date_diff('day', period_end, as_of) <= 365 AS kept_365
FROM reported_any""", "reported_any")
oracle("q_derived_fields", f"""
SELECT cik, as_of, {rr(['gross_profit', 'ebit', 'total_liabilities'], 4)}, derived FROM filled_gaps""", "filled_gaps")
oracle("q_total_debt", f"""
SELECT cik, as_of, {rr(['long_term_debt', 'current_debt', 'total_debt_reported', 'total_debt'], 4)} FROM basis_gaps""", "basis_gaps")
oracle("q_ratios", f"SELECT cik, as_of, {rr(['ebitda', 'interest_burden'], 4)}, {FEATURES_SQL} FROM snaps_gaps", "snaps_gaps")
oracle("q_obs_grid", "SELECT ticker, cik, as_of, default_date FROM grid", "grid")
oracle("q_labels", """
SELECT ticker, as_of, label, CAST(days_to_default AS int) AS days_to_default, is_default_issuer FROM obs""", "obs")
oracle("q_altman", f"""
SELECT ticker, as_of, {r('z2', 6, 'z_double_prime')}, {r('z2 + 3.25', 6, 'em_score')}, z_zone FROM panel""", "panel")
oracle("q_altman_zprime", f"""
SELECT ticker, as_of, {r('sales_ta')}, {r(Z1_SQL, 6, 'z_prime')}, {zone_sql(Z1_SQL, P.Z1_ZONES)} AS zone
FROM (SELECT *, CASE WHEN abs(total_assets) >= 1e-6 THEN revenue / total_assets END AS sales_ta FROM snaps)""", "snaps")

W = P.O_SCORE_WEIGHTS
view("ohlson", ["snaps"], f"""
SELECT *, CASE WHEN o IS NOT NULL THEN 1 / (1 + exp(-greatest(-40, least(40, o)))) END AS o_pd FROM (
SELECT *, CASE WHEN total_assets IS NULL OR total_liabilities IS NULL OR current_assets IS NULL OR current_liabilities IS NULL
                 OR net_income IS NULL OR total_assets <= 0 OR total_liabilities <= 0 OR current_liabilities <= 0 THEN NULL
ELSE {W['const']} + {W['size']} * ln(total_assets / 100.0) + {W['tl_ta']} * total_liabilities / total_assets
  + {W['wc_ta']} * (current_assets - current_liabilities) / total_assets
  + {W['cl_ca']} * (CASE WHEN current_assets > 0 THEN current_liabilities / current_assets ELSE 0 END)
  + {W['oeneg']} * (CASE WHEN total_liabilities > total_assets THEN 1 ELSE 0 END)
  + {W['ni_ta']} * net_income / total_assets
  + {W['ffo_tl']} * (CASE WHEN cfo IS NULL THEN 0 ELSE cfo / total_liabilities END)
  + {W['intwo']} * (CASE WHEN prior_net_income IS NOT NULL AND net_income < 0 AND prior_net_income < 0 THEN 1 ELSE 0 END)
  + {W['chin']} * (CASE WHEN prior_net_income IS NULL OR abs(net_income) + abs(prior_net_income) = 0 THEN 0
       ELSE (net_income - prior_net_income) / (abs(net_income) + abs(prior_net_income)) END) END AS o FROM snaps)""")
oracle("q_ohlson", f"SELECT ticker, as_of, {r('o', 6, 'o_score')}, {r('o_pd', 8, 'o_score_pd')} FROM ohlson", "ohlson")

# diagnostics
oracle("q_panel_diagnostics", f"""
SELECT count(*) AS observations, count(DISTINCT ticker) AS issuers, CAST(sum(label) AS bigint) AS positive_labels,
       {r('avg(label)', 8, 'sample_default_rate')},
       (SELECT string_agg(CAST(y AS varchar), ',' ORDER BY y) FROM (SELECT DISTINCT year(as_of) AS y FROM panel)) AS observation_years,
       count(DISTINCT CASE WHEN label = 1 THEN ticker END) AS defaulted_issuers,
       {r('quantile_cont(report_lag_days, 0.5)', 2, 'median_report_lag_days')},
       (SELECT string_agg(source || ':' || n, ',' ORDER BY source) FROM (SELECT source, count(*) AS n FROM panel GROUP BY source)) AS source_mix
FROM panel""", "panel")
view("gaps_long", ["panel"], " UNION ALL ".join(
    f"SELECT ticker, as_of, label, is_default_issuer, '{f}' AS feature, CASE WHEN {f} IS NULL THEN 1 ELSE 0 END AS gap FROM panel"
    for f in P.FEATURES + ["total_debt"]))
ONLY_FEATURES = "feature <> 'total_debt'"
oracle("q_top_missing", f"""
SELECT feature, {r('avg(gap)', 3, 'missing_share')} FROM gaps_long WHERE {ONLY_FEATURES} GROUP BY feature
ORDER BY avg(gap) DESC, feature LIMIT 5""", "gaps_long")
oracle("q_coverage_warnings", f"""
SELECT 'feature mostly imputed' AS warning, feature AS subject, {r('avg(gap)', 6, 'value')} FROM gaps_long WHERE {ONLY_FEATURES}
GROUP BY feature HAVING avg(gap) > 0.2
UNION ALL SELECT 'too few positive observations', 'panel', CAST(sum(label) AS double) FROM panel HAVING sum(label) < 8
UNION ALL SELECT 'too few defaulted issuers', 'panel', CAST(count(DISTINCT CASE WHEN label = 1 THEN ticker END) AS double) FROM panel
  HAVING count(DISTINCT CASE WHEN label = 1 THEN ticker END) < 5""", "gaps_long", "panel")
view("controls", ["panel"], """
SELECT *, CASE WHEN (debt_ebitda IS NOT NULL AND debt_ebitda > 4) OR (interest_cover IS NOT NULL AND interest_cover < 2)
               THEN 1 ELSE 0 END AS flag FROM panel WHERE label = 0""")
oracle("q_hardness", f"""
SELECT count(*) AS control_observations, {r('avg(flag)', 8, 'speculative_share')},
       {r('avg(CASE WHEN is_default_issuer = 0 THEN flag END)', 8, 'speculative_share_survivors')},
       count(DISTINCT CASE WHEN is_default_issuer = 0 AND flag = 1 THEN ticker END) AS speculative_issuers,
       CASE WHEN avg(CASE WHEN is_default_issuer = 0 THEN flag END) IS NULL THEN 'not computable'
            WHEN avg(CASE WHEN is_default_issuer = 0 THEN flag END) < 0.10 THEN 'easy task'
            WHEN avg(CASE WHEN is_default_issuer = 0 THEN flag END) < 0.30 THEN 'partially hard' ELSE 'hard task' END AS verdict
FROM controls""", "controls")
oracle("q_speculative_issuers", """
SELECT ticker, count(*) AS n_observations FROM controls WHERE flag = 1 AND is_default_issuer = 0 GROUP BY ticker""", "controls")
oracle("q_defaulters_without_positive", """
SELECT ticker, default_date FROM issuers WHERE default_date IS NOT NULL
AND ticker NOT IN (SELECT ticker FROM reported_any WHERE label = 1 AND date_diff('day', period_end, as_of) <= 200)""", "issuers", "reported_any")
oracle("q_missing_by_issuer", f"""
SELECT ticker, feature, max(is_default_issuer) AS defaulter, count(*) AS observations, {r('avg(gap)', 4, 'missing_share')}
FROM gaps_long WHERE feature IN (SELECT feature FROM gaps_long WHERE gap = 1) GROUP BY ticker, feature""", "gaps_long")
oracle("q_missing_by_cohort", f"""
SELECT feature, {r('avg(gap) FILTER (WHERE is_default_issuer = 0)', 4, 'survivors')},
       {r('avg(gap) FILTER (WHERE is_default_issuer = 1)', 4, 'defaulters')}
FROM gaps_long WHERE {ONLY_FEATURES} GROUP BY feature HAVING sum(gap) > 0""", "gaps_long")
GAP_LIST = "concat_ws(',', " + ", ".join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in P.FEATURES) + ")"
oracle("q_positive_gaps", f"SELECT ticker, as_of, {GAP_LIST} AS missing FROM panel WHERE label = 1 AND {GAP_LIST} <> ''", "panel")
oracle("q_z_medians", "SELECT ticker, max(is_default_issuer) AS defaulter, " + ", ".join(
    r(f"median({c})", 6, a) for c, a in [(x, x) for x in P.Z2_WEIGHTS] + [("z2", "z_double_prime")]) + " FROM panel GROUP BY ticker", "panel")
FIELD_LIST = "concat_ws(',', " + ", ".join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in P.FIELDS) + ")"
view("gap_rows", ["snaps"], f"SELECT *, {FIELD_LIST} AS missing FROM snaps WHERE {' OR '.join(f + ' IS NULL' for f in P.FEATURES)}")
oracle("q_gap_fields", "SELECT ticker, as_of, period_end, derived, missing, label = 1 AS is_positive FROM gap_rows", "gap_rows")

KNOWN = "(" + ", ".join(f"'{t}'" for tags in (P.INSTANT_FIELDS | P.DURATION_FIELDS).values() for t in tags) + ")"
VOCABULARY = "[" + ", ".join("[" + ", ".join(f"'{t}'" for t in tags) + "]" for tags in (P.INSTANT_FIELDS | P.DURATION_FIELDS).values()) + "]"
view("entries", [], f"""
SELECT lpad(CAST(l_suppkey AS varchar), 10, '0') AS cik,
       CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN 'dei' ELSE 'us-gaap' END AS taxonomy,
       CASE WHEN l_partkey % 29 = 0 THEN 'UnknownTag' ELSE tags[CAST(l_linenumber % len(tags) AS int) + 1] END AS tag,
       CASE WHEN l_quantity = 1 THEN 'shares' WHEN l_quantity = 2 THEN 'USD/shares' ELSE 'USD' END AS unit,
       CASE WHEN l_quantity <> 3 THEN make_date(y, 12, 31) - CASE WHEN l_linenumber % 4 = 0 THEN 90 ELSE 364 END END AS start_day,
       make_date(y, 12, 31) AS period_end,
       make_date(y, 12, 31) + CAST(30 + (l_orderkey*7 + l_linenumber*13) % 400 AS int) AS filed,
       l_extendedprice AS value,
       CASE WHEN l_discount = 0 THEN '10-Q' WHEN l_linestatus = 'F' THEN '10-k' ELSE '10-K/A' END AS form, y AS fiscal_year
FROM (SELECT *, {VOCABULARY}[CAST(l_partkey % 23 AS int) + 1] AS tags, CAST(year(o_orderdate) AS int) AS y
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""")
view("usd_entries", ["entries"], "SELECT * FROM entries WHERE taxonomy = 'us-gaap' AND starts_with(unit, 'USD')")
oracle("q_tag_census", f"""
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cik ORDER BY period_ends DESC, tag) AS int) AS position FROM (
  SELECT cik, tag, count(DISTINCT period_end) AS period_ends, CAST(year(min(period_end)) AS int) AS first_year,
         CAST(year(max(period_end)) AS int) AS last_year, tag IN {KNOWN} AS in_schema
  FROM usd_entries WHERE starts_with(form, '10-K')
    AND regexp_matches(tag, '(Debt|Borrowing|NotesPayable|SeniorNotes|LineOfCredit|CommercialPaper|FinanceLease|Interest)', 'i')
  GROUP BY cik, tag))""", "usd_entries")
view("probes", ["gap_rows"], " UNION ALL ".join(
    f"SELECT cik, ticker, as_of, period_end AS gap_period, '{f}' AS field, '{p}' AS pattern FROM gap_rows WHERE {f} IS NULL"
    for f, p in P.GAP_PROBES.items()))
oracle("q_gap_tags", f"""
SELECT ticker, field, gap_period, position, tag, span_days, {r('value', 4)}, filed, tag IN {KNOWN} AS in_schema FROM (
 SELECT *, CAST(row_number() OVER (PARTITION BY ticker, field ORDER BY CASE WHEN span_days BETWEEN 300 AND 430 THEN 0 ELSE 1 END,
                                   tag, span_days, value, filed) AS int) AS position
 FROM (SELECT DISTINCT g.ticker, g.field, g.gap_period, e.tag, CAST(date_diff('day', e.start_day, e.period_end) AS int) AS span_days, e.value, e.filed
       FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, field ORDER BY as_of) AS k FROM probes) WHERE k = 1) g
       JOIN usd_entries e ON e.cik = g.cik AND abs(date_diff('day', e.period_end, g.gap_period)) <= 7
        AND starts_with(e.form, '10-K') AND e.start_day IS NOT NULL AND regexp_matches(e.tag, g.pattern)))""", "probes", "usd_entries")
