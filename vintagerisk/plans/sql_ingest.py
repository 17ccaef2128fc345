"""SQL statements of the source, ingest and universe queries."""

from __future__ import annotations

from vintagerisk import params as P
from vintagerisk.plans import sql_panel  # noqa: F401  (views)
from vintagerisk.plans.reference_sql import oracle, r, view

view("dictionary", [], "SELECT * FROM (VALUES " + ", ".join(
    f"('{tag}', '{field}', {rank}, {str(flow).lower()})"
    for flow, fields in ((False, P.INSTANT_FIELDS), (True, P.DURATION_FIELDS))
    for field, tags in fields.items() for rank, tag in enumerate(tags)) + ") AS d(tag, field, tag_rank, is_flow)")
view("wanted", ["usd_entries", "dictionary"], """
SELECT e.*, d.field, d.tag_rank, d.is_flow, date_diff('day', start_day, period_end) AS span
FROM usd_entries e JOIN dictionary d ON e.tag = d.tag WHERE upper(form) IN ('10-K', '10-K/A')""")
oracle("q_facts_scan", f"""
SELECT cik, field, period_end, filed, form, fiscal_year, {r('value', 4)}, tag, tag_rank FROM wanted
WHERE NOT is_flow OR (span BETWEEN 300 AND 430)""", "wanted")
oracle("q_annual_span", """
SELECT field, count(*) AS seen, count(start_day) AS with_start, count(*) FILTER (WHERE span BETWEEN 300 AND 430) AS kept
FROM wanted WHERE is_flow GROUP BY field""", "wanted")
oracle("q_source_fallback", f"""
SELECT cik, source, count(*) AS n_facts, count(form) AS n_forms, {r('sum(value)', 4, 'total_value')} FROM (
  SELECT cik, 'second' AS source, value * 2 AS value, NULL AS form FROM facts WHERE CAST(cik AS bigint) % 3 = 0
  UNION ALL SELECT cik, source, value, form FROM facts WHERE CAST(cik AS bigint) % 3 <> 0)
GROUP BY cik, source""", "facts")
view("filing_rows", [], """
SELECT lpad(CAST(user_id AS varchar), 10, '0') AS cik, CAST(ts AS date) AS filing_date, event_id // 1000 AS page_no,
       CASE WHEN event_type = 'view' THEN '10-Q' ELSE '8-K' END AS form,
       CASE WHEN event_type = 'error' AND value > 20 THEN '1.03,7.01,9.01' WHEN event_type = 'error' THEN '10.3,2.02' ELSE '2.02,9.01' END AS items
FROM events""")
view("claims", [], """
SELECT lpad(CAST(user_id AS varchar), 10, '0') AS cik, DATE '2024-01-01' + CAST((user_id * 7) % 30 AS int) AS default_date,
       user_id % 2 = 0 AS verified FROM (SELECT DISTINCT user_id FROM events)""")
oracle("q_filing_index", """
SELECT DISTINCT f.cik, f.form, f.filing_date, f.items FROM filing_rows f
JOIN (SELECT cik, page_no, min(filing_date) AS a, max(filing_date) AS b,
             page_no = max(page_no) OVER (PARTITION BY cik) AS is_recent FROM filing_rows GROUP BY cik, page_no) p
  ON p.cik = f.cik AND p.page_no = f.page_no
JOIN claims c ON c.cik = f.cik
WHERE f.form = '8-K' AND (p.is_recent OR (p.b >= c.default_date - 2 AND p.a <= c.default_date + 2))""", "filing_rows", "claims")
oracle("q_resolve_cik", """
SELECT 's' || CAST(c_custkey AS varchar) AS ticker, i.cik FROM customer LEFT JOIN issuers i
ON i.ticker = upper('s' || CAST(c_custkey AS varchar))""", "issuers")
oracle("q_verify_names", """
SELECT lpad(CAST(s_suppkey AS varchar), 10, '0') AS cik, 'S' || CAST(s_suppkey AS varchar) AS ticker, s_name AS registrant_name,
       CASE s_suppkey % 3 WHEN 0 THEN true
            WHEN 1 THEN s_suppkey % 5 <> 0 ELSE false END AS verified_name
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
oracle("q_facts_roundtrip", f"""
SELECT field, count(*) AS n_facts, min(cik) AS first_cik, min(filed) AS first_filed, max(filed) AS last_filed,
       {r('sum(value)', 4, 'total_value')}, stored_as
FROM facts, (VALUES ('parquet'), ('csv')) AS s(stored_as) GROUP BY field, stored_as""", "facts")
oracle("q_param_violations", """
SELECT CAST(scale_id AS varchar) AS subject, position AS item, rule FROM (
 SELECT *, CASE WHEN before > pd_upper THEN 'bounds must increase' WHEN before = pd_upper THEN 'bounds must be unique'
                WHEN is_last AND abs(pd_upper - 1) > 1e-9 THEN 'last bound must be 1' END AS rule FROM (
  SELECT *, lag(pd_upper) OVER w AS before, lead(pd_upper) OVER w IS NULL AS is_last FROM (
   SELECT c_nationkey AS scale_id, c_mktsegment AS position,
          CASE WHEN c_mktsegment = 'MACHINERY' AND count(*) % 2 = 0 THEN 1.0 ELSE CAST(max(floor(abs(c_acctbal) / 100)) AS double) / 100 END AS pd_upper
   FROM customer GROUP BY c_nationkey, c_mktsegment) WINDOW w AS (PARTITION BY scale_id ORDER BY position))) WHERE rule IS NOT NULL
UNION ALL
SELECT 'recovery', 'class_' || CAST(p_partkey AS varchar), rule FROM (
 SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'status must be SOURCED' WHEN p_partkey % 7 = 0 THEN 'citation missing'
   WHEN p_partkey % 4 = 3 AND p_type NOT IN ('trading_price', 'ultimate') THEN 'unknown recovery basis'
   WHEN p_partkey % 11 = 0 OR p_retailprice / 1000 - 0.5 < 0 OR p_retailprice / 1000 - 0.5 > 1 THEN 'recovery outside [0, 1]' END AS rule
 FROM part) WHERE rule IS NOT NULL""")
oracle("q_cik_norm", """
SELECT c_custkey, CASE c_custkey % 6 WHEN 4 THEN '12345678901' || CAST(c_custkey AS varchar)
       WHEN 0 THEN lpad(ltrim(CAST(c_custkey AS varchar), '0'), 10, '0') WHEN 1 THEN lpad(CAST(c_custkey AS varchar), 10, '0') END AS cik
FROM customer""")
view("confirmed", ["filing_rows", "claims"], """
SELECT c.cik, c.default_date, c.verified, count(f.filing_date) AS n_filings,
       coalesce(string_agg(DISTINCT CAST(f.filing_date AS varchar), ', ' ORDER BY CAST(f.filing_date AS varchar)), '') AS dates
FROM claims c LEFT JOIN (SELECT * FROM filing_rows WHERE form = '8-K' AND list_contains(string_split(items, ','), '1.03')) f
  ON f.cik = c.cik AND f.filing_date BETWEEN c.default_date - 1 AND c.default_date + 1 GROUP BY ALL""")
oracle("q_default_confirm", "SELECT cik, default_date, n_filings > 0 AS confirmed, n_filings, dates FROM confirmed", "confirmed")
oracle("q_cohort_summary", """
SELECT count(*) AS issuers, count(default_date) AS defaults, count(*) - count(default_date) AS non_defaults,
       count(*) FILTER (WHERE default_date IS NOT NULL AND verified) AS verified_defaults FROM issuers""", "issuers")
oracle("q_universe_violations", """
SELECT * FROM (SELECT ticker, CASE WHEN issuer_id % 17 <> 5 THEN cik END AS cik, default_date,
  CASE WHEN issuer_id % 17 = 5 THEN 'cik unresolved'
       WHEN default_date IS NOT NULL AND issuer_id % 13 = 9 THEN 'defaulted issuer has no exposure mix'
       WHEN default_date IS NOT NULL AND issuer_id % 13 = 4 AND w_secured < 1 - 1e-6 THEN 'exposure weights do not sum to 1'
       WHEN default_date IS NOT NULL AND NOT verified THEN 'default event unverified' END AS problem
 FROM issuers) WHERE problem IS NOT NULL""", "issuers")
oracle("q_universe_sync", """
SELECT ticker, CASE WHEN ticker IN (SELECT ticker FROM issuers) THEN 'present' ELSE 'missing' END AS status
FROM (SELECT DISTINCT 'S' || CAST(c_custkey * 3 AS varchar) AS ticker FROM customer)""", "issuers")
oracle("q_universe_apply", """
SELECT cik, 'verified' AS field, 'false' AS old, 'true' AS new FROM confirmed WHERE n_filings > 0 AND NOT verified""", "confirmed")
