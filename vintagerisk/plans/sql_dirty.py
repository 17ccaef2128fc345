"""SQL for the queries over tables with missing values."""

from __future__ import annotations

from vintagerisk.plans import sql_risk, sql_validation  # noqa: F401  (their views)
from vintagerisk.plans.reference_sql import oracle, r, view

view("dated", ["facts"], "SELECT *, CASE WHEN day(filed) % 5 <> 0 THEN filed END AS known FROM facts")
view("seen", ["dated", "obs"], """
SELECT f.value, min(g.as_of) AS epoch FROM (SELECT row_number() OVER () AS k, known, value FROM dated) f
JOIN (SELECT DISTINCT as_of FROM obs) g ON g.as_of >= f.known GROUP BY f.k, f.value""")
oracle("q_epochs_dirty", f"""
SELECT epoch, count(*) AS n, {r('sum(value)', 4, 'total')}, form FROM seen, (VALUES ('case'), ('calendar')) AS v(form) GROUP BY epoch, form""", "seen")
oracle("q_source_dirty", f"""
SELECT field, count(*) AS n, count(*) FILTER (month(known) <> 4 AND value IS NOT NULL) AS n_values,
       {r('sum(value) FILTER (month(known) <> 4)', 4, 'total')} FROM dated WHERE known IS NOT NULL GROUP BY field""", "dated")
oracle("q_universe_dirty", """
SELECT * FROM (SELECT ticker, cik, default_date, CASE
    WHEN default_date IS NOT NULL AND issuer_id % 5 = 2 THEN 'exposure weight missing'
    WHEN default_date IS NOT NULL AND (issuer_id % 3 = 1 OR NOT verified) THEN 'default event unverified' END AS problem
 FROM issuers) WHERE problem IS NOT NULL""", "issuers")
view("half_known", ["capital"], "SELECT *, facility_id % 9 <> 0 AND facility_id % 11 <> 0 AS ok FROM capital")
view("half_sums", ["half_known"], """
SELECT sector, count(*) FILTER (ok) AS facilities, sum(ead) FILTER (ok) AS t, sum(pd*lgd*ead) FILTER (ok) AS el, sum(k0*ead) FILTER (ok) AS k,
             sum(pd*ead) FILTER (ok) AS p, sum(lgd*ead) FILTER (ok) AS l, count(*) FILTER (NOT ok) AS refused_facilities,
             coalesce(sum(ead) FILTER (NOT ok AND facility_id % 11 <> 0), 0) AS u FROM half_known GROUP BY ROLLUP (sector)""")
oracle("q_portfolio_dirty", f"""
SELECT sector, facilities, {r('t', 2, 'total_ead')}, {r('el', 2, 'expected_loss')}, {r('el/t', 8, 'expected_loss_rate')}, {r('k', 2, 'capital_requirement')},
       {r('k*12.5', 2, 'rwa')}, {r('p/t', 8, 'exposure_weighted_pd')}, {r('l/t', 8, 'exposure_weighted_lgd')}, refused_facilities, {r('u', 2, 'refused_ead')} FROM half_sums""", "half_sums")
oracle("q_refusals_dirty", """
SELECT ead_problem, lgd_problem, count(*) AS facilities, count(*) FILTER (ead_problem IS NULL) AS with_ead, count(*) FILTER (lgd_problem IS NULL) AS with_lgd
FROM (SELECT CASE WHEN facility_id % 11 = 0 OR facility_id % 7 = 0 THEN 'amount missing' END AS ead_problem,
             CASE WHEN facility_id % 9 = 0 THEN 'weight missing' END AS lgd_problem FROM loans) GROUP BY ALL""", "loans")
view("hundredths", ["scored"], """
SELECT b, count(*) AS n, sum(p) AS e, sum(y) AS o FROM (SELECT *, ntile(100) OVER (ORDER BY p, id) AS b FROM scored) GROUP BY b""")
# an even number of degrees of freedom: the survival function is a sum of Poisson terms
oracle("q_hosmer_lemeshow_wide", f"""
SELECT {r('s', 5, 'statistic')}, CAST(k - 2 AS int) AS dof,
       {r('list_sum(list_transform(range(0, CAST((k - 2) // 2 AS bigint)), lambda j: exp(j*ln(s/2) - s/2 - lgamma(j + 1))))', 7, 'p_value')}
FROM (SELECT sum((o - e)*(o - e) / (e*(1 - e/n))) AS s, count(*) AS k FROM hundredths WHERE e*(1 - e/n) > 1e-9)""", "hundredths")
