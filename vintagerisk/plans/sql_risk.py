"""SQL statements of the loss and capital queries.

The normal CDF is its Taylor series and the quantiles of the nine PDs on the tape come
from the Python standard library, so neither repeats the column formulas under test.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from vintagerisk import params as P
from vintagerisk.plans import sql_panel, sql_validation  # noqa: F401  (views)
from vintagerisk.plans.reference_sql import oracle, r, view
from vintagerisk.plans.sql_validation import grade_sql

_pds = [max(i / 100 / 4 + 0.0002, P.IRB_PD_FLOOR) for i in range(9)]
_quantiles = ", ".join(f"({i}, {NormalDist().inv_cdf(p)!r}::double)" for i, p in enumerate(_pds))
WORST = repr(NormalDist().inv_cdf(P.IRB_CONFIDENCE))


def lgd_sql(recovery: float) -> float:
    return max(P.LGD_FLOOR, min(P.LGD_CAP, 1 - recovery))


RECOVERY = {name: mean for name, mean, _, _ in P.RECOVERY_CLASSES}
LGD = {name: lgd_sql(x) for name, x in RECOVERY.items()}
DOWN = {name: lgd_sql(max(0.0, x - P.DOWNTURN_HAIRCUT)) for name, x in RECOVERY.items()}
HARD = {name: lgd_sql(max(0.0, x - P.DISTRESS_HAIRCUT) if name in P.DISTRESS_CLASSES else x) for name, x in RECOVERY.items()}

view("loans", [], """
SELECT l_orderkey*8 + l_linenumber AS facility_id, CAST(round(l_tax*100) AS int) AS tax_step,
       CASE l_returnflag WHEN 'R' THEN 'revolving_credit_facility' WHEN 'A' THEN 'term_loan' ELSE 'bond' END AS instrument,
       l_extendedprice AS drawn, l_extendedprice*l_discount*5 AS undrawn, 1 + l_quantity/12.5 AS maturity_years,
       l_tax/4 + 0.0002 AS pd, o_totalprice/5000 AS sales, c_mktsegment AS sector
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""")
view("rated", ["loans"], f"""
SELECT *, drawn + CASE instrument WHEN 'revolving_credit_facility' THEN 0.75 ELSE 1.0 END * undrawn AS ead,
       (facility_id % 10)/10.0 * {LGD['senior_secured']} + (1 - (facility_id % 10)/10.0) * {LGD['senior_unsecured']} AS lgd FROM loans""")
oracle("q_expected_loss", f"""
SELECT sector, instrument, count(*) AS facilities, {r('sum(ead)', 1, 'ead')}, {r('sum(pd*lgd*ead)', 2, 'expected_loss')},
       {r('max(pd*lgd*ead)', 3, 'largest')} FROM rated GROUP BY sector, instrument""", "rated")
view("irb_parts", ["rated"], f"""
SELECT *, corr0 - 0.04*(1 - (least(greatest(sales, 5), 50) - 5)/45) AS corr1 FROM (
SELECT *, 0.12*w + 0.24*(1 - w) AS corr0, (0.11852 - 0.05478*ln(fpd))*(0.11852 - 0.05478*ln(fpd)) AS b FROM (
SELECT *, (1 - exp(-50*fpd)) / (1 - exp(-50.0)) AS w FROM (SELECT *, greatest(pd, 0.0003) AS fpd FROM rated)))""")
oracle("q_irb_parts", f"""
SELECT facility_id, {r('corr0', 8, 'correlation')}, {r('corr1', 8, 'size_adjusted')}, {r('b', 8, 'maturity_adjustment')} FROM irb_parts""", "irb_parts")
SERIES = f"""0.5 + list_sum(list_transform(range(0, 34), lambda k: CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * pow(x, 2*k + 1)
 / (pow(2, k) * CAST(factorial(CAST(k AS int)) AS double) * (2*k + 1)))) / {math.sqrt(2 * math.pi)!r}"""
view("capital", ["irb_parts"], f"""
SELECT *, greatest(0, (lgd*n1 - fpd*lgd) * (1 + (maturity_years - 2.5)*b) / (1 - 1.5*b)) AS k1,
          greatest(0, (lgd*n0 - fpd*lgd) * (1 + (maturity_years - 2.5)*b) / (1 - 1.5*b)) AS k0 FROM (
SELECT * EXCLUDE (x), {SERIES} AS n0 FROM (
 SELECT * EXCLUDE (x), g/sqrt(1 - corr0) + sqrt(corr0/(1 - corr0))*{WORST} AS x, n1 FROM (
  SELECT *, {SERIES} AS n1 FROM (
   SELECT p.*, q.g, g/sqrt(1 - corr1) + sqrt(corr1/(1 - corr1))*{WORST} AS x
   FROM irb_parts p JOIN (VALUES {_quantiles}) AS q(step, g) ON p.tax_step = q.step))))""")
oracle("q_irb_capital", f"""
SELECT facility_id, {r('n1', 8, 'irb_conditional_pd')}, {r('k1', 8, 'irb_k')}, {r('k1*12.5*ead', 4, 'rwa')} FROM capital""", "capital")
oracle("q_facility_ead", f"""
SELECT instrument, ead_problem, count(*) AS facilities, {r('sum(drawn)', 2, 'drawn')}, {r('sum(undrawn)', 3, 'undrawn')},
       {r('sum(CASE WHEN drawn >= 0 THEN drawn + ccf*undrawn END)', 3, 'ead')}
FROM (SELECT *, CASE WHEN drawn < 0 THEN 'negative amount' WHEN ccf IS NULL THEN 'no conversion factor' END AS ead_problem FROM (
 SELECT *, CASE instrument WHEN 'revolving_credit_facility' THEN 0.75 WHEN 'term_loan' THEN 1.0 WHEN 'bond' THEN 1.0 END AS ccf FROM (
 SELECT CASE WHEN facility_id % 50 = 0 THEN 'guarantee' ELSE instrument END AS instrument,
        CASE WHEN facility_id % 41 = 0 THEN -drawn ELSE drawn END AS drawn, undrawn FROM loans)))
GROUP BY instrument, ead_problem""", "loans")
oracle("q_ead_proxy", f"""
SELECT cik, as_of, {r('coalesce(long_term_debt, 0) + coalesce(current_debt, 0)', 4, 'ead')} FROM snaps_gaps""", "snaps_gaps")


def own_mix(lgd: dict) -> str:
    return f"w_secured*{lgd['senior_secured']!r} + (1 - w_secured)*{lgd['senior_unsecured']!r}"


def mix_case(lgd: dict) -> str:
    return (f"CASE issuer_id % 7 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL "
            f"WHEN 3 THEN 0.3*{lgd['senior_subordinated']!r} + 0.7*{lgd['subordinated']!r} WHEN 4 THEN {lgd['bank_loan_secured']!r} ELSE {own_mix(lgd)} END")


oracle("q_lgd", f"""
SELECT ticker, CASE issuer_id % 7 WHEN 0 THEN 'weights do not sum to 1' WHEN 1 THEN 'mixed recovery bases' WHEN 2 THEN 'unknown seniority class'
         WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE CASE WHEN w_secured IS NULL THEN 'no exposure mix' END END AS lgd_problem,
       {r(mix_case(LGD), 6, 'lgd')}, {r(mix_case(DOWN), 6, 'lgd_downturn')}, {r(mix_case(HARD), 6, 'lgd_distressed')} FROM issuers""", "issuers")
view("o_predictions", ["ohlson", "issuers"], f"""
SELECT o.ticker, o.name, o.sector, o.as_of, o.label, o.total_debt, o.o_pd AS pd, {grade_sql('o.o_pd')} AS grade, i.w_secured
FROM ohlson o JOIN issuers i USING (ticker) WHERE o.o IS NOT NULL""")


def exposures(chosen: str) -> str:
    median = f"(SELECT median(total_debt) FROM {chosen} WHERE total_debt > 0)"
    return f"""
SELECT ticker, name, sector, as_of, {r('pd', 8)},
  {r(f"CASE WHEN w_secured IS NULL THEN 0.5*{LGD['senior_secured']} + 0.5*{LGD['senior_unsecured']} ELSE {own_mix(LGD)} END", 6, 'lgd')},
  {r(f"CASE WHEN w_secured IS NULL THEN 0.5*{DOWN['senior_secured']} + 0.5*{DOWN['senior_unsecured']} ELSE {own_mix(DOWN)} END", 6, 'lgd_downturn')},
  {r(f"coalesce(CASE WHEN total_debt > 0 THEN total_debt END, {median}, 1)", 4, 'ead')},
  'proxy: reported debt, fully drawn' AS ead_basis,
  CASE WHEN w_secured IS NULL THEN 'default 50/50 secured/unsecured' ELSE 'issuer mix' END AS lgd_mix_basis, grade, label AS defaulted_within_12m
FROM {chosen}"""


view("o_latest", ["o_predictions"], """
SELECT ticker, max(as_of) AS as_of, arg_max(name, as_of) AS name, arg_max(sector, as_of) AS sector, arg_max(label, as_of) AS label,
       arg_max(total_debt, as_of) FILTER (WHERE total_debt IS NOT NULL) AS total_debt, arg_max(pd, as_of) AS pd, arg_max(grade, as_of) AS grade,
       max(w_secured) AS w_secured FROM o_predictions GROUP BY ticker""")
view("o_section", ["o_predictions"], "SELECT * FROM o_predictions WHERE as_of = DATE '1999-06-30'")
oracle("q_exposures", exposures("o_latest"), "o_latest")
oracle("q_cross_section", exposures("o_section"), "o_section")
oracle("q_latest_obs", f"""
SELECT ticker, max(as_of) AS as_of, arg_max(label, as_of) AS label,
       {r('arg_max(total_debt, as_of) FILTER (WHERE total_debt IS NOT NULL)', 4, 'total_debt')},
       {r('arg_max(net_margin, as_of) FILTER (WHERE net_margin IS NOT NULL)', 6, 'net_margin')},
       {r('arg_max(wc_ta, as_of) FILTER (WHERE wc_ta IS NOT NULL)', 6, 'wc_ta')} FROM panel GROUP BY ticker""", "panel")
oracle("q_portfolio", f"""
SELECT sector, count(*) AS facilities, {r('sum(ead)', 2, 'total_ead')}, {r('sum(pd*lgd*ead)', 2, 'expected_loss')},
       {r('sum(pd*lgd*ead)/sum(ead)', 8, 'expected_loss_rate')}, {r('sum(k0*ead)', 2, 'capital_requirement')}, {r('sum(k0*ead)*12.5', 2, 'rwa')},
       {r('sum(pd*ead)/sum(ead)', 8, 'exposure_weighted_pd')}, {r('sum(lgd*ead)/sum(ead)', 8, 'exposure_weighted_lgd')}
FROM capital GROUP BY ROLLUP (sector)""", "capital")
