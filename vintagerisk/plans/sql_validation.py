"""SQL statements of the validation queries."""

from __future__ import annotations

from vintagerisk import params as P
from vintagerisk.plans.reference_sql import oracle, r, view

view("scored", [], """
SELECT *, CASE WHEN u < p THEN 1 ELSE 0 END AS y FROM (
SELECT o_orderkey AS id, o_custkey % 200 AS grp, CAST(year(o_orderdate) AS int) AS yr,
       pow((((o_orderkey*7919 + 17) % 10007) + 0.5) / 10007.0, 3) * 0.6 AS p,
       ((((o_orderkey*o_orderkey) % 1000003)*31 + o_custkey*104729 + 5) % 10009) / 10009.0 AS u FROM orders)""")
view("ladder", ["scored"], """
SELECT *, sum(pos) OVER (ORDER BY p) - pos AS pos_before, sum(neg) OVER (ORDER BY p) - neg AS neg_before,
       sum(pos) OVER () AS np, sum(neg) OVER () AS nn
FROM (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY p)""")
oracle("q_auc", f"""
SELECT CAST(np AS bigint) AS n_pos, CAST(nn AS bigint) AS n_neg, {r('a', 9, 'auc')}, {r('2*a - 1', 9, 'gini')} FROM (
SELECT max(np) AS np, max(nn) AS nn, CAST(sum(pos * (neg_before + 0.5*neg)) AS double) / (CAST(max(np) AS double) * max(nn)) AS a FROM ladder)""", "ladder")
oracle("q_ks", f"""
SELECT {r('max(abs((pos_before + pos) / CAST(np AS double) - (neg_before + neg) / CAST(nn AS double)))', 9, 'ks')} FROM ladder""", "ladder")
oracle("q_roc_points", f"""
SELECT {r('p', 9, 'threshold')}, {r('(nn - neg_before) / CAST(nn AS double)', 9, 'fpr')}, {r('(np - pos_before) / CAST(np AS double)', 9, 'tpr')} FROM ladder
UNION ALL SELECT NULL, 0.0, 0.0""", "ladder")
EDGES = "[" + ", ".join(repr(i * 0.1) + "::double" for i in range(1, 10)) + "]"
oracle("q_brier", f"""
SELECT {r('(SELECT avg((p - y)*(p - y)) FROM scored)', 9, 'brier')}, {r('sum(n*(pb - ob)*(pb - ob)) / sum(n)', 9, 'reliability')},
       {r('sum(n*(ob - base)*(ob - base)) / sum(n)', 9, 'resolution')}, {r('max(base*(1 - base))', 9, 'uncertainty')}
FROM (SELECT count(*) AS n, avg(p) AS pb, avg(y) AS ob, (SELECT avg(y) FROM scored) AS base
      FROM (SELECT *, len(list_filter({EDGES}, lambda e: e <= p)) AS bin FROM scored) GROUP BY bin)""", "scored")
view("tenths", ["scored"], """
SELECT b, count(*) AS n, sum(p) AS e, sum(y) AS o FROM (SELECT *, ntile(10) OVER (ORDER BY p, id) AS b FROM scored) GROUP BY b""")
# eight degrees of freedom: the survival function is a finite sum
oracle("q_hosmer_lemeshow", f"""
SELECT {r('s', 6, 'statistic')}, CAST(greatest(k - 2, 1) AS int) AS dof,
       {r('exp(-s/2) * (1 + s/2 + (s/2)*(s/2)/2 + (s/2)*(s/2)*(s/2)/6)', 8, 'p_value')}
FROM (SELECT sum((o - e)*(o - e) / (e*(1 - e/n))) AS s, count(*) AS k FROM tenths WHERE e*(1 - e/n) > 1e-9)""", "tenths")
oracle("q_reliability", f"""
SELECT CAST(b AS int) AS bucket, count(*) AS n, {r('avg(p)', 9, 'mean_predicted_pd')}, {r('avg(y)', 9, 'observed_default_rate')},
       CAST(sum(y) AS bigint) AS observed_defaults, scores
FROM (SELECT p, y, 'fine' AS scores, ntile(5) OVER (ORDER BY p, id) AS b FROM scored
      UNION ALL SELECT round(p, 1), y, 'tied', ntile(5) OVER (ORDER BY round(p, 1), id) FROM scored) GROUP BY b, scores""", "scored")
oracle("q_annual_backtest", f"""
SELECT yr AS year, count(*) AS issuers, {r('sum(p)', 2, 'expected_defaults')}, CAST(sum(y) AS bigint) AS realised_defaults,
       {r('(sum(y) - sum(p)) / sqrt(sum(p*(1 - p)))', 2, 'z')} FROM scored GROUP BY yr""", "scored")


def corrected(rate: str, tau: str) -> str:
    odds = f"(p / (1 - p) * ({tau} / (1 - {tau})) * ((1 - {rate}) / {rate}))"
    return f"{odds} / (1 + {odds})"


view("base_rate", ["scored"], "SELECT avg(y) AS rate FROM scored")
oracle("q_prior_correct", f"SELECT id, {r(corrected('rate', '0.02'), 9, 'pd')} FROM scored, base_rate", "scored", "base_rate")
oracle("q_pd_sensitivity", f"""
SELECT CAST(tau AS double) AS population_rate, {r('avg(' + corrected('rate', 'tau') + ')', 9, 'mean_pd')},
       {r('max(' + corrected('rate', 'tau') + ')', 9, 'max_pd')}
FROM scored, base_rate, (SELECT unnest([0.01::double, 0.02::double, 0.03::double]) AS tau) GROUP BY tau""", "scored", "base_rate")
view("psi_long", [], " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {f} AS v, year(l_shipdate) >= 1998 AS late FROM lineitem" for f in ("l_quantity", "l_discount", "l_extendedprice")))
PROBS = "[" + ", ".join(repr(i * 0.1) for i in range(10)) + ", 1.0]"
view("psi_edges", ["psi_long"], f"""
SELECT feature, list_sort(list_distinct(quantile_cont(v, {PROBS}))) AS edges FROM psi_long WHERE NOT late GROUP BY feature""")
view("psi_buckets", ["psi_edges"], "SELECT feature, unnest(range(0, len(edges) - 1)) AS b FROM psi_edges")
view("psi_counts", ["psi_long", "psi_edges"], """
SELECT l.feature, len(list_filter(edges[2:len(edges) - 1], lambda e: e <= v)) AS b,
       count(*) FILTER (WHERE NOT late) AS early, count(*) FILTER (WHERE late) AS late
FROM psi_long l JOIN psi_edges USING (feature) GROUP BY 1, 2""")
view("psi_values", ["psi_buckets", "psi_counts"], """
SELECT feature, sum((a - e) * ln(a / e)) AS psi FROM (
 SELECT feature, greatest(coalesce(early, 0) / CAST(sum(early) OVER (PARTITION BY feature) AS double), 1e-6) AS e,
        greatest(coalesce(late, 0) / CAST(sum(late) OVER (PARTITION BY feature) AS double), 1e-6) AS a
 FROM psi_buckets LEFT JOIN psi_counts USING (feature, b)) GROUP BY feature""")
oracle("q_psi", f"""
SELECT feature, {r('psi', 9)}, CASE WHEN psi < 0.10 THEN 'stable' WHEN psi < 0.25 THEN 'moderate shift' ELSE 'material shift' END AS reading
FROM psi_values""", "psi_values")


def grade_sql(p: str) -> str:
    bands = " ".join(f"WHEN {p} <= {u} THEN '{g}'" for g, _, u in P.MASTERSCALE)
    return f"CASE WHEN {p} IS NULL THEN 'unrated' {bands} ELSE '7' END"


oracle("q_grades", f"SELECT id, {grade_sql('pd')} AS grade FROM (SELECT id, CASE WHEN id % 97 <> 0 THEN p END AS pd FROM scored)", "scored")
LABELS = "CASE grade " + " ".join(f"WHEN '{g}' THEN '{label}'" for g, label, _ in P.MASTERSCALE) + " END"
view("graded", ["scored"], f"""
SELECT grade, count(*) AS n, sum(y) AS d, avg(p) AS mean_pd, avg(y) AS rate FROM (SELECT *, {grade_sql('p')} AS grade FROM scored) GROUP BY grade""")
oracle("q_grade_table", f"""
SELECT grade, n, CAST(d AS bigint) AS observed_defaults, {r('mean_pd', 9)}, {r('rate', 9, 'observed_default_rate')}, {LABELS} AS label FROM graded""", "graded")
view("bent", ["scored"], f"""
SELECT {grade_sql('p')} AS grade, count(*) AS n, avg(CASE WHEN p > 0.003 AND p <= 0.01 THEN 1 - y ELSE y END) AS rate FROM scored GROUP BY 1""")
oracle("q_monotonicity", f"""
SELECT grade, n, {r('rate', 9, 'observed_default_rate')}, from_grade, {r('from_rate', 9)},
       CASE WHEN rate < from_rate - 1e-12 THEN 'violation' ELSE 'ok' END AS status
FROM (SELECT *, lag(grade) OVER (ORDER BY grade) AS from_grade, lag(rate) OVER (ORDER BY grade) AS from_rate FROM bent WHERE n >= 1500)
UNION ALL SELECT grade, n, {r('rate', 9)}, NULL, NULL, 'excluded_small_n' FROM bent WHERE n < 1500""", "bent")
