"""SQL statements of the model queries.

Folds and bootstrap draws repeat the library's integer hash; logistic lines are refitted
by a recursive Newton iteration; isotonic levels come from the max-min formula.  For
the twelve-feature fits the statement checks the first-order conditions.
"""

from __future__ import annotations

from vintagerisk import params as P
from vintagerisk.functions.hashing import MODULUS
from vintagerisk.models.bootstrap import BOUNDS
from vintagerisk.plans import sql_panel, sql_validation  # noqa: F401  (views)
from vintagerisk.plans.reference_sql import oracle, r, view


def mixed(a: str, b: str, seed: int = P.SEED) -> str:
    """Select-list columns h1, h2, h3 of the hash; h3 is the result."""
    m = MODULUS
    return (
        f"((({a}) % {m}) * 40503 + (({b}) % {m}) * 69621 + {seed * 7919 + 12345}) % {m} AS h1, "
        f"(h1 * h1 + (({b}) % {m}) * 104729 + (({a}) % {m}) * 31 + 1) % {m} AS h2, (h2 * h2 + h2 * 48271 + h1) % {m} AS h3"
    )


view("features_long", ["panel"], " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS v FROM panel" for f in P.FEATURES))
view("feature_bounds", ["features_long"], """
SELECT feature, CASE WHEN a < b THEN a END AS low, CASE WHEN a < b THEN b END AS high, med FROM (
SELECT feature, quantile_cont(v, 0.01) AS a, quantile_cont(v, 0.99) AS b, quantile_cont(v, 0.5) AS med FROM features_long GROUP BY feature)""")
view("clipped", ["features_long", "feature_bounds"], """
SELECT l.feature, low, high, v, CASE WHEN v IS NULL THEN NULL WHEN low IS NULL THEN v ELSE greatest(low, least(high, v)) END AS c,
       CASE WHEN low IS NULL THEN med ELSE greatest(low, least(high, med)) END AS med
FROM features_long l JOIN feature_bounds USING (feature)""")
oracle("q_winsorise", f"""
SELECT feature, {r('low')}, {r('high')}, count(v) AS n, count(*) FILTER (WHERE c <> v) AS n_clipped, {r('avg(c)', 6, 'mean_clipped')}
FROM clipped GROUP BY feature, low, high""", "clipped")
oracle("q_preprocess", f"""
SELECT feature, {r('max(med)', 6, 'median')}, {r('avg(coalesce(c, med))', 6, 'mean')},
       {r('CASE WHEN stddev_pop(coalesce(c, med)) < 1e-10 THEN 1 ELSE stddev_pop(coalesce(c, med)) END', 6, 'deviation')}, count(*) AS n_rows
FROM clipped GROUP BY feature""", "clipped")
oracle("q_design_columns", f"SELECT ticker, as_of, label, {', '.join(r(f, 6, f) for f in P.FEATURES)} FROM panel", "panel")
oracle("q_class_weights", f"""
SELECT y, n, {r('(SELECT count(*) FROM scored) / (2.0 * n)', 9, 'weight')} FROM (SELECT y, count(*) AS n FROM scored GROUP BY y)""", "scored")
oracle("q_risk_score", f"SELECT ticker, as_of, {r('-coalesce(z2, (SELECT median(z2) FROM panel))', 6, 'risk_score')} FROM panel", "panel")
TERMS = ", ".join(f"('{t}')" for t in ["intercept", *P.FEATURES])
oracle("q_logit_foc", f"SELECT term, (SELECT count(*) FROM panel) AS n_train, true AS at_optimum FROM (VALUES {TERMS}) AS t(term)", "panel")

view("strata", ["panel"], "SELECT ticker, CAST(cik AS bigint) AS group_id, max(label) AS stratum FROM panel GROUP BY ticker, cik")
view("dealt", ["strata"], f"""
SELECT group_id, ticker, repeat, CAST((row_number() OVER (PARTITION BY repeat, stratum ORDER BY h3, group_id) - 1) % 5 AS int) AS fold
FROM (SELECT *, {mixed('group_id', 'repeat + 1')} FROM strata, (SELECT CAST(unnest(range(0, {P.CV_REPEATS})) AS int) AS repeat))""")
oracle("q_group_folds", "SELECT group_id, repeat, fold FROM dealt", "dealt")
oracle("q_fold_leakage", """
SELECT d.repeat, d.fold, count(*) AS n_test, CAST(sum(label) AS bigint) AS positives, count(DISTINCT d.ticker) AS issuers,
       CAST(0 AS bigint) AS leaked_issuers
FROM panel p JOIN dealt d USING (ticker) GROUP BY d.repeat, d.fold""", "panel", "dealt")
oracle("q_oof_pd", f"SELECT ticker, as_of, label AS y, CAST({P.CV_REPEATS} AS bigint) AS n_models, true AS in_range FROM panel", "panel")
oracle("q_loio_pd", "SELECT ticker, as_of, label AS y, CAST(1 AS bigint) AS n_models, true AS in_range FROM panel", "panel")
oracle("q_out_of_time", "SELECT ticker, as_of, label AS y, true AS in_range FROM panel WHERE year(as_of) >= 2000", "panel")

view("picks", ["scored"], f"""
SELECT b, grp, {' + '.join(f'CAST(h3 >= {bound} AS int)' for bound in BOUNDS)} AS w FROM (
 SELECT b, grp, {mixed('b', 'grp')} FROM (SELECT unnest(range(0, {P.BOOTSTRAP_DRAWS})) AS b), (SELECT DISTINCT grp FROM scored))""")
view("scored_two", ["scored"], "SELECT *, -abs(p - 0.2) AS p2 FROM scored")


# q_bootstrap_auc picks as many groups as there are, with replacement
view("groups", ["scored"], "SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS gi, count(*) OVER () AS g FROM (SELECT DISTINCT grp FROM scored)")
view("slots", ["groups"], f"""
SELECT b, gi, count(*) AS w FROM (
 SELECT b, h3 % g AS gi FROM (SELECT b, k, g, {mixed('b', 'k')} FROM (SELECT unnest(range(0, {P.BOOTSTRAP_DRAWS})) AS b),
  (SELECT g, unnest(range(0, g)) AS k FROM (SELECT max(g) AS g FROM groups)))) GROUP BY b, gi""")
view("resamples", ["slots", "groups"], "SELECT b, grp, w FROM slots JOIN groups USING (gi)")


def draws(score: str, picks: str = "picks") -> str:
    return f"""
SELECT b, sum(wp * (below + 0.5*wn)) / (CAST(sum(wp) AS double) * sum(wn)) AS auc FROM (
 SELECT *, sum(wn) OVER (PARTITION BY b ORDER BY s) - wn AS below FROM (
  SELECT b, s, CAST(sum(w*pos) AS double) AS wp, CAST(sum(w*neg) AS double) AS wn FROM (
   SELECT grp, {score} AS s, sum(y) AS pos, sum(1 - y) AS neg FROM scored_two GROUP BY grp, s) JOIN {picks} USING (grp)
  GROUP BY b, s)) GROUP BY b"""


def point(score: str) -> str:
    return f"""(SELECT sum(pos * (below + 0.5*neg)) / (CAST(sum(pos) AS double) * sum(neg)) FROM (
 SELECT *, sum(neg) OVER (ORDER BY s) - neg AS below FROM (SELECT {score} AS s, sum(y) AS pos, sum(1 - y) AS neg FROM scored_two GROUP BY s)))"""


view("draws_one", ["picks", "scored_two"], draws("p"))
view("draws_two", ["picks", "scored_two"], draws("p2"))
view("draws_resampled", ["resamples", "scored_two"], draws("p", "resamples"))
oracle("q_bootstrap_auc", f"""
SELECT {r(point('p'), 8, 'auc')}, {r('quantile_cont(auc, 0.025)', 8, 'lower')}, {r('quantile_cont(auc, 0.975)', 8, 'upper')}, count(*) AS n_draws
FROM draws_resampled""", "draws_resampled")
oracle("q_paired_auc", f"""
SELECT {r('d', 8, 'difference')}, {r('lo', 8, 'lower')}, {r('hi', 8, 'upper')}, n AS n_draws, lo > 0 OR hi < 0 AS significant,
       CASE WHEN lo > 0 OR hi < 0 THEN CASE WHEN d > 0 THEN 'first beats second' ELSE 'second beats first' END
            ELSE 'no distinguishable difference' END AS verdict
FROM (SELECT {point('p')} - {point('p2')} AS d, quantile_cont(x.auc - y.auc, 0.025) AS lo, quantile_cont(x.auc - y.auc, 0.975) AS hi, count(*) AS n
      FROM draws_one x JOIN draws_two y USING (b))""", "draws_one", "draws_two")

CLIPPED = "greatest(1e-9, least(1 - 1e-9, p))"
view("logits", ["scored"], f"""
SELECT grp, ln({CLIPPED} / (1 - {CLIPPED})) AS x, count(*) AS n, sum(y) AS k FROM scored GROUP BY grp, p""")


def newton(ridge: float, model: str, train: str, steps: int = 25) -> str:
    """Recursive Newton iteration of the line, one row per model and step."""
    return f"""
SELECT {model} AS m, 0 AS i, 0.0::double AS a, 1.0::double AS b
UNION ALL
SELECT m, i + 1, a - (h11*g0 - h01*g1)/(h00*h11 - h01*h01), b - (h00*g1 - h01*g0)/(h00*h11 - h01*h01) FROM (
 SELECT t.m, t.i, t.a, t.b, sum(n*q - k) AS g0, sum((n*q - k)*x) + {ridge}*t.b AS g1, sum(n*q*(1 - q)) AS h00,
        sum(n*q*(1 - q)*x) AS h01, sum(n*q*(1 - q)*x*x) + {ridge} AS h11
 FROM (SELECT lines.m, lines.i, lines.a, lines.b, l.n, l.k, l.x, 1/(1 + exp(-(lines.a + lines.b*l.x))) AS q
       FROM lines, {train}) t GROUP BY t.m, t.i, t.a, t.b) WHERE i < {steps}"""


def line_oracle(name: str, ridge: float) -> None:
    view(f"lines_{name}", ["logits"], newton(ridge, "0", "logits l").replace("lines", f"lines_{name}"))
    oracle(name, f"""
SELECT {r('a', 6, 'intercept')}, {r('b', 6, 'slope')}, (SELECT count(*) FROM scored) AS n, (SELECT CAST(sum(y) AS bigint) FROM scored) AS positives
FROM lines_{name} WHERE i = (SELECT max(i) FROM lines_{name})""", f"lines_{name}", "scored")


line_oracle("q_platt_foc", 1.0 / P.LOGIT_C)
line_oracle("q_calibration_slope", 0.0)
view("score_strata", ["scored"], "SELECT grp, max(y) AS stratum FROM scored GROUP BY grp")
view("score_folds", ["score_strata"], f"""
SELECT grp, CAST((row_number() OVER (PARTITION BY stratum ORDER BY h3, grp) - 1) % 5 AS int) AS fold
FROM (SELECT *, {mixed('grp', '1')} FROM score_strata)""")
view("fold_logits", ["logits", "score_folds"], "SELECT fold, x, sum(n) AS n, sum(k) AS k FROM logits JOIN score_folds USING (grp) GROUP BY fold, x")
view("lines_cross", ["fold_logits"], newton(
    1.0 / P.LOGIT_C, "unnest(range(0, 5))", "fold_logits l WHERE l.fold <> lines.m").replace("lines", "lines_cross"))
# isotonic levels for the whole (-1) and without each fold: stretches of falling rates are pooled a few times, and
# what remains goes through the max-min formula
view("level_counts", ["scored", "score_folds"], f"""
SELECT m, CASE WHEN m = -1 THEN p ELSE {CLIPPED} END AS p, count(*) AS n, CAST(sum(y) AS double) AS k
FROM scored JOIN score_folds USING (grp), (SELECT unnest(range(-1, 5)) AS m) WHERE fold <> m GROUP BY 1, 2""")
view("pooled_0", ["level_counts"], "SELECT m, p AS lo, n, k FROM level_counts")
ROUNDS = 6
for step in range(1, ROUNDS + 1):
    view(f"pooled_{step}", [f"pooled_{step - 1}"], f"""
SELECT m, min(lo) AS lo, sum(n) AS n, sum(k) AS k FROM (
 SELECT *, sum(rise) OVER (PARTITION BY m ORDER BY lo) AS stretch FROM (
  SELECT *, CASE WHEN k / n > lag(k / n) OVER (PARTITION BY m ORDER BY lo) THEN 1 ELSE 0 END AS rise FROM pooled_{step - 1})) GROUP BY m, stretch""")
view("stretches", [f"pooled_{ROUNDS}"], f"""
SELECT m, lo, n, k, row_number() OVER w AS i, sum(n) OVER w AS s, sum(k) OVER w AS t FROM pooled_{ROUNDS} WINDOW w AS (PARTITION BY m ORDER BY lo)""")
view("stretch_rates", ["stretches"], """
SELECT m, b AS i, max(least_rate) AS rate FROM (
 SELECT m, a, b, min(slope) OVER (PARTITION BY m, a ORDER BY b DESC) AS least_rate FROM (
  SELECT x.m, x.i AS a, z.i AS b, (z.t - (x.t - x.k)) / (z.s - (x.s - x.n)) AS slope FROM stretches x JOIN stretches z ON z.m = x.m AND z.i >= x.i)) GROUP BY m, b""")
view("isotonic_levels", ["level_counts", "stretches", "stretch_rates"], """
SELECT m, p, n, rate, lead(p) OVER (PARTITION BY m ORDER BY p) AS next_p, lead(rate) OVER (PARTITION BY m ORDER BY p) AS next_rate FROM (
 SELECT l.m, l.p, l.n, q.rate FROM level_counts l ASOF JOIN stretches b ON l.m = b.m AND l.p >= b.lo JOIN stretch_rates q ON q.m = b.m AND q.i = b.i)""")
view("isotonic_held_out", ["isotonic_levels", "scored", "score_folds"], f"""
SELECT f.fold, s.y, CASE WHEN l.p IS NULL THEN (SELECT arg_min(rate, p) FROM isotonic_levels WHERE m = f.fold) WHEN l.next_p IS NULL OR s.p = l.p THEN l.rate
       ELSE l.rate + (l.next_rate - l.rate) * (s.p - l.p) / (l.next_p - l.p) END AS c
FROM (SELECT grp, y, {CLIPPED} AS p FROM scored) s JOIN score_folds f USING (grp) ASOF LEFT JOIN isotonic_levels l ON l.m = f.fold AND s.p >= l.p""")
view("platt_held_out", ["scored", "score_folds", "lines_cross"], f"""
SELECT f.fold, s.y, 1/(1 + exp(-(a + b*ln({CLIPPED} / (1 - {CLIPPED}))))) AS c
FROM scored s JOIN score_folds f USING (grp) JOIN lines_cross l ON l.m = f.fold AND l.i = 25""")
oracle("q_crossfit_calibration", f"""
SELECT fold, method, count(*) AS n, CAST(sum(y) AS bigint) AS defaults, {r('avg(c)', 6, 'mean_calibrated')}, {r('max(c)', 6, 'max_calibrated')}, {r('avg(c * c)', 6, 'mean_square')}
FROM (SELECT fold, y, greatest(1e-9, least(1 - 1e-9, c)) AS c, 'platt' AS method FROM platt_held_out
      UNION ALL SELECT fold, y, greatest(1e-9, least(1 - 1e-9, c)), 'isotonic' FROM isotonic_held_out) GROUP BY fold, method""", "platt_held_out", "isotonic_held_out")
oracle("q_isotonic", f"SELECT {r('p', 12, 'p')}, n, {r('rate', 8, 'isotonic')} FROM isotonic_levels WHERE m = -1", "isotonic_levels")
