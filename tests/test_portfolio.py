import re
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from vintagerisk import params as P
from vintagerisk.operators import portfolio


def test_regulatory_reference_weight(spark):
    # the published 92.32 % for PD 1 %, LGD 45 %, 2.5 years
    row = spark.sql("SELECT 0.01D AS pd, 0.45D AS lgd")
    assert portfolio.with_irb(row).first().irb_k * P.RWA_MULTIPLE == pytest.approx(0.9232, abs=0.001)


def test_capital_moves_the_right_way(spark):
    grid = spark.range(60).selectExpr("id", "id DIV 3 AS step", "0.0004D * power(1.4D, id DIV 3) AS pd", "CASE id % 3 WHEN 0 THEN 0.2D WHEN 1 THEN 0.35D ELSE 0.7D END AS lgd", "12D AS sales")
    rows = portfolio.with_irb(grid.where("pd < 0.1").coalesce(1)).orderBy("id").collect()
    k = {(r.step, r.lgd): r.irb_k for r in rows}
    for (step, lgd), value in k.items():
        assert value > 0
        assert (step + 1, lgd) not in k or k[step + 1, lgd] >= value
    assert all(k[s, 0.7] > k[s, 0.35] > k[s, 0.2] for s, _ in k)
    small = {(r.step, r.lgd): r.irb_k for r in portfolio.with_irb(grid.where("pd < 0.1"), sales="sales").collect()}
    assert all(small[x] < k[x] for x in k)


def test_totals_are_sums_over_usable_rows(spark):
    rows = spark.sql("""SELECT * FROM VALUES ('a', 0.02D, 0.35D, 250D), ('a', 0.004D, 0.5D, 75D), ('b', 0.11D, 0.25D, 40D),
        ('b', 0.03D, cast(NULL AS double), 90D), ('b', 0.03D, 0.4D, cast(NULL AS double)), ('c', cast('NaN' AS double), 0.4D, 11D) AS t(unit, pd, lgd, ead)""")
    good = [(0.02, 0.35, 250.0), (0.004, 0.5, 75.0), (0.11, 0.25, 40.0)]
    got = {r.unit: r for r in portfolio.portfolio_totals(rows, by=["unit"]).collect()}
    whole = got[None]
    assert (whole.facilities, whole.refused_facilities, whole.total_ead, whole.refused_ead) == (3, 3, 365.0, 101.0)
    assert whole.expected_loss == pytest.approx(sum(p * g * e for p, g, e in good))
    assert whole.expected_loss_rate == pytest.approx(whole.expected_loss / 365)
    assert whole.exposure_weighted_lgd == pytest.approx(sum(g * e for _, g, e in good) / 365)
    assert got["b"].expected_loss_rate == pytest.approx(0.11 * 0.25) and got["b"].refused_facilities == 2
    assert (got["c"].facilities, got["c"].total_ead, got["c"].expected_loss_rate) == (0, None, None)


def test_formulas_refuse_bad_input(spark):
    row = spark.sql("SELECT 0.3D AS pd, -0.1D AS lgd, 8D AS ead")
    with pytest.raises(Exception, match="PD and LGD"):
        portfolio.portfolio_totals(row).collect()
    with pytest.raises(KeyError):
        portfolio.portfolio_totals(row.drop("ead"))


def test_mix_is_a_weighted_mean_or_refused(spark):
    recovery = {name: (rate, basis) for name, rate, basis, _ in P.RECOVERY_CLASSES}
    by_basis = {}
    for name, (_, basis) in recovery.items():
        by_basis.setdefault(basis, []).append(name)
    (one, two), other = next(v[:2] for v in by_basis.values() if len(v) > 1), None
    other = next(v[0] for b, v in by_basis.items() if b != recovery[one][1])
    rows = spark.sql(f"""SELECT * FROM VALUES (1, map('{one}', 0.7D, '{two}', 0.3D)), (2, map('{one}', 0.7D, '{other}', 0.3D)), (3, map('{one}', 0.9D, 'preferred', 0.1D)),
        (4, map('{one}', 0.7D, '{two}', 0.2D)), (5, map('{one}', 0.7D, '{two}', cast(NULL AS double))), (6, NULL), (7, map('{one}', 0.7D, '{two}', double('NaN'))) AS t(n, exposure)""")
    got = {r.n: r for r in portfolio.mix_lgd(rows, problems=True).collect()}
    assert got[1].lgd == pytest.approx(1 - 0.7 * recovery[one][0] - 0.3 * recovery[two][0]) and got[1].lgd_downturn >= got[1].lgd and got[1].lgd_problem is None
    assert [got[n].lgd_problem for n in range(2, 8)] == [
        "mixed recovery bases", "unknown seniority class", "weights do not sum to 1", "weight missing", "no exposure mix", "weight missing",
    ]
    assert all(got[n].lgd is None for n in range(2, 8))


def test_facility_exposure_or_a_reason(spark):
    rows = spark.sql("""SELECT * FROM VALUES (1, 'revolving_credit_facility', 12D, 30D), (2, 'bond', 55D, 0D), (3, 'leasing', 5D, 5D), (4, 'term_loan', 9D, -2D),
        (5, 'term_loan', NULL, 2D), (6, 'bond', 1D, double('NaN')) AS t(n, instrument, drawn, undrawn)""")
    got = {r.n: (r.ead, r.ead_problem) for r in portfolio.facility_ead(rows).collect()}
    factor = P.CREDIT_CONVERSION["revolving_credit_facility"]
    assert got == {
        1: (12 + 30 * factor, None), 2: (55.0, None), 3: (None, "no conversion factor"), 4: (None, "negative amount"),
        5: (None, "amount missing"), 6: (None, "amount missing"),
    }


def test_bands_are_closed_above(spark):
    edges = [(name, upper) for name, _, upper in P.MASTERSCALE]
    rows = [(upper, name) for name, upper in edges] + [(upper + 1e-7, after) for (_, upper), (after, _) in zip(edges, edges[1:], strict=False)]
    df = spark.createDataFrame([*rows, (None, "unrated"), (float("nan"), "unrated")], "pd double, want string")
    assert df.where(portfolio.grade("pd") != F.col("want")).count() == 0


def test_order_of_grades(spark):
    table = spark.sql("SELECT * FROM VALUES ('A', 40, 0.02D, 0), ('B', 2, 0.5D, 1), ('C', 25, 0.01D, 2), ('D', 30, 0.01D, 3), ('E', 9, 0.2D, 4) AS t(grade, n, observed_default_rate, position)")
    got = {r.grade: (r.status, r.from_grade) for r in portfolio.monotonicity(table).collect()}
    assert got == {"A": ("ok", None), "B": ("excluded_small_n", None), "C": ("violation", "A"), "D": ("ok", "C"), "E": ("ok", "D")}


def test_prior_correction_is_a_shift_of_the_log_odds(spark):
    import math

    rows = spark.range(1, 40).selectExpr("id / 40D AS p").coalesce(1)
    moved = rows.select("p", portfolio.prior_correct("p", "0.3D", "0.04D").alias("q")).collect()
    odds = lambda x: math.log(x / (1 - x))
    assert all(odds(r.q) - odds(r.p) == pytest.approx(odds(0.04) - odds(0.3)) for r in moved)
    with pytest.raises(Exception, match="strictly between"):
        rows.select(portfolio.prior_correct("p", "1D", "0.04D")).collect()


@pytest.mark.parametrize("options", [{"maturity": "years"}, {"maturity": "years", "by": ["unit"]}])
def test_methods_stay_short_enough_to_be_compiled(spark, options, capsys, tmp_path):
    spark.range(100).selectExpr("id % 3 AS unit", "0.001D * id AS pd", "0.4D AS lgd", "5D * id AS ead", "1D + id % 5 AS years").write.parquet(str(tmp_path / "tape"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        portfolio.portfolio_totals(spark.read.parquet(str(tmp_path / "tape")), **options).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(s) for s in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000  # the JVM does not compile longer ones


def test_quantile_and_distribution_of_missing_and_extreme_values(spark):
    from vintagerisk.functions.normal import add_norm_cdf, add_norm_quantile

    rows = spark.sql("SELECT * FROM VALUES (0D), (1D), (0.5D), (cast(NULL AS double)), (1e-12D) AS t(p)")
    got = {r.p: r.g for r in add_norm_quantile(rows, "p", "g").collect()}
    assert got[0.0] is None and got[1.0] is None and got[None] is None and got[0.5] == 0.0
    assert got[1e-12] == pytest.approx(NormalDist().inv_cdf(1e-12), rel=1e-12)
    cdf = {r.p: r.c for r in add_norm_cdf(rows, "p", "c").collect()}
    assert cdf[None] is None and cdf[0.0] == 0.5 and cdf[1.0] == pytest.approx(NormalDist().cdf(1.0), rel=1e-14)
