import itertools
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vintagerisk.functions.normal import add_norm_cdf, add_norm_quantile
from vintagerisk.operators import calibration_tests as ct
from vintagerisk.operators import discrimination, prefix, stability


@pytest.fixture(scope="module")
def scored_pdf():
    rng = np.random.default_rng(3)
    p = np.round(rng.random(3000) ** 2, 2)
    p[:1000] = 0.25  # a third of the rows share one score
    y = (rng.random(3000) < p).astype(int)
    return pd.DataFrame({"id": rng.permutation(3000), "p": p, "y": y, "grp": rng.integers(0, 30, 3000)})


@pytest.fixture(scope="module")
def scored(spark, scored_pdf):
    return spark.createDataFrame(scored_pdf).repartition(4).persist()


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return (np.sum(pos[:, None] > neg[None, :]) + 0.5 * np.sum(pos[:, None] == neg[None, :])) / (len(pos) * len(neg))


def test_auc_ks_against_all_pairs(scored, scored_pdf):
    y, p = scored_pdf["y"].to_numpy(), scored_pdf["p"].to_numpy()
    got = discrimination.auc(scored).first()
    assert got.auc == pytest.approx(brute_auc(y, p), abs=1e-12) and got.gini == pytest.approx(2 * got.auc - 1)
    levels = np.unique(p)
    ks = max(abs(np.mean(p[y == 1] <= t) - np.mean(p[y == 0] <= t)) for t in levels)
    assert discrimination.ks_statistic(scored).first().ks == pytest.approx(ks, abs=1e-12)


def test_auc_extremes(spark):
    perfect = spark.sql("SELECT * FROM VALUES (0, 0.1D), (0, 0.2D), (1, 0.8D), (1, 0.9D) AS t(y, p)")
    assert discrimination.auc(perfect).first().auc == 1.0 and discrimination.ks_statistic(perfect).first().ks == 1.0
    assert discrimination.auc(perfect.withColumn("y", F.lit(0))).first().auc is None


@pytest.mark.parametrize("k", [5, 7])
def test_equal_count_buckets_with_a_heavy_tie(scored, scored_pdf, k):
    ordered = scored_pdf.sort_values(["p", "id"])
    expected = [(len(c), c["p"].sum(), c["y"].sum()) for c in (ordered.iloc[i] for i in np.array_split(np.arange(len(ordered)), k))]
    got = prefix.equal_count_buckets(scored, k).orderBy("bucket").collect()
    assert [(r.n, r.sum_y) for r in got] == [(n, y) for n, _, y in expected]
    assert [r.sum_p for r in got] == pytest.approx([s for _, s, _ in expected])


def test_fewer_rows_than_buckets(spark):
    few = spark.sql("SELECT * FROM VALUES (1, 0.3D, 0), (2, 0.1D, 1), (3, 0.2D, 0) AS t(id, p, y)")
    assert [(r.bucket, r.n) for r in prefix.equal_count_buckets(few, 5).orderBy("bucket").collect()] == [(1, 1), (2, 1), (3, 1)]


@pytest.mark.parametrize("small, accuracy", [(20000, 10000), (40, 200)])
def test_exact_quantiles_against_numpy(spark, small, accuracy):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"g": np.repeat(["a", "b", "c"], 4000), "v": np.concatenate([rng.normal(size=4000), np.round(rng.random(4000), 1), np.full(4000, 2.0)])})
    frame.loc[::7, "v"] = np.nan
    data = spark.createDataFrame(frame).withColumn("v", F.expr("CASE WHEN NOT isnan(v) THEN v END"))
    probabilities = [0.0, 0.01, 0.3, 0.5, 0.99, 1.0]
    # with tiny limits every group goes through brackets
    got = prefix.exact_quantiles(data, ["g"], "v", probabilities, small=small, accuracy=accuracy).collect()
    assert len(got) == 18
    for r in got:
        values = frame.loc[frame["g"] == r.g, "v"].dropna()
        assert r.quantile == pytest.approx(np.quantile(values, probabilities[r.i]), abs=1e-12)


@pytest.mark.parametrize("n", [3_000, 60_000])
def test_brackets_end_at_a_fixed_size(spark, monkeypatch, n):
    """Values of a wide range, two thirds of them ties: what is left between the ends of a bracket does not grow with the rows."""
    left = []
    narrowed = prefix._narrowed

    def watched(present, keys, state, *rest):
        out = narrowed(present, keys, state, *rest)
        left.append(out)
        return out

    monkeypatch.setattr(prefix, "_narrowed", watched)
    data = spark.range(n).selectExpr("'k' AS g", "CASE WHEN id % 3 = 0 THEN exp(pmod(xxhash64(id), 1000003) / 30000D) WHEN id % 3 = 1 THEN 7D ELSE 3D END AS v")
    values = np.sort(data.toPandas()["v"].to_numpy())
    ranks = sorted({0, 1, n // 3 - 1, n // 2, n - 2, n - 1, *np.searchsorted(values, [3.0, 7.0]).tolist(), *(np.searchsorted(values, [3.0, 7.0], "right") - 1).tolist()})
    wanted = spark.createDataFrame([("k", i, int(r)) for i, r in enumerate(ranks)], "g string, i int, rank long")
    got = {r.i: (r.a, r.b) for r in prefix.order_statistics(data, ["g"], wanted, accuracy=200, small=50).collect()}
    assert got == {i: (values[r], values[r + 1] if r + 1 < n else None) for i, r in enumerate(ranks)}
    assert 1 <= len(left) <= 6
    rows = data.collect()
    for b in left[-1].collect():
        assert sum(b.low < r.v < b.high for r in rows) <= 50


def test_a_poor_proposal_costs_a_pass_only(spark):
    data = spark.range(1000).selectExpr("1 AS g", "cast(id DIV 3 as double) AS v")
    values = [i // 3 for i in range(1000)]
    ends = ((200.0, 201.0), (250.0, 250.0), (0.5, 0.6), (33.0, 300.0))
    asked = [(1, i, rank, 0.0, 333.0, 0, None, True, *e) for i, (rank, e) in enumerate(itertools.product((0, 100, 500, 899, 900, 999), ends))]
    state = spark.createDataFrame(asked, "g int, i int, rank long, low double, high double, base long, above double, open boolean, from_v double, to_v double")
    got = prefix._narrowed(data, ["g"], state, 100, 10).collect()
    assert len(got) == len(asked)
    for b in got:
        assert b.low <= values[b.rank] <= b.high and b.base == sum(v < b.low for v in values)
        assert b.above == min((v for v in values if v > b.high), default=None)


def test_brier_identity(spark):
    rng = np.random.default_rng(3)
    p = rng.random(4000)
    df = spark.createDataFrame(pd.DataFrame({"p": p, "y": (rng.random(4000) < p).astype(int)}))
    d = ct.brier_decomposition(df, n_bins=20).first()
    assert d.brier == pytest.approx(d.reliability - d.resolution + d.uncertainty, abs=0.01)
    assert d.brier == pytest.approx(ct.brier_score(df).first().brier)


def test_chi_square_tail(spark):
    rows = spark.sql("SELECT *, sqrt(x) AS root FROM VALUES (3.841458820694124D, 1), (5.991464547107979D, 2), (7.814727903251179D, 3), (15.507313055865453D, 8), (16.918977604620448D, 9) AS t(x, dof)")
    assert [r.p for r in rows.select(ct.chi2_survival("x", "root", "dof").alias("p")).collect()] == pytest.approx([0.05] * 5, abs=1e-10)


def test_chi_square_tail_of_many_degrees_of_freedom(spark):
    rows = spark.createDataFrame([(float(d), math.sqrt(d), d) for d in (1, 2, 65, 70, 98, 120, 999)] + [(0.0, 0.0, 5), (5000.0, math.sqrt(5000), 98)], "s double, i double, dof int")
    got = [r.p for r in rows.coalesce(1).select(ct.chi2_survival("s", "i", "dof").alias("p")).collect()]

    def tail(x, dof):
        """By Simpson's rule over the density."""
        if x == 0:
            return 1.0
        grid = np.linspace(1e-12, x, 400_001)
        log = (dof / 2 - 1) * np.log(grid) - grid / 2 - dof / 2 * math.log(2) - math.lgamma(dof / 2)
        y = np.exp(log)
        return 1 - (grid[1] - grid[0]) / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())

    assert got[0] == pytest.approx(math.erfc(math.sqrt(0.5)))
    assert got[1:] == pytest.approx([tail(x, d) for x, d in [(2, 2), (65, 65), (70, 70), (98, 98), (120, 120), (999, 999), (0, 5), (5000, 98)]], abs=1e-6)
    assert got[3:6] == pytest.approx([0.4775, 0.4810, 0.4829], abs=5e-4)


def test_normal_functions(spark):
    points = [-9.0, -4.1, -2.3, -0.4, 0.0, 0.3, 1.9, 5.0]
    probabilities = [1e-12, 3e-4, 0.01, 0.07, 0.08, 0.5, 0.93, 0.999]
    df = spark.createDataFrame(list(zip(points, probabilities)), "x double, p double")
    got = add_norm_quantile(add_norm_cdf(df, "x", "c"), "p", "q").collect()
    nd = NormalDist()
    for r in got:
        assert r.c == pytest.approx(nd.cdf(r.x), abs=1e-15) and r.q == pytest.approx(nd.inv_cdf(r.p), abs=1e-12)


def test_psi(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(0, 1, 5000)
    frame = pd.DataFrame({"same": np.r_[a, a], "shifted": np.r_[a, a + 1.5], "flat": 1.0, "empty": np.nan, "late": np.r_[np.zeros(5000), np.ones(5000)] > 0})
    got = {r.feature: r for r in stability.psi_by_feature(spark.createDataFrame(frame), ["same", "shifted", "flat", "empty"], F.col("late")).collect()}
    assert got["same"].psi == pytest.approx(0.0, abs=1e-9) and got["same"].reading == "stable"
    assert got["shifted"].psi > 0.25 and got["shifted"].reading == "material shift"
    assert got["flat"].psi == 0.0 and got["empty"].psi is None and got["empty"].reading == "insufficient data"


def test_annual_backtest(spark):
    rows = spark.sql("SELECT * FROM VALUES (2019, 0.1D, 0), (2019, 0.2D, 1), (2019, 0.3D, 0), (2020, 0.05D, 0), (2020, 0.05D, 0) AS t(yr, p, y)")
    got = {r.year: r for r in ct.annual_backtest(rows, F.col("yr")).collect()}
    assert got[2019].expected_defaults == pytest.approx(0.6) and got[2019].realised_defaults == 1
    assert got[2019].z == pytest.approx(0.4 / math.sqrt(0.09 + 0.16 + 0.21))


def test_hosmer_lemeshow_against_numpy(scored, scored_pdf):
    ordered = scored_pdf.sort_values(["p", "id"])
    stat, used = 0.0, 0
    for i in np.array_split(np.arange(len(ordered)), 10):
        c = ordered.iloc[i]
        e, o = c["p"].sum(), c["y"].sum()
        d = e * (1 - e / len(c))
        if d > 1e-9:
            stat, used = stat + (o - e) ** 2 / d, used + 1
    got = ct.hosmer_lemeshow(scored).first()
    assert got.statistic == pytest.approx(stat) and got.dof == used - 2 and 0 <= got.p_value <= 1


def reads_of(df, capsys):
    df.explain()
    return capsys.readouterr().out


def test_ranks_leave_the_input_behind_after_one_read(spark, scored, tmp_path, capsys):
    scored.write.parquet(str(tmp_path / "scored"))
    stored = spark.read.parquet(str(tmp_path / "scored"))
    for ranked in (discrimination.auc(stored), discrimination.ks_statistic(stored), discrimination.roc_points(stored), prefix.equal_count_buckets(stored, 7)):
        assert "FileScan" not in reads_of(ranked, capsys)  # what is left of the plan starts from the stored ladder


def test_separation_takes_all_figures_from_one_ladder(scored):
    found = discrimination.separation(prefix.score_ladder(scored)).first()
    assert found.auc == discrimination.auc(scored).first().auc and found.gini == 2 * found.auc - 1
    assert found.ks == discrimination.ks_statistic(scored).first().ks


def test_buckets_skip_missing_scores_and_take_empty_tables(spark, scored):
    odd = spark.sql("SELECT cast(NULL AS double) AS p, 1 AS y, 9000001L AS id, cast(NULL AS bigint) AS grp UNION ALL SELECT double('NaN'), 0, 9000002L, NULL")
    both = scored.select("p", "y", "id").unionByName(odd.select("p", "y", "id"))
    want = sorted(prefix.equal_count_buckets(scored, 5).collect())
    assert sorted(prefix.equal_count_buckets(both, 5).collect()) == want
    assert prefix.equal_count_buckets(both.where("false"), 5).count() == 0
    assert discrimination.auc(both.where("false")).first().auc is None
