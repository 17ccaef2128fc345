import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vintagerisk import params as P
from vintagerisk.functions.hashing import mix
from vintagerisk.operators import prefix
from vintagerisk.models import bootstrap, boosting, calibrate, expansion, folds, histogram, left_out, logit, resampling


def make_panel(n_issuers=24, years=6, seed=7):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n_issuers):
        risk = rng.normal()
        for t in range(years):
            x = {f: risk + rng.normal() for f in P.FEATURES}
            x["wc_ta"] = None if rng.random() < 0.2 else x["wc_ta"]
            x["negative_equity"] = 0.0  # a flat column
            rows.append({"ticker": f"T{i}", "cik": str(i + 1).zfill(10), "as_of": dt.date(2010 + t, 6, 30), "label": int(rng.random() < 1 / (1 + np.exp(2 - risk))), **x})
    return pd.DataFrame(rows)


@pytest.fixture(scope="module")
def panel_pdf():
    return make_panel()


@pytest.fixture(scope="module")
def rows(spark, panel_pdf):
    schema = "ticker string, cik string, as_of date, label int, " + ", ".join(f"{f} double" for f in P.FEATURES)
    data = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in panel_pdf.itertuples(index=False)]
    return resampling.training_rows(spark.createDataFrame(data, schema))


def reference_fit(train, test):
    """The whole pipeline written out in NumPy, one model."""
    x, y, z = train[P.FEATURES].to_numpy(float), train["label"].to_numpy(float), test[P.FEATURES].to_numpy(float)
    lo, hi = np.nanquantile(x, 0.01, axis=0), np.nanquantile(x, 0.99, axis=0)
    flat = lo >= hi
    lo[flat], hi[flat] = -np.inf, np.inf
    x, z = np.clip(x, lo, hi), np.clip(z, lo, hi)
    med = np.nanmedian(x, axis=0)
    x, z = np.where(np.isnan(x), med, x), np.where(np.isnan(z), med, z)
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd < 1e-10] = 1
    x, z = np.c_[np.ones(len(x)), (x - mean) / sd], np.c_[np.ones(len(z)), (z - mean) / sd]
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    beta, ridge = np.zeros(x.shape[1]), np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ beta))
        beta -= np.linalg.solve(x.T @ (x * (w * p * (1 - p))[:, None]) + ridge, x.T @ (w * (p - y)) + ridge @ beta)
    return beta, 1 / (1 + np.exp(-z @ beta))


def test_whole_fit_matches_the_written_out_pipeline(rows, panel_pdf):
    fit = resampling.whole_fit(rows)
    beta, _ = reference_fit(panel_pdf, panel_pdf)
    assert fit.beta[0] == pytest.approx(beta, abs=1e-7)
    assert fit.beta[0, 1 + P.FEATURES.index("negative_equity")] == pytest.approx(0, abs=1e-9)


def test_bounds_of_every_training_set_are_the_plain_quantiles(spark):
    """Folds that are alike, one that holds all high values, rows held out of nothing, ties, and a feature without values."""
    rng = np.random.default_rng(11)
    n, names = 3000, ["smooth", "tied", "gaps", "empty"]
    x = np.c_[rng.normal(size=n), rng.integers(0, 4, n), np.where(rng.random(n) < 0.4, np.nan, rng.normal(size=n)), np.full(n, np.nan)]
    hold = np.c_[rng.integers(0, 5, n), np.where(x[:, 0] > 0.4, 2, rng.integers(0, 2, n)), np.full(n, -1)]
    data = [(*(None if np.isnan(v) else float(v) for v in r), 0, h.tolist()) for r, h in zip(x, hold, strict=True)]
    rows = spark.createDataFrame(data, ", ".join(f"{f} double" for f in names) + ", y int, hold array<int>")
    models = [(0, f) for f in range(5)] + [(1, f) for f in range(3)] + [(2, 0)]
    fit = logit.quantile_bounds(rows, names, models)
    for m, (r, f) in enumerate(models):
        own = x[hold[:, r] != f]
        for j in range(3):
            low, middle, high = np.nanquantile(own[:, j], [0.01, 0.5, 0.99])
            assert (fit.low[m, j], fit.high[m, j]) == pytest.approx((low, high), abs=1e-12)
            assert fit.middle[m, j] == pytest.approx(middle, abs=1e-12)
        assert (fit.low[m, 3], fit.middle[m, 3], fit.high[m, 3]) == (-np.inf, 0, np.inf)


@pytest.mark.parametrize("at_once", [0, 5, 100_000])
def test_ranks_among_ties_need_no_rows_and_cells_of_any_size_agree(spark, monkeypatch, at_once):
    rng = np.random.default_rng(5)
    x = np.c_[rng.integers(0, 2, 4000).astype(float), rng.normal(size=4000)]
    hold = np.c_[rng.integers(0, 5, 4000), rng.integers(0, 5, 4000)]
    rows = spark.createDataFrame([(*map(float, v), 0, h.tolist()) for v, h in zip(x, hold, strict=True)], "tied double, smooth double, y int, hold array<int>")
    sent, deal = [], logit._rows_of_cells
    monkeypatch.setattr(logit, "_rows_of_cells", lambda rows, features, edges, cells, *more: [sent.extend(cells), deal(rows, features, edges, cells, *more)][1])
    monkeypatch.setattr(logit, "SORTED_AT_ONCE", at_once)
    models = [(r, f) for r in range(2) for f in range(5)]
    fit = logit.quantile_bounds(rows, ["tied", "smooth"], models)
    assert sent and all(j == 1 for j, _ in sent)
    for m, (r, f) in enumerate(models):
        wanted = np.quantile(x[hold[:, r] != f], [0.01, 0.5, 0.99], axis=0)
        assert (fit.low[m], fit.high[m]) == (pytest.approx([-np.inf if a >= b else a for a, b in zip(wanted[0], wanted[2])], abs=1e-12), pytest.approx(wanted[2], abs=1e-12))
        assert fit.middle[m] == pytest.approx(wanted[1], abs=1e-12)


def test_out_of_fold_matches_per_fold_fits(spark, rows, panel_pdf):
    scored, _ = resampling.grouped_oof(rows, n_folds=3, repeats=2)
    got = scored.toPandas().set_index(["ticker", "as_of"])["raw_pd"]
    dealt = folds.group_folds(rows, 3, 2).toPandas()
    expected = pd.Series(0.0, index=pd.MultiIndex.from_frame(panel_pdf[["ticker", "as_of"]]))
    for _, part in dealt.groupby("repeat"):
        fold = dict(zip(part["group_id"], part["fold"]))
        where = panel_pdf["cik"].astype(int).map(fold)
        for f in range(3):
            test = panel_pdf[where == f]
            expected[list(zip(test["ticker"], test["as_of"]))] += reference_fit(panel_pdf[where != f], test)[1] / 2
    assert got.reindex(expected.index).to_numpy() == pytest.approx(expected.to_numpy(), abs=1e-7)


def test_folds_keep_issuers_whole_and_spread_positives(rows):
    dealt = folds.group_folds(rows, 4, 5)
    per = dealt.groupBy("group_id", "repeat").count()
    assert per.where("count <> 1").count() == 0
    positive = rows.groupBy("group_id").agg(F.max("y").alias("s"))
    spread = dealt.join(positive, "group_id").where("s = 1").groupBy("repeat", "fold").count().toPandas()
    assert (spread.groupby("repeat")["count"].agg(lambda c: c.max() - c.min()) <= 1).all()


@pytest.mark.parametrize("batch", [1000, 10])
def test_leave_one_issuer_out_is_exact(rows, panel_pdf, batch):
    got = resampling.leave_one_issuer_out(rows, batch=batch).toPandas().set_index(["ticker", "as_of"])["raw_pd"]
    for ticker in ("T0", "T5", "T23"):
        test = panel_pdf[panel_pdf["ticker"] == ticker]
        expected = reference_fit(panel_pdf[panel_pdf["ticker"] != ticker], test)[1]
        assert got.loc[list(zip(test["ticker"], test["as_of"]))].to_numpy() == pytest.approx(expected, abs=1e-7)


def test_left_out_fits_share_their_sums(spark, monkeypatch):
    """Ties, gaps, an empty feature and values between two models' bounds; no sum is taken model by model but for the whole fit."""
    rng = np.random.default_rng(4)
    n, names = 1200, ["smooth", "heavy", "tied", "gaps", "empty"]
    x = np.c_[rng.normal(size=n), rng.standard_cauchy(n), rng.integers(0, 4, n), np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n)), np.full(n, np.nan)]
    y = (rng.random(n) < 1 / (1 + np.exp(1 - x[:, 0]))).astype(int)
    issuer = rng.integers(0, 300, n)
    data = [(f"T{g}", int(k), int(g), int(t), *(None if np.isnan(v) else float(v) for v in r)) for k, (g, t, r) in enumerate(zip(issuer, y, x, strict=True))]
    rows = spark.createDataFrame(data, "ticker string, as_of int, group_id long, y int, " + ", ".join(f"{f} double" for f in names))
    expected = {}
    for g in (0, 17, 299):
        held = rows.withColumn("hold", F.array((F.col("group_id") == g).cast("int")))
        scored = logit.out_of_fold(held, logit.fit_models(held, [(0, 1)], names), resampling.KEYS).where("n_models > 0")
        expected |= {r.as_of: r.raw_pd for r in scored.collect()}
    plain, asked = logit._summed, []
    monkeypatch.setattr(logit, "_summed", lambda r, f, models, *rest: asked.append(len(models)) or plain(r, f, models, *rest))
    got = {r.as_of: r.raw_pd for r in resampling.leave_one_issuer_out(rows, batch=200, features=names).collect()}
    assert max(asked) == 1
    assert len(got) == n
    assert [got[k] for k in expected] == pytest.approx(list(expected.values()), abs=1e-9)


def scattered(spark, n, issuers, seed=4):
    rng = np.random.default_rng(seed)
    x = np.c_[rng.normal(size=n), rng.standard_cauchy(n), rng.integers(0, 4, n), np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n)), np.full(n, np.nan)]
    y = (rng.random(n) < 1 / (1 + np.exp(1 - x[:, 0]))).astype(int)
    issuer = rng.integers(0, issuers, n)
    data = [(f"T{g}", int(k), int(g), int(t), *(None if np.isnan(v) else float(v) for v in r)) for k, (g, t, r) in enumerate(zip(issuer, y, x, strict=True))]
    names = ["smooth", "heavy", "tied", "gaps", "empty"]
    return spark.createDataFrame(data, "ticker string, as_of int, group_id long, y int, " + ", ".join(f"{f} double" for f in names)), names


def test_left_out_fits_need_no_pass_per_issuer(spark, monkeypatch):
    """nearly all models come from sums that are taken once over all rows; the others are worked out over all rows."""
    rows, names = scattered(spark, 6000, 2500)
    settle, batches = left_out.settle, []
    monkeypatch.setattr(left_out, "settle", lambda fit, *rest: batches.append(len(fit.models)) or settle(fit, *rest))
    exact = {r.as_of: r for r in resampling.leave_one_issuer_out(rows, features=names, expand_from=10**9).collect()}
    everyone, batches[:] = sum(batches), []
    got = resampling.leave_one_issuer_out(rows, features=names, expand_from=1).collect()
    assert 0 < sum(batches) < everyone / 4
    assert len(got) == len(exact) == 6000 and {r.n_models for r in got} == {1}
    assert [r.raw_pd for r in got] == pytest.approx([exact[r.as_of].raw_pd for r in got], abs=1e-10)


@pytest.mark.parametrize("most_odd", [20_000, 0])
def test_left_out_fits_of_few_issuers_fall_back_to_all_rows(spark, monkeypatch, most_odd):
    """One issuer holds all positives: without it there is no model. With few issuers or many rows between bounds nothing is expanded."""
    monkeypatch.setattr(expansion, "MOST_ODD", most_odd)
    rows, names = scattered(spark, 400, 60)
    rows = rows.withColumn("y", F.when((F.col("group_id") == 7) & (F.col("as_of") % 2 == 0), 1).otherwise(0))
    rows = rows.unionByName(rows.where("group_id = 7").withColumn("as_of", F.col("as_of") + 1000).withColumn("y", F.lit(1)))
    exact = {r.as_of: r for r in resampling.leave_one_issuer_out(rows, features=names, expand_from=10**9).collect()}
    got = resampling.leave_one_issuer_out(rows, features=names, expand_from=1).collect()
    assert len(got) == len(exact) == rows.count()
    assert all((r.raw_pd is None) == (r.n_models == 0) == (r.group_id == 7) for r in got)
    assert [r.raw_pd for r in got if r.n_models] == pytest.approx([exact[r.as_of].raw_pd for r in got if r.n_models], abs=1e-9)


def test_out_of_time(rows, panel_pdf):
    scored, _ = resampling.out_of_time(rows, 2014)
    got = scored.toPandas().set_index(["ticker", "as_of"])["raw_pd"]
    year = panel_pdf["as_of"].map(lambda d: d.year)
    test = panel_pdf[year >= 2014]
    assert len(got) == len(test)
    expected = reference_fit(panel_pdf[year < 2014], test)[1]
    assert got.loc[list(zip(test["ticker"], test["as_of"]))].to_numpy() == pytest.approx(expected, abs=1e-7)


def test_one_class_training_is_skipped(rows):
    first = rows.where("y = 1").select("group_id").first()[0]
    only = rows.withColumn("y", F.when((F.col("group_id") == first) & (F.year("as_of") < 2013), 1).otherwise(0)).withColumn("hold", F.array((F.col("group_id") == first).cast("int")))
    fit = logit.fit_models(only, [(0, 0), (0, 1)])
    assert list(fit.usable) == [True, False]
    scored = logit.out_of_fold(only, fit, resampling.KEYS)
    assert scored.where("raw_pd IS NULL").select("group_id").distinct().collect()[0][0] == first


def resampled_auc(pdf, score, draw):
    """AUC of the rows repeated as their group weighs."""
    w = bootstrap.weights(draw, pdf["grp"].to_numpy(), P.SEED)
    sample = pdf.loc[np.repeat(pdf.index, w)]
    pos, neg = sample.loc[sample["y"] == 1, score].to_numpy(), sample.loc[sample["y"] == 0, score].to_numpy()
    return (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()


@pytest.mark.parametrize("rows_per_range", [1_000_000, 20])
def test_bootstrap_against_plain_resampling(spark, monkeypatch, rows_per_range):
    monkeypatch.setattr(prefix, "ROWS_PER_RANGE", rows_per_range)
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"grp": np.repeat(np.arange(30), 6), "p": np.where(rng.random(180) < 0.4, 0.5, np.round(rng.random(180), 2)), "y": (rng.random(180) < 0.2).astype(int)})
    pdf["q"], pdf["flat"] = -pdf["p"] ** 2, 0.25
    dirty = pd.concat([pdf, pd.DataFrame({"grp": [3, 4], "p": [np.nan] * 2, "q": [np.nan] * 2, "flat": [np.nan] * 2, "y": [1, 0]})])
    df = spark.createDataFrame(dirty)
    draws = {r.draw: r for r in bootstrap.bootstrap_draws(df, ["p", "q", "flat"], draws=40).collect()}
    for b in (0, 7, 39):
        picks = spark.createDataFrame([(g,) for g in range(30)], "g long").select("g", mix(F.lit(b), F.col("g"), P.SEED).alias("h")).collect()
        assert [sum(r.h >= x for x in bootstrap.BOUNDS) for r in picks] == bootstrap.weights(b, np.arange(30), P.SEED).tolist()
        for k, score in enumerate(["p", "q", "flat"]):
            assert draws[b][f"auc_{k}"] == pytest.approx(resampled_auc(pdf, score, b), abs=1e-12)
    out = bootstrap.bootstrap_auc(df, draws=200).first()
    assert 0 <= out.lower <= out.auc <= out.upper <= 1 and out.n_draws == 200
    same = bootstrap.paired_difference(df.withColumn("r", F.col("p")), "p", "r", draws=50).first()
    assert same.difference == 0 and not same.significant and same.verdict == "no distinguishable difference"


def test_the_auc_is_resampled_with_as_many_groups_as_there_are(spark):
    """a draw picks the number of groups, with replacement, groups of no usable score included."""
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"grp": np.repeat(np.arange(25) * 7, 5), "p": np.round(rng.random(125), 2), "y": (rng.random(125) < 0.3).astype(int)})
    df = spark.createDataFrame(pd.concat([pdf, pd.DataFrame({"grp": [500], "p": [np.nan], "y": [1]})]))
    got = np.array([r.auc_0 for r in bootstrap.bootstrap_draws(df, ["p"], draws=60, resampled=True).orderBy("draw").collect()])
    expected = []
    for b in range(60):
        w = bootstrap.multiplicities(b, 26, P.SEED)
        assert w.sum() == 26
        sample = pdf.loc[np.repeat(pdf.index, w[pdf["grp"] // 7])]
        pos, neg = sample.loc[sample["y"] == 1, "p"].to_numpy(), sample.loc[sample["y"] == 0, "p"].to_numpy()
        expected.append((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean())
    assert got == pytest.approx(np.array(expected), abs=1e-12)
    out = bootstrap.bootstrap_auc(df, draws=60).first()
    assert [out.lower, out.upper, out.n_draws] == pytest.approx([*np.quantile(expected, [0.025, 0.975]), 60], abs=1e-12)


def test_a_score_of_all_rows_is_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(prefix, "ROWS_PER_RANGE", 20)
    df = spark.range(500).selectExpr("0 AS which", "id AS g", "0.5D AS score")
    splits, tasks = bootstrap._cuts(df)
    assert tasks == {1.0: 50} and splits[0] == 0.5


@pytest.mark.parametrize("draw", [0, 1, 1999, 2**31 - 2, 2**31 - 1, 2**33])
def test_draws_hash_without_division(monkeypatch, draw):
    """the hash of a draw divides nothing; what belongs to the groups alone is worked out once."""
    m = 2**31 - 1
    groups = np.r_[0, 1, m - 1, m, m + 1, 2**40, np.random.default_rng(3).integers(0, 2**33, 40_000)]
    terms = bootstrap._terms(groups, P.SEED)
    expected = []
    for b in groups[:2000].tolist():
        first = (draw % m * 40503 + b % m * 69621 + P.SEED * 7919 + 12345) % m
        second = (first * first + b % m * 104729 + draw % m * 31 + 1) % m
        expected.append((second * second + second * 48271 + first) % m)
    whole = bootstrap._hashed(draw, terms)
    assert whole[:2000].tolist() == expected and (whole == bootstrap._hashed(draw, terms, chunk=7919)).all()
    picks = bootstrap.multiplicities(draw, len(groups), P.SEED)
    assert (picks == np.bincount(bootstrap._mix(draw, np.arange(len(groups)), P.SEED) % len(groups), minlength=len(groups))).all()


def test_weights_are_poisson():
    w = np.concatenate([bootstrap.weights(b, np.arange(5000), P.SEED) for b in range(20)])
    assert w.mean() == pytest.approx(1, abs=0.02) and w.var() == pytest.approx(1, abs=0.03) and (w == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)
    a, b = bootstrap.weights(3, np.arange(5000), P.SEED), bootstrap.weights(4, np.arange(5000), P.SEED)
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.05


def test_calibration_line_recovers_the_truth(spark):
    rng = np.random.default_rng(4)
    p = np.round(rng.uniform(0.02, 0.98, 20000), 4)
    df = spark.createDataFrame(pd.DataFrame({"p": p, "y": (rng.random(20000) < p).astype(int)}))
    line = calibrate.calibration_slope(df)
    assert line.slope == pytest.approx(1.0, abs=0.08) and line.intercept == pytest.approx(0.0, abs=0.08)
    few = calibrate.platt(df.limit(60))
    full = calibrate.calibration_slope(df.limit(60))
    assert abs(few.slope) < abs(full.slope)  # the ridge shrinks


def pav(y, w):
    blocks = [[v, k, 1] for v, k in zip(y, w)]
    i = 0
    while i < len(blocks) - 1:
        if blocks[i][0] > blocks[i + 1][0] + 1e-15:
            a, b = blocks[i], blocks.pop(i + 1)
            blocks[i] = [(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]]
            i = max(i - 1, 0)
        else:
            i += 1
    return np.concatenate([np.full(n, v) for v, _, n in blocks])


def test_isotonic_against_pool_adjacent_violators(spark):
    rng = np.random.default_rng(6)
    p = np.round(rng.random(2000), 2)
    pdf = pd.DataFrame({"p": p, "y": (rng.random(2000) < p**2).astype(int)})
    df = spark.createDataFrame(pdf)
    levels = pdf.groupby("p")["y"].agg(["mean", "count"])
    got = calibrate.isotonic_apply(calibrate.isotonic_fit(df), df.select("p").distinct()).toPandas().sort_values("p")
    assert got["isotonic"].to_numpy() == pytest.approx(pav(levels["mean"].to_numpy(), levels["count"].to_numpy(float)), abs=1e-9)


@pytest.mark.parametrize("rows_per_range", [1_000_000, 40])
def test_isotonic_of_continuous_scores_over_any_ranges(spark, monkeypatch, rows_per_range):
    monkeypatch.setattr(prefix, "ROWS_PER_RANGE", rows_per_range)
    rng = np.random.default_rng(16)
    p = np.r_[rng.random(3000), np.full(400, 0.375)]
    pdf = pd.DataFrame({"p": p, "y": (rng.random(3400) < p**3).astype(int)})
    held = [None, float("nan"), -1.0, 2.0, *rng.random(300)]
    asked = spark.createDataFrame([(None if x is None else float(x),) for x in [*held, *np.unique(p)]], "p double")
    dirty = spark.createDataFrame(pd.concat([pdf, pd.DataFrame({"p": [np.nan, np.nan], "y": [1, 0]})]))
    model = calibrate.isotonic_fit(dirty)
    got = isotonic_rates = {r.p: r.isotonic for r in calibrate.isotonic_apply(model, asked).collect() if r.p is not None and r.p == r.p}
    levels = pdf.groupby("p")["y"].agg(["mean", "count"])
    rate = pav(levels["mean"].to_numpy(), levels["count"].to_numpy(float))
    want = np.interp([x for x in got], levels.index, rate)
    assert list(isotonic_rates.values()) == pytest.approx(want, abs=1e-9)
    assert calibrate.isotonic_apply(model, asked).where("isotonic IS NULL").count() == 2
    assert (len(model.splits) > 50) == (rows_per_range == 40)


def test_cross_fitted_isotonic_equals_one_map_per_fold(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"group_id": np.arange(900) % 45, "p": rng.random(900)})
    pdf["y"] = (rng.random(900) < pdf["p"]).astype(int)
    out, method = calibrate.cross_fitted_calibration(spark.createDataFrame(pdf), n_folds=3, min_positives=5)
    got = out.toPandas()
    assert method == "isotonic" and len(got) == 900
    for fold, part in got.groupby("fold"):
        train = got[got["fold"] != fold].groupby("p")["y"].agg(["mean", "count"])
        rate = pav(train["mean"].to_numpy(), train["count"].to_numpy(float))
        want = np.clip(np.interp(part["p"], train.index, rate), P.PROBABILITY_EPS, 1 - P.PROBABILITY_EPS)
        assert part["calibrated"].to_numpy() == pytest.approx(want, abs=1e-9)


def test_cross_fitting_chooses_its_method(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"group_id": np.arange(300) % 60, "p": np.clip(rng.random(300), 0.01, 0.99)})
    pdf["y"] = (rng.random(300) < pdf["p"]).astype(int)
    many, method = calibrate.cross_fitted_calibration(spark.createDataFrame(pdf))
    assert method == "isotonic" and many.count() == 300 and many.where("calibrated <= 0 OR calibrated >= 1 OR calibrated IS NULL").count() == 0
    pdf["y"] = ((pdf["group_id"] < 9) & (pdf["p"] > 0.5)).astype(int)
    _, method = calibrate.cross_fitted_calibration(spark.createDataFrame(pdf), min_positives=25)
    assert method == "platt"


def grown(x, y, w, edges, rounds, min_leaf=P.GBT_MIN_LEAF):
    """Plain boosting on bins, node by node: returns the raw score of bin rows."""
    bins = lambda z: np.column_stack([np.where(np.isnan(z[:, j]), 999, np.searchsorted(e, z[:, j])) for j, e in enumerate(edges)])
    b = bins(x)
    share = (w * y).sum() / w.sum()
    base = np.log(share / (1 - share))
    raw, trees = np.full(len(y), base), []

    def tree(rows, g, h, depth):
        G, H = g[rows].sum(), h[rows].sum()
        best = (1e-10, None)
        for j in range(b.shape[1] if depth else 0):
            for c in range(len(edges[j]) + 1):
                for missing_left in (False, True):
                    left = np.where(b[rows, j] == 999, missing_left, b[rows, j] <= c)
                    l, r = rows[left], rows[~left]
                    if min(len(l), len(r)) < min_leaf or min(h[l].sum(), h[r].sum()) < 1e-3:
                        continue
                    gain = g[l].sum() ** 2 / (h[l].sum() + 1) + g[r].sum() ** 2 / (h[r].sum() + 1) - G**2 / (H + 1)
                    if gain > best[0] + 1e-9:
                        best = (gain, (j, c, missing_left, l, r))
        if best[1] is None:
            return -P.GBT_STEP * G / (H + 1)
        j, c, missing_left, l, r = best[1]
        return j, c, missing_left, tree(l, g, h, depth - 1), tree(r, g, h, depth - 1)

    def value(t, row):
        while isinstance(t, tuple):
            j, c, missing_left, l, r = t
            t = l if (missing_left if row[j] == 999 else row[j] <= c) else r
        return t

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        trees.append(tree(np.arange(len(y)), w * (p - y), w * p * (1 - p), P.GBT_DEPTH))
        raw = raw + [value(trees[-1], r) for r in b]
    return lambda z: 1 / (1 + np.exp(-(base + np.array([sum(value(t, r) for t in trees) for r in bins(z)]))))


def test_boosted_models_of_all_folds_equal_plain_boosting(spark, rows, panel_pdf):
    names = ["wc_ta", P.FEATURES[0] if P.FEATURES[0] != "wc_ta" else P.FEATURES[1]]
    scored, forest = resampling.boosted_oof(rows, n_folds=2, repeats=2, features=names, rounds=5, bins=16, refresh=2, rows_per_task=50)
    got = scored.toPandas().set_index(["ticker", "as_of"])["gbt_pd"]
    dealt = folds.group_folds(rows, 2, 2).toPandas()
    want = pd.Series(0.0, index=pd.MultiIndex.from_frame(panel_pdf[["ticker", "as_of"]]))
    for _, part in dealt.groupby("repeat"):
        where = panel_pdf["cik"].astype(int).map(dict(zip(part["group_id"], part["fold"])))
        for f in range(2):
            train, test = panel_pdf[where != f], panel_pdf[where == f]
            y = train["label"].to_numpy(float)
            w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
            predict = grown(train[names].to_numpy(float), y, w, forest.edges, 5)
            want[list(zip(test["ticker"], test["as_of"]))] += predict(test[names].to_numpy(float)) / 2
    assert got.reindex(want.index).to_numpy() == pytest.approx(want.to_numpy(), abs=1e-6)


def test_boosting_fills_the_cores(spark, rows, monkeypatch):
    """Few rows with many models are cut into parts of the models; the trees are those of one part."""
    assert histogram._layout(35_000, 100, 12, 100_000) == (1, 12)
    assert histogram._layout(500, 100, 12, 100_000) == (1, 1)
    slices, parts = histogram._layout(2_000_000, 100, 12, 100_000)
    assert (slices, parts) == (20, 1)
    names = P.FEATURES[:3]
    once, _ = resampling.boosted_oof(rows, n_folds=2, repeats=2, features=names, rounds=4, bins=16, refresh=2)
    monkeypatch.setattr(histogram, "ROW_MODELS_PER_TASK", 150)
    for rows_per_task in (1000, 80):
        layout = histogram._layout(144, 4, 4, rows_per_task)
        assert layout[0] * layout[1] > 1 and layout[1] > 1
        parted, _ = resampling.boosted_oof(rows, n_folds=2, repeats=2, features=names, rounds=4, bins=16, refresh=2, rows_per_task=rows_per_task)
        key = lambda df: df.toPandas().sort_values(["ticker", "as_of"])["gbt_pd"].to_numpy()
        assert key(parted) == pytest.approx(key(once), abs=1e-9)


@pytest.mark.parametrize("rows_per_task", [1000, 50])
def test_boosted_models_need_no_pass_per_level(spark, rows, monkeypatch, rows_per_task):
    """tasks grow whole models as long as they can hold the rows; the trees are those of passes over slices and parts."""
    names, options = P.FEATURES[:4], {"n_folds": 3, "repeats": 2, "rounds": 6, "bins": 16, "refresh": 2}
    monkeypatch.setattr(histogram, "ROW_MODELS_PER_TASK", 150)
    key = lambda df: df.toPandas().sort_values(["ticker", "as_of"])["gbt_pd"].to_numpy()
    passes, forest = resampling.boosted_oof(rows, features=names, rows_per_task=rows_per_task, rows_alone=0, **options)
    expected = key(passes)
    monkeypatch.setattr(histogram, "_splits", None)
    got, alone = resampling.boosted_oof(rows, features=names, **options)
    assert key(got) == pytest.approx(expected, abs=1e-9)
    assert (alone.feature == forest.feature).all() and (alone.cut == forest.cut).all() and alone.leaf == pytest.approx(forest.leaf, abs=1e-9)


def test_boosting_learns_which_side_missing_values_take(spark):
    data = [(i, None if i % 2 else float(i % 7), int(i % 2 == 1 or i % 7 == 6)) for i in range(200)]
    df = spark.createDataFrame(data, "group_id long, x double, y int").selectExpr("*", "array(-1) AS hold", "'t' AS ticker", "current_date() AS as_of")
    forest = histogram.fit_forest(df, [(0, 0)], ["x"], rounds=40)
    scored = histogram.out_of_fold(df.withColumn("hold", F.array(F.lit(0))), forest, resampling.KEYS).toPandas()
    assert scored.loc[scored["y"] == 1, "gbt_pd"].min() > scored.loc[scored["y"] == 0, "gbt_pd"].max()
    one_class = histogram.fit_forest(df.withColumn("y", F.lit(0)), [(0, 0)], ["x"], rounds=2)
    assert not one_class.usable.any()


def test_booster_and_weights(spark, rows):
    weights = {r.y: r.weight for r in boosting.class_weights(spark.sql("SELECT * FROM VALUES (1), (0), (0), (0) AS t(y)")).collect()}
    assert weights[1] == pytest.approx(3 * weights[0])
    scored = boosting.predict(boosting.fit_booster(rows, rounds=3), rows).toPandas()
    assert len(scored) == 144 and scored["gbt_pd"].between(0, 1).all()
