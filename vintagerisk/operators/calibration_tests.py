"""Is a stated probability the observed rate?  Brier, Hosmer-Lemeshow, reliability, backtest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagerisk.functions.normal import norm_cdf
from vintagerisk.operators.prefix import equal_count_buckets


def brier_score(scored: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    return scored.agg(F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"))


def bin_edges(n_bins: int) -> list[float]:
    """Interior edges of equal-width bins, as evenly spaced floats."""
    return [i * (1.0 / n_bins) for i in range(1, n_bins)]


def brier_decomposition(scored: DataFrame, n_bins: int = 10, p: str = "p", y: str = "y") -> DataFrame:
    """Reliability, resolution and uncertainty over equal-width bins of the probability."""
    slot = " + ".join(f"CASE WHEN {p} >= {e!r}D THEN 1 ELSE 0 END" for e in bin_edges(n_bins))
    bins = scored.withColumn("bin", F.expr(slot)).groupBy("bin").agg(
        F.count("*").alias("n"), F.avg(p).alias("p_bar"), F.avg(y).alias("o_bar"),
        F.sum((F.col(p) - F.col(y)) ** 2).alias("sq"),
    )
    # n_bins rows: a window without partition is safe
    based = bins.selectExpr("*", "sum(n * o_bar) OVER () / sum(n) OVER () AS base")
    return based.agg(
        (F.sum("sq") / F.sum("n")).alias("brier"),
        (F.sum(F.expr("n * power(p_bar - o_bar, 2)")) / F.sum("n")).alias("reliability"),
        (F.sum(F.expr("n * power(o_bar - base, 2)")) / F.sum("n")).alias("resolution"),
        F.max(F.expr("base * (1 - base)")).alias("uncertainty"),
    )


def chi2_survival(x: str, root: str, dof: str) -> Column:
    """P(chi-square > x) for integer degrees of freedom, by the finite series; `root` names sqrt(x).

    Even dof: a sum of Poisson terms.  Odd dof: the normal tail plus the same kind of sum.
    The series has as many terms as the dof asks for, and each is taken from its logarithm,
    so a large statistic does not underflow on the way.
    """
    def series(first: str, factor: str, terms: str) -> str:
        start = f"named_struct('log_term', {first}, 'total', 0D)"
        grown = f"named_struct('log_term', chi_acc.log_term + ln({factor}), 'total', chi_acc.total + exp(chi_acc.log_term))"
        steps = f"CASE WHEN {terms} >= 1 THEN sequence(1, cast({terms} as int)) ELSE cast(array() as array<int>) END"
        return f"aggregate({steps}, {start}, (chi_acc, chi_step) -> {grown}, chi_acc -> chi_acc.total)"

    even = series(f"-{x} / 2D", f"{x} / (2D * chi_step)", f"{dof} DIV 2")
    odd = series(f"ln(sqrt(2D * {x} / pi())) - {x} / 2D", f"{x} / (2D * chi_step + 1D)", f"({dof} - 1) DIV 2")
    tail = f"CASE WHEN {dof} % 2 = 0 THEN {even} ELSE 2D * (1D - ({norm_cdf(root)})) + {odd} END"
    return F.expr(f"CASE WHEN {x} <= 0 THEN 1D ELSE {tail} END")


def hosmer_lemeshow(scored: DataFrame, n_groups: int = 10, **columns: str) -> DataFrame:
    """Chi-square over equal-count groups, any number of them; groups with no variance are left out of the count."""
    groups = equal_count_buckets(scored, n_groups, **columns)
    used = groups.selectExpr("sum_y", "sum_p", "sum_p * (1 - sum_p / n) AS spread").where("spread > 1e-9D")
    stat = used.agg(
        F.sum(F.expr("power(sum_y - sum_p, 2) / spread")).alias("statistic"),
        F.greatest(F.count("*") - 2, F.lit(1)).cast("int").alias("dof"),
    )
    rooted = stat.withColumn("root", F.sqrt("statistic"))
    return rooted.withColumn("p_value", chi2_survival("statistic", "root", "dof")).drop("root")


def reliability_table(scored: DataFrame, n_bins: int = 5, **columns: str) -> DataFrame:
    return equal_count_buckets(scored, n_bins, **columns).selectExpr(
        "bucket", "n", "sum_p / n AS mean_predicted_pd", "sum_y / cast(n as double) AS observed_default_rate", "sum_y AS observed_defaults"
    )


def annual_backtest(predictions: DataFrame, year: Column, p: str = "p", y: str = "y") -> DataFrame:
    """Expected against realised defaults per year, with the Poisson-binomial normal score."""
    return (
        predictions.groupBy(year.cast("int").alias("year"))
        .agg(
            F.count("*").alias("issuers"), F.sum(p).alias("expected_defaults"),
            F.sum(F.col(y).cast("bigint")).alias("realised_defaults"), F.sum(F.expr(f"{p} * (1 - {p})")).alias("variance"),
        )
        .withColumn("z", F.expr("CASE WHEN variance > 0 THEN (realised_defaults - expected_defaults) / sqrt(variance) END"))
        .drop("variance")
    )
