"""Standard normal distribution as plain SQL arithmetic (Spark has no erf).

The CDF uses W. J. Cody's rational approximations of erf/erfc (Math. Comp. 23, 1969);
the quantile uses M. J. Wichura's algorithm AS 241 (Applied Statistics 37, 1988).
Both are accurate to about 1e-15 and stay inside whole-stage code generation.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from vintagerisk.functions.numeric import dbl

# FIXED VALUES: published polynomial coefficients, highest power first.
ERF_NUM = [1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3]
ERF_DEN = [1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3]
ERFC_NUM = [
    2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2,
    8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3,
]
ERFC_DEN = [
    1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
    3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3,
]
ERFC_TAIL_NUM = [
    1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1,
    1.60837851487422766e-2, 6.58749161529837803e-4,
]
ERFC_TAIL_DEN = [
    1.0, 2.56852019228982242e0, 1.87295284992346047e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3,
]
PPND_A = [
    2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4,
    1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0,
]
PPND_B = [
    5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4,
    5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0,
]
PPND_C = [
    7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0,
    3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0,
]
PPND_D = [
    1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1,
    6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0,
]
PPND_E = [
    2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2,
    2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0,
]
PPND_F = [
    2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4,
    1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0,
]
INV_SQRT_PI = 5.6418958354775628695e-1


def _horner(coefs: list[float], x: str) -> str:
    out = dbl(coefs[0])
    for c in coefs[1:]:
        out = f"({out} * {x} + {dbl(c)})"
    return out


def norm_cdf(x: str, y: str | None = None, y2: str | None = None, inv: str | None = None) -> str:
    """Distribution function of the column named `x`, as SQL text.

    `y`, `y2`, `inv` may name columns that already hold |x|/sqrt(2), its square and the
    inverse of that; otherwise they are written out.
    """
    y = y or f"(abs({x}) / {dbl(math.sqrt(2.0))})"
    y2 = y2 or f"({y} * {y})"
    inv = inv or f"(1D / {y2})"
    erf_mid = f"{y} * {_horner(ERF_NUM, y2)} / {_horner(ERF_DEN, y2)}"
    erfc_mid = f"exp(-{y2}) * {_horner(ERFC_NUM, y)} / {_horner(ERFC_DEN, y)}"
    far = f"{dbl(INV_SQRT_PI)} - {inv} * {_horner(ERFC_TAIL_NUM, inv)} / {_horner(ERFC_TAIL_DEN, inv)}"
    tail = f"CASE WHEN {y} <= 0.46875D THEN 1D - {erf_mid} WHEN {y} <= 4D THEN {erfc_mid} ELSE exp(-{y2}) / {y} * ({far}) END"
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE 0.5D + sign({x}) * (0.5D - 0.5D * ({tail})) END"


def norm_quantile(p: str, r: str | None = None) -> str:
    """Quantile function of the column named `p` (strictly between 0 and 1), as SQL text."""
    q = f"({p} - 0.5D)"
    r_mid = f"(0.180625D - {q} * {q})"
    central = f"{q} * {_horner(PPND_A, r_mid)} / {_horner(PPND_B, r_mid)}"
    r = r or f"sqrt(-ln(least({p}, 1D - {p})))"
    near_r, far_r = f"({r} - 1.6D)", f"({r} - 5D)"
    near = f"{_horner(PPND_C, near_r)} / {_horner(PPND_D, near_r)}"
    far = f"{_horner(PPND_E, far_r)} / {_horner(PPND_F, far_r)}"
    outer = f"CASE WHEN {r} <= 5D THEN {near} ELSE {far} END"
    return f"CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN abs({q}) <= 0.425D THEN {central} ELSE sign({q}) * ({outer}) END"


def add_norm_cdf(df: DataFrame, x: str, name: str) -> DataFrame:
    """Add the distribution function of a column.  Intermediates are projected first, so they are computed once per row.

    They are never NULL (a missing x is handled at the end): the generated polynomials carry no null checks, which keeps
    methods short enough for the JVM to compile.
    """
    return (
        df.selectExpr("*", f"coalesce(abs({x}) / {dbl(math.sqrt(2.0))}, 0D) AS cdf_y")
        .selectExpr("*", "cdf_y * cdf_y AS cdf_y2")
        .selectExpr("*", "coalesce(CASE WHEN cdf_y2 > 0 THEN 1D / cdf_y2 END, 0D) AS cdf_inv")
        .selectExpr("* EXCEPT (cdf_y, cdf_y2, cdf_inv)", f"{norm_cdf(x, 'cdf_y', 'cdf_y2', 'cdf_inv')} AS {name}")
    )


def add_norm_quantile(df: DataFrame, p: str, name: str) -> DataFrame:
    """Add the quantile function of a column; a missing probability counts as 0 on the way and has no quantile."""
    return (
        df.selectExpr("*", f"coalesce({p}, 0D) AS quantile_p")
        .selectExpr("*", "coalesce(sqrt(-ln(least(quantile_p, 1D - quantile_p))), 0D) AS quantile_r")
        .selectExpr("* EXCEPT (quantile_p, quantile_r)", f"{norm_quantile('quantile_p', 'quantile_r')} AS {name}")
    )
