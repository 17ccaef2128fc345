"""Published distress scores, as SQL expressions over a snapshot or panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagerisk import params as P
from vintagerisk.functions.numeric import clamp, dbl, num, sigmoid


def _weighted(weights: dict[str, float]) -> str:
    return " + ".join(f"{dbl(w)} * {name}" for name, w in weights.items())


def z_double_prime(include_constant: bool = False) -> Column:
    """Altman Z'' for non-manufacturers; NULL when any input is missing."""
    score = F.expr(_weighted(P.Z2_WEIGHTS))
    return score + num(P.Z2_CONSTANT) if include_constant else score


def z_prime() -> Column:
    """Altman Z' for private manufacturers; needs `sales_ta`."""
    return F.expr(_weighted(P.Z1_WEIGHTS))


def zone(score: str, cuts: tuple[float, float] = P.Z2_ZONES) -> Column:
    return F.expr(
        f"CASE WHEN {score} IS NULL THEN 'unscored' WHEN {score} > {dbl(cuts[0])} THEN 'safe' "
        f"WHEN {score} < {dbl(cuts[1])} THEN 'distress' ELSE 'grey' END"
    )


def score_panel(panel: DataFrame) -> DataFrame:
    return panel.withColumn("z_double_prime", z_double_prime()).withColumn("z_zone", zone("z_double_prime"))


def o_score(price_index: float = P.O_SCORE_PRICE_INDEX) -> Column:
    """Ohlson's one-year model; missing cash flow and missing prior income count as zero terms."""
    w = {name: dbl(x) for name, x in P.O_SCORE_WEIGHTS.items()}
    return F.expr(f"""
        CASE WHEN total_assets > 0 AND total_liabilities > 0 AND current_liabilities > 0
                  AND current_assets IS NOT NULL AND net_income IS NOT NULL THEN
            {w['const']} + {w['size']} * ln(total_assets / {dbl(price_index)})
            + {w['tl_ta']} * (total_liabilities / total_assets)
            + {w['wc_ta']} * ((current_assets - current_liabilities) / total_assets)
            + {w['cl_ca']} * CASE WHEN current_assets > 0 THEN current_liabilities / current_assets ELSE 0D END
            + {w['oeneg']} * CASE WHEN total_liabilities > total_assets THEN 1D ELSE 0D END
            + {w['ni_ta']} * (net_income / total_assets)
            + {w['ffo_tl']} * coalesce(cfo / total_liabilities, 0D)
            + {w['intwo']} * CASE WHEN net_income < 0 AND prior_net_income < 0 THEN 1D ELSE 0D END
            + {w['chin']} * CASE WHEN abs(net_income) + abs(prior_net_income) > 0
                THEN (net_income - prior_net_income) / (abs(net_income) + abs(prior_net_income)) ELSE 0D END
        END""")


def o_score_pd(score: Column) -> Column:
    return sigmoid(clamp(score, -P.O_SCORE_CLIP, P.O_SCORE_CLIP))
