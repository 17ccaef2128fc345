"""Derived statement lines and ratios on a wide snapshot.  Expressions only, all inside code generation."""

from __future__ import annotations

from pyspark.sql import DataFrame

from vintagerisk import params as P
from vintagerisk.functions.numeric import clamp_sql, dbl, ratio
from vintagerisk.operators.facts import APPROXIMATE_BIT, CURRENT_MATURITY, INCLUSIVE_LTD

EBIT_CHAIN = """coalesce(ebit,
    gross_profit - sga_expense - coalesce(rnd_expense, 0D),
    pretax_income + abs(interest_expense),
    pretax_income - net_interest)"""


def _with(df: DataFrame, **exprs: str) -> DataFrame:
    """Add or replace columns from SQL text in one projection."""
    kept = [f"`{c}`" for c in df.columns if c not in exprs]
    return df.selectExpr(*kept, *[f"{sql} AS `{name}`" for name, sql in exprs.items()])


def derive_fields(snap: DataFrame) -> DataFrame:
    """Fill gross profit, EBIT and total liabilities from identities and list what was derived.

    Gross profit comes first because EBIT may need it.  The list names approximate tags
    in field order, then derived lines.
    """
    snap = _with(
        snap,
        reported="struct(gross_profit, ebit, total_liabilities)",
        gross_profit="coalesce(gross_profit, revenue - cost_of_revenue)",
        total_liabilities="coalesce(total_liabilities, total_assets - equity)",
    )
    snap = _with(snap, ebit=EBIT_CHAIN)
    approximations = sorted((label, tag) for tag, label in P.APPROXIMATE_TAGS.items())
    flags = [
        f"CASE WHEN {label.split('~')[0]}_marks = {APPROXIMATE_BIT[tag]} THEN '{label}' END" for label, tag in approximations
    ] + [
        f"CASE WHEN reported.{name} IS NULL AND {name} IS NOT NULL THEN '{name}' END"
        for name in ("gross_profit", "ebit", "total_liabilities")
    ]
    return _with(snap, derived_fields=f"array_compact(array({', '.join(flags)}))").drop("reported")


# current maturities are not added to a long-term tag that already includes them
TOTAL_DEBT = f"""CASE
    WHEN long_term_debt IS NULL AND current_debt IS NULL THEN total_debt_reported
    WHEN long_term_debt IS NOT NULL AND current_debt IS NOT NULL
         AND long_term_debt_marks = {INCLUSIVE_LTD} AND current_debt_marks = {CURRENT_MATURITY} THEN long_term_debt
    ELSE coalesce(long_term_debt, 0D) + coalesce(current_debt, 0D) END"""
EBITDA = "ebit + coalesce(depreciation_amortisation, 0D)"
# net interest counts only when it is an expense; net income says nothing about the burden
COVERAGE_INTEREST = "coalesce(interest_expense, CASE WHEN net_interest < 0 THEN abs(net_interest) END)"
WORKING_CAPITAL = "current_assets - current_liabilities"
EQUITY = "coalesce(equity, total_assets - total_liabilities)"

RATIOS = {
    "wc_ta": ratio(WORKING_CAPITAL, "total_assets"),
    "re_ta": ratio("retained_earnings", "total_assets"),
    "ebit_ta": ratio("ebit", "total_assets"),
    "equity_tl": ratio("equity_used", "total_liabilities"),
    "current_ratio": ratio("current_assets", "current_liabilities"),
    # negative earnings are distress, not a gap: leverage goes to its cap
    "debt_ebitda": f"""CASE WHEN ebitda > 0 THEN {ratio('total_debt', 'ebitda')}
        WHEN ebitda <= 0 AND total_debt IS NOT NULL THEN {dbl(P.RATIO_BOUNDS['debt_ebitda'][1])} END""",
    # only a reported zero earns the best coverage; an untagged line stays missing
    "interest_cover": f"""CASE WHEN interest_burden <> 0 THEN {ratio('ebit', 'abs(interest_burden)')}
        WHEN interest_burden = 0 AND ebit IS NOT NULL THEN {dbl(P.RATIO_BOUNDS['interest_cover'][1])} END""",
    "cfo_total_debt": ratio("cfo", "total_debt"),
    "net_margin": ratio("net_income", "revenue"),
    "log_assets": "ln(CASE WHEN total_assets > 0 THEN total_assets END)",
    "negative_equity": "CASE WHEN equity_used < 0 THEN 1D WHEN equity_used IS NOT NULL THEN 0D END",
    "two_year_loss": """CASE WHEN net_income < 0 AND prior_net_income < 0 THEN 1D
        WHEN net_income IS NOT NULL AND prior_net_income IS NOT NULL THEN 0D END""",
}


def compute_ratios(snap: DataFrame) -> DataFrame:
    """Add total debt and the twelve model features, each capped at its economic bounds."""
    snap = _with(
        snap, total_debt=TOTAL_DEBT, ebitda=EBITDA, interest_burden=COVERAGE_INTEREST, equity_used=EQUITY
    )
    capped = {}
    for name, sql in RATIOS.items():
        low, high = P.RATIO_BOUNDS.get(name, P.DEFAULT_BOUNDS)
        capped[name] = clamp_sql(sql, dbl(low), dbl(high))
    return _with(snap, **capped)
