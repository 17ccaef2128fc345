"""Parameters of the credit model.

Everything in the FIXED VALUES block must hold exactly for results to be right:
reporting vocabulary, published score coefficients, regulatory constants and the
recovery study figures.  The rest of the package reads them, never restates them.
"""

from __future__ import annotations

import datetime as dt

# --------------------------------------------------------------------------
# FIXED VALUES: filing vocabulary (US-GAAP tags in order of preference)
# --------------------------------------------------------------------------

INSTANT_FIELDS = {
    "total_assets": ["Assets"],
    "total_liabilities": ["Liabilities"],
    "current_assets": ["AssetsCurrent"],
    "current_liabilities": ["LiabilitiesCurrent"],
    "retained_earnings": ["RetainedEarningsAccumulatedDeficit"],
    "equity": [
        "StockholdersEquity",
        "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest",
    ],
    "cash": [
        "CashAndCashEquivalentsAtCarryingValue",
        "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents",
    ],
    "inventory": ["InventoryNet"],
    "long_term_debt": [
        "LongTermDebtNoncurrent",
        "LongTermDebt",
        "LongTermDebtAndCapitalLeaseObligations",
    ],
    "current_debt": [
        "LongTermDebtCurrent",
        "LongTermDebtAndCapitalLeaseObligationsCurrent",
        "DebtCurrent",
        "ShortTermBorrowings",
        "OtherShortTermBorrowings",
    ],
    "total_debt_reported": [
        "DebtAndCapitalLeaseObligations",
        "LongTermDebtAndCapitalLeaseObligationsIncludingCurrentMaturities",
        "DebtLongtermAndShorttermCombinedAmount",
    ],
}

DURATION_FIELDS = {
    "revenue": [
        "RevenueFromContractWithCustomerExcludingAssessedTax",
        "Revenues",
        "SalesRevenueNet",
        "RevenueFromContractWithCustomerIncludingAssessedTax",
        "SalesRevenueGoodsNet",
    ],
    "ebit": ["OperatingIncomeLoss"],
    "gross_profit": ["GrossProfit"],
    "cost_of_revenue": ["CostOfGoodsAndServicesSold", "CostOfRevenue"],
    "sga_expense": ["SellingGeneralAndAdministrativeExpense"],
    "rnd_expense": [
        "ResearchAndDevelopmentExpenseExcludingAcquiredInProcessCost",
        "ResearchAndDevelopmentExpense",
    ],
    "pretax_income": [
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest",
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments",
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesDomestic",
    ],
    "net_income": [
        "NetIncomeLoss",
        "ProfitLoss",
        "NetIncomeLossAvailableToCommonStockholdersBasic",
    ],
    "cfo": [
        "NetCashProvidedByUsedInOperatingActivities",
        "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations",
    ],
    "depreciation_amortisation": [
        "DepreciationDepletionAndAmortization",
        "DepreciationAmortizationAndAccretionNet",
        "DepreciationAndAmortization",
    ],
    "interest_expense": [
        "InterestExpense",
        "InterestExpenseDebt",
        "InterestExpenseNonoperating",
        "InterestAndDebtExpense",
        "InterestExpenseDebtExcludingAmortization",
    ],
    "net_interest": ["InterestIncomeExpenseNonoperatingNet", "InterestIncomeExpenseNet"],
}

FIELDS = list(INSTANT_FIELDS) + list(DURATION_FIELDS)

APPROXIMATE_TAGS = {
    "NetIncomeLossAvailableToCommonStockholdersBasic": "net_income~available_to_common",
    "InterestExpenseDebtExcludingAmortization": "interest_expense~excl_amortisation",
}
LTD_INCLUSIVE_TAGS = ["LongTermDebt"]
CURRENT_MATURITY_TAGS = ["LongTermDebtCurrent", "DebtCurrent"]

ANNUAL_FORMS = ["10-K", "10-K/A"]
ANNUAL_SPAN_DAYS = (300, 430)
PRIOR_GAP_DAYS = (270, 460)
MAX_STALENESS_DAYS = 550
HORIZON_DAYS = 365
OBSERVATION_MONTH_DAY = (6, 30)
BANKRUPTCY_ITEM = r"\b1\.03\b"
TAG_CENSUS_PATTERN = (
    r"(?i)(Debt|Borrowing|NotesPayable|SeniorNotes|LineOfCredit|CommercialPaper|FinanceLease|Interest)"
)
GAP_PROBES = {
    "revenue": r"Revenue|Sales",
    "net_income": r"NetIncome|ProfitLoss|NetEarnings",
    "interest_expense": r"InterestExpense|InterestAndDebtExpense",
}

# --------------------------------------------------------------------------
# FIXED VALUES: ratios, scores, thresholds
# --------------------------------------------------------------------------

FEATURES = [
    "wc_ta",
    "re_ta",
    "ebit_ta",
    "equity_tl",
    "current_ratio",
    "debt_ebitda",
    "interest_cover",
    "cfo_total_debt",
    "net_margin",
    "log_assets",
    "negative_equity",
    "two_year_loss",
]

EXPECTED_SIGN = {
    "wc_ta": -1,
    "re_ta": -1,
    "ebit_ta": -1,
    "equity_tl": -1,
    "current_ratio": -1,
    "debt_ebitda": 1,
    "interest_cover": -1,
    "cfo_total_debt": -1,
    "net_margin": -1,
    "log_assets": -1,
    "negative_equity": 1,
    "two_year_loss": 1,
}

RATIO_BOUNDS = {
    "debt_ebitda": (-50.0, 50.0),
    "interest_cover": (-50.0, 50.0),
    "cfo_total_debt": (-5.0, 5.0),
    "current_ratio": (0.0, 20.0),
    "equity_tl": (-10.0, 20.0),
    "net_margin": (-5.0, 5.0),
    "wc_ta": (-5.0, 5.0),
    "re_ta": (-20.0, 5.0),
    "ebit_ta": (-5.0, 5.0),
}
DEFAULT_BOUNDS = (-1e12, 1e12)
MIN_DENOMINATOR = 1e-6

Z2_WEIGHTS = {"wc_ta": 6.56, "re_ta": 3.26, "ebit_ta": 6.72, "equity_tl": 1.05}
Z2_CONSTANT = 3.25
Z2_ZONES = (2.60, 1.10)  # safe above, distress below
Z1_WEIGHTS = {"wc_ta": 0.717, "re_ta": 0.847, "ebit_ta": 3.107, "equity_tl": 0.420, "sales_ta": 0.998}
Z1_ZONES = (2.90, 1.23)

O_SCORE_WEIGHTS = {
    "const": -1.32,
    "size": -0.407,
    "tl_ta": 6.03,
    "wc_ta": -1.43,
    "cl_ca": 0.0757,
    "oeneg": -1.72,
    "ni_ta": -2.37,
    "ffo_tl": -1.83,
    "intwo": 0.285,
    "chin": -0.521,
}
O_SCORE_PRICE_INDEX = 100.0
O_SCORE_CLIP = 40.0

AGGRESSIVE_LEVERAGE = 4.0
WEAK_COVERAGE = 2.0
HARDNESS_CUTS = (0.10, 0.30)
PSI_CUTS = (0.10, 0.25)
PSI_BUCKETS = 10
PSI_FLOOR = 1e-6
PROBABILITY_EPS = 1e-9

WINSOR_QUANTILES = (0.01, 0.99)
LOGIT_C = 1.0
CV_FOLDS = 5
CV_REPEATS = 20
BOOTSTRAP_DRAWS = 2000
BOOTSTRAP_ALPHA = 0.05
SEED = 42
MIN_POSITIVES_ISOTONIC = 25
POPULATION_RATE = 0.02
POPULATION_GRID = (0.01, 0.02, 0.03)
SIGN_MATERIALITY = 0.05
MIN_GRADE_BUCKET = 3
MIN_POSITIVE_ROWS = 8
MIN_POSITIVE_ISSUERS = 5
MAX_MISSING_SHARE = 0.35

GBT_DEPTH = 3
GBT_ROUNDS = 120
GBT_STEP = 0.05
GBT_MIN_LEAF = 3
GBT_L2 = 1.0

# --------------------------------------------------------------------------
# FIXED VALUES: masterscale, recoveries, conversion factors, capital formula
# --------------------------------------------------------------------------

MASTERSCALE = [
    ("1", "Minimal", 0.0010),
    ("2", "Low", 0.0030),
    ("3", "Moderate", 0.0100),
    ("4", "Acceptable", 0.0300),
    ("5", "Watch", 0.0800),
    ("6", "Substandard", 0.2000),
    ("7", "Impaired", 1.0000),
]

# seniority class, mean recovery, recovery basis, published source of the mean
RECOVERY_CLASSES = [
    ("bank_loan_secured", 0.80, "ultimate", "Moody's Ultimate Recovery Database (annual default and recovery studies)"),
    ("senior_secured", 0.58, "trading_price", "Altman & Kishore (1996), Financial Analysts Journal 52(6)"),
    ("senior_unsecured", 0.48, "trading_price", "Altman & Kishore (1996), Financial Analysts Journal 52(6)"),
    ("senior_subordinated", 0.34, "trading_price", "Altman & Kishore (1996), Financial Analysts Journal 52(6)"),
    ("subordinated", 0.31, "trading_price", "Altman & Kishore (1996), Financial Analysts Journal 52(6)"),
]
RECOVERY_BASES = ["trading_price", "ultimate"]
DISTRESS_HAIRCUT = 0.10
DISTRESS_CLASSES = ["senior_unsecured", "senior_subordinated", "subordinated"]
DISTRESS_ENABLED = False
LGD_FLOOR = 0.05
LGD_CAP = 0.95
DOWNTURN_HAIRCUT = 0.15
DEFAULT_MIX = {"senior_secured": 0.5, "senior_unsecured": 0.5}
WEIGHT_TOLERANCE = 1e-6

CREDIT_CONVERSION = {"revolving_credit_facility": 0.75, "term_loan": 1.0, "bond": 1.0}

IRB_PD_FLOOR = 0.0003
IRB_MATURITY = 2.5
IRB_CONFIDENCE = 0.999
RWA_MULTIPLE = 12.5

DEFAULT_WINDOW = (dt.date(2015, 1, 1), dt.date(2024, 12, 31))
