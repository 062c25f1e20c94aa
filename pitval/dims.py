"""Parameter tables. Every table is small and of fixed size, so joins may broadcast it."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---- fixed values: yearly mean short rate, yearly inflation in percent ----
RISK_FREE_BY_YEAR = {
    2005: 0.0322, 2006: 0.0482, 2007: 0.0444, 2008: 0.0137, 2009: 0.0015,
    2010: 0.0014, 2011: 0.0005, 2012: 0.0009, 2013: 0.0006, 2014: 0.0003,
    2015: 0.0005, 2016: 0.0032, 2017: 0.0093, 2018: 0.0194, 2019: 0.0206,
    2020: 0.0037, 2021: 0.0004, 2022: 0.0202, 2023: 0.0515, 2024: 0.0521,
    2025: 0.0430, 2026: 0.0400,
}
RISK_FREE_DEFAULT = 0.04
INFLATION_BY_YEAR = {
    2005: 3.39, 2006: 3.23, 2007: 2.85, 2008: 3.84, 2009: -0.36,
    2010: 1.64, 2011: 3.16, 2012: 2.07, 2013: 1.46, 2014: 1.62,
    2015: 0.12, 2016: 1.26, 2017: 2.13, 2018: 2.44, 2019: 1.81,
    2020: 1.23, 2021: 4.70, 2022: 8.00, 2023: 4.12, 2024: 2.95,
    2025: 2.70,
}
INFLATION_DEFAULT = 2.0

# ---- fixed values: sector -> (wacc, cash-flow growth, terminal growth) ----
SECTOR_DCF = {
    "Technologie": (0.100, 0.07, 0.030),
    "Santé": (0.090, 0.06, 0.025),
    "Agro-alimentaire et boissons": (0.070, 0.03, 0.020),
    "Produits ménagers et de soin personnel": (0.070, 0.03, 0.020),
    "Services aux collectivités": (0.065, 0.02, 0.015),
    "Banques": (0.090, 0.04, 0.020),
    "Assurance": (0.090, 0.04, 0.020),
    "Services financiers": (0.090, 0.04, 0.020),
    "Immobilier": (0.070, 0.03, 0.020),
    "Pétrole et gaz": (0.100, 0.03, 0.015),
    "Biens et services industriels": (0.090, 0.04, 0.020),
    "Bâtiment et matériaux de construction": (0.090, 0.04, 0.020),
    "Matières premières": (0.090, 0.04, 0.020),
    "Chimie": (0.090, 0.04, 0.020),
    "Medias": (0.090, 0.05, 0.025),
    "Télécommunications": (0.090, 0.05, 0.025),
    "Distribution": (0.095, 0.05, 0.025),
    "Automobiles et équipementiers": (0.095, 0.05, 0.025),
    "Voyage et loisirs": (0.095, 0.05, 0.025),
}
SECTOR_DCF_DEFAULT = (0.100, 0.05, 0.020)
WACC_CALIBRATION_RATE = 0.04
MIN_WACC_SPREAD = 0.03
SECTORS_WITHOUT_DCF = ("Banques", "Assurance", "Immobilier")

# ---- fixed values: sector -> dividend yield ----
DIVIDEND_YIELD = {
    "Technologie": 0.008,
    "Santé": 0.017,
    "Agro-alimentaire et boissons": 0.028,
    "Produits ménagers et de soin personnel": 0.025,
    "Services aux collectivités": 0.035,
    "Banques": 0.030,
    "Assurance": 0.022,
    "Services financiers": 0.020,
    "Immobilier": 0.040,
    "Pétrole et gaz": 0.035,
    "Biens et services industriels": 0.018,
    "Bâtiment et matériaux de construction": 0.015,
    "Matières premières": 0.020,
    "Chimie": 0.022,
    "Medias": 0.012,
    "Télécommunications": 0.045,
    "Distribution": 0.015,
    "Automobiles et équipementiers": 0.020,
    "Voyage et loisirs": 0.012,
}
DIVIDEND_YIELD_DEFAULT = 0.018

# ---- fixed values: multiples that make sense per sector, and their plausible range ----
SECTOR_MULTIPLES = {
    "Banques": ["P/E"],
    "Assurance": ["P/E"],
    "Services financiers": ["P/E"],
    "Immobilier": ["EV/EBITDA"],
    "Services aux collectivités": ["EV/EBITDA", "EV/Sales"],
}
SECTOR_MULTIPLES_DEFAULT = ["EV/EBITDA", "EV/Sales", "P/E"]
PLAUSIBLE_RANGE = {"EV/EBITDA": (0.0, 50.0), "EV/Sales": (0.0, 20.0), "P/E": (0.0, 60.0)}
MIN_PEERS = 5

# ---- fixed values: signal life in days, thresholds, caps ----
MAX_SIGNAL_AGE = {"FY": 270, "TTM": 120}
MAX_SIGNAL_AGE_DEFAULT = 400
ENTRY_THRESHOLD_PCT = 20.0
EXIT_THRESHOLD_RATIO = 0.70
MOMENTUM_MIN_PCT = -10.0
POSITION_CAP_PCT = 20.0
SECTOR_CAP_PCT = 30.0
SECTOR_NEUTRAL_ENTRY_PCT = 10.0
CHURN_LOG_GAP = 0.15
PRICE_TOLERANCE_DAYS = 10
FILL_LIMIT_ROWS = 10
SNAPSHOT_TOLERANCE_DAYS = 14
TARGET_TENOR_DAYS = 730
FALLBACK_VOL = 0.30

# ---- fixed values: option fees ----
# (monthly contracts up to, ((premium below, rate per contract), ...)); None = no bound
COMMISSION_TIERS = (
    (10_000, ((0.05, 0.25), (0.10, 0.50), (None, 0.65))),
    (50_000, ((0.05, 0.25), (None, 0.50))),
    (100_000, ((None, 0.25),)),
    (None, ((None, 0.15),)),
)
COMMISSION_MINIMUM = 1.0
FEE_ORF, FEE_CAT, FEE_OCC, FEE_TAF, FEE_SEC = 0.02295, 0.0003, 0.025, 0.00329, 0.0000206

# ---- fixed values: symbol overrides, sector names, fine split of the financial sector ----
SYMBOL_OVERRIDES = {"BRK.B": "BRK B", "BF.B": "BF B"}
GICS_SECTOR = {
    "Information Technology": "Technologie",
    "Health Care": "Santé",
    "Financials": "Services financiers",
    "Consumer Discretionary": "Distribution",
    "Communication Services": "Medias",
    "Industrials": "Biens et services industriels",
    "Consumer Staples": "Agro-alimentaire et boissons",
    "Energy": "Pétrole et gaz",
    "Utilities": "Services aux collectivités",
    "Real Estate": "Immobilier",
    "Materials": "Matières premières",
}
FINANCIAL_SUB_INDUSTRY = {
    "Diversified Banks": "Banques",
    "Regional Banks": "Banques",
    "Commercial & Residential Mortgage Finance": "Banques",
    "Consumer Finance": "Banques",
    "Investment Banking & Brokerage": "Banques",
    "Asset Management & Custody Banks": "Banques",
    "Diversified Capital Markets": "Banques",
    "Diversified Financial Services": "Banques",
    "Life & Health Insurance": "Assurance",
    "Property & Casualty Insurance": "Assurance",
    "Multi-line Insurance": "Assurance",
    "Reinsurance": "Assurance",
    "Multi-Sector Holdings": "Assurance",
    "Transaction & Payment Processing Services": "Services financiers",
    "Data Processing & Outsourced Services": "Services financiers",
    "Financial Exchanges & Data": "Services financiers",
    "Insurance Brokers": "Services financiers",
}

# ---- fixed values: sector reclassifications (effective date, {symbol: sector before},
# {sector after: sector before}) ----
RECLASSIFICATIONS = (
    ("2016-09-16", {}, {"Immobilier": "Services financiers"}),
    ("2018-09-28", {
        "GOOGL": "Technologie", "GOOG": "Technologie", "META": "Technologie",
        "FB": "Technologie", "TWTR": "Technologie",
        "DIS": "Distribution", "CMCSA": "Distribution", "NFLX": "Distribution",
        "CHTR": "Distribution", "FOXA": "Distribution", "FOX": "Distribution",
        "NWSA": "Distribution", "NWS": "Distribution", "OMC": "Distribution",
        "IPG": "Distribution", "DISCA": "Distribution", "DISCK": "Distribution",
        "VIAB": "Distribution", "CBS": "Distribution", "DISH": "Distribution",
        "TRIP": "Distribution", "LYV": "Distribution", "MTCH": "Distribution",
        "EA": "Technologie", "ATVI": "Technologie", "TTWO": "Technologie",
    }, {}),
    ("2023-03-17", {
        "V": "Technologie", "MA": "Technologie", "PYPL": "Technologie",
        "FIS": "Technologie", "FISV": "Technologie", "FI": "Technologie",
        "GPN": "Technologie", "JKHY": "Technologie",
        "TGT": "Distribution", "DG": "Distribution", "DLTR": "Distribution",
    }, {}),
)

# ---- fixed values: reported-fact tags per metric, in order of preference ----
FACT_TAGS = {
    "revenue": [
        "Revenues",
        "RevenueFromContractWithCustomerExcludingAssessedTax",
        "RevenueFromContractWithCustomerIncludingAssessedTax",
        "SalesRevenueNet",
        "SalesRevenueGoodsNet",
        "SalesRevenueServicesNet",
    ],
    "ebit": ["OperatingIncomeLoss", "OperatingIncomeLossIncludingNoncontrollingInterest"],
    "pretax_income": [
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest",
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments",
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesNoncontrollingInterest",
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesDomestic",
    ],
    "gross_profit": ["GrossProfit"],
    "operating_expenses": ["OperatingExpenses", "OperatingCostsAndExpenses"],
    "costs_and_expenses": ["CostsAndExpenses", "BenefitsLossesAndExpenses"],
    "net_income": ["NetIncomeLoss", "ProfitLoss"],
    "total_assets": ["Assets"],
    "total_liabilities": ["Liabilities"],
    "cash": [
        "CashAndCashEquivalentsAtCarryingValue",
        "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents",
    ],
    "short_term_debt": ["DebtCurrent", "ShortTermBorrowings", "LongTermDebtCurrent"],
    "long_term_debt": ["LongTermDebtNoncurrent", "LongTermDebt"],
    "capex": [
        "PaymentsToAcquirePropertyPlantAndEquipment",
        "PaymentsToAcquireProductiveAssets",
        "CapitalExpenditures",
    ],
    "da": [
        "DepreciationDepletionAndAmortization",
        "DepreciationAmortizationAndAccretionNet",
        "DepreciationAndAmortization",
        "Depreciation",
    ],
    "income_tax_expense": ["IncomeTaxExpenseBenefit"],
    "interest_expense": ["InterestExpense", "InterestExpenseDebt", "InterestExpenseNonoperating"],
    "shares_outstanding": [
        "CommonStockSharesOutstanding", "dei:EntityCommonStockSharesOutstanding", "CommonStockSharesIssued",
    ],
    "current_assets": ["AssetsCurrent"],
    "current_liabilities": ["LiabilitiesCurrent"],
}
FLOW_METRICS = (
    "revenue", "ebit", "net_income", "capex", "da", "income_tax_expense", "interest_expense",
    "pretax_income", "gross_profit", "operating_expenses", "costs_and_expenses",
)
STOCK_METRICS = tuple(m for m in FACT_TAGS if m not in FLOW_METRICS)
COVER_PAGE_TAGS = ("dei:EntityCommonStockSharesOutstanding",)
QUARTER_DAYS = (60, 100)
ANNUAL_DAYS = (330, 400)
FISCAL_YEAR_CUTOFF_MONTH = 6

# ---- fixed values: spread report bands (lo inclusive, hi exclusive) ----
MONEYNESS_BANDS = ((0.0, 2.5), (2.5, 5.0), (5.0, 10.0), (10.0, 20.0), (20.0, 100.0))
TENOR_BANDS = ((0.0, 90.0), (90.0, 270.0), (270.0, 550.0), (550.0, 10000.0))


def table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A parameter table as a DataFrame; rows come from constants or a caller's config."""
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def rates(spark, by_year=None):
    return table(spark, (by_year or RISK_FREE_BY_YEAR).items(), "year int, rate double")


def inflation(spark, by_year=None):
    return table(spark, (by_year or INFLATION_BY_YEAR).items(), "year int, pct double")


def sector_dcf(spark, params=None):
    return table(spark, [(s, *p) for s, p in (params or SECTOR_DCF).items()],
                 "sector string, wacc double, fcf_growth double, terminal_growth double")


def dividend_yields(spark, table_=None):
    return table(spark, (table_ or DIVIDEND_YIELD).items(), "sector string, dividend_yield double")


def sector_multiples(spark, params=None):
    return table(spark, (params or SECTOR_MULTIPLES).items(), "sector string, applicable array<string>")


def fact_tags(spark, tags=None):
    rows = []
    for metric, specs in (tags or FACT_TAGS).items():
        for priority, spec in enumerate(specs):
            namespace, _, tag = spec.rpartition(":")
            rows.append((metric, priority, namespace or "us-gaap", tag,
                         metric in FLOW_METRICS, spec in COVER_PAGE_TAGS))
    return table(spark, rows, "metric string, priority int, namespace string, tag string, "
                              "is_flow boolean, cover_page boolean")


def commission_tiers(spark, tiers=None):
    """Tier grid flattened to half-open volume and premium intervals."""
    rows, low = [], None
    for high, bands in (tiers or COMMISSION_TIERS):
        below = None
        for premium, rate in bands:
            rows.append((low, float(high) if high is not None else None, below, premium, rate))
            below = premium
        low = float(high) if high is not None else None
    return table(spark, rows, "volume_over double, volume_upto double, premium_from double, "
                              "premium_below double, rate double")
