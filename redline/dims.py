"""Fixed vocabularies and the small dimension tables built from them.

The literal tables below are fixed values: results depend on them word for word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---- fixed values: section anchors and their display names -----------------------------------
ITEM_SECTIONS = {
    "item1_business": "Business (1)",
    "item1a_risk": "Risk Factors (1A)",
    "item1b_unresolved": "Unresolved Comments (1B)",
    "item1c_cybersecurity": "Cybersecurity (1C)",
    "item2_properties": "Properties (2)",
    "item3_legal": "Legal Proceedings (3)",
    "item4_safety": "Mine Safety (4)",
    "item5_market": "Market (5)",
    "item6_reserved": "Reserved (6)",
    "item7_mdna": "MD&A (7)",
    "item7a_market_risk": "Market Risk (7A)",
    "item8_financials": "Financials (8)",
    "item9_changes": "Changes in Accountants (9)",
    "item9a_controls": "Controls (9A)",
    "item9b_other": "Other Information (9B)",
    "item9c_foreign": "Foreign Jurisdictions (9C)",
    "item10_governance": "Governance (10)",
    "item11_compensation": "Compensation (11)",
    "item12_equity": "Equity (12)",
    "item13_relationships": "Relationships (13)",
    "item14_accountant": "Accountant Fees (14)",
    "item15_exhibits": "Exhibits (15)",
    "item16_summary": "Summary (16)",
}
STATEMENT_SECTIONS = {
    "income_statement": "Income Statement",
    "balance_sheet": "Balance Sheet",
    "cash_flow": "Cash Flow",
    "stockholders_equity": "Stockholders' Equity",
    "notes_to_financials": "Notes to Financials",
}
SECTION_NAMES = {**ITEM_SECTIONS, **STATEMENT_SECTIONS}

# ---- fixed values: the word that must follow an item number for its anchor --------------------
ITEM_KEYWORDS = {
    "item1_business": "business",
    "item1a_risk": "risk",
    "item1b_unresolved": "unresolved",
    "item1c_cybersecurity": "cybersecurity",
    "item2_properties": "properties",
    "item3_legal": "legal",
    "item4_safety": "safety",
    "item5_market": "market",
    "item6_reserved": "reserved",
    "item7_mdna": "management",
    "item7a_market_risk": "quantitative",
    "item8_financials": "financial",
    "item9_changes": "disagreements",
    "item9a_controls": "controls",
    "item9b_other": "other",
    "item9c_foreign": "foreign",
    "item10_governance": "directors",
    "item11_compensation": "compensation",
    "item12_equity": "security",
    "item13_relationships": "relationships",
    "item14_accountant": "accountant",
    "item15_exhibits": "exhibit",
    "item16_summary": "summary",
}

# ---- fixed values: item numbers whose section is certain even without the keyword --------------
UNAMBIGUOUS_ITEMS = ["1a", "1b", "1c", "7", "7a", "8", "9a", "9b", "9c"]

# ---- fixed values: headings without an item number, tried in this order (Java regex) ----------
HEADING_PATTERNS = [
    (r"^\s*Risk\s+Factors\s*$", "item1a_risk"),
    (r"^\s*Unresolved\s+Staff\s+Comments\s*$", "item1b_unresolved"),
    (r"^\s*Cybersecurity\s*$", "item1c_cybersecurity"),
    (r"^\s*Business\s*$", "item1_business"),
    (r"^\s*Properties\s*$", "item2_properties"),
    (r"^\s*Legal\s+Proceedings\s*$", "item3_legal"),
    (r"^\s*Mine\s+Safety\s+Disclosures\s*$", "item4_safety"),
    (r"^\s*Market\s+for\s+.*Common\s+Stock", "item5_market"),
    (r"^\[?\s*Reserved\s*\]?\s*$", "item6_reserved"),
    (r"Management\s*['’]s\s+Discussion\s+and\s+Analysis", "item7_mdna"),
    (r"^\s*Quantitative\s+and\s+Qualitative\s+Disclosures?\s+About\s+Market\s+Risk\s*$", "item7a_market_risk"),
    (r"Financial\s+Statements\s+and\s+Supplementary\s+Data", "item8_financials"),
    (r"Changes\s+in\s+and\s+Disagreements", "item9_changes"),
    (r"Controls\s+and\s+Procedures\s*$", "item9a_controls"),
    (r"Other\s+Information\s*$", "item9b_other"),
    (r"Disclosure\s+Regarding\s+Foreign\s+Jurisdictions", "item9c_foreign"),
    (r"Directors?,\s*Executive\s+Officers?", "item10_governance"),
    (r"Executive\s+Compensation\s*$", "item11_compensation"),
    (r"Security\s+Ownership\s+of\s+Certain\s+Beneficial\s+Owners", "item12_equity"),
    (r"Certain\s+Relationships\s+and\s+Related\s+Transactions", "item13_relationships"),
    (r"Principal\s+Account(ant|ing)\s+Fees", "item14_accountant"),
    (r"Exhibits?,\s*Financial\s+Statement\s+Schedules?\s*$", "item15_exhibits"),
]

# ---- fixed values: metadata lines that leak into extracted text (Java regex) -------------------
NOISE_LINE_PATTERNS = [
    r"^\?xml version",
    r"^XBRL Document Created with",
    r"^Copyright 20\d\d",
    r"^r:[a-f0-9-]+,g:",
    r"^https?://fasb\.org/",
    r"^us-gaap:[A-Z]",
    r"^\d{10}$",
    r"^(FY|P1Y|true|false)$",
]
DROPPED_ELEMENTS = ["script", "style", "ix:hidden", "ix:resources", "ix:header"]
REQUIRED_ANCHORS = ["item1a_risk", "item7_mdna", "item8_financials"]
FINANCIAL_ANCHORS = ["income_statement", "balance_sheet", "cash_flow"]

# ---- fixed values: reported metric tags and the statement each belongs to ----------------------
TAG_ANCHORS = {
    "ResearchAndDevelopmentExpense": "income_statement",
    "Revenues": "income_statement",
    "RevenueFromContractWithCustomerExcludingAssessedTax": "income_statement",
    "CostOfGoodsAndServicesSold": "income_statement",
    "GrossProfit": "income_statement",
    "OperatingIncomeLoss": "income_statement",
    "NetIncomeLoss": "income_statement",
    "EarningsPerShareBasic": "income_statement",
    "EarningsPerShareDiluted": "income_statement",
    "IncomeLossFromContinuingOperationsBeforeIncomeTaxes": "income_statement",
    "IncomeTaxExpenseBenefit": "income_statement",
    "SellingGeneralAndAdministrativeExpense": "income_statement",
    "Assets": "balance_sheet",
    "Liabilities": "balance_sheet",
    "StockholdersEquity": "balance_sheet",
    "CashAndCashEquivalentsAtCarryingValue": "balance_sheet",
    "AccountsReceivableNet": "balance_sheet",
    "AccountsReceivableNetCurrent": "balance_sheet",
    "InventoryNet": "balance_sheet",
    "PropertyPlantAndEquipmentNet": "balance_sheet",
    "LongTermDebtNoncurrent": "balance_sheet",
    "NetCashProvidedByUsedInOperatingActivities": "cash_flow",
    "NetCashProvidedByUsedInInvestingActivities": "cash_flow",
    "NetCashProvidedByUsedInFinancingActivities": "cash_flow",
    "PaymentsToAcquirePropertyPlantAndEquipment": "cash_flow",
    "RepurchaseOfCommonStock": "cash_flow",
    "PaymentsForRepurchaseOfCommonStock": "cash_flow",
    "PaymentsOfDividends": "cash_flow",
    "PaymentsOfDividendsCommonStock": "cash_flow",
}
TAG_LABELS = {
    "Revenues": "Revenue",
    "RevenueFromContractWithCustomerExcludingAssessedTax": "Revenue",
    "ResearchAndDevelopmentExpense": "R&D Expense",
    "CostOfGoodsAndServicesSold": "Cost of Revenue",
    "GrossProfit": "Gross Profit",
    "OperatingIncomeLoss": "Operating Income",
    "NetIncomeLoss": "Net Income",
    "IncomeLossFromContinuingOperationsBeforeIncomeTaxes": "Pre-Tax Income",
    "IncomeTaxExpenseBenefit": "Income Tax",
    "SellingGeneralAndAdministrativeExpense": "SG&A",
    "EarningsPerShareBasic": "EPS (Basic)",
    "EarningsPerShareDiluted": "EPS (Diluted)",
    "NetCashProvidedByUsedInOperatingActivities": "Operating Cash Flow",
    "NetCashProvidedByUsedInInvestingActivities": "Investing Cash Flow",
    "NetCashProvidedByUsedInFinancingActivities": "Financing Cash Flow",
    "PaymentsToAcquirePropertyPlantAndEquipment": "Capital Expenditure",
    "PaymentsForRepurchaseOfCommonStock": "Share Repurchases",
    "PaymentsOfDividends": "Dividends Paid",
    "Assets": "Total Assets",
    "Liabilities": "Total Liabilities",
    "StockholdersEquity": "Stockholders' Equity",
    "LongTermDebtNoncurrent": "Long-Term Debt",
    "CashAndCashEquivalentsAtCarryingValue": "Cash & Equivalents",
    "AccountsReceivableNetCurrent": "Accounts Receivable",
    "AccountsReceivableNet": "Accounts Receivable",
    "InventoryNet": "Inventory",
    "PropertyPlantAndEquipmentNet": "Property & Equipment",
}
PER_SHARE_TAGS = ["EarningsPerShareBasic", "EarningsPerShareDiluted"]
COST_TAGS = ["CostOfGoodsAndServicesSold", "IncomeTaxExpenseBenefit", "SellingGeneralAndAdministrativeExpense",
             "Liabilities", "LongTermDebtNoncurrent"]
STATEMENT_GROUPS = [
    ("Income Statement", [
        "RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "CostOfGoodsAndServicesSold",
        "GrossProfit", "ResearchAndDevelopmentExpense", "SellingGeneralAndAdministrativeExpense",
        "OperatingIncomeLoss", "IncomeLossFromContinuingOperationsBeforeIncomeTaxes",
        "IncomeTaxExpenseBenefit", "NetIncomeLoss", "EarningsPerShareBasic", "EarningsPerShareDiluted"]),
    ("Cash Flow", [
        "NetCashProvidedByUsedInOperatingActivities", "NetCashProvidedByUsedInInvestingActivities",
        "NetCashProvidedByUsedInFinancingActivities", "PaymentsToAcquirePropertyPlantAndEquipment",
        "PaymentsForRepurchaseOfCommonStock", "PaymentsOfDividends"]),
    ("Balance Sheet", [
        "Assets", "Liabilities", "StockholdersEquity", "CashAndCashEquivalentsAtCarryingValue",
        "AccountsReceivableNetCurrent", "InventoryNet", "PropertyPlantAndEquipmentNet",
        "LongTermDebtNoncurrent"]),
]
QUESTION_TAGS = ["ResearchAndDevelopmentExpense", "RevenueFromContractWithCustomerExcludingAssessedTax",
                 "NetIncomeLoss"]
REVENUE_FALLBACKS = ["Revenues"]
QUESTION_PHRASES = {
    "ResearchAndDevelopmentExpense": "research and development expense",
    "RevenueFromContractWithCustomerExcludingAssessedTax": "total revenue",
    "Revenues": "total revenue",
    "NetIncomeLoss": "net income",
    "Assets": "total assets",
    "NetCashProvidedByUsedInOperatingActivities": "net cash provided by operating activities",
}
STATEMENT_HEADINGS = {
    "income_statement": [
        "CONSOLIDATED STATEMENTS OF OPERATIONS", "CONSOLIDATED STATEMENT OF OPERATIONS",
        "CONSOLIDATED STATEMENTS OF INCOME", "CONSOLIDATED STATEMENT OF INCOME",
        "CONSOLIDATED STATEMENTS OF EARNINGS"],
    "balance_sheet": ["CONSOLIDATED BALANCE SHEETS", "CONSOLIDATED BALANCE SHEET"],
    "cash_flow": ["CONSOLIDATED STATEMENTS OF CASH FLOWS", "CONSOLIDATED STATEMENT OF CASH FLOWS"],
}

# ---- fixed values: report chapters --------------------------------------------------------------
CHAPTERS = [
    ("business", "The Business", ["item1_business", "item5_market"]),
    ("risk", "Risk Landscape", ["item1a_risk", "item7a_market_risk", "item1c_cybersecurity"]),
    ("mdna", "Management's Discussion", ["item7_mdna"]),
    ("legal", "Legal & Regulatory", ["item3_legal", "item9b_other"]),
]

# ---- fixed values: change classes, answer routes, evaluation axes -------------------------------
CLASSES = ["unchanged", "modified_minor", "modified_major", "added", "removed"]
CLASS_LABELS = {
    "unchanged": "Unchanged",
    "modified_minor": "Minor revision",
    "modified_major": "Major revision",
    "added": "Newly added",
    "removed": "Removed",
}
CHANGE_TYPES = ["added", "removed", "expanded", "softened", "strengthened", "reworded"]
MATERIALITIES = ["boilerplate", "notable", "material"]
ABSTAIN_PHRASES = [
    "not found in corpus",
    "cannot be found",
    "cannot find",
    "does not contain",
    "not available",
    "no information",
    "context does not",
    "not in the provided context",
    "i cannot find",
    "is not provided",
    "not mentioned",
]
WEB_TAGS = ["source: web", "[web]", "(web)"]
FAILURE_BUCKETS = ["retrieval_miss", "table_mangle", "wrong_abstention", "false_positive", "web_search_miss",
                   "wrong_routing", "generation_error"]
CHUNK_STRATEGIES = ["fixedsize", "sectionaware"]
EMBEDDING_MODELS = ["bge-small", "e5-small"]

# ---- fixed values: number words --------------------------------------------------------------------
WORD_SCALES = {"thousand": 1e3, "million": 1e6, "billion": 1e9, "trillion": 1e12}
LETTER_SCALES = {"k": 1e3, "m": 1e6, "b": 1e9, "t": 1e12}
NEGATIVE_WORDS = ["loss", "deficit", "decrease", "decline", "negative"]

# ---- fixed values: thresholds and sizes --------------------------------------------------------------
SIMILARITY_FLOOR = 0.50
UNCHANGED_AT, MINOR_AT, MAJOR_AT = 0.95, 0.81, 0.60
GUARD_PCT, GUARD_MIN_VALUE, GUARD_MAJOR_PCT = 0.20, 1.0, 1.00
TOP_K_RETRIEVE, TOP_K_FINAL = 20, 5
TOKENS_TO_CHARS = 4
FIXED_CHUNK_CHARS, FIXED_OVERLAP_CHARS, SNAP_WINDOW = 600 * 4, 50 * 4, 300
TARGET_CHUNK_CHARS, MAX_CHUNK_CHARS, MIN_CHUNK_CHARS = 350 * 4, 500 * 4, 100 * 4
GOLD_SPAN_CHARS = 4000
THIN_SECTION_ROWS = 8
MAX_EVIDENCE = 40
WORDS_PER_MINUTE = 220


def anchor_vocabulary() -> list[str]:
    """Every anchor a chunk may carry: named sections, statements and ``item<N>_unknown`` fallbacks."""
    numbers = [a[len("item"):a.index("_")] for a in ITEM_SECTIONS]
    return list(SECTION_NAMES) + ["item_unknown"] + [f"item{n}_unknown" for n in numbers]


def tag_dim(spark: SparkSession) -> DataFrame:
    """(tag_order, tag, anchor, label): at most one row per known metric tag."""
    rows = [(i, t, a, TAG_LABELS.get(t, t)) for i, (t, a) in enumerate(TAG_ANCHORS.items())]
    return spark.createDataFrame(rows, "tag_order int, tag string, anchor string, label string")


def statement_dim(spark: SparkSession, groups=None) -> DataFrame:
    """(group_order, title, tag_order, tag) in display order."""
    rows = [(g, title, i, tag)
            for g, (title, tags) in enumerate(groups or STATEMENT_GROUPS) for i, tag in enumerate(tags)]
    return spark.createDataFrame(rows, "group_order int, title string, tag_order int, tag string")


def chapter_dim(spark: SparkSession, chapters=None) -> DataFrame:
    """(chapter_order, chapter, title, anchor_order, anchor)."""
    rows = [(c, cid, title, i, a)
            for c, (cid, title, anchors) in enumerate(chapters or CHAPTERS) for i, a in enumerate(anchors)]
    return spark.createDataFrame(
        rows, "chapter_order int, chapter string, title string, anchor_order int, anchor string")
