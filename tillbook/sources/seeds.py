"""Fixed dimension data of the accounting model (A5).

These are tiny constant tables (21 accounts, 4+4 map entries, 4 cost lines):
their size is bounded by the model, not by the data, so every join against
them may broadcast.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the modelled business for right results.
# Chart of accounts: (code, name, account_type, normal_balance); D = debit side,
# K = credit side.
CHART_OF_ACCOUNTS = [
    ("1010", "Cash on Hand", "Asset", "D"),
    ("1020", "Bank BCA", "Asset", "D"),
    ("1030", "QRIS Receivable", "Asset", "D"),
    ("1040", "GoPay Balance", "Asset", "D"),
    ("1220", "Inventory", "Asset", "D"),
    ("1510", "Equipment", "Asset", "D"),
    ("1520", "Accumulated Depreciation", "Asset", "K"),
    ("2010", "Accounts Payable", "Liability", "K"),
    ("2030", "Tax Payable (VAT)", "Liability", "K"),
    ("3010", "Owners Capital", "Equity", "K"),
    ("3020", "Retained Earnings", "Equity", "K"),
    ("4010", "Bread Revenue", "Revenue", "K"),
    ("4020", "Pastry Revenue", "Revenue", "K"),
    ("4030", "Cake Revenue", "Revenue", "K"),
    ("4040", "Beverage Revenue", "Revenue", "K"),
    ("5010", "COGS - Raw Materials", "Expense", "D"),
    ("6010", "Salary Expense", "Expense", "D"),
    ("6020", "Rent Expense", "Expense", "D"),
    ("6030", "Utilities Expense", "Expense", "D"),
    ("6040", "Depreciation Expense", "Expense", "D"),
    ("6050", "QRIS/MDR Fee", "Expense", "D"),
]
# Payment method -> cash account; unknown methods fall back to 1010.
CASH_ACCOUNT = {"Cash": "1010", "QRIS": "1030", "GoPay": "1040", "Debit": "1020"}
DEFAULT_CASH_ACCOUNT = "1010"
# Product category -> revenue account; unknown categories fall back to 4010.
REVENUE_ACCOUNT = {"Bread": "4010", "Pastry": "4020", "Cake": "4030", "Beverage": "4040"}
DEFAULT_REVENUE_ACCOUNT = "4010"
VAT_ACCOUNT = "2030"
COGS_ACCOUNT = "5010"
INVENTORY_ACCOUNT = "1220"
VAT_RATE = Decimal("0.11")
PAYMENT_FEE_RATE = Decimal("0.007")
# Monthly fixed costs: (kind, amount, expense account, counter account).
FIXED_COSTS = [
    ("Salary", Decimal("8500000"), "6010", "2010"),
    ("Rent", Decimal("5000000"), "6020", "1010"),
    ("Utilities", Decimal("1800000"), "6030", "1010"),
    ("Depreciation", Decimal("600000"), "6040", "1520"),
]
# Descriptions of the two lines of a fixed-cost accrual, before the month's name and year.
ACCRUAL_TEXT = {"Salary": ("Salary Expense", "Salary Payable"), "Rent": ("Rent Expense", "Rent Paid"),
                "Utilities": ("Utilities Expense", "Utilities Paid"),
                "Depreciation": ("Depreciation Expense", "Accumulated Depreciation")}
# Opening balance lines: (reference, description, account, debit, credit).
OPENING_LINES = [
    ("OPN-001", "Opening Balance — Cash", "1010", Decimal("150000000"), Decimal("0")),
    ("OPN-002", "Opening Balance — Equipment", "1510", Decimal("18000000"), Decimal("0")),
    ("OPN-001", "Opening Balance — Owner Capital", "3010", Decimal("0"), Decimal("150000000")),
    ("OPN-002", "Opening Balance — Equipment Capital", "3010", Decimal("0"), Decimal("18000000")),
]
# Balance-sheet constants of the statements screen.
BANK_BASE = Decimal("45000000")
EQUIPMENT_VALUE = Decimal("18000000")
ACCOUNTS_PAYABLE = Decimal("8200000")
OWNER_CAPITAL = Decimal("150000000")
MATERIAL_PURCHASE_EXTRA = Decimal("2000000")
# Enumerations of the schema.
PAYMENT_METHODS = ["Cash", "QRIS", "GoPay", "Debit"]
PRODUCT_CATEGORIES = ["Bread", "Pastry", "Cake", "Beverage"]
MOVEMENT_TYPES = ["Sale", "Restock", "Adjustment", "Damage", "Return"]
ACCOUNT_TYPES = ["Asset", "Liability", "Equity", "Revenue", "Expense"]
NORMAL_SIDES = ["D", "K"]
MATERIAL_CATEGORIES = ["Flour & Grain", "Dairy & Eggs", "Fat & Oil", "Sugar & Sweetener",
                       "Fruit & Filling", "Flavoring", "Packaging", "Beverage Base"]
# Journal line descriptions of a posted sale (text around the receipt number / category).
SALE_LINE_TEXT = "Sale "
REVENUE_LINE_TEXT = " Revenue "
VAT_LINE_TEXT = "VAT "
COGS_LINE_TEXT = "COGS "
INVENTORY_LINE_TEXT = "Inventory reduction "
# Income statement lines after the category lines: section, label, figure.
INCOME_LINES = [
    ("Revenue", "Total Revenue", "total_revenue"),
    ("Cost of Goods Sold", "COGS - Raw Materials", "total_cogs"),
    ("Cost of Goods Sold", "Gross Profit", "gross_profit"),
    ("Operating Expenses", "Salary Expense", "salary"),
    ("Operating Expenses", "Rent Expense", "rent"),
    ("Operating Expenses", "Utilities Expense", "utilities"),
    ("Operating Expenses", "Depreciation Expense", "depreciation"),
    ("Operating Expenses", "QRIS/MDR Fee", "payment_fee"),
    ("Operating Expenses", "Total Expenses", "total_opex"),
    ("Net Income", "NET INCOME", "net_income"),
    ("Ratios", "Gross Margin %", "gross_margin"),
    ("Ratios", "Net Margin %", "net_margin"),
]
# Balance sheet line labels.
BALANCE_LABELS = {
    "current": ["Cash on Hand", "Bank BCA", "QRIS Receivable", "GoPay Balance", "Inventory"],
    "fixed": ["Equipment (POS, Oven)", "Accumulated Depreciation"],
    "liabilities": ["Accounts Payable", "VAT Payable"],
    "equity": ["Owner's Capital", "Net Income"],
}
# Where-used label: first three names, then " +<n> lagi" for the rest.
MORE_NAMES_SUFFIX = " lagi"
# Currency display prefix.
CURRENCY_PREFIX = "Rp "
# Defaults applied when a new master row omits a value.
PRODUCT_DEFAULTS = {"supplier": "", "stock": 0, "reorder_point": 5, "cost": Decimal("0")}
MATERIAL_DEFAULTS = {"supplier": "", "stock_qty": Decimal("0"), "reorder_point": Decimal("5"),
                     "unit_cost": Decimal("0")}
# ---------------------------------------------------------------------------

COA_SCHEMA = T.StructType([
    T.StructField("code", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("account_type", T.StringType(), False),
    T.StructField("normal_balance", T.StringType(), False),
])


def chart_of_accounts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHART_OF_ACCOUNTS, COA_SCHEMA)


def seed_dims(spark: SparkSession) -> dict[str, DataFrame]:
    """A5: the constant table that plans join; the account maps and amounts are literals in the expressions."""
    return {"chart_of_accounts": chart_of_accounts(spark)}


def coa_values_sql() -> str:
    """The chart of accounts as a SQL VALUES list (for the DuckDB oracle)."""
    rows = ",\n    ".join(f"('{c}', '{n}', '{t}', '{s}')" for c, n, t, s in CHART_OF_ACCOUNTS)
    return f"(VALUES\n    {rows}) AS coa(code, name, account_type, normal_balance)"
