"""Registered queries: period reports, statements, cash and dashboard figures."""

from __future__ import annotations


from pyspark.sql import functions as F

from tillbook.functions.formatting import rupiah
from tillbook.functions.periods import local_date, local_time, weekday_label
from tillbook.operators import reports
from tillbook.plans.catalog import AS_OF, EMPTY_YEAR, MONTH, YEAR, YEAR_ONLY, query
from tillbook.plans.oracle_sql import oracle
from tillbook.plans.q_ledger import month_pred


def summary_ctes(month=None, year=None) -> str:
    p = month_pred("transaction_date", month, year)
    return f"""
ps AS (SELECT * FROM cat WHERE txn_id IN (SELECT txn_id FROM transactions WHERE {p})),
rc AS (SELECT COALESCE(SUM(revenue), 0) AS total_revenue, COALESCE(SUM(cogs), 0) AS total_cogs FROM ps),
tc AS (SELECT COUNT(*) AS transaction_count FROM transactions WHERE {p}),
summary AS (
  SELECT rc.total_revenue, rc.total_cogs, rc.total_revenue - rc.total_cogs AS gross_profit,
    8500000 AS salary, 5000000 AS rent, 1800000 AS utilities, 600000 AS depreciation,
    ROUND(rc.total_revenue * 0.007, 0) AS payment_fee,
    15900000 + ROUND(rc.total_revenue * 0.007, 0) AS total_opex,
    rc.total_revenue - rc.total_cogs - (15900000 + ROUND(rc.total_revenue * 0.007, 0)) AS net_income,
    tc.transaction_count
  FROM rc, tc),
pay AS (
  SELECT COALESCE(SUM(CASE WHEN payment_method = 'Cash' THEN total END), 0) AS cash,
    COALESCE(SUM(CASE WHEN payment_method = 'QRIS' THEN total END), 0) AS qris,
    COALESCE(SUM(CASE WHEN payment_method = 'GoPay' THEN total END), 0) AS gopay,
    COALESCE(SUM(CASE WHEN payment_method = 'Debit' THEN total END), 0) AS debit,
    COUNT(CASE WHEN payment_method = 'Cash' THEN 1 END) AS n_cash,
    COUNT(CASE WHEN payment_method = 'QRIS' THEN 1 END) AS n_qris,
    COUNT(CASE WHEN payment_method = 'GoPay' THEN 1 END) AS n_gopay,
    COUNT(CASE WHEN payment_method = 'Debit' THEN 1 END) AS n_debit
  FROM transactions WHERE {p}),
sv AS (SELECT COALESCE(SUM(stock * cost), 0) AS stock_value FROM products WHERE active)"""


def pct_sql(num: str, den: str) -> str:
    return f"CASE WHEN {den} > 0 THEN ROUND({num} * 100 / {den}, 1) ELSE 0 END"


def lines_sql(rows, source: str, names: list[str], start: str = "0") -> str:
    """UNION ALL of statement lines: rows = [(text, ..., amount_expr)] with the
    text columns called ``names``."""
    parts = []
    for i, row in enumerate(rows):
        *texts, amount = row
        lits = ", ".join("'" + x.replace("'", "''") + f"' AS {n}" for x, n in zip(texts, names))
        parts.append(f"SELECT CAST({start} + {i + 1} AS BIGINT) AS line_no, {lits}, "
                     f"CAST(CAST({amount} AS DECIMAL(18,2)) AS DOUBLE) AS amount FROM {source}")
    return "\nUNION ALL\n".join(parts)


SUMMARY_SELECT = """
SELECT CAST(total_revenue AS DOUBLE) AS total_revenue, CAST(total_cogs AS DOUBLE) AS total_cogs,
  CAST(gross_profit AS DOUBLE) AS gross_profit, CAST(salary AS DOUBLE) AS salary, CAST(rent AS DOUBLE) AS rent,
  CAST(utilities AS DOUBLE) AS utilities, CAST(depreciation AS DOUBLE) AS depreciation,
  CAST(payment_fee AS DOUBLE) AS payment_fee, CAST(total_opex AS DOUBLE) AS total_opex,
  CAST(net_income AS DOUBLE) AS net_income, transaction_count FROM summary"""


@query("revenue_cogs", oracle("""
SELECT CAST(total_revenue AS DOUBLE) AS total_revenue, CAST(total_cogs AS DOUBLE) AS total_cogs FROM rc""",
                              summary_ctes(MONTH, YEAR)))
def q_revenue_cogs(m, spark):
    """D1/D2 for one month."""
    return reports.revenue_cogs(m, MONTH, YEAR)


@query("txn_count", oracle("SELECT transaction_count FROM tc", summary_ctes(None, YEAR_ONLY)))
def q_txn_count(m, spark):
    """D3 for one year."""
    return reports.txn_count(m, None, YEAR_ONLY)


@query("by_payment", oracle(f"""
SELECT payment_method, COUNT(*) AS count, CAST(SUM(total) AS DOUBLE) AS total
FROM transactions WHERE {month_pred('transaction_date', MONTH, YEAR)} GROUP BY payment_method"""))
def q_by_payment(m, spark):
    """D4 for one month."""
    return reports.by_payment(m, MONTH, YEAR)


@query("by_category", oracle("""
SELECT category, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM ps GROUP BY category""", summary_ctes(None, YEAR_ONLY)))
def q_by_category(m, spark):
    """D5 for one year."""
    return reports.by_category(m, None, YEAR_ONLY)


@query("daily_sales", oracle(f"""
SELECT CAST(transaction_date AS VARCHAR) AS date, CAST(SUM(total) AS DOUBLE) AS total, COUNT(*) AS count
FROM transactions WHERE {month_pred('transaction_date', MONTH, YEAR)} GROUP BY transaction_date"""))
def q_daily_sales(m, spark):
    """D6 for one month."""
    return reports.daily_sales(m, MONTH, YEAR)


@query("available_periods", oracle("""
SELECT DISTINCT CAST(EXTRACT(YEAR FROM transaction_date) AS BIGINT) AS year,
  CAST(EXTRACT(MONTH FROM transaction_date) AS BIGINT) AS month FROM transactions"""))
def q_available_periods(m, spark):
    """D7."""
    return reports.available_periods(m)


@query("report_summary", oracle(SUMMARY_SELECT, summary_ctes(MONTH, YEAR)))
def q_report_summary(m, spark):
    """I8 for one month."""
    return reports.report_summary(m, MONTH, YEAR)


@query("report_summary_year", oracle(SUMMARY_SELECT, summary_ctes(None, YEAR_ONLY)))
def q_report_summary_year(m, spark):
    """I8 for one year (opex stays flat per call)."""
    return reports.report_summary(m, None, YEAR_ONLY)


@query("report_summary_empty_period", oracle(SUMMARY_SELECT, summary_ctes(None, EMPTY_YEAR)))
def q_report_summary_empty(m, spark):
    """I8 for a period without sales: zeros, opex still charged."""
    return reports.report_summary(m, None, EMPTY_YEAR)


INCOME_TAIL = [
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
    ("Ratios", "Gross Margin %", pct_sql("gross_profit", "total_revenue")),
    ("Ratios", "Net Margin %", pct_sql("net_income", "total_revenue")),
]


def income_sql(month, year):
    ctes = summary_ctes(month, year) + """,
cats AS (SELECT category, SUM(revenue) AS revenue FROM ps GROUP BY category),
kc AS (SELECT COUNT(*) AS k FROM cats)"""
    body = ("SELECT CAST(row_number() OVER (ORDER BY revenue DESC, category) AS BIGINT) AS line_no, "
            "'Revenue' AS section, category || ' Revenue' AS label, "
            "CAST(CAST(revenue AS DECIMAL(18,2)) AS DOUBLE) AS amount FROM cats\nUNION ALL\n"
            + lines_sql(INCOME_TAIL, "summary, kc", ["section", "label"], start="kc.k"))
    return oracle(body, ctes)


@query("income_statement", income_sql(MONTH, YEAR))
def q_income_statement(m, spark):
    """I9 for one month."""
    return reports.income_statement(m, MONTH, YEAR)


@query("income_statement_year", income_sql(None, YEAR_ONLY))
def q_income_statement_year(m, spark):
    """I9 for one year."""
    return reports.income_statement(m, None, YEAR_ONLY)


CUR = "cash + (debit + 45000000) + qris + gopay + stock_value"
FIX = "18000000 - 600000"
LIA = "8200000 + ROUND(total_revenue * 0.11 / 1.11, 0)"
EQU = "150000000 + net_income"
BALANCE_ROWS = [
    ("Assets", "Current Assets", "Cash on Hand", "cash"),
    ("Assets", "Current Assets", "Bank BCA", "debit + 45000000"),
    ("Assets", "Current Assets", "QRIS Receivable", "qris"),
    ("Assets", "Current Assets", "GoPay Balance", "gopay"),
    ("Assets", "Current Assets", "Inventory", "stock_value"),
    ("Assets", "Current Assets", "Total Current Assets", CUR),
    ("Assets", "Fixed Assets", "Equipment (POS, Oven)", "18000000"),
    ("Assets", "Fixed Assets", "Accumulated Depreciation", "-600000"),
    ("Assets", "Fixed Assets", "Total Fixed Assets", FIX),
    ("Assets", "Assets", "Total Assets", f"{CUR} + {FIX}"),
    ("Liabilities & Equity", "Liabilities", "Accounts Payable", "8200000"),
    ("Liabilities & Equity", "Liabilities", "VAT Payable", "ROUND(total_revenue * 0.11 / 1.11, 0)"),
    ("Liabilities & Equity", "Liabilities", "Total Liabilities", LIA),
    ("Liabilities & Equity", "Equity", "Owner's Capital", "150000000"),
    ("Liabilities & Equity", "Equity", "Net Income", "net_income"),
    ("Liabilities & Equity", "Equity", "Total Equity", EQU),
    ("Liabilities & Equity", "Liabilities & Equity", "Total Liabilities & Equity", f"{LIA} + {EQU}"),
    ("Check", "Check", "Assets minus Liabilities & Equity", f"({CUR} + {FIX}) - ({LIA}) - ({EQU})"),
]


@query("balance_sheet", oracle(lines_sql(BALANCE_ROWS, "summary, pay, sv", ["side", "section", "label"]),
                               summary_ctes(MONTH, YEAR)))
def q_balance_sheet(m, spark):
    """I10 for one month."""
    return reports.balance_sheet(m, MONTH, YEAR)


CASH_FLOW_ROWS = [
    ("Operating Activities", "Customer receipts", "total_revenue"),
    ("Operating Activities", "Salary payments", "-8500000"),
    ("Operating Activities", "Rent payments", "-5000000"),
    ("Operating Activities", "Utilities", "-1800000"),
    ("Operating Activities", "Raw material purchases", "-(total_cogs + 2000000)"),
    ("Operating Activities", "Net Cash Flow", "total_revenue - 8500000 - 5000000 - 1800000 - (total_cogs + 2000000)"),
    ("Investing Activities", "Equipment purchases", "0"),
    ("Investing Activities", "Net Cash Flow", "0"),
    ("Financing Activities", "Additional capital", "0"),
    ("Financing Activities", "Net Cash Flow", "0"),
]


@query("cash_flow", oracle(lines_sql(CASH_FLOW_ROWS, "summary", ["section", "label"]),
                           summary_ctes(MONTH, YEAR)))
def q_cash_flow(m, spark):
    """I11 for one month."""
    return reports.cash_flow(m, MONTH, YEAR)


@query("cash_position", oracle("""
SELECT CAST(1 AS BIGINT) AS line_no, 'Cash' AS payment_method, '1010' AS account_code, n_cash AS count,
  CAST(cash AS DOUBLE) AS amount FROM pay
UNION ALL SELECT 2, 'QRIS', '1030', n_qris, CAST(qris AS DOUBLE) FROM pay
UNION ALL SELECT 3, 'GoPay', '1040', n_gopay, CAST(gopay AS DOUBLE) FROM pay
UNION ALL SELECT 4, 'Debit', '1020', n_debit, CAST(debit + 45000000 AS DOUBLE) FROM pay
UNION ALL SELECT 5, 'TOTAL', '', n_cash + n_qris + n_gopay + n_debit,
  CAST(cash + qris + gopay + debit + 45000000 AS DOUBLE) FROM pay""", summary_ctes(MONTH, YEAR)))
def q_cash_position(m, spark):
    """I12 for one month."""
    return reports.cash_position(m, MONTH, YEAR)


@query("cash_by_method", oracle(f"""
SELECT COALESCE(m.payment_method, d.payment_method) AS payment_method, COALESCE(d.cnt, 0) AS count,
  CAST(COALESCE(d.amt, 0) AS DOUBLE) AS amount
FROM (VALUES ('Cash'), ('QRIS'), ('GoPay'), ('Debit')) AS m(payment_method)
FULL OUTER JOIN (SELECT payment_method, COUNT(*) AS cnt, SUM(total) AS amt FROM transactions
                 WHERE transaction_date = DATE '{AS_OF}' GROUP BY payment_method) d
  ON d.payment_method = m.payment_method
UNION ALL
SELECT 'TOTAL', COUNT(*), CAST(COALESCE(SUM(total), 0) AS DOUBLE) FROM transactions
WHERE transaction_date = DATE '{AS_OF}'"""))
def q_cash_by_method(m, spark):
    """One day's receipts per method and grand total."""
    return reports.cash_by_method(m, AS_OF)


@query("avg_ticket", oracle("""
SELECT CAST(CASE WHEN transaction_count > 0 THEN ROUND(total_revenue / transaction_count, 2) ELSE 0 END
  AS DOUBLE) AS avg_ticket FROM summary""", summary_ctes(None, YEAR_ONLY)))
def q_avg_ticket(m, spark):
    """D31 for one year."""
    return reports.avg_ticket(m, None, YEAR_ONLY)


@query("analytics", oracle(f"""
SELECT CAST(CASE WHEN transaction_count > 0 THEN ROUND(total_revenue / transaction_count, 2) ELSE 0 END
  AS DOUBLE) AS avg_ticket,
  CAST({pct_sql('gross_profit', 'total_revenue')} AS DOUBLE) AS gross_margin_pct,
  CAST({pct_sql('net_income', 'total_revenue')} AS DOUBLE) AS net_margin_pct, transaction_count
FROM summary""", summary_ctes(MONTH, YEAR)))
def q_analytics(m, spark):
    """I23 for one month."""
    return reports.analytics(m, MONTH, YEAR)


@query("txn_gross_margin", oracle(f"""
SELECT t.txn_id, t.receipt_no, CAST(t.subtotal AS DOUBLE) AS subtotal, CAST(COALESCE(g.cogs, 0) AS DOUBLE) AS cogs,
  CAST({pct_sql('(t.subtotal - COALESCE(g.cogs, 0))', 't.subtotal')} AS DOUBLE) AS gross_margin_pct
FROM transactions t LEFT JOIN txn_cogs g ON g.txn_id = t.txn_id"""))
def q_txn_gross_margin(m, spark):
    """D30 for every sale."""
    return reports.txn_gross_margin(m)


@query("today_kpi", oracle(f"""
SELECT CAST(COALESCE(SUM(total), 0) AS DOUBLE) AS today_total, COUNT(*) AS today_count
FROM transactions WHERE transaction_date = DATE '{AS_OF}'"""))
def q_today_kpi(m, spark):
    """D32."""
    return reports.today_kpi(m, AS_OF)


DASHBOARD_SQL = oracle(f"""
SELECT CAST(s.total_revenue AS DOUBLE) AS total_revenue, s.transaction_count,
  CAST(d.today_total AS DOUBLE) AS today_total, d.today_count, CAST(s.net_income AS DOUBLE) AS net_income,
  CAST({pct_sql('s.net_income', 's.total_revenue')} AS DOUBLE) AS net_margin_pct, l.low_stock_count
FROM summary s,
  (SELECT COALESCE(SUM(total), 0) AS today_total, COUNT(*) AS today_count FROM transactions
   WHERE transaction_date = DATE '{AS_OF}') d,
  (SELECT COUNT(*) AS low_stock_count FROM products WHERE active AND stock <= reorder_point) l""",
                       summary_ctes(MONTH, YEAR))


@query("dashboard_kpis", DASHBOARD_SQL)
def q_dashboard_kpis(m, spark):
    """I22 KPI row."""
    return reports.dashboard_kpis(m, AS_OF, MONTH, YEAR)


def trend_sql(month, year):
    return oracle(f"""
SELECT CAST(d.date AS VARCHAR) AS date, strftime(d.date, '%a') AS label,
  CAST(COALESCE(x.total, 0) AS DOUBLE) AS total, COALESCE(x.cnt, 0) AS count
FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '{AS_OF}' - INTERVAL 6 DAY, TIMESTAMP '{AS_OF}',
        INTERVAL 1 DAY)) AS DATE) AS date) d
LEFT JOIN (SELECT transaction_date, SUM(total) AS total, COUNT(*) AS cnt FROM transactions
           WHERE {month_pred('transaction_date', month, year)} GROUP BY transaction_date) x
  ON x.transaction_date = d.date""")


@query("weekly_trend", trend_sql(MONTH, YEAR))
def q_weekly_trend(m, spark):
    """Seven days to as_of from the period-filtered daily series."""
    return reports.weekly_trend(m, AS_OF, MONTH, YEAR)


@query("weekly_trend_other_period", trend_sql(None, YEAR_ONLY))
def q_weekly_trend_other(m, spark):
    """C8 edge: the chosen period excludes the week, so every day shows 0."""
    return reports.weekly_trend(m, AS_OF, None, YEAR_ONLY)


@query("stock_value", oracle("SELECT CAST(stock_value AS DOUBLE) AS stock_value FROM sv",
                             summary_ctes(None, None)))
def q_stock_value(m, spark):
    """D20."""
    return reports.stock_value(m["products"])


@query("daily_sales_bars", oracle(f"""
SELECT date, total, count,
  CAST(CASE WHEN mx > 0 THEN LEAST(100, ROUND(total * 100 / mx, 1)) ELSE 0 END AS DOUBLE) AS bar_pct
FROM (SELECT CAST(transaction_date AS VARCHAR) AS date, CAST(SUM(total) AS DOUBLE) AS total, COUNT(*) AS count,
        MAX(SUM(total)) OVER () AS mx, SUM(total) AS t0
      FROM transactions WHERE {month_pred('transaction_date', MONTH, YEAR)} GROUP BY transaction_date)"""))
def q_daily_sales_bars(m, spark):
    """Daily series with chart bar lengths relative to the largest day."""
    return reports.bar_ratio(reports.daily_sales(m, MONTH, YEAR), "total")


@query("income_statement_empty_period", income_sql(None, EMPTY_YEAR))
def q_income_statement_empty(m, spark):
    """I9 edge: a period without sales has no category lines, zero revenue,
    the flat operating expenses and 0 % margins."""
    return reports.income_statement(m, None, EMPTY_YEAR)


@query("balance_sheet_year", oracle(lines_sql(BALANCE_ROWS, "summary, pay, sv", ["side", "section", "label"]),
                                    summary_ctes(None, YEAR_ONLY)))
def q_balance_sheet_year(m, spark):
    """I10 for one year."""
    return reports.balance_sheet(m, None, YEAR_ONLY)


@query("sales_by_label", oracle("""
SELECT strftime(transaction_date, '%B %Y') AS month_label, strftime(transaction_date, '%a') AS day_label, COUNT(*) AS sales,
  'Rp ' || replace(CAST(CAST(ROUND(SUM(total), 0) AS DECIMAL(38,0)) AS VARCHAR), ' ', '') AS total_plain
FROM transactions GROUP BY 1, 2"""))
def q_sales_by_label(m, spark):
    """Sales per month and weekday under their display labels."""
    d = F.col("transaction_date")
    return (m["transactions"].groupBy(F.date_format(d, "MMMM yyyy").alias("month_label"), weekday_label("transaction_date").alias("day_label"))
            .agg(F.count(F.lit(1)).alias("sales"),
                 F.concat(F.lit("Rp "), F.round(F.sum("total"), 0).cast("decimal(38,0)").cast("string")).alias("total_plain")))


@query("sale_amount_text", oracle("""
SELECT txn_id, 'Rp ' || replace(printf('%,d', CAST(ROUND(total, 0) AS BIGINT)), ',', '.') AS shown FROM transactions"""))
def q_sale_amount_text(m, spark):
    """Every sale's total as currency text."""
    return m["transactions"].select("txn_id", rupiah(F.col("total")).alias("shown"))


@query("sale_local_clock", oracle("""
SELECT txn_id, CAST(CAST(transaction_date + CAST(transaction_time AS TIME) + INTERVAL 7 HOUR AS DATE) AS VARCHAR) AS local_date,
  strftime(transaction_date + CAST(transaction_time AS TIME) + INTERVAL 7 HOUR, '%H:%M:%S') AS local_time FROM transactions"""))
def q_sale_local_clock(m, spark):
    """The business clock (seven hours ahead) of every sale's instant read as UTC."""
    at = F.to_timestamp(F.concat_ws(" ", F.col("transaction_date").cast("string"), "transaction_time"))
    return m["sale_headers"].select("txn_id", local_date(at).alias("local_date"), local_time(at).alias("local_time"))
