"""SQL text shared by the DuckDB oracle strings in ``tillbook.plans.catalog``.

The model views (``MODEL_CTES``) and the journal (``JOURNAL_CTES``) are
spelled out as CTEs so each oracle string runs stand-alone on the driver's
pre-registered Parquet views.  Outputs are cast the same way the Spark side
presents them: money as DOUBLE (after exact decimal arithmetic), dates as
ISO text, integers as BIGINT.
"""

from __future__ import annotations

from tillbook.sources.adapter import MODEL_CTES

CASH_ACCOUNT_SQL = ("CASE {c} WHEN 'Cash' THEN '1010' WHEN 'QRIS' THEN '1030' WHEN 'GoPay' THEN '1040' "
                    "WHEN 'Debit' THEN '1020' ELSE '1010' END")
REVENUE_ACCOUNT_SQL = ("CASE {c} WHEN 'Bread' THEN '4010' WHEN 'Pastry' THEN '4020' WHEN 'Cake' THEN '4030' "
                       "WHEN 'Beverage' THEN '4040' ELSE '4010' END")

JOURNAL_CTES = """
cat AS (
  SELECT txn_id, COALESCE(category, 'Unknown') AS category, CAST(COALESCE(SUM(line_total), 0) AS DECIMAL(14,2)) AS revenue,
    CAST(COALESCE(SUM(unit_cost * quantity), 0) AS DECIMAL(14,2)) AS cogs, MIN(line_seq) AS first_seq, COUNT(*) AS n_lines
  FROM transaction_items GROUP BY txn_id, COALESCE(category, 'Unknown')),
cat_n AS (
  SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY first_seq) AS k FROM cat),
txn_cogs AS (
  SELECT txn_id, CAST(SUM(cogs) AS DECIMAL(14,2)) AS cogs, COUNT(*) AS n FROM cat GROUP BY txn_id),
sales_journal AS (
  SELECT t.transaction_date AS entry_date, 'Sale ' || t.receipt_no AS description,
    """ + CASH_ACCOUNT_SQL.format(c="t.payment_method") + """ AS account_code,
    CAST(t.total AS DECIMAL(14,2)) AS debit, CAST(0 AS DECIMAL(14,2)) AS credit, t.receipt_no AS reference_no,
    1 AS line_no, 'sale' AS entry_kind
  FROM transactions t
  UNION ALL
  SELECT t.transaction_date, c.category || ' Revenue ' || t.receipt_no,
    """ + REVENUE_ACCOUNT_SQL.format(c="c.category") + """,
    CAST(0 AS DECIMAL(14,2)), c.revenue, t.receipt_no, CAST(1 + c.k AS INTEGER), 'sale'
  FROM cat_n c JOIN transactions t ON t.txn_id = c.txn_id
  UNION ALL
  SELECT t.transaction_date, 'VAT ' || t.receipt_no, '2030', CAST(0 AS DECIMAL(14,2)), t.tax, t.receipt_no,
    CAST(2 + COALESCE(g.n, 0) AS INTEGER), 'sale'
  FROM transactions t LEFT JOIN txn_cogs g ON g.txn_id = t.txn_id
  UNION ALL
  SELECT t.transaction_date, 'COGS ' || t.receipt_no, '5010', COALESCE(g.cogs, 0), CAST(0 AS DECIMAL(14,2)),
    t.receipt_no, CAST(3 + COALESCE(g.n, 0) AS INTEGER), 'sale'
  FROM transactions t LEFT JOIN txn_cogs g ON g.txn_id = t.txn_id
  UNION ALL
  SELECT t.transaction_date, 'Inventory reduction ' || t.receipt_no, '1220', CAST(0 AS DECIMAL(14,2)),
    COALESCE(g.cogs, 0), t.receipt_no, CAST(4 + COALESCE(g.n, 0) AS INTEGER), 'sale'
  FROM transactions t LEFT JOIN txn_cogs g ON g.txn_id = t.txn_id),
bounds AS (
  SELECT MIN(transaction_date) AS first_day, MAX(transaction_date) AS last_day FROM transactions),
months AS (
  SELECT CAST(unnest(generate_series(CAST(date_trunc('month', first_day) AS TIMESTAMP),
    CAST(date_trunc('month', last_day) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS month_start,
    last_day AS as_of
  FROM bounds),
fixed_costs AS (
  SELECT * FROM (VALUES ('Salary Expense', 'Salary Payable', 8500000, '6010', '2010', 1), ('Rent Expense', 'Rent Paid', 5000000, '6020', '1010', 2),
    ('Utilities Expense', 'Utilities Paid', 1800000, '6030', '1010', 3),
    ('Depreciation Expense', 'Accumulated Depreciation', 600000, '6040', '1520', 4))
    AS fc(exp_text, ctr_text, amount, exp_account, ctr_account, cost_no)),
accrual_base AS (
  SELECT m.month_start, m.as_of, fc.*, (m.month_start < date_trunc('month', m.as_of)) AS full_month,
    CASE WHEN m.month_start < date_trunc('month', m.as_of) THEN last_day(m.month_start) ELSE m.as_of END
      AS entry_date,
    CAST(CASE WHEN m.month_start < date_trunc('month', m.as_of) THEN fc.amount
      ELSE ROUND(fc.amount * day(m.as_of) / day(last_day(m.month_start)), 0) END AS DECIMAL(14,2)) AS amt
  FROM months m, fixed_costs fc
  WHERE m.month_start <= date_trunc('month', m.as_of)),
accruals AS (
  SELECT entry_date, exp_text || ' ' || strftime(month_start, '%B %Y') AS description,
    exp_account AS account_code, amt AS debit, CAST(0 AS DECIMAL(14,2)) AS credit,
    'ADJ-' || upper(strftime(month_start, '%b-%Y')) || '-' || lpad(CAST(cost_no AS VARCHAR), 2, '0') AS reference_no,
    1 AS line_no, 'accrual' AS entry_kind
  FROM accrual_base
  UNION ALL
  SELECT entry_date, ctr_text || ' ' || strftime(month_start, '%B %Y'), ctr_account,
    CAST(0 AS DECIMAL(14,2)), amt,
    'ADJ-' || upper(strftime(month_start, '%b-%Y')) || '-' || lpad(CAST(cost_no AS VARCHAR), 2, '0'), 2, 'accrual'
  FROM accrual_base),
opening AS (
  SELECT CAST(date_trunc('month', b.first_day) AS DATE) AS entry_date, o.description, o.account_code,
    CAST(o.debit AS DECIMAL(14,2)) AS debit, CAST(o.credit AS DECIMAL(14,2)) AS credit, o.reference_no,
    o.line_no, 'opening' AS entry_kind
  FROM bounds b, (VALUES ('OPN-001', 'Opening Balance — Cash', '1010', 150000000, 0, 1),
    ('OPN-002', 'Opening Balance — Equipment', '1510', 18000000, 0, 2),
    ('OPN-001', 'Opening Balance — Owner Capital', '3010', 0, 150000000, 3),
    ('OPN-002', 'Opening Balance — Equipment Capital', '3010', 0, 18000000, 4))
    AS o(reference_no, description, account_code, debit, credit, line_no)),
journal AS (
  SELECT * FROM sales_journal UNION ALL SELECT * FROM accruals UNION ALL SELECT * FROM opening)
"""


def oracle(final_sql: str, extra_ctes: str = "") -> str:
    """A complete DuckDB statement: model + journal CTEs, extra CTEs, final query."""
    extra = f",\n{extra_ctes.strip().rstrip(',')}" if extra_ctes.strip() else ""
    return f"WITH {MODEL_CTES.strip()},\n{JOURNAL_CTES.strip()}{extra}\n{final_sql.strip()}"
