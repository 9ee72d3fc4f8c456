"""Registered queries: posting, journal and ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillbook.functions.periods import on_date
from tillbook.operators import ledger, posting
from tillbook.plans.catalog import AS_OF, EMPTY_YEAR, MONTH, YEAR, YEAR_ONLY, query
from tillbook.plans.oracle_sql import oracle

J_COLS = ["entry_date", "description", "account_code", "debit", "credit", "reference_no", "line_no",
          "entry_kind"]
J_SQL = ("CAST(entry_date AS VARCHAR) AS entry_date, description, account_code, CAST(debit AS DOUBLE) AS debit, "
         "CAST(credit AS DOUBLE) AS credit, reference_no, CAST(line_no AS BIGINT) AS line_no, entry_kind")


def journal(m, month=None, year=None):
    """The journal of the model; with a period only that period's sales are
    posted (accruals and opening lines are always complete)."""
    return posting.build_journal(m, None, month, year)


def month_pred(col: str, month=None, year=None) -> str:
    if month and year:
        return f"EXTRACT(MONTH FROM {col}) = {month} AND EXTRACT(YEAR FROM {col}) = {year}"
    if year:
        return f"EXTRACT(YEAR FROM {col}) = {year}"
    return "TRUE"


def gl_cte(month=None, year=None) -> str:
    """Ledger of a period for the oracle: per-account sums of the period's
    journal lines, named from the chart, accounts without activity dropped."""
    return f"""
acct_sums AS (
  SELECT account_code, SUM(debit) AS debit, SUM(credit) AS credit
  FROM journal WHERE {month_pred('entry_date', month, year)}
  GROUP BY account_code),
gl AS (
  SELECT coa.code, coa.name, coa.account_type AS type, coa.normal_balance AS normal, a.debit, a.credit,
    CASE coa.normal_balance WHEN 'D' THEN a.debit - a.credit ELSE a.credit - a.debit END AS balance
  FROM acct_sums a JOIN chart_of_accounts coa ON coa.code = a.account_code
  WHERE a.debit > 0 OR a.credit > 0)"""


GL_SELECT = ("SELECT code, name, type, normal, CAST(debit AS DOUBLE) AS debit, CAST(credit AS DOUBLE) AS credit, "
             "CAST(balance AS DOUBLE) AS balance FROM gl")


@query("sale_totals", oracle("""
SELECT s.txn_id, CAST(s.subtotal AS DOUBLE) AS subtotal,
  CAST(ROUND(s.subtotal * 0.11, 0) AS DOUBLE) AS tax,
  CAST(s.subtotal + ROUND(s.subtotal * 0.11, 0) AS DOUBLE) AS total,
  CAST(g.cogs AS DOUBLE) AS cogs, CAST(g.lines AS BIGINT) AS n_lines
FROM sale_totals s JOIN (SELECT txn_id, SUM(cogs) AS cogs, SUM(n_lines) AS lines FROM cat GROUP BY txn_id) g
  ON g.txn_id = s.txn_id"""))
def q_sale_totals(m, spark):
    """I1 for every sale that has lines."""
    return posting.sale_totals(m["transaction_items"])


@query("post_sales", oracle(f"SELECT {J_SQL} FROM sales_journal"))
def q_post_sales(m, spark):
    """Journal lines of all sales."""
    return posting.post_sales(m["sale_headers"], m["transaction_items"]).select(*J_COLS)


@query("journal", oracle(f"SELECT {J_SQL} FROM journal"))
def q_journal(m, spark):
    """G1: sales postings, monthly accruals and opening lines in one table."""
    return journal(m).select(*J_COLS)


@query("accrue_fixed", oracle(f"SELECT {J_SQL} FROM accruals"))
def q_accrue_fixed(m, spark):
    """I4: fixed-cost accruals for every month from the first sale to the last."""
    return journal(m).filter(F.col("entry_kind") == "accrual").select(*J_COLS)


@query("opening_entries", oracle(f"SELECT {J_SQL} FROM opening"))
def q_opening(m, spark):
    """Opening balance lines dated at the first month of sales."""
    bounds = m["sale_headers"].agg(F.trunc(F.min("transaction_date"), "MM").alias("opening_date"))
    return posting.opening_entries(bounds).select(*J_COLS)


@query("unbalanced_receipts", oracle("""
SELECT reference_no, CAST(SUM(debit) AS DOUBLE) AS total_debit, CAST(SUM(credit) AS DOUBLE) AS total_credit,
  CAST(SUM(debit) - SUM(credit) AS DOUBLE) AS diff
FROM journal GROUP BY reference_no HAVING SUM(debit) <> SUM(credit)"""))
def q_unbalanced(m, spark):
    """Must be empty."""
    return posting.unbalanced_receipts(journal(m))


@query("unbalanced_after_loss", oracle(f"""
SELECT reference_no, CAST(SUM(debit) AS DOUBLE) AS total_debit, CAST(SUM(credit) AS DOUBLE) AS total_credit,
  CAST(SUM(debit) - SUM(credit) AS DOUBLE) AS diff
FROM journal WHERE account_code <> '2030' OR entry_date <> DATE '{AS_OF}' GROUP BY reference_no HAVING SUM(debit) <> SUM(credit)"""))
def q_unbalanced_after_loss(m, spark):
    """I3 with faults in the data: one day's VAT lines are missing from the journal."""
    lost = (F.col("account_code") == "2030") & (F.col("entry_date") == F.lit(AS_OF))
    return posting.unbalanced_receipts(journal(m).filter(~lost))


@query("general_ledger", oracle(GL_SELECT, gl_cte(MONTH, YEAR)))
def q_gl_month(m, spark):
    """I6 for one month."""
    return ledger.general_ledger(m["chart_of_accounts"], journal(m, MONTH, YEAR), MONTH, YEAR)


@query("general_ledger_year", oracle(GL_SELECT, gl_cte(None, YEAR_ONLY)))
def q_gl_year(m, spark):
    """I6 for one year."""
    return ledger.general_ledger(m["chart_of_accounts"], journal(m, None, YEAR_ONLY), None, YEAR_ONLY)


@query("general_ledger_all", oracle(GL_SELECT, gl_cte(None, None)))
def q_gl_all(m, spark):
    """I6 over the whole journal."""
    return ledger.general_ledger(m["chart_of_accounts"], journal(m))


@query("general_ledger_month_without_year", oracle(GL_SELECT, gl_cte(None, None)))
def q_gl_month_only(m, spark):
    """B2 edge: a month without a year is ignored (same as everything)."""
    return ledger.general_ledger(m["chart_of_accounts"], journal(m), MONTH, None)


@query("general_ledger_empty_period", oracle(GL_SELECT, gl_cte(None, EMPTY_YEAR)))
def q_gl_empty(m, spark):
    """I6 for a year without activity: no rows."""
    return ledger.general_ledger(m["chart_of_accounts"], journal(m, None, EMPTY_YEAR), None, EMPTY_YEAR)


@query("trial_balance", oracle("""
SELECT CAST(0 AS BIGINT) AS row_kind, code, name,
  CAST(CASE WHEN normal = 'D' AND balance > 0 THEN balance END AS DOUBLE) AS debit,
  CAST(CASE WHEN normal = 'K' AND balance > 0 THEN balance END AS DOUBLE) AS credit
FROM gl
UNION ALL
SELECT 1, '', 'TOTAL', CAST(COALESCE(SUM(CASE WHEN normal = 'D' THEN balance END), 0) AS DOUBLE),
  CAST(COALESCE(SUM(CASE WHEN normal = 'K' THEN balance END), 0) AS DOUBLE)
FROM gl""", gl_cte(MONTH, YEAR)))
def q_trial_balance(m, spark):
    """I7 for one month."""
    gl = ledger.general_ledger(m["chart_of_accounts"], journal(m, MONTH, YEAR), MONTH, YEAR)
    return ledger.trial_balance(gl)


@query("trial_balance_check", oracle("""
SELECT CAST(d AS DOUBLE) AS total_debit, CAST(k AS DOUBLE) AS total_credit, CAST(d - k AS DOUBLE) AS diff,
  ABS(d - k) < 1 AS balanced
FROM (SELECT COALESCE(SUM(CASE WHEN normal = 'D' THEN balance END), 0) AS d,
             COALESCE(SUM(CASE WHEN normal = 'K' THEN balance END), 0) AS k FROM gl)""", gl_cte(None, YEAR_ONLY)))
def q_tb_check(m, spark):
    """D9 for one year."""
    gl = ledger.general_ledger(m["chart_of_accounts"], journal(m, None, YEAR_ONLY), None, YEAR_ONLY)
    return ledger.trial_balance_check(gl)


@query("journal_balance_by_month", oracle("""
SELECT CAST(EXTRACT(YEAR FROM entry_date) AS BIGINT) AS year, CAST(EXTRACT(MONTH FROM entry_date) AS BIGINT) AS month,
  CAST(SUM(debit) AS DOUBLE) AS total_debit, CAST(SUM(credit) AS DOUBLE) AS total_credit,
  CAST(SUM(debit) - SUM(credit) AS DOUBLE) AS diff
FROM journal GROUP BY 1, 2"""))
def q_balance_by_month(m, spark):
    """D10."""
    return ledger.journal_balance_by_month(journal(m))


@query("journal_totals", oracle(f"""
SELECT COUNT(*) AS lines, CAST(COALESCE(SUM(debit), 0) AS DOUBLE) AS total_debit,
  CAST(COALESCE(SUM(credit), 0) AS DOUBLE) AS total_credit
FROM journal WHERE {month_pred('entry_date', MONTH, YEAR)}"""))
def q_journal_totals(m, spark):
    """D28 for one month."""
    return ledger.journal_totals(journal(m, MONTH, YEAR), MONTH, YEAR)


@query("sales_journal", oracle(f"""
SELECT {J_SQL}, CAST(CASE WHEN debit > 0 THEN debit END AS DOUBLE) AS debit_shown,
  CAST(CASE WHEN credit > 0 THEN credit END AS DOUBLE) AS credit_shown
FROM journal WHERE {month_pred('entry_date', MONTH, YEAR)}
ORDER BY entry_date DESC, reference_no DESC, line_no DESC LIMIT 500"""))
def q_sales_journal(m, spark):
    """Newest 500 lines of one month (the listing size is the feature)."""
    return ledger.sales_journal(journal(m, MONTH, YEAR), MONTH, YEAR, 500).select(*J_COLS, "debit_shown", "credit_shown")


@query("journal_for_receipts", oracle(f"""
SELECT j.reference_no, CAST(j.line_no AS BIGINT) AS line_no, CAST(j.entry_date AS VARCHAR) AS entry_date,
  j.description, j.account_code, c.name AS account_name, CAST(j.debit AS DOUBLE) AS debit,
  CAST(j.credit AS DOUBLE) AS credit
FROM journal j LEFT JOIN chart_of_accounts c ON c.code = j.account_code
WHERE j.reference_no IN (SELECT receipt_no FROM transactions WHERE transaction_date = DATE '{AS_OF}')"""))
def q_journal_for_receipts(m, spark):
    """Journal lines (with account names) of every receipt of one day."""
    from tillbook.sources.adapter import period_headers, sale_lines
    day = period_headers(m, day=AS_OF)
    refs = day.select(F.col("receipt_no").alias("reference_no"))
    # only sale postings carry receipt numbers: posting that day's sales gives every line of those receipts
    day_journal = posting.post_sales(day, sale_lines(m, day))
    return ledger.journal_for_receipts(day_journal, m["chart_of_accounts"], refs)


@query("cash_receipts_journal", oracle(f"""
SELECT txn_id, CAST(transaction_date AS VARCHAR) AS transaction_date, receipt_no, cashier_name, payment_method,
  CAST(total AS DOUBLE) AS dr_cash, CAST(subtotal AS DOUBLE) AS cr_revenue
FROM transactions WHERE {month_pred('transaction_date', MONTH, YEAR)}"""))
def q_cash_receipts_journal(m, spark):
    """I13 for one month."""
    from tillbook.sources.adapter import period_transactions
    return ledger.cash_receipts_journal(period_transactions(m, MONTH, YEAR), MONTH, YEAR)


@query("sale_category_revenue", oracle("""
SELECT txn_id, category, CAST(revenue AS DOUBLE) AS revenue, CAST(cogs AS DOUBLE) AS cogs,
  CAST(n_lines AS BIGINT) AS n_lines
FROM cat"""))
def q_sale_category_revenue(m, spark):
    """Revenue by category inside each sale."""
    return posting.category_lines(m["transaction_items"]).drop("first_seq")


@query("journal_with_footer", oracle(f"""
SELECT CAST(0 AS BIGINT) AS row_kind, CAST(entry_date AS VARCHAR) AS entry_date, description, account_code, reference_no,
  CAST(line_no AS BIGINT) AS line_no, CAST(debit AS DOUBLE) AS debit, CAST(credit AS DOUBLE) AS credit
FROM journal WHERE {month_pred('entry_date', MONTH, YEAR)}
UNION ALL
SELECT 1, NULL, 'TOTAL', NULL, NULL, 0, CAST(SUM(debit) AS DOUBLE), CAST(SUM(credit) AS DOUBLE)
FROM journal WHERE {month_pred('entry_date', MONTH, YEAR)}"""))
def q_journal_with_footer(m, spark):
    """One month's journal listing with its totals as the last row."""
    return ledger.with_footer(journal(m, MONTH, YEAR), MONTH, YEAR)
