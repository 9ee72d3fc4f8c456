"""Registered queries: listings, nested results (as digests), alignment, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillbook.functions.formatting import receipt_code
from tillbook.functions.periods import on_date
from tillbook.operators import listings as ls
from tillbook.plans.catalog import AS_OF, YEAR_ONLY, query
from tillbook.plans.oracle_sql import oracle
from tillbook.plans.q_ledger import journal, month_pred

HDR_COLS = ["txn_id", "transaction_date", "transaction_time", "receipt_no", "payment_method", "subtotal", "tax",
            "total"]
HDR_SQL = ("p.txn_id, CAST(p.transaction_date AS VARCHAR) AS transaction_date, p.transaction_time, p.receipt_no, "
           "p.payment_method, CAST(p.subtotal AS DOUBLE) AS subtotal, CAST(p.tax AS DOUBLE) AS tax, "
           "CAST(p.total AS DOUBLE) AS total")
HDR_GROUP = "p.txn_id, p.transaction_date, p.transaction_time, p.receipt_no, p.payment_method, p.subtotal, p.tax, p.total"


def digest_sql(fields: list[str], alias: str = "i") -> str:
    parts = " || ':' || ".join(f"COALESCE(CAST({alias}.{f} AS VARCHAR), '~')" for f in fields)
    return f"string_agg({parts}, '|' ORDER BY {alias}.line_seq)"


PAGE_FIELDS = ["line_seq", "product_id", "quantity", "line_total"]
PAGE_LIMIT, PAGE_OFFSET = 500, 100


def page_sql(where: str, limit: int, offset: int) -> str:
    return oracle(f"""
SELECT {HDR_SQL}, COUNT(*) AS n_items, {digest_sql(PAGE_FIELDS)} AS items_digest,
  {offset} + row_number() OVER (ORDER BY p.transaction_date DESC, p.transaction_time DESC, p.txn_id) AS row_no
FROM page p LEFT JOIN transaction_items i ON i.txn_id = p.txn_id
GROUP BY {HDR_GROUP} ORDER BY row_no""", f"""
page AS (SELECT * FROM transactions WHERE {where}
         ORDER BY transaction_date DESC, transaction_time DESC, txn_id LIMIT {limit} OFFSET {offset})""")


def page_rows(page):
    return page.select(*HDR_COLS, F.size("items").alias("n_items"),
                       ls.items_digest(F.col("items"), PAGE_FIELDS).alias("items_digest"), "row_no")


@query("transactions_page", page_sql(month_pred("transaction_date", None, YEAR_ONLY), PAGE_LIMIT, PAGE_OFFSET))
def q_transactions_page(m, spark):
    """Newest-first page (limit 500, offset 100) of one year's sales
    with nested lines; a sale without lines has one all-null element."""
    return page_rows(ls.transactions_page(m, None, None, YEAR_ONLY, PAGE_LIMIT, PAGE_OFFSET))


RECEIPT_FIELDS = ["line_seq", "product_name", "quantity", "unit_price", "line_total"]


@query("cash_receipt_day", oracle(f"""
SELECT {HDR_SQL}, p.cashier_name, COUNT(*) AS n_items, {digest_sql(RECEIPT_FIELDS)} AS items_digest,
  row_number() OVER (PARTITION BY substr(p.transaction_time, 1, 2) ORDER BY p.transaction_time, p.txn_id) AS row_in_hour
FROM transactions p LEFT JOIN transaction_items i ON i.txn_id = p.txn_id
WHERE p.transaction_date = DATE '{AS_OF}'
GROUP BY {HDR_GROUP}, p.cashier_name ORDER BY p.transaction_time, p.txn_id"""))
def q_cash_receipt_day(m, spark):
    """One day's sales by time with nested lines."""
    d = ls.cash_receipt_day(m, AS_OF)
    return d.select(*HDR_COLS, "cashier_name", F.size("items").alias("n_items"),
                    ls.items_digest(F.col("items"), RECEIPT_FIELDS).alias("items_digest"), "row_in_hour")


DETAIL_FIELDS = ["line_seq", "product_id", "category", "quantity", "unit_price", "unit_cost", "line_total", "margin",
                 "high_margin"]


JOURNAL_FIELDS = ["line_no", "description", "account_code", "debit", "credit"]


@query("transaction_detail", oracle(f"""
SELECT {HDR_SQL}, COUNT(i.line_seq) AS n_items,
  COALESCE({digest_sql(DETAIL_FIELDS)} FILTER (WHERE i.line_seq IS NOT NULL), '') AS items_digest,
  jt.journal_lines, jt.journal_digest, CAST(jt.journal_debit AS DOUBLE) AS journal_debit, CAST(jt.journal_credit AS DOUBLE) AS journal_credit
FROM transactions p
LEFT JOIN (SELECT *, COALESCE(margin > 40, FALSE) AS high_margin FROM (
             SELECT *, CAST(ROUND((unit_price - unit_cost) * 100 / NULLIF(unit_price, 0), 1) AS DECIMAL(10,1)) AS margin
             FROM transaction_items)) i ON i.txn_id = p.txn_id
LEFT JOIN (SELECT reference_no, COUNT(*) AS journal_lines, SUM(debit) AS journal_debit, SUM(credit) AS journal_credit,
             string_agg(line_no || ':' || description || ':' || account_code || ':' || debit || ':' || credit, '|' ORDER BY line_no)
               AS journal_digest
           FROM journal GROUP BY reference_no) jt ON jt.reference_no = p.receipt_no
WHERE p.transaction_date = DATE '{AS_OF}'
GROUP BY {HDR_GROUP}, jt.journal_lines, jt.journal_digest, jt.journal_debit, jt.journal_credit"""))
def q_transaction_detail(m, spark):
    """Detail of every sale of one day (batch over an id set)."""
    ids = on_date(m["sale_headers"], "transaction_date", AS_OF)
    d = ls.transaction_detail(m, ids)
    return d.select(*HDR_COLS, F.size("items").alias("n_items"),
                    ls.items_digest(F.col("items"), DETAIL_FIELDS).alias("items_digest"),
                    "journal_lines", ls.items_digest(F.col("journal"), JOURNAL_FIELDS).alias("journal_digest"),
                    "journal_debit", "journal_credit")


@query("recent_transactions", oracle("""
SELECT txn_id, receipt_no, CAST(transaction_date AS VARCHAR) AS transaction_date, substr(transaction_time, 1, 5) AS time,
  CAST(total AS DOUBLE) AS total, payment_method
FROM transactions ORDER BY transaction_date DESC, transaction_time DESC, txn_id LIMIT 7"""))
def q_recent_transactions(m, spark):
    """the seven most recent sales."""
    return ls.recent_transactions(m, 7)


@query("movement_listing", oracle("""
SELECT CAST(log_date AS VARCHAR) AS date, substr(log_time, 1, 5) AS time, movement_type AS type,
  product_name AS product, CAST(ABS(quantity_change) AS BIGINT) AS qty, reason, performed_by, txn_id, CAST(kind AS BIGINT) AS kind
FROM stock_movements ORDER BY log_date DESC, log_time DESC, txn_id DESC, line_seq DESC, kind DESC LIMIT 100"""))
def q_movement_listing(m, spark):
    """Latest 100 stock movements, presented."""
    return ls.movement_listing(m["stock_movements"], 100, m["products"])


ALIGNMENT_SQL = """
SELECT CAST(EXTRACT(YEAR FROM t.transaction_date) AS BIGINT) AS year,
  CAST(EXTRACT(MONTH FROM t.transaction_date) AS BIGINT) AS month, COUNT(*) AS transactions,
  CAST(COALESCE(SUM(g.n_lines), 0) AS BIGINT) AS items, CAST(SUM(t.total) AS DOUBLE) AS txn_revenue,
  CAST(COALESCE(SUM(s.subtotal), 0) AS DOUBLE) AS items_revenue,
  CAST(SUM(t.total) - COALESCE(SUM(s.subtotal), 0) * 1.11 AS DOUBLE) AS diff
FROM transactions t
LEFT JOIN sale_totals s ON s.txn_id = t.txn_id
LEFT JOIN (SELECT txn_id, SUM(n_lines) AS n_lines FROM cat GROUP BY txn_id) g ON g.txn_id = t.txn_id
GROUP BY 1, 2"""
ALIGNMENT_LITERAL_SQL = """
SELECT CAST(EXTRACT(MONTH FROM t.transaction_date) AS BIGINT) AS month, COUNT(DISTINCT t.txn_id) AS transactions,
  COUNT(i.line_total) AS items, CAST(SUM(t.total) AS DOUBLE) AS txn_revenue,
  CAST(SUM(i.line_total) AS DOUBLE) AS items_revenue,
  CAST(SUM(t.total) - SUM(i.line_total) * 1.11 AS DOUBLE) AS diff
FROM transactions t LEFT JOIN transaction_items i ON i.txn_id = t.txn_id
GROUP BY 1"""


@query("txn_item_alignment", oracle(ALIGNMENT_SQL))
def q_alignment(m, spark):
    """D11 without fan-out."""
    return ls.txn_item_alignment(m)


@query("txn_item_alignment_literal", oracle(ALIGNMENT_LITERAL_SQL))
def q_alignment_literal(m, spark):
    """D11 exactly as the check query is written (fan-out kept)."""
    return ls.txn_item_alignment_literal(m)


ROW_COUNT_TABLES = ["products", "transactions", "transaction_items", "raw_materials", "product_ingredients",
                    "stock_movements", "chart_of_accounts"]


@query("row_counts", oracle("\nUNION ALL\n".join(
    f"SELECT '{n}' AS table_name, COUNT(*) AS rows FROM {n}" for n in ROW_COUNT_TABLES + ["journal"])))
def q_row_counts(m, spark):
    """Loaded rows per model table, the journal included."""
    t = dict(m)
    t["journal"] = journal(m)
    return ls.row_counts(t, ROW_COUNT_TABLES + ["journal"])


@query("receipt_codes", oracle("""
SELECT txn_id, receipt_no, 'TXN-' || upper(substr(md5(receipt_no), 1, 8)) AS receipt_code FROM transactions"""))
def q_receipt_codes(m, spark):
    """H8: short codes derived from each receipt number."""
    return m["sale_headers"].select("txn_id", "receipt_no",
                                    F.concat(F.lit("TXN-"), receipt_code(F.col("receipt_no"))).alias("receipt_code"))
