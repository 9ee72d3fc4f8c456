"""Registered queries: sinks (A6-A8) verified by a round trip.

Each key writes a whole report with the library's writer into the shared
scratch folder, reads the written files back with Spark, and returns them;
the oracle is the SQL of the report itself, so the check covers what the
sink wrote.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tillbook.operators import reports
from tillbook.plans.catalog import MONTH, YEAR, YEAR_ONLY, present, query
from tillbook.plans.oracle_sql import oracle
from tillbook.plans.q_ledger import J_COLS, J_SQL, journal, month_pred
from tillbook.plans.q_listings import HDR_COLS, PAGE_FIELDS, PAGE_LIMIT, PAGE_OFFSET
from tillbook.plans.q_reports import income_sql
from tillbook.plans.session import scratch_dir
from tillbook.sources import sinks


def _out(spark, name: str) -> str:
    return scratch_dir(spark, f"export-{name}-{uuid.uuid4().hex}")


@query("export_csv_income_statement", income_sql(None, YEAR_ONLY))
def q_export_csv(m, spark):
    """The yearly income statement written as a CSV report (header row,
    every field quoted) and read back with its schema."""
    out = _out(spark, "csv")
    sinks.export_csv(present(reports.income_statement(m, None, YEAR_ONLY)), out)
    return (spark.read.option("header", True).option("escape", '"')
            .schema("line_no bigint, section string, label string, amount double").csv(out))


@query("export_json_transactions_page", oracle(f"""
SELECT p.txn_id, CAST(p.transaction_date AS VARCHAR) AS transaction_date, p.transaction_time, p.receipt_no,
  p.payment_method, CAST(p.subtotal AS DOUBLE) AS subtotal, CAST(p.tax AS DOUBLE) AS tax,
  CAST(p.total AS DOUBLE) AS total, COUNT(*) AS n_items,
  string_agg(COALESCE(CAST(i.line_seq AS VARCHAR), '~') || ':' || COALESCE(CAST(i.product_id AS VARCHAR), '~'),
             '|' ORDER BY i.line_seq) AS items_digest
FROM page p LEFT JOIN transaction_items i ON i.txn_id = p.txn_id
GROUP BY p.txn_id, p.transaction_date, p.transaction_time, p.receipt_no, p.payment_method, p.subtotal, p.tax,
  p.total""", f"""
page AS (SELECT * FROM transactions WHERE {month_pred('transaction_date', None, YEAR_ONLY)}
         ORDER BY transaction_date DESC, transaction_time DESC, txn_id LIMIT {PAGE_LIMIT} OFFSET {PAGE_OFFSET})"""))
def q_export_json(m, spark):
    """The nested transactions page (items as an array of structs) written
    as JSON lines and read back; the nested items survive the round trip."""
    from tillbook.operators import listings as ls
    out = _out(spark, "json")
    page = ls.transactions_page(m, None, None, YEAR_ONLY, PAGE_LIMIT, PAGE_OFFSET)
    sinks.export_json(page.select(*HDR_COLS, "items"), out)
    back = spark.read.schema(page.select(*HDR_COLS, "items").schema).json(out)
    fields = PAGE_FIELDS[:2]
    return present(back.select(*HDR_COLS, F.size("items").alias("n_items"),
                               ls.items_digest(F.col("items"), fields).alias("items_digest")))


@query("append_journal_by_month", oracle(f"""
SELECT {J_SQL} FROM journal WHERE {month_pred('entry_date', MONTH, YEAR)}"""))
def q_append_journal(m, spark):
    """One month's journal lines appended to a month-partitioned store and
    read back through the partition filter."""
    from tillbook.functions.periods import in_period
    out = _out(spark, "append")
    lines = in_period(journal(m, MONTH, YEAR), "entry_date", MONTH, YEAR).select(*J_COLS)
    sinks.append(lines, out, "entry_date")
    back = in_period(spark.read.parquet(out), "entry_date", MONTH, YEAR)
    return back.select(*J_COLS)
