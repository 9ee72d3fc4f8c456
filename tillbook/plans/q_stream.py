"""Registered queries: posting and recording arriving sales (L1)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.plans.catalog import query
from tillbook.plans.oracle_sql import oracle
from tillbook.plans.q_ledger import J_COLS, J_SQL
from tillbook.plans.session import scratch_dir
from tillbook.sources import versions
from tillbook.streaming.recording import start_recording_stream
from tillbook.streaming.sales_stream import deliver, delivered, nested_sales, replay_and_post


@query("stream_post_sales", oracle(f"SELECT {J_SQL} FROM sales_journal"))
def q_stream_post_sales(m, spark):
    """L1: every sale delivered twice through the posting stream is posted
    once; the journal equals the batch posting of the same sales."""
    return replay_and_post(spark, m["transactions"], m["transaction_items"], copies=2).select(*J_COLS)


SOLD_OUT = """
moves AS (
  SELECT i.product_id, t.transaction_date AS d, t.transaction_time AS tm, i.txn_id, i.line_seq, -i.quantity AS q
  FROM transaction_items i JOIN transactions t ON t.txn_id = i.txn_id),
run AS (
  SELECT m.*, p.stock + SUM(q) OVER w AS s FROM moves m JOIN products p ON p.product_id = m.product_id
  WINDOW w AS (PARTITION BY m.product_id ORDER BY d, tm, m.txn_id, line_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
levels AS (
  SELECT *, s - LEAST(0, MIN(s) OVER (PARTITION BY product_id ORDER BY d, tm, txn_id, line_seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS stock_after FROM run)"""


def _recorded_twice(m, spark):
    """All sales uploaded and recorded; then all uploaded again, and the stream restarted."""
    base = scratch_dir(spark, f"recorded-stream-{uuid.uuid4().hex}")
    sales = nested_sales(m["transactions"], m["transaction_items"])
    for time in range(2):
        deliver(delivered(spark, f"{base}/incoming") if time else sales, f"{base}/incoming")
        q = start_recording_stream(spark, f"{base}/incoming", f"{base}/books", f"{base}/_checkpoint", m["products"])
        q.awaitTermination()
        if q.exception() is not None:  # pragma: no cover - surfaced to the caller
            raise RuntimeError(str(q.exception()))
    return versions.read_published(spark, f"{base}/books")


@query("stream_recorded_tables", oracle("""
SELECT 'transactions' AS table_name, COUNT(*) AS n, CAST(SUM(total) AS DOUBLE) AS amount FROM transactions
UNION ALL SELECT 'transaction_items', COUNT(*), CAST(SUM(i.line_total) AS DOUBLE)
  FROM transaction_items i JOIN transactions t ON t.txn_id = i.txn_id
UNION ALL SELECT 'journal_entries', COUNT(*), CAST(SUM(debit) AS DOUBLE) FROM sales_journal
UNION ALL SELECT 'inventory_logs', COUNT(*), CAST(SUM(stock_after) AS DOUBLE) FROM levels
UNION ALL SELECT 'receipts', COUNT(*), 0.0 FROM transactions
UNION ALL SELECT 'rejected_sales', COUNT(*), 0.0 FROM transactions
UNION ALL SELECT 'products', COUNT(*), CAST(SUM(COALESCE(l.stock_after, p.stock)) AS DOUBLE) FROM products p LEFT JOIN (
  SELECT product_id, stock_after FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY d DESC, tm DESC, txn_id DESC,
    line_seq DESC) AS rn FROM levels) WHERE rn = 1) l ON l.product_id = p.product_id""", SOLD_OUT))
def q_stream_recorded(m, spark):
    """Rows and amounts of every table after all sales arrived twice: each is recorded once and rejected once."""
    t = _recorded_twice(m, spark)
    amounts = {"transactions": "total", "transaction_items": "line_total", "journal_entries": "debit",
               "inventory_logs": "stock_after", "products": "stock", "receipts": None, "rejected_sales": None}
    rows = [t[name].agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"),
                        (F.sum(c) if c else F.lit(0.0)).cast("double").alias("amount")) for name, c in amounts.items()]
    return reduce(DataFrame.unionByName, rows)
