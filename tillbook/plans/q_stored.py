"""Registered queries: period reports served by the stored model.

Each key writes the model derived from the given tables once to a new folder
of the shared scratch space, and answers from the stored month partitions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tillbook.operators import inventory as inv, ledger, listings, posting, quality, reports
from tillbook.plans.catalog import AS_OF, MONTH, YEAR, query
from tillbook.plans.oracle_sql import oracle
from tillbook.plans.q_inventory import E1_COLS, LEDGER_CTE
from tillbook.plans.q_ledger import GL_SELECT, J_COLS, J_SQL, gl_cte
from tillbook.plans.q_listings import ALIGNMENT_LITERAL_SQL, ALIGNMENT_SQL, page_rows, page_sql
from tillbook.plans.q_quality import HEADER_VS_LINES_SQL
from tillbook.plans.q_reports import SUMMARY_SELECT, summary_ctes
from tillbook.plans.session import scratch_dir
from tillbook.sources import sale_buckets
from tillbook.sources.model_store import load_model, load_stock_months, materialize_model, verify_day, write_stock_months


def stored_dir(m, spark) -> str:
    out = scratch_dir(spark, f"model-{uuid.uuid4().hex}")
    materialize_model(spark, m, out)
    return out


def stored(m, spark):
    return load_model(spark, stored_dir(m, spark))


@query("stored_report_summary", oracle(SUMMARY_SELECT, summary_ctes(MONTH, YEAR)))
def q_stored_summary(m, spark):
    """I8 for one month from the stored model."""
    return reports.report_summary(stored(m, spark), MONTH, YEAR)


@query("stored_by_category", oracle("""
SELECT category, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM ps GROUP BY category""", summary_ctes(MONTH, YEAR)))
def q_stored_by_category(m, spark):
    """D5 for one month from the stored model."""
    return reports.by_category(stored(m, spark), MONTH, YEAR)


@query("stored_general_ledger", oracle(GL_SELECT, gl_cte(MONTH, YEAR)))
def q_stored_ledger(m, spark):
    """I6 for one month from the stored model."""
    t = stored(m, spark)
    return ledger.general_ledger(t["chart_of_accounts"], posting.build_journal(t, None, MONTH, YEAR), MONTH, YEAR)


@query("stored_month_stock_ledger", oracle(f"""
SELECT product_id, product_name, CAST(log_date AS VARCHAR) AS log_date, log_time, txn_id, CAST(kind AS BIGINT) AS kind,
  movement_type, CAST(quantity_change AS BIGINT) AS quantity_change, reason, CAST(stock_after AS BIGINT) AS stock_after
FROM led WHERE year(log_date) = {YEAR} AND month(log_date) = {MONTH}""", LEDGER_CTE))
def q_stored_month_ledger(m, spark):
    """E1 of one month: its stored movements, opened by the stored summaries of the months before."""
    out = stored_dir(m, spark)
    write_stock_months(spark, out)
    t = load_model(spark, out)
    return inv.month_stock_ledger(t["stock_movements"], load_stock_months(spark, out), t["products"], MONTH, YEAR).select(*E1_COLS)


DEEP_PAGE, DEEP_OFFSET = 50, 900


@query("stored_deep_page", page_sql("TRUE", DEEP_PAGE, DEEP_OFFSET))
def q_deep_page(m, spark):
    """a page far down the newest-first listing of all sales, read from its own days."""
    return page_rows(listings.seek_page(stored(m, spark), DEEP_PAGE, DEEP_OFFSET))


@query("stored_verify_day", oracle(f"""
SELECT CAST(date_trunc('month', transaction_date) AS DATE)::VARCHAR AS month, COUNT(*) AS n_sales,
  COUNT(*) FILTER (WHERE verified OR transaction_date = DATE '{AS_OF}') AS n_verified, CAST(SUM(total) AS DOUBLE) AS total
FROM transactions GROUP BY 1"""))
def q_stored_verify_day(m, spark):
    """J7 on the stored model: one month of headers is rewritten, all months are read back."""
    out = stored_dir(m, spark)
    verify_day(spark, out, AS_OF)
    month = F.trunc("transaction_date", "month").cast("string").alias("month")
    return load_model(spark, out)["transactions"].groupBy(month).agg(
        F.count(F.lit(1)).alias("n_sales"), F.count_if("verified").alias("n_verified"), F.sum("total").alias("total"))


def by_sale(m, spark, operator):
    """``operator`` over the sales of ``m``, stored in buckets of the sale id."""
    out = scratch_dir(spark, f"sales-{uuid.uuid4().hex}")
    sale_buckets.materialize_sale_buckets(spark, m, out)
    return sale_buckets.over_parts(sale_buckets.load_sale_buckets(spark, out), operator)


@query("bucketed_alignment", oracle(ALIGNMENT_SQL))
def q_bucketed_alignment(m, spark):
    """D11/C2 over bucketed sales: no exchange up to the sums by month."""
    return listings.alignment_by_month(by_sale(m, spark, listings.sale_alignment))


@query("bucketed_alignment_literal", oracle(ALIGNMENT_LITERAL_SQL))
def q_bucketed_alignment_literal(m, spark):
    """C13 over bucketed sales: headers meet their lines without an exchange."""
    return listings.literal_by_month(by_sale(m, spark, listings.header_line_rows))


@query("bucketed_header_vs_lines", oracle(HEADER_VS_LINES_SQL))
def q_bucketed_header_vs_lines(m, spark):
    """K5 over bucketed sales: no exchange at all."""
    return by_sale(m, spark, quality.header_vs_lines)


@query("bucketed_post_sales", oracle(f"SELECT {J_SQL} FROM sales_journal"))
def q_bucketed_post_sales(m, spark):
    """I2 over bucketed sales: no exchange at all."""
    return by_sale(m, spark, lambda t: posting.post_sales(t["sale_headers"], t["transaction_items"]).select(*J_COLS))
