"""Registered queries: reports served by the stored daily cube, before and after late and deleted sales."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tillbook.operators import cube
from tillbook.plans.catalog import AS_OF, MONTH, YEAR, YEAR_ONLY, query
from tillbook.plans.oracle_sql import oracle
from tillbook.plans.q_reports import BALANCE_ROWS, DASHBOARD_SQL, SUMMARY_SELECT, income_sql, lines_sql, summary_ctes
from tillbook.plans.session import scratch_dir
from tillbook.sources import cube_store

KEPT = "kept AS (SELECT * FROM transactions WHERE payment_method IS DISTINCT FROM 'Voucher'),"


def stored_cube(m, spark):
    out = scratch_dir(spark, f"cube-{uuid.uuid4().hex}")
    cube_store.write_cube(spark, m["sale_headers"], m["transaction_items"], out)
    return cube_store.read_cube(spark, out)


def changed_cube(m, spark):
    """The cube of the verified sales, to which the others are added late (and once more, which changes nothing), and
    from which the sales by voucher are deleted; then compacted."""
    out = scratch_dir(spark, f"cube-{uuid.uuid4().hex}")
    headers, lines = m["sale_headers"], m["transaction_items"]
    verified = F.coalesce("verified", F.lit(False))
    late, gone = headers.filter(~verified), headers.filter("payment_method = 'Voucher'")

    def of(some):
        return lines.join(some.select("txn_id"), "txn_id", "left_semi")

    cube_store.write_cube(spark, headers.filter(verified), of(headers.filter(verified)), out)
    for _ in range(2):
        cube_store.add_sales(spark, out, "late", late, of(late))
    cube_store.remove_sales(spark, out, "vouchers", gone, of(gone))
    cube_store.compact(spark, out)
    return cube_store.read_cube(spark, out)


@query("cube_report_summary", oracle(SUMMARY_SELECT, summary_ctes(None, YEAR_ONLY)))
def q_cube_summary(m, spark):
    """I8 of a year from the cube."""
    return cube.report_summary(stored_cube(m, spark), None, YEAR_ONLY)


@query("cube_income_statement", income_sql(None, YEAR_ONLY))
def q_cube_income(m, spark):
    """I9 of a year from the cube."""
    return cube.income_statement(stored_cube(m, spark), None, YEAR_ONLY)


@query("cube_balance_sheet", oracle(lines_sql(BALANCE_ROWS, "summary, pay, sv", ["side", "section", "label"]),
                                    summary_ctes(MONTH, YEAR)))
def q_cube_balance(m, spark):
    """I10 of a month from the cube."""
    return cube.balance_sheet(stored_cube(m, spark), m["products"], MONTH, YEAR)


@query("cube_dashboard_kpis", DASHBOARD_SQL)
def q_cube_dashboard(m, spark):
    """I22 from the cube."""
    return cube.dashboard_kpis(stored_cube(m, spark), m["products"], AS_OF, MONTH, YEAR)


@query("cube_summary_after_changes", oracle(SUMMARY_SELECT, KEPT + summary_ctes(None, YEAR_ONLY).replace(
    "FROM transactions", "FROM kept")))
def q_cube_changed_summary(m, spark):
    """I8 of a year from the cube after late and deleted sales."""
    return cube.report_summary(changed_cube(m, spark), None, YEAR_ONLY)


@query("cube_daily_after_changes", oracle("""
SELECT CAST(transaction_date AS VARCHAR) AS date, CAST(SUM(total) AS DOUBLE) AS total, COUNT(*) AS count
FROM kept GROUP BY transaction_date""", KEPT.rstrip(",")))
def q_cube_changed_daily(m, spark):
    """D6 over all days from the cube after late and deleted sales."""
    return cube.daily_sales(changed_cube(m, spark))
