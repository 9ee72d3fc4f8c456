"""Plan-shape checks for the properties the operators rely on at scale."""

from tillbook.operators import inventory, ledger, posting
from tillbook.plans.q_ledger import journal


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_posting_needs_no_per_sale_window(model):
    plan = _plan(posting.post_sales(model["transactions"], model["transaction_items"]))
    assert "row_number" not in plan and "Window" not in plan


def test_posting_aggregates_before_shuffling_lines(model):
    plan = _plan(posting.category_lines(model["transaction_items"]))
    assert "partial_sum" in plan


def test_ledger_broadcasts_only_the_chart(model):
    plan = _plan(ledger.general_ledger(model["chart_of_accounts"], journal(model), 3, 1997))
    assert "BroadcastExchange" in plan


def test_stock_ledger_windows_are_blocked(model, monkeypatch):
    import re
    from tillbook.operators import levels
    monkeypatch.setattr(levels, "RUN_ROWS", 100)
    monkeypatch.setattr(levels, "written", lambda df, name: df)      # the plan of the whole scan in one piece
    plan = _plan(inventory.stock_ledger(model["stock_movements"], model["products"]))
    run_windows = [ln for ln in plan.splitlines() if "Window [" in ln and re.search(r"AS _run#\d+", ln)]
    assert run_windows
    # the row-level running sum is partitioned by (product, block), never by product alone
    for ln in run_windows:
        assert re.search(r"\], \[product_id#\d+L?, _blk#\d+\]", ln), ln


def test_page_selects_sales_before_numbering_lines(model):
    from tillbook.operators import listings
    page = listings.transactions_page(model, None, None, 1998, 50, 0)
    plan = _plan(page)
    window_at = plan.find("Window [row_number()", plan.find("Window [row_number()") + 1)
    assert window_at > 0
    # the semi join on the page's sales sits below (after, in the text) the line numbering window
    assert "LeftSemi" in plan[window_at:]


def _line_scans(plan: str) -> int:
    return plan.count("Location: InMemoryFileIndex") and sum(
        1 for ln in plan.splitlines() if "FileScan parquet" in ln and "l_orderkey" in ln)


def test_periods_select_raw_lines_before_any_join_or_aggregate(spark, model):
    """With broadcasts off, the semi join on the sale sits right on the line scan."""
    import datetime as dt
    import re
    from tillbook.operators import reports
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (reports.today_kpi(model, dt.date(1997, 3, 15)), reports.report_summary(model, 3, 1997),
                   ledger.general_ledger(model["chart_of_accounts"], journal(model, 3, 1997), 3, 1997)):
            plan = _plan(df)
            assert _line_scans(plan) == 1
            semi, scan = plan.find("LeftSemi"), plan.find("l_orderkey", plan.find("LeftSemi"))
            assert 0 < semi < scan
            # between the semi join and the scan of lines there is no other join and no aggregate
            lines = plan[semi:].splitlines()[1:]
            upto = next(i for i, ln in enumerate(lines) if "FileScan parquet" in ln)
            assert not [ln for ln in lines[:upto] if re.search("Aggregate|Join", ln)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_statements_scan_the_lines_once(model):
    import datetime as dt
    from tillbook.operators import listings, reports
    from pyspark.sql import functions as F
    day = dt.date(1997, 3, 15)
    ids = model["sale_headers"].filter(F.col("transaction_date") == F.lit(day))
    for df in (reports.income_statement(model, 3, 1997), reports.balance_sheet(model, 3, 1997),
               reports.dashboard_kpis(model, day, 3, 1997), listings.transaction_detail(model, ids)):
        assert _line_scans(_plan(df)) == 1
    assert sum("o_orderkey" in ln and "FileScan" in ln for ln in _plan(listings.transaction_detail(model, ids)).splitlines()) <= 2


def test_derived_columns_are_made_behind_the_exchange(model):
    """Numbered lines and movements exchange the raw columns, not the line key that repeats them."""
    for name in ("stock_movements", "transaction_items"):
        plan = _plan(model[name])
        key = next(i for i, ln in enumerate(plan.splitlines()) if "AS line_key#" in ln)
        below = plan.splitlines()[key + 1:]      # a tree prints inputs after what reads them
        assert any("Exchange hashpartitioning(l_orderkey" in ln for ln in below), name
        assert not any("AS line_key#" in ln for ln in below), name
