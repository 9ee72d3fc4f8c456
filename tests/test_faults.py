"""Faults planted in the raw tables reach the totals, the quality rules and the stored model."""

import datetime as dt
import os

import duckdb
import pytest

from tillbook.operators import changes, ledger, listings, quality, reports
from tillbook.plans.q_ledger import journal
from tillbook.plans.session import scratch_dir
from tillbook.sources.adapter import load
from tillbook.sources.model_store import load_model, materialize_model

SRC = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def faulty(spark, tmp_path_factory):
    """The small tables without five products and three sale headers that have lines."""
    out = str(tmp_path_factory.mktemp("faulty"))
    con = duckdb.connect()
    for name in ("part", "orders", "lineitem", "supplier"):
        where = {"part": "p_partkey NOT IN (SELECT p_partkey FROM src ORDER BY p_partkey LIMIT 5)",
                 "orders": f"o_orderkey NOT IN (SELECT DISTINCT l_orderkey FROM '{SRC}/lineitem.parquet' ORDER BY 1 LIMIT 3)"}
        con.sql(f"CREATE OR REPLACE VIEW src AS SELECT * FROM '{SRC}/{name}.parquet'")
        con.sql(f"COPY (SELECT * FROM src WHERE {where.get(name, 'TRUE')}) TO '{os.path.join(out, name)}.parquet' (FORMAT parquet)")
    return load(spark, out)


def found(t):
    t = dict(t)
    t["journal"] = journal(t)
    rows = quality.orphans(t).collect()
    return {rule: sum(r.n for r in rows if r.rule == f"orphan:{rule}") for rule in ("line_without_sale", "line_without_product")}


def test_no_line_is_lost(spark, faulty, model):
    raw = model["lineitem"].count()
    assert faulty["transaction_items"].count() == raw
    assert faulty["stock_movements"].filter("kind = 0").count() == raw
    assert faulty["material_movements"].count() == raw
    bad = faulty["transaction_items"].join(faulty["products"].select("product_id"), "product_id", "left_anti").count()
    assert bad > 0
    nulls = {(r.rule, r.key): r.n for r in quality.null_required(faulty).collect()}
    assert nulls["not_null:transaction_items", "product_name"] == bad
    assert nulls["not_null:transaction_items", "product_id"] == 0


def test_rules_see_the_faults_raw_and_stored(spark, faulty):
    out = scratch_dir(spark, f"faulty-{os.getpid()}-{id(faulty)}")
    materialize_model(spark, faulty, out)
    stored = load_model(spark, out)
    raw_found, stored_found = found(faulty), found(stored)
    assert raw_found == stored_found and min(raw_found.values()) > 0
    for period in ((3, 1997), (None, None)):
        a, b = (reports.report_summary(t, *period).collect() for t in (faulty, stored))
        assert a == b


def test_second_write_keeps_the_first_readable(spark, model):
    out = scratch_dir(spark, f"twice-{os.getpid()}")
    materialize_model(spark, model, out)
    first = load_model(spark, out)
    materialize_model(spark, model, out)
    assert first["products"].count() == load_model(spark, out)["products"].count()


def test_listings_come_in_order(spark, model):
    day = dt.date(1997, 3, 15)
    page = [(r.transaction_date, r.transaction_time, -r.txn_id) for r in listings.transactions_page(model, None, None, 1998, 80, 5).collect()]
    assert page == sorted(page, reverse=True)
    receipts = [(r.transaction_time, r.txn_id) for r in listings.cash_receipt_day(model, day).collect()]
    assert receipts and receipts == sorted(receipts)
    codes = [r.code for r in ledger.general_ledger(model["chart_of_accounts"], journal(model)).collect()]
    assert codes == sorted(codes)
    trial = [(r.row_kind, r.code) for r in ledger.trial_balance(ledger.general_ledger(model["chart_of_accounts"], journal(model))).collect()]
    assert trial == sorted(trial)
    week = [r.date for r in reports.weekly_trend(model, day, 3, 1997).collect()]
    assert week == sorted(week) and len(week) == 7


def test_repeated_keys_in_a_change_set_are_rejected(spark):
    base = spark.createDataFrame([(1, 5), (2, 6)], "k int, stock int")
    twice = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "k int, stock int, seq int")
    with pytest.raises(Exception, match="several change rows"):
        changes.update_rows(base, twice.drop("seq"), "k", dt.date(2026, 1, 1)).collect()
    got = {r.k: r.stock for r in changes.update_rows(base, twice, "k", dt.date(2026, 1, 1), ["seq"]).collect()}
    assert got == {1: 12, 2: 6}
    products = spark.createDataFrame([(1, "a", 3)], "product_id int, sku string, stock int")
    with pytest.raises(Exception, match="several change rows"):
        changes.reset_stock_by_sku(products, spark.createDataFrame([("a", 1), ("a", 2)], "sku string, stock int")).collect()


def test_unknown_products_in_adjustments_are_returned(spark):
    p = spark.createDataFrame([(1, "a", 3)], "product_id long, name string, stock int")
    adj = spark.createDataFrame([(1, 2, 1), (9, 4, 2)], "product_id long, qty_change int, seq int")
    assert [r.product_id for r in changes.rejected_adjustments(p, adj).collect()] == [9]


def test_duplicate_keys_are_counted_in_bounded_tasks(spark, model, monkeypatch):
    """A task counts KEYS_IN_TASK keys at most on average, and keys whose text is the same are one."""
    t = dict(model)
    t["products"] = spark.createDataFrame([("a",), ("a",), ("b",), ("",), (None,), (None,)], "sku string")
    t["product_ingredients"] = spark.createDataFrame([(1, None), (None, 1), (2, 3), (2, 3), (4, 5)], "product_id long, raw_material_id long")
    t["transactions"] = model["sale_headers"].select("receipt_no")
    monkeypatch.setattr(quality, "KEYS_IN_TASK", 100)
    found = quality.duplicate_keys(t)
    assert sorted((r.key, r.n) for r in found.collect()) == [("", 3), ("1", 2), ("2|3", 2), ("a", 2)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert f"{-(-t['transactions'].count() // 100)}), REPARTITION_BY_NUM" in plan and "partial_count" in plan
