"""The daily cube gives the statements that the lines give, before and after late and deleted sales."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from tests.helpers import items, products, txns
from tillbook.operators import cube, reports
from tillbook.plans.session import scratch_dir
from tillbook.sources import cube_store, versions

PERIODS = [(3, 1997), (None, 1998), (None, None), (None, 2010)]
DAY = dt.date(1997, 3, 15)


def _rows(df):
    return [tuple(r) for r in df.collect()]


def _same(found, want):
    want = want.select(*found.columns)
    assert sorted(_rows(found), key=repr) == sorted(_rows(want), key=repr)


def _out(spark):
    return scratch_dir(spark, f"cube-{uuid.uuid4().hex}")


def _lines_of(t, headers):
    return t["transaction_items"].join(headers.select("txn_id"), "txn_id", "left_semi")


def _model(t, headers):
    from tillbook.sources.adapter import with_sale_totals
    lines = _lines_of(t, headers)
    return {"sale_headers": headers, "transaction_items": lines, "products": t["products"],
            "transactions": with_sale_totals(headers, lines)}


@pytest.fixture(scope="module")
def stored(spark, model):
    out = _out(spark)
    cube_store.write_cube(spark, model["sale_headers"], model["transaction_items"], out)
    return cube_store.read_cube(spark, out)


@pytest.mark.parametrize("month,year", PERIODS)
def test_reports_equal_those_from_lines(model, stored, month, year):
    for name in ("report_summary", "income_statement", "cash_flow", "cash_position", "by_payment", "by_category", "daily_sales"):
        _same(getattr(cube, name)(stored, month, year), getattr(reports, name)(model, month, year))
    _same(cube.balance_sheet(stored, model["products"], month, year), reports.balance_sheet(model, month, year))
    _same(cube.dashboard_kpis(stored, model["products"], DAY, month, year), reports.dashboard_kpis(model, DAY, month, year))


def test_periods(model, stored):
    assert _rows(cube.available_periods(stored)) == _rows(reports.available_periods(model))


def test_a_month_reads_its_folder(stored):
    plan = cube.report_summary(stored, 3, 1997)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cube_month" in plan


def test_late_and_deleted_sales(spark, model):
    headers = model["sale_headers"]
    early, late = headers.filter("txn_id % 3 <> 0"), headers.filter("txn_id % 3 = 0")
    gone = headers.filter("payment_method = 'Cash'")
    out = _out(spark)
    cube_store.write_cube(spark, early, _lines_of(model, early), out)
    _same(cube.report_summary(cube_store.read_cube(spark, out)), reports.report_summary(_model(model, early)))
    assert cube_store.add_sales(spark, out, "late", late, _lines_of(model, late))
    assert not cube_store.add_sales(spark, out, "late", late, _lines_of(model, late))
    _same(cube.daily_sales(cube_store.read_cube(spark, out)), reports.daily_sales(model))
    assert cube_store.remove_sales(spark, out, "gone", gone, _lines_of(model, gone))
    now = _model(model, headers.join(gone.select("txn_id"), "txn_id", "left_anti"))
    for when in ("deltas", "compacted"):
        found = cube_store.read_cube(spark, out)
        for name in ("report_summary", "income_statement", "by_payment", "by_category", "daily_sales"):
            _same(getattr(cube, name)(found, None, 1997), getattr(reports, name)(now, None, 1997))
        if when == "deltas":
            cube_store.compact(spark, out)
    assert len(versions.latest(spark, out)["tables"][cube_store.TABLE]) == 1
    assert not cube_store.remove_sales(spark, out, "gone", gone, _lines_of(model, gone))
    assert found.count() == found.select(*cube.GRAIN).distinct().count()


def test_a_lost_race_is_refused(spark, model):
    out = _out(spark)
    cube_store.write_cube(spark, model["sale_headers"].limit(0), model["transaction_items"], out)
    base = versions.published_at(spark, out)
    assert cube_store.add_sales(spark, out, "one", model["sale_headers"].limit(5), model["transaction_items"])
    with pytest.raises(versions.StaleBase):
        versions.merge_folders(spark, out, cube_store.VERSION, cube_store.TABLE, lambda path: None, base)


def test_odd_rows(spark):
    """Sales without lines, unknown products and methods, missing dates, rounding by sale, lines of other sales."""
    head = txns(spark, [(1, "1997-03-01", "08:00:00", "Cash"), (2, "1997-03-01", "09:00:00", "Cash"),
                        (3, "1997-03-02", "09:00:00", None), (4, "1997-03-02", "09:00:00", "QRIS")])
    head = head.withColumn("transaction_date", F.when(F.col("txn_id") != 4, F.col("transaction_date")))
    lines = items(spark, [(1, 1, 1, "Bread", 1, "5", "2"), (2, 1, 1, "Bread", 1, "5", "2"), (2, 2, 2, None, 1, "0", "0"),
                          (4, 1, 1, "Cake", 2, "10", "4"), (9, 1, 1, "Cake", 7, "10", "4")])
    catalogue = products(spark, [(1, "p1", "Bread", "5", "2", 1, 1, True)])
    out = _out(spark)
    cube_store.write_cube(spark, head, lines, out)
    t, found = {**_model({"transaction_items": lines, "products": catalogue}, head)}, cube_store.read_cube(spark, out)
    for month, year in [(3, 1997), (None, None)]:
        for name in ("report_summary", "income_statement", "cash_position", "by_payment", "by_category", "daily_sales"):
            _same(getattr(cube, name)(found, month, year), getattr(reports, name)(t, month, year))
    assert ("Unknown", 0) in [(r.category, r.revenue) for r in cube.by_category(found).collect()]


def test_no_sales(spark, model):
    out = _out(spark)
    cube_store.write_cube(spark, model["sale_headers"].limit(0), model["transaction_items"], out)
    assert cube_store.add_sales(spark, out, "none", model["sale_headers"].limit(0), model["transaction_items"])
    cube_store.compact(spark, out)
    found = cube_store.read_cube(spark, out)
    assert found.count() == 0
    _same(cube.report_summary(found), reports.report_summary(model, None, 2010))
