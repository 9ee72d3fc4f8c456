"""Deep pages by month and day counts equal the pages of the sorted listing (F1)."""

import uuid

import pytest
from pyspark.sql import functions as F

from tillbook.operators import listings
from tillbook.plans.session import scratch_dir
from tillbook.sources.model_store import load_model, materialize_model


@pytest.fixture(scope="module")
def books(spark, model):
    """A store in which some sales have no date."""
    some = F.col("txn_id") % 40 == 0
    t = dict(model)
    for name in ("sale_headers", "transactions"):
        t[name] = model[name].withColumn("transaction_date", F.when(~some, F.col("transaction_date")))
    out = scratch_dir(spark, f"pages-{uuid.uuid4().hex}")
    materialize_model(spark, t, out)
    return load_model(spark, out)


def _rows(page):
    return [(r.row_no, r.txn_id, len(r["items"]), r.total) for r in page.collect()]


@pytest.mark.parametrize("limit,offset,month,year", [(20, 0, None, None), (20, 700, None, None), (400, 333, None, None), (30, 1480, None, None),
                                                     (30, 5000, None, None), (7, 11, 3, 1997), (5, 0, None, 2010)])
def test_seek_page_equals_the_sorted_listing(books, limit, offset, month, year):
    found = listings.seek_page(books, limit, offset, month, year)
    want = listings.transactions_page(books, None, month, year, limit, offset)
    assert _rows(found) == _rows(want)


def test_a_deep_page_reads_its_days(books):
    plan = listings.seek_page(books, 5, 900)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(sale_month" in plan or "PartitionFilters: [isnotnull(sale_month" in plan, plan[:3000]
    assert "transaction_date" in plan.split("PushedFilters: [")[1].split("]")[0] or "PushedFilters: [IsNotNull(transaction_date)" in plan


def test_span():
    counts = [("c", 3), ("b", 4), ("a", 2)]
    assert listings._span(counts, 0, 2) == (["c"], 0)
    assert listings._span(counts, 2, 2) == (["c", "b"], 2)
    assert listings._span(counts, 3, 4) == (["b"], 0)
    assert listings._span(counts, 5, 9) == (["b", "a"], 2)
    assert listings._span(counts, 9, 5) == ([], 0)
    assert listings._span([], 0, 5) == ([], 0)
