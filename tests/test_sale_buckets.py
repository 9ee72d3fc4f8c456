"""Sales in buckets of the sale id: same results, no exchange by sale, heavy sales and rows without an id kept apart."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from tillbook.operators import listings, posting, quality
from tillbook.plans.session import scratch_dir
from tillbook.sources import sale_buckets

BY_SALE = {
    "alignment": listings.sale_alignment,
    "literal": listings.header_line_rows,
    "header_vs_lines": quality.header_vs_lines,
    "post_sales": lambda t: posting.post_sales(t["sale_headers"], t["transaction_items"]),
}


def _rows(df):
    return sorted(map(repr, df.collect()))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _exchanges(df):
    return re.findall(r"Exchange \w+\(.*", _plan(df))


def _out(spark):
    return scratch_dir(spark, f"sales-{uuid.uuid4().hex}")


@pytest.fixture(scope="module")
def stored(spark, model):
    out = _out(spark)
    sale_buckets.materialize_sale_buckets(spark, model, out)
    return out


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", BY_SALE)
def test_by_sale_needs_no_exchange(spark, model, stored, no_broadcast, name):
    parts = sale_buckets.load_sale_buckets(spark, stored)
    assert len(parts) == 1
    found = sale_buckets.over_parts(parts, BY_SALE[name])
    assert _exchanges(found) == []
    assert _exchanges(BY_SALE[name](model)) != []
    assert _rows(found) == _rows(BY_SALE[name](model).select(*found.columns))


def test_report_exchanges_only_its_own_groups(spark, stored, no_broadcast):
    parts = sale_buckets.load_sale_buckets(spark, stored)
    by_month = listings.alignment_by_month(sale_buckets.over_parts(parts, listings.sale_alignment))
    found = _exchanges(by_month)
    assert len(found) == 1 and "hashpartitioning(txn_id" not in found[0]


def test_another_session_declares_the_buckets(spark, stored, no_broadcast):
    sale_buckets.forget(spark, stored)
    parts = sale_buckets.load_sale_buckets(spark, stored)
    found = sale_buckets.over_parts(parts, BY_SALE["post_sales"])
    assert _exchanges(found) == [] and found.count() > 0


def test_heavy_sales_and_rows_without_id(spark, model):
    """A limit of three lines makes most sales heavy; headers and lines without an id stay too."""
    t = dict(model)
    head = model["sale_headers"].limit(1).withColumn("txn_id", F.lit(None).cast("long"))
    line = model["transaction_items"].limit(1).withColumn("txn_id", F.lit(None).cast("long"))
    t["sale_headers"] = model["sale_headers"].unionByName(head)
    t["transaction_items"] = model["transaction_items"].unionByName(line)
    out = _out(spark)
    sale_buckets.materialize_sale_buckets(spark, t, out, heavy_lines=3)
    parts = sale_buckets.load_sale_buckets(spark, out)
    assert len(parts) == 2
    n = [p["transaction_items"].count() for p in parts]
    assert min(n) > 0 and sum(n) == t["transaction_items"].count()
    assert parts[0]["transaction_items"].groupBy("txn_id").count().agg(F.max("count")).first()[0] <= 3
    assert sum(p["sale_headers"].filter("txn_id is null").count() for p in parts) == 1
    for op in BY_SALE.values():
        want = op({**t, "transactions": None} if op is listings.sale_alignment else _with_totals(t))
        assert _rows(sale_buckets.over_parts(parts, op)) == _rows(want.select(*op(parts[0]).columns))


def _with_totals(t):
    from tillbook.sources.adapter import with_sale_totals
    return {**t, "transactions": with_sale_totals(t["sale_headers"], t["transaction_items"])}


def test_no_sales(spark, model):
    t = {**model, "sale_headers": model["sale_headers"].limit(0), "transaction_items": model["transaction_items"].limit(0)}
    out = _out(spark)
    sale_buckets.materialize_sale_buckets(spark, t, out)
    parts = sale_buckets.load_sale_buckets(spark, out)
    for op in BY_SALE.values():
        assert sale_buckets.over_parts(parts, op).count() == 0


def test_buckets_grow_with_the_lines(spark):
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sale_buckets._buckets(spark, 0, 100) == width
    assert sale_buckets._buckets(spark, 100 * width + 1, 100) == width + 1
