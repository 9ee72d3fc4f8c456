"""L1 with everything a sale changes: batches are recorded whole and once."""

import datetime as dt
import uuid
from decimal import Decimal as D

import pytest

from tests.helpers import items, products, txns
from tillbook.operators import changes
from tillbook.plans.session import scratch_dir
from tillbook.sources import versions
from tillbook.streaming import recording
from tillbook.streaming.sales_stream import nested_sales


def _base(spark):
    return scratch_dir(spark, f"recording-{uuid.uuid4().hex}")


@pytest.fixture(scope="module")
def shop(spark):
    return products(spark, [(10, "bun", "Bread", "100", "40", 9, 1, True), (11, "cake", "Cake", "200", "90", 2, 1, True)])


def _sale(spark, n, day, qty, product=10, method="Cash"):
    category, price, cost = {10: ("Bread", "100", "40"), 11: ("Cake", "200", "90")}[product]
    return nested_sales(txns(spark, [(n, day, "10:00:00", method)]), items(spark, [(n, 1, product, category, qty, price, cost)]))


def _stock(t):
    return {r.product_id: r.stock for r in t["products"].collect()}


def _run(spark, base, shop, books="books", checkpoint="_checkpoint"):
    q = recording.start_recording_stream(spark, f"{base}/incoming", f"{base}/{books}", f"{base}/{checkpoint}", shop)
    q.awaitTermination()
    assert q.exception() is None
    return versions.read_published(spark, f"{base}/{books}")


def test_batches_add_up_and_replays_change_nothing(spark, shop):
    base = _base(spark)
    first = _sale(spark, 1, "2026-05-20", 2)
    first.unionByName(first).write.mode("append").parquet(f"{base}/incoming")
    t = _run(spark, base, shop)
    assert t["transactions"].count() == 1 and _stock(t) == {10: 7, 11: 2} and t["rejected_sales"].count() == 0
    # more sales; a cake sells out: stock is floored
    _sale(spark, 2, "2026-05-21", 1).unionByName(_sale(spark, 3, "2026-05-21", 5, 11)).write.mode("append").parquet(f"{base}/incoming")
    t = _run(spark, base, shop)
    assert t["transactions"].count() == 3 and t["journal_entries"].count() == 15 and t["inventory_logs"].count() == 3
    assert _stock(t) == {10: 6, 11: 0}
    assert {r.product_id: r.updated_at for r in t["products"].collect()} == {10: dt.date(2026, 5, 21), 11: dt.date(2026, 5, 21)}
    # the first sale comes back, also to a stream that lost its checkpoint
    first.write.mode("append").parquet(f"{base}/incoming")
    t = _run(spark, base, shop)
    assert (t["transactions"].count(), t["rejected_sales"].count(), _stock(t)) == (3, 1, {10: 6, 11: 0})
    t = _run(spark, base, shop, checkpoint="_other")
    assert (t["transactions"].count(), t["receipts"].count(), _stock(t)) == (3, 3, {10: 6, 11: 0})
    assert t["rejected_sales"].count() == 4
    assert t["journal_entries"].agg({"debit": "sum"}).first()[0] == t["journal_entries"].agg({"credit": "sum"}).first()[0]


def test_a_batch_run_again_finds_its_version(spark, shop):
    out = f"{_base(spark)}/books"
    versions.publish(out, "opening", {"products": shop})
    sale = _sale(spark, 1, "2026-05-20", 2)
    assert recording.record_batch(sale, out, "s-0")
    at = versions.published_at(spark, out)
    assert not recording.record_batch(sale, out, "s-0")
    assert versions.published_at(spark, out) == at
    assert versions.read_published(spark, out)["rejected_sales"].count() == 0


def test_a_batch_that_fails_before_publishing_shows_nothing(spark, shop, monkeypatch):
    out = f"{_base(spark)}/books"
    versions.publish(out, "opening", {"products": shop})
    sale = _sale(spark, 1, "2026-05-20", 2)

    def lost(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(versions, "_announce", lost)
        with pytest.raises(RuntimeError, match="driver lost"):
            recording.record_batch(sale, out, "s-0")
    assert set(versions.latest(spark, out)["tables"]) == {"products"}
    assert recording.record_batch(sale, out, "s-0")
    t = versions.read_published(spark, out)
    assert t["transactions"].count() == 1 and _stock(t) == {10: 7, 11: 2}


def test_odd_records(spark, shop):
    """No receipt, no lines, no date, an unknown product, copies that differ, an empty batch."""
    from pyspark.sql import functions as F
    out = f"{_base(spark)}/books"
    versions.publish(out, "opening", {"products": shop})
    none = F.lit(None)
    sale = _sale(spark, 1, "2026-05-20", 2)
    batch = (sale.unionByName(sale.withColumn("transaction_time", F.lit("09:00:00")))
             .unionByName(_sale(spark, 2, "2026-05-20", 1).withColumn("receipt_no", none.cast("string")))
             .unionByName(_sale(spark, 3, "2026-05-20", 1).withColumn("items", F.array().cast(sale.schema["items"].dataType)))
             .unionByName(_sale(spark, 4, "2026-05-20", 1).withColumn("transaction_date", none.cast("date")))
             .unionByName(_sale(spark, 5, "2026-05-20", 1).withColumn("items", F.transform(
                 "items", lambda i: i.withField("product_id", F.lit(99).cast("long"))))))
    assert recording.record_batch(batch, out, "s-0")
    t = versions.read_published(spark, out)
    kept = {r.txn_id: (r.transaction_time, r.total) for r in t["transactions"].collect()}
    assert set(kept) == {1, 3, 4, 5} and kept[1] == ("09:00:00", D("222.00")) and kept[3][1] == 0
    assert [(r.txn_id, r.rejected) for r in t["rejected_sales"].collect()] == [(2, "receipt missing")]
    assert _stock(t) == {10: 6, 11: 2}
    assert recording.record_batch(batch.limit(0), out, "s-1")
    assert versions.read_published(spark, out)["transactions"].count() == 4


def test_only_the_written_lines_are_read_again(spark, shop, monkeypatch):
    base = _base(spark)
    lines = items(spark, [(1, 1, 10, "Bread", 2, "100", "40"), (2, 1, 11, "Cake", 5, "200", "90"), (3, 1, 10, "Bread", 1, "100", "40")])
    lines.write.parquet(f"{base}/given")
    read, publish = {}, versions.publish

    def watched(out_dir, version, tables, write=None, *rest):
        def noted(name, df, path):
            read[name] = any("/given/" in f for f in df.inputFiles())
            write(name, df, path)
        return publish(out_dir, version, tables, noted, *rest)

    monkeypatch.setattr(versions, "publish", watched)
    sales = txns(spark, [(1, "2026-05-20", "09:00:00", "Cash"), (2, "2026-05-20", "10:00:00", "Cash")])
    changes.record_sales(sales, spark.read.parquet(f"{base}/given"), shop, f"{base}/books", "day", "2026-05-20")
    assert [name for name in read if read[name]] == ["transaction_items"]
    t = versions.read_published(spark, f"{base}/books")
    assert t["transaction_items"].count() == 2 and _stock(t) == {10: 7, 11: 0}
    assert sorted((r.product_name, r.reason, r.stock_after) for r in t["inventory_logs"].collect()) == [
        ("p10", "Sale: RCP-0000001", 7), ("p11", "Sale: RCP-0000002", 0)]


def test_a_batch_delivered_again_leaves_its_lines_unread(spark, shop, monkeypatch):
    """A batch without a new receipt is rejected from its headers; one new receipt among known ones is recorded whole."""
    base, seen, one_copy = scratch_dir(spark, f"again-{uuid.uuid4().hex}"), [], recording.one_copy
    monkeypatch.setattr(recording, "one_copy", lambda sales: seen.append("items" in sales.columns) or one_copy(sales))
    first, other = _sale(spark, 1, "2026-05-20", 2), _sale(spark, 2, "2026-05-21", 1)
    counts = []
    for batch in (first, first, first.unionByName(other)):
        batch.write.mode("append").parquet(f"{base}/incoming")
        t = _run(spark, base, shop)
        counts.append([t[name].count() for name in ("transactions", "transaction_items", "receipts", "rejected_sales")])
    assert seen == [True, False, True]
    assert counts == [[1, 1, 1, 0], [1, 1, 1, 1], [2, 2, 2, 2]]


def test_a_second_delivery_nests_no_line_again(spark, model, monkeypatch):
    from tillbook.streaming import sales_stream
    read, deliver = [], sales_stream.deliver
    monkeypatch.setattr(sales_stream, "deliver", lambda sales, path: read.append(sales.inputFiles()) or deliver(sales, path))
    posted = sales_stream.replay_and_post(spark, model["transactions"], model["transaction_items"], copies=3)
    assert any("lineitem" in f for f in read[0]) and len(read) == 3
    assert all("/incoming/" in f for files in read[1:] for f in files) and read[1] == read[2]
    assert posted.select("reference_no", "line_no").distinct().count() == posted.count()
