import pytest
"""Sinks (A6-A8), the J10 batch recorder, and the driver entry points."""

import csv
import glob
import os
import uuid

from pyspark.sql import functions as F

from helpers import items, products, txns
from tillbook.operators import changes
from tillbook.plans.session import scratch_dir
from tillbook.sources import sinks, versions


def _out(spark, name):
    return scratch_dir(spark, f"{name}-{uuid.uuid4().hex}")


def test_export_csv_quotes_and_strips(spark):
    df = spark.createDataFrame([(1, '  <b>Bread</b> "special" ')], "id int, label string")
    path = _out(spark, "csv")
    sinks.export_csv(df.coalesce(1), path)
    f = glob.glob(f"{path}/*.csv")[0]
    with open(f, newline="", encoding="utf-8") as fh:
        rows = list(csv.reader(fh))
    assert rows[0] == ["id", "label"] and rows[1] == ["1", 'Bread "special"']
    assert '""special""' in open(f, encoding="utf-8").read()


def test_export_json_nested_and_append(spark):
    df = spark.createDataFrame([(1, [(1, "a")])], "id int, items array<struct<n:int,s:string>>")
    p = _out(spark, "json")
    sinks.export_json(df, p)
    assert spark.read.json(p).collect()[0]["items"][0]["s"] == "a"
    p2 = _out(spark, "append")
    d = spark.createDataFrame([("2026-05-01", 1)], "d string, v int").withColumn("d", F.to_date("d"))
    sinks.append(d, p2, "d")
    sinks.append(d, p2, "d")
    assert spark.read.parquet(p2).count() == 2
    assert os.path.isdir(f"{p2}/entry_month=2026-05")


def test_record_sales_publishes_manifest(spark):
    it = items(spark, [(1, 1, 10, "Bread", 2, "18500", "7000")])
    tx = txns(spark, [(1, "2026-05-20", "10:00:00", "QRIS")])
    p = products(spark, [(10, "bun", "Bread", "18500", "7000", 1, 5, True)])
    out = _out(spark, "record")
    changes.record_sales(tx, it, p, out, "v1", "2026-05-20")
    got = versions.read_published(spark, out)
    product = got["products"].collect()[0]
    assert product.stock == 0 and str(product.updated_at) == "2026-05-20"         # floored
    assert got["journal_entries"].count() == 5
    log = got["inventory_logs"].collect()[0]
    assert (log.quantity_change, log.product_name, log.movement_type, log.performed_by) == (-2, "p10", "Sale", "c1")
    assert not got["transactions"].collect()[0].verified


def test_a_receipt_is_recorded_once(spark):
    it = items(spark, [(1, 1, 10, "Bread", 2, "18500", "7000"), (2, 1, 10, "Bread", 1, "18500", "7000"),
                       (3, 1, 10, "Bread", 1, "18500", "7000")])
    tx = txns(spark, [(1, "2026-05-20", "10:00:00", "QRIS"), (2, "2026-05-20", "11:00:00", "Cash")])
    p = products(spark, [(10, "bun", "Bread", "18500", "7000", 9, 5, True)])
    out = _out(spark, "replay")
    changes.record_sales(tx.filter("txn_id = 1"), it, p, out, "v1", "2026-05-20")
    stock = versions.read_published(spark, out)["products"]
    changes.record_sales(tx, it, stock, out, "v2", "2026-05-20")
    got = versions.read_published(spark, out)
    assert [r.txn_id for r in got["transactions"].collect()] == [2]
    assert [(r.txn_id, r.rejected) for r in got["rejected_sales"].collect()] == [(1, "receipt recorded before")]
    assert got["products"].collect()[0].stock == 6
    assert got["transaction_items"].count() == 1 and got["receipts"].count() == 2
    # the whole batch again: nothing changes, the index keeps its receipts
    changes.record_sales(tx, it, got["products"], out, "v3", "2026-05-20")
    again = versions.read_published(spark, out)
    assert again["transactions"].count() == again["inventory_logs"].count() == again["journal_entries"].count() == 0
    assert again["products"].collect()[0].stock == 6 and again["rejected_sales"].count() == again["receipts"].count() == 2
    # two sales of one receipt, and one without
    receipt = F.when(F.col("txn_id") == 5, F.lit(None)).otherwise(F.lit("R-9"))
    odd = txns(spark, [(3, "2026-05-21", "12:00:00", "Cash"), (4, "2026-05-21", "09:00:00", "Cash"),
                       (5, "2026-05-21", "09:00:00", "Cash")]).withColumn("receipt_no", receipt)
    changes.record_sales(odd, it, again["products"], out, "v4", "2026-05-21")
    last = versions.read_published(spark, out)
    assert [r.txn_id for r in last["transactions"].collect()] == [4]
    assert sorted((r.txn_id, r.rejected) for r in last["rejected_sales"].collect()) == [
        (3, "receipt of an earlier sale of the batch"), (5, "receipt missing")]
    assert last["products"].collect()[0].stock == 6


def test_receipt_lookup_reads_the_buckets_of_the_batch(spark):
    from tillbook.sources import receipts
    it = items(spark, [(1, 1, 10, "Bread", 2, "18500", "7000")])
    tx = txns(spark, [(1, "2026-05-20", "10:00:00", "QRIS")])
    p = products(spark, [(10, "bun", "Bread", "18500", "7000", 9, 5, True)])
    out = _out(spark, "buckets")
    changes.record_sales(tx, it, p, out, "v1", "2026-05-20")
    parts = versions.latest(spark, out)["tables"][receipts.TABLE]
    plan = receipts.known(spark, parts, tx)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_a_version_made_from_an_older_one_is_refused(spark):
    out = _out(spark, "stale")
    rows = spark.range(3)
    versions.publish(out, "a", {"rows": rows}, base_at=0)
    with pytest.raises(versions.StaleBase):
        versions.publish(out, "b", {"rows": rows}, base_at=0)


def test_failed_batch_leaves_the_old_version(spark):
    it = items(spark, [(1, 1, 10, "Bread", 2, "18500", "7000")])
    tx = txns(spark, [(1, "2026-05-20", "10:00:00", "QRIS")])
    p = products(spark, [(10, "bun", "Bread", "18500", "7000", 5, 5, True)])
    out = _out(spark, "failed")
    changes.record_sales(tx, it, p, out, "v1", "2026-05-20")
    broken = p.withColumn("stock", F.raise_error(F.lit("disk lost")).cast("int"))
    with pytest.raises(Exception, match="disk lost"):
        changes.record_sales(tx, it, broken, out, "v2", "2026-05-21")
    assert versions.read_published(spark, out)["products"].collect()[0].stock == 3
    with pytest.raises(ValueError):
        versions.read_published(spark, out, "v2")


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 90


def test_runner_writes_a_registered_query(spark):
    from tillbook.plans.run import main
    out = _out(spark, "runner")
    assert main(["cash_position", "/root/testdata/sf0.001", out, "json"]) == 0
    rows = spark.read.json(out).collect()
    assert {r.payment_method for r in rows} == {"Cash", "QRIS", "GoPay", "Debit", "TOTAL"}


def test_accounting_keys_without_a_training_library():
    """A missing library of the training-data operators leaves the other keys in place."""
    import subprocess
    import sys
    code = ("import sys; sys.modules['sentencepiece'] = None\n"
            "import __spark_entry__ as E\n"
            "q = E.queries(); print(len(q), len(E.oracle_sql()), 'general_ledger_all' in q, 'pipeline' in q)")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert out[0] == out[1] and out[2:] == ["True", "False"]
