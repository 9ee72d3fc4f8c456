"""The stored (materialized, month-partitioned) model gives the same results
as the lazy adapter, and period filters prune month partitions."""

import datetime as dt
import uuid

from tillbook.operators import inventory, ledger, posting, reports
from tillbook.plans.session import scratch_dir
from tillbook.sources.model_store import load_model, materialize_model


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stored_model_matches_lazy_model(spark, model):
    out = scratch_dir(spark, f"model-{uuid.uuid4().hex}")
    materialize_model(spark, model, out)
    stored = load_model(spark, out)
    assert stored["transaction_items"].count() == model["transaction_items"].count()
    for month, year in [(3, 1997), (None, 1998), (None, None)]:
        assert _rows(reports.report_summary(stored, month, year)) == _rows(reports.report_summary(model, month, year))
        assert _rows(reports.by_category(stored, month, year)) == _rows(reports.by_category(model, month, year))
        day = dt.date(1997, 3, 15)
        assert _rows(inventory.product_sales(stored, day, month, year)) == _rows(inventory.product_sales(model, day, month, year))
    j1, j2 = posting.build_journal(stored), posting.build_journal(model)
    assert _rows(ledger.general_ledger(stored["chart_of_accounts"], j1, 3, 1997)) == \
        _rows(ledger.general_ledger(model["chart_of_accounts"], j2, 3, 1997))
    led1 = inventory.stock_ledger(stored["stock_movements"], stored["products"]).select("product_id", "stock_after")
    led2 = inventory.stock_ledger(model["stock_movements"], model["products"]).select("product_id", "stock_after")
    assert _rows(led1) == _rows(led2)
    plan = reports.by_payment(stored, 3, 1997)._jdf.queryExecution().executedPlan().toString()
    assert "sale_month" in plan and "PartitionFilters" in plan


def test_stored_movements_prune_by_month(spark, model):
    from tillbook.sources.adapter import stock_movements_on
    out = scratch_dir(spark, f"model-{uuid.uuid4().hex}")
    materialize_model(spark, model, out)
    stored = load_model(spark, out)
    day = dt.date(1997, 3, 15)
    lazy = inventory.movements_on_day(stock_movements_on(model, day), day)
    kept = inventory.movements_on_day(stock_movements_on(stored, day), day)
    assert _rows(kept) == _rows(lazy)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "log_month" in plan and "PartitionFilters" in plan


def test_totals_are_made_from_the_stored_lines(spark, monkeypatch):
    from tillbook.sources import adapter, versions
    model = adapter.load(spark, "/root/testdata/sf0.001")
    read, publish = {}, versions.publish

    def watched(out_dir, version, tables, write):
        def noted(name, df, path):
            read[name] = {f.rstrip("/").split("/")[-1] for f in df.inputFiles()}
            write(name, df, path)
        return publish(out_dir, version, tables, noted)

    monkeypatch.setattr(versions, "publish", watched)
    out = scratch_dir(spark, f"model-{uuid.uuid4().hex}")
    materialize_model(spark, model, out)
    assert "orders.parquet" in read["transactions"] and not {"lineitem.parquet", "part.parquet"} & read["transactions"]
    assert _rows(load_model(spark, out)["transactions"].select("txn_id", "subtotal", "tax", "total")) == \
        _rows(model["transactions"].select("txn_id", "subtotal", "tax", "total"))


def _all_columns(df, other):
    """Rows of ``df`` in the columns that both frames have, as text."""
    names = [c for c in df.columns if c in other.columns]
    return sorted(str(tuple(r)) for r in df.select(*names).collect())


def test_lines_and_movements_are_numbered_once(spark, monkeypatch):
    """Both tables come from one staged table of numbered lines, and have the rows of the lazy model; lines whose sale or
    product is unknown and products listed twice included."""
    from pyspark.sql import functions as F
    from tillbook.sources import adapter, versions
    model = adapter.load(spark, "/root/testdata/sf0.001")
    made, read_rows = {}, spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(50)
    odd = (read_rows.withColumn("l_orderkey", F.col("l_orderkey") + 10**9).unionByName(
        read_rows.withColumn("l_partkey", F.col("l_partkey") + 10**9)).withColumn("l_returnflag", F.lit("R")))
    lineitem = model["lineitem"].unionByName(odd.select(*model["lineitem"].columns))

    def faulty(products):
        return {**model, "lineitem": lineitem, "products": products,
                "transaction_items": adapter.items_from_lineitem(lineitem, products),
                "stock_movements": adapter.stock_movements(lineitem, model["sale_headers"])}

    def watched(out_dir, version, tables, write, publish=versions.publish):
        def noted(name, df, path):
            write(name, df, path)
            made[name] = spark.read.parquet(path).count()
        return publish(out_dir, version, tables, noted)

    monkeypatch.setattr(versions, "publish", watched)
    numbered, seen = adapter.numbered_lines, []
    monkeypatch.setattr("tillbook.sources.model_store.numbered_lines", lambda *a: seen.append(1) or numbered(*a))
    twice = model["products"].unionByName(model["products"].limit(5))
    for products, times in ((model["products"], 1), (twice, 0)):
        t, out = faulty(products), scratch_dir(spark, f"model-{uuid.uuid4().hex}")
        seen.clear()
        materialize_model(spark, t, out)
        assert len(seen) == times
        stored = load_model(spark, out)
        for name in ("transaction_items", "stock_movements"):
            assert made[name] == t[name].count()
            assert _all_columns(stored[name], t[name]) == _all_columns(t[name], stored[name])


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in files.mkString("\n").split("\n") if "/shuffle_" in name}


def test_a_written_model_leaves_no_shuffle_files(spark, model):
    import time
    before, out = _shuffle_files(spark), scratch_dir(spark, f"model-{uuid.uuid4().hex}")
    materialize_model(spark, model, out)
    for _ in range(50):
        left = _shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.2)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_only_returns_are_moved_to_their_months(spark, model, monkeypatch):
    """The movement of a sale lies in the month of its line: it is written from there, in order of product."""
    from pyspark.sql import functions as F
    moved, frame = [], type(spark.range(0))
    ranged = frame.repartitionByRange

    def watched(df, *args):
        if "kind" in df.columns:
            moved.extend(r[0] for r in df.select("kind").distinct().collect())
        return ranged(df, *args)

    monkeypatch.setattr(frame, "repartitionByRange", watched)
    out = scratch_dir(spark, f"model-{uuid.uuid4().hex}")
    materialize_model(spark, model, out)
    assert moved == [1]
    stored = load_model(spark, out)["stock_movements"]
    later = stored.withColumn("file", F.input_file_name()).withColumn("at", F.monotonically_increasing_id())
    rows = [(r.file, r.at, r.product_id) for r in later.select("file", "at", "product_id").collect()]
    by_file = {}
    for file, _, product in sorted(rows):
        by_file.setdefault(file, []).append(product)
    assert all(found == sorted(found) for found in by_file.values())


def test_repeated_and_missing_sale_ids_keep_their_lines(spark, model):
    """Sale ids that repeat in a month, in another month or without a date, and lines and sales without an id."""
    from pyspark.sql import functions as F
    from tillbook.sources import adapter
    few = model["sale_headers"].filter("txn_id % 100 = 7")
    headers = (model["sale_headers"].unionByName(few.withColumn("receipt_no", F.concat("receipt_no", F.lit("-b"))))
               .unionByName(few.withColumn("transaction_date", F.add_months("transaction_date", 5)))
               .unionByName(few.withColumn("transaction_date", F.lit(None).cast("date")))
               .unionByName(few.withColumn("txn_id", F.lit(None).cast("long"))))
    lineitem = model["lineitem"].unionByName(model["lineitem"].limit(40).withColumn("l_orderkey", F.lit(None).cast("long")))
    items = adapter.items_from_lineitem(lineitem, model["products"])
    t = {**model, "sale_headers": headers, "lineitem": lineitem, "transaction_items": items,
         "transactions": adapter.with_sale_totals(headers, items), "stock_movements": adapter.stock_movements(lineitem, headers)}
    dated = items.join(headers.select("txn_id", "transaction_date"), "txn_id", "left")
    for parts in (1, 5):
        out = scratch_dir(spark, f"model-{uuid.uuid4().hex}")
        materialize_model(spark, t, out, parts)
        stored = load_model(spark, out)
        assert set(stored["transaction_items"].columns) == {*dated.columns, "sale_month"}
        for name, want in (("transaction_items", dated), ("transactions", t["transactions"]), ("stock_movements", t["stock_movements"])):
            assert _all_columns(stored[name], want) == _all_columns(want, stored[name])
