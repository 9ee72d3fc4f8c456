"""The scan of several levels, month summaries, and changes that rewrite only what they touch."""

import datetime as dt
import glob
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tillbook.operators import changes, inventory, levels
from tillbook.plans import session
from tillbook.plans.session import clear_scratch, scratch_dir, written
from tillbook.sources import versions
from tillbook.sources.model_store import add_movements, load_model, load_stock_months, materialize_model, verify_day, write_stock_months


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def fold(moves, openings):
    level, out = dict(openings), {}
    for key, _, seq, change in sorted(moves, key=lambda r: (r[0], r[1], r[2])):
        level[key] = max(0, level.get(key, 0) + change)
        out[key, seq] = level[key]
    return out, level


@pytest.mark.parametrize("run_rows, fan", [(1 << 20, 1024), (64, 1024), (32, 3)])
def test_hot_keys_over_several_levels(spark, monkeypatch, run_rows, fan):
    """One key holds nearly all rows: the result is the fold's, and no window holds more than its share of them."""
    monkeypatch.setattr(levels, "RUN_ROWS", run_rows)
    monkeypatch.setattr(levels, "FAN", fan)
    rng = random.Random(1)
    moves = [(7 if rng.random() < 0.9 else rng.randrange(6), i // 2, i, rng.choice([-9, -4, -1, 3, 8])) for i in range(3000)]
    openings = [(k, rng.randrange(30)) for k in range(1, 8)]
    df = spark.createDataFrame(moves, "k long, block int, seq int, change int")
    opens = spark.createDataFrame(openings, "k long, opening long")
    want, last = fold(moves, openings)
    before = len(session._WRITTEN)
    got = levels.floored_ledger(df, "k", "block", ["seq"], "change", opens, "opening").collect()
    assert {(r.k, r.seq): r.stock_after for r in got} == want
    closing = levels.floored_closing(df, "k", "block", ["seq"], "change", opens, "opening").collect()
    assert {r.k: r.closing for r in closing} == {k: v for k, v in last.items() if k in {m[0] for m in moves}}
    runs = [p for p in session._WRITTEN[before:] if "/runs-" in p]
    assert bool(runs) == (run_rows < 1000)
    for path in runs:
        dealt = spark.read.parquet(path)
        assert dealt.groupBy("k", "_part").count().agg(F.max("count")).first()[0] <= 3 * run_rows    # ranges are sampled
        assert dealt.filter("k = 7").select("_part").distinct().count() > 3000 * 0.4 / (3 * run_rows)
    assert levels.month_summaries(df.withColumn("m", F.floor(F.col("block") / 500).cast("string")), "k", "m", "block", ["seq"],
                                  "change").count() == len({(m[0], m[1] // 500) for m in moves})


def test_decimal_levels_of_materials(spark, monkeypatch, model):
    whole = rows_of(inventory.material_stock_ledger(model["material_movements"], model["raw_materials"]).select("raw_material_id", "qty_after"))
    monkeypatch.setattr(levels, "RUN_ROWS", 500)
    monkeypatch.setattr(levels, "FAN", 4)
    assert rows_of(inventory.material_stock_ledger(model["material_movements"], model["raw_materials"]).select("raw_material_id", "qty_after")) == whole


@pytest.fixture(scope="module")
def store(spark, model):
    out = scratch_dir(spark, f"model-{uuid.uuid4().hex}")
    materialize_model(spark, model, out)
    write_stock_months(spark, out)
    return out


def month_rows(spark, out, month, year):
    t = load_model(spark, out)
    return inventory.month_stock_ledger(t["stock_movements"], load_stock_months(spark, out), t["products"], month, year)


def test_a_month_opens_with_the_summaries_before_it(spark, store, model):
    names = ["product_id", "txn_id", "kind", "stock_after"]
    whole = inventory.stock_ledger(model["stock_movements"], model["products"])
    for month, year in [(3, 1997), (1, 1992), (12, 1998)]:
        got = month_rows(spark, store, month, year)
        wanted = whole.filter((F.year("log_date") == year) & (F.month("log_date") == month))
        assert rows_of(got.select(*names)) == rows_of(wanted.select(*names))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_month" in plan


def files(out, name):
    return set(glob.glob(f"{out.removeprefix('file://').removeprefix('file:')}/*/{name}/**/*.parquet", recursive=True))


def test_late_movements_and_verified_days_rewrite_their_months_only(spark, model):
    out = scratch_dir(spark, f"model-{uuid.uuid4().hex}")
    materialize_model(spark, model, out)
    write_stock_months(spark, out)
    t = load_model(spark, out)
    late = (t["stock_movements"].filter("log_month = '1996-05' and quantity_change < 0").limit(20)
            .withColumn("txn_id", F.col("txn_id") + 10**9).withColumn("quantity_change", F.col("quantity_change") - 5).drop("log_month"))
    late = written(late, "late")
    before = files(out, "stock_movements"), files(out, "stock_months")
    add_movements(spark, out, late)
    for old, name in zip(before, ("stock_movements", "stock_months")):
        new = files(out, name) - old
        assert old <= files(out, name) and new and all("log_month=1996-05" in f for f in new)
    names = ["product_id", "txn_id", "kind", "stock_after"]
    moved = load_model(spark, out)["stock_movements"]
    assert moved.count() == model["stock_movements"].count() + late.count()
    whole = inventory.stock_ledger(moved, model["products"]).filter("log_month = '1997-03'")
    assert rows_of(month_rows(spark, out, 3, 1997).select(*names)) == rows_of(whole.select(*names))

    day = dt.date(1997, 3, 15)
    old = files(out, "transactions")
    verify_day(spark, out, day)
    new = files(out, "transactions") - old
    assert new and all("sale_month=1997-03" in f for f in new)
    wanted = changes.mark_verified(t["transactions"], day).select("txn_id", "transaction_date", "verified", "total")
    assert rows_of(load_model(spark, out)["transactions"].select(*wanted.columns)) == rows_of(wanted)


def test_a_writer_that_was_overtaken_is_refused(spark):
    out = scratch_dir(spark, f"versions-{uuid.uuid4().hex}")
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "m string, x int")
    versions.publish(out, "v", {"t": df}, lambda _, d, path: d.write.partitionBy("m").parquet(path))
    base = versions.published_at(spark, out, "v")
    change = {"t": ("m", ["a"], spark.createDataFrame([(10, "a"), (11, "a")], "x int, m string"))}
    versions.replace_partitions(spark, out, "v", change, base)
    assert rows_of(versions.read_published(spark, out, "v")["t"].select("m", "x")) == [("a", 10), ("a", 11), ("b", 2), (None, 3)]
    with pytest.raises(versions.StaleBase):
        versions.replace_partitions(spark, out, "v", change, base)


def test_scratch_folders_are_deleted(spark):
    df = written(spark.range(5), "gone")
    assert df.count() == 5
    assert clear_scratch(spark) >= 1 and session._WRITTEN == []
    assert not glob.glob(f"{scratch_dir(spark, 'gone')}-*")


def test_only_hot_keys_are_cut(spark, monkeypatch):
    """Blocks are placed for the keys that need them: 300 keys of two rows add none, nor do undated rows get lost."""
    monkeypatch.setattr(levels, "RUN_ROWS", 160)
    moves = [(k, d, k * 2 + d, -3 if d else 2) for k in range(1, 301) for d in (0, 1)]
    moves += [(0, i // 4 - 1 if i > 3 else None, 1000 + i, -2 if i % 3 else 5) for i in range(200)]
    df = spark.createDataFrame(moves, "k long, block int, seq int, change int")
    opens = spark.createDataFrame([(k, k % 4) for k in range(301)], "k long, opening long")
    want, last = fold([(k, -9 if b is None else b, s, c) for k, b, s, c in moves], [(k, k % 4) for k in range(301)])
    before = len(session._WRITTEN)
    got = levels.floored_ledger(df, "k", "block", ["seq"], "change", opens, "opening").collect()
    assert {(r.k, r.seq): r.stock_after for r in got} == want and {r.block for r in got} == {m[1] for m in moves}
    closing = levels.floored_closing(df, "k", "block", ["seq"], "change", opens, "opening").collect()
    assert {r.k: r.closing for r in closing} == last
    placed = [spark.read.parquet(p).count() for p in session._WRITTEN[before:] if "/blocks-" in p]
    assert placed == [50, 50]
