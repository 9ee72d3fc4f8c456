"""Invariants over the model derived from the sf0.001 tables."""

import random

from pyspark.sql import functions as F

from tillbook.operators import inventory, ledger, posting
from tillbook.plans.q_ledger import journal


def test_every_receipt_balances(model):
    assert posting.unbalanced_receipts(journal(model)).count() == 0


def test_ledger_debits_equal_journal_debits(model):
    j = journal(model)
    gl = ledger.general_ledger(model["chart_of_accounts"], j)
    assert gl.agg(F.sum("debit")).collect()[0][0] == j.agg(F.sum("debit")).collect()[0][0]


def test_stock_ledger_equals_sequential_fold(model):
    led = inventory.stock_ledger(model["stock_movements"], model["products"]).select(
        "product_id", "log_date", "log_time", "txn_id", "line_seq", "kind", "quantity_change", "stock_after")
    opening = {r.product_id: r.stock for r in model["products"].select("product_id", "stock").collect()}
    rows = sorted(led.collect(), key=lambda r: (r.product_id, r.log_date, r.log_time, r.txn_id, r.line_seq, r.kind))
    cur, last = {}, None
    for r in rows:
        s = cur.get(r.product_id, opening[r.product_id])
        s = max(0, s + r.quantity_change)
        cur[r.product_id] = s
        assert r.stock_after == s
    assert min(cur.values()) >= 0


def test_blocked_scan_random_sequences(spark):
    rnd = random.Random(7)
    rows, expect = [], {}
    for p in range(20):
        s = rnd.randint(0, 30)
        opening = s
        per_day = rnd.randint(1, 8)      # the block (day) must be the leading order key
        for i in range(rnd.randint(1, 60)):
            c = rnd.randint(-25, 20)
            day = i // per_day
            rows.append((p, day, i, c))
            s = max(0, s + c)
            expect[(p, i)] = s
        rows.append((p, -1, -1, 0))   # marker row for the opening
        expect[(p, -1)] = opening
    mv = spark.createDataFrame([r for r in rows if r[2] >= 0], "product_id long, day int, seq int, change int")
    op = spark.createDataFrame([(p, expect[(p, -1)]) for p in range(20)], "product_id long, opening long")
    led = inventory.floored_ledger(mv, "product_id", "day", ["seq"], "change", op, "opening")
    for r in led.collect():
        assert r.stock_after == expect[(r.product_id, r.seq)]


def test_closing_stock_non_negative(model):
    led = inventory.stock_ledger(model["stock_movements"], model["products"])
    cs = inventory.closing_stock(led, model["products"])
    assert cs.filter("closing_stock < 0").count() == 0
    assert cs.count() == model["products"].count()


def test_closing_from_blocks_equals_last_ledger_row(model):
    led = inventory.stock_ledger(model["stock_movements"], model["products"])
    from_ledger = inventory.closing_stock(led, model["products"])
    from_blocks = inventory.closing_stock(model["stock_movements"], model["products"])
    assert sorted(from_ledger.collect()) == sorted(from_blocks.collect())


def test_day_movements_equal_filtered_movements(model):
    import datetime as dt
    from pyspark.sql import functions as F
    from tillbook.sources.adapter import stock_movements_on
    for day in [dt.date(1997, 3, 15), dt.date(1996, 1, 2)]:
        cols = ["product_id", "log_date", "log_time", "txn_id", "kind", "quantity_change", "reason"]
        a = stock_movements_on(model, day).select(*cols)
        b = model["stock_movements"].filter(F.col("log_date") == F.lit(day)).select(*cols)
        assert sorted(a.collect()) == sorted(b.collect())
