"""Hand fixtures with known answers (FIXTURES.md section 3)."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from helpers import items, products, txns, with_totals
from tillbook.operators import changes, inventory, ledger, posting, reports
from tillbook.sources import seeds


def test_one_sale_three_categories(spark):
    it = items(spark, [(1, 1, 10, "Bread", 2, "18500", "7000"), (1, 2, 20, "Pastry", 1, "22000", "8500"),
                       (1, 3, 30, "Cake", 1, "185000", "72000")])
    tot = posting.sale_totals(it).collect()[0]
    assert (tot.subtotal, tot.tax, tot.total, tot.cogs) == (D("244000.00"), D("26840.00"), D("270840.00"),
                                                             D("94500.00"))
    tx = txns(spark, [(1, "2026-05-20", "10:00:00", "QRIS")])
    j = posting.post_sales(tx, it).orderBy("line_no").collect()
    assert len(j) == 7
    got = [(r.account_code, r.debit, r.credit) for r in j]
    assert got == [("1030", D("270840.00"), D("0.00")), ("4010", D("0.00"), D("37000.00")),
                   ("4020", D("0.00"), D("22000.00")), ("4030", D("0.00"), D("185000.00")),
                   ("2030", D("0.00"), D("26840.00")), ("5010", D("94500.00"), D("0.00")),
                   ("1220", D("0.00"), D("94500.00"))]


def test_unmapped_method_and_category(spark):
    it = items(spark, [(1, 1, 10, "Promo", 1, "1000", "100"), (1, 2, 11, "Bread", 1, "2000", "100")])
    tx = txns(spark, [(1, "2026-05-20", "10:00:00", "Voucher")])
    j = posting.post_sales(tx, it).orderBy("line_no").collect()
    assert j[0].account_code == "1010"
    rev = [(r.account_code, r.credit) for r in j if r.description.startswith(("Promo", "Bread"))]
    # two separate 4010 revenue lines, in order of first appearance
    assert rev == [("4010", D("1000.00")), ("4010", D("2000.00"))]


def test_empty_sale(spark):
    from tillbook.operators import listings
    it = items(spark, [(1, 1, 10, "Bread", 1, "1000", "100")])
    tx = txns(spark, [(1, "2026-05-20", "10:00:00", "Cash"), (2, "2026-05-20", "11:00:00", "Cash")])
    t = {"transactions": with_totals(tx, it), "transaction_items": it}
    page = {r.txn_id: r.items for r in listings.nest_items(t["transactions"], it, True).collect()}
    assert len(page[2]) == 1 and all(v is None for v in page[2][0].asDict().values())
    det = {r.txn_id: r.items for r in listings.transaction_detail(t, tx.select("txn_id")).collect()}
    assert det[2] == []
    j = posting.post_sales(tx, it).filter("reference_no = 'RCP-0000002'").orderBy("line_no").collect()
    assert [r.account_code for r in j] == ["1010", "2030", "5010", "1220"]
    assert all(r.debit == 0 and r.credit == 0 for r in j)


def _fold(opening, changes_):
    s, out = opening, []
    for c in changes_:
        s = max(0, s + c)
        out.append(s)
    return out


def test_floored_stock(spark):
    ch = [-3, -4, 10, -2, -20, 1]
    assert _fold(5, ch) == [2, 0, 10, 8, 0, 1]
    for days in ([0] * 6, [0, 0, 1, 1, 2, 3], [0, 1, 2, 3, 4, 5]):   # one block, some blocks, one row per block
        rows = [(1, dt.date(2026, 5, 1 + d), f"10:00:{i:02d}", i, c) for i, (d, c) in enumerate(zip(days, ch))]
        mv = spark.createDataFrame(rows, "product_id long, log_date date, log_time string, seq int, change int")
        op = spark.createDataFrame([(1, 5)], "product_id long, opening long")
        led = inventory.floored_ledger(mv, "product_id", "log_date", ["log_time", "seq"], "change", op, "opening")
        got = [r.stock_after for r in led.orderBy("seq").collect()]
        assert got == [2, 0, 10, 8, 0, 1]


def test_prorated_accrual(spark):
    months = spark.createDataFrame([(dt.date(2026, 4, 1),), (dt.date(2026, 5, 1),)], "month_start date")
    acc = posting.accrue_fixed(months, dt.date(2026, 5, 20)).filter("debit > 0").collect()
    may = sorted((r.account_code, r.debit) for r in acc if r.entry_date == dt.date(2026, 5, 20))
    assert may == [("6010", D("5483871.00")), ("6020", D("3225806.00")), ("6030", D("1161290.00")),
                   ("6040", D("387097.00"))]
    april = sorted((r.account_code, r.debit) for r in acc if r.entry_date == dt.date(2026, 4, 30))
    assert april == [("6010", D("8500000.00")), ("6020", D("5000000.00")), ("6030", D("1800000.00")),
                     ("6040", D("600000.00"))]


def test_month_without_year_is_ignored(spark):
    from tillbook.functions.periods import in_period
    df = spark.createDataFrame([(dt.date(2025, 4, 1),), (dt.date(2026, 5, 1),)], "d date")
    assert in_period(df, "d", 4, None).count() == 2
    assert in_period(df, "d", 4, 2025).count() == 1
    assert in_period(df, "d", None, 2026).count() == 1


def test_ledger_activity_and_contra_balance(spark):
    coa = seeds.chart_of_accounts(spark)
    j = spark.createDataFrame(
        [(dt.date(2026, 5, 1), "1220", D("0"), D("94500")), (dt.date(2026, 5, 1), "5010", D("94500"), D("0")),
         (dt.date(2026, 4, 1), "1010", D("5"), D("0"))],
        "entry_date date, account_code string, debit decimal(14,2), credit decimal(14,2)")
    gl = ledger.general_ledger(coa, j, 5, 2026)
    assert sorted(r.code for r in gl.collect()) == ["1220", "5010"]          # 1010 has no May activity
    tb = {r.name: r for r in ledger.trial_balance(gl).collect()}
    assert tb["Inventory"].debit is None and tb["Inventory"].credit is None   # negative balance not shown
    assert tb["TOTAL"].debit == D("0.00")                                    # 94,500 - 94,500
    chk = ledger.trial_balance_check(gl).collect()[0]
    assert chk.balanced and chk.total_credit == 0


def test_zero_price_margin_is_null(spark):
    p = products(spark, [(1, "free", "Bread", "0", "5", 3, 5, True), (2, "x", "Bread", "100", "40", 3, 5, True)])
    r = {x.product_id: x for x in inventory.price_list(p).collect()}
    assert r[1].margin_pct is None
    assert r[2].margin_pct == D("60.0") and r[2].band == "high" and r[2].status == "Low"


def test_recipe_cost_rounding(spark):
    rec = spark.createDataFrame([(1, 100, D("0.5")), (1, 101, D("1"))],
                                "product_id long, raw_material_id long, qty_per_unit decimal(10,3)")
    mats = spark.createDataFrame([(100, "flour", "Flour & Grain", "gram", D("10"), D("5"), D("2501")),
                                  (101, "egg", "Dairy & Eggs", "gram", D("10"), D("5"), D("10"))],
                                 "id long, name string, category string, unit string, stock_qty decimal(12,2), "
                                 "reorder_point decimal(12,2), unit_cost decimal(12,2)")
    p = products(spark, [(1, "bun", "Bread", "5000", "1000", 3, 5, True)])
    assert inventory.recipe_cost(rec, mats, p).collect()[0].recipe_cost == D("1261.00")


def test_where_used_counts_inactive(spark):
    rec = spark.createDataFrame([(1, 100, D("1")), (2, 100, D("1"))],
                                "product_id long, raw_material_id long, qty_per_unit decimal(10,3)")
    mats = spark.createDataFrame([(100, "flour", "Flour & Grain", "gram", D("10"), D("5"), D("2"), "", True)],
                                 "id long, name string, category string, unit string, stock_qty decimal(12,2), "
                                 "reorder_point decimal(12,2), unit_cost decimal(12,2), supplier string, active boolean")
    p = products(spark, [(1, "bun", "Bread", "5000", "1000", 3, 5, True), (2, "old", "Bread", "1", "1", 3, 5, False)])
    r = inventory.ingredients_overview(mats, rec, p).collect()[0]
    assert (r.used_in_products, r.n_product_names, r.used_in_label) == (2, 1, "bun")


def test_where_used_label_more_than_three(spark):
    rec = spark.createDataFrame([(i, 100, D("1")) for i in range(1, 6)],
                                "product_id long, raw_material_id long, qty_per_unit decimal(10,3)")
    mats = spark.createDataFrame([(100, "flour", "Flour & Grain", "gram", D("10"), D("5"), D("2"), "", True)],
                                 "id long, name string, category string, unit string, stock_qty decimal(12,2), "
                                 "reorder_point decimal(12,2), unit_cost decimal(12,2), supplier string, active boolean")
    p = products(spark, [(i, n, "Bread", "1", "1", 3, 5, True) for i, n in enumerate("edcba", start=1)])
    r = inventory.ingredients_overview(mats, rec, p).collect()[0]
    assert r.used_in_label == "a, b, c +2 lagi"


def test_weekly_trend_zero_fill(spark):
    it = items(spark, [(1, 1, 10, "Bread", 1, "1000", "100"), (2, 1, 10, "Bread", 2, "1000", "100")])
    tx = txns(spark, [(1, "2026-05-18", "10:00:00", "Cash"), (2, "2026-05-20", "10:00:00", "Cash")])
    t = {"transactions": with_totals(tx, it), "transaction_items": it}
    tr = reports.weekly_trend(t, dt.date(2026, 5, 20)).orderBy("date").collect()
    assert len(tr) == 7 and sum(1 for r in tr if r.total == 0) == 5
    assert tr[-1].label == "Wed"


def test_duplicate_receipt_in_stream_posted_once(spark):
    from tillbook.streaming.sales_stream import replay_and_post
    it = items(spark, [(1, 1, 10, "Bread", 2, "18500", "7000"), (1, 2, 20, "Pastry", 1, "22000", "8500")])
    tx = txns(spark, [(1, "2026-05-20", "10:00:00", "QRIS"), (2, "2026-05-20", "10:05:00", "Cash")])
    out = replay_and_post(spark, tx, it, copies=3)
    batch = posting.post_sales(tx, it)
    cols = ["reference_no", "line_no", "account_code", "debit", "credit"]
    assert sorted(out.select(*cols).collect()) == sorted(batch.select(*cols).collect())


def test_stock_adjustments_default_type_and_floor(spark):
    p = products(spark, [(1, "bun", "Bread", "5000", "1000", 4, 5, True)])
    adj = spark.createDataFrame([(1, -10, 1, None), (1, 3, 2, "Restock")],
                                "product_id long, qty_change int, seq int, movement_type string")
    new, log = changes.apply_stock_adjustments(p, adj, dt.date(2026, 5, 20))
    rows = log.orderBy("seq").collect()
    assert [(r.movement_type, r.quantity_change, r.stock_after) for r in rows] == [("Adjustment", -10, 0),
                                                                                  ("Restock", 3, 3)]
    assert new.collect()[0].stock == 3


def test_upsert_latest_wins_and_insert(spark):
    base = spark.createDataFrame([(1, 100, D("1")), (1, 101, D("2"))],
                                 "product_id long, raw_material_id long, qty_per_unit decimal(10,3)")
    ch = spark.createDataFrame([(1, 100, D("5"), 1), (1, 100, D("7"), 2), (2, 100, D("9"), 1)],
                               "product_id long, raw_material_id long, qty_per_unit decimal(10,3), ts int")
    out = changes.upsert_pairs(base, ch, ["product_id", "raw_material_id"], ["qty_per_unit"], ["ts"])
    got = sorted((r.product_id, r.raw_material_id, r.qty_per_unit) for r in out.collect())
    assert got == [(1, 100, D("7.000")), (1, 101, D("2.000")), (2, 100, D("9.000"))]


def test_insert_defaults(spark):
    base = products(spark, [(1, "bun", "Bread", "5000", "1000", 4, 5, True)])
    new = spark.createDataFrame([(2, "roll", "Bread", D("3000"), "SKU-2", True)],
                                "product_id long, name string, category string, price decimal(12,2), sku string, "
                                "active boolean")
    r = changes.insert_rows(base, new, seeds.PRODUCT_DEFAULTS).filter("product_id = 2").collect()[0]
    assert (r.supplier, r.stock, r.reorder_point, r.cost) == ("", 0, 5, D("0.00"))


def test_latest_wins_skew_safe_aggregate(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 5, "e"), (1, 4, "d"), (2, 1, "a")], "k long, ts int, v string")
    out = sorted((r.k, r.ts, r.v) for r in inventory.latest_wins(df, "k", ["ts"]).collect())
    assert out == [(1, 5, "e"), (2, 1, "a")]
    assert "Window" not in inventory.latest_wins(df, "k", ["ts"])._jdf.queryExecution().executedPlan().toString()


def test_quality_rules_find_injected_violations(spark):
    from tillbook.operators import quality
    it = items(spark, [(1, 1, 10, "Bread", 1, "1000", "100"), (9, 1, 99, "Bread", 1, "1000", "100")])
    tx = txns(spark, [(1, "2026-05-20", "10:00:00", "Voucher"), (2, "2026-05-20", "10:00:00", "Cash")])
    tx = with_totals(tx, it).withColumn("receipt_no", F.lit("RCP-1"))          # duplicate receipt numbers
    tx = tx.withColumn("supplied_total", F.col("total") + F.lit(1))
    p = products(spark, [(10, "bun", "Promo", "1000", "100", 3, 5, True)])
    rm = spark.createDataFrame([(100, "flour", "Flour & Grain", "gram", D("1"), D("5"), D("2"))],
                               "id long, name string, category string, unit string, stock_qty decimal(12,2), "
                               "reorder_point decimal(12,2), unit_cost decimal(12,2)")
    rec = spark.createDataFrame([(10, 100, D("1")), (10, 100, D("2")), (11, 101, None)],
                                "product_id long, raw_material_id long, qty_per_unit decimal(10,3)")
    mv = spark.createDataFrame([("Sale",), ("Theft",)], "movement_type string")
    t = {"transactions": tx, "transaction_items": it, "products": p, "raw_materials": rm,
         "product_ingredients": rec, "stock_movements": mv, "chart_of_accounts": seeds.chart_of_accounts(spark),
         "journal": spark.createDataFrame([("9999",)], "account_code string")}
    rules = {(r.rule, r.key): r.n for r in quality.quality_report(t).collect()}
    assert rules[("enum:transactions.payment_method", "Voucher")] == 1
    assert rules[("enum:products.category", "Promo")] == 1
    assert rules[("enum:stock_movements.movement_type", "Theft")] == 1
    assert rules[("unique:transactions.receipt_no", "RCP-1")] == 2
    assert rules[("unique:product_ingredients.product_id+raw_material_id", "10|100")] == 2
    assert rules[("orphan:line_without_sale", "9")] == 1
    assert rules[("orphan:line_without_product", "99")] == 1
    assert rules[("orphan:journal_without_account", "9999")] == 1
    assert rules[("orphan:recipe_without_product", "11")] == 1
    assert rules[("orphan:recipe_without_material", "101")] == 1
    assert rules[("not_null:product_ingredients", "qty_per_unit")] == 1
    assert rules[("header_vs_lines", "*")] == 2


def test_scalar_helpers(spark):
    from tillbook.functions.formatting import receipt_code, rupiah, strip_tags
    from tillbook.functions.periods import local_date
    df = spark.createDataFrame([(D("1234567.00"), "RCP-0000001", " <i>x</i> ", dt.datetime(2026, 5, 20, 18, 30))],
                               "amt decimal(14,2), rcp string, txt string, ts timestamp")
    r = df.select(rupiah(F.col("amt")).alias("a"), receipt_code(F.col("rcp")).alias("b"),
                  strip_tags(F.col("txt")).alias("c"), local_date(F.col("ts")).alias("d")).collect()[0]
    import hashlib
    assert r.a == "Rp 1.234.567"
    assert r.b == hashlib.md5(b"RCP-0000001").hexdigest()[:8].upper()
    assert r.c == "x"
    assert r.d == dt.date(2026, 5, 21)          # 18:30 UTC is already the next day at UTC+7


def test_stream_late_sale_posted_and_redelivery_dropped(spark):
    import uuid
    from tillbook.plans.session import scratch_dir
    from tillbook.streaming.sales_stream import nested_sales, start_posting_stream
    base = scratch_dir(spark, f"stream-test-{uuid.uuid4().hex}")
    src, sink, ckpt = f"{base}/in", f"{base}/out", f"{base}/ckpt"
    it = items(spark, [(1, 1, 10, "Bread", 1, "1000", "100"), (2, 1, 10, "Cake", 1, "5000", "100")])
    recent = txns(spark, [(1, "2026-05-20", "10:00:00", "Cash")])
    old = txns(spark, [(2, "2020-01-01", "09:00:00", "QRIS")])
    nested_sales(recent, it).write.mode("append").parquet(src)
    start_posting_stream(spark, src, sink, ckpt).awaitTermination()
    # second upload: a sale rung up years ago, plus a re-delivery of receipt 1
    nested_sales(old.unionByName(recent), it).write.mode("append").parquet(src)
    start_posting_stream(spark, src, sink, ckpt).awaitTermination()
    out = spark.read.parquet(sink)
    refs = sorted(r.reference_no for r in out.filter("line_no = 1").collect())
    assert refs == ["RCP-0000001", "RCP-0000002"]
    assert out.count() == 10          # 5 lines per one-category sale, each posted once


def test_period_label(spark):
    from tillbook.functions.periods import period_label
    r = spark.range(1).select(period_label(3, 1997).alias("a"), period_label(None, 1998).alias("b"),
                              period_label(4, None).alias("c")).collect()[0]
    assert (r.a, r.b, r.c) == ("March 1997", "Year 1998", "All periods")


def test_material_insert_defaults(spark):
    base = spark.createDataFrame([(1, "flour", "Flour & Grain", "gram", D("10"), D("5"), D("2"), "x", True)],
                                 "id long, name string, category string, unit string, stock_qty decimal(12,2), "
                                 "reorder_point decimal(12,2), unit_cost decimal(12,2), supplier string, active boolean")
    new = spark.createDataFrame([(2, "sugar", "Sugar & Sweetener", "gram", True)],
                                "id long, name string, category string, unit string, active boolean")
    r = changes.insert_rows(base, new, seeds.MATERIAL_DEFAULTS).filter("id = 2").collect()[0]
    assert (r.supplier, r.stock_qty, r.reorder_point, r.unit_cost) == ("", D("0.00"), D("5.00"), D("0.00"))


def test_account_absent_from_chart(spark):
    coa = seeds.chart_of_accounts(spark)
    j = spark.createDataFrame(
        [(dt.date(2026, 5, 1), "RCP-1", 1, "x", "9999", D("5"), D("0")),
         (dt.date(2026, 5, 1), "RCP-1", 2, "y", "1010", D("0"), D("5"))],
        "entry_date date, reference_no string, line_no int, description string, account_code string, "
        "debit decimal(14,2), credit decimal(14,2)")
    refs = spark.createDataFrame([("RCP-1",)], "reference_no string")
    rows = {r.account_code: r.account_name for r in ledger.journal_for_receipts(j, coa, refs).collect()}
    assert rows == {"9999": None, "1010": "Cash on Hand"}              # the line is kept, unnamed
    assert [r.code for r in ledger.general_ledger(coa, j).collect()] == ["1010"]   # ledger lists chart accounts
