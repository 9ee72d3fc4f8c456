"""Registered queries: batch change-sets (J1-J9) with change-sets derived from
the data by business rules."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from tillbook.operators import changes as ch
from tillbook.operators import inventory as inv
from tillbook.plans.catalog import AS_OF, query
from tillbook.plans.oracle_sql import oracle
from tillbook.plans.q_inventory import LEDGER_CTE
from tillbook.sources import seeds

P_COLS = ["product_id", "name", "category", "price", "cost", "stock", "reorder_point", "sku", "supplier", "active"]
P_SQL = ("product_id, name, category, CAST(price AS DOUBLE) AS price, CAST(cost AS DOUBLE) AS cost, "
         "CAST(stock AS BIGINT) AS stock, CAST(reorder_point AS BIGINT) AS reorder_point, sku, supplier, active")
NEW_ID_OFFSET = 1_000_000_000


@query("products_insert", oracle(f"""
SELECT {P_SQL} FROM products
UNION ALL
SELECT product_id + {NEW_ID_OFFSET}, name || ' (bread)', 'Bread', CAST(price AS DOUBLE), 0.0, 0, 5,
  printf('NEW-%06d', product_id), '', TRUE
FROM products WHERE category = 'Promo'"""))
def q_products_insert(m, spark):
    """Add a Bread variant of every Promo product; omitted fields take
    the defaults (supplier '', stock 0, reorder point 5, cost 0)."""
    p = m["products"]
    new = p.filter(F.col("category") == "Promo").select(
        (F.col("product_id") + NEW_ID_OFFSET).alias("product_id"), F.concat("name", F.lit(" (bread)")).alias("name"),
        F.lit("Bread").alias("category"), "price", F.format_string("NEW-%06d", "product_id").alias("sku"),
        F.lit(True).alias("active"))
    return ch.insert_rows(p, new, seeds.PRODUCT_DEFAULTS)


@query("products_update", oracle(f"""
SELECT p.product_id, p.name, p.category,
  CAST(CASE WHEN c.product_id IS NOT NULL THEN c.price ELSE p.price END AS DOUBLE) AS price,
  CAST(p.cost AS DOUBLE) AS cost, CAST(p.stock AS BIGINT) AS stock,
  CAST(CASE WHEN c.product_id IS NOT NULL THEN c.reorder_point ELSE p.reorder_point END AS BIGINT) AS reorder_point,
  p.sku, p.supplier, p.active,
  CASE WHEN c.product_id IS NOT NULL THEN '{AS_OF}' END AS updated_at
FROM products p LEFT JOIN (
  SELECT product_id, CAST(ROUND(price * 1.05, 2) AS DECIMAL(12,2)) AS price, 20 AS reorder_point
  FROM products WHERE active AND stock <= reorder_point) c ON c.product_id = p.product_id"""))
def q_products_update(m, spark):
    """Reprice low-stock products by +5 % and raise their reorder point
    to 20; matched rows are stamped with the as-of date."""
    p = m["products"]
    changes = inv.low_stock(p).select("product_id", F.round(F.col("price") * F.lit(1.05).cast("decimal(3,2)"), 2)
                                      .alias("price"), F.lit(20).alias("reorder_point"))
    return ch.update_rows(p, changes, "product_id", AS_OF)


@query("products_soft_delete", oracle(f"""
SELECT product_id, name, category, CAST(price AS DOUBLE) AS price, CAST(cost AS DOUBLE) AS cost,
  CAST(stock AS BIGINT) AS stock, CAST(reorder_point AS BIGINT) AS reorder_point, sku, supplier,
  active AND product_id IN (SELECT product_id FROM transaction_items) AS active
FROM products"""))
def q_products_soft_delete(m, spark):
    """Discontinue products that were never sold (rows kept, inactive)."""
    p = m["products"]
    never = p.select("product_id").join(m["transaction_items"].select("product_id"), "product_id", "left_anti")
    return ch.soft_delete(p, never, "product_id")


ADJ_SQL = """
adj AS (
  SELECT product_id, 2 * reorder_point - stock AS qty_change, 1 AS seq, 'Restock' AS movement_type
  FROM products WHERE active AND stock <= reorder_point
  UNION ALL
  SELECT product_id, -50, 2, 'Damage' FROM products WHERE stock > 45
  UNION ALL
  SELECT product_id, 3, 3, 'Adjustment' FROM products WHERE category = 'Promo'),
adj_log AS (
  SELECT a.product_id, p.name AS product_name, a.movement_type, a.qty_change, a.seq,
    s - LEAST(0, MIN(s) OVER (PARTITION BY a.product_id ORDER BY a.seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS stock_after
  FROM (SELECT a.*, SUM(a.qty_change) OVER (PARTITION BY a.product_id ORDER BY a.seq
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cs FROM adj a) a
  JOIN products p ON p.product_id = a.product_id,
  LATERAL (SELECT p.stock + a.cs AS s))"""


def _adjustments(m):
    p = m["products"]
    restock = inv.low_stock(p).select("product_id", (2 * F.col("reorder_point") - F.col("stock")).alias("qty_change"),
                                      F.lit(1).alias("seq"), F.lit("Restock").alias("movement_type"))
    damage = p.filter(F.col("stock") > 45).select("product_id", F.lit(-50).alias("qty_change"), F.lit(2).alias("seq"),
                                                  F.lit("Damage").alias("movement_type"))
    other = p.filter(F.col("category") == "Promo").select(
        "product_id", F.lit(3).alias("qty_change"), F.lit(3).alias("seq"),
        F.lit(None).cast("string").alias("movement_type"))
    return restock.unionByName(damage).unionByName(other)


@query("stock_adjustment_log", oracle(f"""
SELECT CAST(DATE '{AS_OF}' AS VARCHAR) AS log_date, '00:00:00' AS log_time, product_id, product_name, movement_type,
  CAST(qty_change AS BIGINT) AS quantity_change, CAST(stock_after AS BIGINT) AS stock_after, '' AS reason,
  'System' AS performed_by, CAST(seq AS BIGINT) AS seq
FROM adj_log""", ADJ_SQL))
def q_stock_adjustment_log(m, spark):
    """Restock low items, write off damaged stock, and adjust Promo stock
    (type defaults to Adjustment), floored at zero, one log row each."""
    _, log = ch.apply_stock_adjustments(m["products"], _adjustments(m), AS_OF)
    return log


@query("stock_after_adjustments", oracle(f"""
SELECT p.product_id, p.name, CAST(COALESCE(l.stock_after, p.stock) AS BIGINT) AS stock,
  CASE WHEN l.product_id IS NOT NULL THEN '{AS_OF}' END AS updated_at
FROM products p LEFT JOIN (
  SELECT product_id, stock_after FROM (
    SELECT product_id, stock_after, row_number() OVER (PARTITION BY product_id ORDER BY seq DESC) AS rn FROM adj_log)
  WHERE rn = 1) l ON l.product_id = p.product_id""", ADJ_SQL))
def q_stock_after_adjustments(m, spark):
    """The product table after the adjustments."""
    new, _ = ch.apply_stock_adjustments(m["products"], _adjustments(m), AS_OF)
    return new.select("product_id", "name", "stock", "updated_at")


@query("recipes_upsert", oracle("""
SELECT COALESCE(b.product_id, c.product_id) AS product_id, COALESCE(b.raw_material_id, c.raw_material_id) AS raw_material_id,
  CAST(CASE WHEN c.product_id IS NOT NULL THEN c.qty ELSE b.qty_per_unit END AS DOUBLE) AS qty_per_unit
FROM product_ingredients b FULL OUTER JOIN (
  SELECT product_id, supp_id AS raw_material_id, CAST(quantity AS DECIMAL(10,3)) AS qty FROM (
    SELECT *, row_number() OVER (PARTITION BY product_id, supp_id ORDER BY ship_date DESC, txn_id DESC, line_seq DESC) AS rn
    FROM transaction_items WHERE return_flag = 'R') WHERE rn = 1) c
  ON c.product_id = b.product_id AND c.raw_material_id = b.raw_material_id"""))
def q_recipes_upsert(m, spark):
    """The quantity of the latest returned line of each (product,
    material) pair replaces the recipe quantity; new pairs are inserted."""
    changes = (m["transaction_items"].filter(F.col("return_flag") == "R")
               .select("product_id", F.col("supp_id").alias("raw_material_id"),
                       F.col("quantity").cast("decimal(10,3)").alias("qty_per_unit"), "ship_date", "txn_id", "line_key"))
    return ch.upsert_pairs(m["product_ingredients"], changes, ["product_id", "raw_material_id"], ["qty_per_unit"],
                           ["ship_date", "txn_id", "line_key"])


@query("recipes_delete", oracle("""
SELECT product_id, raw_material_id, CAST(qty_per_unit AS DOUBLE) AS qty_per_unit FROM product_ingredients
WHERE raw_material_id NOT IN (SELECT id FROM raw_materials WHERE category = 'Packaging')"""))
def q_recipes_delete(m, spark):
    """Remove every recipe row that uses a Packaging material."""
    r = m["product_ingredients"]
    pack = m["raw_materials"].filter(F.col("category") == "Packaging").select(F.col("id").alias("raw_material_id"))
    keys = r.join(pack, "raw_material_id", "left_semi")
    return ch.delete_pairs(r, keys, ["product_id", "raw_material_id"])


@query("transactions_verified", oracle(f"""
SELECT txn_id, CAST(transaction_date AS VARCHAR) AS transaction_date,
  verified OR transaction_date = DATE '{AS_OF}' AS verified FROM transactions"""))
def q_transactions_verified(m, spark):
    """Mark the as-of day's sales verified."""
    return ch.mark_verified(m["transactions"], AS_OF).select("txn_id", "transaction_date", "verified")


@query("cascade_delete", oracle("""
SELECT txn_id, product_id, CAST(quantity AS BIGINT) AS quantity, CAST(line_total AS DOUBLE) AS line_total
FROM transaction_items WHERE txn_id NOT IN (SELECT txn_id FROM transactions WHERE payment_method = 'Voucher')"""))
def q_cascade_delete(m, spark):
    """Deleting the sales paid with an unknown method removes their lines."""
    parents = m["transactions"].filter(F.col("payment_method") == "Voucher").select("txn_id")
    kids = ch.cascade_delete(parents, "txn_id", {"items": m["transaction_items"]})
    return kids["items"].select("txn_id", "product_id", "quantity", "line_total")


@query("reset_stock_by_sku", oracle("""
SELECT p.product_id, p.sku, CAST(COALESCE(c.closing, p.stock) AS BIGINT) AS stock
FROM products p LEFT JOIN (
  SELECT product_id, stock_after AS closing FROM (
    SELECT product_id, stock_after, row_number() OVER (PARTITION BY product_id
      ORDER BY log_date DESC, log_time DESC, txn_id DESC, line_seq DESC, kind DESC) AS rn FROM led) WHERE rn = 1) c
  ON c.product_id = p.product_id""", LEDGER_CTE))
def q_reset_stock_by_sku(m, spark):
    """Reset catalogue stock from a baseline by SKU (the baseline being
    the closing stock of the movement ledger)."""
    p = m["products"]
    closing = inv.closing_stock(m["stock_movements"], p)
    baseline = closing.join(p.select("product_id", "sku"), "product_id").select(
        "sku", F.col("closing_stock").alias("stock"))
    return ch.reset_stock_by_sku(p, baseline).select("product_id", "sku", "stock")


@query("material_adjustments", oracle(f"""
SELECT rm.id, rm.name, CAST(COALESCE(a.qty_after, rm.stock_qty) AS DOUBLE) AS stock_qty,
  CASE WHEN a.id IS NOT NULL THEN '{AS_OF}' END AS updated_at
FROM raw_materials rm LEFT JOIN (
  SELECT id, qty_after FROM (
    SELECT id, seq, s - LEAST(0, MIN(s) OVER (PARTITION BY id ORDER BY seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS qty_after,
      row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn
    FROM (SELECT c.id, c.seq, r.stock_qty + SUM(c.qty_change) OVER (PARTITION BY c.id ORDER BY c.seq
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s
          FROM (SELECT id, 2 * reorder_point - stock_qty AS qty_change, 1 AS seq FROM raw_materials
                WHERE stock_qty <= reorder_point
                UNION ALL
                SELECT id, -CAST(1000 AS DECIMAL(12,2)), 2 FROM raw_materials WHERE category = 'Packaging') c
          JOIN raw_materials r ON r.id = c.id))
  WHERE rn = 1) a ON a.id = rm.id"""))
def q_material_adjustments(m, spark):
    """J4 for materials: restock materials at or below their reorder point to
    twice that point, then write off 1,000 of every packaging material
    (floored at zero)."""
    rm = m["raw_materials"]
    restock = inv.low_stock_materials(rm).select(
        F.col("id").alias("raw_material_id"),
        (2 * F.col("reorder_point") - F.col("stock_qty")).alias("qty_change"), F.lit(1).alias("seq"))
    writeoff = rm.filter(F.col("category") == "Packaging").select(
        F.col("id").alias("raw_material_id"), F.lit(-1000).cast("decimal(12,2)").alias("qty_change"),
        F.lit(2).alias("seq"))
    new = ch.apply_material_adjustments(rm, restock.unionByName(writeoff), AS_OF)
    return new.select("id", "name", "stock_qty", "updated_at")


@query("materials_update", oracle(f"""
SELECT rm.id, rm.name, rm.category, CAST(rm.stock_qty AS DOUBLE) AS stock_qty,
  CAST(CASE WHEN rm.stock_qty < 2 * rm.reorder_point THEN 1000 ELSE rm.reorder_point END AS DOUBLE) AS reorder_point,
  CAST(rm.unit_cost AS DOUBLE) AS unit_cost,
  CASE WHEN rm.stock_qty < 2 * rm.reorder_point THEN '{AS_OF}' END AS updated_at
FROM raw_materials rm"""))
def q_materials_update(m, spark):
    """J2 for materials: materials holding less than twice their reorder point
    get a reorder point of 1,000; changed rows are stamped with the as-of date."""
    rm = m["raw_materials"]
    thin = rm.filter(F.col("stock_qty") < 2 * F.col("reorder_point")).select(
        "id", F.lit(1000).cast("decimal(12,2)").alias("reorder_point"))
    return ch.update_rows(rm, thin, "id", AS_OF).select("id", "name", "category", "stock_qty", "reorder_point",
                                                       "unit_cost", "updated_at")


@query("cascade_delete_recipes", oracle("""
SELECT product_id, raw_material_id, CAST(qty_per_unit AS DOUBLE) AS qty_per_unit FROM product_ingredients
WHERE product_id NOT IN (SELECT product_id FROM products WHERE NOT active)
  AND raw_material_id NOT IN (SELECT id FROM raw_materials WHERE category = 'Packaging')"""))
def q_cascade_delete_recipes(m, spark):
    """Deleting discontinued products and packaging materials removes
    their recipe rows."""
    gone = m["products"].filter(~F.col("active")).select("product_id")
    rest = ch.cascade_delete(gone, "product_id", {"recipes": m["product_ingredients"]})
    pack = m["raw_materials"].filter(F.col("category") == "Packaging").select(F.col("id").alias("raw_material_id"))
    return ch.cascade_delete(pack, "raw_material_id", rest)["recipes"]


RECORDED_SQL = f"""
day_items AS (SELECT * FROM transaction_items WHERE txn_id IN (SELECT txn_id FROM transactions WHERE transaction_date = DATE '{AS_OF}')),
day_moves AS (
  SELECT i.product_id, i.product_name, t.transaction_date AS log_date, t.transaction_time AS log_time, i.txn_id, i.line_seq,
    -i.quantity AS quantity_change, 'Sale: ' || t.receipt_no AS reason, t.cashier_name AS performed_by
  FROM day_items i JOIN transactions t ON t.txn_id = i.txn_id),
day_run AS (
  SELECT m.*, p.stock + SUM(quantity_change) OVER w AS s FROM day_moves m JOIN products p ON p.product_id = m.product_id
  WINDOW w AS (PARTITION BY m.product_id ORDER BY log_time, txn_id, line_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
day_log AS (
  SELECT *, s - LEAST(0, MIN(s) OVER (PARTITION BY product_id ORDER BY log_time, txn_id, line_seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS stock_after FROM day_run)"""


@contextmanager
def _day_sales(m):
    """Headers and lines of the as-of day, each written once.  The size of the written headers is known, so all lines
    meet a small day without an exchange; a day of any size exchanges them once."""
    from tillbook.plans.session import staged
    from tillbook.sources.adapter import period_headers, sale_lines
    with (staged(period_headers(m, day=AS_OF), "day-headers") as headers,
          staged(sale_lines(m, headers).drop("line_key"), "day-lines") as lines):
        yield headers, lines


def _recorded(m, spark):
    """The as-of day's sales recorded as a batch and read back."""
    import uuid
    from tillbook.plans.session import scratch_dir
    from tillbook.sources import versions
    out = scratch_dir(spark, f"recorded-{uuid.uuid4().hex}")
    with _day_sales(m) as (hdr, lines):
        ch.record_sales(hdr, lines, m["products"], out, "day", AS_OF)
    return versions.read_published(spark, out)


@query("record_sales_log", oracle("""
SELECT product_id, product_name, CAST(log_date AS VARCHAR) AS log_date, log_time, txn_id, CAST(line_seq AS BIGINT) AS line_seq,
  'Sale' AS movement_type, CAST(quantity_change AS BIGINT) AS quantity_change, reason, performed_by,
  CAST(stock_after AS BIGINT) AS stock_after FROM day_log""", RECORDED_SQL))
def q_record_sales_log(m, spark):
    """The stock log of a recorded batch, read through its manifest."""
    return _recorded(m, spark)["inventory_logs"].select(
        "product_id", "product_name", "log_date", "log_time", "txn_id", "line_seq", "movement_type", "quantity_change",
        "reason", "performed_by", "stock_after")


@query("record_sales_tables", oracle(f"""
SELECT 'transactions' AS table_name, COUNT(*) AS n, CAST(SUM(total) AS DOUBLE) AS amount, COUNT(*) FILTER (WHERE NOT verified) AS marked
FROM (SELECT total, FALSE AS verified FROM transactions WHERE transaction_date = DATE '{AS_OF}')
UNION ALL SELECT 'transaction_items', COUNT(*), CAST(SUM(line_total) AS DOUBLE), 0 FROM day_items
UNION ALL SELECT 'journal_entries', COUNT(*), CAST(SUM(debit) AS DOUBLE), 0 FROM sales_journal WHERE entry_date = DATE '{AS_OF}'
UNION ALL SELECT 'products', COUNT(*), CAST(SUM(COALESCE(l.stock_after, p.stock)) AS DOUBLE), COUNT(l.product_id) FROM products p LEFT JOIN (
  SELECT product_id, stock_after FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY log_time DESC, txn_id DESC,
    line_seq DESC) AS rn FROM day_log) WHERE rn = 1) l ON l.product_id = p.product_id""", RECORDED_SQL))
def q_record_sales_tables(m, spark):
    """Rows, amounts and marks (unverified sales, restamped products) of
    every table of a recorded batch, read through its manifest."""
    t = _recorded(m, spark)
    none = F.lit(0).cast("bigint")

    def row(name, amount, marked=none):
        return t[name].agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"),
                           F.sum(amount).cast("double").alias("amount"), marked.alias("marked"))
    return (row("transactions", "total", F.count(F.when(~F.col("verified"), 1)))
            .unionByName(row("transaction_items", "line_total")).unionByName(row("journal_entries", "debit"))
            .unionByName(row("products", "stock", F.count("updated_at"))))


@query("record_sales_replayed", oracle(f"""
SELECT 'transactions' AS table_name, COUNT(*) AS n, CAST(SUM(total) AS DOUBLE) AS amount
FROM transactions WHERE transaction_date = DATE '{AS_OF}' AND transaction_time >= '12:00:00'
UNION ALL SELECT 'rejected_sales', COUNT(*), 0.0 FROM transactions WHERE transaction_date = DATE '{AS_OF}' AND transaction_time < '12:00:00'
UNION ALL SELECT 'receipts', COUNT(*), 0.0 FROM transactions WHERE transaction_date = DATE '{AS_OF}'
UNION ALL SELECT 'products', COUNT(*), CAST(SUM(COALESCE(l.stock_after, p.stock)) AS DOUBLE) FROM products p LEFT JOIN (
  SELECT product_id, stock_after FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY log_time DESC, txn_id DESC,
    line_seq DESC) AS rn FROM day_log) WHERE rn = 1) l ON l.product_id = p.product_id""", RECORDED_SQL))
def q_record_sales_replayed(m, spark):
    """J10 with K2's rule: the morning's sales are recorded, then the whole day is
    delivered; the morning's receipts are rejected and move no stock twice."""
    import uuid
    from tillbook.plans.session import scratch_dir
    from tillbook.sources import versions
    out = scratch_dir(spark, f"replayed-{uuid.uuid4().hex}")
    with _day_sales(m) as (day, lines):     # a batch takes the lines of its own sales
        ch.record_sales(day.filter("transaction_time < '12:00:00'"), lines, m["products"], out, "morning", AS_OF)
        products = versions.read_published(spark, out)["products"].drop("updated_at")
        ch.record_sales(day, lines, products, out, "day", AS_OF)
    t = versions.read_published(spark, out)

    def row(name, amount):
        return t[name].agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"), amount.cast("double").alias("amount"))
    return (row("transactions", F.sum("total")).unionByName(row("rejected_sales", F.lit(0.0)))
            .unionByName(row("receipts", F.lit(0.0))).unionByName(row("products", F.sum("stock"))))
