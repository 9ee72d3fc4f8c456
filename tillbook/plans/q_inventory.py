"""Registered queries: stock ledgers, catalogue, recipes and product sales."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tillbook.operators import inventory as inv, name_lists
from tillbook.plans.catalog import AS_OF, MONTH, YEAR, query
from tillbook.plans.oracle_sql import oracle
from tillbook.plans.q_ledger import month_pred
from tillbook.plans.session import scratch_dir
from tillbook.sources import name_index

E1_ORDER = "m.log_date, m.log_time, m.txn_id, m.line_seq, m.kind"
EDITED_PRODUCT = 7         # the product whose recipe is edited

LEDGER_CTE = f"""
led AS (
  SELECT product_id, product_name, log_date, log_time, txn_id, line_seq, kind, movement_type, quantity_change,
    reason, s - LEAST(0, MIN(s) OVER (PARTITION BY product_id ORDER BY log_date, log_time, txn_id, line_seq, kind
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS stock_after
  FROM (SELECT m.*, COALESCE(p.stock, 0) + SUM(m.quantity_change) OVER (PARTITION BY m.product_id ORDER BY {E1_ORDER}
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s
        FROM stock_movements m LEFT JOIN products p ON p.product_id = m.product_id))"""

E1_COLS = ["product_id", "product_name", "log_date", "log_time", "txn_id", "kind", "movement_type",
           "quantity_change", "reason", "stock_after"]


@query("stock_ledger", oracle("""
SELECT product_id, product_name, CAST(log_date AS VARCHAR) AS log_date, log_time, txn_id, CAST(kind AS BIGINT) AS kind,
  movement_type, CAST(quantity_change AS BIGINT) AS quantity_change, reason, CAST(stock_after AS BIGINT) AS stock_after
FROM led""", LEDGER_CTE))
def q_stock_ledger(m, spark):
    """Floored running stock after every sale and return."""
    return inv.stock_ledger(m["stock_movements"], m["products"]).select(*E1_COLS)


@query("closing_stock", oracle("""
SELECT p.product_id, p.name, CAST(p.stock AS BIGINT) AS opening_stock,
  CAST(COALESCE(l.stock_after, p.stock) AS BIGINT) AS closing_stock
FROM products p LEFT JOIN (
  SELECT product_id, stock_after FROM (
    SELECT product_id, stock_after, row_number() OVER (PARTITION BY product_id
      ORDER BY log_date DESC, log_time DESC, txn_id DESC, line_seq DESC, kind DESC) AS rn FROM led) WHERE rn = 1) l
  ON l.product_id = p.product_id""", LEDGER_CTE))
def q_closing_stock(m, spark):
    """Stock after all movements for every product."""
    return inv.closing_stock(m["stock_movements"], m["products"])


@query("material_stock_ledger", oracle("""
SELECT raw_material_id, CAST(log_date AS VARCHAR) AS log_date, txn_id, CAST(qty_change AS DOUBLE) AS qty_change,
  CAST(s - LEAST(0, MIN(s) OVER (PARTITION BY raw_material_id ORDER BY log_date, txn_id, line_seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS DOUBLE) AS qty_after
FROM (SELECT mm.*, COALESCE(r.stock_qty, 0) + SUM(mm.qty_change) OVER (PARTITION BY mm.raw_material_id
        ORDER BY mm.log_date, mm.txn_id, mm.line_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s
      FROM material_movements mm LEFT JOIN raw_materials r ON r.id = mm.raw_material_id)"""))
def q_material_stock_ledger(m, spark):
    """Floored running quantity of every material as sales consume it."""
    return inv.material_stock_ledger(m["material_movements"], m["raw_materials"]).select(
        "raw_material_id", "log_date", "txn_id", "qty_change", "qty_after")


@query("last_movement", oracle("""
SELECT product_id, CAST(log_date AS VARCHAR) AS log_date, log_time, txn_id, CAST(kind AS BIGINT) AS kind,
  movement_type, CAST(quantity_change AS BIGINT) AS quantity_change
FROM (SELECT *, row_number() OVER (PARTITION BY product_id
        ORDER BY log_date DESC, log_time DESC, txn_id DESC, line_seq DESC, kind DESC) AS rn FROM stock_movements)
WHERE rn = 1"""))
def q_last_movement(m, spark):
    """The latest movement per product (latest-wins reduction)."""
    mv = m["stock_movements"].select("product_id", "log_date", "log_time", "txn_id", "line_key", "kind",
                                     "movement_type", "quantity_change")
    last = inv.latest_wins(mv, "product_id", ["log_date", "log_time", "txn_id", "line_key", "kind"])
    return last.drop("line_key")


PRODUCT_SQL = ("product_id, name, category, CAST(price AS DOUBLE) AS price, CAST(cost AS DOUBLE) AS cost, "
               "CAST(stock AS BIGINT) AS stock, CAST(reorder_point AS BIGINT) AS reorder_point, sku, supplier, active")
MATERIAL_SQL = ("id, name, category, unit, CAST(stock_qty AS DOUBLE) AS stock_qty, "
                "CAST(reorder_point AS DOUBLE) AS reorder_point, CAST(unit_cost AS DOUBLE) AS unit_cost, supplier, active")


@query("product_catalogue", oracle(f"SELECT {PRODUCT_SQL} FROM products WHERE active"))
def q_catalogue(m, spark):
    """A2."""
    return inv.product_catalogue(m["products"])


@query("material_list", oracle(f"SELECT {MATERIAL_SQL} FROM raw_materials"))
def q_material_list(m, spark):
    """A3."""
    return inv.material_list(m["raw_materials"])


SEARCH_CATEGORY, SEARCH_TEXT = "Bread", "RING"


SEARCH_SQL = f"""
SELECT {PRODUCT_SQL} FROM products
WHERE active AND category = '{SEARCH_CATEGORY}' AND contains(lower(name), lower('{SEARCH_TEXT}'))"""


@query("search_products", oracle(SEARCH_SQL))
def q_search(m, spark):
    """One category, case-insensitive name search."""
    return inv.search_products(m["products"], SEARCH_CATEGORY, SEARCH_TEXT)


@query("search_products_indexed", oracle(SEARCH_SQL))
def q_search_indexed(m, spark):
    """B4 through the stored grams of all product names."""
    out = scratch_dir(spark, f"names-{uuid.uuid4().hex}")
    name_index.write_name_index(spark, m["products"], out)
    return name_index.search(spark, out, m["products"], SEARCH_CATEGORY, SEARCH_TEXT)


@query("low_stock", oracle(f"SELECT {PRODUCT_SQL} FROM products WHERE active AND stock <= reorder_point"))
def q_low_stock(m, spark):
    """B5."""
    return inv.low_stock(m["products"])


@query("low_stock_materials", oracle(f"SELECT {MATERIAL_SQL} FROM raw_materials WHERE stock_qty <= reorder_point"))
def q_low_stock_materials(m, spark):
    """B6."""
    return inv.low_stock_materials(m["raw_materials"])


MARGIN_SQL = "ROUND((price - cost) * 100 / NULLIF(price, 0), 1)"


@query("price_list", oracle(f"""
SELECT category, sku, product_id, name, CAST(price AS DOUBLE) AS price, CAST(cost AS DOUBLE) AS cost,
  CAST({MARGIN_SQL} AS DOUBLE) AS margin_pct, CAST(price - cost AS DOUBLE) AS margin_amount,
  CASE WHEN {MARGIN_SQL} > 50 THEN 'high' WHEN {MARGIN_SQL} > 35 THEN 'mid' ELSE 'low' END AS band,
  CAST(stock AS BIGINT) AS stock,
  CASE WHEN stock = 0 THEN 'Out' WHEN stock <= reorder_point THEN 'Low' ELSE 'Available' END AS status
FROM products WHERE active AND category IN ('Bread', 'Pastry', 'Cake', 'Beverage')"""))
def q_price_list(m, spark):
    """I20 with B7/B8."""
    return inv.price_list(m["products"])


@query("price_list_kpis", oracle(f"""
SELECT COUNT(*) AS products, CAST(ROUND(AVG(price), 2) AS DOUBLE) AS avg_price,
  CAST(ROUND(AVG(cost), 2) AS DOUBLE) AS avg_cost, CAST(ROUND(AVG((price - cost) * 100 / NULLIF(price, 0)), 1)
  AS DOUBLE) AS avg_margin_pct
FROM products WHERE active"""))
def q_price_list_kpis(m, spark):
    """D22."""
    return inv.price_list_kpis(m["products"])


@query("price_list_counts", oracle("SELECT category, COUNT(*) AS products FROM products WHERE active GROUP BY category"))
def q_price_list_counts(m, spark):
    """D23."""
    return inv.price_list_counts(m["products"])


@query("inventory_report", oracle("""
SELECT product_id, sku, name, category, CAST(stock AS BIGINT) AS stock, CAST(reorder_point AS BIGINT) AS reorder_point,
  CASE WHEN stock = 0 THEN 'Out' WHEN stock <= reorder_point THEN 'Low' ELSE 'Available' END AS status,
  CAST(stock * cost AS DOUBLE) AS stock_value
FROM products WHERE active"""))
def q_inventory_report(m, spark):
    """I21."""
    return inv.inventory_report(m["products"])


@query("low_stock_alert", oracle("""
SELECT 'products' AS kind, COUNT(*) AS low_stock_count FROM products WHERE active AND stock <= reorder_point
UNION ALL
SELECT 'materials', COUNT(*) FROM raw_materials WHERE stock_qty <= reorder_point"""))
def q_low_stock_alert(m, spark):
    """D25."""
    return inv.low_stock_alert(m["products"], m["raw_materials"])


@query("material_stock_value", oracle("""
SELECT CAST(COALESCE(SUM(stock_qty * unit_cost), 0) AS DOUBLE) AS stock_value FROM raw_materials"""))
def q_material_stock_value(m, spark):
    """D21."""
    return inv.material_stock_value(m["raw_materials"])


@query("movements_on_day", oracle(f"""
SELECT movement_type, COUNT(*) AS movements FROM stock_movements WHERE log_date = DATE '{AS_OF}'
GROUP BY movement_type"""))
def q_movements_on_day(m, spark):
    """D27."""
    from tillbook.sources.adapter import stock_movements_on
    return inv.movements_on_day(stock_movements_on(m, AS_OF), AS_OF)


@query("recipe_lines", oracle("""
SELECT pi.product_id, pi.raw_material_id, rm.name AS material_name, rm.category AS material_category, rm.unit,
  CAST(rm.unit_cost AS DOUBLE) AS unit_cost, CAST(rm.stock_qty AS DOUBLE) AS stock_qty,
  CAST(pi.qty_per_unit AS DOUBLE) AS qty_per_unit,
  CAST(ROUND(pi.qty_per_unit * rm.unit_cost, 0) AS DOUBLE) AS cost_contribution
FROM product_ingredients pi JOIN raw_materials rm ON rm.id = pi.raw_material_id"""))
def q_recipe_lines(m, spark):
    """I17 detail for every product."""
    return inv.recipe_lines(m["product_ingredients"], m["raw_materials"])


@query("recipe_cost", oracle("""
SELECT r.product_id, r.materials, CAST(r.recipe_cost AS DOUBLE) AS recipe_cost, p.name,
  CAST(p.cost AS DOUBLE) AS standard_cost, CAST(r.recipe_cost - p.cost AS DOUBLE) AS cost_gap
FROM (SELECT pi.product_id, COUNT(*) AS materials, SUM(ROUND(pi.qty_per_unit * rm.unit_cost, 0)) AS recipe_cost
      FROM product_ingredients pi JOIN raw_materials rm ON rm.id = pi.raw_material_id GROUP BY pi.product_id) r
LEFT JOIN products p ON p.product_id = r.product_id"""))
def q_recipe_cost(m, spark):
    """Recipe cost as the sum of rounded contributions."""
    return inv.recipe_cost(m["product_ingredients"], m["raw_materials"], m["products"])


@query("ingredients_overview", oracle(f"""
SELECT {MATERIAL_SQL}, COALESCE(u.n, 0) AS used_in_products, COALESCE(nm.n, 0) AS n_product_names,
  COALESCE(CASE WHEN nm.n > 3 THEN nm.first3 || ' +' || CAST(nm.n - 3 AS VARCHAR) || ' lagi' ELSE nm.first3 END, '')
    AS used_in_label
FROM raw_materials rm
LEFT JOIN (SELECT raw_material_id, COUNT(DISTINCT product_id) AS n FROM product_ingredients GROUP BY 1) u
  ON u.raw_material_id = rm.id
LEFT JOIN (SELECT raw_material_id, COUNT(*) AS n,
             string_agg(CASE WHEN rk <= 3 THEN product_name END, ', ' ORDER BY product_name) AS first3
           FROM (SELECT *, row_number() OVER (PARTITION BY raw_material_id ORDER BY product_name) AS rk
                 FROM (SELECT DISTINCT pi.raw_material_id, p.name AS product_name
                       FROM product_ingredients pi JOIN products p ON p.product_id = pi.product_id AND p.active))
           GROUP BY raw_material_id) nm
  ON nm.raw_material_id = rm.id""".replace("SELECT id, name, category, unit, CAST(stock_qty",
                                           "SELECT rm.id, rm.name, rm.category, rm.unit, CAST(rm.stock_qty")
                                  .replace("CAST(reorder_point AS DOUBLE) AS reorder_point, CAST(unit_cost AS DOUBLE) "
                                           "AS unit_cost, supplier, active",
                                           "CAST(rm.reorder_point AS DOUBLE) AS reorder_point, "
                                           "CAST(rm.unit_cost AS DOUBLE) AS unit_cost, rm.supplier, rm.active")))
def q_ingredients_overview(m, spark):
    """I18 (D15, D16 count, F7 label)."""
    return inv.ingredients_overview(m["raw_materials"], m["product_ingredients"], m["products"])


@query("ingredient_product_names", oracle("""
SELECT DISTINCT pi.raw_material_id, p.name AS product_name
FROM product_ingredients pi JOIN products p ON p.product_id = pi.product_id AND p.active"""))
def q_ingredient_names(m, spark):
    """D16 long form: distinct active product names per material."""
    return inv.ingredient_product_names(m["product_ingredients"], m["products"])


NAMES_SQL = """
SELECT {key}, CAST((rn - 1) // {size} + 1 AS BIGINT) AS part_no, COUNT(*) AS n_names, string_agg(name, ', ' ORDER BY rn) AS names
FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY name, id) AS rn FROM {source}) GROUP BY 1, 2"""


def _joined(lists):
    return lists.withColumn("names", F.array_join("names", ", "))


@query("ingredient_name_lists", oracle(NAMES_SQL.format(key="raw_material_id", size=name_lists.PART_SIZE, source="""(
  SELECT DISTINCT pi.raw_material_id, p.name, 0 AS id
  FROM product_ingredients pi JOIN products p ON p.product_id = pi.product_id AND p.active)""")))
def q_ingredient_lists(m, spark):
    """Every material's product names, in parts."""
    return _joined(name_lists.ingredient_name_lists(m["product_ingredients"], m["products"]))


@query("low_stock_names", oracle(NAMES_SQL.format(key="kind", size=name_lists.PART_SIZE, source="""(
  SELECT 'products' AS kind, name, product_id AS id FROM products WHERE active AND stock <= reorder_point
  UNION ALL SELECT 'materials', name, id FROM raw_materials WHERE stock_qty <= reorder_point)""")))
def q_low_stock_names(m, spark):
    """All names of the low-stock alert, in parts."""
    return _joined(name_lists.low_stock_names(m["products"], m["raw_materials"]))


@query("recipe_links", oracle("""
SELECT CAST(COALESCE(SUM(n), 0) AS BIGINT) AS recipe_links
FROM (SELECT raw_material_id, COUNT(DISTINCT product_id) AS n FROM product_ingredients GROUP BY 1)"""))
def q_recipe_links(m, spark):
    """D26."""
    return inv.recipe_links(m["product_ingredients"])


SALES_CTE = f"""
psales AS (
  SELECT i.product_id,
    SUM(CASE WHEN t.transaction_date = DATE '{AS_OF}' THEN i.quantity ELSE 0 END) AS sold_today,
    SUM(i.quantity) AS sold_period, SUM(i.quantity * i.unit_price) AS revenue
  FROM transaction_items i JOIN transactions t ON t.txn_id = i.txn_id
  WHERE {month_pred('t.transaction_date', MONTH, YEAR)}
  GROUP BY i.product_id)"""


@query("product_revenue", oracle("""
SELECT p.product_id, p.name, p.category, CAST(COALESCE(s.revenue, 0) AS DOUBLE) AS revenue
FROM products p LEFT JOIN psales s ON s.product_id = p.product_id WHERE p.active""", SALES_CTE))
def q_product_revenue(m, spark):
    """Revenue per active product in the period, zero sales included."""
    return inv.product_revenue(m, AS_OF, MONTH, YEAR)


@query("top_products", oracle("""
SELECT p.product_id, p.name, p.category, CAST(COALESCE(s.revenue, 0) AS DOUBLE) AS revenue
FROM products p LEFT JOIN psales s ON s.product_id = p.product_id WHERE p.active
ORDER BY COALESCE(s.revenue, 0) DESC, p.category, p.name, p.product_id LIMIT 5""", SALES_CTE))
def q_top_products(m, spark):
    """top five products by revenue in the period."""
    return inv.top_products(m, AS_OF, MONTH, YEAR)


@query("production_log", oracle("""
SELECT p.product_id, p.name, p.category, CAST(s.sold_today AS BIGINT) AS sold_today,
  CAST(s.sold_period AS BIGINT) AS sold_period, CAST(s.sold_period * p.price AS DOUBLE) AS revenue_at_current_price
FROM products p JOIN psales s ON s.product_id = p.product_id WHERE p.active AND s.sold_period > 0""", SALES_CTE))
def q_production_log(m, spark):
    """I19/D19/F8."""
    return inv.production_log(m, AS_OF, MONTH, YEAR)


@query("production_kpis", oracle("""
SELECT (SELECT COUNT(*) FROM products WHERE active) AS active_products,
  CAST(COALESCE(SUM(s.sold_today), 0) AS BIGINT) AS units_today,
  CAST(COALESCE(SUM(s.sold_period), 0) AS BIGINT) AS units_period
FROM psales s WHERE s.product_id IN (SELECT product_id FROM products WHERE active)""", SALES_CTE))
def q_production_kpis(m, spark):
    """D33."""
    return inv.production_kpis(m, AS_OF, MONTH, YEAR)


@query("recipes_by_material_name", oracle("""
SELECT r.product_id, r.material_name, n.raw_material_id, CAST(r.qty_per_unit AS DOUBLE) AS qty_per_unit,
  n.raw_material_id IS NOT NULL AS resolved
FROM (SELECT pi.product_id, rm.name AS material_name, pi.qty_per_unit
      FROM product_ingredients pi JOIN raw_materials rm ON rm.id = pi.raw_material_id) r
LEFT JOIN (SELECT name, CASE WHEN COUNT(*) = 1 THEN MIN(id) END AS raw_material_id FROM raw_materials GROUP BY name) n
  ON n.name = r.material_name"""))
def q_recipes_by_material_name(m, spark):
    """Recipes written with material names (as the seed lists them)
    resolved back to material ids by a join on the name."""
    from tillbook.sources.adapter import resolve_material_ids
    rm = m["raw_materials"]
    by_name = m["product_ingredients"].join(rm.select(F.col("id").alias("raw_material_id"),
                                                      F.col("name").alias("material_name")), "raw_material_id")
    return resolve_material_ids(by_name.select("product_id", "material_name", "qty_per_unit"), rm)


@query("addable_materials", oracle(f"""
SELECT id, name, category, unit, CAST(stock_qty AS DOUBLE) AS stock_qty, CAST(unit_cost AS DOUBLE) AS unit_cost FROM raw_materials
WHERE id NOT IN (SELECT raw_material_id FROM product_ingredients WHERE product_id = {EDITED_PRODUCT})"""))
def q_addable_materials(m, spark):
    """The materials not yet in the recipe of one product being edited."""
    return inv.addable_materials(EDITED_PRODUCT, m["raw_materials"], m["product_ingredients"]).select(
        "id", "name", "category", "unit", "stock_qty", "unit_cost")
