"""Stock, recipes and catalogue views.

Floored running stock is an exact blocked scan of several levels (``levels``); this module gives its blocks: prefixes
of the order of movements, each short enough for one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbook.functions.periods import in_period, on_date
from tillbook.operators.levels import floored_closing, floored_ledger, month_openings, month_summaries
from tillbook.sources import seeds
from tillbook.sources.adapter import period_headers

MONEY = "decimal(24,2)"  # width of sum(decimal(14,2)); totals of 100 TB fit


def _order_cols(df: DataFrame, cols: list[str]) -> list[str]:
    """Use the raw line key when present (no per-sale window needed)."""
    return [("line_key" if c == "line_seq" and "line_key" in df.columns else c) for c in cols]


SALES_IN_BLOCK = 1 << 16   # sale ids in one block of movements that share a time


def _product_blocks(movements: DataFrame) -> DataFrame:
    """Block = (day, minute, range of sale ids within the day's last second): a prefix of the (date, time, sale, ...)
    order, so blocks stay contiguous in it.  Returns all carry the day's last second; the range of their sale ids
    spreads them over as many blocks as there are sale ids.  Movements without a date (their sale is unknown) come
    first."""
    late = F.col("log_time") >= "23:59:59"
    return movements.withColumn("_blk", F.struct(
        F.coalesce("log_date", F.lit("0001-01-01").cast("date")).alias("d"),
        F.when(late, "23:59:59").otherwise(F.coalesce(F.substring("log_time", 1, 5), F.lit(""))).alias("h"),
        F.when(late, F.floor(F.col("txn_id") / SALES_IN_BLOCK)).otherwise(F.lit(0)).alias("s")))


def _material_blocks(movements: DataFrame) -> DataFrame:
    """Block = (day, range of sale ids), a prefix of the (day, sale, ...) order."""
    return movements.withColumn("_blk", F.struct(
        F.coalesce("log_date", F.lit("0001-01-01").cast("date")).alias("d"),
        F.floor(F.col("txn_id") / SALES_IN_BLOCK).alias("s")))


def _openings(products: DataFrame) -> DataFrame:
    return products.select("product_id", F.col("stock").cast("bigint").alias("opening"))


def stock_ledger(movements: DataFrame, products: DataFrame, openings: DataFrame | None = None) -> DataFrame:
    """Every movement with the floored stock after it; the unclamped
    change is kept.  Opening stock = the product's ``stock`` column, or
    ``openings(product_id, opening)``."""
    order = _order_cols(movements, ["log_time", "txn_id", "line_seq", "kind"])
    led = floored_ledger(_product_blocks(movements), "product_id", "_blk", order, "quantity_change",
                         _openings(products) if openings is None else openings, "opening")
    if "product_name" not in led.columns:
        led = led.join(products.select("product_id", F.col("name").alias("product_name")), "product_id", "left")
    return led.drop("_blk").withColumn("stock_after", F.col("stock_after").cast("bigint"))


def stock_months(movements: DataFrame) -> DataFrame:
    """(product_id, log_month, total, low) of stored movements: what each month does to a product's stock, whatever it
    opens with (``levels``)."""
    order = _order_cols(movements, ["log_time", "txn_id", "line_seq", "kind"])
    return month_summaries(_product_blocks(movements), "product_id", "log_month", "_blk", order, "quantity_change")


def month_stock_ledger(movements: DataFrame, months: DataFrame, products: DataFrame, month: int, year: int) -> DataFrame:
    """E1 for one month of stored movements: the stock at its start comes from the summaries of the months before, so
    only the month's own movements are read."""
    wanted = f"{year:04d}-{month:02d}"
    opening = month_openings(months, "product_id", "log_month", _openings(products), "opening", wanted)
    return stock_ledger(movements.filter(F.col("log_month") == wanted), products, opening)


def material_stock_ledger(movements: DataFrame, materials: DataFrame) -> DataFrame:
    """The same floor for raw materials (decimal quantities)."""
    order = _order_cols(movements, ["txn_id", "line_seq"])
    led = floored_ledger(_material_blocks(movements), "raw_material_id", "_blk", order, "qty_change",
                         materials.select(F.col("id").alias("raw_material_id"),
                                          F.col("stock_qty").alias("opening")), "opening", "qty_after")
    return led.drop("_blk").withColumn("qty_after", F.col("qty_after").cast(MONEY))


def latest_wins(df: DataFrame, key: list[str] | str, order: list[str]) -> DataFrame:
    """The last row per key by ``order`` (what repeated updates leave).

    A ``max`` over a struct whose leading fields are the order columns is an
    ordinary aggregate with a map-side partial step, so a key with a third of
    all rows is reduced before the shuffle (a ``row_number`` window would
    sort that key in one task)."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *rest)
    agg = df.groupBy(*keys).agg(F.max(packed).alias("_last"))
    sel = [F.col(f"_last._o{i}").alias(c) for i, c in enumerate(order)] + [F.col(f"_last.{c}").alias(c) for c in rest]
    return agg.select(*keys, *sel).select(*df.columns)


def closing_stock(movements: DataFrame, products: DataFrame) -> DataFrame:
    """Stock after all movements for every product (products without
    movements keep their opening stock).

    Given raw movements, only the block summaries of the scan are needed
    (``floored_closing``).  Given a ledger (with ``stock_after``), its last
    row per product is taken."""
    if "stock_after" in movements.columns:
        order = _order_cols(movements, ["log_date", "log_time", "txn_id", "line_seq", "kind"])
        last = latest_wins(movements.select("product_id", *order, "stock_after"), "product_id", order)
        last = last.select("product_id", F.col("stock_after").alias("closing"))
    else:
        order = _order_cols(movements, ["log_time", "txn_id", "line_seq", "kind"])
        last = floored_closing(_product_blocks(movements), "product_id", "_blk", order, "quantity_change",
                               _openings(products), "opening")
    return (products.select("product_id", "name", F.col("stock").cast("bigint").alias("opening_stock"))
            .join(last, "product_id", "left")
            .select("product_id", "name", "opening_stock",
                    F.coalesce(F.col("closing").cast("bigint"), F.col("opening_stock")).alias("closing_stock")))


# ---------------------------------------------------------------------------
# Catalogue and stock status


def product_catalogue(products: DataFrame) -> DataFrame:
    """A2: active products by category, name (id breaks ties)."""
    return products.filter("active").orderBy("category", "name", "product_id")


def material_list(materials: DataFrame) -> DataFrame:
    """A3: materials by category, name."""
    return materials.orderBy("category", "name", "id")


def search_products(products: DataFrame, category: str | None, q: str | None) -> DataFrame:
    """Category (or All) and case-insensitive substring of the name."""
    df = products.filter("active")
    if category and category != "All":
        df = df.filter(F.col("category") == category)
    if q:
        df = df.filter(F.lower("name").contains(q.lower()))
    return df


def low_stock(products: DataFrame) -> DataFrame:
    """Active products at or below their reorder point."""
    return products.filter(F.col("active") & (F.col("stock") <= F.col("reorder_point")))


def low_stock_materials(materials: DataFrame) -> DataFrame:
    """B6."""
    return materials.filter(F.col("stock_qty") <= F.col("reorder_point"))


def stock_status(stock: Column, reorder: Column) -> Column:
    """Out at zero, Low at or below the reorder point, else Available."""
    return F.when(stock == 0, "Out").when(stock <= reorder, "Low").otherwise("Available")


def margin_pct(price: Column, cost: Column) -> Column:
    """Margin % rounded to one decimal; null for a zero price (H3)."""
    return F.round(F.try_divide((price - cost) * 100, F.when(price != 0, price)), 1).cast("decimal(10,1)")


def margin_band(pct: Column) -> Column:
    """>50 high, >35 mid, else low, on the one-decimal value."""
    return F.when(pct > 50, "high").when(pct > 35, "mid").otherwise("low")


PRICE_LIST_CATEGORIES = ["Bread", "Pastry", "Cake", "Beverage"]


def price_list(products: DataFrame) -> DataFrame:
    """Per active product of the four sections: margin %, margin amount,
    band and stock status."""
    p = products.filter(F.col("active") & F.col("category").isin(PRICE_LIST_CATEGORIES))
    pct = margin_pct(F.col("price"), F.col("cost"))
    return p.select("category", "sku", "product_id", "name", "price", "cost", pct.alias("margin_pct"),
                    (F.col("price") - F.col("cost")).alias("margin_amount"), margin_band(pct).alias("band"),
                    "stock", stock_status(F.col("stock"), F.col("reorder_point")).alias("status")
                    ).orderBy("category", "name", "product_id")


def price_list_kpis(products: DataFrame) -> DataFrame:
    """Active product count, mean price, mean cost, mean of per-product
    margin % (rounded to one decimal)."""
    p = products.filter("active")
    ratio = F.try_divide((F.col("price") - F.col("cost")) * 100, F.when(F.col("price") != 0, F.col("price")))
    return p.agg(F.count(F.lit(1)).alias("products"),
                 F.round(F.avg("price"), 2).cast(MONEY).alias("avg_price"),
                 F.round(F.avg("cost"), 2).cast(MONEY).alias("avg_cost"),
                 F.round(F.avg(ratio), 1).cast("decimal(10,1)").alias("avg_margin_pct"))


def price_list_counts(products: DataFrame) -> DataFrame:
    """Active products per category."""
    return products.filter("active").groupBy("category").agg(F.count(F.lit(1)).alias("products"))


def inventory_report(products: DataFrame) -> DataFrame:
    """Per active product stock, reorder point, status and stock value."""
    return products.filter("active").select(
        "product_id", "sku", "name", "category", "stock", "reorder_point",
        stock_status(F.col("stock"), F.col("reorder_point")).alias("status"),
        (F.col("stock") * F.col("cost")).cast(MONEY).alias("stock_value"))


def low_stock_alert(products: DataFrame, materials: DataFrame) -> DataFrame:
    """Number of low-stock products and materials (the names are the
    rows of ``low_stock`` / ``low_stock_materials``)."""
    a = low_stock(products).agg(F.lit("products").alias("kind"), F.count(F.lit(1)).alias("low_stock_count"))
    b = low_stock_materials(materials).agg(F.lit("materials").alias("kind"),
                                           F.count(F.lit(1)).alias("low_stock_count"))
    return a.unionByName(b)


def material_stock_value(materials: DataFrame) -> DataFrame:
    """Sum of quantity x unit cost over all materials."""
    return materials.agg(
        F.coalesce(F.sum(F.col("stock_qty") * F.col("unit_cost")), F.lit(0)).cast(MONEY).alias("stock_value"))


def movements_on_day(movements: DataFrame, day) -> DataFrame:
    """Movements logged on a day, sales included, by type (no row cap)."""
    return (on_date(movements, "log_date", day).groupBy("movement_type")
            .agg(F.count(F.lit(1)).alias("movements")))


# ---------------------------------------------------------------------------
# Recipes (bill of materials)


def recipe_rows(recipes: DataFrame, materials: DataFrame) -> DataFrame:
    """Every recipe row with its material and the rounded contribution
    round(qty x unit cost, 0)."""
    m = materials.select(F.col("id").alias("raw_material_id"), F.col("name").alias("material_name"),
                         F.col("category").alias("material_category"), "unit", "unit_cost", "stock_qty")
    j = recipes.join(m, "raw_material_id", "inner")
    return j.select("product_id", "raw_material_id", "material_name", "material_category", "unit",
                    "unit_cost", "stock_qty", "qty_per_unit",
                    F.round(F.col("qty_per_unit") * F.col("unit_cost"), 0).cast(MONEY).alias("cost_contribution"))


def recipe_lines(recipes: DataFrame, materials: DataFrame) -> DataFrame:
    """I17 detail: the recipe rows by product, material category and name."""
    return recipe_rows(recipes, materials).orderBy("product_id", "material_category", "material_name", "raw_material_id")


def recipe_cost(recipes: DataFrame, materials: DataFrame, products: DataFrame) -> DataFrame:
    """Per product the sum of rounded contributions next to its
    standard cost.  Products without a recipe are not listed."""
    per = (recipe_rows(recipes, materials).groupBy("product_id")
           .agg(F.count(F.lit(1)).alias("materials"), F.sum("cost_contribution").cast(MONEY).alias("recipe_cost")))
    return (per.join(products.select("product_id", "name", F.col("cost").alias("standard_cost")), "product_id", "left")
            .withColumn("cost_gap", (F.col("recipe_cost") - F.col("standard_cost")).cast(MONEY)))


NAME_BUCKETS = 64          # per material, of its product names


def ingredients_overview(materials: DataFrame, recipes: DataFrame, products: DataFrame) -> DataFrame:
    """I18 (D15, D16, F7): per material the number of distinct products using
    it (inactive ones counted), the number of distinct *active* product names,
    and the label of the first three names (sorted) plus "+n lagi".

    (material, product) pairs are unique, so the first count counts rows.  One
    aggregate per (material, name) feeds both counts and the label: its rows
    are ranked within hash buckets, and per (material, bucket) only the counts
    and the first three names go on to the material.  The full name list of a
    material is the long-format ``ingredient_product_names``."""
    rp = recipes.select("raw_material_id", "product_id").join(
        products.select("product_id", F.col("name").alias("product_name"), "active"), "product_id", "left")
    shown = F.when(F.col("active"), F.col("product_name"))
    per_name = rp.groupBy("raw_material_id", shown.alias("product_name")).agg(F.count(F.lit(1)).alias("uses"))
    bucket = F.pmod(F.hash("product_name"), F.lit(NAME_BUCKETS))
    first = F.slice(F.array_sort(F.collect_list(F.when(F.col("_r") <= 3, F.col("product_name")))), 1, 3)
    per_bucket = (per_name.withColumn("_b", bucket)
                  .withColumn("_r", F.row_number().over(Window.partitionBy("raw_material_id", "_b").orderBy("product_name")))
                  .groupBy("raw_material_id", "_b")
                  .agg(F.sum("uses").alias("uses"), F.count("product_name").alias("names"), first.alias("first")))
    per = per_bucket.groupBy("raw_material_id").agg(
        F.sum("uses").alias("used_in_products"), F.sum("names").alias("n_product_names"),
        F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, 3).alias("_first"))
    label = F.array_join("_first", ", ")
    label = F.when(F.col("n_product_names") > 3,
                   F.concat(label, F.lit(" +"), (F.col("n_product_names") - 3).cast("string"), F.lit(seeds.MORE_NAMES_SUFFIX))
                   ).otherwise(label)
    out = materials.join(per, materials.id == per.raw_material_id, "left")
    return out.select(*materials.columns,
                      F.coalesce("used_in_products", F.lit(0)).alias("used_in_products"),
                      F.coalesce("n_product_names", F.lit(0)).alias("n_product_names"),
                      F.coalesce(label, F.lit("")).alias("used_in_label")).orderBy("category", "name", "id")


def ingredient_product_names(recipes: DataFrame, products: DataFrame) -> DataFrame:
    """D16 (long form): distinct active product names per material."""
    act = products.filter("active").select("product_id", F.col("name").alias("product_name"))
    return recipes.join(act, "product_id", "inner").select("raw_material_id", "product_name").distinct()


def recipe_links(recipes: DataFrame) -> DataFrame:
    """Total recipe links = sum over materials of products using them."""
    per = recipes.groupBy("raw_material_id").agg(F.countDistinct("product_id").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("recipe_links"))


def addable_materials(product_id: int, materials: DataFrame, recipes: DataFrame) -> DataFrame:
    """Materials not yet in one product's recipe (the recipe editor's
    choice list); an anti join, no pairing of products with materials."""
    used = recipes.filter(F.col("product_id") == F.lit(product_id)).select(F.col("raw_material_id").alias("id"))
    return materials.join(used, "id", "left_anti")


# ---------------------------------------------------------------------------
# Sales per product


def product_sales(t: dict[str, DataFrame], as_of, month=None, year=None) -> DataFrame:
    """Per product: units sold on ``as_of``, units and revenue (line price) in
    the period.  Lines meet their sale's date once and are summed per product,
    with a map-side partial aggregate; raw lines get the product's price after
    that sum."""
    hdr = period_headers(t, month, year).select("txn_id", (F.col("transaction_date") == F.lit(as_of)).alias("_today"))
    items = t["transaction_items"]
    if "lineitem" in t:
        lines = (t["lineitem"].join(hdr.withColumnRenamed("txn_id", "l_orderkey"), "l_orderkey")
                 .select(F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("int").alias("quantity"), "_today"))
    elif "transaction_date" in items.columns:     # stored model: lines carry the sale date
        lines = (in_period(items, "transaction_date", month, year).filter(F.col("transaction_date").isNotNull())
                 .withColumn("_today", F.col("transaction_date") == F.lit(as_of)))
    else:
        lines = items.join(hdr, "txn_id")
    revenue = F.sum(F.col("quantity") * F.col("unit_price")) if "unit_price" in lines.columns else F.lit(None)
    per = lines.groupBy("product_id").agg(
        F.sum(F.when(F.col("_today"), F.col("quantity")).otherwise(0)).alias("sold_today"),
        F.sum("quantity").alias("sold_period"), revenue.cast(MONEY).alias("revenue"))
    if "unit_price" in lines.columns:
        return per
    price = t["products"].select("product_id", "price")
    return per.join(price, "product_id", "left").select(
        "product_id", "sold_today", "sold_period", (F.col("sold_period") * F.col("price")).cast(MONEY).alias("revenue"))


def product_revenue(t, as_of, month=None, year=None) -> DataFrame:
    """Revenue per active product, zero-sale products included."""
    s = product_sales(t, as_of, month, year)
    return (t["products"].filter("active").select("product_id", "name", "category")
            .join(s.select("product_id", "revenue"), "product_id", "left")
            .select("product_id", "name", "category",
                    F.coalesce("revenue", F.lit(0).cast(MONEY)).alias("revenue")))


def top_products(t, as_of, month=None, year=None, k: int = 5) -> DataFrame:
    """the k best-selling products by revenue (a top-k report)."""
    return (product_revenue(t, as_of, month, year)
            .orderBy(F.col("revenue").desc(), "category", "name", "product_id").limit(k))


def production_log(t, as_of, month=None, year=None) -> DataFrame:
    """Active products sold in the period with units sold on
    ``as_of`` and in the period; the revenue column is units x *current*
    price, as the production screen shows it."""
    s = product_sales(t, as_of, month, year)
    p = t["products"].filter("active").select("product_id", "name", "category", "price")
    return (p.join(s.filter(F.col("sold_period") > 0), "product_id", "inner")
            .select("product_id", "name", "category", "sold_today", "sold_period",
                    (F.col("sold_period") * F.col("price")).cast(MONEY).alias("revenue_at_current_price"))
            .orderBy(F.col("sold_period").desc(), "product_id"))


def production_kpis(t, as_of, month=None, year=None) -> DataFrame:
    """Active products, units sold on ``as_of`` and in the period."""
    s = product_sales(t, as_of, month, year)
    act = t["products"].filter("active").select("product_id")
    sold = s.join(act, "product_id", "left_semi").agg(
        F.coalesce(F.sum("sold_today"), F.lit(0)).alias("units_today"),
        F.coalesce(F.sum("sold_period"), F.lit(0)).alias("units_period"))
    n = act.agg(F.count(F.lit(1)).alias("active_products"))
    from tillbook.operators.reports import _side_by_side
    return _side_by_side(n, sold)
