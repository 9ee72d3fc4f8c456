"""A1: load the driver's star-schema Parquet tables and derive the bakery model.

Every model table is a lazy DataFrame built with built-in expressions, so
Catalyst prunes what a query does not use (e.g. the ``line_seq`` window
disappears from plans that never read it) and pushes filters to the scans.

The same definitions exist as SQL text (``MODEL_CTES``) for the DuckDB oracle.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.sources import seeds

RAW_SCHEMAS = {
    "part": T.StructType([
        T.StructField("p_partkey", T.LongType()), T.StructField("p_name", T.StringType()),
        T.StructField("p_brand", T.StringType()), T.StructField("p_type", T.StringType()),
        T.StructField("p_size", T.IntegerType()), T.StructField("p_retailprice", T.DoubleType()),
    ]),
    "orders": T.StructType([
        T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
        T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_orderdate", T.TimestampNTZType()), T.StructField("o_orderpriority", T.StringType()),
    ]),
    "lineitem": T.StructType([
        T.StructField("l_orderkey", T.LongType()), T.StructField("l_partkey", T.LongType()),
        T.StructField("l_suppkey", T.LongType()), T.StructField("l_linenumber", T.IntegerType()),
        T.StructField("l_quantity", T.DoubleType()), T.StructField("l_extendedprice", T.DoubleType()),
        T.StructField("l_discount", T.DoubleType()), T.StructField("l_tax", T.DoubleType()),
        T.StructField("l_returnflag", T.StringType()), T.StructField("l_linestatus", T.StringType()),
        T.StructField("l_shipdate", T.TimestampNTZType()),
    ]),
    "supplier": T.StructType([
        T.StructField("s_suppkey", T.LongType()), T.StructField("s_name", T.StringType()),
        T.StructField("s_nationkey", T.IntegerType()), T.StructField("s_acctbal", T.DoubleType()),
    ]),
}

# Fixed values of the adapter (see FIXTURES.md section 2).
CATEGORY_BY_TYPE = [("ECONOMY", "Bread"), ("STANDARD", "Bread"), ("MEDIUM", "Pastry"),
                    ("LARGE", "Cake"), ("SMALL", "Beverage"), ("PROMO", "Promo")]
COST_FACTOR_BY_SIZE_MOD5 = [Decimal("0.30"), Decimal("0.40"), Decimal("0.50"),
                            Decimal("0.60"), Decimal("0.70")]
PAYMENT_BY_PRIORITY = [("1-URGENT", "Cash"), ("2-HIGH", "QRIS"), ("3-MEDIUM", "GoPay"),
                       ("4-NOT SPECIFIED", "Debit"), ("5-LOW", "Voucher")]
RETURN_TIME = "23:59:59"


def read_raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = RAW_SCHEMAS.get(name)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def _case(col: Column, pairs, default: Column) -> Column:
    expr = None
    for k, v in pairs:
        expr = F.when(col == F.lit(k), F.lit(v)) if expr is None else expr.when(col == F.lit(k), F.lit(v))
    return expr.otherwise(default)


def products_from_part(part: DataFrame) -> DataFrame:
    price = F.col("p_retailprice").cast("decimal(12,2)")
    factor = _case(F.col("p_size") % 5, list(enumerate(COST_FACTOR_BY_SIZE_MOD5)), F.lit(None))
    return part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("name"),
        _case(F.col("p_type"), CATEGORY_BY_TYPE, F.col("p_type")).alias("category"),
        price.alias("price"),
        F.round(price * factor, 2).cast("decimal(12,2)").alias("cost"),
        F.col("p_size").alias("stock"),
        F.lit(10).alias("reorder_point"),
        F.format_string("SKU-%06d", F.col("p_partkey")).alias("sku"),
        F.col("p_brand").alias("supplier"),
        (F.col("p_partkey") % 50 != 0).alias("active"),
    )


def items_from_lineitem(lineitem: DataFrame, products: DataFrame) -> DataFrame:
    """Sale lines.  The join to products is a plain equi-join: the product
    dimension grows with the data, so no broadcast is forced; Spark's size
    statistics or AQE (after measuring the product side at runtime) decide.
    It is a left join: a line of an unknown product stays, with its product id
    and null product columns, and the quality rules K3 and K4 report it.

    ``line_key`` holds the raw columns that order lines inside a sale;
    ``line_seq`` numbers them with a window partitioned by ``txn_id``, so a
    semi join on ``txn_id`` (a page of sales) is pushed below the window and
    only the selected sales are numbered.  Plans that never read
    ``line_seq`` lose the window entirely."""
    # raw columns are numbered, and what is derived from them (the line key repeats most) is made behind the window
    return line_columns(priced_lines(lineitem, products).withColumn("line_seq", _numbered()))


def _numbered() -> Column:
    return F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_KEY)).cast("int")


def priced_lines(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Raw lines with the columns of their product that a sale line shows."""
    p = products.select("product_id", F.col("name").alias("product_name"), "category",
                        F.col("price").alias("unit_price"), F.col("cost").alias("unit_cost"))
    more = [c for c in lines.columns if c in ("line_seq", *SALE_COLUMNS)]
    return (lines.join(p, lines.l_partkey == p.product_id, "left")
            .select("l_orderkey", *LINE_KEY, "l_returnflag", "product_name", "category", "unit_price", "unit_cost", *more))


def line_columns(priced: DataFrame, *others: str) -> DataFrame:
    """The columns of a sale line from a priced and numbered raw line; ``others`` are kept as they are."""
    qty = F.col("l_quantity").cast("int")
    return priced.select(
        F.col("l_orderkey").alias("txn_id"), "line_seq",
        F.struct(*LINE_KEY).alias("line_key"),
        F.col("l_partkey").alias("product_id"), "product_name", "category",
        qty.alias("quantity"),
        "unit_price", "unit_cost",
        (F.col("unit_price") * qty).cast("decimal(14,2)").alias("line_total"),
        F.col("l_returnflag").alias("return_flag"),
        F.col("l_shipdate").cast("date").alias("ship_date"),
        F.col("l_suppkey").alias("supp_id"), *others,
    )


def headers_from_orders(orders: DataFrame) -> DataFrame:
    secs = F.lit(28800) + (F.col("o_orderkey") * 37) % 43200
    return orders.select(
        F.col("o_orderkey").alias("txn_id"),
        F.col("o_orderdate").cast("date").alias("transaction_date"),
        F.format_string("%02d:%02d:%02d", F.floor(secs / 3600), F.floor(secs / 60) % 60,
                        secs % 60).alias("transaction_time"),
        F.concat(F.lit("cashier_"), (F.col("o_custkey") % 3).cast("string")).alias("cashier_name"),
        _case(F.col("o_orderpriority"), PAYMENT_BY_PRIORITY, F.col("o_orderpriority")).alias("payment_method"),
        F.format_string("RCP-%07d", F.col("o_orderkey")).alias("receipt_no"),
        (F.col("o_orderstatus") == "F").alias("verified"),
        F.col("o_totalprice").cast("decimal(14,2)").alias("supplied_total"),
    )


def materials_from_supplier(supplier: DataFrame) -> DataFrame:
    cats = list(enumerate(seeds.MATERIAL_CATEGORIES))
    return supplier.select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        _case(F.col("s_nationkey") % 8, cats, F.lit(None)).alias("category"),
        F.lit("gram").alias("unit"),
        F.greatest(F.col("s_acctbal"), F.lit(0.0)).cast("decimal(12,2)").alias("stock_qty"),
        F.lit(Decimal("500.00")).cast("decimal(12,2)").alias("reorder_point"),
        (F.lit(1) + F.col("s_suppkey") % 50).cast("decimal(12,2)").alias("unit_cost"),
        F.lit("").alias("supplier"),
        F.lit(True).alias("active"),
    )


def recipes_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Bill of materials: one row per (part, supplier) pair seen in sales.
    Partial aggregation runs map-side before the shuffle on the pair."""
    return (lineitem.groupBy(F.col("l_partkey").alias("product_id"),
                             F.col("l_suppkey").alias("raw_material_id"))
            .agg(F.min("l_quantity").cast("decimal(10,3)").alias("qty_per_unit")))


LINE_KEY = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
SALE_COLUMNS = ("transaction_date", "transaction_time", "receipt_no", "cashier_name", "_part")   # of a sale, beside its lines


def _plain_lines(lineitem: DataFrame, *others: str) -> DataFrame:
    """The raw lines in the model's names, without anything from products; ``others`` are kept as they are."""
    return lineitem.select(
        F.col("l_orderkey").alias("txn_id"), F.struct(*LINE_KEY).alias("line_key"), F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("raw_material_id"), F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_returnflag").alias("return_flag"), F.col("l_shipdate").cast("date").alias("ship_date"), *others)


def _line_seq():
    return F.row_number().over(Window.partitionBy("txn_id").orderBy("line_key")).cast("int").alias("line_seq")


def stock_movements(lineitem: DataFrame, headers: DataFrame) -> DataFrame:
    """E1 input: a sale is -quantity at the sale's date/time; a returned line
    (flag R) is +quantity at its ship date, end of day.  ``kind`` (0 sale,
    1 return) completes the total order (date, time, txn_id, line_seq, kind).
    The movement of a line without a sale header stays, without date and time.
    Names are not part of a movement; a ledger or listing adds them last."""
    return movement_columns(moved_lines(numbered_lines(lineitem, headers)))


def numbered_lines(lineitem: DataFrame, headers: DataFrame) -> DataFrame:
    """The raw lines with ``line_seq`` and the columns of their sale that a movement shows; without a header they are null."""
    raw = lineitem.select("l_orderkey", *LINE_KEY, "l_returnflag").withColumn("line_seq", _numbered())
    hdr = headers.select("txn_id", *[c for c in headers.columns if c in SALE_COLUMNS])
    return raw.join(hdr, F.col("l_orderkey") == F.col("txn_id"), "left").drop("txn_id")


def moved_lines(numbered: DataFrame) -> DataFrame:
    """One pass: each numbered line yields its sale and, when flagged, its return (``kind``), still in raw columns."""
    kinds = F.when(F.col("l_returnflag") == "R", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (numbered.withColumn("kind", F.explode(kinds))
            .withColumn("log_date", F.when(F.col("kind") == 0, F.col("transaction_date")).otherwise(F.col("l_shipdate").cast("date")))
            .drop("transaction_date", "l_returnflag"))


def movement_columns(moved: DataFrame, *others: str) -> DataFrame:
    """The columns of a movement from raw columns; ``others`` are kept as they are."""
    sale, qty = F.col("kind") == 0, F.col("l_quantity").cast("int")
    return moved.select(
        F.col("l_partkey").alias("product_id"), "log_date",
        F.when(sale, F.col("transaction_time")).otherwise(RETURN_TIME).alias("log_time"),
        F.col("l_orderkey").alias("txn_id"), "line_seq", F.struct(*LINE_KEY).alias("line_key"), "kind",
        F.when(sale, "Sale").otherwise("Return").alias("movement_type"),
        F.when(sale, -qty).otherwise(qty).alias("quantity_change"),
        F.concat(F.when(sale, "Sale: ").otherwise("Return: "), F.col("receipt_no")).alias("reason"),
        F.col("cashier_name").alias("performed_by"), *others)


def stock_movements_on(t: dict[str, DataFrame], day) -> DataFrame:
    """The stock movements logged on one day, built for that day only: the
    day's sales (headers filtered at their scan, lines semi-joined) and the
    returns shipped that day.  A stored model is simply filtered (its
    movements are partitioned by month)."""
    from tillbook.functions.periods import on_date
    if "sale_headers" not in t:
        return on_date(t["stock_movements"], "log_date", day)
    hdr = on_date(t["sale_headers"], "transaction_date", day)
    raw = t["lineitem"]
    sold = raw.join(hdr.select(F.col("txn_id").alias("l_orderkey")), "l_orderkey", "left_semi")
    returned = raw.filter((F.col("l_returnflag") == "R") & (F.col("l_shipdate").cast("date") == F.lit(day).cast("date")))
    return (stock_movements(sold, hdr).filter("kind = 0")
            .unionByName(stock_movements(returned, t["sale_headers"]).filter("kind = 1")))


def material_movements(lineitem: DataFrame) -> DataFrame:
    """E2 input: each sold line consumes its quantity of the supplier's
    material.  Built from the raw lines alone; a material needs no product."""
    return _plain_lines(lineitem).select(
        "raw_material_id", F.col("ship_date").alias("log_date"), "txn_id", _line_seq(), "line_key",
        (-F.col("quantity")).cast("decimal(12,2)").alias("qty_change"))


def resolve_material_ids(recipe_rows: DataFrame, materials: DataFrame) -> DataFrame:
    """Recipe rows that name their material get its id by a join on the
    name.  An unknown name keeps a null id (caught by the not-null rule, as
    the seed's insert would fail); a name shared by several materials is
    ambiguous and resolves to null as well, instead of fanning out."""
    names = (materials.groupBy("name")
             .agg(F.min("id").alias("_id"), F.count(F.lit(1)).alias("_n"))
             .select(F.col("name").alias("material_name"),
                     F.when(F.col("_n") == 1, F.col("_id")).alias("raw_material_id")))
    return (recipe_rows.join(names, "material_name", "left")
            .select("product_id", "material_name", "raw_material_id", "qty_per_unit",
                    F.col("raw_material_id").isNotNull().alias("resolved")))


def with_sale_totals(headers: DataFrame, items: DataFrame) -> DataFrame:
    """Headers with subtotal, VAT and total computed from their lines (I1);
    a header without lines gets zeros."""
    from tillbook.operators.posting import sale_totals
    totals = sale_totals(items)
    return (headers.join(totals, "txn_id", "left")
            .select(headers["*"],
                    *[F.coalesce(F.col(c), F.lit(0).cast("decimal(14,2)")).cast("decimal(14,2)").alias(c)
                      for c in ("subtotal", "tax", "total")]))


def sale_lines(t: dict[str, DataFrame], ids: DataFrame | None = None) -> DataFrame:
    """The sale lines, all or those of the sales in ``ids``.  The raw lines
    are semi-joined to the selected sales before any other join or aggregate,
    so only selected lines reach a later shuffle, whatever the sizes."""
    if ids is None:
        return t["transaction_items"]
    if "lineitem" in t:
        wanted = ids.select(F.col("txn_id").alias("l_orderkey"))
        return items_from_lineitem(t["lineitem"].join(wanted, "l_orderkey", "left_semi"), t["products"])
    return t["transaction_items"].join(ids.select("txn_id"), "txn_id", "left_semi")


def period_headers(t: dict[str, DataFrame], month=None, year=None, day=None) -> DataFrame:
    """Header rows of a period (month/year) and/or one day; totals are there
    only if they are stored.  The filters reach the header scan."""
    from tillbook.functions.periods import in_period, on_date
    df = in_period(t.get("sale_headers", t["transactions"]), "transaction_date", month, year)
    return on_date(df, "transaction_date", day) if day is not None else df


def headers_for(t: dict[str, DataFrame], ids: DataFrame) -> DataFrame:
    """Header rows (with totals) of a selected set of sales.  When totals are
    derived from lines (``sale_headers`` present), only the selected sales'
    lines are aggregated; a stored ``transactions`` table is just filtered."""
    ids = ids.select("txn_id")
    if "sale_headers" in t:
        return with_sale_totals(t["sale_headers"].join(ids, "txn_id", "left_semi"), sale_lines(t, ids))
    return t["transactions"].join(ids, "txn_id", "left_semi")


def period_transactions(t: dict[str, DataFrame], month=None, year=None, day=None) -> DataFrame:
    """Headers with totals of the sales of a period (month/year) or of one
    day.  With derived totals only those sales' lines are joined and
    aggregated; a stored ``transactions`` table is just filtered, with
    month-partition pruning."""
    hdr = period_headers(t, month, year, day)
    if "sale_headers" not in t:
        return hdr
    if not (month or year or day is not None):
        return t["transactions"]
    return with_sale_totals(hdr, sale_lines(t, hdr))


def load(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All model tables as lazy DataFrames keyed by model name."""
    part = read_raw(spark, sf_dir, "part")
    lineitem = read_raw(spark, sf_dir, "lineitem")
    orders = read_raw(spark, sf_dir, "orders")
    supplier = read_raw(spark, sf_dir, "supplier")

    products = products_from_part(part)
    items = items_from_lineitem(lineitem, products)
    headers = headers_from_orders(orders)
    transactions = with_sale_totals(headers, items)
    tables = {
        "lineitem": lineitem,
        "products": products,
        "transaction_items": items,
        "sale_headers": headers,
        "transactions": transactions,
        "raw_materials": materials_from_supplier(supplier),
        "product_ingredients": recipes_from_lineitem(lineitem),
    }
    tables["stock_movements"] = stock_movements(lineitem, headers)
    tables["material_movements"] = material_movements(lineitem)
    tables.update(seeds.seed_dims(spark))
    return tables


# ---------------------------------------------------------------------------
# The same model as DuckDB SQL, used only by the oracle in __spark_entry__.
MODEL_CTES = """
products AS (
  SELECT p_partkey AS product_id, p_name AS name,
    CASE p_type WHEN 'ECONOMY' THEN 'Bread' WHEN 'STANDARD' THEN 'Bread' WHEN 'MEDIUM' THEN 'Pastry'
      WHEN 'LARGE' THEN 'Cake' WHEN 'SMALL' THEN 'Beverage' WHEN 'PROMO' THEN 'Promo' ELSE p_type END AS category,
    CAST(p_retailprice AS DECIMAL(12,2)) AS price,
    CAST(ROUND(CAST(p_retailprice AS DECIMAL(12,2)) * CASE p_size % 5 WHEN 0 THEN 0.30 WHEN 1 THEN 0.40
      WHEN 2 THEN 0.50 WHEN 3 THEN 0.60 WHEN 4 THEN 0.70 END, 2) AS DECIMAL(12,2)) AS cost,
    p_size AS stock, 10 AS reorder_point, printf('SKU-%06d', p_partkey) AS sku,
    p_brand AS supplier, (p_partkey % 50 <> 0) AS active
  FROM part),
transaction_items AS (
  SELECT l.l_orderkey AS txn_id,
    CAST(row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey,
      l.l_quantity, l.l_extendedprice, l.l_shipdate) AS INTEGER) AS line_seq,
    l.l_partkey AS product_id, p.name AS product_name, p.category, CAST(l.l_quantity AS INTEGER) AS quantity,
    p.price AS unit_price, p.cost AS unit_cost,
    CAST(p.price * CAST(l.l_quantity AS INTEGER) AS DECIMAL(14,2)) AS line_total,
    l.l_returnflag AS return_flag, CAST(l.l_shipdate AS DATE) AS ship_date, l.l_suppkey AS supp_id
  FROM lineitem l LEFT JOIN products p ON p.product_id = l.l_partkey),
sale_totals AS (
  SELECT txn_id, CAST(SUM(line_total) AS DECIMAL(14,2)) AS subtotal
  FROM transaction_items GROUP BY txn_id),
transactions AS (
  SELECT o.o_orderkey AS txn_id, CAST(o.o_orderdate AS DATE) AS transaction_date,
    printf('%02d:%02d:%02d', (28800 + (o.o_orderkey * 37) % 43200) // 3600,
      ((28800 + (o.o_orderkey * 37) % 43200) // 60) % 60, (28800 + (o.o_orderkey * 37) % 43200) % 60)
      AS transaction_time,
    'cashier_' || CAST(o.o_custkey % 3 AS VARCHAR) AS cashier_name,
    CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Cash' WHEN '2-HIGH' THEN 'QRIS' WHEN '3-MEDIUM' THEN 'GoPay'
      WHEN '4-NOT SPECIFIED' THEN 'Debit' WHEN '5-LOW' THEN 'Voucher' ELSE o.o_orderpriority END AS payment_method,
    printf('RCP-%07d', o.o_orderkey) AS receipt_no, (o.o_orderstatus = 'F') AS verified,
    CAST(o.o_totalprice AS DECIMAL(14,2)) AS supplied_total,
    CAST(COALESCE(s.subtotal, 0) AS DECIMAL(14,2)) AS subtotal,
    CAST(ROUND(COALESCE(s.subtotal, 0) * 0.11, 0) AS DECIMAL(14,2)) AS tax,
    CAST(COALESCE(s.subtotal, 0) + ROUND(COALESCE(s.subtotal, 0) * 0.11, 0) AS DECIMAL(14,2)) AS total
  FROM orders o LEFT JOIN sale_totals s ON s.txn_id = o.o_orderkey),
raw_materials AS (
  SELECT s_suppkey AS id, s_name AS name,
    CASE s_nationkey % 8 WHEN 0 THEN 'Flour & Grain' WHEN 1 THEN 'Dairy & Eggs' WHEN 2 THEN 'Fat & Oil'
      WHEN 3 THEN 'Sugar & Sweetener' WHEN 4 THEN 'Fruit & Filling' WHEN 5 THEN 'Flavoring'
      WHEN 6 THEN 'Packaging' WHEN 7 THEN 'Beverage Base' END AS category,
    'gram' AS unit, CAST(GREATEST(s_acctbal, 0.0) AS DECIMAL(12,2)) AS stock_qty,
    CAST(500 AS DECIMAL(12,2)) AS reorder_point, CAST(1 + s_suppkey % 50 AS DECIMAL(12,2)) AS unit_cost,
    '' AS supplier, TRUE AS active
  FROM supplier),
product_ingredients AS (
  SELECT l_partkey AS product_id, l_suppkey AS raw_material_id,
    CAST(MIN(l_quantity) AS DECIMAL(10,3)) AS qty_per_unit
  FROM lineitem GROUP BY l_partkey, l_suppkey),
stock_movements AS (
  SELECT i.product_id, i.product_name, t.transaction_date AS log_date, t.transaction_time AS log_time,
    i.txn_id, i.line_seq, 0 AS kind, 'Sale' AS movement_type, -i.quantity AS quantity_change,
    'Sale: ' || t.receipt_no AS reason, t.cashier_name AS performed_by
  FROM transaction_items i LEFT JOIN transactions t ON t.txn_id = i.txn_id
  UNION ALL
  SELECT i.product_id, i.product_name, i.ship_date, '23:59:59', i.txn_id, i.line_seq, 1, 'Return',
    i.quantity, 'Return: ' || t.receipt_no, t.cashier_name
  FROM transaction_items i LEFT JOIN transactions t ON t.txn_id = i.txn_id WHERE i.return_flag = 'R'),
material_movements AS (
  SELECT l_suppkey AS raw_material_id, CAST(l_shipdate AS DATE) AS log_date, l_orderkey AS txn_id,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
      l_quantity, l_extendedprice, l_shipdate) AS INTEGER) AS line_seq,
    CAST(-CAST(l_quantity AS INTEGER) AS DECIMAL(12,2)) AS qty_change
  FROM lineitem),
chart_of_accounts AS (SELECT * FROM """ + seeds.coa_values_sql() + """)
"""
