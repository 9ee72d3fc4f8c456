import datetime as dt
from decimal import Decimal as D

from pyspark.sql import types as T

ITEM_SCHEMA = T.StructType([
    T.StructField("txn_id", T.LongType()), T.StructField("line_seq", T.IntegerType()),
    T.StructField("product_id", T.LongType()), T.StructField("product_name", T.StringType()),
    T.StructField("category", T.StringType()), T.StructField("quantity", T.IntegerType()),
    T.StructField("unit_price", T.DecimalType(12, 2)), T.StructField("unit_cost", T.DecimalType(12, 2)),
    T.StructField("line_total", T.DecimalType(14, 2)),
])
TXN_SCHEMA = T.StructType([
    T.StructField("txn_id", T.LongType()), T.StructField("transaction_date", T.DateType()),
    T.StructField("transaction_time", T.StringType()), T.StructField("cashier_name", T.StringType()),
    T.StructField("payment_method", T.StringType()), T.StructField("receipt_no", T.StringType()),
    T.StructField("verified", T.BooleanType()),
])
PRODUCT_SCHEMA = T.StructType([
    T.StructField("product_id", T.LongType()), T.StructField("name", T.StringType()),
    T.StructField("category", T.StringType()), T.StructField("price", T.DecimalType(12, 2)),
    T.StructField("cost", T.DecimalType(12, 2)), T.StructField("stock", T.IntegerType()),
    T.StructField("reorder_point", T.IntegerType()), T.StructField("sku", T.StringType()),
    T.StructField("supplier", T.StringType()), T.StructField("active", T.BooleanType()),
])


def items(spark, rows):
    """rows: (txn_id, line_seq, product_id, category, qty, price, cost)"""
    return spark.createDataFrame(
        [(t, s, p, f"p{p}", c, q, D(pr), D(co), D(pr) * q) for t, s, p, c, q, pr, co in rows], ITEM_SCHEMA)


def txns(spark, rows):
    """rows: (txn_id, date, time, method)"""
    return spark.createDataFrame(
        [(t, dt.date.fromisoformat(d), tm, "c1", m, f"RCP-{t:07d}", False) for t, d, tm, m in rows], TXN_SCHEMA)


def products(spark, rows):
    """rows: (id, name, category, price, cost, stock, reorder, active)"""
    return spark.createDataFrame(
        [(i, n, c, D(p), D(co), s, r, f"SKU-{i:06d}", "", a) for i, n, c, p, co, s, r, a in rows], PRODUCT_SCHEMA)


def with_totals(txn_df, item_df):
    from pyspark.sql import functions as F
    from tillbook.operators.posting import sale_totals
    st = sale_totals(item_df).select("txn_id", "subtotal", "tax", "total")
    j = txn_df.join(st, "txn_id", "left")
    return j.select(txn_df["*"], *[F.coalesce(F.col(c), F.lit(0).cast("decimal(14,2)")).alias(c)
                                   for c in ("subtotal", "tax", "total")])
