"""K1-K5: data-quality rules of the model as set-based checks.

Every rule returns rows ``(rule, key, n)``: the rule name, the offending
value (as text) and how many rows carry it.  Checks are grouped aggregates
and anti joins; nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.sources import seeds

ENUM_RULES = [
    ("transactions", "payment_method", seeds.PAYMENT_METHODS),
    ("products", "category", seeds.PRODUCT_CATEGORIES),
    ("stock_movements", "movement_type", seeds.MOVEMENT_TYPES),
    ("chart_of_accounts", "account_type", seeds.ACCOUNT_TYPES),
    ("chart_of_accounts", "normal_balance", seeds.NORMAL_SIDES),
    ("raw_materials", "category", seeds.MATERIAL_CATEGORIES),
]
UNIQUE_RULES = [
    ("products", ["sku"]),
    ("transactions", ["receipt_no"]),
    ("product_ingredients", ["product_id", "raw_material_id"]),
]
# (rule, child table, child key, parent table, parent key)
FOREIGN_KEYS = [
    ("line_without_sale", "transaction_items", "txn_id", "transactions", "txn_id"),
    ("line_without_product", "transaction_items", "product_id", "products", "product_id"),
    ("journal_without_account", "journal", "account_code", "chart_of_accounts", "code"),
    ("recipe_without_product", "product_ingredients", "product_id", "products", "product_id"),
    ("recipe_without_material", "product_ingredients", "raw_material_id", "raw_materials", "id"),
]
REQUIRED = {
    "transactions": ["txn_id", "transaction_date", "transaction_time", "cashier_name", "payment_method", "receipt_no",
                     "subtotal", "tax", "total"],
    "transaction_items": ["txn_id", "product_id", "product_name", "category", "quantity", "unit_price", "unit_cost",
                          "line_total"],
    "products": ["product_id", "name", "category", "price", "cost", "stock", "reorder_point", "sku"],
    "raw_materials": ["id", "name", "category", "unit", "stock_qty", "reorder_point", "unit_cost"],
    "product_ingredients": ["product_id", "raw_material_id", "qty_per_unit"],
}


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def enum_violations(t: dict[str, DataFrame]) -> DataFrame:
    """K1: values outside an enumeration (nulls are K4's job)."""
    out = []
    for table, col, allowed in ENUM_RULES:
        df = t[table]
        bad = df.filter(F.col(col).isNotNull() & ~F.col(col).isin(allowed))
        out.append(bad.groupBy(F.col(col).cast("string").alias("key"))
                   .agg(F.count(F.lit(1)).alias("n"))
                   .select(F.lit(f"enum:{table}.{col}").alias("rule"), "key", "n"))
    return _union(out)


KEYS_IN_TASK = 1 << 18     # rows that one task of K2 counts


def _key_tasks(t: dict[str, DataFrame], table: str, cols: list[str]) -> int:
    """Tasks to count a table's keys in.  Recipes derived from lines are at most as many as the lines."""
    rows = t["lineitem"] if table == "product_ingredients" and "lineitem" in t else t[table].select(*cols)
    return max(1, -(-rows.count() // KEYS_IN_TASK))


def duplicate_keys(t: dict[str, DataFrame]) -> DataFrame:
    """K2: keys that must be unique but occur more than once.  Nearly every key is a group of its own, so rows are dealt
    by key to as many tasks as their number asks for, and counted as they are; only repeated keys become text."""
    out = []
    for table, cols in UNIQUE_RULES:
        counts = (t[table].select(*cols).repartition(_key_tasks(t, table, cols), *cols).groupBy(*cols)
                  .agg(F.count(F.lit(1)).alias("n")))
        key = F.concat_ws("|", *[F.col(c).cast("string") for c in cols])
        # a text leaves nulls out: several keys may share such a one
        shared = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols]) | (key == "")
        out.append(counts.filter((F.col("n") > 1) | shared).groupBy(key.alias("key")).agg(F.sum("n").alias("n"))
                   .filter(F.col("n") > 1)
                   .select(F.lit(f"unique:{table}.{'+'.join(cols)}").alias("rule"), "key", "n"))
    return _union(out)


def _sources(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The narrowest frames that hold the keys of ``FOREIGN_KEYS``: headers without derived totals and raw lines without
    product columns, where the model has them."""
    out = dict(t)
    if "sale_headers" in t:
        out["transactions"] = t["sale_headers"]
    if "lineitem" in t:
        out["transaction_items"] = t["lineitem"].select(F.col("l_orderkey").alias("txn_id"), F.col("l_partkey").alias("product_id"))
    return out


def orphans(t: dict[str, DataFrame]) -> DataFrame:
    """K3: child rows whose parent key does not exist.  Children are counted by
    key before they meet their parents, so a hot key is one row a task."""
    t, out = _sources(t), []
    for rule, child, ck, parent, pk in FOREIGN_KEYS:
        parents = t[parent].select(F.col(pk).alias(ck))
        counts = t[child].filter(F.col(ck).isNotNull()).groupBy(ck).agg(F.count(F.lit(1)).alias("n"))
        out.append(counts.join(parents, ck, "left_anti")
                   .select(F.lit(f"orphan:{rule}").alias("rule"), F.col(ck).cast("string").alias("key"), "n"))
    return _union(out)


def null_required(t: dict[str, DataFrame]) -> DataFrame:
    """K4: null counts of required columns (one conditional-sum pass per table;
    every checked column is reported, zero included)."""
    out = []
    for table, cols in REQUIRED.items():
        agg = t[table].agg(*[F.count(F.when(F.col(c).isNull(), F.lit(1))).alias(c) for c in cols])
        stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("n")) for c in cols]))
        out.append(agg.select(stacked.alias("s")).select(F.lit(f"not_null:{table}").alias("rule"), "s.key", "s.n"))
    return _union(out)


def header_vs_lines(t: dict[str, DataFrame]) -> DataFrame:
    """K5: sales whose supplied header total differs from the total recomputed
    from their lines (subtotal + rounded 11 % tax)."""
    tx = t["transactions"]
    return (tx.filter(F.col("supplied_total") != F.col("total"))
            .select("txn_id", "receipt_no", F.col("supplied_total"), F.col("total").alias("recomputed_total"),
                    (F.col("supplied_total") - F.col("total")).alias("diff")))


def quality_report(t: dict[str, DataFrame]) -> DataFrame:
    """K1-K4 stacked, plus the K5 mismatch count."""
    k5 = header_vs_lines(t).agg(F.lit("header_vs_lines").alias("rule"), F.lit("*").alias("key"),
                                F.count(F.lit(1)).alias("n"))
    return _union([enum_violations(t), duplicate_keys(t), orphans(t), null_required(t), k5])
