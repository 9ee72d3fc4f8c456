"""Registered queries: data-quality rules K1-K5."""

from __future__ import annotations

from tillbook.operators import quality as q
from pyspark.sql import functions as F

from tillbook.plans.catalog import AS_OF, query
from tillbook.plans.oracle_sql import oracle
from tillbook.plans.q_ledger import journal


def _with_journal(m):
    t = dict(m)
    t["journal"] = journal(m)
    return t


def enum_sql() -> str:
    parts = []
    for table, col, allowed in q.ENUM_RULES:
        lst = ", ".join(f"'{a}'" for a in allowed)
        parts.append(f"SELECT 'enum:{table}.{col}' AS rule, CAST({col} AS VARCHAR) AS key, COUNT(*) AS n FROM {table} "
                     f"WHERE {col} IS NOT NULL AND {col} NOT IN ({lst}) GROUP BY {col}")
    return "\nUNION ALL\n".join(parts)


def dup_sql() -> str:
    parts = []
    for table, cols in q.UNIQUE_RULES:
        key = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in cols)
        parts.append(f"SELECT 'unique:{table}.{'+'.join(cols)}' AS rule, {key} AS key, COUNT(*) AS n FROM {table} "
                     f"GROUP BY {key} HAVING COUNT(*) > 1")
    return "\nUNION ALL\n".join(parts)


def orphan_sql() -> str:
    parts = []
    for rule, child, ck, parent, pk in q.FOREIGN_KEYS:
        parts.append(f"SELECT 'orphan:{rule}' AS rule, CAST({ck} AS VARCHAR) AS key, COUNT(*) AS n FROM {child} "
                     f"WHERE {ck} IS NOT NULL AND {ck} NOT IN (SELECT {pk} FROM {parent}) GROUP BY {ck}")
    return "\nUNION ALL\n".join(parts)


def null_sql() -> str:
    parts = []
    for table, cols in q.REQUIRED.items():
        for c in cols:
            parts.append(f"SELECT 'not_null:{table}' AS rule, '{c}' AS key, COUNT(*) - COUNT({c}) AS n FROM {table}")
    return "\nUNION ALL\n".join(parts)


@query("enum_violations", oracle(enum_sql()))
def q_enum(m, spark):
    """K1 (the adapter's Promo category and Voucher method are flagged)."""
    return q.enum_violations(m)


@query("duplicate_keys", oracle(dup_sql()))
def q_dups(m, spark):
    """K2."""
    return q.duplicate_keys(m)


@query("orphans", oracle(orphan_sql()))
def q_orphans(m, spark):
    """K3 (journal included)."""
    return q.orphans(_with_journal(m))


@query("null_required", oracle(null_sql()))
def q_nulls(m, spark):
    """K4."""
    return q.null_required(m)


HEADER_VS_LINES_SQL = """
SELECT txn_id, receipt_no, CAST(supplied_total AS DOUBLE) AS supplied_total, CAST(total AS DOUBLE) AS recomputed_total,
  CAST(supplied_total - total AS DOUBLE) AS diff
FROM transactions WHERE supplied_total <> total"""


@query("header_vs_lines", oracle(HEADER_VS_LINES_SQL))
def q_header_vs_lines(m, spark):
    """K5."""
    return q.header_vs_lines(m)


CUT_CTES = """
kept_products AS (SELECT * FROM products WHERE active),
kept_transactions AS (SELECT * FROM transactions WHERE payment_method <> 'Voucher')"""


@query("orphans_after_cut", oracle("""
SELECT 'orphan:line_without_sale' AS rule, CAST(txn_id AS VARCHAR) AS key, COUNT(*) AS n FROM transaction_items
WHERE txn_id NOT IN (SELECT txn_id FROM kept_transactions) GROUP BY txn_id
UNION ALL
SELECT 'orphan:line_without_product', CAST(product_id AS VARCHAR), COUNT(*) FROM transaction_items
WHERE product_id NOT IN (SELECT product_id FROM kept_products) GROUP BY product_id
UNION ALL
SELECT 'orphan:recipe_without_product', CAST(product_id AS VARCHAR), COUNT(*) FROM product_ingredients
WHERE product_id NOT IN (SELECT product_id FROM kept_products) GROUP BY product_id""", CUT_CTES))
def q_orphans_after_cut(m, spark):
    """K3 with faults in the data: the discontinued products and the sales of
    an unknown payment method are missing from their tables."""
    t = _with_journal(m)
    t["products"] = m["products"].filter("active")
    t["sale_headers"] = m["sale_headers"].filter(F.col("payment_method") != "Voucher")
    return q.orphans(t)


@query("duplicate_keys_after_replay", oracle(f"""
SELECT 'unique:transactions.receipt_no' AS rule, receipt_no AS key, CAST(2 AS BIGINT) AS n FROM transactions
WHERE transaction_date = DATE '{AS_OF}'
UNION ALL
SELECT 'unique:product_ingredients.product_id+raw_material_id', l_partkey || '|' || l_suppkey, COUNT(*)
FROM lineitem GROUP BY l_partkey, l_suppkey HAVING COUNT(*) > 1"""))
def q_duplicates_after_replay(m, spark):
    """K2 with faults in the data: one day's sales were delivered twice, and
    recipes were loaded from the lines without grouping the pairs."""
    t = dict(m)
    again = m["sale_headers"].filter(F.col("transaction_date") == F.lit(AS_OF))
    t["transactions"] = m["sale_headers"].unionByName(again)
    t["product_ingredients"] = m["lineitem"].select(F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("raw_material_id"))
    return q.duplicate_keys(t)
