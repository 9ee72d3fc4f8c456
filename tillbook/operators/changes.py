"""Table changes as batch change-sets.

Each operator takes a base DataFrame and a DataFrame of changes and returns
the new table (to be written as a new Parquet version); no row-at-a-time
statements.  Keys are joined, never collected; repeated changes for one key
are reduced with ``latest_wins`` (an aggregate with map-side combine) before
they meet the base table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.operators.inventory import floored_ledger, latest_wins, stock_ledger
from tillbook.operators.posting import post_sales, sale_totals
from tillbook.plans.session import staged
from tillbook.sources import receipts, versions


def _date(d) -> Column:
    return F.lit(d if isinstance(d, dt.date) else dt.date.fromisoformat(str(d))).cast("date")


def one_per_key(changes: DataFrame, key: str, order: list[str] | None) -> DataFrame:
    """One change row per key: the last by ``order``; without an order a key
    that occurs twice is an error (nothing says which row counts)."""
    if order:
        return latest_wins(changes, key, order)
    rest = [c for c in changes.columns if c != key]
    grouped = changes.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("_row"))
    message = F.concat(F.lit(f"several change rows for {key} "), F.col(key).cast("string"), F.lit(" and no order"))
    row = F.when(F.col("_n") == 1, F.col("_row")).otherwise(
        F.raise_error(message).cast(grouped.schema["_row"].dataType.simpleString()))
    return grouped.select(key, row.alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def insert_rows(base: DataFrame, new_rows: DataFrame, defaults: dict) -> DataFrame:
    """Append new rows; columns missing or null in a new row take the
    default (e.g. empty supplier, stock 0, reorder point 5, cost 0)."""
    cols = []
    for f in base.schema.fields:
        if f.name in new_rows.columns:
            c = F.col(f.name)
        else:
            c = F.lit(None)
        if f.name in defaults:
            c = F.coalesce(c, F.lit(defaults[f.name]))
        cols.append(c.cast(f.dataType).alias(f.name))
    return base.unionByName(new_rows.select(*cols))


def update_rows(base: DataFrame, changes: DataFrame, key: str, as_of, order: list[str] | None = None,
                stamp_col: str = "updated_at") -> DataFrame:
    """Full-row update by key.  A matched row takes every column given in
    the change row and is stamped with ``as_of``; if a key has several change
    rows the last by ``order`` wins, and without an order that is an error."""
    ch = one_per_key(changes, key, order)
    given = [c for c in ch.columns if c != key and c in base.columns and c not in (order or [])]
    ch = ch.select(key, *[F.col(c).alias(f"_new_{c}") for c in given]).withColumn("_hit", F.lit(True))
    j = base.join(ch, key, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    out = []
    for f in base.schema.fields:
        if f.name in given:
            out.append(F.when(hit, F.col(f"_new_{f.name}")).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name))
        elif f.name != stamp_col:
            out.append(F.col(f.name))
    prev = F.col(stamp_col) if stamp_col in base.columns else F.lit(None).cast("date")
    out.append(F.when(hit, _date(as_of)).otherwise(prev).alias(stamp_col))
    return j.select(*out)


def soft_delete(base: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Set ``active`` to false for the given keys (rows stay)."""
    hit = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    j = base.join(hit, key, "left")
    return j.select(*[(F.col("active") & F.col("_hit").isNull()).alias("active") if c == "active" else F.col(c)
                      for c in base.columns])


def rejected_adjustments(products: DataFrame, adjustments: DataFrame) -> DataFrame:
    """The adjustments whose product does not exist."""
    return adjustments.join(products.select("product_id"), "product_id", "left_anti")


SEQ_IN_BLOCK = 1 << 12     # adjustments of one product in one block


def _sequence_blocks(adjustments: DataFrame, *order: str) -> DataFrame:
    """Blocks of the scan over a day's adjustments: (time, range of ``seq``),
    a prefix of their order, so one product's changes are split."""
    return adjustments.withColumn("_blk", F.struct(*order, F.floor(F.col("seq") / SEQ_IN_BLOCK).alias("s")))


def apply_stock_adjustments(products: DataFrame, adjustments: DataFrame, as_of,
                            default_type: str = "Adjustment") -> tuple[DataFrame, DataFrame]:
    """Apply signed stock changes in ``seq`` order with the floor at zero.

    ``adjustments``: product_id, qty_change, seq, and optionally movement_type,
    reason, performed_by, log_time.  Returns (new products, log rows); each log
    row carries the unclamped change and the floored stock after it.  An
    adjustment of an unknown product changes nothing; ``rejected_adjustments``
    returns those."""
    adj = adjustments
    for c, v in [("movement_type", default_type), ("reason", ""), ("performed_by", "System"),
                 ("log_time", "00:00:00")]:
        adj = adj.withColumn(c, F.coalesce(F.col(c), F.lit(v))) if c in adj.columns else adj.withColumn(c, F.lit(v))
    adj = adj.withColumn("log_date", _date(as_of))
    names = products.select("product_id", F.col("name").alias("product_name"))
    adj = adj.join(names, "product_id", "inner")
    log = floored_ledger(_sequence_blocks(adj, "log_time"), "product_id", "_blk", ["seq"], "qty_change",
                         products.select("product_id", F.col("stock").cast("bigint").alias("opening")), "opening")
    log = log.select("log_date", "log_time", "product_id", "product_name", "movement_type",
                     F.col("qty_change").alias("quantity_change"), F.col("stock_after").cast("int").alias("stock_after"),
                     "reason", "performed_by", "seq")
    final = latest_wins(log.select("product_id", "log_time", "seq", "stock_after"), "product_id", ["log_time", "seq"])
    new = update_rows(products, final.select("product_id", F.col("stock_after").alias("stock")), "product_id", as_of)
    return new, log


def apply_material_adjustments(materials: DataFrame, adjustments: DataFrame, as_of) -> DataFrame:
    """J4 for raw materials: signed decimal changes applied in ``seq`` order,
    floored at zero; the material table keeps no log row, so only the new
    table is returned (stamped with ``as_of`` where changed)."""
    adj = adjustments.select(F.col("raw_material_id"), F.col("qty_change").cast("decimal(12,2)").alias("qty_change"),
                             "seq")
    led = floored_ledger(_sequence_blocks(adj), "raw_material_id", "_blk", ["seq"], "qty_change",
                         materials.select(F.col("id").alias("raw_material_id"), F.col("stock_qty").alias("opening")),
                         "opening", "qty_after")
    final = latest_wins(led.select("raw_material_id", "seq", "qty_after"), "raw_material_id", ["seq"])
    changes = final.select(F.col("raw_material_id").alias("id"), F.col("qty_after").alias("stock_qty"))
    return update_rows(materials, changes, "id", as_of)


def upsert_pairs(base: DataFrame, changes: DataFrame, keys: list[str], value_cols: list[str],
                 order: list[str]) -> DataFrame:
    """Insert-or-update on a composite key (ON CONFLICT DO UPDATE); the
    last change per key by ``order`` wins."""
    last = latest_wins(changes.select(*keys, *value_cols, *order), keys, order)
    ch = last.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in value_cols], F.lit(True).alias("_hit"))
    j = base.join(ch, keys, "full_outer")
    return j.select(*keys, *[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
                             for c in value_cols])


def delete_pairs(base: DataFrame, keys_df: DataFrame, keys: list[str]) -> DataFrame:
    """Delete rows whose key appears in ``keys_df``."""
    return base.join(keys_df.select(*keys), keys, "left_anti")


def mark_verified(transactions: DataFrame, day) -> DataFrame:
    """Every sale of ``day`` becomes verified."""
    return transactions.withColumn(
        "verified", F.col("verified") | (F.col("transaction_date") == _date(day)))


def cascade_delete(parent_ids: DataFrame, key: str, children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Remove the children of deleted parents (one anti join each)."""
    ids = parent_ids.select(key)
    return {n: df.join(ids, key, "left_anti") for n, df in children.items()}


def reset_stock_by_sku(products: DataFrame, baseline: DataFrame) -> DataFrame:
    """Overwrite stock from a (sku, stock) baseline; other rows unchanged.
    A SKU listed twice is an error."""
    b = one_per_key(baseline.select("sku", F.col("stock").alias("_base_stock")), "sku", None)
    j = products.join(b, "sku", "left")
    return j.select(*[F.coalesce(F.col("_base_stock"), F.col("stock")).cast("int").alias("stock") if c == "stock"
                      else F.col(c) for c in products.columns])


def record_sales(headers: DataFrame, lines: DataFrame, products: DataFrame, out_dir: str, version: str, as_of,
                 carry: tuple[str, ...] = ()) -> str:
    """Record a batch of sales: totals (I1), journal (I2), stock log and
    new stock (E1 with the sales as negative changes).

    A receipt is recorded once: sales whose receipt is missing, was recorded
    in ``out_dir`` before, or belongs to an earlier sale of the batch change
    nothing and are listed in ``rejected_sales`` with the reason, so a batch
    delivered twice is a no-op the second time (``sources.receipts``).
    Recorded sales are not verified yet; the log names the product, the
    movement type and the cashier; products whose stock changed are stamped
    with ``as_of``.  The tables are written to a new folder of ``version`` and
    published together (``versions.publish``): readers never see half a batch,
    and a failed batch leaves the previous version in place.  ``out_dir`` must
    be a shared folder on a cluster (e.g. under ``spark.checkpoint.dir``).
    Returns the folder of the written version."""
    spark = headers.sparkSession
    last = versions.latest(spark, out_dir) or {"at": 0, "tables": {}}
    index = last["tables"].get(receipts.TABLE, [])
    carried = {name: last["tables"].get(name, []) for name in (receipts.TABLE, *carry)}
    with staged(receipts.judge(spark, index, headers), "judged-sales") as judged:
        return _record(judged, lines, products, out_dir, version, as_of, carried, last["at"])


def _record(judged: DataFrame, lines: DataFrame, products: DataFrame, out_dir: str, version: str, as_of,
            carried: dict[str, list[dict]], base_at: int) -> str:
    rejected = judged.filter("rejected is not null")
    headers = judged.filter("rejected is null").drop("rejected")
    zero = F.lit(0).cast("decimal(14,2)")
    order = ["log_date", "log_time", "txn_id", "line_seq"]

    # The lines are written first and once; what is made from them reads them there, so nothing repeats the joins behind
    # ``lines``, which for the sales of a period go through all lines there are.
    def new_transactions(written: dict[str, DataFrame]) -> DataFrame:
        totals = sale_totals(written["transaction_items"]).select("txn_id", "subtotal", "tax", "total")
        return (headers.drop("verified").join(totals, "txn_id", "left")
                .select(*[c for c in headers.columns if c != "verified"], F.lit(False).alias("verified"),
                        *[F.coalesce(F.col(c), zero).alias(c) for c in ("subtotal", "tax", "total")]))

    def new_log(written: dict[str, DataFrame]) -> DataFrame:
        # names and texts are added after the scan, which moves only what orders and changes the stock
        who = headers.select("txn_id", F.col("transaction_date").alias("log_date"), F.col("transaction_time").alias("log_time"),
                             "receipt_no", F.col("cashier_name").alias("performed_by"))
        sold = written["transaction_items"].select("txn_id", "line_seq", "product_id", "product_name", "quantity").join(who, "txn_id")
        moves = sold.select("product_id", "product_name", "log_date", "log_time", "txn_id", "line_seq", F.lit(0).alias("kind"),
                            (-F.col("quantity")).alias("quantity_change"), "receipt_no", "performed_by")
        names = products.select("product_id", F.col("name").alias("_name"))
        return (stock_ledger(moves, products).join(names, "product_id", "left")
                .select("product_id", F.coalesce("product_name", "_name").alias("product_name"), *order, "kind",
                        F.lit("Sale").alias("movement_type"), "quantity_change",
                        F.concat(F.lit("Sale: "), F.col("receipt_no")).alias("reason"), "performed_by", "stock_after"))

    def new_stock(written: dict[str, DataFrame]) -> DataFrame:
        # the stock log is written once and the new stock is read from it
        last = latest_wins(written["inventory_logs"].select("product_id", *order, "stock_after"), "product_id", order)
        return update_rows(products, last.select("product_id", F.col("stock_after").cast("int").alias("stock")),
                           "product_id", as_of)

    def write(name: str, df: DataFrame, path: str) -> None:
        if name == receipts.TABLE:
            receipts.with_bucket(df).repartition("bucket").write.partitionBy("bucket").parquet(path)
        else:
            df.write.parquet(path)

    tables = {"transaction_items": lines.join(headers.select("txn_id"), "txn_id", "left_semi"),
              "transactions": new_transactions,
              "journal_entries": lambda written: post_sales(written["transactions"], written["transaction_items"]),
              "inventory_logs": new_log, "products": new_stock,
              "rejected_sales": rejected.select("txn_id", "receipt_no", "transaction_date", "rejected")}
    if not headers.isEmpty():      # else nothing to add to the index
        tables[receipts.TABLE] = headers.select("receipt_no", "txn_id")
    return versions.publish(out_dir, version, tables, write, carried, base_at)
