"""Write the derived model once and serve reports from the stored tables.

On a cluster the adapter (``tillbook.sources.adapter``) runs once per data
delivery, not once per report: ``materialize_model`` writes the model tables
to a shared folder (e.g. under ``spark.checkpoint.dir``), and
``load_model`` returns the same dictionary of DataFrames over those files.
Reports then read stored totals instead of re-aggregating lines, and the
layout makes period filters cheap:

- sale headers, sale lines and stock movements are partitioned by month
  (``sale_month`` / ``log_month``).  Lines carry their sale's date (a
  denormalised column), so a period report prunes line partitions directly
  instead of joining lines to headers;
- sales and lines are range-partitioned on (month, sale id) before writing, so write
  tasks are balanced even when one month holds a third of all sales, and
  files are ordered by sale id (tight min/max statistics for id lookups);
- all lines are moved three times: by sale id to be numbered, by product for its columns, and to the part of
  their sale, where they meet it.  Movements of sales are written from the stored lines, unmoved; returns are
  range-partitioned on (month, product).  Movement files are ordered by product;
- a table's shuffle files are deleted when it is written, so disk holds one write's at a time;
- month-end levels (``write_stock_months``): a summary of each product's movements a month, from which the
  stock at any month's start follows without the movements before it;
- changes rewrite only the months they touch (``verify_day``, ``add_movements``);
- every write goes to a folder of its own, published by a manifest written
  last (``versions``); a failed write leaves the previous model in place.

A line without a sale header is stored too, without a date (in the month
partition of nulls); the period reports leave it out and K3 reports it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.operators import changes, inventory
from tillbook.operators.posting import MONEY, with_amounts
from tillbook.plans.session import COMPACT, DROP_SHUFFLES, settings, staged
from tillbook.sources import seeds, versions
from tillbook.sources.adapter import line_columns, moved_lines, movement_columns, numbered_lines, priced_lines

PARTITIONED = {
    "transactions": ("transaction_date", "sale_month", "txn_id"),
    "transaction_items": ("transaction_date", "sale_month", "txn_id"),
    "stock_movements": ("log_date", "log_month", "product_id"),
}
# Headers are stored with their totals (``transactions``); the derived-only
# ``sale_headers`` view is not published, so readers use the stored totals.
PLAIN = ["products", "raw_materials", "product_ingredients"]
# Columns of a sale that its stored lines carry for its movements; ``load_model`` leaves them out.
OF_SALE = ["transaction_time", "receipt_no", "cashier_name"]


def _month(col: str):
    """``yyyy-MM`` of a date column, from its ISO text (a formatter a row costs many times as much)."""
    return F.substring_index(F.col(col).cast("string"), "-", 2)


def _dealt(headers: DataFrame, n: int) -> DataFrame:
    """What lines and movements show of their sale, with ``_part``: the part of ``n`` that its lines are written in, by
    range of (month, sale id)."""
    shown = headers.select("txn_id", "transaction_date", *OF_SALE)
    return shown.repartitionByRange(n, _month("transaction_date"), "txn_id").withColumn("_part", F.spark_partition_id())


def _parts(dealt: DataFrame) -> DataFrame:
    """The parts of each sale id; more than one only where an id repeats (K2)."""
    return dealt.select("txn_id", "_part").repartition("txn_id").dropDuplicates(["txn_id", "_part"])


def _write_lines(lines: DataFrame, dealt: DataFrame, path: str, n: int) -> DataFrame:
    """``priced_lines`` with ``_part``, moved in raw columns to the part of their sale, without a range sample of them; they
    meet the sale there, without another exchange.  Returns the stored lines."""
    part = F.coalesce("_part", F.pmod(F.hash("l_orderkey"), F.lit(n)))
    placed = lines.withColumn("_part", part).repartitionById(n, "_part")
    sales = dealt.withColumnRenamed("txn_id", "l_orderkey").repartitionById(n, "_part")
    rows = (placed.join(sales, ["_part", "l_orderkey"], "left").withColumn("sale_month", _month("transaction_date"))
            .sortWithinPartitions("sale_month", "l_orderkey"))
    stored = line_columns(rows, "transaction_date", *OF_SALE, "sale_month")
    stored.write.options(**COMPACT).partitionBy("sale_month").parquet(path)
    return stored.sparkSession.read.schema(stored.schema).parquet(path)


def _write_movements(lines: DataFrame, path: str, n: int) -> None:
    """The movements of the stored lines.  A sale moves stock in the month that its lines lie in, so its movements are
    written from there, in ``n`` tasks; only returns are moved, in raw columns, by range of (month, product)."""
    raw = lines.select(F.col("txn_id").alias("l_orderkey"), "line_key.*", F.col("return_flag").alias("l_returnflag"),
                       "line_seq", "transaction_date", *OF_SALE)
    sold = moved_lines(raw).filter("kind = 0")
    returned = moved_lines(raw.filter("l_returnflag = 'R'")).filter("kind = 1").drop("transaction_time")
    returned = returned.repartitionByRange(n, _month("log_date"), "l_partkey").withColumn("transaction_time", F.lit(None).cast("string"))
    for moved, mode in ((sold, "error"), (returned, "append")):
        rows = moved.withColumn("log_month", _month("log_date")).sortWithinPartitions("log_month", "l_partkey")
        with settings(lines.sparkSession, {"spark.sql.files.minPartitionNum": str(n)}):
            (movement_columns(rows, "log_month").write.mode(mode).options(**COMPACT).partitionBy("log_month").parquet(path))


def _with_totals(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """``with_sale_totals`` of stored lines: they are summed by sale, not by sale and category first.  A sale id that
    repeats has each line once a header, the first line too."""
    copies, amount = F.count_if(F.col("line_seq") == 1), F.coalesce(F.sum("line_total"), F.lit(0).cast(MONEY))
    sums = lines.groupBy("txn_id").agg(F.when(copies > 1, amount / copies).otherwise(amount).cast(MONEY).alias("subtotal"))
    return with_amounts(headers.join(sums, "txn_id", "left"))


def _write_headers(rows: DataFrame, path: str, n: int) -> None:
    """Headers with totals, moved with their subtotal alone by range of (month, sale id)."""
    placed = rows.drop("tax", "total").repartitionByRange(n, _month("transaction_date"), "txn_id")
    (with_amounts(placed).withColumn("sale_month", _month("transaction_date")).sortWithinPartitions("sale_month", "txn_id")
     .write.options(**COMPACT).partitionBy("sale_month").parquet(path))


def _repeats(products: DataFrame) -> bool:
    """Whether a product id occurs twice (K2): its lines then double before they are numbered."""
    return not products.groupBy("product_id").count().filter("count > 1").isEmpty()


def materialize_model(spark: SparkSession, model: dict[str, DataFrame], out_dir: str,
                      partitions: int | None = None) -> str:
    """Write the model tables to a new folder under ``out_dir`` and publish
    them.  Returns that folder.

    Where the raw lines are given, they are numbered and meet their products and sales once, on the way to the stored
    lines; movements and totals are made from those."""
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    headers = model["sale_headers"]
    # the lines are written first: sale totals come from them, not from another join of all lines with products
    tables = {"transaction_items": model["transaction_items"].join(headers.select("txn_id", "transaction_date"), "txn_id", "left"),
              "transactions": lambda written: _with_totals(headers, written["transaction_items"])}
    tables.update({name: model[name] for name in ["stock_movements", *PLAIN]})

    def write(name: str, df: DataFrame, path: str) -> None:
        if name == "transactions":
            _write_headers(df, path, n)
        elif name not in PARTITIONED:
            df.write.options(**COMPACT).parquet(path)
        else:
            date_col, part_col, order_col = PARTITIONED[name]
            (df.withColumn(part_col, _month(date_col)).repartitionByRange(n, part_col, order_col)
             .sortWithinPartitions(part_col, order_col).write.options(**COMPACT).partitionBy(part_col).parquet(path))

    with settings(spark, DROP_SHUFFLES):
        if "lineitem" not in model or _repeats(model["products"]):
            return versions.publish(out_dir, "model", tables, write)
        with staged(_dealt(headers, n), "dealt-sales") as dealt:
            lines = priced_lines(numbered_lines(model["lineitem"], _parts(dealt)), model["products"])
            stored = {}

            def write_raw(name: str, df: DataFrame, path: str) -> None:
                if name == "transaction_items":
                    stored[name] = _write_lines(lines, dealt, path, n)
                elif name == "stock_movements":
                    _write_movements(stored["transaction_items"], path, n)
                else:
                    write(name, df, path)

            return versions.publish(out_dir, "model", tables, write_raw)


def load_model(spark: SparkSession, model_dir: str) -> dict[str, DataFrame]:
    """The published model as the same dictionary ``adapter.load`` returns."""
    tables = versions.read_published(spark, model_dir, "model")
    tables["transaction_items"] = tables["transaction_items"].drop(*OF_SALE)
    tables["material_movements"] = tables["transaction_items"].select(
        F.col("supp_id").alias("raw_material_id"), F.col("ship_date").alias("log_date"), "txn_id", "line_seq",
        "line_key", (-F.col("quantity")).cast("decimal(12,2)").alias("qty_change"))
    tables.update(seeds.seed_dims(spark))
    return tables


def write_stock_months(spark: SparkSession, model_dir: str) -> None:
    """Store the month summaries of the published movements beside the model."""
    months = inventory.stock_months(load_model(spark, model_dir)["stock_movements"])
    versions.publish(model_dir, "stock_months", {"stock_months": months},
                     lambda _, df, path: df.repartitionByRange("log_month", "product_id").write.partitionBy("log_month").parquet(path))


def load_stock_months(spark: SparkSession, model_dir: str) -> DataFrame:
    return versions.read_published(spark, model_dir, "stock_months")["stock_months"]


def _months(df: DataFrame, col: str) -> list[str]:
    """The months that ``df`` touches: one row each reaches the driver."""
    return sorted(r[0] for r in df.select(_month(col).alias("m")).filter("m is not null").distinct().collect())


def verify_day(spark: SparkSession, model_dir: str, day) -> None:
    """J7 on the stored model: the sales of ``day`` become verified.  One month of headers is read and written."""
    base = versions.published_at(spark, model_dir, "model")
    month = day.strftime("%Y-%m")
    rows = load_model(spark, model_dir)["transactions"].filter(F.col("sale_month") == month)
    versions.replace_partitions(spark, model_dir, "model", {
        "transactions": ("sale_month", [month], changes.mark_verified(rows, day))}, base)


def add_movements(spark: SparkSession, model_dir: str, late: DataFrame) -> None:
    """Movements that arrive after their month was stored (columns as stored, dated): their months are rewritten, and of
    the summaries those of their months.  Later months need nothing: their openings follow from the summaries."""
    base, stored = versions.published_at(spark, model_dir, "model"), load_model(spark, model_dir)["stock_movements"]
    touched = _months(late, "log_date")
    if not touched:
        return
    late = late.withColumn("log_month", _month("log_date"))
    now = stored.filter(F.col("log_month").isin(touched)).unionByName(late.select(*stored.columns))
    versions.replace_partitions(spark, model_dir, "model", {"stock_movements": ("log_month", touched, now)}, base)
    again = load_model(spark, model_dir)["stock_movements"].filter(F.col("log_month").isin(touched))
    versions.replace_partitions(spark, model_dir, "stock_months", {
        "stock_months": ("log_month", touched, inventory.stock_months(again))})
