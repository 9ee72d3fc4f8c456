"""L1: post arriving sales to the journal with Structured Streaming.

Sales arrive as one nested record per sale (header + ``items`` array), the
way a point-of-sale terminal submits them.  Delivery is at-least-once, so a
receipt may arrive twice: ``dropDuplicatesWithinWatermark('receipt_no')``
posts it once while keeping only a bounded horizon of receipt keys in state.
Posting is then a *per-row* computation with higher-order functions
(``aggregate``, ``filter``, ``array_distinct``, ``transform``) over the sale's
own items, so no stateful aggregate is needed, and every sale becomes its
journal lines with a single ``explode``.  Results equal the batch posting
(``tillbook.operators.posting.post_sales``) line for line.

Watermark: on *arrival* time (the modification time of the uploaded file,
from the file source's ``_metadata`` column), not on the sale's own time.
Deduplication state then stays bounded by the replay horizon, and a sale that
is uploaded days after it was rung up is still posted: only a re-delivery
that arrives later than the horizon after the first copy escapes
deduplication here (the K2 duplicate-key check reports it).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.operators.posting import explode_journal, journal_line_array, sale_amounts
from tillbook.plans.session import scratch_dir

ITEM_TYPE = T.StructType([
    T.StructField("line_seq", T.IntegerType()), T.StructField("product_id", T.LongType()),
    T.StructField("category", T.StringType()), T.StructField("quantity", T.IntegerType()),
    T.StructField("unit_price", T.DecimalType(12, 2)), T.StructField("unit_cost", T.DecimalType(12, 2)),
    T.StructField("line_total", T.DecimalType(14, 2)),
])
SALE_SCHEMA = T.StructType([
    T.StructField("txn_id", T.LongType()), T.StructField("receipt_no", T.StringType()),
    T.StructField("transaction_date", T.DateType()), T.StructField("transaction_time", T.StringType()),
    T.StructField("cashier_name", T.StringType()), T.StructField("payment_method", T.StringType()),
    T.StructField("items", T.ArrayType(ITEM_TYPE)),
])


def nested_sales(transactions: DataFrame, items: DataFrame) -> DataFrame:
    """One record per sale with its ordered ``items`` ([] when none) - the
    shape a terminal submits.  Lines are gathered per sale only."""
    fields = [f.name for f in ITEM_TYPE.fields]
    per = (items.groupBy("txn_id")
           .agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).cast(ITEM_TYPE[c].dataType).alias(c) for c in fields])))
                .alias("items")))
    hdr = transactions.select("txn_id", "receipt_no", "transaction_date", "transaction_time", "cashier_name",
                              "payment_method")
    j = hdr.join(per, "txn_id", "left")
    return j.select(*[F.col(c) for c in hdr.columns],
                    F.coalesce(F.col("items"), F.array().cast(T.ArrayType(ITEM_TYPE))).alias("items"))


def post_sale_rows(sales: DataFrame) -> DataFrame:
    """Per-row posting of nested sales (works on batch and streaming frames)."""
    a = sale_amounts(F.col("items"))
    lines = journal_line_array(F.col("receipt_no"), F.col("payment_method"), a["total"], a["tax"], a["cogs"], a["cats"])
    return explode_journal(sales, "transaction_date", lines)


def with_arrival_time(df: DataFrame) -> DataFrame:
    """Arrival time of each record: the modification time of its file."""
    return df.withColumn("arrived_at", F.col("_metadata.file_modification_time"))


def start_posting_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                         horizon: str = "7 days", available_now: bool = True):
    """Start the posting stream: files of nested sales in ``source_dir`` ->
    journal lines appended as Parquet under ``sink_dir``.  The checkpoint
    (offsets, dedup state) lives in ``checkpoint_dir`` on shared storage, so a
    restarted or relocated driver resumes exactly where it stopped."""
    stream = (spark.readStream.schema(SALE_SCHEMA).parquet(source_dir))
    deduped = (with_arrival_time(stream).withWatermark("arrived_at", horizon)
               .dropDuplicatesWithinWatermark(["receipt_no"]))
    writer = (post_sale_rows(deduped).writeStream.format("parquet")
              .option("path", sink_dir).option("checkpointLocation", checkpoint_dir).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def deliver(sales: DataFrame, source_dir: str) -> None:
    """Upload nested sales: new files in ``source_dir``."""
    sales.write.mode("append").parquet(source_dir)


def delivered(spark: SparkSession, source_dir: str) -> DataFrame:
    """The sales uploaded so far (later files are not among them): delivering them again copies them, and nests no line anew."""
    return spark.read.schema(SALE_SCHEMA).parquet(source_dir)


def replay_and_post(spark: SparkSession, transactions: DataFrame, items: DataFrame, copies: int = 2) -> DataFrame:
    """Stage the sales as terminal uploads (``copies`` deliveries of each, as
    an at-least-once replay would produce), run the posting stream to the end
    of the available input, and return the posted journal lines."""
    base = scratch_dir(spark, f"sales-stream-{uuid.uuid4().hex}")
    src, sink, ckpt = f"{base}/incoming", f"{base}/journal", f"{base}/_checkpoint"
    deliver(nested_sales(transactions, items), src)
    again = delivered(spark, src)
    for _ in range(copies - 1):
        deliver(again, src)
    q = start_posting_stream(spark, src, sink, ckpt)
    q.awaitTermination()
    if q.exception() is not None:  # pragma: no cover - surfaced to the caller
        raise RuntimeError(str(q.exception()))
    return spark.read.parquet(sink)
