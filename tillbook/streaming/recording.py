"""L1 with everything a sale changes: arriving sales are recorded batch by batch.

Each micro-batch of nested sales becomes one published version (``versions``):
headers with totals, lines, journal, stock log, new product stock, receipt
index and rejected sales appear together or not at all.  Three things keep a
sale from counting twice:

- copies of a sale within a batch are reduced to one before anything else;
- a receipt that any earlier batch recorded is rejected by a join with the
  index of recorded receipts, however late it comes back: there is no horizon
  and no state that grows in the stream; a batch without any new receipt is
  rejected from its receipts and headers alone;
- a batch is published under the stream's own id and its number.  If the
  driver is lost after publishing and before the checkpoint notes it, the
  batch runs again and finds its version there.

A batch that fails before publishing leaves folders that nothing refers to.
Stock is floored in the order of batches and, within one, of date, time and
id.  A sale id belongs to one receipt (K2 reports others).  One stream writes
to a folder at a time.  The published list names a folder a batch and table,
so a folder of sales should be closed and a new one opened from its products
before batches number many thousands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.operators import changes
from tillbook.plans.session import staged
from tillbook.sources import receipts, versions
from tillbook.streaming.sales_stream import SALE_SCHEMA

# Tables that go on holding the rows of earlier batches; products are replaced by each batch.
CARRIED = ("transactions", "transaction_items", "journal_entries", "inventory_logs", "rejected_sales")


def one_copy(sales: DataFrame) -> DataFrame:
    """One record of each (receipt, sale id): copies may differ, the smallest record by value counts."""
    rest = [c for c in sales.columns if c not in ("receipt_no", "txn_id")]
    return (sales.groupBy("receipt_no", "txn_id").agg(F.min(F.struct(*rest)).alias("_s"))
            .select("receipt_no", "txn_id", "_s.*").select(*sales.columns))


def sale_lines_of(sales: DataFrame) -> DataFrame:
    """The lines of nested sales; their product's name is joined when they are recorded."""
    return (sales.select("txn_id", F.explode("items").alias("i")).select("txn_id", "i.*")
            .filter("line_seq is not null").withColumn("product_name", F.lit(None).cast("string")))


def record_batch(sales: DataFrame, out_dir: str, version: str) -> bool:
    """Record a batch of nested sales as ``version`` on top of what ``out_dir`` holds; False if that version is there."""
    spark = sales.sparkSession
    if versions.is_published(spark, out_dir, version):
        return False
    last = versions.latest(spark, out_dir)["tables"]
    new = _has_new_receipts(sales, last.get(receipts.TABLE, []))
    # no line of a batch without a new receipt is recorded: its sales are listed as rejected, and their lines stay unread
    with staged(one_copy(sales if new else sales.drop("items")), "arrived-sales") as arrived:
        as_of = arrived.agg(F.coalesce(F.max("transaction_date"), F.current_date())).first()[0]
        lines = sale_lines_of(arrived if new else sales.filter(F.lit(False)))
        changes.record_sales(arrived.drop("items"), lines, versions.read_parts(spark, last["products"]), out_dir, version, as_of, CARRIED)
    return True


def _has_new_receipts(sales: DataFrame, index: list[dict]) -> bool:
    """Whether a sale of the batch has a receipt that the index of recorded ones lacks."""
    given = sales.select("receipt_no").filter("receipt_no is not null")
    known = receipts.known(sales.sparkSession, index, given)
    return known is None or not given.join(known, "receipt_no", "left_anti").isEmpty()


def _stream_id(spark: SparkSession, checkpoint_dir: str) -> str:
    """The id that a stream's checkpoint holds: a new checkpoint is a new stream with batch numbers of its own."""
    return spark.read.schema("id string").json(f"{checkpoint_dir.rstrip('/')}/metadata").first()["id"]


def start_recording_stream(spark: SparkSession, source_dir: str, out_dir: str, checkpoint_dir: str,
                           products: DataFrame, available_now: bool = True):
    """Record the nested sales that arrive as files in ``source_dir``.  ``products`` opens an empty ``out_dir``; later the
    published products count.  ``out_dir`` and ``checkpoint_dir`` lie on shared storage."""
    if versions.latest(spark, out_dir) is None:
        versions.publish(out_dir, "opening", {"products": products})

    def record(batch: DataFrame, number: int) -> None:
        record_batch(batch, out_dir, f"{_stream_id(batch.sparkSession, checkpoint_dir)}-{number}")

    writer = (spark.readStream.schema(SALE_SCHEMA).parquet(source_dir).writeStream.foreachBatch(record)
              .option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
