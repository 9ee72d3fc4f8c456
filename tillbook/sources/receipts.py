"""An index of the receipts recorded so far, which keeps a receipt from being recorded twice.

Receipts lie in folders by hash bucket.  A batch reads the folders of its own
buckets only, and each batch adds a folder of its own to the published list
(``versions``): nothing stored is rewritten.  Receipts of a bucket are never
gathered in one task; batch and index meet in a join by receipt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.sources import versions

TABLE = "receipts"
BUCKETS = 1024             # folders of the index


def with_bucket(receipts: DataFrame) -> DataFrame:
    return receipts.withColumn("bucket", F.pmod(F.xxhash64("receipt_no"), F.lit(BUCKETS)).cast("int"))


def known(spark: SparkSession, parts: list[dict], receipts: DataFrame) -> DataFrame | None:
    """Those of ``receipts`` (receipt_no) that the index folders ``parts`` hold; None without an index.  At most
    ``BUCKETS`` numbers reach the driver, to name the folders to read."""
    if not parts:
        return None
    asked = with_bucket(receipts.select("receipt_no").filter("receipt_no is not null"))
    buckets = sorted(r[0] for r in asked.select("bucket").distinct().collect())
    stored = versions.read_parts(spark, parts).filter(F.col("bucket").isin(buckets)).select("receipt_no")
    return asked.select("receipt_no").join(stored, "receipt_no", "left_semi").distinct()


def first_of_batch(headers: DataFrame) -> DataFrame:
    """One sale a receipt: the first by date, time and id (an aggregate with partial results, no window)."""
    first = F.min(F.struct("transaction_date", "transaction_time", "txn_id"))
    return headers.filter("receipt_no is not null").groupBy("receipt_no").agg(first.alias("_f")).select(
        "receipt_no", F.col("_f.txn_id").alias("txn_id"))


def judge(spark: SparkSession, parts: list[dict], headers: DataFrame) -> DataFrame:
    """``headers`` with ``rejected``: null for a sale to record, else why not: its receipt is missing, was recorded
    before, or belongs to an earlier sale of the batch."""
    first = first_of_batch(headers).select("receipt_no", F.col("txn_id").alias("_first"))
    judged = headers.join(first, "receipt_no", "left")
    before = known(spark, parts, headers)
    judged = (judged.withColumn("_known", F.lit(False)) if before is None else
              judged.join(before.withColumn("_known", F.lit(True)), "receipt_no", "left"))
    why = (F.when(F.col("receipt_no").isNull(), "receipt missing").when(F.col("_known"), "receipt recorded before")
           .when(F.col("_first") != F.col("txn_id"), "receipt of an earlier sale of the batch"))
    return judged.select(*headers.columns, why.alias("rejected"))
