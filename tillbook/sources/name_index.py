"""B4 by index: postings of three-character grams of product names.

Every place of a name (lower case) starts a gram; two end marks pad it, so a
text of one or two characters is the beginning of some gram as well.  Postings
are stored sorted by (gram, product): a search pushes its grams down to the
files whose statistics cover them, counts how many of them each product has,
and verifies the products that have all by ``contains``.  A gram that very many
names share is spread over several files and summed before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.operators.inventory import search_products
from tillbook.sources import versions

VERSION = TABLE = "name_grams"
SIZE = 3
END = "\u0000"


def postings(products: DataFrame) -> DataFrame:
    """(gram, product_id), each pair once; a null name has none."""
    text = F.concat(F.lower("name"), F.lit(END * (SIZE - 1)))
    starts = F.sequence(F.lit(1), F.length("name_text") - (SIZE - 1))
    grams = F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("name_text"), i, F.lit(SIZE))))
    return (products.filter(F.length("name") > 0).select("product_id", text.alias("name_text"))
            .select(F.explode(grams).alias("gram"), "product_id"))


def write_name_index(spark: SparkSession, products: DataFrame, out_dir: str) -> None:
    versions.publish(out_dir, VERSION, {TABLE: postings(products)}, lambda _, df, path: df.repartitionByRange(
        "gram", "product_id").sortWithinPartitions("gram", "product_id").write.parquet(path))


def candidates(index: DataFrame, q: str) -> DataFrame:
    """Products whose name holds every gram of ``q`` (product_id)."""
    q = q.lower()
    if len(q) < SIZE:
        return index.filter(F.col("gram").startswith(q)).select("product_id").distinct()
    grams = sorted({q[i:i + SIZE] for i in range(len(q) - SIZE + 1)})
    return (index.filter(F.col("gram").isin(grams)).groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") == len(grams)).select("product_id"))


def search(spark: SparkSession, out_dir: str, products: DataFrame, category: str | None, q: str | None) -> DataFrame:
    """``search_products`` through the index; without a text there is nothing to look up."""
    if q:
        index = versions.read_parts(spark, versions.latest(spark, out_dir, VERSION)["tables"][TABLE], "gram string, product_id bigint")
        products = products.join(candidates(index, q), "product_id", "left_semi")
    return search_products(products, category, q)
