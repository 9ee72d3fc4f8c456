"""Lists of names in numbered parts of bounded size.

A material used by very many products, or a long low-stock alert, has no
single row to hold its names.  ``numbered_parts`` cuts each key's sorted names
into parts of at most ``size``; the parts in order, joined, are the whole list.

The place of a name in its key comes from range partitions, not from a window
over the key: rows are dealt by (key, order) into runs of bounded size, each
run counts its rows by key, and a running sum over a key's runs (at most one
row a run) gives the place where the run goes on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillbook.operators.inventory import ingredient_product_names, low_stock, low_stock_materials
from tillbook.plans.session import written

PART_SIZE = 1000           # names a part
RUN_ROWS = 1 << 20         # rows a run of the sorted pairs


def numbered_parts(rows: DataFrame, key: str, order: list[str], size: int = PART_SIZE, run_rows: int = RUN_ROWS) -> DataFrame:
    """(key, part_no from 1, n_names, names): the ``order[0]`` values of each key in the order of ``order``, ``size`` a part.
    Rows equal in key and order are each kept; null names come first, as null elements; a null key is a key."""
    spark = rows.sparkSession
    pairs = written(rows.select(key, *order), "name-pairs")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pairs.count() // run_rows))
    # written: the runs stay as they are, whatever task reads them again
    dealt = written(pairs.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, key, *order, "_tie")
                    .withColumn("_run", F.spark_partition_id()), "name-runs")
    before = F.sum("n").over(Window.partitionBy(key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1))
    starts = dealt.groupBy(key, "_run").agg(F.count(F.lit(1)).alias("n")).select(
        F.col(key).alias("_key"), F.col("_run").alias("_at"), F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_run", key).orderBy(*order, "_tie"))
    placed = dealt.withColumn("_place", place).join(
        starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_run") == F.col("_at")))
    rank = F.col("_start") + F.col("_place") - 1
    # at most ``size`` elements; a null name is wrapped, as a list would drop it
    gathered = F.array_sort(F.collect_list(F.struct(rank.alias("rank"), F.col(order[0]).alias("name"))))
    return (placed.groupBy(key, (F.floor(rank / size) + 1).cast("bigint").alias("part_no"))
            .agg(F.count(F.lit(1)).alias("n_names"), gathered.alias("_names"))
            .select(key, "part_no", "n_names", F.transform("_names", lambda x: x["name"]).alias("names")))


def ingredient_name_lists(recipes: DataFrame, products: DataFrame, size: int = PART_SIZE) -> DataFrame:
    """The distinct names of the active products that use a material, in parts."""
    return numbered_parts(ingredient_product_names(recipes, products), "raw_material_id", ["product_name"], size)


def low_stock_names(products: DataFrame, materials: DataFrame, size: int = PART_SIZE) -> DataFrame:
    """The names in the low-stock alert, products and materials, in parts by name and id."""
    a = low_stock(products).select(F.lit("products").alias("kind"), "name", F.col("product_id").alias("id"))
    b = low_stock_materials(materials).select(F.lit("materials").alias("kind"), "name", "id")
    return numbered_parts(a.unionByName(b), "kind", ["name", "id"], size)
