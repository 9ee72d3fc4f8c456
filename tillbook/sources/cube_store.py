"""The daily sales cube as a stored table with deltas.

The cube is written once, in month folders.  A batch of late sales, or of
deleted ones, adds a folder with its own small cube (subtracted for deleted
sales) and reads nothing stored; reports sum whatever folders there are.  Each
batch has a name, and a batch that was applied before changes nothing.
``compact`` merges the folders into one.  Publishing is ``versions``'.

A corrected sale is its old version removed and its new one added.  The cube
holds at most days x methods x (categories + 1) rows a folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.operators import cube
from tillbook.sources import versions

VERSION = TABLE = "daily_cube"
MONTH = "cube_month"
SCHEMA = "sale_date date, payment_method string, level string, category string, " + ", ".join(
    f"{c} {kind}" for c, kind in cube.FIGURES.items()) + f", {MONTH} string"


def _write(df: DataFrame, path: str) -> None:
    month = F.date_format("sale_date", "yyyy-MM")
    df.withColumn(MONTH, month).repartitionByRange(MONTH).write.partitionBy(MONTH).parquet(path)


def write_cube(spark: SparkSession, headers: DataFrame, lines: DataFrame, out_dir: str) -> None:
    """Store the cube of all sales in ``headers``."""
    versions.publish(out_dir, VERSION, {TABLE: cube.daily_cube(headers, lines)}, lambda _, df, path: _write(df, path))


def read_cube(spark: SparkSession, out_dir: str) -> DataFrame:
    """All cube rows, deltas included (several rows a group; every report sums them)."""
    return versions.read_parts(spark, versions.latest(spark, out_dir, VERSION)["tables"][TABLE], SCHEMA)


def add_sales(spark: SparkSession, out_dir: str, batch: str, headers: DataFrame, lines: DataFrame) -> bool:
    """Late sales: their cube is added.  False if ``batch`` was applied before."""
    return versions.add_folder(spark, out_dir, VERSION, TABLE, lambda path: _write(cube.daily_cube(headers, lines), path), batch)


def remove_sales(spark: SparkSession, out_dir: str, batch: str, headers: DataFrame, lines: DataFrame) -> bool:
    """Deleted sales, as they were recorded: their cube is subtracted.  False if ``batch`` was applied before."""
    return versions.add_folder(spark, out_dir, VERSION, TABLE,
                               lambda path: _write(cube.negated(cube.daily_cube(headers, lines)), path), batch)


def compact(spark: SparkSession, out_dir: str) -> None:
    """One folder with the merged rows in place of the cube and its deltas; names of applied batches are kept."""
    base = versions.published_at(spark, out_dir, VERSION)
    rows = cube.summed(read_cube(spark, out_dir))
    versions.merge_folders(spark, out_dir, VERSION, TABLE, lambda path: _write(rows, path), base)
