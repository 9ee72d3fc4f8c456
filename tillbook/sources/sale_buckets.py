"""Headers and lines stored in buckets of the sale id, so work by sale needs no exchange.

``materialize_sale_buckets`` writes both tables with the same number of hash
buckets, sorted by sale id.  Their join (C1, C2, C13), the aggregate by sale
(D11, I1, I2) and the comparison of header and lines (K5) then run bucket by
bucket: the rows of a sale already lie together, and only what a report groups
by something else (months, accounts) is exchanged, after the aggregate by sale.

A bucket is read by one task, so it must not hold a sale that fills it alone:
sales of more than ``HEAVY_LINES`` lines, and rows without a sale id, lie in
plain tables beside the buckets.  Spark exchanges and pre-aggregates them as
usual.  ``load_sale_buckets`` returns both parts; every operator that treats
each sale by itself runs on the parts one by one (``over_parts``).  Without
heavy sales there is one part and no exchange.

Tables are published by ``versions``.  The buckets are declared as external
tables of the session, in any session that loads them.  Lines are stored with
``line_key`` (their order in the sale) and without ``line_seq``, whose window
would gather a heavy sale in one task.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.plans.session import written
from tillbook.sources import seeds, versions
from tillbook.sources.adapter import with_sale_totals

VERSION = "sale_buckets"
HEAVY_LINES = 1 << 20          # lines of a sale from which it leaves the buckets
ROWS_PER_BUCKET = 1 << 24      # lines that a bucket should hold
KEY = "txn_id"
TABLES = ("sale_headers", "transaction_items")


def _buckets(spark: SparkSession, rows: int, rows_per_bucket: int) -> int:
    """Buckets for ``rows`` lines: as many as their size needs, at least the session's shuffle width, at most what Spark
    allows (a bucket then holds more rows)."""
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(most, max(width, -(-rows // rows_per_bucket))))


def _table(path: str) -> str:
    """The session's name of the table stored at ``path`` (version-uuid/name)."""
    *_, folder, name = path.rstrip("/").split("/")
    return f"{folder.replace('-', '_')}_{name}"


def materialize_sale_buckets(spark: SparkSession, model: dict[str, DataFrame], out_dir: str,
                             heavy_lines: int = HEAVY_LINES, rows_per_bucket: int = ROWS_PER_BUCKET) -> str:
    """Write the headers and lines of ``model`` to a new folder under ``out_dir`` and publish them.  Returns the folder."""
    lines = model["transaction_items"].drop("line_seq")
    headers, products = model["sale_headers"], model["products"]
    # partial aggregate: a heavy sale reaches the shuffle as one row a task
    per_sale = written(lines.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")), "lines-per-sale")
    rows = per_sale.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy = per_sale.filter((F.col("n") > heavy_lines) & F.col(KEY).isNotNull()).select(KEY)
    has_heavy = not heavy.isEmpty()
    n = _buckets(spark, rows, rows_per_bucket)

    def light_part(df: DataFrame) -> DataFrame:
        df = df.filter(F.col(KEY).isNotNull())
        return df.join(heavy, KEY, "left_anti") if has_heavy else df

    def heavy_part(df: DataFrame) -> DataFrame:
        alone = df.filter(F.col(KEY).isNull())
        return alone.unionByName(df.join(heavy, KEY, "left_semi").select(*df.columns)) if has_heavy else alone

    def write(name: str, df: DataFrame, path: str) -> None:
        if name not in TABLES:
            df.write.parquet(path)
            return
        (df.repartition(n, KEY).write.format("parquet").option("path", path).bucketBy(n, KEY).sortBy(KEY)
         .saveAsTable(_table(path)))

    tables = {name: light_part(df) for name, df in (("sale_headers", headers), ("transaction_items", lines))}
    tables["heavy_headers"], tables["heavy_lines"] = heavy_part(headers), heavy_part(lines)
    tables["products"] = products
    tables["layout"] = lambda done: spark.createDataFrame(
        [(n, not (done["heavy_headers"].isEmpty() and done["heavy_lines"].isEmpty()),
          *[json.dumps(done[name].schema.jsonValue()) for name in TABLES])],
        "buckets int, heavy boolean, " + ", ".join(f"{name} string" for name in TABLES))
    return versions.publish(out_dir, VERSION, tables, write)


def _declared(spark: SparkSession, path: str, schema: T.StructType, buckets: int) -> DataFrame:
    """The bucketed table at ``path``, declared in this session where it is not yet known."""
    name = _table(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY}) "
                  f"INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def _part(headers: DataFrame, lines: DataFrame, products: DataFrame, spark: SparkSession) -> dict[str, DataFrame]:
    return {"sale_headers": headers, "transaction_items": lines, "products": products,
            "transactions": with_sale_totals(headers, lines), **seeds.seed_dims(spark)}


def load_sale_buckets(spark: SparkSession, out_dir: str) -> list[dict[str, DataFrame]]:
    """The published sales as one model per part: the buckets and, where there are such rows, the heavy sales."""
    folders = {name: parts[0]["path"] for name, parts in versions.latest(spark, out_dir, VERSION)["tables"].items()}
    layout = spark.read.parquet(folders["layout"]).first()
    products = spark.read.parquet(folders["products"])
    schemas = [T.StructType.fromJson(json.loads(layout[name])) for name in TABLES]
    light = [_declared(spark, folders[name], schema, layout["buckets"]) for name, schema in zip(TABLES, schemas)]
    parts = [_part(*light, products, spark)]
    if layout["heavy"]:
        heavy = [spark.read.schema(schema).parquet(folders[name])
                 for name, schema in zip(("heavy_headers", "heavy_lines"), schemas)]
        parts.append(_part(*heavy, products, spark))
    return parts


def over_parts(parts: list[dict[str, DataFrame]], by_sale: Callable[[dict[str, DataFrame]], DataFrame]) -> DataFrame:
    """``by_sale``, an operator that treats each sale by itself, on every part; the rows of all parts."""
    return reduce(DataFrame.unionByName, [by_sale(part) for part in parts])


def forget(spark: SparkSession, out_dir: str) -> None:
    """Drop the session's declarations of the published buckets; the stored files stay."""
    for name, parts in versions.latest(spark, out_dir, VERSION)["tables"].items():
        if name in TABLES:
            spark.sql(f"DROP TABLE IF EXISTS {_table(parts[0]['path'])}")
