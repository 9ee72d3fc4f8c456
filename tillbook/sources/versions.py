"""Versioned sets of tables, published as a whole.

Every write goes to a folder of its own, so nothing that readers use is ever
overwritten.  A version becomes visible by one small manifest file, appended
after all its tables are written; readers follow the manifest with the latest
publishing time through Spark, so any store that Spark reads will do.

A table is a list of folders, each without some values of its partition
column.  ``replace_partitions`` writes the new rows of the touched partitions
to a folder of their own and hides those partitions in the older folders, so a
change costs what it touches and all other files are referred to as they are.

One writer at a time: a writer that another one overtook since it read its
base is refused (``StaleBase``), but the check and the manifest's append are
two steps, so two writers must not publish in the same instant.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "version string, at long, paths string"


def publish(out_dir: str, version: str, tables: dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]],
            write: Callable[[str, DataFrame, str], None] | None = None, carried: dict[str, list[dict]] | None = None,
            base_at: int | None = None) -> str:
    """Write ``tables`` in order to a new folder under ``out_dir`` and publish
    them as ``version``.  A callable gets the tables written so far (read back)
    and returns its own.  ``write(name, df, path)`` replaces the plain Parquet
    write.  ``carried`` names folders of earlier versions that a table goes on
    holding.  ``base_at``: when the version was published that the tables were
    made from (0: none); a later one is ``StaleBase``.  Returns the folder."""
    base = f"{out_dir.rstrip('/')}/{version}-{uuid.uuid4().hex}"
    written: dict[str, DataFrame] = {}
    spark = None
    for name, table in tables.items():
        df = table(written) if callable(table) else table
        spark = df.sparkSession
        if write:
            write(name, df, f"{base}/{name}")
        else:
            df.write.parquet(f"{base}/{name}")
        written[name] = spark.read.schema(df.schema).parquet(f"{base}/{name}")     # a table without rows may have no file
    if base_at is not None and (latest(spark, out_dir) or {"at": 0})["at"] != base_at:
        raise StaleBase(f"{out_dir} was published again")
    kept = {name: list(parts) for name, parts in (carried or {}).items() if parts}
    for name in tables:
        kept[name] = [*kept.get(name, []), {"path": f"{base}/{name}"}]
    _announce(spark, out_dir, version, kept)
    return base


def _announce(spark: SparkSession, out_dir: str, version: str, tables: dict[str, list[dict]]) -> None:
    row = spark.createDataFrame([(version, time.time_ns(), json.dumps(tables))], MANIFEST)
    row.coalesce(1).write.mode("append").json(f"{out_dir.rstrip('/')}/_manifest")


class StaleBase(ValueError):
    """Another version was published since the base was read."""


def latest(spark: SparkSession, out_dir: str, version: str | None = None) -> dict | None:
    """The last publication in ``out_dir`` (of ``version``): ``at`` and ``tables`` (folders by table); None before the
    first of all."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out_dir.rstrip('/')}/_manifest")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    last = _last(spark, out_dir, version)
    return {"at": last["at"], "tables": json.loads(last["paths"])}


def _last(spark: SparkSession, out_dir: str, version: str | None) -> Row:
    rows = spark.read.schema(MANIFEST).json(f"{out_dir.rstrip('/')}/_manifest")
    if version is not None:
        rows = rows.filter(F.col("version") == version)
    last = rows.orderBy(F.col("at").desc()).limit(1).first()
    if last is None:
        raise ValueError(f"nothing published in {out_dir}")
    return last


def is_published(spark: SparkSession, out_dir: str, version: str) -> bool:
    rows = spark.read.schema(MANIFEST).json(f"{out_dir.rstrip('/')}/_manifest")
    return not rows.filter(F.col("version") == version).isEmpty()


def published_at(spark: SparkSession, out_dir: str, version: str | None = None) -> int:
    """When the latest version was published: what a writer passes as its base."""
    return _last(spark, out_dir, version)["at"]


def replace_partitions(spark: SparkSession, out_dir: str, version: str, changes: dict[str, tuple[str, list, DataFrame]],
                       base: int | None = None) -> None:
    """Publish ``version`` anew with some partitions replaced: ``changes`` names (partition column, its values, all rows
    that have them now) by table.  Only those rows are written; every other folder stays as it is.  ``base`` is the
    ``published_at`` of what the rows were made from."""
    last = _last(spark, out_dir, version)
    if base is not None and last["at"] != base:
        raise StaleBase(f"{version} in {out_dir} was published again")
    tables = json.loads(last["paths"])
    for name, (column, values, df) in changes.items():
        path = f"{out_dir.rstrip('/')}/{version}-{uuid.uuid4().hex}/{name}"
        df.repartitionByRange(column, *[c for c in df.columns if c != column][:1]).write.partitionBy(column).parquet(path)
        for part in tables[name]:
            part["column"], part["without"] = column, sorted({*part.get("without", []), *values})
        tables[name].append({"path": path})
    if base is not None and published_at(spark, out_dir, version) != base:
        raise StaleBase(f"{version} in {out_dir} was published again")
    _announce(spark, out_dir, version, tables)


def marks(parts: list[dict]) -> set[str]:
    """The names of the batches that a table's folders hold."""
    return {mark for part in parts for mark in part.get("marks", [])}


def add_folder(spark: SparkSession, out_dir: str, version: str, name: str, write: Callable[[str], None], mark: str) -> bool:
    """Publish ``version`` anew with one more folder of table ``name``, which ``write(path)`` writes and which stands for
    the batch ``mark``.  A batch that the table holds already changes nothing and returns False."""
    last = _last(spark, out_dir, version)
    tables = json.loads(last["paths"])
    if mark in marks(tables[name]):
        return False
    path = f"{out_dir.rstrip('/')}/{version}-{uuid.uuid4().hex}/{name}"
    write(path)
    tables[name].append({"path": path, "marks": [mark]})
    _announce_after(spark, out_dir, version, tables, last["at"])
    return True


def merge_folders(spark: SparkSession, out_dir: str, version: str, name: str, write: Callable[[str], None], base: int) -> None:
    """Publish ``version`` anew with one folder, written by ``write(path)`` from the version published at ``base``, in place
    of all folders of table ``name``; it holds their batches."""
    tables = json.loads(_last(spark, out_dir, version)["paths"])
    path = f"{out_dir.rstrip('/')}/{version}-{uuid.uuid4().hex}/{name}"
    write(path)
    tables[name] = [{"path": path, "marks": sorted(marks(tables[name]))}]
    _announce_after(spark, out_dir, version, tables, base)


def _announce_after(spark: SparkSession, out_dir: str, version: str, tables: dict[str, list[dict]], base: int) -> None:
    if published_at(spark, out_dir, version) != base:
        raise StaleBase(f"{version} in {out_dir} was published again")
    _announce(spark, out_dir, version, tables)


def read_parts(spark: SparkSession, parts: list[dict], schema: StructType | str | None = None) -> DataFrame:
    """The rows of a table's folders, without the partitions that later folders replaced.  ``schema`` is needed where the
    first folder may hold no rows."""
    schema = schema or spark.read.parquet(parts[0]["path"]).schema
    found = []
    for part in parts:
        df = spark.read.schema(schema).parquet(part["path"])
        if part.get("without"):
            column = F.col(part["column"])
            df = df.filter(column.isNull() | ~column.isin(part["without"]))
        found.append(df)
    return reduce(DataFrame.unionByName, found)


def read_published(spark: SparkSession, out_dir: str, version: str | None = None) -> dict[str, DataFrame]:
    """The tables of the latest published version, or of the latest
    publication of ``version``.  Only manifest rows reach the driver."""
    return {name: read_parts(spark, parts) for name, parts in json.loads(_last(spark, out_dir, version)["paths"]).items()}
