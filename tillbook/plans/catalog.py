"""Registry of named queries: each is a Spark plan over the driver's tables and,
where SQL can say the same thing, the equivalent DuckDB SQL.

Every query reads the whole model derived from the given Parquet tables;
parameters (period, day) are business arguments, not row subsets.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.sources.adapter import load

# Business parameters of the registered queries (see FIXTURES.md section 2).
MONTH, YEAR = 3, 1997          # one month
YEAR_ONLY = 1998               # one year
EMPTY_YEAR = 2010              # a period without rows
AS_OF = dt.date(1997, 3, 15)   # "today"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def present(df: DataFrame) -> DataFrame:
    """Cross-engine presentation: decimals -> double (after exact decimal
    arithmetic), dates -> ISO text, small integers -> bigint."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None):
    """Register ``fn(model, spark) -> DataFrame`` under ``name``."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(load(spark, sf_dir), spark))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _register_all():
    # importing the modules registers their queries
    from tillbook.plans import (q_ledger, q_reports, q_inventory, q_listings,  # noqa: F401
                                q_changes, q_quality, q_stream, q_sinks, q_stored, q_cube)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _register_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _register_all()
    return dict(ORACLE)
