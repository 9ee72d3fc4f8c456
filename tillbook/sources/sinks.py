"""Report export and append-only outputs.

All writers are distributed Spark writers (one file per task); nothing is
gathered on the driver.  Paths must be shared storage on a cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.functions.formatting import strip_tags


def clean_text(df: DataFrame) -> DataFrame:
    """Strip markup tags and surrounding blanks from text columns."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = strip_tags(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV report with a header row; text is tag-stripped and trimmed and
    every field is quoted with inner quotes doubled (RFC 4180).  The UTF-8
    byte-order mark of the browser export is not written (it would need a
    driver-side rewrite of the first file)."""
    (clean_text(df).write.mode(mode)
     .option("header", True).option("quoteAll", True).option("quote", '"').option("escape", '"')
     .option("encoding", "UTF-8").csv(path))


def export_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Nested results (structs, arrays) as JSON lines."""
    df.write.mode(mode).json(path)


def append(df: DataFrame, path: str, date_col: str | None = None) -> None:
    """Append posted rows, partitioned by month of ``date_col`` so period
    reports prune whole folders."""
    out = df
    if date_col:
        out = df.withColumn("entry_month", F.date_format(F.col(date_col), "yyyy-MM"))
        out.write.mode("append").partitionBy("entry_month").parquet(path)
    else:
        out.write.mode("append").parquet(path)
