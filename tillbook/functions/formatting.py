"""Scalar text helpers as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillbook.sources import seeds

TAG = r"<[^>]+>"


def rupiah(c: Column) -> Column:
    """``Rp 1.234.567`` display text (half up to whole units, dot grouping)."""
    return F.concat(F.lit(seeds.CURRENCY_PREFIX), F.translate(F.format_number(F.round(c, 0), 0), ",", "."))


def receipt_code(key: Column) -> Column:
    """H8: short code from a key: upper-case first 8 hex digits of its MD5."""
    return F.upper(F.substring(F.md5(key.cast("string")), 1, 8))


def strip_tags(c: Column) -> Column:
    """Text without markup tags, trimmed."""
    return F.trim(F.regexp_replace(c, TAG, ""))
