"""Listings and nested results.

Nested ``items`` arrays are built only for the sales a listing returns: the
page of headers is chosen first (a top-k ``TakeOrderedAndProject``), the raw
lines are semi-joined to those sales, gathered once per sale, and totals,
margins and journal lines are computed per row from the gathered lines.  The
listing's order is restored last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbook.functions.periods import in_period, on_date
from tillbook.operators.posting import SUM_TYPE, journal_line_array, sale_amounts, sale_totals
from tillbook.sources.adapter import headers_for, period_headers, sale_lines

MONEY = "decimal(24,2)"  # width of sum(decimal(14,2)); totals of 100 TB fit

ITEM_FIELDS = ["line_seq", "product_id", "product_name", "quantity", "unit_price", "unit_cost", "category",
               "line_total"]


def newest_first(df: DataFrame) -> list[Column]:
    return [F.col("transaction_date").desc(), F.col("transaction_time").desc(), F.col("txn_id").asc()]


def transactions_query(t: dict[str, DataFrame], date=None, month=None, year=None) -> DataFrame:
    """Headers filtered by exact date and/or period (AND)."""
    df = t.get("sale_headers", t["transactions"])
    if date is not None:
        df = on_date(df, "transaction_date", date)
    return in_period(df, "transaction_date", month, year)


def gather_lines(lines: DataFrame, fields: list[str]) -> DataFrame:
    """(txn_id, items): the lines of each sale in line order."""
    elem = F.struct(*[F.col(c) for c in fields])
    return lines.groupBy("txn_id").agg(F.array_sort(F.collect_list(elem)).alias("items"))


def nest_items(headers: DataFrame, lines: DataFrame, empty_as_null_element: bool = True,
               fields: list[str] = ITEM_FIELDS) -> DataFrame:
    """``items`` array per header ordered by line.

    ``empty_as_null_element`` reproduces the aggregate over a left join: a
    sale without lines gets one element whose fields are all null (D12);
    otherwise it gets ``[]`` (D13, aggregate with a FILTER)."""
    per = gather_lines(lines, fields)
    kind = per.schema["items"].dataType.simpleString()
    none = F.array(F.struct(*[F.lit(None).alias(c) for c in fields])) if empty_as_null_element else F.array()
    return (headers.join(per, "txn_id", "left")
            .withColumn("items", F.coalesce("items", none.cast(kind))))


def with_line_amounts(sales: DataFrame) -> DataFrame:
    """Nested sales with subtotal, VAT and total computed from their items
    (I1), where the totals are not stored."""
    if "total" in sales.columns:
        return sales
    amounts = sale_amounts(F.col("items"))
    return sales.select("*", *[amounts[c].alias(c) for c in ("subtotal", "tax", "total")])


def transactions_page(t, date=None, month=None, year=None, limit: int = 500, offset: int = 0) -> DataFrame:
    """Newest-first page of sales with their nested lines; ``row_no``
    numbers the whole listing from 1.

    The page is chosen on header columns (a top-k over the period's headers);
    only its sales' raw lines are joined and gathered, and the totals come
    from the gathered lines, so nothing is done for sales off the page."""
    src = transactions_query(t, date, month, year)
    ordered = src.orderBy(*newest_first(src))
    page = ordered.offset(offset).limit(limit) if offset else ordered.limit(limit)
    return _numbered_page(t, page, offset)


def _numbered_page(t, page: DataFrame, offset: int) -> DataFrame:
    nested = with_line_amounts(nest_items(page, sale_lines(t, page), empty_as_null_element=True))
    # the page holds at most ``limit`` rows
    return (nested.withColumn("row_no", F.row_number().over(Window.orderBy(*newest_first(nested))) + F.lit(offset))
            .orderBy("row_no"))


def _span(counts: list[tuple], offset: int, limit: int) -> tuple[list, int]:
    """Which groups of an ordered list of (group, rows) hold rows ``offset`` to ``offset + limit``, and where in the first
    of them the rows begin."""
    start, found, skipped = 0, [], 0
    for group, n in counts:
        if start + n <= offset:
            skipped = start + n
        elif start < offset + limit:
            found.append(group)
        start += n
    return found, offset - skipped


def _newest(counts: DataFrame) -> list[tuple]:
    """(group, rows), newest first, null last, as ``newest_first`` orders them."""
    return sorted(((r[0], r[1]) for r in counts.collect()), key=lambda r: (r[0] is not None, r[0] or r[1]), reverse=True)


def _among(col: str, values: list):
    some = F.col(col).isin([v for v in values if v is not None])
    return some | F.col(col).isNull() if None in values else some


def seek_page(t, limit: int = 500, offset: int = 0, month=None, year=None) -> DataFrame:
    """F1 on the stored model: any page of the newest-first listing, however
    deep, from the days that hold it.

    Sales are counted by month (from the files' row counts, no column is
    read), then by day in the page's months only; one row a month and a day
    reaches the driver.  Headers are sorted for the page's days alone, and
    lines are read from the page's months alone."""
    src = in_period(t["transactions"], "transaction_date", month, year)
    months, rest = _span(_newest(src.groupBy("sale_month").agg(F.count(F.lit(1)))), offset, limit)
    inside = src.filter(_among("sale_month", months))
    days, skip = _span(_newest(inside.groupBy("transaction_date").agg(F.count(F.lit(1)))), rest, limit)
    wanted = inside.filter(_among("transaction_date", days))
    page = wanted.orderBy(*newest_first(wanted)).offset(skip).limit(limit)
    lines = t["transaction_items"].filter(_among("sale_month", months)).drop("transaction_date", "sale_month")
    return _numbered_page({**t, "transaction_items": lines}, page, offset)


def recent_transactions(t, n: int = 7) -> DataFrame:
    """the n most recent sales; only their lines are totalled."""
    src = period_headers(t)
    top = headers_for(t, src.orderBy(*newest_first(src)).limit(n))
    return (top.orderBy(*newest_first(top))
            .select("txn_id", "receipt_no", "transaction_date",
                    F.substring("transaction_time", 1, 5).alias("time"), "total", "payment_method"))


def cash_receipt_day(t, day) -> DataFrame:
    """The day's sales ordered by time with nested lines;
    ``row_in_hour`` numbers the sales of each hour (a number over the whole
    day would gather it in one task)."""
    fields = ["line_seq", "product_name", "quantity", "unit_price", "line_total"]
    hdr = period_headers(t, day=day)
    nested = with_line_amounts(nest_items(hdr, sale_lines(t, hdr), True, fields))
    hour = F.substring("transaction_time", 1, 2)
    w = Window.partitionBy("transaction_date", hour).orderBy("transaction_time", "txn_id")
    return (nested.withColumn("row_in_hour", F.row_number().over(w))
            .orderBy("transaction_date", "transaction_time", "txn_id"))


def transaction_detail(t, ids: DataFrame, journal: DataFrame | None = None) -> DataFrame:
    """Detail of a batch of sales: lines (``[]`` when none) with line
    margin round((price - cost) / price x 100, 1) (null for a zero price),
    and the sale's journal lines with their debit / credit totals.  Unknown
    ids give no row.

    ``ids`` may be header rows already selected; then headers are not joined
    again.  The sales' raw lines are selected and gathered once; totals, margins and
    journal lines are computed per row from the gathered lines.  A stored
    ``journal`` is joined instead where one is given."""
    src = t.get("sale_headers", t["transactions"])
    hdr = ids if set(src.columns) <= set(ids.columns) else src.join(ids.select("txn_id"), "txn_id", "left_semi")
    lines = sale_lines(t, ids)
    margin = (F.round(F.try_divide((F.col("unit_price") - F.col("unit_cost")) * 100,
                                   F.when(F.col("unit_price") != 0, F.col("unit_price"))), 1).cast("decimal(10,1)"))
    # A line margin above 40 % is flagged (null margin -> not flagged)
    lines = lines.withColumn("margin", margin).withColumn("high_margin", F.coalesce(F.col("margin") > 40, F.lit(False)))
    nested = with_line_amounts(nest_items(hdr, lines, empty_as_null_element=False, fields=ITEM_FIELDS + ["margin", "high_margin"]))
    if journal is None:
        amounts = sale_amounts(F.col("items"))
        posted = journal_line_array(F.col("receipt_no"), F.col("payment_method"), F.col("total"), F.col("tax"),
                                    amounts["cogs"], amounts["cats"])
        out = nested.withColumn("journal", posted)
    else:
        entry = F.struct("line_no", "description", "account_code", "debit", "credit")
        per = (journal.join(hdr.select(F.col("receipt_no").alias("reference_no")), "reference_no", "left_semi")
               .groupBy("reference_no").agg(F.array_sort(F.collect_list(entry)).alias("journal")))
        out = nested.join(per, nested.receipt_no == per.reference_no, "left").drop("reference_no")

    def side(c):
        return F.aggregate("journal", F.lit(0).cast(SUM_TYPE), lambda n, x: (n + x[c]).cast(SUM_TYPE)).cast(MONEY)
    return (out.withColumn("journal_lines", F.size("journal").cast("long"))
            .withColumn("journal_debit", side("debit")).withColumn("journal_credit", side("credit"))
            .orderBy("transaction_date", "transaction_time", "txn_id"))


def items_digest(items: Column, fields: list[str]) -> Column:
    """A flat text form of a nested items array (for comparisons and CSV)."""
    def one(x):
        return F.concat_ws(":", *[F.coalesce(x[f].cast("string"), F.lit("~")) for f in fields])
    return F.array_join(F.transform(items, one), "|")


def movement_listing(ledger_or_moves: DataFrame, n: int = 100, products: DataFrame | None = None) -> DataFrame:
    """The latest n movements, presented (time cut to HH:MM, absolute
    quantity).  Names missing from the movements are added to the n rows."""
    order = [F.col(c).desc() for c in ["log_date", "log_time", "txn_id"]]
    key = "line_key" if "line_key" in ledger_or_moves.columns else "line_seq"
    order += [F.col(key).desc(), F.col("kind").desc()]
    top = ledger_or_moves.orderBy(*order).limit(n)
    if "product_name" not in top.columns:
        names = products.select("product_id", F.col("name").alias("product_name"))
        top = top.join(names, "product_id", "left").orderBy(*order)
    return (top
            .select(F.col("log_date").alias("date"), F.substring("log_time", 1, 5).alias("time"),
                    F.col("movement_type").alias("type"), F.col("product_name").alias("product"),
                    F.abs("quantity_change").alias("qty"), "reason", "performed_by", "txn_id", "kind"))


def sale_alignment(t) -> DataFrame:
    """D11 by sale: date, header total, number and sum of its lines."""
    per = sale_totals(t["transaction_items"])
    if "sale_headers" in t:        # header totals are derived from these same lines: one pass
        return (t["sale_headers"].select("txn_id", "transaction_date")
                .join(per.select("txn_id", F.col("subtotal").alias("items_total"), "n_lines", "total"), "txn_id", "left")
                .withColumn("total", F.coalesce(F.col("total"), F.lit(0).cast("decimal(14,2)"))))
    per = per.select("txn_id", F.col("subtotal").alias("items_total"), "n_lines")
    return t["transactions"].select("txn_id", "transaction_date", "total").join(per, "txn_id", "left")


def alignment_by_month(by_sale: DataFrame) -> DataFrame:
    """D11 from ``sale_alignment`` rows."""
    d = F.col("transaction_date")
    return (by_sale.groupBy(F.year(d).alias("year"), F.month(d).alias("month"))
            .agg(F.count(F.lit(1)).alias("transactions"),
                 F.coalesce(F.sum("n_lines"), F.lit(0)).alias("items"),
                 F.sum("total").cast(MONEY).alias("txn_revenue"),
                 F.coalesce(F.sum("items_total"), F.lit(0)).cast(MONEY).alias("items_revenue"))
            .withColumn("diff", (F.col("txn_revenue") - F.col("items_revenue") * F.lit(1.11).cast("decimal(3,2)"))
                        .cast("decimal(22,4)")))


def txn_item_alignment(t) -> DataFrame:
    """D11 (pre-aggregated): per year and month, sales, lines, header totals,
    line totals and header total - lines x 1.11; lines are summed per sale
    before meeting the header, so header totals are counted once."""
    return alignment_by_month(sale_alignment(t))


def header_line_rows(t) -> DataFrame:
    """Every header with each of its lines, header totals repeated."""
    return t["transactions"].select("txn_id", "transaction_date", "total").join(
        t["transaction_items"].select("txn_id", "line_total"), "txn_id", "left")


def literal_by_month(rows: DataFrame) -> DataFrame:
    """D11 from ``header_line_rows``."""
    return (rows.groupBy(F.month("transaction_date").alias("month"))
            .agg(F.countDistinct("txn_id").alias("transactions"), F.count("line_total").alias("items"),
                 F.sum("total").cast(MONEY).alias("txn_revenue"), F.sum("line_total").cast(MONEY).alias("items_revenue"))
            .withColumn("diff", (F.col("txn_revenue") - F.col("items_revenue") * F.lit(1.11).cast("decimal(3,2)"))
                        .cast("decimal(22,4)")))


def txn_item_alignment_literal(t) -> DataFrame:
    """D11 as the check query states it: header totals repeat once per line
    after the join, and months of different years share a group."""
    return literal_by_month(header_line_rows(t))


def row_counts(tables: dict[str, DataFrame], names: list[str]) -> DataFrame:
    """Loaded rows per table (one global count each, stacked)."""
    out = None
    for n in names:
        c = tables[n].agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("rows"))
        out = c if out is None else out.unionByName(c)
    return out
