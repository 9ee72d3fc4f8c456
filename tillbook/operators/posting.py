"""Sale totals and double-entry posting.

Every sale posts 4 + k journal lines (k = number of product categories on the
sale): Dr cash account for the total, Cr one revenue line per category, Cr VAT
payable, Dr COGS and Cr inventory for the cost of the goods sold.

Plan shape (per sale): lines are first aggregated to (txn_id, category) with a
map-side partial aggregate, so even a sale holding a third of all lines
reaches the shuffle as at most one row per category and map task.  The
per-sale step then only gathers those few category rows, and a single
``explode`` over an array of line structs emits all journal lines in one pass
(no union of several scans).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.sources import seeds

MONEY = "decimal(14,2)"
SUM_TYPE = "decimal(24,2)"
UNKNOWN_CATEGORY = "Unknown"
JOURNAL_COLUMNS = ["entry_date", "description", "account_code", "debit", "credit",
                   "reference_no", "posted_by", "line_no", "entry_kind"]


def _money(c: Column) -> Column:
    return c.cast(MONEY)


def _map_lookup(key: Column, mapping: dict[str, str], default: str) -> Column:
    """Constant lookup with a default for unknown keys (bounded map)."""
    m = F.create_map(*[F.lit(x) for kv in sorted(mapping.items()) for x in kv])
    return F.coalesce(F.try_element_at(m, key), F.lit(default))


def line_order_key(df: DataFrame) -> Column:
    """Sort key of a line inside its sale.

    The adapter carries ``line_key``, the raw columns that define the line
    order, so ordering needs no per-sale ``row_number`` window (a window would
    put one hot sale into one task).  Hand-built frames use ``line_seq``."""
    return F.col("line_key") if "line_key" in df.columns else F.col("line_seq")


def category_lines(items: DataFrame) -> DataFrame:
    """Revenue, cost and first line per (sale, category).  Lines of an
    unknown product carry no price: their category is ``Unknown``, at zero."""
    zero = F.lit(0).cast(MONEY)
    return (items.groupBy("txn_id", F.coalesce("category", F.lit(UNKNOWN_CATEGORY)).alias("category"))
            .agg(_money(F.coalesce(F.sum("line_total"), zero)).alias("revenue"),
                 _money(F.coalesce(F.sum(F.col("unit_cost") * F.col("quantity")), zero)).alias("cogs"),
                 F.min(line_order_key(items)).alias("first_seq"),
                 F.count(F.lit(1)).alias("n_lines")))


def sale_totals(items: DataFrame) -> DataFrame:
    """subtotal = sum of price x qty, tax = round(11 %) to whole units,
    total = subtotal + tax, plus the cost of goods sold, per sale."""
    per_txn = (category_lines(items).groupBy("txn_id")
               .agg(_money(F.sum("revenue")).alias("subtotal"),
                    _money(F.sum("cogs")).alias("cogs"),
                    F.sum("n_lines").alias("n_lines")))
    tax = _money(F.round(F.col("subtotal") * F.lit(seeds.VAT_RATE), 0))
    return per_txn.select("txn_id", "subtotal", tax.alias("tax"),
                          _money(F.col("subtotal") + tax).alias("total"), "cogs", "n_lines")


def with_amounts(sales: DataFrame) -> DataFrame:
    """Tax and total beside the ``subtotal`` of each sale; a sale without one (no lines) gets zeros."""
    kept = sales.withColumn("subtotal", F.coalesce("subtotal", F.lit(0).cast(MONEY)))
    tax = _money(F.round(F.col("subtotal") * F.lit(seeds.VAT_RATE), 0))
    return kept.select("*", tax.alias("tax"), _money(F.col("subtotal") + tax).alias("total"))


def journal_line_array(receipt_no: Column, payment_method: Column, total: Column, tax: Column,
                       cogs: Column, cats: Column) -> Column:
    """The ordered journal lines of one sale as an array of structs.

    ``cats`` is an array of (category, revenue) structs in order of first
    appearance on the sale (may be null or empty for a sale without lines).
    Shared by the batch posting and the streaming posting."""
    zero = F.lit(0).cast(MONEY)
    n = F.when(cats.isNull(), F.lit(0)).otherwise(F.size(cats))
    cogs = F.coalesce(cogs, zero)

    def line(desc, acct, dr, cr, no):
        return F.struct(desc.alias("description"), acct.alias("account_code"), _money(dr).alias("debit"),
                        _money(cr).alias("credit"), no.cast("int").alias("line_no"))

    cash = line(F.concat(F.lit(seeds.SALE_LINE_TEXT), receipt_no),
                _map_lookup(payment_method, seeds.CASH_ACCOUNT, seeds.DEFAULT_CASH_ACCOUNT),
                total, zero, F.lit(1))
    revenue = F.transform(cats, lambda c, i: line(
        F.concat(c["category"], F.lit(seeds.REVENUE_LINE_TEXT), receipt_no),
        _map_lookup(c["category"], seeds.REVENUE_ACCOUNT, seeds.DEFAULT_REVENUE_ACCOUNT),
        zero, c["revenue"], i + 2))
    revenue = F.coalesce(revenue, F.array().cast(
        "array<struct<description:string,account_code:string,debit:decimal(14,2),"
        "credit:decimal(14,2),line_no:int>>"))
    tail = F.array(
        line(F.concat(F.lit(seeds.VAT_LINE_TEXT), receipt_no), F.lit(seeds.VAT_ACCOUNT), zero, tax, n + 2),
        line(F.concat(F.lit(seeds.COGS_LINE_TEXT), receipt_no), F.lit(seeds.COGS_ACCOUNT), cogs, zero, n + 3),
        line(F.concat(F.lit(seeds.INVENTORY_LINE_TEXT), receipt_no), F.lit(seeds.INVENTORY_ACCOUNT), zero, cogs,
             n + 4),
    )
    return F.concat(F.array(cash), revenue, tail)


def _sum_of(arr: Column, value) -> Column:
    return F.aggregate(arr, F.lit(0).cast(SUM_TYPE), lambda n, x: (n + F.coalesce(value(x), F.lit(0))).cast(SUM_TYPE))


def sale_amounts(items: Column) -> dict[str, Column]:
    """I1 per row, from the nested lines of one sale: subtotal, tax, total,
    cogs and ``cats`` (category, revenue) in order of first appearance.  Null
    elements (a sale without lines, D12) count nothing."""
    lines = F.filter(items, lambda x: x["line_seq"].isNotNull())
    subtotal = _money(_sum_of(lines, lambda x: x["line_total"]))
    tax = _money(F.round(subtotal * F.lit(seeds.VAT_RATE), 0))
    name = lambda x: F.coalesce(x["category"], F.lit(UNKNOWN_CATEGORY))
    out = {"subtotal": subtotal, "tax": tax, "total": _money(subtotal + tax)}
    out["cogs"] = _money(_sum_of(lines, lambda x: x["unit_cost"] * x["quantity"]))
    out["cats"] = F.transform(
        F.array_distinct(F.transform(lines, name)),
        lambda c: F.struct(c.alias("category"), _money(_sum_of(F.filter(lines, lambda x: name(x) == c),
                                                               lambda x: x["line_total"])).alias("revenue")))
    return out


def explode_journal(df: DataFrame, date_col: str, lines: Column) -> DataFrame:
    return (df.select(F.col(date_col).alias("entry_date"), F.col("receipt_no").alias("reference_no"),
                      F.explode(lines).alias("l"))
            .select("entry_date", "l.description", "l.account_code", "l.debit", "l.credit",
                    "reference_no", F.lit("System").alias("posted_by"), "l.line_no",
                    F.lit("sale").alias("entry_kind")))


def post_sales(transactions: DataFrame, items: DataFrame) -> DataFrame:
    """Journal lines of every sale (live-path rules: zero amounts post).

    ``transactions`` needs txn_id, transaction_date, receipt_no and
    payment_method.  Subtotal, VAT, total and COGS come from the lines (I1),
    from the same per-(sale, category) aggregate that gives the revenue
    lines, so the lines are scanned and shuffled once.  Unknown payment
    methods post to 1010, unknown categories to 4010.
    """
    cats = category_lines(items)
    per_txn = (cats.groupBy("txn_id")
               .agg(_money(F.sum("revenue")).alias("subtotal"),
                    _money(F.sum("cogs")).alias("cogs"),
                    # bounded: one element per category present on the sale
                    F.array_sort(F.collect_list(F.struct("first_seq", "category", "revenue")))
                    .alias("cats")))
    hdr = transactions.select("txn_id", "transaction_date", "receipt_no", "payment_method")
    j = hdr.join(per_txn, "txn_id", "left")
    subtotal = F.coalesce(F.col("subtotal"), F.lit(0).cast(MONEY))
    tax = _money(F.round(subtotal * F.lit(seeds.VAT_RATE), 0))
    total = _money(subtotal + tax)
    cat_arr = F.transform(F.col("cats"), lambda c: F.struct(c["category"].alias("category"),
                                                            c["revenue"].alias("revenue")))
    lines = journal_line_array(F.col("receipt_no"), F.col("payment_method"), total, tax, F.col("cogs"), cat_arr)
    return explode_journal(j, "transaction_date", lines)


def period_text(month: str) -> Column:
    """`` April 2026`` of a month's first day."""
    return F.concat(F.lit(" "), F.date_format(month, "MMMM yyyy"))


def accrue_fixed(months: DataFrame, as_of) -> DataFrame:
    """I4: two lines per fixed cost and month (expense Dr, counter account Cr).

    ``months`` has a ``month_start`` date column.  Months before the month of
    ``as_of`` accrue in full on their last day; the month of ``as_of`` accrues
    round(cost x day(as_of) / days in month) on ``as_of``; later months none.
    The four cost kinds are expanded with an array explode (no join).
    """
    as_of_c = F.lit(as_of) if isinstance(as_of, (dt.date, str)) else as_of
    as_of_c = as_of_c.cast("date")
    ms = F.col("month_start")
    cur = F.trunc(as_of_c, "MM")
    full = ms < cur
    ratio_days = F.dayofmonth(as_of_c)
    dim = F.dayofmonth(F.last_day(ms))
    costs = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(a).cast(MONEY).alias("amount"),
                               F.lit(e).alias("exp"), F.lit(c).alias("ctr"), F.lit(i + 1).alias("no"),
                               *[F.lit(x).alias(n) for x, n in zip(seeds.ACCRUAL_TEXT[k], ("exp_text", "ctr_text"))])
                      for i, (k, a, e, c) in enumerate(seeds.FIXED_COSTS)])
    base = (months.filter(ms <= cur)
            .select(ms, F.when(full, F.last_day(ms)).otherwise(as_of_c).alias("entry_date"),
                    full.alias("full"), ratio_days.alias("days"), dim.alias("dim"),
                    F.explode(costs).alias("c")))
    amount = F.when(F.col("full"), F.col("c.amount")).otherwise(
        F.round(F.col("c.amount") * F.col("days") / F.col("dim"), 0))
    # the year is part of the reference: a model spans several years
    ref = F.concat(F.lit("ADJ-"), F.upper(F.date_format("month_start", "MMM-yyyy")), F.lit("-"),
                   F.lpad(F.col("c.no").cast("string"), 2, "0"))
    month = period_text("month_start")
    pair = F.array(
        F.struct(F.col("c.exp").alias("account_code"), F.concat(F.col("c.exp_text"), month).alias("description"), _money(amount).alias("debit"),
                 F.lit(0).cast(MONEY).alias("credit"), F.lit(1).alias("line_no")),
        F.struct(F.col("c.ctr").alias("account_code"), F.concat(F.col("c.ctr_text"), month).alias("description"), F.lit(0).cast(MONEY).alias("debit"),
                 _money(amount).alias("credit"), F.lit(2).alias("line_no")))
    return (base.select("entry_date", ref.alias("reference_no"), F.explode(pair).alias("p"))
            .select("entry_date", "p.description", "p.account_code", "p.debit", "p.credit",
                    "reference_no", F.lit("System").alias("posted_by"),
                    F.col("p.line_no").cast("int").alias("line_no"),
                    F.lit("accrual").alias("entry_kind")))


def opening_entries(anchor: DataFrame) -> DataFrame:
    """Opening capital lines dated ``anchor.opening_date`` (one-row frame)."""
    lines = F.array(*[F.struct(F.lit(r).alias("reference_no"), F.lit(d).alias("description"),
                               F.lit(a).alias("account_code"), F.lit(dr).cast(MONEY).alias("debit"),
                               F.lit(cr).cast(MONEY).alias("credit"), F.lit(i + 1).alias("line_no"))
                      for i, (r, d, a, dr, cr) in enumerate(seeds.OPENING_LINES)])
    return (anchor.select(F.col("opening_date").alias("entry_date"), F.explode(lines).alias("o"))
            .select("entry_date", "o.description", "o.account_code", "o.debit", "o.credit",
                    "o.reference_no", F.lit("System").alias("posted_by"), "o.line_no",
                    F.lit("opening").alias("entry_kind")))


def build_journal(t: dict[str, DataFrame], as_of=None, month=None, year=None) -> DataFrame:
    """The journal table: sales postings, monthly accruals and opening lines.

    The calendar of months and the opening date come from a one-row aggregate
    of the sales (first and last sale date); ``as_of`` defaults to the last
    sale date.  Nothing is collected to the driver.

    With a period, only that period's sales are posted: the raw lines are
    semi-joined to the period's headers before anything else; accruals and
    opening lines are produced in full for the caller's own period filter.
    """
    from tillbook.sources.adapter import period_headers, sale_lines
    bounds = t.get("sale_headers", t["transactions"]).agg(
        F.min("transaction_date").alias("first_day"), F.max("transaction_date").alias("last_day"))
    as_of_c = F.col("last_day") if as_of is None else F.lit(as_of).cast("date")
    months = bounds.select(
        F.explode(F.sequence(F.trunc("first_day", "MM"), F.trunc(as_of_c, "MM"),
                             F.expr("INTERVAL 1 MONTH"))).alias("month_start"),
        as_of_c.alias("as_of"))
    accruals = accrue_fixed(months, F.col("as_of"))
    opening = opening_entries(bounds.select(F.trunc("first_day", "MM").alias("opening_date")))
    headers = period_headers(t, month, year)
    lines = sale_lines(t, headers) if month or year else t["transaction_items"]
    return (post_sales(headers, lines)
            .unionByName(accruals).unionByName(opening))


def unbalanced_receipts(journal: DataFrame) -> DataFrame:
    """References whose debits and credits differ (must be empty)."""
    return (journal.groupBy("reference_no")
            .agg(_money(F.sum("debit")).alias("total_debit"), _money(F.sum("credit")).alias("total_credit"))
            .withColumn("diff", _money(F.col("total_debit") - F.col("total_credit")))
            .filter(F.col("diff") != 0))
