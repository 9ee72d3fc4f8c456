"""Period reports and statements.

A statement scans the sale lines once: the period's headers select raw lines
before any join or aggregate (``sale_lines``), one aggregate over them feeds
every figure, and the statement is built from a one-row summary with an
``explode`` of line structs.  Headers are scanned for the selection and again
where a figure needs their columns.  Everything a statement needs from the
dimension side (stock value) is itself a one-row aggregate.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.functions.periods import day_spine, in_period, period_predicate, weekday_label
from tillbook.operators.inventory import low_stock
from tillbook.operators.posting import category_lines, sale_totals
from tillbook.sources.adapter import period_headers, period_transactions, sale_lines, with_sale_totals
from tillbook.sources import seeds

MONEY = "decimal(24,2)"  # width of sum(decimal(14,2)); totals of 100 TB fit
FIXED_TOTAL = sum(a for _, a, _, _ in seeds.FIXED_COSTS)
FIXED = {k: a for k, a, _, _ in seeds.FIXED_COSTS}


def _m(c: Column) -> Column:
    return c.cast(MONEY)


def _zero() -> Column:
    return F.lit(0).cast(MONEY)


def period_lines(t: dict[str, DataFrame], hdr: DataFrame, month=None, year=None) -> DataFrame:
    """The lines of the sales in ``hdr`` (headers of the period).  Lines
    that carry their sale's date (the stored model) are filtered directly,
    which prunes month partitions; raw lines are semi-joined first."""
    items = t["transaction_items"]
    if "transaction_date" in items.columns:
        return in_period(items, "transaction_date", month, year).filter(F.col("transaction_date").isNotNull())
    return sale_lines(t, hdr)


def period_sales(t: dict[str, DataFrame], month=None, year=None) -> DataFrame:
    """Per (sale, category) aggregates of the sales dated in the period."""
    return category_lines(period_lines(t, period_headers(t, month, year), month, year))


def sale_facts(t: dict[str, DataFrame], hdr: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per sale of ``hdr`` with net revenue, gross total and COGS
    (zeros without lines), from one pass over the lines."""
    per = sale_totals(lines).select("txn_id", "subtotal", "total", "cogs")
    zero = F.lit(0).cast("decimal(14,2)")
    return (hdr.select("txn_id", "transaction_date", "payment_method").join(per, "txn_id", "left")
            .select("txn_id", "transaction_date", "payment_method",
                    *[F.coalesce(F.col(c), zero).alias(c) for c in ("subtotal", "total", "cogs")]))


def revenue_cogs(t, month=None, year=None) -> DataFrame:
    """Total revenue (net of tax) and COGS; 0 when the period is empty."""
    return period_sales(t, month, year).agg(
        _m(F.coalesce(F.sum("revenue"), _zero())).alias("total_revenue"),
        _m(F.coalesce(F.sum("cogs"), _zero())).alias("total_cogs"))


def txn_count(t, month=None, year=None) -> DataFrame:
    """D3."""
    return period_headers(t, month, year).agg(F.count(F.lit(1)).alias("transaction_count"))


def by_payment(t, month=None, year=None) -> DataFrame:
    """Count and gross total (tax included) per payment method."""
    return (period_transactions(t, month, year)
            .groupBy("payment_method")
            .agg(F.count(F.lit(1)).alias("count"), _m(F.sum("total")).alias("total")))


def by_category(t, month=None, year=None) -> DataFrame:
    """Revenue per category, largest first."""
    return (period_sales(t, month, year).groupBy("category")
            .agg(_m(F.sum("revenue")).alias("revenue"))
            .orderBy(F.col("revenue").desc(), "category"))


def daily_sales(t, month=None, year=None) -> DataFrame:
    """Gross total and count per day."""
    return (period_transactions(t, month, year)
            .groupBy(F.col("transaction_date").alias("date"))
            .agg(_m(F.sum("total")).alias("total"), F.count(F.lit(1)).alias("count"))
            .orderBy("date"))


def available_periods(t) -> DataFrame:
    """Distinct (year, month) with sales, newest first."""
    d = F.col("transaction_date")
    return (period_headers(t).select(F.year(d).alias("year"), F.month(d).alias("month"))
            .distinct().orderBy(F.col("year").desc(), F.col("month").desc()))


def report_summary(t, month=None, year=None) -> DataFrame:
    """I8: one row.  fee = round(0.7 % of *all* net revenue); operating
    expenses = the four monthly fixed costs + fee, flat per call (not times
    the months in the period); gross = revenue - COGS; net = gross - opex."""
    return summary_row(_side_by_side(revenue_cogs(t, month, year), txn_count(t, month, year)))


def summary_row(s: DataFrame, *more: str) -> DataFrame:
    """The summary row from total_revenue, total_cogs and transaction_count;
    ``more`` columns are carried along."""
    fee = _m(F.round(F.col("total_revenue") * F.lit(seeds.PAYMENT_FEE_RATE), 0))
    opex = _m(F.lit(FIXED_TOTAL) + fee)
    gross = _m(F.col("total_revenue") - F.col("total_cogs"))
    return s.select(
        "total_revenue", "total_cogs", gross.alias("gross_profit"),
        *[F.lit(FIXED[k]).cast(MONEY).alias(k.lower()) for k in FIXED],
        fee.alias("payment_fee"), opex.alias("total_opex"),
        _m(gross - opex).alias("net_income"), "transaction_count", *more)


def _sums(when: Column | None = None) -> list[Column]:
    """Net revenue, COGS and number of the sales that ``when`` selects (all)."""
    pick = (lambda c: c) if when is None else (lambda c: F.when(when, c))
    return [_m(F.coalesce(F.sum(pick(F.col("subtotal"))), _zero())).alias("total_revenue"),
            _m(F.coalesce(F.sum(pick(F.col("cogs"))), _zero())).alias("total_cogs"),
            F.count(pick(F.lit(1))).alias("transaction_count")]


def _side_by_side(*frames: DataFrame) -> DataFrame:
    """Put one-row aggregates side by side without a join: union them (each
    column is non-null in exactly one input) and take each column's only
    non-null value in a global aggregate."""
    from functools import reduce
    from pyspark.sql import types as T
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    aggs = []
    for f in u.schema.fields:
        c = F.col(f"`{f.name}`")
        simple = not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        aggs.append((F.max(c) if simple else F.first(c, ignorenulls=True)).alias(f.name))
    return u.agg(*aggs)


def _pct(num: Column, den: Column) -> Column:
    """Percentage rounded to one decimal, 0 when the denominator is 0."""
    return F.when(den > 0, F.round(num * 100 / den, 1)).otherwise(F.lit(0)).cast("decimal(10,1)")


def _lines(rows: list[tuple[str, str, Column]]) -> Column:
    return F.array(*[F.struct(F.lit(i + 1).alias("line_no"), F.lit(sec).alias("section"),
                              F.lit(label).alias("label"), _m(v).alias("amount"))
                     for i, (sec, label, v) in enumerate(rows)])


def income_statement(t, month=None, year=None) -> DataFrame:
    """Category revenue lines (largest first), totals, the five cost lines,
    net income, and gross / net margin % (0 without revenue)."""
    by = period_sales(t, month, year).groupBy("category").agg(
        _m(F.sum("revenue")).alias("revenue"), _m(F.sum("cogs")).alias("cogs"))
    return income_lines(by, txn_count(t, month, year))


def income_lines(by: DataFrame, count: DataFrame) -> DataFrame:
    """I9 from ``by`` (category, revenue, cogs) and the one-row ``count``."""
    one = by.agg(
        _m(F.coalesce(F.sum("revenue"), _zero())).alias("total_revenue"),
        _m(F.coalesce(F.sum("cogs"), _zero())).alias("total_cogs"),
        # one element per product category
        F.array_sort(F.collect_list(F.struct((-F.col("revenue")).alias("neg"), "category", "revenue"))).alias("cats"))
    s = summary_row(_side_by_side(one, count), "cats")
    c = F.col
    cat_lines = F.transform(c("cats"), lambda x, i: F.struct(
        (i + 1).alias("line_no"), F.lit("Revenue").alias("section"),
        F.concat(x["category"], F.lit(" Revenue")).alias("label"), _m(x["revenue"]).alias("amount")))
    value = {"gross_margin": _pct(c("gross_profit"), c("total_revenue")), "net_margin": _pct(c("net_income"), c("total_revenue"))}
    tail_rows = [(sec, label, value[col] if col in value else c(col)) for sec, label, col in seeds.INCOME_LINES]
    k = F.size(c("cats"))
    tail = F.array(*[F.struct((k + i + 1).alias("line_no"), F.lit(sec).alias("section"),
                              F.lit(label).alias("label"), _m(v).alias("amount"))
                     for i, (sec, label, v) in enumerate(tail_rows)])
    return (s.select(F.explode(F.concat(cat_lines, tail)).alias("l"))
            .select(F.col("l.line_no").cast("int").alias("line_no"), "l.section", "l.label", "l.amount"))


def _method_total(method: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("payment_method") == method, F.col("total"))), _zero())


def _method_count(method: str, sales: Column) -> Column:
    return F.coalesce(F.sum(F.when(F.col("payment_method") == method, sales)), F.lit(0)).cast("bigint")


def stock_value(products: DataFrame) -> DataFrame:
    """Current value of product stock (active catalogue)."""
    return products.filter("active").agg(
        _m(F.coalesce(F.sum(F.col("stock") * F.col("cost")), _zero())).alias("stock_value"))


def balance_sheet(t, month=None, year=None) -> DataFrame:
    """Cash lines are gross receipts per method of the period; bank adds
    45M; inventory is the *current* stock value whatever the period; VAT
    payable = round(revenue x 0.11 / 1.11) although revenue is already net.
    Sides are not forced equal: the side totals and their difference are
    separate lines."""
    hdr = period_headers(t, month, year)
    one = sale_facts(t, hdr, period_lines(t, hdr, month, year)).agg(*_sums(), *method_totals())
    return balance_lines(one, stock_value(t["products"]))


def method_totals() -> list[Column]:
    """Gross receipts of each known method, one column each."""
    return [_m(_method_total(mth)).alias(mth.lower()) for mth in seeds.PAYMENT_METHODS]


def balance_lines(one: DataFrame, stock: DataFrame) -> DataFrame:
    """I10 from the one-row sums and ``method_totals`` of a period and the stock value."""
    methods = [mth.lower() for mth in seeds.PAYMENT_METHODS]
    s = _side_by_side(summary_row(one, *methods), stock)
    c = F.col
    L = seeds.BALANCE_LABELS
    cur = list(zip(L["current"], (c("cash"), c("debit") + F.lit(seeds.BANK_BASE), c("qris"), c("gopay"), c("stock_value"))))
    fixed = list(zip(L["fixed"], (F.lit(seeds.EQUIPMENT_VALUE), -F.lit(FIXED["Depreciation"]))))
    liab = list(zip(L["liabilities"], (F.lit(seeds.ACCOUNTS_PAYABLE), F.round(
        c("total_revenue") * F.lit(seeds.VAT_RATE) / F.lit(Decimal("1.11")), 0))))
    eq = list(zip(L["equity"], (F.lit(seeds.OWNER_CAPITAL), c("net_income"))))

    def total(rows):
        acc = rows[0][1]
        for _, v in rows[1:]:
            acc = acc + v
        return acc

    rows = ([("Assets", "Current Assets", lbl, v) for lbl, v in cur]
            + [("Assets", "Current Assets", "Total Current Assets", total(cur))]
            + [("Assets", "Fixed Assets", lbl, v) for lbl, v in fixed]
            + [("Assets", "Fixed Assets", "Total Fixed Assets", total(fixed))]
            + [("Assets", "Assets", "Total Assets", total(cur) + total(fixed))]
            + [("Liabilities & Equity", "Liabilities", lbl, v) for lbl, v in liab]
            + [("Liabilities & Equity", "Liabilities", "Total Liabilities", total(liab))]
            + [("Liabilities & Equity", "Equity", lbl, v) for lbl, v in eq]
            + [("Liabilities & Equity", "Equity", "Total Equity", total(eq))]
            + [("Liabilities & Equity", "Liabilities & Equity", "Total Liabilities & Equity",
                total(liab) + total(eq))]
            + [("Check", "Check", "Assets minus Liabilities & Equity",
                total(cur) + total(fixed) - total(liab) - total(eq))])
    arr = F.array(*[F.struct(F.lit(i + 1).alias("line_no"), F.lit(side).alias("side"),
                             F.lit(sec).alias("section"), F.lit(lbl).alias("label"), _m(v).alias("amount"))
                    for i, (side, sec, lbl, v) in enumerate(rows)])
    return s.select(F.explode(arr).alias("l")).select(
        F.col("l.line_no").cast("int").alias("line_no"), "l.side", "l.section", "l.label", "l.amount")


def cash_flow(t, month=None, year=None) -> DataFrame:
    """Receipts (net revenue) less salary, rent, utilities and material
    purchases (COGS + 2M); investing and financing are zero."""
    return cash_flow_lines(report_summary(t, month, year))


def cash_flow_lines(s: DataFrame) -> DataFrame:
    """I11 from the summary row."""
    c = F.col
    op = [("Customer receipts", c("total_revenue")), ("Salary payments", -F.lit(FIXED["Salary"])),
          ("Rent payments", -F.lit(FIXED["Rent"])), ("Utilities", -F.lit(FIXED["Utilities"])),
          ("Raw material purchases", -(c("total_cogs") + F.lit(seeds.MATERIAL_PURCHASE_EXTRA)))]
    net_op = op[0][1]
    for _, v in op[1:]:
        net_op = net_op + v
    rows = ([("Operating Activities", lbl, v) for lbl, v in op]
            + [("Operating Activities", "Net Cash Flow", net_op),
               ("Investing Activities", "Equipment purchases", _zero()),
               ("Investing Activities", "Net Cash Flow", _zero()),
               ("Financing Activities", "Additional capital", _zero()),
               ("Financing Activities", "Net Cash Flow", _zero())])
    return s.select(F.explode(_lines(rows)).alias("l")).select(
        F.col("l.line_no").cast("int").alias("line_no"), "l.section", "l.label", "l.amount")


def _method_rows(hdr: DataFrame, extra_bank: bool, sales: Column) -> DataFrame:
    """The four methods, zero-filled, from one conditional aggregate; a row of ``hdr`` stands for ``sales`` sales."""
    aggs = []
    for mth in seeds.PAYMENT_METHODS:
        aggs += [_m(_method_total(mth)).alias(f"t_{mth}"), _method_count(mth, sales).alias(f"n_{mth}")]
    s = hdr.agg(*aggs)
    rows = []
    for i, mth in enumerate(seeds.PAYMENT_METHODS):
        amt = F.col(f"t_{mth}")
        if extra_bank and mth == "Debit":
            amt = amt + F.lit(seeds.BANK_BASE)
        rows.append(F.struct(F.lit(i + 1).alias("line_no"), F.lit(mth).alias("payment_method"),
                             F.lit(seeds.CASH_ACCOUNT[mth]).alias("account_code"),
                             F.col(f"n_{mth}").alias("count"), _m(amt).alias("amount")))
    return s.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def cash_position(t, month=None, year=None) -> DataFrame:
    """Per method gross receipts on its cash account (bank +45M) and the
    total of cash and equivalents."""
    return cash_position_lines(period_transactions(t, month, year), F.lit(1))


def cash_position_lines(hdr: DataFrame, sales: Column) -> DataFrame:
    """I12 from rows of payment method and total that stand for ``sales`` sales each."""
    rows = _method_rows(hdr, extra_bank=True, sales=sales)
    total = rows.agg(F.lit(5).alias("line_no"), F.lit("TOTAL").alias("payment_method"),
                     F.lit("").alias("account_code"), F.sum("count").alias("count"),
                     _m(F.sum("amount")).alias("amount"))
    return rows.unionByName(total).orderBy("line_no")


def cash_by_method(t, day) -> DataFrame:
    """One day's receipts per method plus a TOTAL row; the four
    methods appear even without sales (C9), any other method present on the
    day is listed too.  The total comes from a global aggregate, so an empty
    day still has its zero TOTAL row."""
    hdr = period_transactions(t, day=day)
    spine = hdr.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(mth) for mth in seeds.PAYMENT_METHODS])).alias("payment_method"))
    detail = hdr.groupBy("payment_method").agg(F.count(F.lit(1)).alias("count"), _m(F.sum("total")).alias("amount"))
    filled = (spine.join(detail, "payment_method", "full_outer")
              .select("payment_method", F.coalesce("count", F.lit(0)).alias("count"),
                      F.coalesce("amount", _zero()).alias("amount")))
    total = hdr.agg(F.lit("TOTAL").alias("payment_method"), F.count(F.lit(1)).alias("count"),
                    _m(F.coalesce(F.sum("total"), _zero())).alias("amount"))
    place = F.coalesce(F.array_position(F.array(*[F.lit(m) for m in seeds.PAYMENT_METHODS]), F.col("payment_method")), F.lit(0))
    return (filled.unionByName(total)
            .orderBy(F.col("payment_method") == "TOTAL", place == 0, place, "payment_method"))


def avg_ticket(t, month=None, year=None) -> DataFrame:
    """Net revenue per sale, 0 without sales."""
    s = report_summary(t, month, year)
    return s.select(F.when(F.col("transaction_count") > 0,
                           F.round(F.col("total_revenue") / F.col("transaction_count"), 2))
                    .otherwise(0).cast(MONEY).alias("avg_ticket"))


def analytics(t, month=None, year=None) -> DataFrame:
    """Average ticket, gross and net margin %, sale count."""
    s = report_summary(t, month, year)
    c = F.col
    return s.select(
        F.when(c("transaction_count") > 0, F.round(c("total_revenue") / c("transaction_count"), 2))
        .otherwise(0).cast(MONEY).alias("avg_ticket"),
        _pct(c("gross_profit"), c("total_revenue")).alias("gross_margin_pct"),
        _pct(c("net_income"), c("total_revenue")).alias("net_margin_pct"),
        "transaction_count")


def txn_gross_margin(t) -> DataFrame:
    """Per sale (subtotal - cost) / subtotal in %, 0 when subtotal is 0.
    With totals derived from lines, subtotal and cost come from the same
    per-sale aggregate (one pass over the lines)."""
    per = sale_totals(t["transaction_items"])
    if "sale_headers" in t:
        j = t["sale_headers"].select("txn_id", "receipt_no").join(
            per.select("txn_id", "subtotal", "cogs"), "txn_id", "left")
        sub = F.coalesce(F.col("subtotal"), _zero())
    else:
        j = t["transactions"].select("txn_id", "receipt_no", "subtotal").join(
            per.select("txn_id", "cogs"), "txn_id", "left")
        sub = F.col("subtotal")
    cg = F.coalesce(F.col("cogs"), _zero())
    return j.select("txn_id", "receipt_no", sub.cast("decimal(14,2)").alias("subtotal"), _m(cg).alias("cogs"),
                    _pct(sub - cg, sub).alias("gross_margin_pct"))


def today_kpi(t, as_of) -> DataFrame:
    """Total and count of the sales of ``as_of``."""
    return period_transactions(t, day=as_of).agg(
        _m(F.coalesce(F.sum("total"), _zero())).alias("today_total"),
        F.count(F.lit(1)).alias("today_count"))


def dashboard_kpis(t, as_of, month=None, year=None) -> DataFrame:
    """I22 KPI row: period revenue and count, today's total and count, net
    income with margin, and the low-stock count."""
    hdr = period_headers(t)
    inside = period_predicate("transaction_date", month, year)
    today = F.col("transaction_date") == F.lit(as_of)
    hdr = hdr.filter(inside | today)
    one = sale_facts(t, hdr, sale_lines(t, hdr)).agg(
        *_sums(inside), _m(F.coalesce(F.sum(F.when(today, F.col("total"))), _zero())).alias("today_total"),
        F.count(F.when(today, F.lit(1))).alias("today_count"))
    return dashboard_row(one, t["products"])


def dashboard_row(one: DataFrame, products: DataFrame) -> DataFrame:
    """I22 from the one-row sums of the period and of today."""
    low = low_stock(products).agg(F.count(F.lit(1)).alias("low_stock_count"))
    s = _side_by_side(summary_row(one, "today_total", "today_count"), low)
    c = F.col
    return s.select("total_revenue", "transaction_count", "today_total", "today_count", "net_income",
                    _pct(c("net_income"), c("total_revenue")).alias("net_margin_pct"), "low_stock_count")


def weekly_trend(t, as_of, month=None, year=None) -> DataFrame:
    """The seven days ending ``as_of`` with the gross daily total of
    the *period-filtered* series (days outside the period show 0)."""
    last = as_of if isinstance(as_of, dt.date) else dt.date.fromisoformat(str(as_of))
    week = F.col("transaction_date").between(F.lit(last - dt.timedelta(days=6)), F.lit(last))
    hdr = period_headers(t, month, year).filter(week)
    totals = with_sale_totals(hdr, sale_lines(t, hdr)) if "sale_headers" in t else hdr
    daily = totals.groupBy(F.col("transaction_date").alias("date")).agg(
        _m(F.sum("total")).alias("total"), F.count(F.lit(1)).alias("count"))
    days = hdr.sparkSession.range(1).select(F.explode(day_spine(last)).alias("date"))
    return (days.join(daily, "date", "left")
            .select("date", weekday_label("date").alias("label"),
                    F.coalesce(F.col("total"), _zero()).alias("total"),
                    F.coalesce(F.col("count"), F.lit(0)).alias("count")).orderBy("date"))


def bar_ratio(df: DataFrame, value_col: str) -> DataFrame:
    """Bar length min(100, v / max(v) x 100) over a small aggregate (a
    daily or per-method series, bounded by the calendar), so the global
    ``max() over ()`` window sees few rows."""
    from pyspark.sql import Window
    mx = F.max(value_col).over(Window.partitionBy())
    r = F.when(mx > 0, F.least(F.lit(100), F.round(F.col(value_col) * 100 / mx, 1))).otherwise(F.lit(0))
    return df.withColumn("bar_pct", r.cast("decimal(10,1)"))
