"""Daily sales cube: additive figures by day, payment method and category (D1-D7, I8-I12, I22 without the lines).

One row a (day, method, category) with revenue and cost, and one a (day,
method) with what is known by sale only: number of sales, net revenue, cost
and gross total (VAT is rounded by sale, so totals do not follow from
categories).  ``level`` tells the two kinds apart.  All figures add up, so
the cube of late sales, added, and that of deleted sales, subtracted
(``negated``), bring a stored cube up to date; ``summed`` merges such deltas.

A report reads the cube rows of its period: at most days x methods x
categories, however many sales they stand for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.functions.periods import in_period, period_predicate
from tillbook.operators import reports
from tillbook.operators.posting import category_lines
from tillbook.sources import seeds

MONEY = "decimal(24,2)"
GRAIN = ["sale_date", "payment_method", "level", "category"]
FIGURES = {"n_sales": "bigint", "n_lines": "bigint", "revenue": MONEY, "cogs": MONEY, "total": MONEY}
SALE, CATEGORY = "sale", "category"


def daily_cube(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """The cube of the sales in ``headers`` (one row a sale) from their ``lines``, read once.  Lines of other sales count
    nothing; a sale without lines counts as one of total zero; a null day or method is a group of its own."""
    cats = category_lines(lines).select("txn_id", "category", "revenue", "cogs", "n_lines")
    by_sale = cats.groupBy("txn_id").agg(
        # one element per category present on the sale
        F.collect_list(F.struct("category", "revenue", "cogs", "n_lines")).alias("cats"),
        F.sum("n_lines").alias("n_lines"), F.sum("revenue").alias("revenue"), F.sum("cogs").alias("cogs"))
    zero = F.lit(0).cast(MONEY)
    net, cost = F.coalesce(F.col("revenue").cast(MONEY), zero), F.coalesce(F.col("cogs").cast(MONEY), zero)
    total = (net + F.round(net * F.lit(seeds.VAT_RATE), 0)).cast(MONEY)

    def fact(level, category, n_sales, n_lines, revenue, cogs, gross):
        return F.struct(F.lit(level).alias("level"), category.cast("string").alias("category"),
                        *[v.cast(FIGURES[c]).alias(c) for c, v in zip(FIGURES, (n_sales, n_lines, revenue, cogs, gross))])

    none = F.array().cast("array<struct<category:string,revenue:decimal(14,2),cogs:decimal(14,2),n_lines:bigint>>")
    per_category = F.transform(F.coalesce("cats", none), lambda c: fact(
        CATEGORY, c["category"], F.lit(0), c["n_lines"], c["revenue"], c["cogs"], zero))
    facts = F.concat(F.array(fact(SALE, F.lit(None), F.lit(1), F.coalesce("n_lines", F.lit(0)), net, cost, total)), per_category)
    rows = (headers.select("txn_id", F.col("transaction_date").alias("sale_date"), "payment_method")
            .join(by_sale, "txn_id", "left").select("sale_date", "payment_method", F.explode(facts).alias("f"))
            .select("sale_date", "payment_method", "f.*"))
    return summed(rows)


def summed(rows: DataFrame) -> DataFrame:
    """Cube rows merged: one a group, without groups whose sales and lines are all gone."""
    out = rows.groupBy(*GRAIN).agg(*[F.sum(c).cast(kind).alias(c) for c, kind in FIGURES.items()])
    return out.filter(" or ".join(f"{c} <> 0" for c in FIGURES))


def negated(rows: DataFrame) -> DataFrame:
    """The delta that takes the sales of ``rows`` out of a cube."""
    return rows.select(*GRAIN, *[(-F.col(c)).cast(kind).alias(c) for c, kind in FIGURES.items()])


def _level(cube: DataFrame, level: str, month=None, year=None) -> DataFrame:
    return in_period(cube.filter(F.col("level") == level), "sale_date", month, year)


def sale_rows(cube: DataFrame, month=None, year=None) -> DataFrame:
    return _level(cube, SALE, month, year)


def category_rows(cube: DataFrame, month=None, year=None) -> DataFrame:
    return _level(cube, CATEGORY, month, year)


def by_payment(cube: DataFrame, month=None, year=None) -> DataFrame:
    """D4."""
    return sale_rows(cube, month, year).groupBy("payment_method").agg(
        F.sum("n_sales").alias("count"), F.sum("total").cast(MONEY).alias("total")).filter("count <> 0")


def _categories(cube: DataFrame, month=None, year=None) -> DataFrame:
    return (category_rows(cube, month, year).groupBy("category")
            .agg(F.sum("revenue").cast(MONEY).alias("revenue"), F.sum("cogs").cast(MONEY).alias("cogs"), F.sum("n_lines").alias("n"))
            .filter("n <> 0").drop("n"))


def by_category(cube: DataFrame, month=None, year=None) -> DataFrame:
    """D5."""
    return _categories(cube, month, year).select("category", "revenue").orderBy(F.col("revenue").desc(), "category")


def daily_sales(cube: DataFrame, month=None, year=None) -> DataFrame:
    """D6."""
    return (sale_rows(cube, month, year).groupBy(F.col("sale_date").alias("date"))
            .agg(F.sum("total").cast(MONEY).alias("total"), F.sum("n_sales").alias("count"))
            .filter("count <> 0").orderBy("date"))


def available_periods(cube: DataFrame) -> DataFrame:
    """D7/G3."""
    d = F.col("sale_date")
    return (sale_rows(cube).groupBy(F.year(d).alias("year"), F.month(d).alias("month")).agg(F.sum("n_sales").alias("n"))
            .filter("n <> 0").select("year", "month").orderBy(F.col("year").desc(), F.col("month").desc()))


def _sum(c: str, when: Column | None = None) -> Column:
    value = F.col(c) if when is None else F.when(when, F.col(c))
    return F.coalesce(F.sum(value), F.lit(0)).cast(FIGURES[c])


def _period_sums(when: Column | None = None) -> list[Column]:
    return [_sum("revenue", when).alias("total_revenue"), _sum("cogs", when).alias("total_cogs"),
            _sum("n_sales", when).alias("transaction_count")]


def report_summary(cube: DataFrame, month=None, year=None) -> DataFrame:
    """I8."""
    return reports.summary_row(sale_rows(cube, month, year).agg(*_period_sums()))


def income_statement(cube: DataFrame, month=None, year=None) -> DataFrame:
    """I9."""
    count = sale_rows(cube, month, year).agg(_sum("n_sales").alias("transaction_count"))
    return reports.income_lines(_categories(cube, month, year), count)


def balance_sheet(cube: DataFrame, products: DataFrame, month=None, year=None) -> DataFrame:
    """I10."""
    one = sale_rows(cube, month, year).agg(*_period_sums(), *reports.method_totals())
    return reports.balance_lines(one, reports.stock_value(products))


def cash_flow(cube: DataFrame, month=None, year=None) -> DataFrame:
    """I11."""
    return reports.cash_flow_lines(report_summary(cube, month, year))


def cash_position(cube: DataFrame, month=None, year=None) -> DataFrame:
    """I12."""
    return reports.cash_position_lines(sale_rows(cube, month, year), F.col("n_sales"))


def dashboard_kpis(cube: DataFrame, products: DataFrame, as_of, month=None, year=None) -> DataFrame:
    """I22 KPI row; ``as_of`` may lie outside the period."""
    inside, today = period_predicate("sale_date", month, year), F.col("sale_date") == F.lit(as_of)
    rows = cube.filter((F.col("level") == SALE) & (inside | today))
    one = rows.agg(*_period_sums(inside), _sum("total", today).alias("today_total"), _sum("n_sales", today).alias("today_count"))
    return reports.dashboard_row(one, products)
