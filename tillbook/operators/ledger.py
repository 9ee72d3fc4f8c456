"""Ledger views of the journal.

The journal is aggregated per account *before* it meets the chart of
accounts: account codes are unique in the chart, so the result equals the
left join + GROUP BY + HAVING form, and the 21-row chart (a fixed dimension,
size bounded by the model) is broadcast into the aggregate's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.functions.periods import in_period
from tillbook.plans.session import written

MONEY = "decimal(24,2)"  # width of sum(decimal(14,2)); totals of 100 TB fit


def general_ledger(coa: DataFrame, journal: DataFrame, month=None, year=None) -> DataFrame:
    """Per account sum of debits and credits of the period, balance on
    the account's normal side, by account code; accounts without activity are left out."""
    j = in_period(journal, "entry_date", month, year)
    sums = (j.groupBy("account_code")
            .agg(F.sum("debit").cast(MONEY).alias("debit"), F.sum("credit").cast(MONEY).alias("credit")))
    c = F.broadcast(coa.select("code", "name", F.col("account_type").alias("type"),
                               F.col("normal_balance").alias("normal")))
    gl = sums.join(c, sums.account_code == c.code, "inner")
    balance = F.when(F.col("normal") == "D", F.col("debit") - F.col("credit")).otherwise(
        F.col("credit") - F.col("debit")).cast(MONEY)
    return (gl.filter((F.col("debit") > 0) | (F.col("credit") > 0))
            .select("code", "name", "type", "normal", "debit", "credit", balance.alias("balance")).orderBy("code"))


def trial_balance(gl: DataFrame) -> DataFrame:
    """Each account shows its balance on its normal side when positive;
    the TOTAL row sums *all* balances per side (negative ones included), so
    shown rows need not add up to the total."""
    rows = gl.select(
        F.lit(0).alias("row_kind"), "code", "name",
        F.when((F.col("normal") == "D") & (F.col("balance") > 0), F.col("balance")).alias("debit"),
        F.when((F.col("normal") == "K") & (F.col("balance") > 0), F.col("balance")).alias("credit"))
    total = gl.agg(
        F.lit(1).alias("row_kind"), F.lit("").alias("code"), F.lit("TOTAL").alias("name"),
        F.coalesce(F.sum(F.when(F.col("normal") == "D", F.col("balance"))), F.lit(0)).cast(MONEY).alias("debit"),
        F.coalesce(F.sum(F.when(F.col("normal") == "K", F.col("balance"))), F.lit(0)).cast(MONEY).alias("credit"))
    return rows.unionByName(total).orderBy("row_kind", "code")


def trial_balance_check(gl: DataFrame) -> DataFrame:
    """Totals of balances per side and the balanced flag (|diff| < 1)."""
    d = F.coalesce(F.sum(F.when(F.col("normal") == "D", F.col("balance"))), F.lit(0)).cast(MONEY)
    k = F.coalesce(F.sum(F.when(F.col("normal") == "K", F.col("balance"))), F.lit(0)).cast(MONEY)
    out = gl.agg(d.alias("total_debit"), k.alias("total_credit"))
    diff = (F.col("total_debit") - F.col("total_credit")).cast(MONEY)
    return out.select("total_debit", "total_credit", diff.alias("diff"),
                      (F.abs(diff) < 1).alias("balanced"))


def journal_balance_by_month(journal: DataFrame) -> DataFrame:
    """Per calendar month, sum of debits, credits and their difference."""
    return (journal.groupBy(F.year("entry_date").alias("year"), F.month("entry_date").alias("month"))
            .agg(F.sum("debit").cast(MONEY).alias("total_debit"),
                 F.sum("credit").cast(MONEY).alias("total_credit"))
            .withColumn("diff", (F.col("total_debit") - F.col("total_credit")).cast(MONEY)))


def journal_totals(journal: DataFrame, month=None, year=None) -> DataFrame:
    """Column totals of a journal listing."""
    j = in_period(journal, "entry_date", month, year)
    return j.agg(F.count(F.lit(1)).alias("lines"),
                 F.coalesce(F.sum("debit"), F.lit(0)).cast(MONEY).alias("total_debit"),
                 F.coalesce(F.sum("credit"), F.lit(0)).cast(MONEY).alias("total_credit"))


def with_footer(lines: DataFrame, month=None, year=None) -> DataFrame:
    """A journal listing with its column totals as a last row
    (``row_kind`` 1).  The period's lines are posted and written once; listing
    and totals read what was written."""
    cols = ["entry_date", "description", "account_code", "reference_no", "line_no"]
    j = written(in_period(lines, "entry_date", month, year).select(*cols, "debit", "credit"), "journal-listing")
    rows = j.select(F.lit(0).alias("row_kind"), *cols, F.col("debit").cast(MONEY).alias("debit"),
                    F.col("credit").cast(MONEY).alias("credit"))
    total = journal_totals(j).select(
        F.lit(1).alias("row_kind"), F.lit(None).cast("date").alias("entry_date"), F.lit("TOTAL").alias("description"),
        *[F.lit(None).cast("string").alias(c) for c in ("account_code", "reference_no")],
        F.lit(0).alias("line_no"), F.col("total_debit").alias("debit"), F.col("total_credit").alias("credit"))
    return rows.unionByName(total).orderBy("row_kind", F.col("entry_date").desc(), F.col("reference_no").desc(), F.col("line_no").desc())


def journal_display(journal: DataFrame) -> DataFrame:
    """Amount columns blank (null) unless positive."""
    return journal.select(
        "*",
        F.when(F.col("debit") > 0, F.col("debit")).alias("debit_shown"),
        F.when(F.col("credit") > 0, F.col("credit")).alias("credit_shown"))


def sales_journal(journal: DataFrame, month=None, year=None, limit: int | None = 500) -> DataFrame:
    """Newest-first journal lines of the period with display columns.
    ``limit`` is the listing size (a top-k feature); None lists everything."""
    j = journal_display(in_period(journal, "entry_date", month, year))
    ordered = j.orderBy(F.col("entry_date").desc(), F.col("reference_no").desc(), F.col("line_no").desc())
    return ordered.limit(limit) if limit else ordered


def journal_for_receipts(journal: DataFrame, coa: DataFrame, refs: DataFrame) -> DataFrame:
    """Journal lines of a set of receipts with account names; a line
    whose account is missing from the chart keeps a null name.  ``refs`` has a
    ``reference_no`` column and may be large, so it is joined, not collected."""
    j = journal.join(refs.select("reference_no"), "reference_no", "left_semi")
    names = F.broadcast(coa.select(F.col("code").alias("account_code"), F.col("name").alias("account_name")))
    return j.join(names, "account_code", "left").select(
        "reference_no", "line_no", "entry_date", "description", "account_code", "account_name", "debit", "credit"
    ).orderBy("reference_no", "line_no")


def coa_sections(coa: DataFrame) -> DataFrame:
    """Account list grouped by type with a Debit/Credit side label."""
    rank = (F.when(F.col("account_type") == "Asset", 1).when(F.col("account_type") == "Liability", 2)
            .when(F.col("account_type") == "Equity", 3).when(F.col("account_type") == "Revenue", 4)
            .when(F.col("account_type") == "Expense", 5).otherwise(6))
    return coa.select(rank.alias("section_rank"), "account_type", "code", "name",
                      F.when(F.col("normal_balance") == "D", "Debit").otherwise("Credit").alias("side"))


def cash_receipts_journal(transactions: DataFrame, month=None, year=None) -> DataFrame:
    """Per sale of the period, Dr cash = total, Cr revenue = subtotal."""
    t = in_period(transactions, "transaction_date", month, year)
    return t.select("txn_id", "transaction_date", "receipt_no", "cashier_name", "payment_method",
                    F.col("total").alias("dr_cash"), F.col("subtotal").alias("cr_revenue")
                    ).orderBy(F.col("transaction_date").desc(), F.col("txn_id").desc())
