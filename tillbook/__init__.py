"""tillbook: retail accounting and inventory analytics on Spark DataFrames.

Typical use::

    from tillbook.plans.session import build_session
    from tillbook.sources.adapter import load
    from tillbook.operators import ledger, posting, reports

    spark = build_session()
    t = load(spark, "/path/to/tables")                      # model as lazy DataFrames
    journal = posting.build_journal(t)
    gl = ledger.general_ledger(t["chart_of_accounts"], journal, month=3, year=1997)
    statement = reports.income_statement(t, month=3, year=1997)

Every operator maps DataFrames to DataFrames with built-in Spark functions;
``tillbook.plans.catalog`` registers the named queries used by
``__spark_entry__``.
"""

__version__ = "0.1.0"
