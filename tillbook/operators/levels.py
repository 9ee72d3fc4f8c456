"""Floored running levels over any number of movements.

A level never goes below zero: ``s <- max(0, s + change)``.  With the running sum ``S_k = opening + sum(change_1..k)``
(``S_0 = opening >= 0``) it has the closed form ``F_k = S_k - min(0, min_{j<=k} S_j)``.  A stretch of movements is
summarised by (total, low): its sum, and the least running sum inside it.  Summaries are associative,

    (t1, l1) + (t2, l2) = (t1 + t2, min(l1, t1 + l2)),

so a scan may cut a key's movements wherever it likes:

1. rows of one *block* (a short prefix of the order, see ``inventory``) give running sums and the block's summary;
2. blocks are dealt by range of (key, block) into *runs* of about ``RUN_ROWS`` blocks, a hot key into as many as it
   needs; a window over a run gives each block its place in the run, and the run its summary;
3. runs have consecutive numbers, so runs of runs are those with the same number divided by ``FAN``, and so on until at
   most ``FAN`` are left.  No window holds more than a run's or ``FAN`` rows, whatever key is hot;
4. from the top down every level hands its offset and earlier minimum to the one below.

Only hot keys are cut: a key of at most ``RUN_ROWS // KEYS_IN_RUN`` rows is one block.  (Cut as well, cold keys would have
about as many blocks as rows, and every step above would move them all again.)

(total, low) of a month is also all that later months need to know of it: ``month_summaries`` are stored beside the
movements, and a month's ledger reads its own movements only (``month_openings``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillbook.plans.session import written

RUN_ROWS = 1 << 20         # blocks of one run
FAN = 1024                 # runs of one run of the next level
KEYS_IN_RUN = 16           # a key with more than this part of a run's rows is cut into blocks


def _before(key: list[str], order: str):
    return Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _placed(summaries: DataFrame, group: list[str], order: str) -> DataFrame:
    """``_off`` and ``_low``: sum, and least level, of the summaries before each one in its group (0 and null first)."""
    w = _before(group, order)
    return (summaries.withColumn("_off", F.coalesce(F.sum("_btot").over(w), F.lit(0)))
            .withColumn("_low", F.min(F.col("_off") + F.col("_bmin")).over(w)))


def _summed(placed: DataFrame, group: list[str]) -> DataFrame:
    """Summary of each group of placed summaries."""
    return placed.groupBy(*group).agg(F.sum("_btot").alias("_btot"), F.min(F.col("_off") + F.col("_bmin")).alias("_bmin"))


def _from_top(summaries: DataFrame, key: str, at: str, count: int) -> DataFrame:
    """``summaries(key, at, _btot, _bmin)`` with ``at`` in 0..count-1 -> (key, at, _above, _least): running sum before each
    of them in its key, and the least one so far (null at the key's first)."""
    if count <= FAN:
        placed = _placed(summaries, [key], at)
        return placed.select(key, at, F.col("_off").alias("_above"), F.col("_low").alias("_least"))
    up = f"{at}_up"        # of its own at every level
    placed = _placed(summaries.withColumn(up, F.floor(F.col(at) / FAN).cast("int")), [key, up], at)
    above = _from_top(_summed(placed, [key, up]), key, up, -(-count // FAN))
    return _handed_down(placed, above, [key, up]).select(key, at, F.col("_off").alias("_above"), F.col("_low").alias("_least"))


def _handed_down(placed: DataFrame, above: DataFrame, on: list[str]) -> DataFrame:
    """Places within runs -> places within keys.  ``least`` leaves nulls out."""
    return (placed.join(above, on).withColumn("_low", F.least("_least", F.col("_above") + F.col("_low")))
            .withColumn("_off", F.col("_above") + F.col("_off")))


def placed_blocks(blocks: DataFrame, key: str, block: str) -> DataFrame:
    """``blocks(key, block, _btot, _bmin)`` with ``_off`` and ``_low``: running sum before each block of its key, and the
    least one so far (null at the key's first), both from zero.

    The narrow block table is written once; only if it holds more than a run's rows it is dealt by range and written
    again with the number of each block's run (a written number does not change when a task is repeated)."""
    blocks = written(blocks.select(key, block, "_btot", "_bmin"), "blocks")
    runs = -(-blocks.count() // RUN_ROWS)
    if runs <= 1:
        return _placed(blocks, [key], block)
    dealt = written(blocks.repartitionByRange(runs, key, block).withColumn("_part", F.spark_partition_id()), "runs")
    placed = _placed(dealt, [key, "_part"], block)
    above = _from_top(_summed(placed, [key, "_part"]), key, "_part", runs)
    return _handed_down(placed, above, [key, "_part"]).select(key, block, "_btot", "_bmin", "_off", "_low")


def _scanned(moves: DataFrame, key: str, block: str | None, order: list, change: str) -> DataFrame:
    """Running sum ``_run`` and its minimum ``_runmin`` inside each block (None: the whole key); ``_last`` marks the block's last row, where the
    two are the block's summary.  (Helper column names are distinct without regard to case: Spark resolves names
    case-insensitively.)"""
    w = (Window.partitionBy(key, block) if block else Window.partitionBy(key)).orderBy(*order)
    w1 = w.rowsBetween(Window.unboundedPreceding, 0)
    return (moves.withColumn("_run", F.sum(change).over(w1)).withColumn("_last", F.lead(F.lit(1)).over(w).isNull())
            .withColumn("_runmin", F.min("_run").over(w1)))


def _ends(rows: DataFrame, key: str, block: str) -> DataFrame:
    """The summary of each block."""
    return rows.filter("_last").select(key, block, F.col("_run").alias("_btot"), F.col("_runmin").alias("_bmin"))


def _hot_keys(moves: DataFrame, key: str) -> DataFrame | None:
    """The keys with more rows than one window should hold (at most one a ``RUN_ROWS // KEYS_IN_RUN`` rows); None without any."""
    counts = moves.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = written(counts.filter(F.col("_n") > RUN_ROWS // KEYS_IN_RUN).select(F.col(key).alias("_hot"), F.lit(True).alias("_cut")), "hot-keys")
    return None if hot.isEmpty() else hot


def _cut(moves: DataFrame, key: str, block: str, hot: DataFrame) -> DataFrame:
    """``moves`` with ``block`` wrapped for hot keys and null for all others, which are one block each; ``_at`` is the
    block as given."""
    marked = moves.withColumn("_at", F.col(block)).join(hot, F.col(key).eqNullSafe(F.col("_hot")), "left")
    return marked.withColumn(block, F.when(F.col("_cut"), F.struct(F.col(block).alias("b")))).drop("_hot", "_cut")


def _floored(total, low):
    return total - F.least(F.lit(0), low)


def floored_ledger(moves: DataFrame, key: str, block: str, order: list, change: str,
                   openings: DataFrame, opening_col: str, level_col: str = "stock_after") -> DataFrame:
    """Every movement with the floored level after it.

    ``block`` is the leading order key inside a ``key``, ``order`` orders rows inside a block; ``openings`` has ``key``
    and ``opening_col`` (non-negative; missing keys open at 0).  The rows are staged once with their place in the block;
    the blocks and the result are read from there."""
    opens = openings.select(key, F.col(opening_col).alias("_open"))
    opening = F.coalesce(F.col("_open"), F.lit(0))

    def uncut(rows: DataFrame) -> DataFrame:
        level = _floored(opening + F.col("_run"), F.least(opening, opening + F.col("_runmin")))
        return rows.join(opens, key, "left").withColumn(level_col, level).drop("_run", "_runmin", "_last", "_open")

    hot = _hot_keys(moves, key)
    if hot is None:
        return uncut(_scanned(moves, key, None, [block, *order], change))
    rows = written(_scanned(_cut(moves, key, block, hot), key, block, ["_at", *order], change), "movements")
    cut = rows.filter(F.col(block).isNotNull())
    blocks = placed_blocks(_ends(cut, key, block), key, block).join(opens, key, "left")
    blocks = blocks.select(F.col(key).alias("_k"), F.col(block).alias("_b"), (opening + F.col("_off")).alias("_boff"),
                           F.least(opening, opening + F.col("_low")).alias("_prevmin"))
    low = F.least(F.col("_prevmin"), F.col("_boff") + F.col("_runmin"))
    out = (cut.join(blocks, F.col(key).eqNullSafe(F.col("_k")) & (F.col(block) == F.col("_b")))
           .withColumn(level_col, _floored(F.col("_boff") + F.col("_run"), low))
           .drop("_run", "_runmin", "_last", "_boff", "_prevmin", "_k", "_b"))
    out = uncut(rows.filter(F.col(block).isNull())).unionByName(out)
    return out.withColumn(block, F.col("_at")).drop("_at")


def _summaries(moves: DataFrame, key: str, block: str, order: list, change: str) -> DataFrame:
    """(key, total, low) of everything a key has; only the columns of the scan are read."""
    needed = moves.select(key, block, *order, change)
    hot = _hot_keys(needed, key)
    if hot is None:
        rows = _scanned(needed, key, None, [block, *order], change)
        return rows.filter("_last").select(key, F.col("_run").alias("total"), F.col("_runmin").alias("low"))
    ends = written(_ends(_scanned(_cut(needed, key, block, hot), key, block, ["_at", *order], change), key, block), "ends")
    uncut = ends.filter(F.col(block).isNull()).select(key, F.col("_btot").alias("total"), F.col("_bmin").alias("low"))
    blocks = placed_blocks(ends.filter(F.col(block).isNotNull()), key, block)
    return uncut.unionByName(blocks.groupBy(key).agg(F.sum("_btot").alias("total"), F.min(F.col("_off") + F.col("_bmin")).alias("low")))


def floored_closing(moves: DataFrame, key: str, block: str, order: list, change: str,
                    openings: DataFrame, opening_col: str, level_col: str = "closing") -> DataFrame:
    """The level after the last movement of every key that has movements, from summaries alone: no movement is joined
    back."""
    ends = _summaries(moves, key, block, order, change)
    opening = F.coalesce(F.col("_open"), F.lit(0))
    return (ends.join(openings.select(key, F.col(opening_col).alias("_open")), key, "left")
            .select(key, _floored(opening + F.col("total"), F.least(opening, opening + F.col("low"))).alias(level_col)))


def month_summaries(moves: DataFrame, key: str, month: str, block: str, order: list, change: str) -> DataFrame:
    """(key, month, total, low) of every key's movements of a month.  ``month`` is a prefix of ``block``'s order; blocks of
    a month are combined like those of a key."""
    ends = _summaries(moves.withColumn("_km", F.struct(key, month)), "_km", block, order, change)
    return ends.select(F.col(f"_km.{key}").alias(key), F.col(f"_km.{month}").alias(month), "total", "low")


def month_openings(summaries: DataFrame, key: str, month: str, openings: DataFrame, opening_col: str, wanted: str) -> DataFrame:
    """(key, opening): the floored level of every key of ``openings`` before the month ``wanted`` ('yyyy-MM'), from the
    summaries of earlier months (undated movements, month null, come first).  A key has one summary a month, so its
    window is bounded by the calendar; the floored level itself is all that is carried on."""
    early = summaries.filter(F.col(month).isNull() | (F.col(month) < wanted))
    w = _before([key], month)
    placed = (early.withColumn("_off", F.coalesce(F.sum("total").over(w), F.lit(0)))
              .groupBy(key).agg(F.sum("total").alias("_t"), F.min(F.col("_off") + F.col("low")).alias("_l")))
    opening = F.col(opening_col)
    level = _floored(opening + F.coalesce("_t", F.lit(0)), F.least(opening, opening + F.col("_l")))
    return openings.join(placed, key, "left").select(key, level.alias("opening"))
