"""Operator 2 (native): a time-varying curriculum over sources.

Each source has a weight schedule over training time 0..1 (piecewise linear).  The schedule's integral is the
source's weight; weights share ``SHARE`` of all words, a target stops at ``CAP`` times its source's size, and the
excess is shared again by weight.  Within a source, documents stand in the order of a hash, pass after pass; a
document's place in that running count of words, carried through the inverse of the source's cumulative demand,
is its training position.  Output in training order is a range sort by position.

Running counts never gather a source: words are summed per (source, hash bucket), the bucket sums are accumulated
(at most ``BUCKETS`` rows a source), and documents are counted inside their bucket.  Sources are ranked by range
partitions and the partitions' counts.  The level of the re-sharing comes from one-row aggregates.

Everything is DataFrame functions; whole numbers are summed as such, so reruns agree.

Edge cases: a null text has size 0 and is never taken; a null source is a source and comes last; rows that repeat a
doc_id are documents of their own; a table without words has targets 0; an empty table gives an empty result;
extra columns stay (in the mix) or are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbook.llm.common import materialize, pack

WORD = r"[^\x20\x09-\x0D]+"
SHARE, CAP = 1.5, 2
BUCKETS_HEX = 3            # hex digits of a bucket: 4096 buckets a source
SLOTS = 1_000_000          # training time in whole slots
# Schedules by rank of the source, repeating: (time, weight) knots.  They integrate to 5, 2 and 1.
SCHEDULES = [[(0.0, 7.5), (1.0, 2.5)], [(0.0, 2.0), (1.0, 2.0)], [(0.0, 0.5), (1.0, 1.5)]]


def integral(knots: list[tuple[float, float]]) -> float:
    return sum((b - a) * (v + w) / 2 for (a, v), (b, w) in zip(knots, knots[1:]))


def position(share: Column, knots: list[tuple[float, float]]) -> Column:
    """The time at which a schedule's cumulative demand reaches ``share`` (0..1) of its integral."""
    area = share * F.lit(integral(knots))
    out, done = None, 0.0
    for j, ((a, v), (b, w)) in enumerate(zip(knots, knots[1:])):
        rest, slope = area - F.lit(done), (w - v) / (b - a)
        inside = F.when(rest <= 0, F.lit(a)).otherwise(
            F.lit(a) + F.lit(2.0) * rest / (F.lit(v) + F.sqrt(F.greatest(F.lit(v * v) + F.lit(2 * slope) * rest, F.lit(0.0)))))
        done += (b - a) * (v + w) / 2
        last = j == len(knots) - 2
        step = inside if last else F.when(area < F.lit(done), inside)
        out = step if out is None else F.coalesce(out, step)
    return out


def sized(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(row, source, size, key): ``row`` holds the columns ``keep``, ``key`` orders the documents of a source like
    random."""
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    doc = F.coalesce(F.col("row.doc_id").cast("string"), F.lit(""))
    return pack(docs).select(F.struct(*[F.col(f"row.`{c}`").alias(c) for c in keep]).alias("row"),
                             F.col("row.source").cast("string").alias("source"),
                             F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.md5(doc).alias("key"))


def _ranked(sources: DataFrame) -> DataFrame:
    """(source, source_size, nth): place of each source by code point, null last, counted from 0."""
    null = F.col("source").isNull()
    spread = materialize(sources.repartitionByRange(null.asc(), F.col("source").asc())
                         .select("source", "source_size", F.spark_partition_id().alias("part")), "sources")
    here = F.row_number().over(Window.partitionBy("part").orderBy(null, "source")) - 1
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = (spread.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
             .select("part", F.coalesce(before, F.lit(0)).alias("base")))
    return spread.withColumn("here", here).join(parts, "part").select(
        "source", "source_size", (F.col("base") + F.col("here")).alias("nth"))


def targets(sources: DataFrame, schedules: list = SCHEDULES, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, kind, target) from (source, source_size)."""
    kind = F.pmod(F.col("nth"), F.lit(len(schedules))).cast("int")
    weight = F.element_at(F.array(*[F.lit(integral(s)) for s in schedules]), F.col("kind") + 1)
    known = materialize(_ranked(sources).withColumn("kind", kind)
                        .select("source", "source_size", "kind", weight.alias("weight")), "weights")
    limit = F.col("source_size") * cap
    one = known.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    words = share * (one["size"] or 0)
    level, before = words / (one["weight"] or 1.0), None
    while level != before:             # each round stops at least one more source at its cap
        full = limit < F.col("weight") * F.lit(level)
        row = known.agg(F.sum(F.when(full, limit)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        before, level = level, (words - (row["held"] or 0)) / row["weight"] if row["weight"] else level
    return known.select("source", "source_size", "kind",
                        F.least(limit.cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def plan(docs: DataFrame, keep: list[str], schedules: list = SCHEDULES, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(row, size, source_size, target, passes): for each row what each pass over its source takes of it, as
    ``passes`` = array of (taken, slot).  ``row`` holds the columns ``keep``, doc_id among them."""
    rows = sized(docs, keep).withColumn("bucket", F.substring("key", 1, BUCKETS_HEX))
    buckets = materialize(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "buckets")
    per_source = targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), schedules, share, cap)
    earlier = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    base = buckets.select(F.col("source").alias("s1"), F.col("bucket").alias("b1"), F.coalesce(earlier, F.lit(0)).alias("base"))
    per = per_source.select(F.col("source").alias("s2"), "source_size", "kind", "target")
    known = base.join(per, F.col("s1").eqNullSafe(F.col("s2"))).drop("s2")
    inside = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("key", F.col("row.doc_id"), "size")
                                .rowsBetween(Window.unboundedPreceding, -1))
    placed = (rows.withColumn("inside", F.coalesce(inside, F.lit(0)))
              .join(known, F.col("source").eqNullSafe(F.col("s1")) & (F.col("bucket") == F.col("b1"))))
    start = F.col("base") + F.col("inside")
    whole = F.floor("target")
    passes = []
    for p in range(cap):
        at = F.lit(p) * F.col("source_size") + start
        taken = F.greatest(F.lit(0), F.least(F.col("size"), whole - at)).cast("long")
        share_at = F.when(taken > 0, at / whole)
        when = F.lit(None).cast("double")
        for k, knots in enumerate(schedules):
            when = F.when(F.col("kind") == k, position(share_at, knots)).otherwise(when)
        passes.append(F.struct(taken.alias("taken"), F.floor(when * SLOTS).cast("long").alias("slot")))
    return placed.select("row", "size", "source_size", "target", F.array(*passes).alias("passes"))


def mix_report(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_slot) of every row of ``docs``; the slot is -1 for a row
    that the mix does not take.  Rows stand in the order of their first pass, range-partitioned and sorted."""
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda n, p: n + p["taken"])
    report = plan(docs, ["doc_id"]).select(F.col("row.doc_id").cast("long").alias("doc_id"), "size", "source_size", "target",
                             taken.alias("taken"), F.coalesce(F.array_min(F.col("passes.slot")), F.lit(-1)).alias("first_slot"))
    # rows that are not taken share a slot, so their ids spread them
    return report.repartitionByRange("first_slot", "doc_id").sortWithinPartitions("first_slot", "doc_id")


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: each row once for every pass that takes at least half of its words, whole, in training
    order (range-partitioned and sorted by position)."""
    chosen = F.filter("passes", lambda p: (p["taken"] > 0) & (p["taken"] * 2 >= F.col("size")))
    copies = plan(docs, docs.columns).select("row", F.explode(F.transform(chosen, lambda p: p["slot"])).alias("slot"))
    return copies.repartitionByRange("slot").sortWithinPartitions("slot", "row.doc_id").select("row.*")
