"""Operator 13: groups of spelling variants by pivotal grams.

1. Words: runs of letters of whole texts, counted on the JVM (``words``).
2. Bigrams are ranked by how many words hold them, the rarest first (at most 90 letters, so 8,100 bigrams).  A word's
   *prefix* is its three first bigrams in that rank, with at most two further places of the third one; its *pivots*
   are the two disjoint bigrams of the first three that the fewest words hold, chosen by dynamic programming.
   One edit changes two bigrams at most and brings in two at most, so of two words one edit apart the one whose third
   bigram ranks lower or equal has a pivot that stands unchanged in the other's prefix.
3. Position limits: a pivot at place p of a word of length l stands at p in a word of length l, at p or p + 1 in one of
   length l + 1, at p or p - 1 in one of length l - 1.  The edit is on one side of the pivot, so the other side up to the
   word's end is equal: pivots are looked up by (side, equal text, length of the other word).
4. A list of a key is joined directly while pivots times prefixes stay within ``LIST``.  A longer list is dealt anew by
   where the edit may stand: the window of unequal text is halved, and one of its halves must be equal too.  This
   repeats until lists are short or the window is one letter, whose list the alphabet bounds.  Nothing is cut.
5. Candidates are verified by edit distance inside the join, so only near pairs leave it.

Results: null texts have no words; a null doc_id counts as an empty one in the checksum; repeated rows count each time;
ties go to the form first in code-point order; an empty table gives an empty result; other columns are ignored.  Words of
any length take part (rows carry the word at most 18 times, never one text per place)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import column, discard, materialize, schema_of

LEAST_LENGTH, LEAST_COUNT = 7, 2
STRONGER = 10              # a form is at least so many times as frequent
RUN = r"[A-Za-zÀ-ÿ]{%d,}" % LEAST_LENGTH       # a shorter run cannot give a word
DROP_ONE_IN = 31
LIST = 10_000              # pivots times prefixes of a list that is joined directly


def words(docs: DataFrame) -> DataFrame:
    """(word, n) of every word of ``LEAST_LENGTH`` code points that occurs ``LEAST_COUNT`` times."""
    run = F.col("run")
    upper = F.translate(run, "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123))))
    # lower() is the quick way where no letter outside A-Z has a lower case
    lowered = F.when(run.rlike("[À-Þ]"), upper).otherwise(F.lower(run))
    text_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    h = F.crc32(F.concat(text_id, F.lit(":"), F.col("run")).cast("binary"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring(run, at + 2, F.length("run")))
    return (docs.select("doc_id", F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
            .select("doc_id", lowered.alias("run")).withColumn("h", h)
            .select(F.when(F.col("h") % DROP_ONE_IN == 0, shorter).otherwise(F.col("run")).alias("word"))
            .filter(F.length("word") >= LEAST_LENGTH)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT))


def pivotal_grams(word: str, held: dict[str, int]) -> tuple[list[int], list[int]]:
    """(places of the prefix bigrams, places of the two pivots); ``held``: words that hold each bigram."""
    ranked = sorted((held[word[i:i + 2]], word[i:i + 2], i) for i in range(len(word) - 1))
    prefix = ranked[:3] + [g for g in ranked[3:5] if g[1] == ranked[2][1]]
    # by place: the lightest choice of k disjoint bigrams that ends at or before each of them
    first = sorted(ranked[:3], key=lambda g: g[2])
    one: list[tuple[int, tuple[int, ...]]] = []
    two: list[tuple[int, tuple[int, ...]]] = []
    for weight, _, i in first:
        before = [c for c in one if c[1][-1] + 2 <= i]
        one.append((weight, (i,)))
        if before:
            lightest = min(before)
            two.append((lightest[0] + weight, (*lightest[1], i)))
    return [g[2] for g in prefix], list(min(two)[1])


def _grams(vocabulary: DataFrame) -> dict[str, int]:
    """Words that hold each bigram: at most 8,100 numbers."""
    places = F.sequence(F.lit(1), F.length("word") - 1)
    each = F.array_distinct(F.transform(places, lambda i: F.substring(F.col("word"), i, F.lit(2))))
    found = vocabulary.select(F.explode(each).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    return {r.g: r.n for r in found.collect()}


def _places(vocabulary: DataFrame) -> DataFrame:
    """(word, n, prefix, pivots) of every word."""
    held = _grams(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pivotal_grams(w, held) for w in column(batch, "word").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "word"), column(batch, "n"), pa.array([p for p, _ in found], pa.list_(pa.int32())),
                 pa.array([v for _, v in found], pa.list_(pa.int32()))], ["word", "n", "prefix", "pivots"])

    return vocabulary.mapInArrow(run, schema_of("word string, n long, prefix array<int>, pivots array<int>"))


def _key() -> Column:
    """Words whose keys are equal share their first ``head`` and last ``tail`` letters (or collide, which verification
    finds).  ``other`` is the length of the prefix word; from level 1 on ``own``, that of the pivot word, belongs to it."""
    return F.xxhash64("own", "other", F.substring(F.col("word"), F.lit(1), F.col("head")),
                      F.substring(F.col("word"), F.length("word") - F.col("tail") + 1, F.col("tail")),
                      F.col("head") > 0, F.col("tail") > 0)


_ROW = ["key", "pivot", "word", "n", "own", "other", "head", "tail"]


def _first_lists(places: DataFrame) -> DataFrame:
    """Level 0: a row per (place, side) of prefix words, per (place, side, length of the other) of pivot words."""
    length = F.length("word")

    def sides(at: Column) -> Column:
        return F.array(F.struct((at + 2).alias("head"), F.lit(0).alias("tail")),
                       F.struct(F.lit(0).alias("head"), (length - at).alias("tail")))

    both = F.array(
        F.struct(F.lit(False).alias("pivot"), F.col("prefix").alias("at"), F.array(length).alias("others")),
        F.struct(F.lit(True).alias("pivot"), F.col("pivots").alias("at"), F.array(length - 1, length, length + 1).alias("others")))
    rows = (places.select("word", "n", F.explode(both).alias("s"))
            .select("word", "n", "s.pivot", "s.others", F.explode("s.at").alias("at"))
            .select("word", "n", "pivot", "others", F.explode(sides(F.col("at"))).alias("e"))
            .select("word", "n", "pivot", F.explode("others").alias("other"), "e.head", "e.tail")
            .withColumn("own", F.lit(0)))
    return rows.withColumn("key", _key()).select(*_ROW)


def _with_own(rows: DataFrame) -> DataFrame:
    """Prefix words take part once for each length that the pivot word may have."""
    own = F.when(F.col("pivot"), F.array(F.length("word"))).otherwise(F.array(F.col("other") - 1, F.col("other"), F.col("other") + 1))
    return rows.withColumn("own", F.explode(own))


def _halved(rows: DataFrame) -> DataFrame:
    """The next level of long lists: the first half of the window is equal, or the second."""
    window = F.least("own", "other") - F.col("head") - F.col("tail")
    half = F.floor(window / 2).cast("int")
    ends = F.array(F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail")),
                   F.struct(F.col("head").alias("head"), (F.col("tail") + window - half).alias("tail")))
    out = (rows.filter(window >= 0).withColumn("e", F.explode(ends))
           .select("word", "n", "pivot", "own", "other", "e.head", "e.tail"))
    return out.withColumn("key", _key()).select(*_ROW)


def _lists(rows: DataFrame, first: bool) -> DataFrame:
    """Rows of the keys that hold a pivot and a prefix of different words, and whether their list is ``long``."""
    halves = F.lit(True) if first else F.max(F.least("own", "other") - F.col("head") - F.col("tail")) > 1
    size = (rows.groupBy("key").agg(
        F.sum(F.col("pivot").cast("long")).alias("pivots"), F.count(F.lit(1)).alias("all"),
        F.min(F.xxhash64("word")).alias("low"), F.max(F.xxhash64("word")).alias("high"), halves.alias("halves"))
        .filter("pivots > 0 and pivots < all and low <> high")
        .select("key", ((F.col("pivots") * (F.col("all") - F.col("pivots")) > LIST) & F.col("halves")).alias("long")))
    return rows.join(size, "key")


def _pairs(rows: DataFrame) -> DataFrame:
    """Near pairs of short lists, the smaller word first."""
    p = rows.filter("pivot").select("key", F.col("word").alias("p"), F.col("n").alias("p_n"), "other")
    s = rows.filter("not pivot").select("key", F.col("word").alias("s"), F.col("n").alias("s_n"))
    near = p.join(s, "key").filter((F.col("p") != F.col("s")) & (F.length("s") == F.col("other"))
                                   & (F.levenshtein("p", "s", 1) == 1))
    ends = F.array_sort(F.array(F.struct(F.col("p").alias("w"), F.col("p_n").alias("n")), F.struct(F.col("s").alias("w"), F.col("s_n").alias("n"))))
    return near.select(ends.alias("e")).select(F.col("e")[0].alias("a"), F.col("e")[1].alias("b")).distinct()


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """``vocabulary(word, n)`` -> each pair of words one edit apart, once: a and b, each (w, n)."""
    level, found, done = _first_lists(_places(vocabulary)), [], []
    while True:
        lists = materialize(_lists(level, not done), "lists")
        found.append(_pairs(lists.filter("not long")))
        rest = lists.filter("long").drop("long")
        if rest.isEmpty():
            break
        level = _halved(rest if done else _with_own(rest))
        done.append(lists)
    out = materialize(reduce(DataFrame.unionByName, found).distinct(), "near")
    discard(lists, *done)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """``forms(word, form)`` -> (word, root): each word's last form.  A form is ``STRONGER`` times as frequent, so chains are
    short; every round doubles the part of a chain that is known."""
    known = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "roots")
    while not known.filter("open").isEmpty():
        onward = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(known.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")), "roots")
        discard(known)
        known = step
    return known.select("word", "root")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """One row per word: word, n, form (its much more frequent near word or null), root (last form of the chain), n_near,
    form_n."""
    vocabulary = materialize(words(docs), "words")
    pairs = near_pairs(vocabulary)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")),
                                          F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e"))
    best = (both.groupBy(F.col("e.x.w").alias("word"))
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("e.y.n")).alias("less"), F.col("e.y.w").alias("w"))).alias("top")))
    strong = -F.col("top.less") >= STRONGER * F.col("n")
    rows = materialize(vocabulary.join(best, "word", "left").select(
        "word", "n", F.when(strong, F.col("top.w")).alias("form"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(strong, -F.col("top.less")).alias("form_n")), "variants")
    roots = _roots(rows.filter("form is not null").select("word", "form"))
    return (rows.join(roots, "word", "left")
            .select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n"))
