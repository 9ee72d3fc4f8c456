"""Operator 9: severity of toxicity by cumulative-link ordinal regression.

Grades 0..3 are ordered; P(grade > j) = sigmoid(w.x - theta_j) with one weight vector for all thresholds and
theta_0 < theta_1 < theta_2.  Features are sparse: log(1 + rate) of single words and of word beginnings (``PREFIX``
bytes, so that inflected forms share a feature), named by 64-bit hashes.  The rate is the occurrences in ``PER`` words,
or all of them in a shorter text, so that chance mentions do not add up with a text's length.

The labels only say toxic or not.  Their grade is 0 for clean rows; toxic rows are graded by thirds of how many
features they hold, by the same rate, that mark toxic rows (its share of toxic rows exceeds its share of clean rows
by ``Z`` standard errors and ``TIMES`` times).  Only marking features enter the model.

The P(toxic) from which a document is rejected comes from held-out labelled rows: words and weights are fitted on
each half of the sample and score the other one, and of all thresholds from ``REJECT_AT`` up the one is taken that
has the largest share of toxic rows found less ``CLEAN_LOSS`` times the share of clean rows lost.

The model is fitted on a bounded sample of labelled documents, ``SAMPLE`` of each label, drawn by a hash of doc_id;
of rows that repeat a doc_id the smallest text counts.
Scoring reads every whole text once.  The output is the expected grade, the most probable one and P(toxic).

Edge cases: null and wordless texts hold no features; without labelled rows of both kinds, or without a marking
word, nothing is known and every severity is 0; of a doc_id labelled twice the larger label counts, labels that
are null or not 0/1 don't; an empty table gives an empty result; extra columns stay or are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import NOT_ALNUM, WordHasher, column, materialize, release_codecs, schema_of, text_slices

SAMPLE = {1: 4000, 0: 8000}            # labelled rows the model is fitted on, at most, by label
SAMPLE_TASKS = 48                      # a few hundred of them each
MAX_FEATURES = 4096                    # the most telling words
PREFIX = 5                             # bytes of a word's beginning
Z, TIMES = 5.0, 8.0                    # how clearly a feature marks toxic rows
GRADES = 4
PER = 200                              # words a rate refers to
FOLDS = 2
REJECT_AT = 0.5                        # least P(toxic) from which a document is rejected
CLEAN_LOSS = 10.0                      # a share of clean rows lost counts as so large a share of toxic rows missed
RIDGE, STEPS, RATE = 2e-5, 500, 0.1


@dataclass
class Model:
    words: np.ndarray                  # sorted hashes of the feature words
    weights: np.ndarray
    thresholds: np.ndarray
    reject_at: float = REJECT_AT

    def predict(self, eta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(expected grade, most probable grade, P(grade > 0)) at each linear score."""
        above = _sigmoid(eta[:, None] - self.thresholds)
        each = -np.diff(np.concatenate([np.ones((len(eta), 1)), above, np.zeros((len(eta), 1))], axis=1), axis=1)
        return above.sum(axis=1), each.argmax(axis=1), above[:, 0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _occurrences(words: np.ndarray, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, occurrences) of the feature words among the hashed words of a slice."""
    if not len(words) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    hit = np.flatnonzero(words[at] == h)
    doc = np.searchsorted(first, hit, "right") - 1
    pair, n = np.unique(doc * len(words) + at[hit], return_counts=True)
    return pair // len(words), pair % len(words), n


def _rates(n: np.ndarray, doc: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Occurrences per ``PER`` words; ``words`` are those of each document."""
    return n * np.minimum(1.0, PER / np.maximum(words[doc], 1))


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct features of each labelled text."""
    release_codecs()
    hasher = WordHasher(NOT_ALNUM)
    for batch in batches:
        named = pa.StructArray.from_arrays([column(batch, "toxic"), column(batch, "fold")], ["toxic", "fold"])
        for rows, data, offsets in text_slices(named, column(batch, "text")):
            h, first = hasher.words_and_prefixes(data, offsets, PREFIX)
            flags, folds = (x.to_numpy() for x in rows.flatten())
            for d in range(len(flags)):
                own = np.unique(h[first[d]:first[d + 1]]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), flags[d], np.int32)),
                                                  pa.array(np.full(len(own), folds[d], np.int32))], ["word", "toxic", "fold"])


def _feature_rows(words: np.ndarray):
    """One row per labelled text: its words, features and their occurrences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_codecs()
        hasher = WordHasher(NOT_ALNUM)
        for batch in batches:
            names = ["doc_id", "toxic", "fold"]
            named = pa.StructArray.from_arrays([column(batch, c) for c in names], names)
            for rows, data, offsets in text_slices(named, column(batch, "text")):
                h, first = hasher.words_and_prefixes(data, offsets, PREFIX)
                doc, feature, n = _occurrences(words, h, first)
                cuts = pa.array(np.searchsorted(doc, np.arange(len(rows) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*rows.flatten(), pa.array(np.diff(first).astype(np.int32) // 2), pa.ListArray.from_arrays(cuts, pa.array(feature.astype(np.int32))),
                     pa.ListArray.from_arrays(cuts, pa.array(n.astype(np.int32)))], [*names, "words", "features", "counts"])
    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> DataFrame:
    """(doc_id, toxic, text) of at most ``sample[label]`` labelled documents of each label, chosen by a hash of doc_id:
    one row each, with its smallest text."""
    known = (labels.filter("doc_id is not null and toxic in (0, 1)")
             .groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max("toxic").cast("int").alias("toxic")))
    drawn = [known.filter(F.col("toxic") == label).orderBy(F.xxhash64("label_id"), "label_id").limit(n) for label, n in sample.items()]
    ids = drawn[0]
    for more in drawn[1:]:
        ids = ids.unionByName(more)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most sum(sample) pairs of numbers are broadcast
    one = texts.join(F.broadcast(ids), texts.doc_id == ids.label_id).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    # small partitions would be merged, and a Python worker hold thousands of texts at once
    return one.repartition(SAMPLE_TASKS, "doc_id")


def _marking(held: DataFrame, folds: list[int], size: dict) -> np.ndarray:
    """Sorted hashes of the words that mark toxic rows of the folds."""
    n = {label: sum(size.get((label, f), 0) for f in folds) for label in (0, 1)}
    if not n[0] or not n[1]:
        return np.zeros(0, np.uint64)
    t, c = (sum((F.col(f"{kind}{f}") for f in folds), F.lit(0)) for kind in "tc")
    p, q = t / n[1], c / n[0]
    pooled = (t + c) / (n[0] + n[1])
    z = (p - q) / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-9)) * (1 / n[0] + 1 / n[1]))
    marked = held.withColumn("z", z).filter((F.col("z") >= Z) & (p >= q * TIMES)).orderBy(F.desc("z"), "word").limit(MAX_FEATURES)
    return np.sort(np.array([r["word"] for r in marked.select("word").collect()], np.int64).view(np.uint64))


def fit(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> Model:
    fold = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int")
    rows = materialize(labelled_sample(docs, labels, sample).withColumn("fold", fold), "labelled")
    size = {(r["toxic"], r["fold"]): r["n"] for r in rows.groupBy("toxic", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    none = Model(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES - 1, np.inf))
    if len({label for label, _ in size}) < 2:
        return none
    held = rows.mapInArrow(_word_rows, schema_of("word long, toxic int, fold int")).groupBy("word").agg(
        *[F.count_if((F.col("toxic") == label) & (F.col("fold") == f)).alias(f"{kind}{f}")
          for kind, label in (("t", 1), ("c", 0)) for f in range(FOLDS)])
    held = materialize(held, "held")
    words = _marking(held, list(range(FOLDS)), size)
    if not len(words):
        return none
    others = [_marking(held, [g for g in range(FOLDS) if g != f], size) for f in range(FOLDS)]
    known = np.unique(np.concatenate([words, *others]))
    table = rows.mapInArrow(_feature_rows(known), schema_of(
        "doc_id long, toxic int, fold int, words int, features array<int>, counts array<int>")).toArrow()
    table = table.sort_by("doc_id")        # sums must not depend on the order in which rows arrive
    toxic, fold, length = (table.column(c).to_numpy() for c in ("toxic", "fold", "words"))
    lists = table.column("features").combine_chunks()
    doc = np.repeat(np.arange(len(toxic)), lists.value_lengths().to_numpy())
    feature = lists.flatten().to_numpy()
    rate = _rates(table.column("counts").combine_chunks().flatten().to_numpy(), doc, length)

    def part(own: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, feature, rate) of the words ``own`` in the rows ``chosen``, both numbered anew."""
        at = np.minimum(np.searchsorted(own, known), max(0, len(own) - 1))
        mine = own[at] == known
        use = mine[feature] & chosen[doc]
        return (np.cumsum(chosen) - 1)[doc[use]], at[feature[use]], rate[use]

    every = np.ones(len(toxic), bool)
    model = _fit(words, toxic, *part(words, every))
    p = np.full(len(toxic), np.nan)
    for f, own in enumerate(others):
        if len(own):
            trial = _fit(own, toxic[fold != f], *part(own, fold != f))
            doc_, feature_, rate_ = part(own, fold == f)
            p[fold == f] = trial.predict(np.bincount(doc_, np.log1p(rate_) * trial.weights[feature_], (fold == f).sum()))[2]
    scored = ~np.isnan(p)
    model.reject_at = threshold(p[scored], toxic[scored])
    return model


def threshold(p: np.ndarray, toxic: np.ndarray) -> float:
    """The P(toxic) from ``REJECT_AT`` up, midway between two held-out rows, that weighs best."""
    high = np.unique(p[p >= REJECT_AT])
    ts = np.concatenate([[REJECT_AT], (high[1:] + high[:-1]) / 2])
    found, lost = (1 - np.searchsorted(np.sort(p[toxic == label]), ts) / max(1, (toxic == label).sum()) for label in (1, 0))
    return float(ts[np.argmax(found - CLEAN_LOSS * lost)])


def _fit(words: np.ndarray, toxic: np.ndarray, doc: np.ndarray, feature: np.ndarray, rate: np.ndarray) -> Model:
    value = np.log1p(rate)
    hits = np.bincount(doc, rate, len(toxic))
    cuts = np.quantile(hits[toxic == 1], np.arange(1, GRADES - 1) / (GRADES - 1))
    grade = np.where(toxic == 1, 1 + (hits[:, None] > cuts).sum(axis=1), 0)
    n, k = len(grade), len(words)
    w, theta = np.zeros(k), np.array([0.5, 1.5, 2.5])[:GRADES - 1]
    higher = (grade[:, None] > np.arange(GRADES - 1)).astype(float)
    share = np.where(grade > 0, 0.5 / max(1, (grade > 0).sum()), 0.5 / max(1, (grade == 0).sum()))
    m, v = np.zeros(k + GRADES - 1), np.zeros(k + GRADES - 1)
    for step in range(1, STEPS + 1):
        eta = np.bincount(doc, value * w[feature], n)
        # each threshold is a logistic model of "graded above it"; together they share w
        wrong = (_sigmoid(eta[:, None] - theta) - higher) * share[:, None]
        slope = np.concatenate([np.bincount(feature, value * wrong.sum(axis=1)[doc], k) + RIDGE * w, -wrong.sum(axis=0)])
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
        move = RATE * m / (1 - 0.9 ** step) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
        w, theta = w - move[:k], np.sort(theta - move[k:])
    return Model(words, w, theta)


def severity(text: Column, model: Model) -> Column:
    """Struct (severity, grade, p_toxic, toxic) of a text column."""
    @F.arrow_udf("severity double, grade int, p_toxic double, toxic boolean")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release_codecs()
        hasher = WordHasher(NOT_ALNUM)
        for text in texts:
            eta = []
            for part, data, offsets in text_slices(text, text):
                h, first = hasher.words_and_prefixes(data, offsets, PREFIX)
                doc, feature, n = _occurrences(model.words, h, first)
                rate = _rates(n, doc, np.diff(first) // 2)
                eta.append(np.bincount(doc, np.log1p(rate) * model.weights[feature], len(part)))
            expected, grade, p = model.predict(np.concatenate(eta) if eta else np.zeros(0))
            yield pa.StructArray.from_arrays(
                [pa.array(expected), pa.array(grade.astype(np.int32)), pa.array(p), pa.array(p >= model.reject_at)],
                ["severity", "grade", "p_toxic", "toxic"])
    return score(text.cast("string"))


def grade_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, severity, grade, p_toxic, toxic) of every row of ``docs``."""
    model = fit(docs, labels)
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), severity(F.col("text"), model).alias("s"))
            .select("doc_id", "s.severity", "s.grade", "s.p_toxic", "s.toxic"))
