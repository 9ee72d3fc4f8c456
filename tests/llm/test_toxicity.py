import random

import numpy as np
from pyspark.sql import functions as F

from llm.helpers import TEXTS, documents
from tillbook.llm import toxicity

BAD = ["vileword", "nastyword", "uglyword"]


def corpus(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(2000)}" for _ in range(60)]
        toxic = i % 4 == 0
        for _ in range(rng.randrange(1, 12) if toxic else 0):
            words[rng.randrange(60)] = rng.choice(BAD) + rng.choice(["", "s", "ish"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def frame(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows_are_graded_by_severity(spark):
    rows, labels = corpus(1200, 1)
    got = toxicity.grade_documents(documents(spark, rows), frame(spark, labels[:600])).collect()
    truth = dict((i, t) for i, _, t in labels)
    held = [r for r in got if r.doc_id >= 600]
    assert sum(r.toxic == bool(truth[r.doc_id]) for r in held) >= 0.99 * len(held)
    text = dict(rows)
    hits = np.array([sum(text[r.doc_id].count(b) for b in BAD) for r in held])
    severity = np.array([r.severity for r in held])
    means = [severity[(hits >= a) & (hits < b)].mean() for a, b in ((0, 1), (1, 4), (4, 8), (8, 12))]
    assert means == sorted(means) and means[0] < 0.3 and means[-1] > 2
    assert all(0 <= r.severity <= 3 and 0 <= r.grade <= 3 for r in got)


def test_edge_cases(spark):
    rows, labels = corpus(300, 2)
    labels += [(5, 1, None), (7, 1, 9), (None, 1, 1), (8, 1, 0), (8, 1, 1), (10 ** 6, 0, 1)]
    got = toxicity.grade_documents(documents(spark, rows + TEXTS), frame(spark, labels)).collect()
    assert len(got) == 300 + len(TEXTS)
    plain = [r for r in got if r.doc_id is None]
    assert not plain[0].toxic
    same = {(r.severity, r.toxic) for r in got if r.doc_id == 5 and not r.toxic}
    assert len(same) <= 2
    assert toxicity.grade_documents(documents(spark, []), frame(spark, labels)).count() == 0


def test_nothing_known_without_both_labels(spark):
    rows, labels = corpus(40, 3)
    for known in ([], [x for x in labels if x[2]], [x for x in labels if not x[2]]):
        got = toxicity.grade_documents(documents(spark, rows), frame(spark, known)).collect()
        assert {(r.severity, r.grade, r.toxic) for r in got} == {(0.0, 0, False)}


def test_sample_is_bounded_and_repeatable(spark):
    rows, labels = corpus(400, 4)
    docs, known = documents(spark, rows), frame(spark, labels)
    one = toxicity.labelled_sample(docs, known, {1: 30, 0: 50}).groupBy("toxic").count().collect()
    assert {r.toxic: r["count"] for r in one} == {1: 30, 0: 50}
    a, b = (toxicity.fit(d, known) for d in (docs, docs.repartition(7)))
    assert np.array_equal(a.words, b.words) and np.array_equal(a.weights, b.weights) and np.array_equal(a.thresholds, b.thresholds)


def test_thresholds_are_ordered_and_probabilities_sum_up():
    model = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), np.array([0.5, 1.0, 4.0]))
    expected, grade, p = model.predict(np.array([-9.0, 0.7, 2.0, 9.0]))
    assert grade.tolist() == [0, 2, 2, 3] or grade.tolist()[0] == 0 and grade.tolist()[-1] == 3
    assert (np.diff(expected) > 0).all() and ((p > 0) & (p < 1)).all()


def test_long_clean_texts_with_chance_mentions_stay(spark):
    """A word that marks toxic rows is met by chance once in 500 words of any text; long texts hold several."""
    rows, labels = corpus(1200, 5)
    rng = random.Random(6)
    clean = []
    for i in range(60):
        words = [f"w{rng.randrange(2000)}" for _ in range(2500)]
        for _ in range(5):
            words[rng.randrange(2500)] = rng.choice(BAD)
        clean.append((5000 + i, " ".join(words)))
    toxic = [(6000 + i, " ".join(rng.choice(BAD) if rng.random() < 0.05 else f"w{rng.randrange(2000)}" for _ in range(2500)))
             for i in range(20)]
    got = {r.doc_id: r.toxic for r in toxicity.grade_documents(documents(spark, rows + clean + toxic), frame(spark, labels)).collect()}
    assert not any(got[i] for i, _ in clean) and all(got[i] for i, _ in toxic)


def test_threshold_weighs_clean_rows_kept():
    p = np.array([0.1] * 97 + [0.6, 0.62, 0.7] + [0.65] + [0.9] * 9)
    label = np.array([0] * 100 + [1] * 10)
    assert 0.7 < toxicity.threshold(p, label) < 0.9
    assert toxicity.threshold(p[3:97], label[3:97]) == toxicity.REJECT_AT
    # a clean row scored among the toxic ones does not cost most of them
    assert toxicity.threshold(np.append(p, 0.95), np.append(label, 0)) < 0.9


def test_sample_holds_one_row_of_a_repeated_doc_id(spark):
    rows, labels = corpus(400, 7)
    rows += [rows[3]] * 200 + [(4, f"zz other text {i}") for i in range(200)] + [(9, None)]
    docs, known = documents(spark, rows), frame(spark, labels)
    got = toxicity.labelled_sample(docs, known, {1: 30, 0: 50}).collect()
    assert len(got) == len({r.doc_id for r in got}) == 80
    every = {r.doc_id: r.text for r in toxicity.labelled_sample(docs, known).collect()}
    assert len(every) == 400 and all(every[i] == min(t for j, t in rows if j == i and t is not None) for i in (3, 4, 9))
    a, b = (toxicity.fit(documents(spark, x), known) for x in (rows[:400], rows[:400] + [rows[3]] * 200))
    assert np.array_equal(a.words, b.words) and np.array_equal(a.weights, b.weights) and a.reject_at == b.reject_at
