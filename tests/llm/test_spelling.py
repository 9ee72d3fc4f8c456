import collections
import itertools
import random
import re
import zlib

from llm.helpers import LOWER, SMALL, TEXTS, documents
from tillbook.llm import spelling

RUNS = re.compile("[A-Za-zÀ-ÿ]+")


def counted(rows):
    n = collections.Counter()
    for i, text in rows:
        for w in RUNS.findall(text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += len(w) >= 7
    return {w: k for w, k in n.items() if k >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def variants(n):
    """Rows by comparing each word with all words in which some place may be left out or replaced."""
    holes = collections.defaultdict(set)
    for w in n:
        for i in range(len(w) + 1):
            holes[w[:i] + "." + w[i:]].add(w)
            if i < len(w):
                holes[w[:i] + "." + w[i + 1:]].add(w)
    near = collections.defaultdict(set)
    for group in holes.values():
        for a, b in itertools.combinations(group, 2):
            if one_edit(a, b):
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {(w, n[w], form[w], root(w), len(near[w]), n[form[w]] if form[w] else None) for w in n}


def got(df):
    rows = df.collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def test_equals_brute_force_on_the_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    n = counted([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert got(spelling.spelling_variants(docs)) == variants(n)


def test_odd_texts(spark):
    rows = [*TEXTS, (20, "École école ÉCOLE×÷ Straße strasse " * 3), (None, "Abcdefgh abcdefgh"), (21, "abcdefgh's x" * 4)]
    n = counted(rows)
    assert got(spelling.spelling_variants(documents(spark, rows))) == variants(n)
    assert got(spelling.spelling_variants(documents(spark, []).limit(0))) == set()


def test_long_lists_are_split_without_loss(spark, monkeypatch):
    """Words that share one rare bigram at one place, more than a list holds; and chains of forms."""
    monkeypatch.setattr(spelling, "LIST", 20)
    rng = random.Random(5)
    words = {"qz" + "".join(rng.choices("ab", k=rng.randrange(5, 9))) for _ in range(300)} | {"xxxxxxx", "xxxxxxxx", "x" * 300, "x" * 301}
    times = {w: rng.choice([2, 2, 3, 25, 300]) for w in words}
    df = spark.createDataFrame(list(times.items()), "word string, n long")
    pairs = {(r.a.w, r.b.w) for r in spelling.near_pairs(df).collect()}
    assert pairs == {(a, b) for a, b in itertools.combinations(sorted(words), 2) if one_edit(a, b)}
    wanted = {r[0]: r[3] for r in variants(times)}
    forms = spark.createDataFrame([(r[0], r[2]) for r in variants(times) if r[2]], "word string, form string")
    assert {r.word: r.root for r in spelling._roots(forms).collect()} == {r[0]: r[3] for r in variants(times) if r[2]}
    assert any(wanted[r[0]] != r[2] for r in variants(times) if r[2])      # some chains have more than one step


def test_pivots_are_the_lightest_disjoint_pair():
    rng = random.Random(9)
    for _ in range(300):
        word = "".join(rng.choices("abcd", k=rng.randrange(7, 15)))
        held = collections.defaultdict(lambda: rng.randrange(1, 9))
        prefix, pivots = spelling.pivotal_grams(word, held)
        first = sorted((held[word[i:i + 2]], word[i:i + 2], i) for i in range(len(word) - 1))[:3]
        assert set(pivots) <= {g[2] for g in first} <= set(prefix) and pivots[1] - pivots[0] >= 2
        lightest = min(a[0] + b[0] for a, b in itertools.combinations(first, 2) if abs(a[2] - b[2]) >= 2)
        assert sum(held[word[i:i + 2]] for i in pivots) == lightest
