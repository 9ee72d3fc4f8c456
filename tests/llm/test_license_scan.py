import random

import pytest

from llm.helpers import ALNUM, LOWER, SMALL, TEXTS, documents
from tillbook.llm import license_scan as scan


def plain(text):
    w = ALNUM.findall((text or "").translate(LOWER))
    base = [(i, label) for p, label in scan.PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    best = [(1.0, label) for _, label in base]
    for label, text_, keys in scan.TEMPLATES:
        t = text_.split()
        needed = {i for k in keys for i in range(next(j for j in range(len(t)) if t[j:j + len(k.split())] == k.split()),
                                                 next(j for j in range(len(t)) if t[j:j + len(k.split())] == k.split()) + len(k.split()))}
        for at in range(-len(t), len(w)):
            equal = [0 <= at + i < len(w) and w[at + i] == x for i, x in enumerate(t)]
            if all(equal[i] for i in needed) and sum(equal) >= scan.ENOUGH * len(t):
                best.append((sum(equal) / len(t), label))
    starts = [i for i, _ in base]
    return (len(w), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})),
            ",".join(sorted({x for _, x in best})), max((s for s, _ in best), default=0.0))


def check(spark, rows):
    got = scan.scan(documents(spark, rows)).collect()
    key = lambda r: str(r)
    assert sorted(map(key, [tuple(r) for r in got])) == sorted(map(key, [(i, *plain(t)) for i, t in rows]))


ODD = [
    (30, "CC BY"), (31, "cc-by cc by"), (32, "ccby c by cc  \n by"), (33, "All rights reserved. all RIGHTS reserved all rights"),
    (34, "GNU General Public License"), (35, "This work is licensed under the GNU General Public License, version 3."),
    (36, "license, version 2.0 Licensed under the Apache License"), (37, "Licensed under the Apache License, Version 2.0."),
    (38, "cc"), (39, "by cc"), (40, "Licensed under CC BY-NC 4.0."), (41, "É cc by É général public license"),
    (42, "under the Apache License, Version 2.0."), (43, "Apache License"), (44, "rights reserved all"),
]


def test_edge_cases(spark):
    check(spark, TEXTS + ODD)
    assert scan.scan(documents(spark, [])).count() == 0


def test_neighbouring_documents_do_not_join(spark):
    check(spark, [(i, "all rights" if i % 2 else "reserved cc") for i in range(40)])


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    check(spark, [(r.doc_id, r.text) for r in docs])


@pytest.mark.parametrize("seed", range(3))
def test_random_licence_words(spark, seed):
    rng = random.Random(seed)
    words = scan.vocabulary(scan.PHRASES, scan.TEMPLATES)
    rows = []
    for i in range(60):
        parts = [rng.choice(words) for _ in range(30)]
        text = rng.choice([*scan.PHRASES, *[t for _, t, _ in scan.TEMPLATES]]).split()
        if rng.random() < 0.5:
            text[rng.randrange(len(text))] = "other"
        parts[10:10] = text
        rows.append((i, rng.choice([" ", "\n", ", ", "-"]).join(parts)))
    check(spark, rows)


def test_rarest_words_become_anchors():
    index = scan.Index({"all": 50, "rights": 3, "reserved": 9}, 100, {"all rights reserved": "reserved"}, [])
    assert index.postings == {"rights": [(0, 1)]}
