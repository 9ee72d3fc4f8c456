import random

import numpy as np
from pyspark.sql import functions as F

from llm.helpers import SMALL, TEXTS, components, documents, shingle_set
from tillbook.llm import minhash
from tillbook.llm.components import connected_components


def expected(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingle_set(t))
    flat = [(i, s) for i, many in sets.items() for s in many if s and i is not None]
    linked = [(a, b) for n, (a, s) in enumerate(flat) for b, t in flat[n + 1:] if 100 * len(s & t) >= 75 * len(s | t)]
    return components([i for i in sets if i is not None], linked)


def check(spark, rows):
    got = minhash.near_duplicates(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    assert got[0].__fields__ == ["doc_id", "n_shingles", "component_id", "kept"]
    want = expected(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id])
    assert sorted(r.n_shingles for r in got) == sorted(len(shingle_set(t)) for _, t in rows)


def test_edge_cases(spark):
    check(spark, TEXTS)


def test_empty_table(spark):
    assert minhash.near_duplicates(documents(spark, [])).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_group_of_near_copies_whose_centre_is_not_the_smallest_id(spark, monkeypatch):
    """Copies that differ from each other more than from their original link through it; buckets larger than a
    block are dealt into tiles."""
    monkeypatch.setattr(minhash, "TILE", 16)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(120)]

    def near():
        words = list(base)
        for _ in range(2):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10 ** 6)}"
        return " ".join(words)
    rows = [(i, near()) for i in range(60)] + [(1000, " ".join(base))] + [(2000 + i, " ".join(base)) for i in range(40)]
    rows += [(3000 + i, " ".join(f"y{rng.randrange(10 ** 6)}" for _ in range(80))) for i in range(20)]
    check(spark, rows)


def test_tile_verifies_every_open_pair():
    """Inside a tile: all links between members of different components, whatever the order."""
    import pyarrow as pa
    rng = np.random.default_rng(2)
    pool = minhash.mix64(np.arange(1, 400, dtype=np.uint64))
    sets = [np.unique(rng.choice(pool[k * 100:k * 100 + 100], 90, replace=False)) for k in (0, 0, 0, 1, 1, 2)]
    sig = [x.tobytes() for x in minhash._minima(sets)]
    table = pa.table({"doc_id": np.arange(6) + 10, "comp": np.arange(6) + 10, "sig": pa.array(sig, pa.binary()),
                      "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})
    links = [tuple(x) for b in minhash._tile_links(table) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    want = [(a + 10, b + 10) for a in range(6) for b in range(a + 1, 6)
            if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))]
    assert components(range(10, 16), links) == components(range(10, 16), want)


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (500, 501), (501, 502), (502, 500)]
    links += [(rng.randrange(600, 700), rng.randrange(600, 700)) for _ in range(60)]
    df = spark.createDataFrame(links + [(None, 3)], "u long, v long")
    ids = {x for p in links for x in p}
    got = {r.id: r.root for r in connected_components(df).collect()}
    assert {i: got.get(i, i) for i in ids} == components(ids, links)
    assert connected_components(df.filter(F.lit(False))).count() == 0
