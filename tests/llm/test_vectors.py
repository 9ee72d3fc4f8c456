import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.helpers import SMALL
from tillbook.llm import exact_topk, graph_ann
from tillbook.llm.vectors import merge_top


def asks():
    return F.col("vec_id") % 20 == 0

SCHEMA = "vec_id long, embedding array<float>, label int, shard int, block string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 9, "b") for i, v in rows], SCHEMA)


def best(rows, k, value, zero_too):
    usable = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
              and (zero_too or any(v))]
    out = {}
    for q, x in usable:
        if q % 20 == 0:
            scores = sorted((-value(x, y), i) for i, y in usable if i != q)[:k]
            out[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return out


def lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def scaled(x, y):
    return sum(math.floor(64 * a) * math.floor(64 * b) for a, b in zip(x, y))


ODD = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]),
       (6, [float("inf"), 0.0]), (7, [0.0, 0.0]), (8, [-1.0, -0.25]), (9, [2.0]), (20, [0.3, -0.7]), (40, []), (None, [1.0, 1.0])]


def test_exact_edge_cases_and_ties(spark):
    assert lists(exact_topk.exact_top_k(vectors(spark, ODD), asks(), 3)) == best(ODD, 3, scaled, True)
    assert exact_topk.exact_top_k(vectors(spark, []), asks(), 3).count() == 0


def test_exact_beyond_double_precision(spark):
    rows = [(0, [2.0 ** 24 + 2, 3.0]), (1, [2.0 ** 24, 2.0 ** 20]), (2, [2.0 ** 24 + 2, 2.0 ** 19]), (3, [-(2.0 ** 24), 1.0])]
    assert lists(exact_topk.exact_top_k(vectors(spark, rows), asks(), 2)) == best(rows, 2, scaled, True)


def test_exact_over_many_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "SHARD_ROWS", 7)
    monkeypatch.setattr(exact_topk, "BLOCK_ROWS", 3)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(150)]
    assert lists(exact_topk.exact_top_k(vectors(spark, rows), asks(), 5)) == best(rows, 5, scaled, True)


def test_merge_tree_levels(spark):
    rows = [(1, s, [s * 2, s * 2 + 1], [float(s), float(-s)]) for s in range(300)]
    parts = spark.createDataFrame(rows, "query_id long, shard int, ids array<long>, scores array<double>")
    got = [(r["rank"], r.vec_id, r.score) for r in merge_top(parts, 3, 300).orderBy("rank").collect()]
    assert got == [(1, 598, 299.0), (2, 596, 298.0), (3, 594, 297.0)]


def test_graph_edge_cases_copies_and_ties(spark):
    rows = ODD[:-2] + [(100 + i, [0.9, 0.9]) for i in range(60)] + [(None, [1.0, 1.0])]
    plain = lambda x, y: float(sum(np.float32(a) * np.float64(np.float32(b)) for a, b in zip(x, y)))
    got, want = lists(graph_ann.graph_top_k(vectors(spark, rows), asks(), 10)), best(rows, 10, plain, False)
    assert {q: [(r, i) for r, i, _ in v] for q, v in got.items()} == {q: [(r, i) for r, i, _ in v] for q, v in want.items()}
    assert graph_ann.graph_top_k(vectors(spark, []), asks(), 3).count() == 0


def test_graph_recall_over_shards(spark, monkeypatch):
    monkeypatch.setattr(graph_ann, "SHARD_ROWS", 200)
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in table.collect()]
    x = np.array([v for _, v in rows])
    ids = np.array([i for i, _ in rows])
    got = lists(graph_ann.graph_top_k(table, asks(), 20))
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        order = [i for i in np.lexsort((ids, -(x @ x[q]))) if i != q][:20]
        found = got[ids[q]]
        hits += len({ids[i] for i in order} & {i for _, i, _ in found})
        total += len(order)
        for _, i, score in found:
            assert abs(score - x[q] @ x[np.flatnonzero(ids == i)[0]]) < 1e-9
    assert hits >= 0.95 * total


def test_graph_recall_with_unequal_norms(spark):
    """A few vectors 10,000 times as long as the others: lists beyond those few hold the others in right order."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 12)).astype(np.float32).astype(float)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    x = x.astype(np.float32).astype(float)
    x[[7, 11, 13]] *= 1e4
    got = lists(graph_ann.graph_top_k(vectors(spark, [(i, [float(c) for c in v]) for i, v in enumerate(x)]), asks(), 20))
    hits = total = 0
    for q in range(0, len(x), 20):
        order = [i for i in np.lexsort((np.arange(len(x)), -(x @ x[q]))) if i != q][:20]
        hits += len(set(order) & {i for _, i, _ in got[q]})
        total += len(order)
    assert hits >= 0.95 * total


def test_pruning_keeps_diverse_edges():
    """A candidate behind a kept one goes; one in another direction stays."""
    angle = np.array([0.0, 0.1, 0.12, -0.3])
    points = np.stack([np.cos(angle), np.sin(angle)], axis=1).astype(np.float32)
    near = np.array([[1, 2, 3]])
    dist = (2 - 2 * points[near[0]] @ points[0])[None, :]
    assert graph_ann.robust_prune(points, near, dist, 3, 1.2).tolist() == [[1, 3, -1]]


def test_scores_beyond_64_bits_are_refused():
    huge = np.full((1, 2), 2.0 ** 40)
    with pytest.raises(OverflowError):
        exact_topk._product(huge, huge)
    assert exact_topk._product(np.full((1, 2), 2.0 ** 30), np.full((1, 2), 2.0 ** 31)).tolist() == [[1 << 62]]
