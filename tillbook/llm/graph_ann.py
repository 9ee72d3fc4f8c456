"""Operator 1: approximate nearest neighbours (largest inner product) over robust-pruned directed graphs.

Rows are dealt into shards of about ``SHARD_ROWS``.  In each shard a graph is grown by batches: a greedy beam
search from the entry proposes neighbours of the new nodes, and relaxed pruning (``ALPHA`` > 1) keeps a near
candidate only if no kept one lies closer to it by that factor, so edges point in diverse directions; kept edges
are added in reverse too, and full nodes are pruned again.  The graphs are written to the shared folder.  A query
block runs a beam search on every shard; the beam's nodes are scored exactly (float64, original vectors) and the
lists of all shards meet in a tree of bounded merges.

Inner product becomes a distance on the unit sphere by one extra component, sqrt(1 - |x|^2 / M^2) with M the
shard's largest norm.  Beside a norm many times its own a vector would fall to the pole, nearer to all others there
than float32 tells, so norms are split into ranges of a factor of 2^``NORM_BITS`` and shards hold one range each.  Equal vectors of a shard are one node that carries their ids, so a vector repeated by a
third of all rows neither crowds out edges nor hides copies.

Edge cases: vectors that are null, zero, or hold a null or non-finite component take no part, nor do rows without
id; shorter vectors count as padded with zeros; rows repeating the query's id are its own; a query with fewer
than k candidates gets them all that are found; rows that repeat both id and vector count once; ties go to the
smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import map_groups, materialize
from tillbook.llm.vectors import matrix, merge_top, queries_of, top_lists, usable

SHARD_ROWS, BLOCK_ROWS = 8192, 16384
NORM_BITS = 4              # norms from 2^-2 to 2^2 share shards, those from 2^2 to 2^6, ...
DEGREE = 32                # edges of a node
BUILD_BEAM, SEARCH_BEAM = 64, 96
ALPHA = 1.2
BATCH = 512                # nodes inserted, or queries searched, in lockstep
NAMES = ["query_id", "shard", "ids", "scores"]


def beam_search(points: np.ndarray, edges: np.ndarray, targets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nearest nodes that a greedy walk from node 0 meets, nearest first, for each target (in
    lockstep): (nodes, squared distances), with -1 and infinity where it met fewer."""
    b, n = len(targets), len(points)
    nodes = np.full((b, width), -1)
    dist = np.full((b, width), np.inf, np.float32)
    done = np.ones((b, width), bool)
    nodes[:, 0], dist[:, 0], done[:, 0] = 0, 2 - 2 * targets @ points[0], False
    seen = np.zeros((b, n + 1), bool)      # column n: the missing edge
    seen[:, [0, n]] = True
    step = 2                               # nodes expanded at once
    while True:
        live = np.flatnonzero(~done.all(axis=1))
        if not len(live):
            return nodes, dist
        open_ = ~done[live]
        rank = np.cumsum(open_, axis=1)
        take = open_ & (rank <= step)
        row, col = np.nonzero(take)
        done[live[row], col] = True
        slot = rank[row, col] - 1
        near = np.full((len(live), step, edges.shape[1]), n)
        near[row, slot] = edges[nodes[live[row], col]]
        near = near.reshape(len(live), -1)
        near[near < 0] = n
        near = np.where(seen[live[:, None], near], n, near)
        seen[live[:, None], near] = True
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        fresh = near < n
        d = 2 - 2 * np.einsum("ijk,ik->ij", points[np.where(fresh, near, 0)], targets[live])
        all_nodes = np.concatenate([nodes[live], np.where(fresh, near, -1)], axis=1)
        all_dist = np.concatenate([dist[live], np.where(fresh, d, np.inf)], axis=1)
        all_done = np.concatenate([done[live], ~fresh], axis=1)
        best = np.argsort(all_dist, axis=1, kind="stable")[:, :width]
        nodes[live] = np.take_along_axis(all_nodes, best, 1)
        dist[live] = np.take_along_axis(all_dist, best, 1)
        done[live] = np.take_along_axis(all_done, best, 1)


def robust_prune(points: np.ndarray, near: np.ndarray, dist: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of each row's candidates (nearest first, -1 where missing), up to ``degree`` diverse ones: a kept candidate
    removes those that lie closer to it, by the factor ``alpha``, than to the row's own node."""
    out = np.full((len(near), degree), -1)
    for a in range(0, len(near), 256):
        c, d = near[a:a + 256], dist[a:a + 256]
        x = points[np.maximum(c, 0)]
        between = 2 - 2 * x @ x.transpose(0, 2, 1)
        alive = c >= 0
        row = np.arange(len(c))
        for slot in range(degree):
            best = alive.argmax(axis=1)
            has = alive[row, best]
            if not has.any():
                break
            out[a:a + 256, slot] = np.where(has, c[row, best], -1)
            alive &= ~(has[:, None] & (alpha * alpha * between[row, best] <= d))
            alive[row, best] &= ~has
    return out


def _add_reverse(points: np.ndarray, edges: np.ndarray, sources: np.ndarray) -> None:
    target = edges[sources].reshape(-1)
    source = np.repeat(sources, edges.shape[1])[target >= 0]
    target = target[target >= 0]
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    hit, begin, count = np.unique(target, return_index=True, return_counts=True)
    wide = np.full((len(hit), edges.shape[1] + int(count.max(initial=0))), -1)
    wide[:, :edges.shape[1]] = edges[hit]
    row = np.repeat(np.arange(len(hit)), count)
    wide[row, edges.shape[1] + np.arange(len(target)) - begin[row]] = source
    d = np.where(wide >= 0, 2 - 2 * np.einsum("ijk,ik->ij", points[np.maximum(wide, 0)], points[hit]), np.inf)
    order = np.argsort(d, axis=1, kind="stable")
    wide, d = np.take_along_axis(wide, order, 1), np.take_along_axis(d, order, 1)
    double = np.zeros(wide.shape, bool)    # an edge that exists already
    for c in range(1, wide.shape[1]):
        double[:, c] = (wide[:, :c] == wide[:, c:c + 1]).any(axis=1) & (wide[:, c] >= 0)
    wide[double], d[double] = -1, np.inf
    order = np.argsort(d, axis=1, kind="stable")
    wide, d = np.take_along_axis(wide, order, 1), np.take_along_axis(d, order, 1)
    fits = (wide >= 0).sum(axis=1) <= edges.shape[1]
    edges[hit[fits]] = wide[fits, :edges.shape[1]] if wide.shape[1] >= edges.shape[1] else edges[hit[fits]]
    if (~fits).any():
        most = 2 * edges.shape[1]          # the nearest ones are enough to choose from
        edges[hit[~fits]] = robust_prune(points, wide[~fits, :most], d[~fits, :most], edges.shape[1], ALPHA)


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> np.ndarray:
    """Edges (n x degree, -1 where missing) of a graph over unit vectors; node 0 is the entry."""
    n = len(points)
    edges = np.full((n, degree), -1)
    seed = min(n, degree + 1)
    for i in range(seed):
        edges[i, :seed - 1] = np.delete(np.arange(seed), i)
    done = seed
    while done < n:
        new = np.arange(done, min(n, done + min(BATCH, max(32, done))))
        near, dist = beam_search(points, edges, points[new], beam)
        edges[new] = robust_prune(points, near, dist, degree, alpha)
        _add_reverse(points, edges, new)
        done += len(new)
    return edges


def on_sphere(x: np.ndarray) -> np.ndarray:
    """Vectors as unit vectors of one more component whose distances order like inner products with a query."""
    norm = np.sqrt((x * x).sum(axis=1))
    most = norm.max(initial=0) or 1.0
    rest = np.sqrt(np.maximum(0, 1 - (norm / most) ** 2))
    return np.concatenate([x / most, rest[:, None]], axis=1).astype(np.float32)


def _build(table: pa.Table) -> Iterator[pa.RecordBatch]:
    x, owner = np.unique(matrix(table.column("embedding")), axis=0, return_inverse=True)
    ids = table.column("vec_id").to_numpy()
    points = on_sphere(x)
    order = np.random.default_rng(len(x)).permutation(len(x))
    middle = int(np.argmax(points @ points.mean(axis=0)))
    order = np.concatenate([[middle], order[order != middle]])
    edges = build_graph(points[order])
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    node = place[owner.reshape(-1)]
    by = np.lexsort((ids, node))
    by = by[np.concatenate([[True], (np.diff(node[by]) != 0) | (np.diff(ids[by]) != 0)])]
    cuts = np.searchsorted(node[by], np.arange(len(x) + 1)).astype(np.int32)
    n, width = len(x), x.shape[1]
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, table.column("shard")[0].as_py(), np.int32)), pa.array(np.arange(n, dtype=np.int32)),
         pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids[by])),
         pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(x[order].reshape(-1))),
         pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * DEGREE), pa.array(edges.astype(np.int32).reshape(-1)))],
        ["shard", "node", "ids", "embedding", "edges"])


def _search(k: int, beam: int):
    def block(table: pa.Table) -> Iterator[pa.RecordBatch]:
        asks = pc.equal(table.column("node"), -1)
        qs, index = table.filter(asks), table.filter(pc.invert(asks))
        if not qs.num_rows or not index.num_rows:
            return
        index = index.take(pc.sort_indices(index.column("node")))
        x = matrix(index.column("embedding"))
        q = matrix(qs.column("embedding"), x.shape[1])
        x = np.pad(x, ((0, 0), (0, q.shape[1] - x.shape[1])))
        points = on_sphere(x)
        edges = index.column("edges").combine_chunks().flatten().to_numpy().reshape(len(x), DEGREE)
        lists = index.column("ids").combine_chunks()
        ids, cuts = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        unit = np.concatenate([q / np.sqrt((q * q).sum(axis=1))[:, None], np.zeros((len(q), 1))], axis=1).astype(np.float32)
        query, shard = qs.column("vec_id").to_numpy(), table.column("shard")[0].as_py()
        for a in range(0, len(q), BATCH):
            mine = query[a:a + BATCH]
            nodes, _ = beam_search(points, edges, unit[a:a + BATCH], beam)
            row, col = np.nonzero(nodes >= 0)
            node = nodes[row, col]
            score = np.einsum("ij,ij->i", x[node], q[a:a + BATCH][row])
            # of a node's copies, in id order, more than k besides the query's own can't enter its list
            copies = np.minimum(cuts[node + 1] - cuts[node], k + 1)
            nth = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
            row, score, found = np.repeat(row, copies), np.repeat(score, copies), ids[np.repeat(cuts[node], copies) + nth]
            other = found != mine[row]
            yield top_lists(mine, row[other], found[other], score[other], k, shard, NAMES)
    return block


def build_index(vectors: DataFrame) -> tuple[DataFrame, int]:
    """The graphs of all shards, written to the shared folder, as (shard, node, ids, embedding, edges), and the
    number of shards.  Every usable row is in the index."""
    biggest = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + (x / F.col("biggest")) * (x / F.col("biggest")))
    bits = F.log2("biggest") + F.log2(square) / 2
    rows = (usable(vectors, zero_too=False).withColumn("biggest", biggest)
            .withColumn("span", F.floor(bits / NORM_BITS + 0.5).cast("int")).drop("biggest"))
    # doubles have at most 2,100 / NORM_BITS ranges
    counts = {r["span"]: r["n"] for r in rows.groupBy("span").agg(F.count(F.lit(1)).alias("n")).collect()}
    first, many, shards = [], [], 0
    for span, n in sorted(counts.items()):
        own = max(1, math.ceil(n / SHARD_ROWS))
        first += [F.lit(span), F.lit(shards)]
        many += [F.lit(span), F.lit(own)]
        shards += own
    shards = max(1, shards)
    at = lambda pairs: F.element_at(F.create_map(*pairs), F.col("span")) if pairs else F.lit(1)
    dealt = rows.withColumn("shard", (at(first) + F.pmod(F.xxhash64("vec_id"), at(many))).cast("int")).drop("span")
    index = map_groups(dealt, ["shard"], _build,
                       "shard int, node int, ids array<long>, embedding array<double>, edges array<int>", 4 * shards)
    return materialize(index, "graphs"), shards


def graph_top_k(vectors: DataFrame, is_query: Column, k: int = 20, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for every row that ``is_query`` selects."""
    index, shards = build_index(vectors)
    asked = queries_of(usable(vectors, zero_too=False), is_query)
    blocks = max(1, math.ceil(asked.count() / BLOCK_ROWS))
    graphs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("vec_id", F.lit(None).cast("long"))
    asking = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(-1).alias("node"),
        F.lit(None).cast("array<long>").alias("ids"), F.col("embedding").cast("array<double>").alias("embedding"),
        F.lit(None).cast("array<int>").alias("edges"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id")
    found = map_groups(graphs.unionByName(asking), ["shard", "block"], _search(k, beam),
                       "query_id long, shard int, ids array<long>, scores array<double>", 4 * shards * blocks)
    return merge_top(found, k, shards)
