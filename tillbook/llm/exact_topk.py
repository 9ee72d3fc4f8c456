"""Operator 6: exact top-k search by tiled matrix products.

Candidates are dealt into shards of about ``SHARD_ROWS`` rows and queries into blocks of ``BLOCK_ROWS``.  A task
gets one shard and one block, multiplies tiles of them, keeps each query's best entries of the tile, and emits
one list per query; the lists of all shards meet in a tree of bounded merges.  Every pair of a query and a
candidate is scored, and no task holds more than one shard, one block and one tile.

Components become ``floor(64 * x)``; the score is the integer inner product.  Products run in float64 where all
partial sums stay below 2^53 (so they are exact) and in Python integers beyond.  A score that no 64-bit number holds
is an error: the query fails with a message and returns nothing that is not the contract's score.

Edge cases: vectors that are null or hold a null or non-finite component take no part, nor do rows without id;
shorter vectors count as padded with zeros; rows repeating the query's id are its own; a query with fewer than k
candidates gets them all; ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import map_groups
from tillbook.llm.vectors import matrix, merge_top, queries_of, top_lists, usable

SCALE = 64
SHARD_ROWS, BLOCK_ROWS = 8192, 16384
TILE_ROWS = 256            # queries multiplied with a shard at once
NAMES = ["query_id", "shard", "ids", "scores"]
LARGEST = (1 << 63) - 1


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of ``q`` and ``c`` as int64."""
    bound = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1]
    if bound < 1 << 53:
        return (q @ c.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in c]
    scores = [[sum(int(x) * y for x, y in zip(row, other)) for other in whole] for row in q]
    if any(abs(x) > LARGEST for row in scores for x in row):
        raise OverflowError("an integer inner product exceeds 64 bits: scale the vectors down")
    return np.array(scores, np.int64).reshape(len(q), len(c))


def _search(k: int):
    def tile(table: pa.Table) -> Iterator[pa.RecordBatch]:
        asks = pc.equal(table.column("asks"), 1)
        qs, cs = table.filter(asks), table.filter(pc.invert(asks))
        if not qs.num_rows or not cs.num_rows:
            return
        cs = cs.take(pc.sort_indices(cs.column("vec_id")))
        ids = cs.column("vec_id").to_numpy()
        c = np.floor(SCALE * matrix(cs.column("embedding")))
        q = np.floor(SCALE * matrix(qs.column("embedding"), c.shape[1]))
        c = np.pad(c, ((0, 0), (0, q.shape[1] - c.shape[1])))
        query, n, shard = qs.column("vec_id").to_numpy(), len(ids), table.column("shard")[0].as_py()
        for a in range(0, len(q), TILE_ROWS):
            mine = query[a:a + TILE_ROWS]
            scores = _product(q[a:a + TILE_ROWS], c)
            if np.abs(scores).max() < (1 << 61) // n:
                # one number orders by score, then by the smaller id (candidates stand in id order)
                rank = scores * n + (n - 1 - np.arange(n))
                rank[mine[:, None] == ids] = -LARGEST - 1
                at = np.argpartition(-1 - rank, min(k, n) - 1, axis=1)[:, :k]
                row, at = np.repeat(np.arange(len(mine)), at.shape[1]), at.reshape(-1)
            else:
                row, at = np.repeat(np.arange(len(mine)), n), np.tile(np.arange(n), len(mine))
            other = ids[at] != mine[row]
            row, at = row[other], at[other]
            yield top_lists(mine, row, ids[at], scores[row, at], k, shard, NAMES)
    return tile


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the largest integer inner product for every row that
    ``is_query`` (a condition on vec_id) selects."""
    rows = usable(vectors, zero_too=True)
    asked = queries_of(rows, is_query)
    count = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).first()
    shards, blocks = max(1, math.ceil(count["n"] / SHARD_ROWS)), max(1, math.ceil(count["q"] / BLOCK_ROWS))
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select(part(shards).alias("shard"), each(blocks).alias("block"), F.lit(0).alias("asks"), "vec_id", "embedding")
    asking = asked.select(part(blocks).alias("block"), each(shards).alias("shard"), F.lit(1).alias("asks"), "vec_id", "embedding")
    found = map_groups(candidates.unionByName(asking), ["shard", "block"], _search(k),
                       "query_id long, shard int, ids array<long>, scores array<long>", 4 * shards * blocks)
    return merge_top(found, k, shards)
