"""What both vector searches share: usable rows, dealing of shards and query blocks, and the tree merge of
per-query top lists."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, zero_too: bool) -> DataFrame:
    """(vec_id, embedding) of rows with an id and a vector of finite components; ``zero_too``: also all-zero ones."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(
        F.col("vec_id").isNotNull() & v.isNotNull() & ~bad)
    return rows if zero_too else rows.filter(F.exists(v, lambda x: x != 0))


def queries_of(rows: DataFrame, is_query: Column) -> DataFrame:
    """The query rows, one for each id (of rows that repeat an id, the smallest vector asks)."""
    return rows.filter(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def matrix(lists: pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """List column -> float64 matrix; shorter vectors are padded with zeros up to the widest (or ``width``)."""
    arr = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], arr.type)
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = arr.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(width, int(sizes.max(initial=0)))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    begin = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - begin[row]] = flat
    return out


def top_lists(query: np.ndarray, row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int, part: int,
              names: list[str]) -> pa.RecordBatch:
    """The best ``k`` entries of each query, as lists; ``row`` names an entry's query."""
    order = np.lexsort((ids, -scores, row))
    row, ids, scores = row[order], ids[order], scores[order]
    begin = np.searchsorted(row, np.arange(len(query)))
    keep = np.arange(len(row)) - begin[row] < k
    row, ids, scores = row[keep], ids[keep], scores[keep]
    cuts = pa.array(np.searchsorted(row, np.arange(len(query) + 1)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(query), pa.array(np.full(len(query), part, np.int32)), pa.ListArray.from_arrays(cuts, pa.array(ids)),
         pa.ListArray.from_arrays(cuts, pa.array(scores))], names)


def merge_top(parts: DataFrame, k: int, shards: int, fan: int = 16) -> DataFrame:
    """Tree merge of (query_id, shard, ids, scores): each level joins ``fan`` lists of ``k`` entries, so no group
    grows with the number of shards.  Returns (query_id, rank, vec_id, score)."""
    best = F.transform(F.arrays_zip("scores", "ids"), lambda e: F.struct((-e["scores"]).alias("s"), e["ids"].alias("id")))
    level = parts.select("query_id", "shard", best.alias("best"))
    for _ in range(max(1, math.ceil(math.log(max(shards, 2), fan)))):
        level = (level.groupBy("query_id", F.floor(F.col("shard") / fan).cast("int").alias("shard"))
                 .agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best")))
    out = level.select("query_id", F.posexplode("best").alias("p", "e"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("e.id").alias("vec_id"),
                      (-F.col("e.s")).alias("score"))
