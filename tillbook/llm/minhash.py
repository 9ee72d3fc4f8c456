"""Operator 10: MinHash near-duplicate groups.

1. One pass over the texts hashes words and 5-word shingles (vectorised, whole texts) and takes ``ROWS * BANDS``
   universal hash minima per document, plus a 128-bit digest of the full shingle set.
2. Documents with equal sets collapse to one class (its smallest id), so groups of exact copies of any size
   become a single node before any bucket exists.
3. Each class enters one bucket per band.  Only buckets with two or more classes go on.
4. Buckets are verified in three rounds, each skipping what is already connected: every class in its fullest
   bucket; then one class per component in each bucket that still holds several components; then all classes
   of the buckets that remain.  Inside a bucket signatures are compared first, then full shingle sets; members
   already connected are not compared again, so no list of all pairs arises.  A bucket larger than ``TILE``
   is dealt into block tiles, whose blocks meet pairwise, so every pair of blocks is seen and no task holds
   more than two blocks.
5. Links (at most one per component and tile) go to connected components by large-star / small-star.

``MINIMA`` = 128 with 4 rows a band misses a pair of similarity 0.75 with probability (1 - 0.75^4)^32 = 5e-6;
a signature is passed on to exact verification from 0.58 up, 4.4 standard deviations below 0.75.

Edge cases: null or wordless texts have an empty set, link with nothing and are kept; fewer than five words form
one shingle; rows that repeat a doc_id belong to one component; a row without doc_id cannot be named by others:
its component is null and it is kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import (SPACES, WordHasher, column, discard, gathered, map_groups, materialize, mix64, random_words, release_codecs, schema_of,
                                 text_slices)
from tillbook.llm.components import connected_components

WORDS = 5                  # words in a shingle
SHARE = (75, 100)          # linked from 100 * |intersection| >= 75 * |union|
BANDS, ROWS = 32, 4
MINIMA = BANDS * ROWS
PASS_AT = 0.58             # share of equal minima from which a pair is confirmed on full sets
TILE = 2048                # classes of a bucket in one block


def shingles(hasher: WordHasher, data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a slice of documents and, per document, the index of its first one (and the total)."""
    h, _, first = hasher.words(data, offsets)
    weight = random_words(words, 101)
    count = np.diff(first)
    per_doc = np.where(count >= words, count - words + 1, (count > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(per_doc)])
    with np.errstate(over="ignore"):
        n = max(0, len(h) - words + 1)
        window = np.zeros(n, np.uint64)
        for i in range(words):
            window += h[i:i + n] * weight[i]
        out = np.zeros(bounds[-1], np.uint64)
        doc = np.repeat(np.arange(len(count)), per_doc)
        at = first[:-1][doc] + (np.arange(bounds[-1]) - bounds[:-1][doc])
        whole = count[doc] >= words
        out[whole] = window[at[whole]]
        for d in np.flatnonzero((count > 0) & (count < words)):
            part = h[first[d]:first[d + 1]]
            out[bounds[d]] = (part * weight[:len(part)]).sum() + np.uint64(len(part)) * np.uint64(0x2545F4914F6CDD1D)
    return mix64(out), bounds


def _minima(sets: list[np.ndarray]) -> np.ndarray:
    """Universal hash minima (one row of ``MINIMA`` each) of non-empty shingle sets."""
    scale, shift = random_words(MINIMA, 211), random_words(MINIMA, 307)
    flat = np.concatenate(sets)
    begin = np.concatenate([[0], np.cumsum([len(x) for x in sets])[:-1]]).astype(np.int64)
    out = np.zeros((len(sets), MINIMA), np.uint32)
    with np.errstate(over="ignore"):
        x, v = flat >> np.uint64(32), np.empty_like(flat)
        for k in range(MINIMA):
            np.multiply(x, scale[k], out=v)
            v += shift[k]
            out[:, k] = np.minimum.reduceat(v, begin) >> np.uint64(32)
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release_codecs()
    hasher = WordHasher(SPACES)
    for batch in batches:
        for ids, data, offsets in text_slices(column(batch, "doc_id"), column(batch, "text")):
            s, bounds = shingles(hasher, data, offsets)
            docs = len(ids)
            size, d1, d2 = np.zeros(docs, np.int64), np.zeros(docs, np.uint64), np.zeros(docs, np.uint64)
            minima = np.zeros((docs, MINIMA), np.uint32)
            held = np.flatnonzero(np.diff(bounds))
            if len(held):
                with np.errstate(over="ignore"):
                    sets = [np.unique(s[bounds[d]:bounds[d + 1]]) for d in held]
                    size[held] = [len(x) for x in sets]
                    flat = np.concatenate(sets)
                    begin = np.concatenate([[0], np.cumsum(size[held])[:-1]])
                    d1[held] = np.add.reduceat(mix64(flat), begin)
                    d2[held] = np.add.reduceat(mix64(flat ^ np.uint64(0x5851F42D4C957F2D)), begin)
                    minima[held] = _minima(sets)
            rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(MINIMA * 4), docs, [None, pa.py_buffer(minima.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(size), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)),
                 rows.cast(pa.binary())], ["doc_id", "n_shingles", "d1", "d2", "sig"])


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, sig) of every row; ``sig`` holds the minima as little-endian 32-bit numbers."""
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(_signatures, schema_of("doc_id long, n_shingles long, d1 long, d2 long, sig binary")))


def _band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weight, salt = random_words(ROWS, 401), random_words(BANDS, 503)
    for batch in batches:
        ids = column(batch, "doc_id").to_numpy()
        sig = _stack(column(batch, "sig")).astype(np.uint64).reshape(-1, BANDS, ROWS)
        with np.errstate(over="ignore"):
            keys = mix64((sig * weight).sum(axis=2, dtype=np.uint64) + salt).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(ids, BANDS))], ["bucket", "doc_id"])


def _stack(sig: pa.Array | pa.ChunkedArray) -> np.ndarray:
    rows = sig.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint32).reshape(len(rows), MINIMA)


def _set_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signature and full shingle set of each text."""
    release_codecs()
    hasher = WordHasher(SPACES)
    for batch in batches:
        for ids, data, offsets in text_slices(column(batch, "doc_id"), column(batch, "text")):
            s, bounds = shingles(hasher, data, offsets)
            sets = [np.unique(s[a:b]) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([x.tobytes() for x in _minima(sets)], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())],
                ["doc_id", "sig", "shingles"])


def _tile_links(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Links between components that meet in one tile: at most one per component, to the smallest it joins.

    A pivot is compared with every member of another component whose signature comes near; pivots go in the
    order of how many members come near them, so the centre of a group of near copies connects it at once."""
    ids = table.column("doc_id").to_numpy()
    start = table.column("comp").to_numpy()
    n = len(ids)
    if n < 2 or (start == start[0]).all():
        return
    order = np.argsort(ids, kind="stable")
    ids, start = ids[order], start[order]
    names, comp = np.unique(start, return_inverse=True)
    sig = _stack(table.column("sig"))[order]
    least = int(np.ceil(PASS_AT * MINIMA))
    near: list[np.ndarray] = []
    columns = np.ascontiguousarray(sig.T)
    for i in range(n):
        equal = np.zeros(n, np.uint8)
        for c in columns:
            equal += c == c[i]
        equal[i] = 0
        near.append(np.flatnonzero((equal >= least) & (comp != comp[i])))
    sets = table.column("shingles").combine_chunks().take(pa.array(order))
    load = lambda i: np.frombuffer(sets[int(i)].as_py(), np.uint64)
    root = comp.copy()
    for p in sorted(range(n), key=lambda i: (-len(near[i]), i)):
        others = near[p][root[near[p]] != root[p]]
        if not len(others):
            continue
        mine = load(p)
        theirs = [load(i) for i in others]
        sizes = np.array([len(x) for x in theirs])
        flat = np.concatenate(theirs)
        place = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
        both = np.add.reduceat((mine[place] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        for i in others[SHARE[1] * both >= SHARE[0] * (len(mine) + sizes - both)]:
            if root[i] != root[p]:
                root[root == root[i]] = root[p]
    label, first = np.unique(comp, return_index=True)
    group = root[first]
    least = {g: label[group == g].min() for g in np.unique(group)}
    joined = [(a, least[g]) for a, g in zip(label, group) if least[g] != a]
    if joined:
        u, v = np.array(joined).T
        yield pa.RecordBatch.from_arrays([pa.array(names[u]), pa.array(names[v])], ["u", "v"])


def _verify(members: DataFrame, sets: DataFrame, rows: int) -> DataFrame:
    """``members(bucket, doc_id, comp)``, at most ``rows`` -> verified links between components; every bucket is
    dealt into tiles of bounded size."""
    size = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(TILE)).cast("int")
    tiles = (gathered(members.join(size, "bucket"), rows)
             .withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
             .select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                     "doc_id", "comp"))
    return map_groups(tiles.join(sets, "doc_id"), ["bucket", "low", "high"], _tile_links, "u long, v long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = materialize(signatures(docs), "signatures")
    full = base.filter("n_shingles > 0 and doc_id is not null")
    classes = materialize(full.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    reps = (full.select("doc_id", "sig").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
            .distinct())
    bands = reps.mapInArrow(_band_keys, schema_of("bucket long, doc_id long"))
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = materialize(bands.join(shared, "bucket"), "buckets")
    rows = buckets.count()
    in_buckets = docs.join(gathered(buckets.select("doc_id").distinct(), rows), "doc_id", "left_semi").distinct()
    sets = materialize(in_buckets.mapInArrow(_set_bytes, schema_of("doc_id long, sig binary, shingles binary")), "sets")

    # round 1: every class in its fullest bucket
    fullest = (buckets.groupBy("doc_id").agg(F.max_by("bucket", F.struct("n", "bucket")).alias("bucket"))
               .select("bucket", "doc_id", F.col("doc_id").alias("comp")))
    comps = connected_components(_verify(gathered(fullest, rows), sets, rows))
    # rounds 2 and 3: buckets that still hold several components, by one class of each, then by all
    for everyone in (False, True):
        known = (buckets.select("bucket", "doc_id").join(comps.withColumnRenamed("id", "doc_id"), "doc_id", "left")
                 .select("bucket", "doc_id", F.coalesce("root", "doc_id").alias("comp")))
        known = gathered(known, rows)
        mixed = known.groupBy("bucket").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a <> b").select("bucket")
        left = materialize(gathered(known.join(mixed, "bucket", "left_semi"), rows), "left")
        n = left.count()
        if not n:
            break
        if not everyone:
            left = gathered(left.groupBy("bucket", "comp").agg(F.min("doc_id").alias("doc_id")).select("bucket", "doc_id", "comp"), n)
        joined = connected_components(_verify(left, sets, n))
        # links are between component roots: the old roots move, and what hung on them moves along
        moved = joined.select(F.col("id").alias("root"), F.col("root").alias("top"))
        comps = materialize(gathered(comps.join(moved, "root", "left").select("id", F.coalesce("top", "root").alias("root"))
                                     .unionByName(joined), rows), "components")

    discard(sets, buckets)      # the largest tables; what follows reads base, classes and comps only
    rep = F.coalesce("rep", "doc_id")
    out = (base.select("doc_id", "n_shingles", "d1", "d2")
           .join(classes, ["d1", "d2", "n_shingles"], "left")
           .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, rep).otherwise(F.col("doc_id")).alias("rep"))
           .join(comps.select(F.col("id").alias("rep"), "root"), "rep", "left")
           .select("doc_id", "n_shingles", F.coalesce("root", "rep").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
