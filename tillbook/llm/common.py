"""Helpers shared by the operators: table reads, tables cut from their lineage, keyed groups inside tasks and a
vectorised word hasher.

The word hasher works on the UTF-8 bytes of a slice of documents at once.  A word is a maximal run of word
bytes; both word classes in use consist of whole UTF-8 characters, so bytes decide exactly as characters would.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.plans.session import scratch_dir

SLICE_BYTES = 1 << 20      # text bytes hashed at once; longer single documents form a slice of their own


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.  The lineage ends there: a lost executor
    costs only a re-read of files that all machines see."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark, 'llm')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that no later plan reads."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def gathered(df: DataFrame, rows: int, per_task: int = 250_000) -> DataFrame:
    """``df`` of about ``rows`` small rows in as few tasks as they need (never more than it has)."""
    return df.coalesce(max(12, rows // per_task))


def pack(docs: DataFrame) -> DataFrame:
    """All columns of a row as one struct ``row``, so that no helper column can clash with an extra column."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def schema_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def text_slices(ids: pa.Array, texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Cut one Arrow batch into slices of about ``limit`` text bytes: (ids, bytes, document offsets).  A null
    text counts as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield (ids.slice(first, last - first), data[offsets[first]:offsets[last]],
               offsets[first:last + 1] - offsets[first])
        first = last


_KEPT: list = []           # caches of codecs that a Python worker keeps from task to task


def kept_by_worker(cache):
    """Marks an ``lru_cache`` whose values are large and last as long as a worker runs tasks of one operator."""
    _KEPT.append(cache)
    return cache


def release_codecs() -> None:
    """Give back what other operators' tasks left in this worker: Spark goes on using its Python workers from stage to
    stage.  Called at the start of tasks that need none of it; costs nothing where nothing is kept."""
    held = [c for c in _KEPT if c.cache_info().currsize]
    if held:
        for c in held:
            c.cache_clear()
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)     # the allocator's free pages, where it has the call
        if trim:
            trim(0)


def byte_slices(batches: Iterator[pa.RecordBatch], name: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of the text column ``name``; a longer single text is a batch of
    its own.  Python objects made from a batch stay as small."""
    for batch in batches:
        sizes = pc.binary_length(column(batch, name)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(first, last - first)
            first = last


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply-xorshift)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def random_words(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(seed)) | np.uint64(1)


class WordHasher:
    """64-bit hashes of all words of a slice of documents, without a Python loop over words.

    ``separators``: byte values between words; ``A-Z`` is lower-cased.  A word's hash is a polynomial over
    random per-byte values, so equal words have equal hashes wherever they stand."""

    def __init__(self, separators: bytes, seed: int = 7):
        self.separator = np.zeros(256, bool)
        self.separator[list(separators)] = True
        lower = np.arange(256)
        lower[65:91] += 32
        self.value = random_words(256, seed)[lower]
        self.lower = lower.astype(np.uint8)
        self.base = random_words(1, seed + 1)[0] | np.uint64(5)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, self.base)]))
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, self.inverse)]))

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word byte mask, byte position of each word, first word of each document and the total)."""
        word = ~self.separator[data]
        start = word.copy()
        if len(data):
            start[1:] &= ~word[:-1]
            heads = offsets[:-1][offsets[:-1] < len(data)]
            start[heads] = word[heads]
        begin = np.flatnonzero(start)
        return word, begin, np.searchsorted(begin, offsets)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each word, byte position of each word, first word of each document and the total)."""
        word, begin, first = self.starts(data, offsets)
        if not len(begin):
            return np.zeros(0, np.uint64), begin, first
        self._powers(len(data))
        with np.errstate(over="ignore"):
            part = self.value[data]
            part *= self.up[:len(data)]
            part[~word] = 0
            h = np.add.reduceat(part, begin) * self.down[begin]
            return mix64(h), begin, first

    def words_and_prefixes(self, data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """For each word two hashes in a row, of the word and of its first ``size`` bytes (told apart by a salt),
        and the index of each document's first one (and the total)."""
        h, begin, first = self.words(data, offsets)
        if not len(h):
            return h, first * 2
        word = ~self.separator[data]
        doc_end = offsets[np.searchsorted(first, np.arange(len(begin)), "right")]
        stop = np.minimum(np.append(begin[1:], len(data)), np.minimum(begin + size, doc_end))
        with np.errstate(over="ignore"):
            part = self.value[data]
            part *= self.up[:len(data)]
            part[~word] = 0            # a word shorter than its stop ends at a separator
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part)])
            prefix = mix64((total[stop] - total[begin]) * self.down[begin] + np.uint64(0x632BE59BD9B4E019))
        return np.stack([h, prefix], axis=1).reshape(-1), first * 2


SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str,
               tasks: int | None = None) -> DataFrame:
    """``fn`` on each group of rows with equal ``keys`` (the caller bounds the groups).  One shuffle by the keys
    and a sort; groups share a task's Arrow batches, so thousands of tiny groups cost no call into Spark each.
    ``tasks`` fixes the number of tasks where groups are few but costly (small partitions are not merged then)."""
    out = schema_of(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            changes = np.zeros(batch.num_rows, bool)
            for k in keys:
                v = column(batch, k).to_numpy(zero_copy_only=False)
                changes[1:] |= v[1:] != v[:-1]
            same = bool(held) and all(column(held[-1], k)[-1].as_py() == column(batch, k)[0].as_py() for k in keys)
            if held and not same:
                yield from fn(pa.Table.from_batches(held))
                held = []
            cuts = [0, *np.flatnonzero(changes).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a:
                    yield from fn(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from fn(pa.Table.from_batches(held))

    by = [F.col(k) for k in keys]
    dealt = df.repartition(tasks, *by) if tasks else df.repartition(*by)
    return dealt.sortWithinPartitions(*keys).mapInArrow(run, out)
