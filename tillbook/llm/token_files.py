"""Operator 7: token-id files with Elias-Fano encoded document boundaries.

Documents are range-partitioned by doc_id; each partition writes one shard file to the shared folder:

    magic  "TBK1"              4 bytes
    header  4 x uint64         documents n, ids u, bits of a low part l, bytes per id (2 or 4)
    ids     u little-endian    the documents' ids, one after the other
    lows    n+1 low parts of l bits, packed
    highs   bit vector of n+1 + (u >> l) + 1 bits: the i-th set bit stands at (boundary_i >> l) + i
    docs    n x int64          the doc_ids, in file order, then n flags for rows without id

Boundaries take about 2 + log2(u / n) bits each instead of 64.  ``select(i)`` finds the i-th set bit by a sampled
directory built when a file is opened.  A task writes to a name of its own and publishes by renaming, so a retried
or duplicated task replaces a file with equal bytes.

Edge cases: a null text has no ids but the end id; rows that repeat a doc_id stand next to each other, ordered by
text, over several shards where their texts begin differently (the range bounds hold 64 characters of a text); rows
without doc_id come first, likewise; an empty table gives no files and an empty result; extra columns are ignored.  A folder
without scheme lies in the session's default store, for tasks as for Spark's reader.
"""

from __future__ import annotations

import functools
import struct
import sys
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillbook.llm.common import column, kept_by_worker, materialize, schema_of
from tillbook.llm.tokenizer_files import Memo, byte_letters, load
from tillbook.plans.session import scratch_dir

MAGIC = b"TBK1"
HEADER = struct.Struct("<4Q")
SAMPLE = 256               # set bits between two entries of the select directory


class EliasFano:
    """A non-decreasing sequence of n values up to ``top``, in about 2 + log2(top / n) bits each."""

    def __init__(self, n: int, low_bits: int, lows: np.ndarray, highs: np.ndarray):
        self.n, self.low_bits, self.lows, self.highs = n, low_bits, lows, highs
        ones = np.bitwise_count(highs)
        self.before = np.cumsum(ones) - ones                       # set bits before each byte
        self.directory = np.searchsorted(self.before, np.arange(0, n + 1, SAMPLE), "right") - 1

    @staticmethod
    def sizes(n: int, top: int) -> tuple[int, int, int]:
        """(bits of a low part, bytes of all low parts, bytes of the high bit vector)."""
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        return low_bits, (n * low_bits + 7) // 8, (n + (top >> low_bits) + 1 + 7) // 8

    @classmethod
    def encode(cls, values: np.ndarray) -> "EliasFano":
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits, _, high_bytes = cls.sizes(n, top)
        bits = (values[:, None] >> np.arange(low_bits)) & 1
        high = np.zeros(high_bytes * 8, np.uint8)
        high[(values >> low_bits) + np.arange(n)] = 1
        return cls(n, low_bits, np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little"),
                   np.packbits(high, bitorder="little"))

    def select(self, i: int) -> int:
        """The i-th value (from 0): the place of the i-th set bit gives its high part."""
        a = int(self.directory[i // SAMPLE])
        b = int(self.directory[i // SAMPLE + 1]) + 1 if i // SAMPLE + 1 < len(self.directory) else len(self.highs)
        byte = a + int(np.searchsorted(self.before[a:b], i, "right")) - 1
        rest = i - int(self.before[byte])
        bit = int(np.flatnonzero(np.unpackbits(self.highs[byte:byte + 1], bitorder="little"))[rest])
        low = 0
        if self.low_bits:
            at = i * self.low_bits
            part = int.from_bytes(self.lows[at // 8:(at + self.low_bits + 7) // 8].tobytes(), "little")
            low = part >> at % 8 & (1 << self.low_bits) - 1
        return (byte * 8 + bit - i << self.low_bits) | low

    def all(self) -> np.ndarray:
        """All values at once."""
        place = np.flatnonzero(np.unpackbits(self.highs, bitorder="little"))[:self.n]
        high = place - np.arange(self.n)
        if not self.low_bits:
            return high
        bits = np.unpackbits(self.lows, bitorder="little")[:self.n * self.low_bits].reshape(self.n, self.low_bits)
        return (high << self.low_bits) | (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)


def encode_shard(ids: bytes, counts: np.ndarray, doc_ids: np.ndarray, unnamed: np.ndarray, width: int) -> bytes:
    """One shard file: ``counts`` ids of each document, concatenated in ``ids`` with ``width`` bytes an id."""
    ef = EliasFano.encode(np.concatenate([[0], np.cumsum(counts)]).astype(np.int64))
    head = HEADER.pack(len(counts), int(counts.sum()), ef.low_bits, width)
    return b"".join([MAGIC, head, ids, ef.lows.tobytes(), ef.highs.tobytes(), doc_ids.astype("<i8").tobytes(),
                     unnamed.astype(np.uint8).tobytes()])


class Shard:
    """A shard file opened for reading."""

    def __init__(self, content: bytes):
        if content[:4] != MAGIC:
            raise ValueError("not a token shard")
        n, total, low_bits, width = HEADER.unpack_from(content, 4)
        at = 4 + HEADER.size
        self.ids = np.frombuffer(content, f"<u{width}", total, at)
        at += total * width
        _, low_bytes, high_bytes = EliasFano.sizes(n + 1, total)
        lows = np.frombuffer(content, np.uint8, low_bytes, at)
        highs = np.frombuffer(content, np.uint8, high_bytes, at + low_bytes)
        self.bounds = EliasFano(n + 1, low_bits, lows, highs)
        at += low_bytes + high_bytes
        self.doc_ids = np.frombuffer(content, "<i8", n, at)
        self.unnamed = np.frombuffer(content, np.uint8, n, at + 8 * n).astype(bool)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i):self.bounds.select(i + 1)]


# Fixed value: the pre-token pattern of the word vocabulary.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class WordEncoder:
    """Ids of texts as the library gives them, from remembered units and pre-tokens.

    White space ends every pre-token of this vocabulary (its pattern drops it), so the units between spaces and
    line ends are encoded on their own.  Units differ mostly by case and punctuation: a unit is lower-cased and cut
    into pre-tokens, and the library's merges run once for each distinct one.  Units that need more of the library
    (special strings, text that is not in normal form, capital sigma, whose lower case depends on its place in
    Python only) go through it whole."""

    def __init__(self, path: str, kind: str):
        self.tokenizer = load(path)
        self.letters = byte_letters()
        self.merge = self.tokenizer.model.tokenize
        self.code = {"<u2": "H", "<u4": "I"}[kind]
        self.units, self.words = Memo(self._unit, 600_000, 64), Memo(self._word, 300_000, 64)

    def _word(self, word: str) -> bytes:
        # one letter stands for each byte
        return self._bytes([t.id for t in self.merge(word.encode().decode("latin-1").translate(self.letters))])

    def _bytes(self, ids: list[int]) -> bytes:
        raw = array(self.code, ids)
        if sys.byteorder == "big":
            raw.byteswap()
        return raw.tobytes()

    def _unit(self, unit: str) -> bytes:
        if "<|" in unit or "Σ" in unit or not unicodedata.is_normalized("NFC", unit):
            return self._bytes(self.tokenizer.encode(unit, add_special_tokens=False).ids)
        low = unit.lower()
        if low.isalpha():
            return self.words[low]
        if low[:-1].isalpha() and low[-1:] in (".", ","):
            return self.words[low[:-1]] + self.words[low[-1:]]
        return b"".join(map(self.words.__getitem__, PRE_TOKEN.findall(low)))

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.units.__getitem__, text.replace("\n", " ").split(" ")))


@kept_by_worker
@functools.lru_cache(maxsize=2)
def encoder(path: str, kind: str) -> WordEncoder:
    return WordEncoder(path, kind)


def store_uri(spark: SparkSession, folder: str) -> str:
    """``folder`` with the scheme and host that Spark resolves it to, in the form that Arrow reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return f"{uri.getScheme()}://{uri.getAuthority() or ''}{uri.getPath()}"


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int, shards: int | None = None) -> DataFrame:
    """Write ``docs`` in ascending doc_id order as shard files under ``folder``; returns one row per file:
    (shard, file, n_docs, n_ids).  Running it again writes the same bytes under the same names."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    uri = store_uri(spark, folder)
    width = 2 if max(load(path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path, f"<u{width}").encode, end_id.to_bytes(width, "little")
        parts, counts, ids, unnamed = [], [], [], []
        for batch in batches:
            for doc, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist()):
                raw = (encode(text) if text else b"") + end
                parts.append(raw)
                counts.append(len(raw) // width)
                ids.append(doc or 0)
                unnamed.append(doc is None)
        if not ids:
            return
        context = TaskContext.get()
        shard = context.partitionId()
        store, base = fs.FileSystem.from_uri(uri)
        store.create_dir(base, recursive=True)
        final = f"{base}/shard-{shard:06d}.tok"
        own = f"{base}/.shard-{shard:06d}-{context.taskAttemptId()}-{uuid.uuid4().hex}"
        with store.open_output_stream(own) as out:
            out.write(encode_shard(b"".join(parts), np.array(counts), np.array(ids, np.int64), np.array(unnamed), width))
        if store.get_file_info(final).type != fs.FileType.NotFound:    # of an earlier attempt, with equal bytes
            store.delete_file(final)
        store.move(own, final)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [final], "n_docs": pa.array([len(ids)], pa.int64()),
                                          "n_ids": pa.array([sum(counts)], pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the beginning of the text deals repeated ids over shards in order; whole texts never serve as range bounds
    ordered = rows.repartitionByRange(shards, "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, schema_of("shard int, file string, n_docs long, n_ids long"))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, doc_id, start, n_tokens, ids_crc32) of every document in the files, start counted over all files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.tok").load(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, content in zip(column(batch, "shard").to_pylist(), column(batch, "content")):
                shard = Shard(content.as_py())
                bounds, wide = shard.bounds.all(), shard.ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(shard), number, np.int32)), pa.array(shard.doc_ids, mask=shard.unnamed),
                     pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())],
                    ["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    number = F.regexp_extract("path", r"shard-(\d+)\.tok$", 1).cast("int")
    found = materialize(files.select(number.alias("shard"), "content").mapInArrow(
        run, schema_of("shard int, doc_id long, at long, n_tokens long, ids_crc32 long")), "token-documents")
    # one row per file: how many ids stand in the files before it
    before = F.sum("u").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = (found.groupBy("shard").agg(F.sum("n_tokens").alias("u"))
             .select("shard", F.coalesce(before, F.lit(0)).alias("base")))
    return (found.join(bases, "shard")
            .select("shard", "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"))


def token_files_digest(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Write the files of ``docs`` to a new folder beside the checkpoints, read them back, digest each document."""
    folder = f"{scratch_dir(docs.sparkSession, 'llm')}/tokens-{uuid.uuid4().hex}"
    if not materialize(write_token_files(docs, path, folder, end_id), "token-files").head(1):
        return docs.sparkSession.createDataFrame([], "shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_token_files(docs.sparkSession, folder)
