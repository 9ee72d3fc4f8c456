"""Operator 3: removal of passages of lines that repeat across documents.

A text's lines are hashed, and a rolling hash runs over the last ``WINDOW`` line hashes; a chunk ends where it is
smaller than at the line before and not larger than at the line after.  So the same lines are cut alike whatever
stands around them, a chunk has three lines on average, and none is shorter than two unless the text is.

Chunks alone miss most passages: one of few lines seldom holds a whole chunk of its own, and longer ones lose the
chunks at both edges.  So from each line with words on, the shortest run of at least two such lines and
``MIN_WORDS`` words is a candidate too, and so is the shortest one that ends there: together these runs cover every
line of every repeated passage of that size, up to its edges, whatever stands around it.  A passage of one line
counts from ``LINE_WORDS`` words.

Candidates are grouped over all documents by hash *and* text: equality of the bytes decides, and the
pre-aggregation before the shuffle holds a text once per task however often it repeats.  The copy in the smallest
doc_id stays (its first place there); the lines of all other copies go.  A line only goes where an earlier copy of
it is, so the first copy of each line stays somewhere.  Where a hash stands for several texts, places are looked up by
hash and text.

Edge cases: null texts stay null and empty ones empty; a text all of whose lines go becomes empty; rows without
doc_id stay as they are; rows sharing a doc_id count as one document, each keeping what that document keeps; line
ends are ``\\n`` and stay as they were between kept lines; an empty table gives an empty result; extra columns stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import column, materialize, pack, release_codecs, schema_of

WINDOW = 2                 # line hashes in the rolling hash
MIN_LINES = 2
MAX_LINES = 64             # of a chunk in which the rolling hash has no minimum (one line over and over)
MIN_WORDS = 8              # chunks and runs of fewer words are left alone
LINE_WORDS = 50            # from which a line is a passage of its own
BATCH_BYTES = 1 << 22      # about, of an emitted batch
BITS = 1 << 23             # of the table of hashes that may repeat (1 MB)
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def chunks(text: str) -> list[tuple[int, int]]:
    """(first line, line after the last) of each chunk of a text."""
    lines = text.split("\n")
    rolling, held, marks = 0, [0] * WINDOW, []
    leaving = pow(BASE, WINDOW, 1 << 64)
    for i, line in enumerate(lines):
        h = xxhash.xxh3_64_intdigest(line)
        rolling = (rolling * BASE + h - held[i % WINDOW] * leaving) & MASK
        held[i % WINDOW] = h
        marks.append((rolling ^ rolling >> 32) * BASE & MASK)
    out, start = [], 0
    for i in range(1, len(lines) - 2):
        if marks[i - 1] > marks[i] <= marks[i + 1] or i + 1 - start >= MAX_LINES:
            out.append((start, i + 1))
            start = i + 1
    return [*out, (start, len(lines))]


def _shortest(words: list[int]) -> Iterator[tuple[int, int]]:
    """(first, last) of the shortest run of enough lines and words from each line on."""
    held = stop = 0
    for first in range(len(words)):
        while stop < len(words) and (stop - first < MIN_LINES or held < MIN_WORDS):
            held += words[stop]
            stop += 1
        if stop - first < MIN_LINES or held < MIN_WORDS:
            return
        yield first, stop - 1
        held -= words[first]


def runs(words: list[int]) -> Iterator[tuple[int, int]]:
    """(first line, line after the last), by the words of each line, of the shortest runs from each line with words
    on and up to each such line.  Lines without words count only as part of a run."""
    full = [i for i, n in enumerate(words) if n]
    for first, last in _shortest([words[i] for i in full]):
        yield full[first], full[last] + 1
    full.reverse()
    for last, first in _shortest([words[i] for i in full]):
        yield full[first], full[last] + 1


def spans(text: str) -> list[tuple[int, int]]:
    """(first line, line after the last) of everything in a text that may be removed: chunks, runs and long lines."""
    words = [len(line.split()) for line in text.split("\n")]
    found = {(a, b) for a, b in chunks(text) if b - a >= MIN_LINES and sum(words[a:b]) >= MIN_WORDS}
    found.update(runs(words))
    found.update((i, i + 1) for i, n in enumerate(words) if n >= LINE_WORDS)
    return sorted(found)


def candidates(text: str) -> Iterator[tuple[int, int, str]]:
    """The lines that may be removed, with their text."""
    lines = text.split("\n")
    for a, b in spans(text):
        yield a, b, "\n".join(lines[a:b])


def chunk_hash(part: str) -> int:
    return xxhash.xxh3_64_intdigest(part, 1)


def _emit(wanted: np.ndarray | None, hashed: Callable[[str], int]):
    """Rows of the candidates: without their text, or (``wanted``: a bit table) with it where the hash is in the
    table."""
    kinds = {"doc_id": pa.int64(), "mark": pa.int64(), "a": pa.int32(), "b": pa.int32(), "hash": pa.int64(),
             "chunk": pa.string(), "again": pa.bool_()}
    names = [k for k in kinds if k != "chunk" or wanted is not None]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, pa.schema([(k, kinds[k]) for k in names]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_codecs()
        rows, held = [], 0
        for batch in batches:
            for doc, mark, text in zip(column(batch, "doc_id"), column(batch, "mark"), column(batch, "text")):
                seen = set()
                for a, b, part in candidates(text.as_py()):
                    key = hashed(part)
                    if wanted is None or wanted[key % BITS]:
                        rows.append({"doc_id": doc.as_py(), "mark": mark.as_py(), "a": a, "b": b,
                                     "hash": key - (1 << 63), "chunk": part, "again": part in seen})
                        held += 100 if wanted is None else 100 + len(part)
                    seen.add(part)
                    if held > BATCH_BYTES:     # candidates overlap: a batch of texts may give several
                        yield batch_of(rows)
                        rows, held = [], 0
        yield batch_of(rows)
    return run


def _chunk_rows(docs: DataFrame, hashed: Callable[[str], int], wanted: np.ndarray | None = None) -> DataFrame:
    rows = (docs.select(F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64("row.text").alias("mark"),
                        F.col("row.text").cast("string").alias("text"))
            .filter("doc_id is not null and text is not null"))
    return rows.mapInArrow(_emit(wanted, hashed), schema_of(
        f"doc_id long, mark long, a int, b int, hash long, {'' if wanted is None else 'chunk string, '}again boolean"))


def bit_table(hashes: DataFrame) -> np.ndarray:
    """A table of ``BITS`` bits in which those of all ``hashes`` are set.  Its size is fixed; however many hashes
    there are, at most ``BITS / 32`` rows reach the driver."""
    at = F.pmod(F.col("hash"), F.lit(BITS))
    words = hashes.select(F.floor(at / 32).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 32).cast("int")).alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(BITS // 32, np.uint32)
    table[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint32)
    # a stored hash is the key less 2^63, a multiple of BITS: both have the same bit
    return np.unpackbits(table.view(np.uint8), bitorder="little")


def repeated_chunks(docs: DataFrame, hashed: Callable[[str], int] = chunk_hash) -> DataFrame:
    """(doc_id, mark, a, b) of every chunk copy that goes; ``mark`` is the hash of the whole text.

    Hashes alone tell which chunks may repeat; only the texts of those (and of the few that share a bit with one)
    are shuffled for the comparison of bytes.  With more repeated hashes than the bit table tells apart, more texts
    are shuffled and the result stays the same.  Places of a hash that stands for several texts are read again with
    their texts."""
    places = materialize(_chunk_rows(docs, hashed), "chunks")
    often = places.filter("not again").groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    texts = _chunk_rows(docs, hashed, bit_table(often)).filter("not again").groupBy("hash", "chunk").agg(
        F.min("doc_id").alias("owner"), F.count(F.lit(1)).alias("n"))
    owners = materialize(texts.groupBy("hash").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n"), F.min("owner").alias("owner"))
                         .filter("texts > 1 or n > 1"), "owners")
    shared = owners.filter("texts = 1").select("hash", "owner")
    collided = materialize(owners.filter("texts > 1").select("hash"), "collided")
    elsewhere = places.join(shared, "hash").filter("doc_id <> owner or again")
    within = places.filter("again").join(owners.select("hash"), "hash", "left_anti")
    gone = [elsewhere, within]
    if not collided.isEmpty():
        copies = _chunk_rows(docs, hashed, bit_table(collided)).join(collided, "hash", "left_semi")
        owner = copies.groupBy("hash", "chunk").agg(F.min("doc_id").alias("owner"))
        gone.append(copies.join(owner, ["hash", "chunk"]).filter("doc_id <> owner or again"))
    return reduce(DataFrame.unionByName, [g.select("doc_id", "mark", "a", "b") for g in gone])


def _without(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Texts without the lines of the spans, which may overlap, and how many lines went."""
    for texts, gone in parts:
        cleaned, removed = [], []
        for text, spans_ in zip(texts.to_pylist(), gone.to_pylist()):
            if text is None:
                cleaned.append(None)
                removed.append(0)
                continue
            lines, kept, at = text.split("\n"), [], 0
            for a, b in sorted((g["a"], g["b"]) for g in spans_):
                kept += lines[at:max(at, a)]
                at = max(at, b)
            kept += lines[at:]
            cleaned.append("\n".join(kept))
            removed.append(len(lines) - len(kept))
        yield pa.StructArray.from_arrays([pa.array(cleaned, pa.string()), pa.array(removed, pa.int64())], ["cleaned", "n_removed"])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """(row, cleaned, n_lines, n_removed) for every row of ``docs``; ``row`` holds all its columns."""
    rows = pack(docs)
    gone = (repeated_chunks(rows).distinct().groupBy(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark"))
            .agg(F.collect_list(F.struct("a", "b")).alias("gone")))
    joined = rows.join(gone, (F.col("row.doc_id").cast("long") == F.col("gone_id"))
                       & (F.xxhash64("row.text") == F.col("gone_mark")), "left")
    text = F.col("row.text").cast("string")
    without = F.arrow_udf(_without, "cleaned string, n_removed long")
    # only texts that lose lines go through Python
    less = joined.select("row", "gone", without(F.when(F.col("gone").isNotNull(), text), F.col("gone")).alias("less"))
    return less.select(
        "row", F.when(F.col("gone").isNull(), text).otherwise(F.col("less.cleaned")).alias("cleaned"),
        F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(0)).cast("long").alias("n_lines"), F.col("less.n_removed").alias("n_removed"))


def with_text(cleaned: DataFrame, names: list[str]) -> DataFrame:
    """The documents of ``dedup_lines`` with their cleaned texts, columns as they were."""
    return cleaned.select(*[F.col("cleaned").alias("text") if n == "text" else F.col(f"row.`{n}`").alias(n) for n in names])
