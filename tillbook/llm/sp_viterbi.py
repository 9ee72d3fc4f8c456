"""Operator 8: SentencePiece encoding and decoding by a streaming Viterbi pass.

The model at hand is a merge (BPE) model.  A segmentation is the model's result exactly when each two neighbouring
pieces are what the merges make of their joined text, and every prefix has one such segmentation; so the best path
to a position is the one piece that ends there and is compatible with the best path to its start.  The pass keeps
one backpointer per position and a window of positions: any later piece starts within the longest piece's length
of the newest position, so as soon as the backpointer paths from all those positions meet in one boundary, the
pieces before it are committed and the window shrinks.  Memory is bounded by the window, whatever the text length.

Where two neighbouring characters stand side by side in no piece of the vocabulary, all paths meet whatever else
the text holds.  Texts are cut at such places (for this vocabulary: line ends, spaces after other characters, most
punctuation), and a worker remembers the ids of the latest distinct stretches (bounded).

Characters outside the vocabulary become byte pieces.  Decoding joins pieces, bytes and spaces, and drops the one
leading space that encoding adds; a text holding the space mark U+2581 itself decodes to a space, as in the library.

Edge cases: null and empty texts have no ids and decode to the empty text; an empty table gives an empty result;
repeated rows are encoded alike; extra columns stay as they are.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.llm.common import byte_slices, column, kept_by_worker
from tillbook.llm.tokenizer_files import Memo

SPACE = "▁"
PAIR_BITS = 22             # of a piece's number in a pair of neighbours
UNKNOWN = 1 << 21          # numbers of characters outside the vocabulary begin here
STEP = 3                   # characters between remembered states of a word's beginning
REMEMBERED = 64            # longest stretch that is remembered


class Pieces:
    """The vocabulary of a merge model with byte fallback, and its merge rule."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        normal = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in normal}
        self.rank = {p: (-model.get_score(i), i) for p, i in self.ids.items()}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        self.names = [p for p in self.ids if len(p) == 1 or self.merge(p) == [p]]
        self.longest = max(map(len, self.names))
        # every ending of a piece, with the piece's number if it is one itself, else -1
        self.endings = dict.fromkeys((p[i:] for p in self.names for i in range(len(p))), -1)
        self.endings.update((p, i) for i, p in enumerate(self.names))
        self.compatible = Memo(self._compatible, 150_000)
        self.pairs = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.raw = [b""] * model.vocab_size()
        for p, i in self.ids.items():
            self.raw[i] = p.replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])
        # a space mark or a line end never follows another character inside a piece: whole words can be cut out fast
        self.words = not any(SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1) for p in self.ids)

    def merge(self, text: str) -> list[str]:
        """Join the best-scored neighbours, leftmost first, until none joins."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=None)
            if best is None:
                break
            parts[best[1]:best[1] + 2] = ["".join(parts[best[1]:best[1] + 2])]
        return parts

    def name(self, number: int) -> str:
        return self.names[number] if number < UNKNOWN else chr(number - UNKNOWN)

    def _compatible(self, pair: int) -> bool:
        two = [self.name(pair >> PAIR_BITS), self.name(pair & (1 << PAIR_BITS) - 1)]
        return self.merge("".join(two)) == two

    def ids_of(self, number: int) -> list[int]:
        piece = self.name(number)
        return [self.ids[piece]] if piece in self.ids else [self.bytes[b] for b in piece.encode()]


class StreamingEncoder:
    """Feed text in any portions; the numbers of pieces are returned as soon as they are certain."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.window = pieces, ""
        # for each boundary of the window: length and number of the piece before it (of the last committed one at 0)
        self.back, self.last = [0], [-1]

    def state(self) -> tuple[str, list[int], list[int]]:
        return self.window, self.back, self.last

    def resume(self, state: tuple[str, list[int], list[int]]) -> "StreamingEncoder":
        self.window, self.back, self.last = state[0], state[1].copy(), state[2].copy()
        return self

    def feed(self, text: str) -> list[int]:
        out = []
        for a in range(0, len(text), self.pieces.longest):
            out += self._advance(text[a:a + self.pieces.longest])
        return out

    def _advance(self, text: str) -> list[int]:
        p, back, last, first = self.pieces, self.back, self.last, len(self.window) + 1
        self.window = window = self.window + text
        ending, compatible = p.endings.get, p.compatible
        for end in range(first, len(window) + 1):
            size, number = 1, ending(window[end - 1], -1)
            if number < 0:
                number = UNKNOWN + ord(window[end - 1])
            while True:
                if number >= 0:
                    before = last[end - size]
                    if before < 0 or compatible[before << PAIR_BITS | number]:
                        back.append(size)
                        last.append(number)
                        break
                size += 1
                number = ending(window[end - size:end]) if size <= end else None
                if number is None:
                    raise ValueError("no segmentation")
        return self._commit() if len(window) >= 3 * p.longest else []

    def _commit(self) -> list[int]:
        """Pieces before the boundary on which the paths of all positions that a later piece may start from meet."""
        end = len(self.window)
        alive = set(range(end - self.pieces.longest + 1, end + 1))
        while len(alive) > 1:
            latest = max(alive)
            alive.remove(latest)
            alive.add(latest - self.back[latest])
        return self._take(alive.pop())

    def _take(self, upto: int) -> list[int]:
        out, at = [], upto
        while at:
            out.append(self.last[at])
            at -= self.back[at]
        if upto:
            self.window, self.back, self.last = self.window[upto:], [0, *self.back[upto + 1:]], self.last[upto:]
        return out[::-1]

    def finish(self) -> list[int]:
        return self._take(len(self.window))


class PieceCodec:
    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.units, self.stretches = Memo(self._unit, 100_000, REMEMBERED), Memo(self._stream, 120_000, REMEMBERED)
        self.words = Memo(self._word, 400_000, REMEMBERED)
        self.states = Memo(lambda text: self._begun(text).state(), 50_000)
        self.raw_ids = Memo(lambda number: np.array(self.pieces.ids_of(number), "<i4").tobytes(), 100_000)

    def _begun(self, text: str) -> StreamingEncoder:
        """An encoder that was fed a short text: it goes on from the remembered state of the text's beginning."""
        encoder, at = StreamingEncoder(self.pieces), (len(text) - 1) // STEP * STEP
        if at:
            encoder.resume(self.states[text[:at]])
        encoder.feed(text[at:])
        return encoder

    def _stream(self, text: str) -> bytes:
        if len(text) <= self.pieces.longest:
            numbers = self._begun(text).finish()
        else:
            encoder = StreamingEncoder(self.pieces)
            numbers = encoder.feed(text) + encoder.finish()
        return b"".join(map(self.raw_ids.__getitem__, numbers))

    def _word(self, word: str) -> bytes:
        """A word after a space: remembered here only, not among the stretches again."""
        return self._stream(SPACE + word) if word.isalpha() else self._unit(SPACE + word)

    def _letters(self, text: str) -> bytes:
        return self.words[text[1:]] if text[0] == SPACE else self.stretches[text]

    def _unit(self, text: str) -> bytes:
        if text[1:].isalpha():
            return self._letters(text)
        pairs = self.pieces.pairs
        if text[1:-1].isalpha() and text[-2:] not in pairs:
            return self._letters(text[:-1]) + self.stretches[text[-1]]
        cuts = [0, *[i for i in range(1, len(text)) if text[i - 1:i + 1] not in pairs], len(text)]
        return b"".join([self.stretches[text[a:b]] for a, b in zip(cuts, cuts[1:])])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        if not text:
            return b""
        if not self.pieces.words:
            return self._unit(SPACE + text.replace(" ", SPACE))
        parts, known, after_space = [], self.units.__getitem__, self.words.__getitem__
        for i, line in enumerate(text.split("\n")):
            if i:
                parts.append(known("\n"))
            else:
                line = " " + line          # the library begins a text with a space
            if "  " in line or SPACE in line:
                line = line.replace(" ", SPACE)
                parts.extend(map(known, re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", line)))
            else:
                first, *rest = line.split(" ")
                if first:
                    parts.append(known(first))
                parts.extend(map(after_space, rest))
        return b"".join(parts)

    def decode(self, ids) -> str:
        return b"".join(map(self.pieces.raw.__getitem__, ids)).decode("utf-8", "replace")[1:]


@kept_by_worker
@functools.lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def _mapped(df: DataFrame, source: str, target: str, kind: T.DataType, make) -> DataFrame:
    """``df`` with column ``target`` made from column ``source`` by ``make`` (list of values -> Arrow array)."""
    keep = [c for c in df.columns if c != target]
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(target, kind)])

    of_texts = isinstance(df.schema[source].dataType, T.StringType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, source) if of_texts else batches:
            new = make(column(batch, source))
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in keep], new], [*keep, target])

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text`` as an array column."""
    def make(texts: pa.Array) -> pa.Array:
        raw = [codec(path).encode(t) if t else b"" for t in texts.to_pylist()]
        cuts = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.frombuffer(b"".join(raw), "<i4")))

    return _mapped(docs, "text", ids, T.ArrayType(T.IntegerType()), make)


def _each(lists: pa.Array) -> Iterator[np.ndarray]:
    """The ids of each row (none for null)."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return (flat[a:b] for a, b in zip(cuts, cuts[1:]))


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids; null ids decode to the empty text."""
    return _mapped(encoded, ids, text, T.StringType(), lambda lists: pa.array(
        [codec(path).decode(x.tolist()) if len(x) else "" for x in _each(lists)], pa.string()))


def digest(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, round_trip) of every row: number and unsigned crc32 (as little-endian 32-bit
    numbers) of the ids that encoding gives, and whether decoding them gives the text again.  Text by text in one
    pass, so no ids travel between processes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = codec(path)
        for batch in byte_slices(batches, "text"):
            rows = []
            for text in column(batch, "text"):
                text = text.as_py() or ""
                raw = both.encode(text)
                back = both.decode(np.frombuffer(raw, "<i4").tolist()) if raw else ""
                rows.append((len(raw) // 4, zlib.crc32(raw), back == text))
            n, crc, same = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()),
                                              pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids_crc32", "round_trip"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType.fromDDL("doc_id long, n_tokens long, ids_crc32 long, round_trip boolean"))
