"""Operator 5: token counts by the whole-token shortcut.

Offline, every vocabulary string is run through the merges once: those that end as one token *and* are one
pre-token form the set of proven whole tokens.  At run time a text falls into units at its spaces and line ends;
a unit's pre-tokens found in the set count 1 without any merging, and only the others are merged.  Units repeat,
so a worker remembers the counts of the latest distinct ones (bounded).

Why units are independent: a space belongs to the word after it and a line end stands alone, unless white space
meets white space.  Stretches where that happens are therefore cut only where a single white-space character
stands between two others, and white-space runs stay within one unit.

Special strings in a text are cut out first and count one token each, which is the library's default.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); an empty table gives an empty result; repeated rows
are counted alike; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import byte_slices, column, kept_by_worker, schema_of
from tillbook.llm.tokenizer_files import Memo, byte_letters, load

LIMIT = 1024

# Fixed value: the pre-token pattern of the vocabulary.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
RUN = regex.compile(r"\s{2,}")


class Counter:
    """Token counts of texts for one byte-level vocabulary file."""

    def __init__(self, path: str):
        tokenizer = load(path)
        self.merge = tokenizer.model.tokenize
        letters = byte_letters()
        self.letters = [letters[b] for b in range(256)]
        specials = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.whole = self._proven(tokenizer)
        self.memo = Memo(self._unit, 400_000, 64)

    def _proven(self, tokenizer) -> frozenset[str]:
        back = {c: b for b, c in enumerate(self.letters)}
        found = set()
        for word in tokenizer.get_vocab(with_added_tokens=False):
            raw = bytes(back[c] for c in word)
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                continue           # part of a character: never a whole pre-token
            if PRE_TOKEN.fullmatch(text) and PRE_TOKEN.findall(text) == [text] and len(self.merge(word)) == 1:
                found.add(text)
        return frozenset(found)

    def _unit(self, unit: str) -> int:
        n = 0
        for token in PRE_TOKEN.findall(unit):
            if token in self.whole:
                n += 1
            else:
                n += len(self.merge("".join([self.letters[b] for b in token.encode()])))
        return n

    def _plain(self, text: str) -> int:
        if RUN.search(text):
            # white space meets white space: a unit may only begin at a lone space or line end
            cuts = [0, *(m.start() for m in regex.finditer(r"(?<=\S)[ \n](?=\S)", text)), len(text)]
            return sum(map(self.memo.__getitem__, [text[a:b] for a, b in zip(cuts, cuts[1:])]))
        lines = text.split("\n")
        n, get = 0, self.memo.__getitem__
        for i, line in enumerate(lines):
            words = line.split(" ")
            first = words[0]
            if i:
                first = "\n" + first
            if first:
                n += get(first)
            if len(words) > 1:
                n += sum(map(get, [" " + w for w in words[1:]]))
        return n

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self._plain(text) if text else 0
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self._plain(p) for p in parts if p)


@kept_by_worker
@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in byte_slices(batches, "text"):
            n = [count(t) if t else 0 for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "n_bytes"), pa.array(n, pa.int64())],
                                             ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return (rows.mapInArrow(run, schema_of("doc_id long, n_bytes long, n_tokens long"))
            .withColumn("over_limit", F.col("n_tokens") > limit))
