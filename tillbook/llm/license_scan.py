"""Operator 4: licence scan over a positional rare-token index.

Templates are short licence statements; each has mandatory key phrases.  One pass over all texts counts in how
many documents each template word occurs, which gives its inverse document frequency; in every template and every
key phrase the rarest words become its anchors.  The index maps an anchor to its postings (template, position).

The scan hashes all words of a slice of documents at once, looks the anchors up, and turns each hit into a
relative position (word number in the file minus position in the template).  Where a template's anchors agree on
one relative position, its words are compared there, and its label counts if the mandatory phrases stand in
place and at least ``ENOUGH`` of its words do.  The key phrases listed under ``PHRASES`` are searched through
the same index, by their rarest word, and verified word by word: all their places count.

Words are compared by 64-bit hashes for the look-up and by their bytes in the verification.

Edge cases: null, empty and wordless texts have no places and score 0; a template word that no document holds
counts as rarest; an empty table gives an empty result; repeated rows are scanned alike; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import NOT_ALNUM, WordHasher, column, schema_of, text_slices

# Base phrases with their labels, and licence statements with label and mandatory phrases.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at",
     ["in compliance with the license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files", ["permission is hereby granted free of charge"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     ["source and binary forms"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license", ["under the terms of the gnu"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", ["mozilla public license"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
]
ANCHORS = 3                # rarest words of a template that must agree on a place
ENOUGH = 0.8               # share of a template's words that must stand in place


class Index:
    """Anchors of all templates and phrases, from the document frequencies of their words."""

    def __init__(self, frequency: dict[str, int], documents: int, phrases: dict[str, str], templates: list[tuple]):
        idf = lambda w: math.log((documents + 1) / (frequency.get(w, 0) + 1))
        self.entries = []                  # (words, label, mandatory word positions, is a base phrase)
        self.postings: dict[str, list[tuple[int, int]]] = {}
        self.agree = []                    # anchors of an entry that must agree
        base = [(text, label, [text], True) for text, label in phrases.items()]
        for text, label, keys, plain in [*base, *[(t, label, keys, False) for label, t, keys in templates]]:
            words = text.split()
            needed = set()
            for key in keys:
                k = key.split()
                at = next(i for i in range(len(words)) if words[i:i + len(k)] == k)
                needed |= set(range(at, at + len(k)))
            # a mandatory word is part of every place, so the rarest of them finds them all
            anchors = sorted(needed, key=lambda i: (-idf(words[i]), i))[:1 if plain else ANCHORS]
            self.agree.append(len(anchors))
            for i in anchors:
                self.postings.setdefault(words[i], []).append((len(self.entries), i))
            self.entries.append(([w.encode() for w in words], label, sorted(needed), plain))


def vocabulary(phrases: dict[str, str], templates: list[tuple]) -> list[str]:
    return sorted({w for text in [*phrases, *[t for _, t, _ in templates]] for w in text.split()})


def _hash_words(hasher: WordHasher, words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    return hasher.words(np.frombuffer(b"".join(raw), np.uint8), offsets)[0]


def _look_up(hashes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in ``hashes`` that are in the sorted ``table``, their indices in it)."""
    at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    hit = np.flatnonzero(table[at] == hashes)
    return hit, at[hit]


def document_frequency(texts: DataFrame, words: list[str]) -> dict[str, int]:
    """In how many rows each word occurs; at most one row per word reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(NOT_ALNUM)
        table = _hash_words(hasher, words)
        order = np.argsort(table)
        total = np.zeros(len(words), np.int64)
        for batch in batches:
            text = column(batch, "text")
            for _, data, offsets in text_slices(text, text):
                h, _, first = hasher.words(data, offsets)
                hit, which = _look_up(h, table[order])
                doc = np.searchsorted(first, hit, "right") - 1
                seen = np.unique(doc * len(words) + which)
                total += np.bincount(order[seen % len(words)], minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(total)], ["word", "n"])

    rows = texts.mapInArrow(run, schema_of("word string, n long")).groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"]: r["n"] for r in rows}


def _scan(index: Index):
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(NOT_ALNUM)
        anchors = sorted(index.postings)
        table = _hash_words(hasher, anchors)
        order = np.argsort(table)
        table = table[order]
        for batch in batches:
            for ids, data, offsets in text_slices(column(batch, "doc_id"), column(batch, "text")):
                h, begin, first = hasher.words(data, offsets)
                lower = hasher.lower[data].tobytes()
                stop = hasher.separator

                def word(i: int) -> bytes:
                    a, b = int(begin[i]), int(begin[i + 1]) if i + 1 < len(begin) else len(data)
                    raw = lower[a:b]
                    end = next((j for j, c in enumerate(raw) if stop[c]), len(raw))
                    return raw[:end]

                votes: dict[tuple[int, int], int] = {}
                hit, which = _look_up(h, table)
                for at, w in zip(hit.tolist(), which.tolist()):
                    for entry, position in index.postings[anchors[order[w]]]:
                        votes[entry, at - position] = votes.get((entry, at - position), 0) + 1
                places: dict[int, list[tuple[int, int, float]]] = {}
                for (entry, at), n in votes.items():
                    words, _, needed, _ = index.entries[entry]
                    if n < index.agree[entry]:
                        continue
                    doc = int(np.searchsorted(first, at + needed[0], "right")) - 1
                    low, high = int(first[doc]), int(first[doc + 1])
                    # words before the file's first or after its last one count as missing
                    equal = [low <= at + i < high and int(begin[at + i]) < offsets[doc + 1] and word_at(word, begin, offsets, doc, at + i) == w
                             for i, w in enumerate(words)]
                    share = sum(equal) / len(words)
                    if all(equal[i] for i in needed) and share >= ENOUGH:
                        places.setdefault(doc, []).append((entry, at - low, share))
                rows = []
                for doc in range(len(ids)):
                    found = places.get(doc, [])
                    base = [(e, at) for e, at, _ in found if index.entries[e][3]]
                    starts = [at for _, at in base]
                    label = lambda entries: ",".join(sorted({index.entries[e][1] for e in entries}))
                    rows.append((len(base), min(starts, default=None), max(starts, default=None), label([e for e, _ in base]),
                                 label([e for e, _, _ in found]), max((s for _, _, s in found), default=0.0)))
                n, a, b, base_labels, labels, score = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.diff(first)), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                     pa.array(base_labels, pa.string()), pa.array(labels, pa.string()), pa.array(score, pa.float64())], names)
    return run


def word_at(word, begin: np.ndarray, offsets: np.ndarray, doc: int, i: int) -> bytes:
    """Word ``i``, cut at the end of its document where the next one begins without a separator."""
    return word(i)[:int(offsets[doc + 1]) - int(begin[i])]


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of ``docs``.

    ``score`` is the largest share of a found template's words that stand in place (1 for a whole base phrase)."""
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = vocabulary(phrases, templates)
    frequency = document_frequency(rows.select("text"), words)
    index = Index(frequency, rows.count(), phrases, templates)
    return rows.mapInArrow(_scan(index), schema_of(
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"))
