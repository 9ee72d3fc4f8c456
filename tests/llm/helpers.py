"""Fixtures and plain versions of definitions shared by the operator tests."""

import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, bucket int, ids string"

# Nulls, empty and wordless texts, one word, repeated rows, a very long text, other scripts, separators of all kinds.
TEXTS = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two three four"), (5, "one two three four"),
    (6, "á é 漢字 \U0001d54f İstanbul ΣΣ"), (7, "x" * 70_000), (8, "word " * 20_000),
    (9, "\x00nul \x85next \xa0nbsp line"), (10, "a  b\n\n\nc \n d  "), (11, "<|endoftext|> it's we'll 3.14"),
    (None, "no id at all but some words here"), (12, "▁mark ▁"),
]


def documents(spark, rows):
    """Documents with extra columns whose names clash with those of the operators."""
    full = [(i, t, "en", f"src{(i or 0) % 3}" if i != 4 else None, len(t or ""), "r", 1, "x") for i, t in rows]
    return spark.createDataFrame(full, DOCS)


def shingle_set(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(ids, linked):
    """Smallest reachable id of each id."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in linked:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
