import random

from llm.helpers import SMALL, TEXTS, documents
from tillbook.llm import line_chunks
from tillbook.llm.common import pack


def plain(rows):
    """Cleaned texts, chunk by chunk on one machine."""
    owner = {}
    for i, t in rows:
        if i is not None and t is not None:
            for *_, part in line_chunks.candidates(t):
                owner[part] = min(owner.get(part, i), i)
    out = []
    for i, t in rows:
        if i is None or t is None:
            out.append((i, t))
            continue
        gone, seen = set(), set()
        for a, b, part in line_chunks.candidates(t):
            if owner[part] != i or part in seen:
                gone |= set(range(a, b))
            seen.add(part)
        out.append((i, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)))
    return out


def check(spark, rows):
    docs = documents(spark, rows)
    found = line_chunks.dedup_lines(docs)
    got = line_chunks.with_text(found, docs.columns)
    assert got.columns == docs.columns
    assert sorted(map(str, [(r.doc_id, r.text) for r in got.collect()])) == sorted(map(str, plain(rows)))
    return found


def sentence(rng):
    return " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(8))


def test_edge_cases(spark):
    check(spark, TEXTS + [(20, "\n" * 40), (21, "\n" * 40), (22, "same line of eight words in this text\n" * 9)])
    assert line_chunks.dedup_lines(documents(spark, [])).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    check(spark, [(r.doc_id, r.text) for r in docs])


def test_shifted_passages_are_found_and_other_lines_stay(spark):
    rng = random.Random(4)
    passage = [sentence(rng) for _ in range(24)]
    rows = []
    for i in range(30):
        before, after = [sentence(rng) for _ in range(rng.randrange(7))], [sentence(rng) for _ in range(3)]
        rows.append((i, "\n".join(before + passage + after)))
    found = check(spark, rows)
    for r in found.select("row.doc_id", "row.text", "cleaned", "n_removed").collect():
        own = [x for x in r.text.split("\n") if x not in passage]
        assert [x for x in r.cleaned.split("\n") if x not in passage] == own
        # all but the passage's edges, where a chunk mixes with the document's own lines
        assert r.n_removed == 0 if r.doc_id == 0 else r.n_removed >= 16


def test_single_repeated_lines_stay(spark):
    rng = random.Random(6)
    line = sentence(rng)
    rows = [(i, "\n".join([sentence(rng), line, sentence(rng), sentence(rng)])) for i in range(20)]
    assert all(a == b for a, b in zip(plain(rows), rows))
    check(spark, rows)


def test_short_passages_go_whole(spark):
    """Passages of 1 to 6 lines between each document's own lines, with blank lines or short ones among them."""
    rng = random.Random(8)
    long = lambda: " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(60))
    passages = [[long()], *[[sentence(rng) for _ in range(n)] for n in range(2, 7)],
                [sentence(rng), "", "", sentence(rng)], [sentence(rng), "two words", "one"], ["a b c", "d e f", "g h i"]]
    rows, own = [], {}
    for n, passage in enumerate(passages):
        for i in range(10 * n, 10 * n + 5):
            before, after = [sentence(rng) for _ in range(1 + i % 4)], [sentence(rng) for _ in range(1 + i % 3)]
            rows.append((i, "\n".join(before + passage + after)))
            own[i] = rows[-1][1] if i == 10 * n else "\n".join(before + after)
    got = {r.doc_id: r for r in check(spark, rows).select("row.doc_id", "cleaned", "n_lines", "n_removed").collect()}
    assert {i: r.cleaned for i, r in got.items()} == own
    assert all(r.n_lines - r.n_removed == r.cleaned.count("\n") + 1 for r in got.values())


def test_first_copy_of_each_line_stays(spark):
    rng = random.Random(9)
    lines = [sentence(rng) for _ in range(12)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 12)))) for i in range(60)]
    left = {x for r in check(spark, rows).select("cleaned").collect() for x in r.cleaned.split("\n")}
    assert left - {""} == {x for _, t in rows for x in t.split("\n")}


def test_hashes_that_stand_for_several_texts(spark):
    """With a hash of 16 values nearly all chunks collide: what goes is the same."""
    rng = random.Random(11)
    passages = [[sentence(rng) for _ in range(3)] for _ in range(4)]
    rows = [(i, "\n".join([sentence(rng), *passages[i % 4], sentence(rng)])) for i in range(24)]
    docs = pack(documents(spark, rows))
    found, exact = (line_chunks.repeated_chunks(docs, h) for h in (lambda part: len(part) % 16, line_chunks.chunk_hash))
    places = lambda df: sorted({(r.doc_id, r.a, r.b) for r in df.collect()})
    assert places(found) == places(exact) and len(places(exact)) > 20
