import collections
import hashlib
import zlib

import numpy as np
import pytest

from llm.helpers import SMALL
from tillbook.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, prefix string, parent long, depth int, digests string"


def brute(rows):
    """Nodes of (conv_id, turn, role, text) rows, by dictionaries of whole prefixes."""
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    turns = {c: [(r, x) for _, r, x in sorted(v, key=lambda z: z[0])] for c, v in own.items()}
    seq, members, kids = {}, collections.defaultdict(list), collections.defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        rest = c % 5 if c >= 0 else -(-c % 5)
        seq[c] = tuple(turns.get(c - rest, [])[:h] + turns[c][h:])
        for d in range(len(seq[c]) + 1):
            members[seq[c][:d]].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, set()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[k] for k in kids[p])
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(seq[c]) == len(p))))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out


def check(spark, rows, task_turns):
    df = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA)
    got = prefix_trie.prefix_trie(df, task_turns).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute(rows)


@pytest.mark.parametrize("task_turns", [1_000_000, 40])
def test_equals_brute_force_on_the_table(spark, task_turns):
    df = spark.read.parquet(f"{SMALL}/conversations.parquet")
    got = prefix_trie.prefix_trie(df, task_turns).collect()
    assert {tuple(r) for r in got} == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("task_turns", [1_000_000, 25])
def test_nulls_copies_prefixes_of_each_other_and_long_conversations(spark, task_turns):
    rows = [(None, 1, "user", "no id"), (0, None, None, None), (0, 1, "user", "a"), (1, 1, "user", "a"), (1, 2, "bot", ""),
            (-3, 1, "user", "a"), (-5, 1, "user", "é漢" * 500), (7, 3, "user", "late"), (7, 1, "user", "early"),
            (10, 1, "us", "era"), (11, 1, "use", "ra"), (10**12, 1, "user", "a")]
    rows += [(c, t, "user", f"turn {t}") for c in range(100, 160) for t in range(4)]          # one large group of copies
    rows += [(c, t, "user", "same") for c in range(200, 230, 5) for t in range(c - 195)]      # each a prefix of the next
    rows += [(300, t, "user", f"long {t % 3}") for t in range(600)]
    check(spark, rows, task_turns)


def test_equal_turns_and_repeated_rows_are_turns_of_their_own(spark):
    df = spark.createDataFrame([(5, 1, "user", "b", "", 1, 1, ""), (5, 1, "user", "a", "", 1, 1, ""), (5, 1, "user", "a", "", 1, 1, "")], SCHEMA)
    got = prefix_trie.prefix_trie(df).collect()
    assert sorted(r.depth for r in got) == [0, 1, 2, 3]
    assert {tuple(r) for r in got} == {tuple(r) for r in prefix_trie.prefix_trie(df).collect()}


def test_no_conversations_give_no_nodes(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_extents_equal_a_scan():
    rng = np.random.default_rng(3)
    lcp = rng.integers(0, 5, 200)
    lcp[0] = 0
    table = prefix_trie.RangeMin(lcp)
    row, depth = rng.integers(0, 200, 500), rng.integers(0, 6, 500)
    first, last = prefix_trie.extents(table, 200, row, depth)
    for r, d, a, b in zip(row, depth, first, last):
        low = high = r
        while low > 0 and lcp[low] >= d:
            low -= 1
        while high < 199 and lcp[high + 1] >= d:
            high += 1
        assert (a, b) == (low, high)
