"""Operator 11: trie of rebuilt conversations from sorted sequences, LCPs and a sparse table of range minima.

1. A turn becomes a 128-bit digest of (role, text) and the text's length, so no text is shuffled.  A conversation is the
   array of its turns; rebuilding puts the first turns of another one, at most eight, in front (``rebuilt``).
2. Rebuilt conversations are range-partitioned and sorted by (sequence of digests, conv_id).  Copies of one sequence
   spread over as many tasks as their ids need.
3. In a task, neighbours' common prefix lengths (LCPs) go into a sparse table of range minima.  Every prefix that starts at
   a row is a candidate; two independent binary searches over range minima give its members' first and last row, and
   that of its parent.  Smallest ids come from a second sparse table; sums over subtrees are differences of
   cumulative sums, as a node is charged to its first row.
4. A node that touches the first or last row of a task may go on in the next one.  Such *edge* nodes (at most twice the
   longest conversation a task) leave as parts under a digest of their prefix, are merged by it, and the
   sums of their subtrees are completed over these parts alone.  All other nodes are final.
5. The ids that end at a node are consecutive rows in ascending order.  Those of edge nodes are streamed through the hash
   in order of the tasks, in pieces, so that no list of ids is ever held.

Results: rows without conv_id take no part; turns are ordered by turn (null first), equal turns by their digest; repeated
rows are turns of their own; no conversations give no nodes; other columns are ignored; ``c - c % 5`` is Spark's remainder
(the sign of c).  A conversation's digests and lengths (20 bytes a turn) are one row; its texts are not."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import column, discard, materialize, schema_of

GROUP = 5                  # conversations c - c % 5 .. share their first turns
HEADS = 9                  # at most HEADS - 1 shared turns
TASK_TURNS = 1_000_000     # turns of one task
NOTHING = hashlib.sha256(b"").hexdigest()

_NODE = ("edge boolean, task int, prefix binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
         "n_children long, n_leaves long, saved_tokens long, own_bytes long, ends string, ends_sha256 string")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) with turns = array of (digest, bytes), every conversation rebuilt."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # the role's length in front keeps (role, text) apart from any other split of the same characters
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    own = (conversations.filter("conv_id is not null")
           .select(F.col("conv_id").cast("long").alias("conv_id"),
                   F.struct("turn", digest.alias("digest"), F.octet_length(text).alias("bytes")).alias("t"))
           .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
           .select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("own")))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    base = own.select(F.col("conv_id").alias("base"), F.slice("own", 1, HEADS - 1).alias("head"))
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).withColumn("h", h).join(base, "base", "left")
    none = F.filter("own", lambda _: F.lit(False))
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")),
                                             F.slice("own", F.col("h") + 1, F.size("own"))).alias("turns"))


class RangeMin:
    """Sparse table: minima of all windows whose length is a power of two."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 * len(self.rows[0]) >= 4 << len(self.rows) - 1 and len(self.rows[-1]) > 1 << len(self.rows) - 1:
            step = 1 << len(self.rows) - 1
            self.rows.append(np.minimum(self.rows[-1][:-step], self.rows[-1][step:]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minima of values[first..last], both included."""
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), self.rows[0].dtype)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.rows[k][first[at]], self.rows[k][last[at] - (1 << int(k)) + 1])
        return out


def extents(lcp: RangeMin, n: int, row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row that share their first ``depth`` turns with ``row``; ``lcp[i]`` is of rows i - 1 and i.  Each
    candidate is searched for on its own, by halving, both ways."""
    low, high = np.zeros_like(row), row.copy()
    while (low < high).any():
        middle = (low + high) // 2
        # middle < row wherever a search goes on; elsewhere a window of the row itself is asked for and not used
        joined = lcp.least(np.minimum(middle + 1, row), row) >= depth
        high = np.where((low < high) & joined, middle, high)
        low = np.where((low < high) & ~joined, middle + 1, low)
    first = high
    low, high = row.copy(), np.full_like(row, n - 1)
    while (low < high).any():
        middle = (low + high + 1) // 2
        joined = lcp.least(np.minimum(row + 1, middle), middle) >= depth
        going = low < high
        low, high = np.where(going & joined, middle, low), np.where(going & ~joined, middle - 1, high)
    return first, low


def neighbours(size: np.ndarray, offset: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Common prefix length of each row with the one before it; 0 for the first."""
    n = len(size)
    out = np.zeros(n, np.int64)
    both = np.minimum(size[1:], size[:-1])
    rows = np.flatnonzero(both) + 1
    if len(rows):
        length = both[rows - 1]
        begin = np.concatenate([[0], np.cumsum(length)])
        within = np.arange(begin[-1]) - np.repeat(begin[:-1], length)
        a, b = np.repeat(offset[rows], length) + within, np.repeat(offset[rows - 1], length) + within
        same = (digests[a] == digests[b]).all(axis=1)
        out[rows] = np.minimum.reduceat(np.where(same, np.repeat(length, length), within), begin[:-1])
    return out


def _prefixes(digests: np.ndarray) -> list[bytes]:
    """Digest of each prefix of one sequence, the empty one first."""
    out = [hashlib.md5(b"").digest()]
    for d in digests:
        out.append(hashlib.md5(out[-1] + d.tobytes()).digest())
    return out


def _nodes(task: int, conv: np.ndarray, size: np.ndarray, digests: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    """All nodes of one task's sorted rows: final ones, and parts of edge nodes."""
    n = len(conv)
    offset = np.concatenate([[0], np.cumsum(size)])
    lcp = neighbours(size, offset, digests)
    table = RangeMin(lcp)
    fresh = lcp.copy()
    fresh[0] = -1                                  # the root and every prefix of the first row start there
    count = size - fresh                           # prefixes that start at each row
    start = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(n), count)
    depth = np.arange(start[-1]) - start[:-1][row] + fresh[row] + 1
    first, last = extents(table, n, row, depth)
    up, _ = extents(table, n, row, np.maximum(depth - 1, 0))
    parent = np.where(depth > 0, start[:-1][up] + (depth - 1) - fresh[up] - 1, -1)
    members = last - first + 1
    least = RangeMin(conv).least(first, last)
    edge = (first == 0) | (last == n - 1)
    padded = np.append(length, 0)                  # the root has no turn of its own
    own = padded[np.where(depth > 0, offset[row] + depth - 1, len(length))]
    children = np.bincount(parent[parent >= 0], minlength=len(row))
    # sums over subtrees: cumulative over rows and, within a row, over the prefixes that start there
    leaf = ((children == 0) & ~edge).astype(np.int64)
    value = np.where(edge, 0, (members - 1) * own)
    end = start[1:][last]

    def below(v: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(v)])
        return total[end] - total[:-1]             # from the node itself to the last prefix of its last row

    leaves, saved = below(leaf), below(value)
    closed_children = np.bincount(parent[(parent >= 0) & ~edge], minlength=len(row))
    # rows of exactly this sequence stand first among the members
    stop = np.zeros(len(row), np.int64)
    is_last = size[row] == depth                   # the row's whole sequence is new here
    owner = np.full(n, -1, np.int64)
    owner[row[is_last]] = np.flatnonzero(is_last)
    holder = np.maximum.accumulate(np.where(owner >= 0, np.arange(n), 0))
    # a row equal to the one before it ends at the same node; no other row lacks a prefix of its own
    np.add.at(stop, owner[holder], 1)

    final = np.flatnonzero(~edge)
    parts = np.flatnonzero(edge)
    ends = {int(k): ",".join(map(str, conv[first[k]:first[k] + stop[k]].tolist())) for k in np.flatnonzero(stop)}
    names = {0: _prefixes(digests[offset[0]:offset[1]]), n - 1: _prefixes(digests[offset[n - 1]:offset[n]])}

    def name(k: int) -> bytes:
        return names[0][depth[k]] if first[k] == 0 else names[n - 1][depth[k]]

    order = np.concatenate([final, parts])
    is_edge = edge[order]
    up_edge = [parent[k] >= 0 and edge[parent[k]] for k in order]
    return pa.RecordBatch.from_arrays([
        pa.array(is_edge), pa.array(np.full(len(order), task, np.int32)),
        pa.array([name(k) if edge[k] else None for k in order], pa.binary()),
        pa.array([name(parent[k]) if u else None for k, u in zip(order, up_edge)], pa.binary()),
        pa.array(least[order]), pa.array(depth[order]),
        pa.array([None if u or parent[k] < 0 else int(least[parent[k]]) for k, u in zip(order, up_edge)], pa.int64()),
        pa.array(members[order]), pa.array(np.where(is_edge, closed_children[order], children[order])),
        pa.array(leaves[order]), pa.array(saved[order]), pa.array(own[order]),
        pa.array([ends.get(int(k)) if edge[k] else None for k in order], pa.string()),
        pa.array([None if edge[k] else hashlib.sha256(ends[int(k)].encode()).hexdigest() if int(k) in ends else NOTHING for k in order], pa.string()),
    ], names=[part.split()[0] for part in _NODE.split(", ")])


def _task_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's rows, sorted by (sequence, conv_id); the number of the partition gives the order of the tasks."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    turns = table.column("turns").combine_chunks()
    size = pc.list_value_length(turns).to_numpy().astype(np.int64)
    flat = turns.flatten()
    # digests come as binary values of 16 bytes each
    raw = pc.struct_field(flat, "digest").cast(pa.binary(16))
    digests = np.frombuffer(raw.buffers()[1], np.uint64, 2 * len(raw), raw.offset * 16).reshape(-1, 2) if len(raw) else np.zeros((0, 2), np.uint64)
    length = pc.struct_field(flat, "bytes").to_numpy(zero_copy_only=False).astype(np.int64)
    yield _nodes(TaskContext.get().partitionId(), table.column("conv_id").to_numpy(), size, digests, length)


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged edge nodes -> the same with sums over their subtrees.  Their number is bounded by the tasks, not the rows."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    nodes = pa.Table.from_batches(held).sort_by([("depth", "descending")]).combine_chunks()
    prefix, parent = nodes.column("prefix").to_pylist(), nodes.column("parent").to_pylist()
    conv = nodes.column("conv_id").to_pylist()
    at = {p: i for i, p in enumerate(prefix)}
    children = nodes.column("n_children").to_numpy().copy()
    members = nodes.column("n_convs").to_numpy()
    # what edge nodes add to their ancestors; the parts' sums hold all final nodes below already
    leaves, saved = np.zeros(len(prefix), np.int64), (members - 1) * nodes.column("own_bytes").to_numpy()
    for i, p in enumerate(parent):             # deeper nodes first: a node is complete when its turn comes
        if not children[i]:
            leaves[i] = 1
        if p is not None:
            u = at[p]
            children[u] += 1
            leaves[u] += leaves[i]
            saved[u] += saved[i]
    leaves += nodes.column("n_leaves").to_numpy()
    saved += nodes.column("saved_tokens").to_numpy()
    parents = pa.array([None if p is None else conv[at[p]] for p in parent], pa.int64())
    yield pa.RecordBatch.from_arrays(
        [pa.array(prefix, pa.binary()), pa.array(conv, pa.int64()), nodes.column("depth").combine_chunks(), parents, pa.array(members),
         pa.array(children), pa.array(leaves), pa.array(saved)],
        ["prefix", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"])


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (prefix, task) -> (prefix, SHA-256 of the pieces joined by commas), one state at a time."""
    schema = pa.schema([("prefix", pa.binary()), ("ends_sha256", pa.string())])
    open_prefix, state = None, None
    for batch in batches:
        done = []
        for prefix, piece in zip(column(batch, "prefix").to_pylist(), column(batch, "ends")):
            if prefix != open_prefix:
                if state is not None:
                    done.append((open_prefix, state.hexdigest()))
                open_prefix, state = prefix, hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.as_py().encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.binary()), pa.array([h for _, h in done])], schema=schema)
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([open_prefix], pa.binary()), pa.array([state.hexdigest()])], schema=schema)


def prefix_trie(conversations: DataFrame, task_turns: int = TASK_TURNS) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256."""
    return trie_of(rebuilt(conversations), task_turns)


def trie_of(sequences: DataFrame, task_turns: int = TASK_TURNS) -> DataFrame:
    """The same of any ``(conv_id, turns)`` with distinct ids."""
    sequences = materialize(sequences, "sequences")
    turns = sequences.agg(F.sum(F.size("turns") + 1)).first()[0] or 0
    tasks = max(1, -(-turns // task_turns))
    order = [F.col("turns.digest"), F.col("conv_id")]
    found = materialize(sequences.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
                        .mapInArrow(_task_nodes, schema_of(_NODE)), "nodes")
    discard(sequences)
    parts = found.filter("edge")
    merged = parts.groupBy("prefix").agg(
        F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_tokens"), F.first("own_bytes").alias("own_bytes"))
    edges = materialize(merged.coalesce(1).mapInArrow(_subtrees, schema_of(
        "prefix binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")), "edges")
    hashes = (parts.filter("ends is not null").select("prefix", "task", "ends").repartition("prefix")
              .sortWithinPartitions("prefix", "task").mapInArrow(_hash_pieces, schema_of("prefix binary, ends_sha256 string")))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    above = edges.select(F.col("prefix").alias("parent"), F.col("conv_id").alias("above"))
    # most final nodes know their parent; only children of edge nodes ask for it
    inner = found.filter("not edge and parent is null")
    asking = found.filter("not edge and parent is not null").join(above, "parent").withColumn("parent_conv_id", F.col("above"))
    outer = edges.join(hashes, "prefix", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
    return inner.select(*out).unionByName(asking.select(*out)).unionByName(outer.select(*out))
