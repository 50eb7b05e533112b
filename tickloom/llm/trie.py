"""Operator 11: the prefix trie of conversations by an LCP-aware external mergesort.

A turn is a cell of fixed width, the first bytes of its digest and its length, so a conversation is a string of cells and
its prefixes are those of the string. Distinct strings are cut into sorted runs that carry, with each
string, how many cells it shares with the one before it; the runs are written to the shared folder. Ranges of strings are then merged,
each range by one task: a loser tree compares two heads first by the cells that they share with what
was put out last, and looks at cells only where these agree, from there on. The merged stream
keeps the nodes of the path that is open on a stack; a node is put out when the next string leaves it.

A node on the first or last path of a range can go on in the neighbouring ranges. Its parts add up once the boundaries
are known: the cells that the last string of a range shares with the first of the next say which nodes are in both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, working

#: Bytes of a turn's digest, and of a cell: the digest and the turn's length.
DIGEST, CELL = 16, 24
#: A run is sorted at once: at most so many strings, and bytes of them (but one string at least).
RUN_ROWS, RUN_BYTES = 1 << 16, 1 << 24
#: Bytes and strings that a range is to have; a task merges one range.
RANGE_BYTES, RANGE_ROWS = 1 << 24, 100_000
#: Conversations whose ids are joined to one piece before a node's ids are hashed.
IDS_AT_ONCE = 8192

RUNS = "run long, place long, lcp int, string binary, conv_id long, n long"
PARTS = "kind int, node binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends long, ends_with long, low binary, high binary"
#: Kinds of rows that a merge puts out: whole nodes, parts of nodes at the edge of a range, and the range's first and last string.
WHOLE, PART, RANGE = 0, 1, 2


def cell(role: Column, text: Column) -> Column:
    """A turn as hexadecimal digits: the start of its digest, and its length in code points."""
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    return F.concat(F.upper(digest), F.lpad(F.hex(F.length(text).cast("long")), 2 * (CELL - DIGEST), "0"))


def turn_cells(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, cells`` of each conversation, in the order of turns, null first; equal turn numbers by role, then digest.

    Null roles and texts are empty. Rows without conv_id are no conversation's. Texts are not shuffled, only cells; a conversation's cells are one row.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).cast("long").alias("turn"), role.alias("role"), cell(role, text).alias("cell")).alias("t"))
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["cell"]).alias("cells"))


# sorted runs


def shared_cells(a: bytes, b: bytes, known: int = 0) -> int:
    """Cells that two strings share from their start; ``known`` of them need no look."""
    k, most = known, min(len(a), len(b)) // CELL
    while k < most and a[k * CELL : (k + 1) * CELL] == b[k * CELL : (k + 1) * CELL]:
        k += 1
    return k


def form_runs(rows: Iterator[tuple[bytes, int, int]], first_run: int, most_rows: int = RUN_ROWS, most_bytes: int = RUN_BYTES) -> Iterator[list[tuple]]:
    """Sorted runs of ``(run, place, lcp, string, conv_id, n)``."""
    held: list[tuple[bytes, int, int]] = []
    size, run = 0, first_run

    def sorted_run() -> list[tuple]:
        held.sort()
        out, before = [], b""
        for place, (string, conv, n) in enumerate(held):
            out.append((run, place, shared_cells(before, string), string, conv, n))
            before = string
        return out

    for row in rows:
        held.append(row)
        size += len(row[0])
        if len(held) >= most_rows or size >= most_bytes:
            yield sorted_run()
            held, size, run = [], 0, run + 1
    if held:
        yield sorted_run()


def _runs(strings: DataFrame) -> DataFrame:
    schema = pa.schema([("run", pa.int64()), ("place", pa.int64()), ("lcp", pa.int32()), ("string", pa.binary()), ("conv_id", pa.int64()), ("n", pa.int64())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("string", "conv_id", "n")), strict=True))
        for run in form_runs(rows, TaskContext.get().partitionId() << 32):
            for k in range(0, len(run), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*run[k : k + 4096], strict=True), schema, strict=True)], schema=schema)

    return strings.mapInArrow(make, RUNS)


# merge


class LoserTree:
    """Merges sorted runs of ``(string, lcp, ...)``: yields ``lcp, row``, where lcp counts the cells shared with the row before.

    A head's lcp always refers to what was put out last, so of two heads the one that shares more is the
    smaller; where both share the same, cells are compared from there on, and the loser then keeps what it shares with the winner.
    """

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.runs, self.at = runs, [0] * len(runs)
        self.lcp = [0] * len(runs)  # of each run's head, with what was put out last or what has beaten it
        self.size = 1
        while self.size < max(len(runs), 1):
            self.size *= 2
        self.losers = [-1] * self.size
        self.compared = 0  # comparisons that looked at cells

    def _gone(self, k: int) -> bool:
        return k < 0 or k >= len(self.runs) or self.at[k] >= len(self.runs[k])

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs' heads."""
        if self._gone(a):
            return b, a
        if self._gone(b):
            return a, b
        la, lb = self.lcp[a], self.lcp[b]
        if la != lb:
            return (a, b) if la > lb else (b, a)
        x, y = self.runs[a][self.at[a]][0], self.runs[b][self.at[b]][0]
        self.compared += 1
        k = shared_cells(x, y, la)
        if x[k * CELL : (k + 1) * CELL] <= y[k * CELL : (k + 1) * CELL]:
            self.lcp[b] = k
            return a, b
        self.lcp[a] = k
        return b, a

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        winner, self.losers[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return winner

    def __iter__(self) -> Iterator[tuple[int, tuple]]:
        winner = self._build(1) if self.size > 1 else 0
        while not self._gone(winner):
            row = self.runs[winner][self.at[winner]]
            yield self.lcp[winner], row
            self.at[winner] += 1
            if not self._gone(winner):
                self.lcp[winner] = self.runs[winner][self.at[winner]][1]
            node = (winner + self.size) // 2
            while node >= 1 and self.size > 1:
                winner, self.losers[node] = self._play(winner, self.losers[node])
                node //= 2


def in_runs(rows: Iterator[tuple]) -> list[list[tuple]]:
    """Runs of ``(string, lcp, conv_id, n)`` from rows ``(run, place, lcp, string, conv_id, n)`` of one range, in whatever order they come."""
    found: dict[int, list[tuple]] = {}
    for row in rows:
        found.setdefault(row[0], []).append(row)
    out = []
    for run in found.values():
        run.sort(key=lambda r: r[1])  # they mostly are in order
        before, made = None, []
        for _, place, lcp, string, conv, n in run:
            # what is carried holds only after the very string before it
            made.append((string, lcp if before is not None and place == before + 1 else 0 if before is None else shared_cells(made[-1][0], string), conv, n))
            before = place
        out.append(made)
    return out


def child_key(parent: bytes, turn: bytes) -> bytes:
    return hashlib.blake2b(parent + turn, digest_size=16).digest()


ROOT = hashlib.blake2b(b"", digest_size=16).digest()


def nodes_of(stream: Iterator[tuple[int, tuple]]) -> Iterator[tuple]:
    """Rows of ``PARTS`` from merged strings: nodes as they are finished, then the range's first and last string.

    The open path is a stack of nodes; every string closes those that it does not share with the string before.
    """
    path: list[dict] = []
    low = high = None

    def opened(key: bytes, parent: bytes | None, length: int) -> dict:
        return {"key": key, "parent": parent, "length": length, "conv": None, "n": 0, "children": 0, "leaves": 0, "saved": 0, "ends": 0, "with": None, "edge": low is None}

    def closed(last: bool) -> tuple:
        node = path.pop()
        depth = len(path)
        leaves = node["leaves"] or 1  # without children it is a leaf
        saved = node["saved"] + (node["n"] - 1) * node["length"]
        if path:
            up = path[-1]
            up["n"] += node["n"]
            up["conv"] = node["conv"] if up["conv"] is None else min(up["conv"], node["conv"])
            up["children"] += 1
            up["leaves"] += leaves
            up["saved"] += saved
        kind = PART if node["edge"] or last else WHOLE
        return (kind, node["key"], node["parent"], depth, node["conv"], node["n"], node["children"], leaves, saved, node["ends"], node["with"], None, None)

    for lcp, (string, _, conv, n) in stream:
        while len(path) > lcp + 1:
            yield closed(False)
        if not path:
            path.append(opened(ROOT, None, 0))
        for k in range(len(path) - 1, len(string) // CELL):
            turn = string[k * CELL : (k + 1) * CELL]
            path.append(opened(child_key(path[-1]["key"], turn), path[-1]["key"], int.from_bytes(turn[DIGEST:], "big")))
        top = path[-1]
        top["n"] += n
        top["conv"] = conv if top["conv"] is None else min(top["conv"], conv)
        top["ends"], top["with"] = n, conv
        low = string if low is None else low
        high = string
    while path:
        yield closed(True)
    if low is not None:
        yield (RANGE, *[None] * 10, low, high)


def seams(high: bytes, low: bytes) -> Iterator[tuple]:
    """What two neighbouring ranges count twice, by their last and first string: rows ``node, parent, depth, n_children, n_leaves, saved_tokens`` to add.

    Of a node that is in both, the own ``n - 1`` falls short by one in all, its child on the shared path is counted twice, and a
    last string that goes on in the next range was taken for a leaf.
    """
    both = shared_cells(high, low)
    keys, lengths = [ROOT], [0]
    for k in range(both):
        turn = low[k * CELL : (k + 1) * CELL]
        keys.append(child_key(keys[-1], turn))
        lengths.append(int.from_bytes(turn[DIGEST:], "big"))
    no_leaf = -1 if len(high) == both * CELL else 0
    below = 0
    for d in range(both, -1, -1):
        below += lengths[d]
        yield (keys[d], keys[d - 1] if d else None, d, -1 if d < both else 0, no_leaf, below)


_PARTS = pa.schema([("kind", pa.int32()), ("node", pa.binary()), ("parent", pa.binary()), *((c, pa.int64()) for c in ("depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "ends_with")), ("low", pa.binary()), ("high", pa.binary())])


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    yield from _in_batches(nodes_of(iter(LoserTree(in_runs(rows)))), _PARTS)


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (seam for b in batches for high, low in zip(*(c.to_pylist() for c in b.columns), strict=True) for seam in seams(high, low))
    schema = pa.schema([("node", pa.binary()), ("parent", pa.binary()), *((c, pa.int64()) for c in ("depth", "n_children", "n_leaves", "saved_tokens"))])
    yield from _in_batches(rows, schema)


# ids of the conversations that end at a node


def _id_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows ``group, conv_id`` to ``group, low, ids``: a piece is the ids of one group that follow each other, joined."""

    def pieces() -> Iterator[tuple]:
        group, ids = None, []
        for b in batches:
            for g, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if ids and (g != group or len(ids) >= IDS_AT_ONCE):
                    yield group, ids[0], ",".join(map(str, ids))
                    ids = []
                group = g
                ids.append(c)
        if ids:
            yield group, ids[0], ",".join(map(str, ids))

    yield from _in_batches(pieces(), pa.schema([("group", pa.int64()), ("low", pa.int64()), ("ids", pa.string())]), 64)


def _id_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows ``group, low, ids`` to ``group, ends_sha256``."""

    def hashes() -> Iterator[tuple]:
        group, h = None, None
        for b in batches:
            for g, ids in zip(b.column("group").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if h is None or g != group:
                    if h is not None:
                        yield group, h.hexdigest()
                    group, h = g, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(ids.encode())
        if h is not None:
            yield group, h.hexdigest()

    yield from _in_batches(hashes(), pa.schema([("group", pa.int64()), ("ends_sha256", pa.string())]))


def _shared_ends(convs: DataFrame, strings: DataFrame) -> DataFrame:
    """``group, ends_sha256`` of strings that several conversations are; ``group`` is the smallest of them.

    Ids are dealt by ranges of group and id, so that a very common string is many tasks' until only its hash, one pass over the joined pieces, is left.
    """
    many = strings.where("n > 1").select(F.reverse(F.hex("string")).alias("key"), F.col("conv_id").alias("group"))
    rows = convs.join(many, F.reverse(F.hex("string")) == F.col("key")).select("group", "conv_id")
    pieces = rows.repartitionByRange("group", "conv_id").sortWithinPartitions("group", "conv_id").mapInArrow(_id_pieces, "group long, low long, ids string")
    return pieces.repartition("group").sortWithinPartitions("group", "low").mapInArrow(_id_hashes, "group long, ends_sha256 string")


def prefix_trie(convs: DataFrame) -> DataFrame:
    """The trie of ``convs`` (``conv_id, cells``; ids are distinct): a row per node, written to the shared folder.

    ``conv_id`` smallest conversation through the node, ``depth``, ``parent_conv_id`` (the root's is null), ``n_convs``
    through it, ``n_children``, ``n_leaves`` in its subtree, ``saved_tokens`` (over the subtree, length of the last turn times
    what ``n_convs`` exceeds one by), ``ends_sha256`` of the ids that end there, ascending, comma-joined. The root is there if any conversation is, be it empty.
    """
    spark = convs.sparkSession
    with working(spark) as keep:
        whole = stash(convs.select("conv_id", F.unhex(F.array_join("cells", "")).alias("string")), "strings")
        strings = whole.groupBy("string").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
        runs = stash(_runs(strings), "runs")
        size = runs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("string")), F.lit(0))).first()
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size[0] // RANGE_ROWS), -(-size[1] // RANGE_BYTES))
        parts = stash(runs.repartitionByRange(ranges, "string").mapInArrow(_merge, PARTS), "nodes")

        # two strings a range, in order: the neighbours' shared paths
        pairs = parts.where(F.col("kind") == RANGE).select("low", F.lag("high").over(Window.orderBy("low")).alias("before")).where("before is not null")
        twice = pairs.select("before", "low").mapInArrow(_seams, "node binary, parent binary, depth long, n_children long, n_leaves long, saved_tokens long")
        columns = ["node", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "ends_with"]
        cut = parts.where(F.col("kind") == PART).select(*columns).unionByName(twice, allowMissingColumns=True)
        cut = cut.groupBy("node").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens", "ends")), F.min("ends_with").alias("ends_with"))
        nodes = parts.where(F.col("kind") == WHOLE).select(*columns).unionByName(cut)

        top = nodes.where("n_children > 0").select(F.reverse(F.hex("node")).alias("above"), F.col("conv_id").alias("parent_conv_id"))
        out = nodes.join(top, F.reverse(F.hex("parent")) == F.col("above"), "left")
        many = _shared_ends(whole, runs)
        out = out.join(many, F.when(F.col("ends") > 1, F.col("ends_with")) == F.col("group"), "left")
        ends = F.when(F.col("ends") > 1, F.col("ends_sha256")).when(F.col("ends") == 1, F.sha2(F.col("ends_with").cast("string"), 256)).otherwise(F.sha2(F.lit(""), 256))
        return keep(stash(out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends.alias("ends_sha256")), "trie"))
