"""Line deduplication with a segment-partition edit join.

Two lines are one if they are equal or at most ``max_edits`` insertions, deletions and
substitutions of code points apart; classes are the components of such links, and of each class the
first line (by document, then position) stays.

Lines within the threshold share one of ``max_edits + 1`` segments of the shorter one, at a place
that the lengths bound. Every line so goes into an index under its segments, and probes it with its
own substrings at those places, for each length that its partner can have. The counts of a candidate
pair's characters must also agree but for two an edit; a signature has them modulo four. What is left is verified
on the lines themselves with a bit-parallel edit distance in a band along the diagonal. Keys that
many lines have in the index, as lines of one form have, give no pairs: their lines are compared in
blocks of bounded size, which only links leave, by the counts of characters and of neighbouring
characters, and then in the same way; lines that are linked already are not compared again.

Keys and lines are hashes; the text of a line travels only if the line is in a candidate pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, fresh, stash, working
from .textnum import U64, freed, mix64, slices

#: Bits of the table that tells which lines are in a candidate pair: 1 MB, whatever the input.
TABLE_BITS = 23
SEEN = 1 << 18
#: Counters in a signature, of two bits each; characters share them by their last five bits, so that a-z have their own.
LANES = 32
#: Lines that an index key may have to give pairs, and lines in a block of those with more.
FEW = 64
BLOCK = 512
#: Keys up to which their table (8 bytes each) is broadcast.
MAX_BROADCAST = 100_000
_BASE = 0x2545F4914F6CDD1D
_BASE_INV = pow(_BASE, -1, 1 << 64)


@cache
def _powers(bits: int, base: int) -> np.ndarray:
    out = np.ones(1, dtype=U64)
    for k in range(bits):
        out = np.concatenate([out, out * U64(pow(base, 1 << k, 1 << 64))])
    return out


class Lines:
    """Lines of at least ``least`` code points of a slice of texts, with rolling hashes."""

    def __init__(self, column: pa.Array, least: int):
        texts = [x or "" for x in column.to_pylist()]
        self.points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        n = len(self.points)
        breaks = np.flatnonzero(self.points == 10)
        starts, ends = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [n]])
        of = np.searchsorted(np.cumsum([len(x) + 1 for x in texts]), starts, side="right")
        first = np.searchsorted(of, np.arange(len(texts)))
        position = np.arange(len(starts)) - first[of]
        long = ends - starts >= least
        self.start, self.end, self.doc, self.position = starts[long], ends[long], of[long], position[long]
        self.length = self.end - self.start
        codes = mix64(self.points.astype(U64) + U64(77))
        bits = max(1, n.bit_length())
        self.inverse = _powers(bits, _BASE_INV)
        self.prefix = np.zeros(n + 1, dtype=U64)
        np.cumsum(codes * _powers(bits, _BASE)[:n], out=self.prefix[1:])
        self.id = mix64(self.hash(self.start, self.end) ^ self.length.astype(U64) * U64(0x9E3779B97F4A7C15))
        self.signature = self._counts()

    def _counts(self, pairs: bool = False) -> np.ndarray:
        """Signature of each line: its characters' counts modulo four, low bits in the low half; with ``pairs``, those of neighbouring characters."""
        size = self.length - pairs
        if not size.sum():
            return np.zeros(len(size), dtype=U64)
        line = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(line)) + np.repeat(self.start - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        lane = self.points[at] & (LANES - 1)
        if pairs:
            lane = (mix64(self.points[at].astype(U64) << U64(32) | self.points[at + 1].astype(U64)) >> U64(59)).astype(np.int64)
        counts = np.bincount(line * LANES + lane, minlength=len(size) * LANES).reshape(-1, LANES)
        low, high = (((counts >> bit & 1).astype(U64) << np.arange(LANES, dtype=U64)).sum(axis=1, dtype=U64) for bit in (0, 1))
        return low | high << U64(LANES)

    def hash(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (self.prefix[hi] - self.prefix[lo]) * self.inverse[lo]

    def pick(self, rows: np.ndarray) -> None:
        for name in ("start", "end", "doc", "position", "length", "id", "signature"):
            setattr(self, name, getattr(self, name)[rows])

    def text(self, k: int) -> str:
        return self.points[self.start[k] : self.end[k]].tobytes().decode("utf-32-le", "surrogatepass")

    def _key(self, lo: np.ndarray, size: np.ndarray, length: np.ndarray, segment: int) -> np.ndarray:
        return mix64(self.hash(lo, lo + size) ^ mix64(length.astype(U64) * U64(64) + U64(segment)))

    def segments(self, max_edits: int) -> np.ndarray:
        """Index keys, a row for each line."""
        keys = []
        for i in range(max_edits + 1):
            at, size = segment(self.length, max_edits, i)
            keys.append(self._key(self.start + at, size, self.length, i))
        return np.stack(keys, axis=1)

    def probes(self, max_edits: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Probe keys, of substrings that can be a segment of a line as long or shorter: a row for each line, and which of them there are."""
        keys, there = [], []
        for gap in range(max_edits + 1):
            length = np.maximum(self.length - gap, least)
            for i in range(max_edits + 1):
                at, size = segment(length, max_edits, i)
                for shift in range(max(-i, gap - (max_edits - i)), min(i, gap + max_edits - i) + 1):
                    ok = (self.length - gap >= least) & (at + shift >= 0) & (at + shift + size <= self.length)
                    keys.append(self._key(self.start + np.where(ok, at + shift, 0), np.where(ok, size, 0), length, i))
                    there.append(ok)
        return np.stack(keys, axis=1), np.stack(there, axis=1)


def segment(length: np.ndarray, max_edits: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and size of segment ``i``; sizes differ by one at most, the longer ones last."""
    parts = max_edits + 1
    size, more = length // parts, length % parts
    return i * size + np.maximum(0, i - (parts - more)), size + (i >= parts - more)


def _walk(least: int, emit: Callable[[Lines, pa.Array], pa.RecordBatch | None]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                out = emit(Lines(batch.column(1).slice(lo, hi - lo), least), batch.column(0).slice(lo, hi - lo))
                if out is not None:
                    yield out

    return run


def _lists(values: np.ndarray, there: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values[there].view(np.int64)))


def _emit_lines(max_edits: int, least: int, floor: int):
    """Place of every line of ``floor`` code points; for the first of equal lines of ``least`` that a task meets, its keys too."""

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # forgotten when it grows, which only repeats keys

        def emit(lines: Lines, ids: pa.Array) -> pa.RecordBatch:
            distinct, first = np.unique(lines.id, return_index=True)
            fresh_ = np.array([x not in seen for x in distinct.tolist()], dtype=bool)
            if len(seen) > SEEN:
                seen.clear()
            seen.update(distinct[fresh_].tolist())
            new = np.zeros((len(lines.id), 1), dtype=bool)
            new[first[fresh_]] = True
            new[lines.length < least] = False
            index = lines.segments(max_edits)
            probe, there = lines.probes(max_edits, least)
            columns = [ids.take(pa.array(lines.doc)), pa.array(lines.position.astype(np.int32)), pa.array(lines.id.view(np.int64)), pa.array(lines.signature.view(np.int64)), _lists(index, np.repeat(new, index.shape[1], axis=1)), _lists(probe, there & new)]
            return pa.RecordBatch.from_arrays(columns, names=["doc", "position", "line", "signature", "segments", "probes"])

        yield from _walk(floor, emit)(batches)

    return start


def _emit_texts(least: int, words: np.ndarray):
    table = np.zeros(1 << (TABLE_BITS - 6), dtype=U64)
    table[words[:, 0].astype(np.int64)] = words[:, 1]

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # so that a very common line is sent once, or a few times, by a task

        def emit(lines: Lines, _: pa.Array) -> pa.RecordBatch | None:
            slot = (lines.id >> U64(64 - TABLE_BITS)).astype(np.int64)
            rows = np.flatnonzero(table[slot >> 6] >> (slot & 63).astype(U64) & U64(1))
            rows = rows[np.unique(lines.id[rows], return_index=True)[1]]
            rows = rows[[x not in seen for x in lines.id[rows].tolist()]] if len(rows) else rows
            if not len(rows):
                return None
            if len(seen) > SEEN:
                seen.clear()
            seen.update(lines.id[rows].tolist())
            return pa.RecordBatch.from_arrays([pa.array(lines.id[rows].view(np.int64)), pa.array([lines.text(k) for k in rows], pa.string())], names=["line", "text"])

        yield from _walk(least, emit)(batches)

    return start


def within(a: str, b: str, most: int) -> bool:
    """True if the edit distance is at most ``most``: bit-parallel columns, in a band of ``2 * most + 1`` rows.

    Column j of the distance table is kept as bits of the differences between the band's rows
    (row j - most to j + most), with the distance on the band's diagonal. The band moves down a row
    with every column.
    """
    if a == b:
        return True
    if abs(len(a) - len(b)) > most:
        return False
    k, m = 0, min(len(a), len(b))
    while k < m and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    k, m = 0, min(len(a), len(b))
    while k < m and a[-1 - k] == b[-1 - k]:
        k += 1
    a, b = a[: len(a) - k], b[: len(b) - k]
    if not a or not b:
        return max(len(a), len(b)) <= most
    width = 2 * most + 1
    full = (1 << width) - 1
    where: dict[str, list[int]] = {}
    for i, c in enumerate(a):
        where.setdefault(c, []).append(i)
    # rows of the band in column 0 are -most..most; below row 0 they count up, above it they do not exist
    up, down = (full >> most) << most & ~(1 << most) & full, 0
    for i in range(most + 1):
        up &= ~(1 << i)
    on_diagonal = 0
    for j, c in enumerate(b):
        low = j - most  # the band of column j + 1 has the characters of rows low .. low + width - 1
        match = 0
        for i in where.get(c, ()):
            if low <= i < low + width:
                match |= 1 << (i - low)
        # shifted: differences of column j at the rows of the new band
        vp, vn = up >> 1 | 1 << (width - 1), down >> 1
        d0 = ((((match & vp) + vp) ^ vp) | match | vn) & full
        hp, hn = vn | (full & ~(d0 | vp)), d0 & vp
        if not d0 >> most & 1:
            on_diagonal += 1
            if on_diagonal > 2 * most:
                return False
        # horizontal differences at row r become vertical ones below it in the new column
        hp_, hn_ = (hp << 1 | (low <= 0)) & full, hn << 1 & full
        up, down = hn_ | (full & ~(d0 | hp_)), d0 & hp_
        up, down = up & full, down & full
    # from the diagonal of the last column to the last row
    at = on_diagonal
    gap = len(a) - len(b)
    step = range(most + 1, most + 1 + gap) if gap > 0 else range(most, most + gap, -1)
    for r in step:
        change = (up >> r & 1) - (down >> r & 1)
        at += change if gap > 0 else -change
    return at <= most


def _verify(max_edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [within(x, y, max_edits) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least difference of the counts behind two arrays of signatures: one where low bits differ, two where only high ones do."""
    differ = x ^ y
    low, high = differ & U64((1 << LANES) - 1), differ >> U64(LANES)
    return np.bitwise_count(low).astype(np.int64) + 2 * np.bitwise_count(high & ~low)


def _compare(max_edits: int):
    def run(table: pa.Table) -> pa.Table:
        """Links of the lines of the first half with those of the second, or among themselves where there is none."""
        table = table.combine_chunks()
        line, half = (table.column(c).to_numpy() for c in ("line", "half"))
        texts = table.column("text").to_pylist()
        lines = Lines(pa.array(texts, pa.string()), 1)
        single, double, length = lines.signature, lines._counts(pairs=True), lines.length
        own, others = np.flatnonzero(half == 0), np.flatnonzero(half == 1)
        alone = not len(others)
        others = own if alone else others
        joined: dict[int, int] = {}

        def top(x: int) -> int:
            while joined.get(x, x) != x:
                joined[x] = joined.get(joined[x], joined[x])
                x = joined[x]
            return x

        links = []
        for k in range(0, len(own), 64):
            part = own[k : k + 64]
            near = _apart(single[part][:, None], single[others][None, :]) <= 2 * max_edits
            near &= np.abs(length[part][:, None] - length[others][None, :]) <= max_edits
            rows, cols = np.nonzero(near)
            x, y = part[rows], others[cols]
            keep = _apart(double[x], double[y]) <= 4 * max_edits  # an edit makes and unmakes two neighbours at most
            if alone:
                keep &= x < y
            for i, j in zip(x[keep].tolist(), y[keep].tolist(), strict=True):
                a, b = top(i), top(j)
                if a != b and line[i] != line[j] and within(texts[i], texts[j], max_edits):
                    joined[a] = b
                    links.append((int(line[i]), int(line[j])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def read_lines(docs: DataFrame, id_col: str, text_col: str, max_edits: int, least: int, floor: int) -> tuple[DataFrame, DataFrame]:
    """Documents as ``id, text``, and their lines with places, signatures and keys; lines below ``least`` have no keys."""
    if least <= max_edits:
        raise ValueError("lines must be longer than the threshold")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    return base, stash(base.mapInArrow(freed(_emit_lines(max_edits, least, floor)), "doc long, position int, line long, signature long, segments array<long>, probes array<long>"), "lines")


def line_links(base: DataFrame, lines: DataFrame, max_edits: int, least: int) -> DataFrame:
    """Pairs ``a, b`` of different lines (as hashes) at most ``max_edits`` apart, as many as their components need."""
    index, probe = (lines.select(F.explode(keys).alias("key"), F.col("signature").alias(f"signature_{c}"), F.col("line").alias(c)) for keys, c in (("segments", "a"), ("probes", "b")))
    # tasks that have seen a line forget it, and it comes again: lines of a key are counted with repeats, which only makes more keys crowded
    crowded = stash(lines.select(F.explode("segments").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > FEW).select("key"), "crowded")
    n_crowded = crowded.count()
    differ = F.col("signature_a").bitwiseXOR(F.col("signature_b"))
    low, high = differ.bitwiseAND((1 << LANES) - 1), F.shiftrightunsigned(differ, LANES)
    # counts differ by one modulo four where low bits differ, by two where only high ones do
    near = F.bit_count(low) + 2 * F.bit_count(high.bitwiseAND(F.bitwise_not(low))) <= 2 * max_edits
    hot = F.broadcast(crowded) if n_crowded <= MAX_BROADCAST else crowded.hint("merge")
    pairs = (index.join(hot, "key", "left_anti") if n_crowded else index).hint("merge").join(probe, "key").where((F.col("a") != F.col("b")) & near)
    pairs = stash(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("line")).unionByName(pairs.select(F.col("b").alias("line")))
    if n_crowded:
        members = index.select("key", F.col("a").alias("line")).unionByName(probe.select("key", F.col("b").alias("line")))
        members = stash(members.join(hot, "key").distinct(), "members")
        wanted = wanted.unionByName(members.select("line"))
    wanted = wanted.distinct()
    slot = F.shiftrightunsigned("line", 64 - TABLE_BITS)
    words = wanted.select(F.shiftright(slot, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int")).alias("v")).groupBy("w").agg(F.bit_or("v").alias("v")).toPandas()  # bounded by the table
    table = np.stack([words["w"].to_numpy(dtype=np.int64).view(U64), words["v"].to_numpy(dtype=np.int64).view(U64)], axis=1)
    texts = base.mapInArrow(freed(_emit_texts(least, table)), "line long, text string").join(wanted, "line", "left_semi").groupBy("line").agg(F.min("text").alias("text"))
    texts = stash(texts, "texts")
    left, right = (texts.select(F.col("line").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    links = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(freed(_verify(max_edits)), "a long, b long")
    if n_crowded:
        links = links.unionByName(_crowded_links(members, texts, max_edits))
    return stash(links, "links")


def _crowded_links(members: DataFrame, texts: DataFrame, max_edits: int) -> DataFrame:
    """Links among the lines that share a crowded key, in pairs of blocks."""
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    sizes = sizes.select(F.bitwise_not("key").alias("turned"), "blocks")  # joined by another key than the counts', so that a crowded one can be split
    rows = members.join(sizes, F.bitwise_not(F.col("key")) == F.col("turned")).withColumn("at", F.pmod(F.xxhash64("line"), F.col("blocks")).cast("int"))
    rows = rows.join(texts, "line")
    to = lambda x, y, half: F.struct(x.alias("x"), y.alias("y"), F.lit(half).alias("half"))
    own = F.transform(F.sequence(F.col("at"), F.col("blocks") - 1), lambda y: to(F.col("at"), y, 0))
    other = F.when(F.col("at") > 0, F.transform(F.sequence(F.lit(0), F.col("at") - 1), lambda x: to(x, F.col("at"), 1))).otherwise(F.array().cast("array<struct<x:int,y:int,half:int>>"))
    dealt = rows.withColumn("to", F.explode(F.concat(own, other))).select("key", "to.x", "to.y", "to.half", "line", "text")
    return dealt.groupBy("key", "x", "y").applyInArrow(_compare(max_edits), "a long, b long")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 2, least: int = 20, short: bool = False) -> DataFrame:
    """``docs`` with later lines of each class taken out of the text, and ``n_lines, n_removed, n_near, n_copied`` added.

    Lines are what line feeds separate. Those of fewer than ``least`` code points are never near another; with ``short``,
    those that are equal are one class too, else they are never removed. Empty lines always stay.
    n_lines counts all lines, n_removed those taken out, n_near those of the taken out that are not
    equal to any earlier line, n_copied those whose class stays in another document. A null text stays null and has no lines; an empty one has one empty line. A
    row without id keeps its text. Rows that share an id count as one document: a line that
    goes goes from each; of equal or near lines the first by document, then place, stays. Added columns get leading underscores where their names are taken.
    """
    base, lines = read_lines(docs, id_col, text_col, max_edits, least, 1 if short else least)
    with working(docs.sparkSession) as keep:
        found = keep(components(line_links(base, lines, max_edits, least)))
    places = lines.select("doc", "position", "line")
    same = places.groupBy("line").agg(F.min(F.struct("doc", "position")).alias("first"), F.count("*").alias("n"))
    same = same.join(found, F.col("line") == F.col("node"), "left").select("line", F.coalesce("root", "line").alias("root"), "first", "n")
    group = same.groupBy("root").agg(F.min("first").alias("keep"), F.sum("n").alias("total")).where("total > 1")
    # joined by another key than that of the counts, so that a very common line can be split
    later = same.join(group, "root").select(F.bitwise_not("line").alias("key"), "keep", F.col("first").alias("own"))
    gone = places.join(later, F.bitwise_not(F.col("line")) == F.col("key")).where("struct(doc, position) <> keep")
    gone = gone.select("doc", "position", (F.struct("doc", "position") == F.col("own")).alias("near"), (F.col("keep.doc") != F.col("doc")).alias("copied")).distinct()
    listed = gone.groupBy("doc").agg(F.collect_list("position").alias("removed"), F.count_if("near").alias("near"), F.count_if("copied").alias("copied"))
    names = fresh(docs, "n_lines", "n_removed", "n_near", "n_copied", "key_", "doc_", "removed_", "near_", "copied_", "parts_")
    key, doc, removed, near, copied, parts_ = names[4:]
    own = listed.select(F.col("doc").alias(doc), F.col("removed").alias(removed), F.col("near").alias(near), F.col("copied").alias(copied))
    out = docs.withColumn(key, F.col(id_col).cast("long")).join(own, F.col(key) == F.col(doc), "left").withColumn(parts_, F.split(F.col(text_col), "\n", -1))
    n = F.size(parts_)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), F.col(removed)), lambda i: F.get(F.col(parts_), i))
    text = F.when(F.col(removed).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    counts = [F.when(F.col(text_col).isNull(), 0).otherwise(n), *(F.coalesce(x, F.lit(0)) for x in (F.size(removed), near, copied))]
    return out.select(*(text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns), *(x.cast("long").alias(c) for x, c in zip(counts, names, strict=False)))
