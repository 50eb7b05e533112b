"""Byte-pair vocabularies: trained on a table of words by rounds of merges, and texts as ids.

Token k below 256 is byte k, and the token that merge number r makes has id 256 + r. Training works on arrays of the tokens of
many words, texts are encoded and spelt by arrays of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.codec import BINS, LETTERS
from tickloom.sources.sinks import dropped, materialised

#: The byte-level pattern of pieces that merges stay within, and those of chart blocks and price tokens.
WHITE = r"\t\n\x0B\f\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: The pattern for texts of ASCII only, which the built-in engine finds faster.
_ASCII_WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t\n\x0B\f\r A-Za-z0-9]+|[\t\n\x0B\f\r ]+(?![^\t\n\x0B\f\r ])|[\t\n\x0B\f\r ]+"
CHART = r"(?s)<chart>.*?</chart>"
PRICE = r"<chart>|</chart>|[OHLC]_\d+"
BYTES = 256
#: Merges that a round looks at, and merges after which the words are written anew with all of them done.
LOOK, REWRITE = 24, 8
#: Tokens of a row of packed words, about, and what stands after each word there.
PACK, GAP = 1 << 19, -1
#: Words after which an encoder sends its rows, and merges up to which it does one after the other.
FLUSH, IN_TURN = 1 << 18, 512
_PACKED = "tokens binary, counts binary"


@dataclass(frozen=True)
class Merge:
    rank: int
    left: int
    right: int
    count: int

    @property
    def made(self) -> int:
        return BYTES + self.rank


def words_of(texts: DataFrame, text: str) -> DataFrame:
    """``word, n``: the pieces of all texts with how often they occur, counted before they are dealt. Null texts have none."""
    pieces = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    return texts.select(F.explode(pieces).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and counts as rows of about ``PACK`` tokens: a word's tokens and ``GAP`` after each, and the words' counts, as bytes."""
    for b in batches:
        words, counts = b.column(0).cast(pa.binary()), b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes + 1)
        lo = 0
        while lo < len(words):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PACK, side="right")))
            tokens = _laid(words.slice(lo, hi - lo), sizes[lo:hi])
            yield _pack(tokens, counts[lo:hi])
            lo = hi


def _laid(words: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """The bytes of words one after the other, ``GAP`` after each."""
    total = int(sizes.sum())
    begin = int(np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset]) if total else 0
    tokens = np.full(total + len(sizes), GAP, dtype=np.int32)
    if total:
        tokens[np.arange(total) + np.repeat(np.arange(len(sizes)), sizes)] = np.frombuffer(words.buffers()[2], dtype=np.uint8)[begin : begin + total]
    return tokens


def _pack(tokens: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([tokens.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], names=["tokens", "counts"])


def _packs(batches: Iterator[pa.RecordBatch], merges: Sequence[Merge]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens, after the merges, and words' counts of each row."""
    for b in batches:
        for tokens, counts in zip(b.column(0), b.column(1), strict=True):
            yield _merged(np.frombuffer(tokens.as_buffer(), dtype=np.int32), merges), np.frombuffer(counts.as_buffer(), dtype=np.int64)


def _merged(tokens: np.ndarray, merges: Sequence[Merge]) -> np.ndarray:
    """Occurrences of a pair are taken from the left, as byte-pair encoding does."""
    for m in merges:
        at = np.flatnonzero((tokens[:-1] == m.left) & (tokens[1:] == m.right))
        if m.left == m.right and len(at):  # of a run of one token, every second place
            first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            at = at[(np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))) % 2 == 0]
        if len(at):
            tokens = tokens.copy()
            tokens[at] = m.made
            tokens = np.delete(tokens, at + 1)
    return tokens


def _weights(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The count of each token's word."""
    return counts[np.minimum(np.cumsum(tokens == GAP) - (tokens == GAP), max(len(counts) - 1, 0))]


def _sums(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and the sums of their weights, as whole numbers."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[first], np.add.reduceat(weights[order], first) if len(first) else weights[:0]


def _pair_counts(merges: Sequence[Merge], size: int):
    """``pair, n`` of a part's words; a pair is left * ``size`` + right. Sums of several rows are put together before they are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = size * size <= 1 << 21
        total, some = np.zeros(size * size if small else 0, dtype=np.int64), False
        for tokens, counts in _packs(batches, merges):
            at = np.flatnonzero((tokens[:-1] != GAP) & (tokens[1:] != GAP))
            codes = tokens[at].astype(np.int64) * size + tokens[at + 1]
            weights = _weights(tokens, counts)[at]
            if small and counts.sum() < 1 << 32:  # sums in floating point are exact so far
                total += np.bincount(codes, weights, minlength=size * size).astype(np.int64)
                some = True
            else:
                yield _named(["pair", "n"], *_sums(codes, weights))
        if some:
            found = np.flatnonzero(total)
            yield _named(["pair", "n"], found, total[found])

    return run


def _named(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=names)


def _beside(merges: Sequence[Merge], batch: Sequence[Merge], size: int):
    """``k, side, n``: how often a token (``side``, those after the pair from ``size`` on) stands beside the pair of merge ``k`` of the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, counts in _packs(batches, merges):
            weights = _weights(tokens, counts)
            for k, m in enumerate(batch):
                at = np.flatnonzero((tokens[:-1] == m.left) & (tokens[1:] == m.right))
                before, after = at[at > 0], at[at + 2 < len(tokens)]
                before, after = before[tokens[before - 1] != GAP], after[tokens[after + 2] != GAP]
                side, n = _sums(np.concatenate([tokens[before - 1], tokens[after + 2] + size]).astype(np.int64), np.concatenate([weights[before], weights[after]]))
                if len(side):
                    yield _named(["k", "side", "n"], np.full(len(side), k), side, n)

    return run


def train(words: DataFrame, n_merges: int, least: int = 2) -> list[Merge]:
    """The first ``n_merges`` merges of byte-pair training on ``words`` (``word, n``): always the most frequent pair, of equals the
    one of the smallest ids, while it occurs ``least`` times.

    Words are packed into rows of many and counted by arrays, a round in one pass over them that sends sums of pairs only. A round
    does several merges where they are sure to be the next ones: they share no token, so none changes another's count, and no pair that one
    makes is as frequent as a later one, as the counts of its triples show. The driver sees the most frequent ``LOOK`` pairs of a round
    and no others.
    """
    done: list[Merge] = []
    known = words.where("word IS NOT NULL AND n > 0").select(F.encode("word", "UTF-8").alias("word"), F.col("n").cast("long").alias("n"))
    parts = known.sparkSession.sparkContext.defaultParallelism * 2
    base = materialised(known.repartition(parts).mapInArrow(_cut, _PACKED))
    written = 0  # merges that ``base`` has
    while len(done) < n_merges:
        size = BYTES + len(done)
        sums = base.mapInArrow(_pair_counts(done[written:], size), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        top = [(r["pair"] // size, r["pair"] % size, r["n"]) for r in sums.where(F.col("n") >= least).orderBy(F.desc("n"), "pair").limit(LOOK).collect()]
        batch: list[Merge] = []
        used: set[int] = set()
        for a, b, n in top[: n_merges - len(done)]:
            if used & {a, b}:
                break
            used |= {a, b}
            batch.append(Merge(len(done) + len(batch), a, b, n))
        if not batch:
            break
        if len(batch) > 1:
            batch = _sure(base, done[written:], batch, size)
        done += batch
        if len(done) - written >= REWRITE:
            new = materialised(base.mapInArrow(_rewritten(done[written:]), _PACKED))
            dropped(base)
            base, written = new, len(done)
    dropped(base)
    return done


def _rewritten(merges: Sequence[Merge]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, counts in _packs(batches, merges):
            yield _pack(tokens, counts)

    return run


def _sure(base: DataFrame, merges: Sequence[Merge], batch: list[Merge], size: int) -> list[Merge]:
    """The beginning of ``batch`` before which no pair that its merges make can come."""
    sides = base.mapInArrow(_beside(merges, batch[:-1], size), "k long, side long, n long").groupBy("k", "side").agg(F.sum("n").alias("n"))
    most = {r["k"]: r["n"] for r in sides.groupBy("k").agg(F.max("n").alias("n")).collect()}
    out, bar = [], 0
    for k, m in enumerate(batch):
        if out and m.count <= bar:
            break
        out.append(m)
        bar = max(bar, most.get(k, 0))
    return out


def token_bytes(merges: Sequence[Merge]) -> list[bytes]:
    out = [bytes([k]) for k in range(BYTES)]
    for m in merges:
        out.append(out[m.left] + out[m.right])
    return out


def merges_frame(spark: SparkSession, merges: Sequence[Merge]) -> DataFrame:
    """``rank, left, right, token, count``; the token's bytes in hexadecimal."""
    spelt = token_bytes(merges)
    return spark.createDataFrame([(m.rank, m.left, m.right, spelt[m.made].hex(), m.count) for m in merges], "rank long, left long, right long, token string, count long")


class Encoder:
    """Ids of words, least rank first: pieces are linked, and a heap holds the merges that can be done."""

    def __init__(self, merges: Sequence[Merge], most: int = 1 << 17) -> None:
        self.ranks = {(m.left, m.right): m.rank for m in merges}
        self.known: dict[str, list[int]] = {}
        self.most = most  # words that are kept

    def word(self, word: str) -> list[int]:
        out = self.known.get(word)
        if out is None:
            if len(self.known) >= self.most:
                self.known.clear()
            out = self.known[word] = self._encode(word.encode())
        return out

    def _encode(self, data: bytes) -> list[int]:
        from heapq import heapify, heappop, heappush

        ids = list(data)
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        ranks = self.ranks
        heap = [(r, k) for k in range(n - 1) if (r := ranks.get((ids[k], ids[k + 1]))) is not None]
        heapify(heap)
        while heap:
            r, k = heappop(heap)
            j = after[k]
            if ids[k] < 0 or j < 0 or ranks.get((ids[k], ids[j])) != r:
                continue  # one of the two is no longer there
            ids[k], ids[j] = BYTES + r, -1
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y >= 0 and (q := ranks.get((ids[x], ids[y]))) is not None:
                    heappush(heap, (q, x))
        return [i for i in ids if i >= 0]


_TOKEN = re.compile(PRICE)


def split_prices(text: str, strict: bool, bins: int = BINS) -> list[tuple[bool, str]]:
    """``(is price, part)`` of a text: price tokens inside chart blocks (``strict``) or anywhere; tokens of no bin are text. Blank parts are left out."""
    out: list[tuple[bool, str]] = []

    def loose(part: str) -> None:
        at = 0
        for m in _TOKEN.finditer(part):
            if "_" in m[0] and int(m[0][2:]) >= bins:
                continue
            text_part(part[at : m.start()])
            out.append((True, m[0]))
            at = m.end()
        text_part(part[at:])

    def text_part(part: str) -> None:
        if part.strip():
            out.append((False, part))

    if not strict:
        loose(text)
        return out
    at = 0
    for block in re.finditer(CHART, text):
        text_part(text[at : block.start()])
        loose(block[0])
        at = block.end()
    text_part(text[at:])
    return out


def price_number(token: str) -> int:
    """Place of a price token or marker after the text's vocabulary."""
    if token == "<chart>":
        return len(LETTERS) * BINS
    if token == "</chart>":
        return len(LETTERS) * BINS + 1
    return LETTERS.index(token[0]) * BINS + int(token[2:])


def _ids_of(words: pa.Array, merges: Sequence[Merge], encoder: Encoder, first: int, base: int) -> pa.Array:
    """The ids of distinct words and price tokens, as lists: few merges are done in turn on all words at once, as a merge makes no pair of one before it."""
    if len(merges) <= IN_TURN:
        data = words.cast(pa.binary())
        tokens = _merged(_laid(data, pc.binary_length(data).to_numpy(zero_copy_only=False).astype(np.int64)), merges)
        at = np.flatnonzero(tokens == GAP)
        ends, ids = at - np.arange(len(at)), tokens[tokens != GAP]
    else:
        lists = [encoder.word(w) for w in words.to_pylist()]
        ends, ids = np.cumsum([len(x) for x in lists]), np.fromiter((i for x in lists for i in x), dtype=np.int32)
    ids = pa.array(ids + np.int32(first))
    out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), ids)
    is_price = pc.match_substring_regex(words, f"^(?:{PRICE})$")
    if not pc.any(is_price).as_py():
        return out
    own = pa.array([[base + price_number(w)] for w in words.filter(is_price).to_pylist()], out.type)
    where = np.arange(len(words))
    where[is_price.to_numpy(zero_copy_only=False)] = len(words) + np.arange(len(own))
    return pa.concat_arrays([out, own]).take(pa.array(where))


def encoded(df: DataFrame, text: str, merges: Sequence[Merge], out: str = "ids", prices: bool = True, strict: bool = True, first: int = 0) -> DataFrame:
    """``df`` with the ids of ``text``: those of its words by merges, those of price tokens after them, all from ``first`` on. A null text has null ids.

    Without ``prices`` all is text. A task takes texts of about ``FLUSH`` words at once and encodes their distinct words; nothing is shuffled.
    """
    base = BYTES + len(merges) + first
    rules = list(merges)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        encoder, pattern, plain = Encoder(rules), regex.compile(WORD), re.compile(_ASCII_WORD)
        for b in batches:
            done, found, ends, null = 0, [], [0], []
            for k in range(b.num_rows):
                t = b.column(text)[k].as_py()
                null.append(t is None)
                for is_price, part in (split_prices(t, strict) if prices else [(False, t)]) if t is not None else ():
                    if is_price:
                        found.append(part)  # no word has this form
                    else:
                        found += (plain if part.isascii() else pattern).findall(part)
                ends.append(len(found))
                if len(found) >= FLUSH or k + 1 == b.num_rows:
                    words = pa.array(found, pa.string()).dictionary_encode()
                    lists = _ids_of(words.dictionary, rules, encoder, first, base).take(words.indices)
                    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])[ends]
                    rows = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), lists.flatten(), mask=pa.array(null))
                    yield pa.RecordBatch.from_arrays([*(c.slice(done, k + 1 - done) for c in b.columns), rows], names=[*b.schema.names, out])
                    done, found, ends, null = k + 1, [], [0], []

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    return df.mapInArrow(make, schema)


def decoded(ids: Column, merges: Sequence[Merge]) -> Column:
    """The text of ids of words: their bytes in order. Ids beyond the merges give nothing."""
    table = F.array(*(F.lit(b.decode("latin-1")) for b in token_bytes(merges)))
    return F.decode(F.encode(F.array_join(F.transform(ids, lambda i: F.coalesce(F.get(table, i), F.lit(""))), ""), "ISO-8859-1"), "UTF-8")


def spelt(df: DataFrame, ids: str, merges: Sequence[Merge], out: str) -> DataFrame:
    """``df`` with the text of the array ``ids`` of words in its place, named ``out``, as ``decoded`` has it; null ids have a null text."""
    table = pa.array([*token_bytes(merges), b""], pa.large_binary())

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                lists = part.column(ids)
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                flat = pc.fill_null(pc.list_flatten(lists), -1).to_numpy(zero_copy_only=False)
                flat = np.where((flat < 0) | (flat >= len(table) - 1), len(table) - 1, flat)
                found = table.take(pa.array(flat))
                bounds = np.concatenate([[0], np.cumsum(pc.binary_length(found).to_numpy(zero_copy_only=False))])[np.concatenate([[0], np.cumsum(sizes)])]
                data = memoryview(found.buffers()[2]) if len(found) and found.buffers()[2] is not None else memoryview(b"")
                texts = [None if null else str(data[a:z], "utf-8", "replace") for a, z, null in zip(bounds[:-1], bounds[1:], lists.is_null().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(c for c, n in zip(part.columns, part.schema.names, strict=True) if n != ids), pa.array(texts, pa.string())], names=[*(n for n in part.schema.names if n != ids), out])

    schema = T.StructType([*(f for f in df.schema.fields if f.name != ids), T.StructField(out, T.StringType())])
    return df.mapInArrow(make, schema)
