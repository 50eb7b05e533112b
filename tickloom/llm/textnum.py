"""Vectorised word hashing over Arrow string columns.

One pass over the UTF-8 bytes of a batch gives a 64-bit hash for every word, with no Python object
per word: a word's hash is a difference of two prefix sums of ``table[byte] * base**position``,
brought back to position zero with the inverse power and mixed. All arithmetic is modulo 2**64.
Batches are cut into slices of a bounded number of bytes, so that a batch of very long texts does
not need more memory than a batch of short ones (one text longer than the bound makes a slice of
its own).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, elementwise on uint64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _lanes(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


_BASE = 0x5851F42D4C957F2D  # odd, 5 modulo 8
_BASE_INV = pow(_BASE, -1, 1 << 64)
#: Bytes whose prefix sums are held at once.
CHUNK_BITS = 17


@cache
def _powers(base: int) -> np.ndarray:
    """base**i for i < 2**CHUNK_BITS, by doubling."""
    out = np.ones(1, dtype=U64)
    for k in range(CHUNK_BITS):
        out = np.concatenate([out, out * U64(pow(base, 1 << k, 1 << 64))])
    return out


@cache
def _byte_table(lower: bool) -> np.ndarray:
    table = _lanes(256, 11)
    if lower:
        table = table.copy()
        table[65:91] = table[97:123]
    return table


@cache
def _space() -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[9, 10, 11, 12, 13, 32]] = True
    return out


@cache
def _word_bytes() -> np.ndarray:
    """True for ASCII letters and digits and for every byte of a non-ASCII character."""
    out = np.zeros(256, dtype=bool)
    out[48:58] = out[65:91] = out[97:123] = out[128:] = True
    return out


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes of text, or of one row."""
    offsets = _offsets(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def freed(run: Run) -> Run:
    """``run``, which gives what it no longer uses back to the system at its end: a worker is kept for later tasks, and with it what Arrow's pool holds."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return out


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    raw = np.frombuffer(column.buffers()[1], dtype=kind, count=len(column) + column.offset + 1)
    return raw[column.offset :].astype(np.int64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array (a null has none) and the byte offsets of its rows."""
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    if column.null_count:
        column = column.fill_null("")
    offsets = _offsets(column)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray, alnum: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and the index of the first word of each row (one more at the end).

    Words are runs without ASCII white space, or with ``alnum`` runs of letters and digits. A row's
    end also ends a word.
    """
    inside = _word_bytes()[raw] if alnum else ~_space()[raw]
    edge = np.empty(len(raw) + 1, dtype=bool)
    edge[0] = True
    edge[1:-1] = ~inside[:-1]
    edge[-1] = True
    edge[offsets] = True  # a row begins a new word
    starts = np.flatnonzero(inside & edge[:-1])
    after = np.empty(len(raw), dtype=bool)
    if len(raw):
        after[:-1] = ~inside[1:]
        after[-1] = True
        cut = offsets[1:-1]
        after[cut[cut > 0] - 1] = True
    ends = np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each byte span; ``lower`` folds A-Z. Spans are in order and do not overlap.

    Prefix sums are made for ``2**CHUNK_BITS`` bytes at a time, so memory does not follow the slice.
    """
    table, up, down, most = _byte_table(lower), _powers(_BASE), _powers(_BASE_INV), 1 << CHUNK_BITS
    out = np.empty(len(starts), dtype=U64)
    prefix = np.zeros(most + 1, dtype=U64)
    k = 0
    while k < len(starts):
        lo = int(starts[k])
        j = int(np.searchsorted(ends, lo + most, side="right"))
        if j <= k:  # a span longer than a chunk
            out[k] = U64(_long_sum(raw, lo, int(ends[k]), table))
            k += 1
            continue
        part = raw[lo : int(ends[j - 1])]
        np.cumsum(table[part] * up[: len(part)], out=prefix[1 : len(part) + 1])
        first = starts[k:j] - lo
        out[k:j] = (prefix[ends[k:j] - lo] - prefix[first]) * down[first]
        k = j
    return mix64(out + (ends - starts).astype(U64))


def _long_sum(raw: np.ndarray, lo: int, hi: int, table: np.ndarray) -> int:
    total = 0
    for a in range(lo, hi, 1 << CHUNK_BITS):
        part = raw[a : min(hi, a + (1 << CHUNK_BITS))]
        total += int((table[part] * _powers(_BASE)[: len(part)]).sum(dtype=U64)) * pow(_BASE, a - lo, 1 << 64)
    return total % (1 << 64)


def hash_stems(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: tuple[int, ...]) -> Iterator[np.ndarray]:
    """Hash of the first bytes of each span, for each of the ascending ``sizes``; they differ from the spans' own by the size."""
    table, up = _byte_table(True), _powers(_BASE)
    total = np.zeros(len(starts), dtype=U64)
    for j in range(max(sizes)):
        inside = np.flatnonzero(starts + j < ends)
        total[inside] += table[raw[starts[inside] + j]] * up[j]
        if j + 1 in sizes:
            yield mix64(mix64(total + np.minimum(ends - starts, j + 1).astype(U64)) + U64(j + 1))


def words(column: pa.Array, alnum: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a slice, A-Z folded, and each row's first index among them."""
    raw, offsets = utf8(column)
    starts, ends, first = word_spans(raw, offsets, alnum)
    return hash_spans(raw, starts, ends), first


_STEP = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93]


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the runs of ``width`` words of each row; a shorter row's words are one run."""
    hashes, first = words(column)
    out = []
    runs = None
    if len(hashes) >= width:
        runs = hashes[: len(hashes) - width + 1] * U64(_STEP[0])
        for k in range(1, width):
            runs = (runs ^ (runs >> U64(29))) * U64(_STEP[0]) + hashes[k : len(hashes) - width + 1 + k] * U64(_STEP[k % 5])
        runs = mix64(runs)
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        if hi - lo >= width:
            out.append(np.unique(runs[lo : hi - width + 1]))
        elif hi > lo:
            one = np.array([hi - lo], dtype=U64)
            for k in range(lo, hi):
                one = mix64(one * U64(_STEP[1]) + hashes[k : k + 1])
            out.append(one)
        else:
            out.append(np.zeros(0, dtype=U64))
    return out
