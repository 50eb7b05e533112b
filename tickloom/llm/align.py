"""Operator 12: tokens of two vocabularies aligned by bytes, each distinct segment once.

Texts are cut before spaces where neither tokenizer can merge (``check_cuts`` verifies that for the given files), so the
tokens of a text are those of its segments, and both tokenizers have an end at every cut. A chunk of texts
lists its distinct segments by buckets of their hash; a bucket's task tokenises and aligns each distinct segment
of the corpus once and sends every chunk the alignments that it has listed, packed, in its order. The chunk composes its texts from
them. Corpus counts of linked ids are then sums over chunks, joined back to the chunks by id pair and looked up by the texts.

Nothing is dealt by a segment or an id pair whose rows could be very many: a chunk lists a segment, and an id pair, once.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, stash, working

A_PATH, B_PATH = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Before a space that has another character than a space before it and no white space after it.
CUT = re.compile(r" (?<=[^ ] )(?=[^\s])")
#: Characters of texts in a chunk; a longer text is a chunk of its own.
CHUNK = 1 << 24
#: Buckets of segments: so many at this many characters, and with the root of their number beyond, as vocabularies grow.
BUCKETS, BUCKETS_AT = 128, 1 << 28
#: An id pair in one number.
SHIFT = 20

CHUNKS = "chunk string, bucket int, data binary"
TEXTS = "chunk string, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, links binary, codes binary, docs binary"
COLUMNS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"


# the two tokenizers


@lru_cache(maxsize=2)
def byte_tokenizer(path: str):
    """Tokenizer and the bytes of each id. Byte-level entries stand for bytes by printable characters."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    vocab = t.get_vocab(with_added_tokens=False)
    size = max(vocab.values()) + 1
    out = [b""] * size
    for token, i in vocab.items():
        out[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return t, out


@lru_cache(maxsize=2)
def piece_tokenizer(path: str):
    """Processor and the bytes of each id."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        found = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
        out.append(bytes([int(found[1], 16)]) if found and sp.is_byte(i) else piece.replace(SPACE, " ").encode())
    return sp, out


def check_cuts(a_path: str, b_path: str) -> bool:
    """Whether neither tokenizer can merge across a cut.

    A: it splits texts by the byte-level pattern, where a space that white space does not follow starts a piece, and does not
    change them first. B: it does not change texts, puts a space before them, and no piece has a space after another character.
    """
    with open(a_path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    a_fine = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec["model"].get("continuing_subword_prefix") is None and spec["model"].get("end_of_word_suffix") is None
    sp = piece_tokenizer(b_path)[0]
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(b_path, "rb") as f:
        model.ParseFromString(f.read())
    norm = model.normalizer_spec
    same = norm.name == "identity" and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces and not norm.precompiled_charsmap
    inner = re.compile(f"[^{SPACE}]{SPACE}")
    return bool(a_fine and same and not any(inner.search(sp.id_to_piece(i)) for i in range(sp.get_piece_size())))


def segments(text: str) -> list[str]:
    """The segments of a text, each without the space that stands before it (before the first, the added one)."""
    out = CUT.split(f" {text}")
    out[0] = out[0][1:]
    return out


def align(a_ids: list[int], b_ids: list[int], a_bytes: list[bytes], b_bytes: list[bytes]) -> tuple[list[tuple[list[int], list[int]]], list[tuple[int, int]]]:
    """Groups between common ends, and links: pairs whose bytes overlap. Both lists must spell the same bytes."""
    groups, links = [], []
    i = j = a_end = b_end = 0
    left, right = [], []
    new_a = new_b = True
    while i < len(a_ids) and j < len(b_ids):
        if new_a:
            left.append(a_ids[i])
            a_end += len(a_bytes[a_ids[i]])
        if new_b:
            right.append(b_ids[j])
            b_end += len(b_bytes[b_ids[j]])
        links.append((a_ids[i], b_ids[j]))
        new_a, new_b = a_end <= b_end, b_end <= a_end
        i, j = i + new_a, j + new_b
        if new_a and new_b:
            groups.append((left, right))
            left, right = [], []
    return groups, links


def align_segments(parts: list[str], a_path: str, b_path: str) -> list[tuple[int, int, int, int, str, list[int]] | None]:
    """For each segment ``n_a, n_b, n_groups, n_links, groups, codes of links``; None where tokens do not spell the segment."""
    t, a_bytes = byte_tokenizer(a_path)
    sp, b_bytes = piece_tokenizer(b_path)
    out = []
    for k in range(0, len(parts), 10_000):
        some = parts[k : k + 10_000]
        for s, a, b in zip(some, t.encode_batch([f" {s}" for s in some], add_special_tokens=False), sp.encode(some, num_threads=1), strict=True):
            a = a.ids
            whole = f" {s}".encode()
            if b"".join([a_bytes[i] for i in a]) != whole or b"".join([b_bytes[i] for i in b]) != whole:
                out.append(None)
                continue
            groups, links = align(a, b, a_bytes, b_bytes)
            shown = ";".join([f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups])
            out.append((len(a), len(b), len(groups), len(links), shown, [x << SHIFT | y for x, y in links]))
    return out


# packing


def _packed(parts: list[str]) -> bytes:
    """Strings in one compressed piece: lengths in bytes, then the bytes."""
    data = [p.encode() for p in parts]
    return zstandard.compress(np.array([len(parts), *map(len, data)], "<i4").tobytes() + b"".join(data), 3)


def _unpacked(data: bytes) -> list[str]:
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, "<i4", 1)[0])
    ends = np.cumsum(np.frombuffer(raw, "<i4", n, 4), dtype=np.int64) + 4 * (n + 1)
    out, at = [], 4 * (n + 1)
    for end in ends.tolist():
        out.append(raw[at:end].decode())
        at = end
    return out


def _numbers(x, kind: str = "<i4") -> bytes:
    return zstandard.compress(np.ascontiguousarray(x, kind).tobytes(), 3)


def _array(data: bytes, kind: str = "<i4") -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def _pack_alignments(rows: list[tuple | None]) -> bytes:
    """Alignments of a list of segments: counts (-1 in the first where there are none), texts of groups, codes of links."""
    counts = np.array([r[:4] if r else (-1, 0, 0, 0) for r in rows], "<i4").reshape(-1, 4)
    codes = np.array([c for r in rows if r for c in r[5]], "<i8")
    shown = _packed([r[4] if r else "" for r in rows])
    head = np.array([len(rows), len(codes), len(shown)], "<i4").tobytes()
    return zstandard.compress(head + counts.tobytes() + codes.tobytes() + shown, 3)


def _unpack_alignments(data: bytes) -> tuple[np.ndarray, np.ndarray, list[str]]:
    raw = zstandard.decompress(data)
    n, m, size = np.frombuffer(raw, "<i4", 3).tolist()
    counts = np.frombuffer(raw, "<i4", 4 * n, 12).reshape(n, 4)
    codes = np.frombuffer(raw, "<i8", m, 12 + 16 * n)
    return counts, codes, _unpacked(raw[12 + 16 * n + 8 * m :][:size])


# chunks of texts


class _Local(dict):
    """Numbers of segments in the order in which they come."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def _chunk_rows(texts: list[str | None], ids: list[int | None], buckets: int, cut: bool) -> Iterator[tuple[str, int, bytes]]:
    """A chunk: bucket -1 holds its texts as numbers of segments, the other buckets their lists of segments."""
    chunk, local = uuid.uuid4().hex, _Local()
    lengths, seen = [], []
    for text in texts:
        parts = (segments(text) if cut else [text]) if text else []
        lengths.append(len(parts))
        seen.append(np.fromiter(map(local.__getitem__, parts), "<i4", len(parts)))
    lists: list[list[str]] = [[] for _ in range(buckets)]
    where = np.empty(len(local), "<i4")  # numbers in the order of buckets
    hashes = [zlib.crc32(s.encode()) % buckets for s in local]
    order = np.argsort(np.array(hashes, "<i4"), kind="stable")
    where[order] = np.arange(len(local), dtype="<i4")
    for s, h in zip(local, hashes, strict=True):
        lists[h].append(s)
    numbers = where[np.concatenate(seen)] if seen and len(local) else np.empty(0, "<i4")
    parts = [_numbers([i is not None for i in ids], "<i1"), _numbers([i or 0 for i in ids], "<i8"), _numbers(lengths), _numbers(numbers), _numbers([len(x) for x in lists])]
    yield chunk, -1, np.array([len(p) for p in parts], "<i8").tobytes() + b"".join(parts)
    for k, some in enumerate(lists):
        if some:
            yield chunk, k, _packed(some)


def _split(data: bytes, n: int) -> list[bytes]:
    sizes = np.frombuffer(data, "<i8", n).tolist()
    out, at = [], 8 * n
    for size in sizes:
        out.append(data[at : at + size])
        at += size
    return out


def _chunks(docs: DataFrame, id_col: str, text_col: str, buckets: int, cut: bool) -> DataFrame:
    schema = pa.schema([("chunk", pa.string()), ("bucket", pa.int32()), ("data", pa.binary())])

    def one(texts: list, ids: list) -> Iterator[pa.RecordBatch]:
        for row in _chunk_rows(texts, ids, buckets, cut):
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True))], schema)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ids, size = [], [], 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                if texts and size + len(text or "") > CHUNK:
                    yield from one(texts, ids)
                    texts, ids, size = [], [], 0
                texts.append(text)
                ids.append(i)
                size += len(text or "")
        if texts:
            yield from one(texts, ids)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(make, CHUNKS)


def _aligned(chunks: DataFrame, buckets: int, a_path: str, b_path: str) -> DataFrame:
    """The lists of segments replaced by their alignments. A bucket's task keeps what it has aligned, so each distinct segment is tokenised once."""
    schema = pa.schema([("chunk", pa.string()), ("bucket", pa.int32()), ("data", pa.binary())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, known = None, {}
        for b in batches:
            for chunk, k, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != bucket:
                    bucket, known = k, {}
                parts = _unpacked(data)
                new = [s for s in parts if s not in known]
                known.update(zip(new, align_segments(new, a_path, b_path), strict=True))
                yield pa.RecordBatch.from_pylist([{"chunk": chunk, "bucket": k, "data": _pack_alignments([known[s] for s in parts])}], schema)

    rows = chunks.where("bucket >= 0").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(make, CHUNKS)


_TEXTS = pa.schema([("chunk", pa.string()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("groups", pa.string()), ("links", pa.binary()), ("codes", pa.binary()), ("docs", pa.binary())])


def _compose(keep_groups: bool):
    """A chunk's texts from its numbers and the alignments: a row a text, and a last row with the chunk's id pairs and how many of its texts have each."""

    def make(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = left.column("chunk")[0].as_py()
        there, ids, lengths, numbers, sizes = (_array(d, k) for d, k in zip(_split(left.column("data")[0].as_py(), 5), ("<i1", "<i8", "<i4", "<i4", "<i4"), strict=True))
        got = dict(zip(right.column("bucket").to_pylist(), right.column("data").to_pylist(), strict=True))
        counts, codes, shown = [np.empty((0, 4), "<i4")], [np.empty(0, "<i8")], []
        for k, size in enumerate(sizes.tolist()):
            if size:
                c, x, s = _unpack_alignments(got.pop(k))
                counts.append(c)
                codes.append(x)
                shown += s
        counts, codes = np.concatenate(counts), np.concatenate(codes)
        pairs, local = np.unique(codes, return_inverse=True)
        local = local.astype("<i4")
        starts = np.concatenate([[0], np.cumsum(counts[:, 3], dtype=np.int64)])
        in_texts = np.zeros(len(pairs), np.int64)
        out = {f.name: [] for f in _TEXTS}
        at = 0
        for has_id, i, n in zip(there.tolist(), ids.tolist(), lengths.tolist(), strict=True):
            mine = numbers[at : at + n]
            at += n
            total, digest, text, links = np.zeros(4, np.int64), "", None, b""
            if n and counts[mine, 0].min() >= 0:
                total = counts[mine].sum(axis=0, dtype=np.int64)
                text = ";".join([shown[k] for k in mine.tolist()])
                digest = hashlib.sha256(text.encode()).hexdigest()
                distinct, times = np.unique(mine, return_counts=True)
                width = counts[distinct, 3]
                index = np.repeat(starts[distinct] - np.concatenate([[0], np.cumsum(width[:-1], dtype=np.int64)]), width) + np.arange(width.sum())
                held, back = np.unique(local[index], return_inverse=True)
                often = np.bincount(back, weights=np.repeat(times, width), minlength=len(held)).astype("<i8")
                in_texts[held] += 1
                parts = [_numbers(held), _numbers(often, "<i8")]
                links = np.array([len(p) for p in parts], "<i8").tobytes() + b"".join(parts)
            for name, value in zip(_TEXTS.names, (chunk, i if has_id else None, *total.tolist(), digest, text if keep_groups else None, links, None, None), strict=True):
                out[name].append(value)
        for name, value in zip(_TEXTS.names, (chunk, None, *[None] * 7, _numbers(pairs, "<i8"), _numbers(in_texts, "<i8")), strict=True):
            out[name].append(value)
        return pa.table(out, schema=_TEXTS)

    return make


def _listed_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for chunk, codes, docs in zip(*(c.to_pylist() for c in b.columns), strict=True):
            codes, docs = _array(codes, "<i8"), _array(docs, "<i8")
            has = np.flatnonzero(docs)
            for k in range(0, len(has), 1 << 16):
                some = has[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(some)), pa.array(some.astype("i4")), pa.array(codes[some]), pa.array(docs[some])], names=["chunk", "number", "code", "docs"])


_COLUMNS = pa.schema([*((c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string()), ("groups", pa.string())])


def _look_up(_key, left: pa.Table, right: pa.Table) -> pa.Table:
    """The texts of a chunk with sums over their links, from the corpus counts of the chunk's id pairs."""
    number = right.column("number").to_numpy()
    size = int(number.max()) + 1 if len(number) else 0
    count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    count[number] = right.column("count").to_numpy()
    best[number] = right.column("best").to_numpy()
    sums: dict[str, list[int]] = {"n_best": [], "count_sum": []}
    for links in left.column("links").to_pylist():
        held, often = (_array(d, k) for d, k in zip(_split(links, 2), ("<i4", "<i8"), strict=True)) if links else (np.empty(0, "<i4"), np.empty(0, "<i8"))
        sums["n_best"].append(int((best[held] * often).sum()))
        sums["count_sum"].append(int((count[held] * often).sum()))
    return pa.table([pa.array(sums[f.name], f.type) if f.name in sums else left.column(f.name).cast(f.type) for f in _COLUMNS], schema=_COLUMNS)


def alignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str = A_PATH, b_path: str = B_PATH, groups: bool = False) -> DataFrame:
    """A row per row of ``docs`` in ``COLUMNS``, written to the shared folder; ``groups`` is null unless asked for.

    Tokens of a text with a space before it, without special tokens. A null or empty text, and one that a tokenizer's bytes do not spell, has none: zeros,
    an empty digest and null groups. An id pair's count is the number of rows of ``docs`` that hold it linked; repeated rows count each, with or without id.
    The tokenizer files must be at their paths on every machine.
    """
    spark = docs.sparkSession
    cut = check_cuts(a_path, b_path)
    with working(spark) as keep:
        size = docs.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0))).first()[0]
        buckets = max(BUCKETS, int(BUCKETS * (size / BUCKETS_AT) ** 0.5))
        chunks = stash(_chunks(docs, id_col, text_col, buckets, cut), "chunks")
        found = _aligned(chunks, buckets, a_path, b_path)
        texts = stash(chunks.where("bucket = -1").groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_compose(groups), TEXTS), "texts")
        drop_stash(chunks)

        listed = texts.where("codes IS NOT NULL").select("chunk", "codes", "docs").mapInArrow(_listed_pairs, "chunk string, number int, code long, docs long")
        # never a broadcast: the planner knows the size of the packed rows only
        count = listed.groupBy("code").agg(F.sum("docs").alias("count"))
        most = count.groupBy(F.shiftright("code", SHIFT).alias("a")).agg(F.max("count").alias("most"))
        count = count.join(most.hint("merge"), F.shiftright("code", SHIFT) == F.col("a")).select(F.col("code").alias("pair"), "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
        back = listed.join(count.hint("merge"), F.col("code") == F.col("pair")).select("chunk", "number", "count", "best")
        own = texts.where("codes IS NULL").drop("codes", "docs")
        return keep(stash(own.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(_look_up, COLUMNS), "aligned"))
