"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of two neighbouring blocks of ``BLOCK`` words. Terms are the benchmark's
words, less those so common that they tell nothing (every item keeps its rarest); their document
frequencies are counted over all blocks of all documents. A randomised singular value
decomposition, whose matrix products are summed over partitions, gives the latent space: of the
TF-IDF rows of the items and of the passages of a bounded sample of documents. Every passage of
every document is then projected and compared with all items by cosine, and what comes near is
verified on the words round it: the longest common subsequence with the item, and, where that is
only partial as in a paraphrase, the words of the item's answer. Items of fewer than ``SHORT`` words are a
small part of a passage; they are also looked for round every occurrence of their rarest word.

The benchmark is the query set. It is taken in blocks of bounded size, each against all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnum import U64, freed, hash_spans, mix64, slices, utf8, word_spans, words

BLOCK = 24
#: Rows of the sparse matrix that are multiplied at once, with the terms that they use.
GROUP = 64
#: Words below which an item is also looked up by its rarest word.
SHORT = 15


@dataclass
class Item:
    """An item's words and its answer's, as hashes."""

    id: int
    words: np.ndarray
    answer: np.ndarray


@dataclass
class Index:
    """Terms (sorted hashes), their weights, the latent basis and the items' unit vectors in it."""

    terms: np.ndarray
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    items: list[Item]
    cosine: float


def _hash(texts: list[str]) -> list[np.ndarray]:
    hashes, first = words(pa.array(texts, pa.string()), alnum=True)
    return [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def _last_sentence(text: str) -> str:
    parts = [p for p in re.split(r"[.?!\n]+", text) if p.strip()]
    return parts[-1] if parts else ""


class _Finder:
    """Position of each word among the terms, -1 for none."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.low = np.zeros(1 << 16, dtype=bool)
        self.low[(terms & U64(0xFFFF)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, dtype=np.int64)
        maybe = np.flatnonzero(self.low[(hashes & U64(0xFFFF)).astype(np.int64)])
        if len(maybe) and len(self.terms):
            at = np.searchsorted(self.terms, hashes[maybe])
            at[at == len(self.terms)] = 0
            same = self.terms[at] == hashes[maybe]
            out[maybe[same]] = at[same]
        return out


class _Blocks:
    """Term counts of the blocks of a slice of texts: entries (block, term, count), sorted by block."""

    def __init__(self, column: pa.Array, find: _Finder):
        raw, offsets = utf8(column)
        starts, ends, self.first = word_spans(raw, offsets, alnum=True)
        self.hashes = hash_spans(raw, starts, ends)
        n = np.diff(self.first)
        blocks = -(-n // BLOCK)
        self.base = np.concatenate([[0], np.cumsum(blocks)])  # a row's first block
        at = find(self.hashes)
        known = np.flatnonzero(at >= 0)
        row = np.searchsorted(self.first, known, side="right") - 1
        block = self.base[row] + (known - self.first[row]) // BLOCK
        both, self.count = np.unique(block * max(1, len(find.terms)) + at[known], return_counts=True)
        self.block, self.term = both // max(1, len(find.terms)), both % max(1, len(find.terms))

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Blocks that have terms, first blocks of windows (of those with terms, and a few without), and which blocks are their row's only one."""
        full, total, size = np.unique(self.block), int(self.base[-1]), np.diff(self.base)
        last, alone = np.zeros(total + 1, dtype=bool), np.zeros(total + 1, dtype=bool)
        last[self.base[1:][size > 0] - 1] = True
        alone[self.base[:-1][size == 1]] = True
        head = np.unique(np.concatenate([full, full[full > 0] - 1]))
        return full, head[~last[head] | alone[head]], alone


def _term_counts(terms: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, df, total = _Finder(terms), np.zeros(len(terms), dtype=np.int64), 0
        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                b = _Blocks(batch.column(0).slice(lo, hi - lo), find)
                df += np.bincount(b.term, minlength=len(terms))
                total += int(b.base[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(terms))), pa.array(np.concatenate([[total], df]))], names=["term", "n"])

    return run


def _dense(row: np.ndarray, term: np.ndarray, value: np.ndarray, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """A sparse matrix in groups of rows: first and last row, the terms in use, and the dense part. Entries are sorted by row."""
    starts = np.searchsorted(row, np.arange(0, n + GROUP, GROUP))
    for k, (a, z) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
        if a < z:
            lo = k * GROUP
            hi = min(lo + GROUP, n)
            used, at = np.unique(term[a:z], return_inverse=True)
            out = np.zeros((hi - lo, len(used)), dtype=value.dtype)
            out[row[a:z] - lo, at] = value[a:z]
            yield lo, hi, used, out


def _rows(b: _Blocks, idf: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Heads of the windows of a slice and the windows' TF-IDF rows times ``matrix``."""
    full, head, alone = b.windows()
    if not len(full) or not len(head):
        return np.zeros(0, dtype=np.int64), np.zeros((0, matrix.shape[1]), dtype=np.float32)
    value = (b.count * idf[b.term]).astype(np.float32)
    sums = np.zeros((len(full) + 1, matrix.shape[1]), dtype=np.float32)
    for lo, hi, used, dense in _dense(np.searchsorted(full, b.block), b.term, value, len(full)):
        sums[lo:hi] = dense @ matrix[used]
    place = lambda x: np.where(np.isin(x, full), np.searchsorted(full, x), len(full))
    return head, sums[place(head)] + np.where(alone[head][:, None], 0, sums[place(head + 1)])


def _sparse(b: _Blocks, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Windows' TF-IDF entries (window, term, value), rows of unit length, and the number of windows."""
    full, head, alone = b.windows()
    ends = np.concatenate([b.block, [1 << 62]])
    lo = np.searchsorted(ends, head)
    hi = np.searchsorted(ends, head + np.where(alone[head], 1, 2))
    size = hi - lo
    at = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    window = np.repeat(np.arange(len(head)), size)
    value = b.count[at] * idf[b.term[at]]
    norm = np.sqrt(np.bincount(window, value * value, minlength=len(head)))
    return window, b.term[at], value / np.maximum(norm[window], 1e-12), len(head)


def _product(terms: np.ndarray, idf: np.ndarray, right: np.ndarray):
    """Per partition, the rows of A'(A right) for its part of the TF-IDF matrix A."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, out = _Finder(terms), np.zeros((len(terms), right.shape[1]))
        for batch in batches:
            for lo, hi in slices(batch.column(0), 1 << 18):
                window, term, value, n = _sparse(_Blocks(batch.column(0).slice(lo, hi - lo), find), idf)
                if n:
                    _add_product(out, window, term, value, n, right)
        some = np.flatnonzero(np.abs(out).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(list(out[some]), pa.list_(pa.float64()))], names=["term", "row"])

    return run


def _add_product(out: np.ndarray, window: np.ndarray, term: np.ndarray, value: np.ndarray, n: int, right: np.ndarray) -> None:
    for _, _, used, dense in _dense(window, term, value, n):
        out[used] += dense.T @ (dense @ right[used])


def _sum_rows(table: pa.Table) -> pa.Table:
    term = table.column("term").to_numpy()
    rows = np.stack(table.column("row").to_numpy())
    ids, at = np.unique(term, return_inverse=True)
    out = np.zeros((len(ids), rows.shape[1]))
    np.add.at(out, at, rows)
    return pa.table({"term": pa.array(ids), "row": pa.array(list(out), pa.list_(pa.float64()))})


def _summed(sample: DataFrame, terms: np.ndarray, idf: np.ndarray, right: np.ndarray) -> np.ndarray:
    parts = sample.mapInArrow(freed(_product(terms, idf, right)), "term long, row array<double>")
    found = parts.groupBy(F.floor(F.col("term") / 64).alias("part")).applyInArrow(_sum_rows, "term long, row array<double>").toArrow()
    out = np.zeros((len(terms), right.shape[1]))
    if found.num_rows:
        out[found.column("term").to_numpy()] = np.stack(found.column("row").to_numpy())
    return out


def build_index(docs: DataFrame, items: list[tuple[int, str, str | None]], text_col: str = "text", rank: int = 256, fit_docs: int = 10_000, common: float = 0.02, keep: int = 16, cosine: float = 0.35) -> Index | None:
    """Index of a block of items (id, text, answer or None); None if no item has a word.

    The basis is fitted on the items and on about ``fit_docs`` documents, taken by a hash of their
    text; document frequencies cover all documents. Terms in more than the share ``common`` of all
    blocks are left out, but for the ``keep`` rarest of each item.
    """
    hashed, answers = _hash([t for _, t, _ in items]), _hash([_last_sentence(t) if a is None else a for _, t, a in items])
    kept = [Item(int(i), w, a) for (i, _, _), w, a in zip(items, hashed, answers, strict=True) if len(w)]
    if not kept:
        return None
    terms = np.unique(np.concatenate([x.words for x in kept]))
    text = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = text.mapInArrow(freed(_term_counts(terms)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df, total = np.zeros(len(terms), dtype=np.int64), 0
    for t, n in zip(counted["term"], counted["n"], strict=True):
        if t < 0:
            total = int(n)
        else:
            df[t] = n
    use = df <= common * total
    for x in kept:
        own = np.unique(np.searchsorted(terms, x.words))
        use[own[np.argsort(df[own], kind="stable")[:keep]]] = True
    terms, df = terms[use], df[use]
    idf = np.log((total + 2) / (df + 1))

    n_docs = max(1, docs.count())
    share = min(1.0, fit_docs / n_docs)
    sample = text.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20))).repartition(8)
    own = [_item_row(x, terms, idf) for x in kept]
    window = np.repeat(np.arange(len(own)), [len(t) for t, _ in own])
    term, value = np.concatenate([t for t, _ in own]), np.concatenate([v for _, v in own])
    weight = max(1.0, total * share / 2 / len(kept))  # items and passages weigh alike
    k = min(rank, len(terms))
    right = np.random.default_rng(99).standard_normal((len(terms), min(len(terms), k + 16)))
    product = _summed(sample, terms, idf, right)
    _add_product(product, window, term, value * np.sqrt(weight), len(own), right)
    q, _ = np.linalg.qr(product)
    product = _summed(sample, terms, idf, q)
    _add_product(product, window, term, value * np.sqrt(weight), len(own), q)
    size, turn = np.linalg.eigh((q.T @ product + product.T @ q) / 2)
    basis = (q @ turn[:, np.argsort(-size)[:k]]).astype(np.float32)
    vectors = np.zeros((len(own), k), dtype=np.float32)
    for i, (t, v) in enumerate(own):
        vectors[i] = v @ basis[t]
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return Index(terms, idf, basis, vectors, kept, cosine)


def _item_row(item: Item, terms: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = _Finder(terms)(item.words)
    term, count = np.unique(at[at >= 0], return_counts=True)
    value = count * idf[term]
    return term, value / max(float(np.linalg.norm(value)), 1e-12)


def common_words(masks: dict[int, int], region: list[int]) -> int:
    """Length of the longest common subsequence: one bit of an integer for each word of the item."""
    row = 0
    for w in region:
        hit = masks.get(w)
        if hit is not None:
            x = row | hit
            row = x & ((x - ((row << 1) | 1)) ^ x)
        # a word that the item lacks changes nothing
    return row.bit_count()


def _search(index: Index, partial: float, whole: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, basis, vectors = _Finder(index.terms), index.basis, index.vectors.T.copy()
        masks: list[dict[int, int]] = []
        for item in index.items:
            mask: dict[int, int] = {}
            for k, w in enumerate(item.words.tolist()):
                mask[w] = mask.get(w, 0) | 1 << k
            masks.append(mask)
        answers = [set(x.answer.tolist()) for x in index.items]
        anchors, anchored = _anchors(index)
        find_anchor = _Finder(anchors)

        def judge(found: dict[int, float], i: int, region: list[int]) -> None:
            n = len(index.items[i].words)
            share = common_words(masks[i], region) / n
            if share > found.get(i, 0.0) and (share >= (whole if n >= 8 else 1.0) or n >= 8 and share >= partial and _answered(answers[i], region)):
                found[i] = share

        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                b = _Blocks(batch.column(1).slice(lo, hi - lo), find)
                head, latent = _rows(b, index.idf, basis)
                found: list[dict[int, float]] = [{} for _ in range(hi - lo)]
                for a in range(0, len(head), 2048):
                    part = latent[a : a + 2048]
                    near = part @ vectors >= index.cosine * np.maximum(np.linalg.norm(part, axis=1), 1e-9)[:, None]
                    for w, i in zip(*np.nonzero(near), strict=True):
                        row = int(np.searchsorted(b.base, head[a + w], side="right") - 1)
                        if found[row].get(i, 0.0) >= 1.0:
                            continue
                        n = len(index.items[i].words)
                        at = b.first[row] + (head[a + w] - b.base[row]) * BLOCK
                        judge(found[row], i, b.hashes[max(b.first[row], at - n) : min(b.first[row + 1], at + 2 * BLOCK + n)].tolist())
                hit = find_anchor(b.hashes) if len(anchors) else np.zeros(0, dtype=np.int64)
                for at in np.flatnonzero(hit >= 0):
                    row = int(np.searchsorted(b.first, at, side="right") - 1)
                    for i in anchored[hit[at]]:
                        if found[row].get(i, 0.0) < 1.0:
                            n = len(index.items[i].words)
                            judge(found[row], i, b.hashes[max(b.first[row], at - n + 1) : min(b.first[row + 1], at + n)].tolist())
                lists = [sorted((index.items[i].id, s) for i, s in x.items()) for x in found]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                flat = [y for x in lists for y in x]
                version = pa.array(_versions(b, hi - lo).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), version, pa.ListArray.from_arrays(pa.array(ends), pa.array([i for i, _ in flat], pa.int64())), pa.ListArray.from_arrays(pa.array(ends), pa.array([s for _, s in flat], pa.float64()))], names=["id", "version", "items", "shares"])

    return run


def _versions(b: _Blocks, n: int) -> np.ndarray:
    """A hash of each text's words in order; texts of the same words have the same items."""
    place = np.arange(len(b.hashes)) - np.repeat(b.first[:-1], np.diff(b.first))
    ends = np.concatenate([[0], np.cumsum(mix64(b.hashes + mix64(place.astype(U64) + U64(3))), dtype=U64)])
    return ends[b.first[1:]] - ends[b.first[:-1]] if n else np.zeros(0, dtype=U64)


def _anchors(index: Index) -> tuple[np.ndarray, list[list[int]]]:
    """The rarest words of the items of fewer than ``SHORT`` words, sorted, and the items of each."""
    find, own = _Finder(index.terms), {}
    for i, item in enumerate(index.items):
        if len(item.words) < SHORT:
            at = find(item.words)
            at = at[at >= 0]
            own.setdefault(int(index.terms[at[np.argmax(index.idf[at])]]), []).append(i)
    return np.array(sorted(own), dtype=U64), [own[w] for w in sorted(own)]


def _answered(answer: set[int], region: list[int]) -> bool:
    return bool(answer) and len(answer.intersection(region)) >= 0.6 * len(answer)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    answer_col: str | None = None,
    partial: float = 0.55,
    whole: float = 0.7,
    block_items: int = 2048,
    block_chars: int = 2_000_000,
    **fit: float,
) -> DataFrame:
    """``doc_id, contaminated, n_items, items, best`` for every row of ``docs``.

    A document has an item if the longest common subsequence with it, round some passage, is the
    share ``whole`` of the item's words, or ``partial`` with three fifths of the answer's distinct words present (the item's last
    sentence, where there is no answer column). Items of fewer than 8 words must be there whole. An item of fewer than ``SHORT``
    words that stands in a document as it is is always found.
    Items without a word, or with a null id, are no items; items of the same id are one in the result. Null and
    empty texts have no items; a null id stays null; repeated rows give repeated results. best is
    the greatest share (0 without items), items the comma-joined ids in ascending order. Items are taken in blocks of
    ``block_items`` items and ``block_chars`` code points at most, about, which bounds the terms and so the
    index that a worker holds; rows that share an id, or have none, each get what their own text has.
    """
    known = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull())
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(item_text_col)), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["n"] // block_items), -(-size["chars"] // block_chars))
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    none = F.array().cast("array<struct<item:bigint,share:double>>")
    parts = []
    for k in range(blocks):
        own = known.where(F.pmod(F.xxhash64(item_col, item_text_col), F.lit(blocks)) == k)
        rows = own.select(F.col(item_col).cast("long"), F.col(item_text_col), F.col(answer_col) if answer_col else F.lit(None).cast("string")).collect()
        index = build_index(base, sorted((tuple(r) for r in rows), key=lambda r: (r[0], r[1])), "text", **fit)
        if index is not None:
            parts.append((index, base.mapInArrow(freed(_search(index, partial, whole)), "id long, version long, items array<long>, shares array<double>")))
    if len(parts) == 1:
        out = parts[0][1].select("id", F.arrays_zip(F.col("items").alias("item"), F.col("shares").alias("share")).alias("found"))
    elif parts:  # only documents with items are brought together, by id and text, as an id can be null or shared
        every = None
        for _, p in parts:
            hits = p.select("id", "version", F.explode(F.arrays_zip(F.col("items").alias("item"), F.col("shares").alias("share"))).alias("one"))
            every = hits if every is None else every.unionByName(hits)
        hits = every.groupBy("id", "version").agg(F.collect_set("one").alias("found"))
        own = parts[0][1].select(F.col("id").alias("id_"), F.col("version").alias("version_"))
        out = own.join(hits, F.col("id_").eqNullSafe(F.col("id")) & (F.col("version_") == F.col("version")), "left").select(F.col("id_").alias("id"), F.coalesce("found", none).alias("found"))
    else:
        out = base.select("id", none.alias("found"))
    out = out.select("id", F.transform("found", lambda x: x["item"]).alias("items"), F.transform("found", lambda x: x["share"]).alias("shares"))
    items = F.array_sort(F.array_distinct("items"))
    return out.select(F.col("id").alias("doc_id"), (F.size("items") > 0).alias("contaminated"), F.size(items).cast("long").alias("n_items"), F.array_join(items.cast("array<string>"), ",").alias("items"), F.coalesce(F.array_max("shares"), F.lit(0.0)).alias("best"))
