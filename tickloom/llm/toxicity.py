"""Toxicity by a counterfactual-regularised linear classifier.

Texts are sets of words and of the beginnings of words, which catch inflected forms that no label
has (64-bit hashes, so that no two features share a weight by chance of a small table). A logistic
model is fitted on a bounded sample of labelled rows; its loss has a second term for pairs of
labelled texts that differ only in identity terms: the squared change of the score, as log odds. A text that
names groups is paired with itself after every such term has been exchanged for another one, or
taken out; as few texts name groups, a share of the others is paired with themselves after a term
has been put in. Pairs are made of words, before their features, so that a term's beginnings go
with it and those of other words stay. Neutral mentions so score as the rest of their text does. An
L1 term keeps the model to few words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, stash, working
from .textnum import U64, freed, hash_spans, hash_stems, mix64, slices, utf8, word_spans

#: Words that name groups of people; any other list can be given.
IDENTITY_TERMS = (
    "women men woman man girls boys female male gay lesbian straight bisexual transgender queer "
    "muslim muslims christian christians jewish jews hindu hindus buddhist atheist catholic protestant "
    "black white asian african european american mexican latino arab indian chinese "
    "immigrant immigrants refugee refugees foreigner native disabled deaf blind old young elderly"
).split()


@dataclass(frozen=True)
class ToxicityModel:
    """Sorted word hashes, their weights and the intercept; ``fitted`` is False without both labels."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    fitted: bool = True


#: Bytes of the beginnings of words that are features, besides the whole word.
STEMS = (4, 5, 6)
#: Texts are worked on in slices of so many bytes.
SLICE = 1 << 18
#: One in so many of the texts without identity terms is paired too.
PUT = 4


def _kinds(column: pa.Array) -> tuple[Iterator[np.ndarray], np.ndarray]:
    """Feature hashes of every word of a slice, one array for whole words and each length of stem, and each row's first index."""
    raw, offsets = utf8(column)
    starts, ends, first = word_spans(raw, offsets, alnum=True)

    def each() -> Iterator[np.ndarray]:
        yield hash_spans(raw, starts, ends)
        yield from hash_stems(raw, starts, ends, STEMS)

    return each(), first


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row of feature hashes for every word of a slice, and each text's first row."""
    kinds, first = _kinds(column)
    return np.stack(list(kinds), axis=1), first


def _swapped(rows: np.ndarray, named: np.ndarray, terms: np.ndarray, turn: int) -> np.ndarray | None:
    """The words of a text with its identity terms exchanged or taken out, or with one put in; None for no pair."""
    if not len(terms) or not len(named) and turn % PUT:
        return None
    turn //= PUT
    if not len(named):
        return np.concatenate([rows, terms[turn % len(terms)][None, :]])
    if turn % 3 == 0:
        return np.delete(rows, named, axis=0)
    out = rows.copy()
    own = np.searchsorted(terms[:, 0], rows[named, 0])
    out[named] = terms[(own + 1 + turn % max(1, len(terms) - 1)) % len(terms)]
    return out


def _lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
    flat = np.concatenate(sets) if sets else np.zeros(0, dtype=U64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _word_sets(terms: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=U64)
        for batch in batches:
            for lo, hi in slices(batch.column(2), SLICE):
                words, first = _features(batch.column(2).slice(lo, hi - lo))
                named = np.isin(words[:, 0], terms[:, 0])
                turns = mix64(batch.column(0).slice(lo, hi - lo).to_numpy().view(U64)) >> U64(8)
                sets, pairs = [], []
                for turn, a, b in zip(turns.tolist(), first[:-1], first[1:], strict=True):
                    other = _swapped(words[a:b], np.flatnonzero(named[a:b]), terms, turn)
                    sets.append(np.unique(words[a:b]))
                    pairs.append(none if other is None else np.unique(other))
                paired = pa.array([len(x) > 0 for x in pairs])
                columns = [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), _lists(sets), _lists(pairs), paired]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "y", "words", "swapped", "paired"])

    return run


def _terms(terms: Sequence[str]) -> np.ndarray:
    """Features of the identity terms, a row each, by the hash of the whole word."""
    out = _features(pa.array([" ".join(terms)]))[0]
    return out[np.unique(out[:, 0], return_index=True)[1]]


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = 8_000,
    identity_terms: Sequence[str] = IDENTITY_TERMS,
    counterfactual: float = 1.0,
    l1: float = 4e-5,
    rounds: int = 300,
    min_rows: int = 3,
) -> ToxicityModel:
    """Fit on at most ``max_rows`` labelled rows that are not held out, taken by the order of a hash of the id.

    Rows without id or label are left out; a label other than 0 is 1. Of rows that share an id one
    is taken. Without rows of both labels the model is not fitted.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) != 0).cast("int").alias("y")).where("id is not null and y is not null")
    known = known.where(~held_out("id")).groupBy("id").agg(F.max("y").alias("y"))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    share = max_rows / max(1, known.count())
    if share < 1:  # a little more than is asked for, so that tasks send few rows to the driver
        known = known.where(place < int(min(1.0, 1.1 * share + 1e-6) * (1 << 30)))
    known = known.orderBy(place, "id").limit(max_rows)  # bounded, so it can be broadcast
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    terms = _terms(identity_terms)
    rows = rows.join(F.broadcast(known), "id").select("id", "y", "text").mapInArrow(freed(_word_sets(terms)), "id long, y int, words array<long>, swapped array<long>, paired boolean")
    with working(docs.sparkSession):  # the model has all that is needed
        rows = stash(rows, "words")
        size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("pos")).first()
        if not 0 < size["pos"] < size["n"]:
            return ToxicityModel(np.zeros(0, dtype=U64), np.zeros(0), 0.0, False)
        # features are screened where they are; the driver gets only those that tell
        share = size["pos"] / size["n"]
        seen = rows.select("y", F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"), F.sum("y").alias("pos")).where(F.col("n") >= min_rows)
        telling = seen.where(F.abs(F.col("pos") - F.col("n") * share) > 3 * F.sqrt(F.col("n") * share * (1 - share))).select("w").toArrow()
        keys = np.union1d(telling.column("w").to_numpy().view(U64), np.unique(terms[:, 0]))
        table = rows.mapInArrow(freed(_only(keys)), rows.schema).toArrow().combine_chunks().sort_by([("id", "ascending")])
        own, pairs = _Sparse(table.column("words")), _Sparse(table.column("swapped"))
        return _fit(own, pairs, np.flatnonzero(table.column("paired").to_numpy()), table.column("y").to_numpy().astype(np.float64), counterfactual, l1, rounds)


def _only(keys: np.ndarray):
    def kept(lists: pa.ListArray) -> pa.Array:
        flat = lists.flatten().to_numpy(zero_copy_only=False).view(U64)
        known = np.isin(flat, keys)
        ends = np.concatenate([[0], np.cumsum(known)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat[known].view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), kept(batch.column(2)), kept(batch.column(3)), batch.column(4)], names=batch.schema.names)

    return run


class _Sparse:
    """Sets of features, one a text, as entries (row, feature)."""

    def __init__(self, column: pa.ChunkedArray):
        lists = column.combine_chunks()
        lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
        self.sizes = np.diff(lists.offsets.to_numpy())
        self.row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.flat = lists.flatten().to_numpy().view(U64)

    def index(self, keys: np.ndarray) -> None:
        self.col = np.searchsorted(keys, self.flat)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], minlength=len(self.sizes))

    def back(self, r: np.ndarray, d: int) -> np.ndarray:
        return np.bincount(self.col, r[self.row], minlength=d)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _fit(own: _Sparse, pairs: _Sparse, paired: np.ndarray, y: np.ndarray, counterfactual: float, l1: float, rounds: int) -> ToxicityModel:
    """Accelerated proximal steps on: mean log loss + counterfactual * mean squared change of the paired texts' log odds + l1 * |weights|."""
    keys = np.unique(np.concatenate([own.flat, pairs.flat]))
    own.index(keys)
    pairs.index(keys)
    n, d, m = len(y), len(keys), max(1, len(paired))
    # what a pair differs in: entries (text, feature) of one of the two, with a sign
    mine, other = own.row * d + own.col, pairs.row * d + pairs.col
    is_paired = np.zeros(n, dtype=bool)
    is_paired[paired] = True
    mine = mine[is_paired[own.row]]
    entry = np.concatenate([np.setdiff1d(other, mine), np.setdiff1d(mine, other)])
    sign = np.where(np.isin(entry, other), 1.0, -1.0)
    row, col = entry // d, entry % d
    positive = y.mean()
    b = float(np.log(positive / (1 - positive)))
    step = 1.0 / (0.25 * np.bincount(own.col, minlength=d) / n + 1e-3)  # diagonal steps, damped
    step *= 1.0 / max(8.0, np.percentile(own.sizes, 50) ** 0.5)
    most = max(1, int(np.bincount(row, minlength=1).max())) if len(row) else 1
    step /= 1 + step * 2 * counterfactual * most * np.bincount(col, minlength=d) / m
    m1, prev_w, t = np.zeros(d), np.zeros(d), 1.0
    for _ in range(rounds):
        r = (_sigmoid(own.times(m1) + b) - y) / n
        change = 2 * counterfactual / m * np.bincount(row, sign * m1[col], minlength=n)
        grad = own.back(r, d) + np.bincount(col, sign * change[row], minlength=d)
        w = m1 - step * grad
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        b -= 2.0 * r.sum()
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        m1 = w + (t - 1) / t_next * (w - prev_w)
        prev_w, t = w, t_next
    used = np.flatnonzero(np.abs(w) > 1e-3)
    return ToxicityModel(keys[used], w[used], b)


def _score(model: ToxicityModel, threshold: float):
    low = np.zeros(1 << 16, dtype=bool)  # most words are no key: their last bits say so
    low[(model.keys & U64(0xFFFF)).astype(np.int64)] = True

    def entries(column: pa.Array) -> np.ndarray:
        """Entries (row, key) of a slice, each once; words that are no key are let go kind by kind."""
        kinds, first = _kinds(column)
        out = []
        for hashes in kinds:
            maybe = np.flatnonzero(low[(hashes & U64(0xFFFF)).astype(np.int64)])
            at = np.searchsorted(model.keys, hashes[maybe])
            at[at == len(model.keys)] = 0
            same = model.keys[at] == hashes[maybe]
            out.append((np.searchsorted(first, maybe[same], side="right") - 1) * len(model.keys) + at[same])
        return np.unique(np.concatenate(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1), SLICE):
                z = np.full(hi - lo, model.bias)
                if len(model.keys):
                    both = entries(batch.column(1).slice(lo, hi - lo))
                    z += np.bincount(both // len(model.keys), model.weights[both % len(model.keys)], minlength=hi - lo)
                score = _sigmoid(z) if model.fitted else np.zeros(hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return run


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``doc_id, score, predicted`` for every row, from the whole text and nothing else.

    A null or empty text has no words and scores as the intercept does; repeated rows give repeated
    results; a null id stays null. A model that is not fitted scores 0.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return base.mapInArrow(freed(_score(model, threshold)), "doc_id long, score double, predicted int")
