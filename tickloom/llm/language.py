"""Language identification with hyperdimensional profiles.

Every letter of any script has a random vector of signs. A trigram binds its letters: the first letter's vector
rotated twice, the second's rotated once and the third's as it is, multiplied elementwise. A text
is the bundle (sum) of its trigrams, of unit length; a language's prototype is the bundle of its
texts less the bundle of all texts that any language would share. The prediction is the language
whose prototype has the greatest cosine with the text.

The letter vectors follow from a seed alone, so every executor makes the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out
from .textnum import slices

UNKNOWN = "und"
#: Trigrams and letters of which a worker keeps the vectors; beyond, it begins anew.
MAX_TRIGRAMS, MAX_LETTERS = 1 << 17, 1 << 15
_BITS = 21  # of a code point


@cache
def _folded() -> np.ndarray:
    """Small letter of each code point below 65536, 0 where it is no letter."""
    return np.array([_letter(cp) for cp in range(1 << 16)], dtype=np.int64)


def _letter(cp: int) -> int:
    c = chr(cp)
    return ord(c.lower()[0]) if c.isalpha() else 0


class _Bundler:
    """Bundles texts; keeps the vectors of trigrams and letters that it has met."""

    def __init__(self, dim: int):
        self.dim = dim
        self.letters: dict[int, np.ndarray] = {}
        self._forget()

    def _forget(self) -> None:
        self.codes, self.at = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)  # sorted trigrams, and where their vectors are
        self.vectors = np.empty((4096, self.dim), dtype=np.int8)

    def _signs(self, symbol: int) -> np.ndarray:
        """A letter's vector (and that of the edge of a word, 0), from its code point and a seed alone."""
        if symbol not in self.letters:
            if len(self.letters) > MAX_LETTERS:
                self.letters.clear()
            self.letters[symbol] = np.random.default_rng([1729, symbol]).choice(np.array([-1, 1], dtype=np.int8), self.dim)
        return self.letters[symbol]

    def _find(self, codes: np.ndarray) -> np.ndarray:
        """Places of sorted distinct trigrams among the vectors."""
        place = np.minimum(np.searchsorted(self.codes, codes), max(0, len(self.codes) - 1))
        new = codes[self.codes[place] != codes] if len(self.codes) else codes
        if len(self.codes) + len(new) > MAX_TRIGRAMS:
            self._forget()
            new = codes
        if len(new):
            n, mask = len(self.codes), (1 << _BITS) - 1
            while n + len(new) > len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.empty_like(self.vectors)])
            for k, code in enumerate(new.tolist(), n):
                self.vectors[k] = np.roll(self._signs(code >> 2 * _BITS), 2) * np.roll(self._signs(code >> _BITS & mask), 1) * self._signs(code & mask)
            place = np.searchsorted(self.codes, new)
            self.codes, self.at = np.insert(self.codes, place, new), np.insert(self.at, place, np.arange(n, n + len(new)))
        return self.at[np.searchsorted(self.codes, codes)]

    def texts(self, column: pa.Array) -> Iterator[np.ndarray | None]:
        """Unit bundle of each text, None where it has no letter."""
        texts = [x or "" for x in column.to_pylist()]
        points = np.frombuffer("\n".join(texts).encode("utf-32-le", "replace"), dtype=np.uint32)
        ends = np.cumsum(np.array([len(x) + 1 for x in texts]))
        symbols = np.where(points < (1 << 16), _folded()[np.minimum(points, (1 << 16) - 1)], 0)
        for k in np.flatnonzero(points >= (1 << 16)):
            symbols[k] = _letter(int(points[k]))
        start = 0
        for end in ends:
            s = symbols[start : end - 1]
            start = end
            letter = s > 0
            if not letter.any():
                yield None
                continue
            s = np.concatenate([[0], s[letter | np.concatenate([[False], letter[:-1]])], [0]])
            if s[-2] == 0:
                s = s[:-1]
            code, count = np.unique(s[:-2] << 2 * _BITS | s[1:-1] << _BITS | s[2:], return_counts=True)
            out = np.zeros(self.dim, dtype=np.float32)
            for k in range(0, len(code), 4096):
                at = self._find(code[k : k + 4096])
                out += count[k : k + 4096].astype(np.float32) @ self.vectors[at].astype(np.float32)
            yield out / max(float(np.linalg.norm(out)), 1e-12)


def _profile(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler, sums, seen = _Bundler(dim), {}, {}
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                langs = batch.column(0).slice(lo, hi - lo).to_pylist()
                for lang, v in zip(langs, bundler.texts(batch.column(1).slice(lo, hi - lo)), strict=True):
                    if v is not None:
                        sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
                        seen[lang] = seen.get(lang, 0) + 1
        for lang, v in sums.items():
            # integers, so that the sum over partitions is the same in any order
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim), pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.rint(v * 1e6).astype(np.int64)), pa.array(np.full(dim, seen[lang]))], names=["lang", "k", "v", "n"])

    return run


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dim: int = 512) -> dict[str, np.ndarray]:
    """Prototype of each language, from every row that is not held out and has a language and a letter.

    Each partition sends one vector a language; they are added by position, so what reaches the
    driver is ``dim`` numbers a language, whatever the size of the table.
    """
    rows = docs.where(~held_out(id_col)).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    parts = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).mapInArrow(_profile(dim), "lang string, k int, v long, n long")
    total = parts.groupBy("lang", "k").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).toPandas()
    sums = {lang: (part.sort_values("k")["v"].to_numpy(dtype=np.float64), int(part["n"].iloc[0])) for lang, part in total.groupby("lang")}
    out = {lang: v / np.linalg.norm(v) for lang, (v, _) in sorted(sums.items()) if np.linalg.norm(v)}
    if len(out) > 1:  # what all languages share says nothing
        shared = np.mean(list(out.values()), axis=0)
        out = {lang: v - shared for lang, v in out.items()}
    return {lang: (v / max(float(np.linalg.norm(v)), 1e-12)).astype(np.float32) for lang, v in out.items()}


def _predict(prototypes: dict[str, np.ndarray]):
    names = list(prototypes)
    dim = len(next(iter(prototypes.values()))) if prototypes else 8
    matrix = np.stack(list(prototypes.values())) if prototypes else np.zeros((0, dim), dtype=np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler = _Bundler(dim)
        for batch in batches:
            for lo, hi in slices(batch.column(2)):
                found = []
                for v in bundler.texts(batch.column(2).slice(lo, hi - lo)):
                    if v is None or not names:
                        found.append((UNKNOWN, 0.0))
                    else:
                        cosine = matrix @ v
                        best = int(cosine.argmax())
                        found.append((names[best], min(1.0, max(0.0, float(cosine[best])))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row; only the text is looked at.

    lang_pred is ``und`` with score 0 where the text is null or has no letter, or where nothing was
    learned. The score is the cosine, not below 0. Ties go to the first language by name. Repeated
    rows give repeated results.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return base.mapInArrow(_predict(prototypes), "doc_id long, held_out boolean, lang_pred string, score double")
