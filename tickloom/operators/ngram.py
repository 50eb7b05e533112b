"""A trigram model with interpolated Kneser-Ney discounts: counted, normalised and applied as joins.

Tokens are any column that can be compared. A sequence has two marks before it and one after it; the marks before are never
predicted. Of the lower orders, counts are of distinct words before, not of occurrences. The lowest order is shared out evenly among all
predicted tokens and the unknown one, so that each context's probabilities sum to one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.sources.sinks import materialised

ORDER = 3
#: Tokens that are counted at once, about, and such packs a file where they are written.
PACK, PACKS_A_FILE = 1 << 21, 4

Mark = str | int


@dataclass(frozen=True)
class Model:
    """``three``: ``u, v, w, c`` counts; ``two``: ``v, w, c`` and ``one``: ``w, c`` of distinct words before; ``after_two`` and ``after_one``:
    ``total, kinds`` of what follows a context; ``discounts`` by order; ``total`` and ``kinds`` of ``one``. The mark before a sequence and that after it are ``begin`` and ``end``."""

    three: DataFrame
    two: DataFrame
    one: DataFrame
    after_two: DataFrame
    after_one: DataFrame
    discounts: tuple[float, float, float]
    total: int
    kinds: int
    begin: Mark
    end: Mark


def marked(tokens: Column, begin: Mark = "<s>", end: Mark = "</s>") -> Column:
    """A sequence with its marks."""
    return F.concat(F.array(F.lit(begin), F.lit(begin)), tokens, F.array(F.lit(end)))


def trigrams(df: DataFrame, tokens: Column, *keep: str) -> DataFrame:
    """``*keep, place, u, v, w`` for every token of an array but its first two; a null array has none."""
    n = F.greatest(F.size(tokens) - 2, F.lit(0))
    z = F.arrays_zip(F.slice(tokens, F.lit(1), n).alias("u"), F.slice(tokens, F.lit(2), n).alias("v"), F.slice(tokens, F.lit(3), n).alias("w"))
    return df.where(tokens.isNotNull()).select(*keep, F.posexplode(z).alias("place", "g")).select(*keep, "place", "g.u", "g.v", "g.w")


def _packs(batches: Iterator[pa.RecordBatch], tokens: str) -> Iterator[pa.Table]:
    """Rows that together hold about ``PACK`` tokens; a longer row is one pack. Null arrays are left out."""
    held, size = [], 0
    for b in batches:
        b = b.filter(pc.is_valid(b.column(tokens)))
        ends = np.cumsum(pc.list_value_length(b.column(tokens)).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        lo = 0
        while lo < b.num_rows:
            before = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + PACK - size, side="right")))
            held.append(b.slice(lo, hi - lo))
            size += int(ends[hi - 1]) - before
            lo = hi
            if size >= PACK or lo < b.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _dense(parts: Sequence[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """For rows of several numbers below given sizes: each row's place among the distinct ones, and a row of each."""
    code, size = parts[0][0].astype(np.int64), parts[0][1]
    for part, n in parts[1:]:
        if size * n >= 1 << 62:
            enc = pa.array(code).dictionary_encode()
            code, size = enc.indices.to_numpy().astype(np.int64), len(enc.dictionary)
        code, size = code * n + part, size * n
    enc = pa.array(code).dictionary_encode()
    place = enc.indices.to_numpy()
    first = np.zeros(len(enc.dictionary), dtype=np.int64)
    first[place[::-1]] = np.arange(len(place))[::-1]
    return place, first


@dataclass
class _Grams:
    """The trigrams of a pack: of each its row; the tokens as numbers, where each trigram begins, and the tokens' values."""

    row: np.ndarray
    tokens: np.ndarray
    at: np.ndarray
    values: pa.Array

    def columns(self, which: np.ndarray) -> list[pa.Array]:
        return [self.values.take(pa.array(self.tokens[self.at[which] + k])) for k in range(ORDER)]

    def parts(self) -> list[tuple[np.ndarray, int]]:
        return [(self.tokens[self.at + k], len(self.values)) for k in range(ORDER)]


def _grams(table: pa.Table, tokens: str, marks: tuple[Mark, Mark] | None) -> _Grams:
    lists = table.column(tokens).combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().dictionary_encode(null_encoding="encode")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    values, codes = flat.dictionary, flat.indices.to_numpy().astype(np.int64)
    ahead, behind = (2, 1) if marks else (0, 0)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.concatenate([[0], np.cumsum(sizes + ahead + behind)])
    out = np.empty(int(starts[-1]), dtype=np.int64)
    out[np.arange(len(codes)) + rows * (ahead + behind) + ahead] = codes
    if marks:
        places = []
        for m in marks:
            k = pc.index(values, pa.scalar(m, values.type)).as_py()
            if k < 0:
                k = len(values)
                values = pa.concat_arrays([values, pa.array([m], values.type)])
            places.append(k)
        out[starts[:-1]] = out[starts[:-1] + 1] = places[0]
        out[starts[1:] - 1] = places[1]
    n = np.maximum(np.diff(starts) - (ORDER - 1), 0)
    row = np.repeat(np.arange(len(sizes)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + starts[:-1][row]
    return _Grams(row, out, at, values)


def counted(df: DataFrame, tokens: str, *by: str, marks: tuple[Mark, Mark] | None = ("<s>", "</s>")) -> DataFrame:
    """``*by, u, v, w, c``: how often each trigram is there. Packs of rows are counted as arrays, so that only their distinct trigrams are sent."""
    token = df.schema[tokens].dataType.elementType
    names = [*by, "u", "v", "w", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _packs(batches, tokens):
            g = _grams(table, tokens, marks)
            if len(g.row):
                keys = [table.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in by]
                keys = [k.combine_chunks() if isinstance(k, pa.ChunkedArray) else k for k in keys]
                keys = [k.chunk(0) if isinstance(k, pa.ChunkedArray) else k for k in keys]
                place, first = _dense([*g.parts(), *((k.indices.to_numpy()[g.row], len(k.dictionary)) for k in keys)])
                rows = pa.array(g.row[first])
                own = [k.dictionary.take(k.indices.take(rows)) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, *g.columns(first), pa.array(np.bincount(place, minlength=len(first)))], names=names)

    schema = T.StructType([*(df.schema[c] for c in by), *(T.StructField(c, token) for c in "uvw"), T.StructField("c", T.LongType())])
    return df.select(*by, tokens).mapInArrow(run, schema).groupBy(*names[:-1]).agg(F.sum("c").alias("c"))


def discount(counts: DataFrame) -> float:
    """n1 / (n1 + 2 n2) of the counts of counts; 0.5 where nothing is there once."""
    n1, n2 = counts.agg(F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    return n1 / (n1 + 2 * n2) if n1 else 0.5


def fit(df: DataFrame, tokens: str, begin: Mark = "<s>", end: Mark = "</s>") -> Model:
    """Counts are partial aggregates, so that a very common trigram or context is no task's alone; all but the discounts and two totals stay tables."""
    return fit_counts(counted(df, tokens, marks=(begin, end)), begin, end)


def fit_counts(counts: DataFrame, begin: Mark = "<s>", end: Mark = "</s>") -> Model:
    """The model of trigrams that are counted already: ``u, v, w, c``."""
    three = materialised(counts)
    two = materialised(three.groupBy("v", "w").agg(F.count("*").alias("c")))
    one = materialised(two.groupBy("w").agg(F.count("*").alias("c")))
    after_two = materialised(three.groupBy("u", "v").agg(F.sum("c").alias("total"), F.count("*").alias("kinds")))
    after_one = materialised(two.groupBy("v").agg(F.sum("c").alias("total"), F.count("*").alias("kinds")))
    total, kinds = one.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    return Model(three, two, one, after_two, after_one, (discount(one), discount(two), discount(three)), total, kinds, begin, end)


def _renamed(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*(F.col(c).alias(n) for c, n in names.items()))


def with_chance(grams: DataFrame, model: Model, out: str = "p") -> DataFrame:
    """Distinct ``u, v, w`` with the probability of ``w`` after ``u, v``. An unknown ``w`` has the share of the unknown token; an unknown context that of the next lower order.

    A trigram's row meets the counts by equal keys; contexts that very many trigrams share are split by the adaptive planner, as their side has one row each.
    """
    d1, d2, d3 = model.discounts
    g = grams.select("u", "v", "w").distinct()
    same = lambda a, b: F.col(a) == F.col(b)
    g = g.join(_renamed(model.three, u="u3", v="v3", w="w3", c="c3"), same("u", "u3") & same("v", "v3") & same("w", "w3"), "left")
    g = g.join(_renamed(model.after_two, u="ua", v="va", total="t3", kinds="k3"), same("u", "ua") & same("v", "va"), "left")
    g = g.join(_renamed(model.two, v="v2", w="w2", c="c2"), same("v", "v2") & same("w", "w2"), "left")
    g = g.join(_renamed(model.after_one, v="vb", total="t2", kinds="k2"), same("v", "vb"), "left")
    g = g.join(_renamed(model.one, w="w1", c="c1"), same("w", "w1"), "left")

    def order(count: str, total: str, kinds: str, d: float, below: Column) -> Column:
        kept = F.greatest(F.coalesce(count, F.lit(0)) - d, F.lit(0.0)) / F.col(total)
        return F.when(F.col(total).isNull(), below).otherwise(kept + F.lit(d) * F.col(kinds) / F.col(total) * below)

    even = F.lit(1.0 / (model.kinds + 1))
    p1 = F.greatest(F.coalesce("c1", F.lit(0)) - d1, F.lit(0.0)) / model.total + d1 * model.kinds / model.total * even if model.total else even
    p2 = order("c2", "t2", "k2", d2, p1)
    return g.select("u", "v", "w", order("c3", "t3", "k3", d3, p2).alias(out))


def losses(df: DataFrame, tokens: str, model: Model, *keep: str, whole: bool = True) -> DataFrame:
    """``*keep, n, loss``: predicted tokens of each row and the sum of their negative log probabilities.

    Whole sequences get their marks, that after them counts as predicted; else the first two tokens are the context of the others, and shorter sequences have no row.
    ``keep`` names a row; rows that share it count together. Rows are packed and only the distinct trigrams of a pack are looked up.
    """
    return losses_of(packed(df, tokens, *keep, marks=(model.begin, model.end) if whole else None), model)


@dataclass(frozen=True)
class Packs:
    """Packs of rows: what names the rows, their numbers of trigrams, the places of these among the pack's distinct ones, and those with their counts; ``apart`` tells packs of one kind."""

    table: DataFrame
    keep: tuple[T.StructField, ...]

    def grams(self) -> DataFrame:
        """``pack, apart, place, u, v, w, c`` of the distinct trigrams of each pack."""
        return self.table.select("pack", "apart", F.posexplode(F.arrays_zip("u", "v", "w", "c")).alias("place", "g")).select("pack", "apart", "place", "g.u", "g.v", "g.w", "g.c")

    def counts(self, apart: bool) -> DataFrame:
        """``u, v, w, c`` over the packs that are ``apart``, or those that are not."""
        return self.grams().where(F.col("apart") == apart).groupBy("u", "v", "w").agg(F.sum("c").alias("c"))


def packed(df: DataFrame, tokens: str, *keep: str, marks: tuple[Mark, Mark] | None = ("<s>", "</s>"), apart: str | None = None) -> Packs:
    """Packs of the rows of ``df``, written; rows whose boolean ``apart`` (one of ``keep``) is true or null are in packs of their own."""
    token = df.schema[tokens].dataType.elementType
    fields = [df.schema[c] for c in keep]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, kind in ((t, k) for whole in _packs(batches, tokens) for t, k in _sorted_apart(whole, apart)):
            g = _grams(table, tokens, marks)
            if len(g.row):
                place, first = _dense(g.parts())
                n = np.bincount(g.row, minlength=table.num_rows).astype(np.int32)
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                whole_ = lambda x: pa.concat_arrays(x.chunks)
                own = [one(whole_(table.column(c))) for c in keep]
                data = pa.array([place.astype(np.int32).tobytes()], pa.binary())
                count = one(pa.array(np.bincount(place, minlength=len(first)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([kind]), *own, one(pa.array(n)), data, *map(one, g.columns(first)), count], names=packs_schema.fieldNames())

    listed = [T.StructField(f"keep_{k}", T.ArrayType(f.dataType)) for k, f in enumerate(fields)]
    packs_schema = T.StructType([T.StructField("pack", T.StringType()), T.StructField("apart", T.BooleanType()), *listed, T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("places", T.BinaryType()), *(T.StructField(c, T.ArrayType(token)) for c in "uvw"), T.StructField("c", T.ArrayType(T.IntegerType()))])
    table = materialised(df.select(*keep, tokens).mapInArrow(pack, packs_schema), PACKS_A_FILE)
    return Packs(table, tuple(fields))


def _sorted_apart(table: pa.Table, apart: str | None) -> Iterator[tuple[pa.Table, bool]]:
    if apart is None:
        yield table, False
        return
    kind = pc.fill_null(table.column(apart), True)
    for value, rows in ((False, pc.invert(kind)), (True, kind)):
        some = table.filter(rows)
        if some.num_rows:
            yield some.combine_chunks(), value


def losses_of(packs: Packs, model: Model) -> DataFrame:
    """``losses`` of packed rows. Only a pack's distinct trigrams meet the model; they come back to their pack as one array of chances."""
    keep, fields = [f.name for f in packs.keep], packs.keep
    grams = packs.grams().select("pack", "place", "u", "v", "w")
    chance = with_chance(grams, model).select(F.col("u").alias("u_"), F.col("v").alias("v_"), F.col("w").alias("w_"), "p")
    found = grams.join(chance, (F.col("u") == F.col("u_")) & (F.col("v") == F.col("v_")) & (F.col("w") == F.col("w_"))).select(F.col("pack").alias("pack_"), "place", "p")
    names = [f"keep_{k}" for k in range(len(keep))]

    def spread(rows: pa.Table, chances: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return out_schema_empty
        loss = np.zeros(chances.num_rows)
        loss[chances.column("place").to_numpy()] = -np.log(chances.column("p").to_numpy())
        sizes = rows.column("sizes")[0].values.to_numpy().astype(np.int64)
        places = np.frombuffer(rows.column("places")[0].as_buffer(), dtype=np.int32)
        sums = np.bincount(np.repeat(np.arange(len(sizes)), sizes), loss[places], minlength=len(sizes))
        out = pa.Table.from_arrays([*(rows.column(c)[0].values for c in names), pa.array(sizes), pa.array(sums)], names=[*names, "n", "loss"])
        return out.filter(pc.greater(out.column("n"), 0))  # shorter ones have no row

    out_schema = T.StructType([*(T.StructField(n, f.dataType) for n, f in zip(names, fields, strict=True)), T.StructField("n", T.LongType()), T.StructField("loss", T.DoubleType())])
    out_schema_empty = _empty(out_schema)
    each = packs.table.select(F.col("pack").alias("own_"), *names, "sizes", "places").groupBy("own_").cogroup(found.groupBy("pack_")).applyInArrow(spread, out_schema)
    return each.groupBy(*(F.col(n).alias(k) for n, k in zip(names, keep, strict=True))).agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"))


def _empty(schema: T.StructType) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema).empty_table()


def next_chances(contexts: DataFrame, model: Model) -> DataFrame:
    """``u, v, w, p`` for every known token after each distinct context: what a step of sampling chooses from. Contexts are few, the vocabulary may be large."""
    every = contexts.select("u", "v").distinct().join(model.one.select("w"), how="cross")
    return with_chance(every, model)
