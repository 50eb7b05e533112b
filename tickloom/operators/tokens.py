"""Token ids, packing and segments, as arrays."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.codec import BINS, LETTERS
from tickloom.functions.ranking import with_order

#: Special ids and the place of the markers and prices in the closed vocabulary.
PAD, BOS, EOS, UNK = 0, 1, 2, 3
OPEN, CLOSE, FIRST_PRICE = 4, 5, 6
CLOSED_SIZE, PADDED_SIZE = 4102, 4160
IGNORED = -100
MIN_DOC, MIN_TAIL = 8, 64
PIECE = r"<chart>|</chart>|[OHLC]_\d+|[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def price_id(letter: Column, bin_: Column, base: int) -> Column:
    """Id of a price token: letters one after the other, ``BINS`` ids each."""
    return F.lit(base) + (F.instr(F.lit(LETTERS), letter) - 1) * BINS + bin_


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def _is_price(p: Column) -> Column:
    """A price token whose bin there is."""
    return p.rlike(r"^[OHLC]_\d{1,4}$") & F.coalesce(F.regexp_extract(p, r"_(\d{1,4})$", 1).try_cast("int") < BINS, F.lit(False))


def closed_ids(text: Column) -> Column:
    """Ids in the closed vocabulary; anything but markers and prices is unknown."""

    def one(p: Column) -> Column:
        price = price_id(F.substring(p, 1, 1), F.regexp_extract(p, r"_(\d{1,4})$", 1).try_cast("int"), FIRST_PRICE)
        return F.when(p == "<chart>", OPEN).when(p == "</chart>", CLOSE).when(_is_price(p), price).otherwise(UNK).cast("int")

    return F.transform(pieces(text), one)


def closed_text(ids: Column) -> Column:
    """Text of closed ids; specials give nothing."""

    def one(i: Column) -> Column:
        k = i - FIRST_PRICE
        price = F.concat(F.substring(F.lit(LETTERS), F.floor(k / BINS).cast("int") + 1, F.lit(1)), F.lit("_"), (k % BINS).cast("string"))
        return F.when(i == OPEN, "<chart>").when(i == CLOSE, "</chart>").when(i >= FIRST_PRICE, price).otherwise("")

    return F.array_join(F.filter(F.transform(ids, one), lambda x: x != ""), " ")


def encode(text: Column, words: Callable[[Column], Column], base: int) -> Column:
    """Ids with a pluggable text path: ``words`` maps a piece to its id below ``base``; markers and prices come from ``base`` on."""

    def one(p: Column) -> Column:
        price = price_id(F.substring(p, 1, 1), F.regexp_extract(p, r"_(\d{1,4})$", 1).try_cast("int"), base)
        return F.when(p == "<chart>", base + 4 * BINS).when(p == "</chart>", base + 4 * BINS + 1).when(_is_price(p), price).otherwise(words(p)).cast("int")

    return F.transform(pieces(text), one)


def price_segments(text: Column, strict: bool = False) -> Column:
    """Price tokens of a text; ``strict`` takes those inside chart blocks only."""
    found = F.regexp_extract_all(text, F.lit(r"[OHLC]_\d+"), F.lit(0))
    if strict:
        blocks = F.regexp_extract_all(text, F.lit(r"(?s)<chart>.*?</chart>"), F.lit(0))
        found = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r"[OHLC]_\d+"), F.lit(0))))
    return F.filter(found, _is_price)


def with_eos(ids: Column) -> Column:
    return F.concat(ids, F.array(F.lit(EOS)))


def packed(df: DataFrame, group: str, order: str, ids: str, block: int) -> DataFrame:
    """``group, block, ids``: each group's ids, an end mark after each document, in one row and cut.

    The remainder is dropped, unless the group has less than a block, which then is one short block. Groups are the
    callers', of bounded size, as a loader's batches are.
    """
    one = F.struct(F.col(order).alias("o"), with_eos(F.col(ids)).alias("ids"))
    g = df.groupBy(group).agg(F.flatten(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["ids"])).alias("all"))
    count = F.greatest(F.floor(F.size("all") / block), F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice("all", k * block + 1, F.lit(block)))
    return g.where(F.size("all") > 0).select(group, F.posexplode(cut).alias("block", "ids"))


def segments(ids: Column, length: int) -> Column:
    """Pieces of ``length + 1`` ids; a tail of over 64 gives the last such piece. Under 8 ids there are none."""
    n = F.size(ids)
    full = F.floor(n / (length + 1)).cast("int")
    body = F.when(full > 0, F.transform(F.sequence(F.lit(0), F.greatest(full - 1, F.lit(0))), lambda k: F.slice(ids, k * (length + 1) + 1, F.lit(length + 1)))).otherwise(F.array().cast("array<array<int>>"))
    tail = F.array(F.slice(ids, F.greatest(n - length, F.lit(1)), F.lit(length + 1)))
    return F.when(n < MIN_DOC, F.array().cast("array<array<int>>")).when(n - full * (length + 1) >= MIN_TAIL + 1, F.concat(body, tail)).otherwise(body)


def strided(ids: Column, length: int, stride: int) -> Column:
    """Windows of ``length + 1`` ids every ``stride``; a last one if at least 64 ids stay uncovered (a text without a window counts as covered so far)."""
    n = F.size(ids)
    count = F.when(n >= length + 1, F.floor((n - length - 1) / stride).cast("int") + 1).otherwise(0)
    body = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda k: F.slice(ids, k * stride + 1, F.lit(length + 1)))).otherwise(F.array().cast("array<array<int>>"))
    covered = F.greatest(count - 1, F.lit(0)) * stride + length + 1
    tail = F.array(F.slice(ids, F.greatest(n - length, F.lit(1)), F.lit(length + 1)))
    return F.when(n < MIN_DOC, F.array().cast("array<array<int>>")).when(n - covered >= MIN_TAIL, F.concat(body, tail)).otherwise(body)


def collated(df: DataFrame, batch: Sequence[str], ids: str) -> DataFrame:
    """Adds ``input_ids`` and ``labels``, shifted by one and padded to ``length``, the longest of the batch.

    A row without ids is padding only; ``length`` is -1 where the whole batch has none. Batches are of a few rows each.
    """
    own = F.coalesce(F.col(ids), F.array().cast("array<int>"))
    m = F.size(own) - 1
    d = df.withColumn("length", F.max(m).over(Window.partitionBy(*batch)))
    kept = F.greatest(m, F.lit(0))
    pad = lambda value: F.array_repeat(F.lit(value), F.greatest("length", F.lit(0)) - kept)
    return d.withColumns({"input_ids": F.concat(F.slice(own, F.lit(1), kept), pad(PAD)), "labels": F.concat(F.slice(own, F.lit(2), kept), pad(IGNORED))})


def fixed(ids: Column, length: int = 402, pad: int = PAD) -> Column:
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), length)), 1, length)


def chunked(df: DataFrame, text: str, ids: str, order: str, chunk: int, least: int = 200) -> DataFrame:
    """``df`` with ``chunk``: texts of ``least`` characters and two ids or more, by ``chunk`` rows in order."""
    d = df.where((F.length(F.trim(F.col(text))) >= least) & (F.size(ids) >= 2))
    return with_order(d, order, "r_").withColumn("chunk", F.floor((F.col("r_") - 1) / chunk)).drop("r_")


def check_vocabulary(size: int, specials: dict[str, int]) -> None:
    """Raises where special ids repeat or lie outside the vocabulary."""
    if len(set(specials.values())) < len(specials) or not all(0 <= v < size for v in specials.values()):
        raise ValueError(f"special ids {specials} do not fit a vocabulary of {size}")
