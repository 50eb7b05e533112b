"""Column expressions of the chart codec: prices to bins and back, candles to text and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BINS = 1024
LETTERS = "OHLC"
CANDLE = r"O_(\d+)\s+H_(\d+)\s+L_(\d+)\s+C_(\d+)"
CANDLES = "array<struct<o:int,h:int,l:int,c:int>>"


def true_range(high: Column, low: Column, last_close: Column) -> Column:
    """Largest of the three ranges; null on a first row (``greatest`` alone would skip the nulls)."""
    return F.when(last_close.isNotNull(), F.greatest(high - low, F.abs(high - last_close), F.abs(low - last_close)))


def to_bin(price: Column, anchor: Column, atr: Column, scale: float | Column, bins: int = BINS) -> Column:
    """Bin of a price: its distance from the anchor in ``scale`` ranges, clipped to one, halves to even. Null where the range is not positive."""
    norm = F.greatest(F.least((price - anchor) / (scale * atr), F.lit(1.0)), F.lit(-1.0))
    return F.when(atr > 0, F.bround((norm + 1) / 2 * (bins - 1)).cast("int"))


def to_price(bin_: Column, anchor: Column, atr: Column, scale: float | Column, bins: int = BINS) -> Column:
    return (bin_ / F.lit(float(bins - 1)) * 2 - 1) * scale * atr + anchor


def candle_text(c: Column, pixel: bool = False) -> Column:
    """Four tokens of a candle struct; ``pixel`` gives the bracketed form."""
    shape = "<px_{0}_%d>" if pixel else "{0}_%d"
    return F.format_string(" ".join(shape.format(x) for x in LETTERS), *(c[x.lower()] for x in LETTERS))


def chart_text(candles: Column, pixel: bool = False) -> Column:
    return F.concat(F.lit("<chart> "), F.array_join(F.transform(candles, lambda c: candle_text(c, pixel)), " "), F.lit(" </chart>"))


def parse_candles(text: Column) -> Column:
    """Candles of a chart's text, in order; malformed ones are skipped."""
    found = F.regexp_extract_all(text, F.lit(CANDLE), F.lit(0))
    return F.transform(found, lambda m: F.struct(*(F.regexp_extract(m, CANDLE, k + 1).cast("int").alias(x.lower()) for k, x in enumerate(LETTERS))))


def letter_values(text: Column, letter: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(letter + r"_(\d+)"), F.lit(1)), lambda x: x.cast("int"))


def decode_window(text: Column, anchor: Column, atr: Column, scale: float, bins: int = BINS) -> Column:
    """Prices of a chart's text; it is an error if the letters do not occur equally often."""
    values = [letter_values(text, x) for x in LETTERS]
    same = (F.size(values[0]) == F.size(values[1])) & (F.size(values[0]) == F.size(values[2])) & (F.size(values[0]) == F.size(values[3]))
    zipped = F.arrays_zip(*(v.alias(x.lower()) for v, x in zip(values, LETTERS, strict=True)))
    prices = F.transform(zipped, lambda c: F.struct(*(to_price(c[x.lower()], anchor, atr, scale, bins).alias(x.lower()) for x in LETTERS)))
    return F.when(same, prices).otherwise(F.raise_error(F.lit("unequal numbers of O, H, L and C tokens")).cast("array<struct<o:double,h:double,l:double,c:double>>"))


def slice_candles(candles: Column, start: Column | int, end: Column | int) -> Column:
    """Candles from ``start`` up to ``end`` (exclusive)."""
    lo = F.greatest(F.lit(start) if isinstance(start, int) else start, F.lit(0))
    hi = F.lit(end) if isinstance(end, int) else end
    return F.slice(candles, lo + 1, F.greatest(hi - lo, F.lit(0)))


def centred(candles: Column, at: Column, before: int, after: int) -> Column:
    """Candles round ``at``; empty if either side is short."""
    whole = (at >= before) & (at + after < F.size(candles))
    return F.when(whole, F.slice(candles, at - before + 1, F.lit(before + after + 1))).otherwise(F.array().cast(CANDLES))


def shifted(candles: Column, by: Column) -> Column:
    return F.transform(candles, lambda c: F.struct(*((c[x.lower()] + by).alias(x.lower()) for x in LETTERS)))


def pixel_tokens(text: Column) -> Column:
    """``O_512`` tokens to ``<px_O_512>`` ones."""
    return F.regexp_replace(text, r"(?<![\w<])([OHLC]_\d+)(?!\w)", "<px_$1>")
