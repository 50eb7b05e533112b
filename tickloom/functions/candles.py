"""Column expressions of single candles and of pairs: measures, direction, pin bars, engulfing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def body(o: Column, c: Column) -> Column:
    return F.abs(c - o)


def span(h: Column, low: Column) -> Column:
    """Range of a candle, 1 for none."""
    return F.when(h == low, 1).otherwise(h - low)


def upper_wick(o: Column, h: Column, c: Column) -> Column:
    return h - F.greatest(o, c)


def lower_wick(o: Column, low: Column, c: Column) -> Column:
    return F.least(o, c) - low


def direction(o: Column, c: Column, threshold: int = 2) -> Column:
    return F.when(c - o > threshold, "BULL").when(o - c > threshold, "BEAR").otherwise("DOJI")


def pin_bar(o: Column, h: Column, low: Column, c: Column, wick: float = 0.6, small: float = 0.3) -> Column:
    """HAMMER, SHOOTING_STAR or null."""
    r, up, down = span(h, low), upper_wick(o, h, c), lower_wick(o, low, c)
    thin = body(o, c) <= small * r
    hammer = thin & (down >= wick * r) & (up < 0.5 * down)
    star = thin & (up >= wick * r) & (down < 0.5 * up)
    return F.when(hammer, "HAMMER").when(star, "SHOOTING_STAR")


def engulfing(prev_o: Column, prev_c: Column, o: Column, c: Column, threshold: int = 2) -> Column:
    """BULLISH_ENGULFING, BEARISH_ENGULFING or null; a first candle (null before it) has none."""
    before, now = direction(prev_o, prev_c, threshold), direction(o, c, threshold)
    bull = (before == "BEAR") & (now == "BULL") & (o <= prev_c) & (c >= prev_o)
    bear = (before == "BULL") & (now == "BEAR") & (o >= prev_c) & (c <= prev_o)
    return F.when(bull, "BULLISH_ENGULFING").when(bear, "BEARISH_ENGULFING")
