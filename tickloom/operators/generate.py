"""Synthetic rows: price facts, candles, gaps and arithmetic over bins, and shifted charts.

Each generator is a range of numbers with hashed choices, so that any part of it can be made by any
task, and again. Sentences are our own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.codec import BINS, LETTERS, candle_text, chart_text, parse_candles, shifted
from tickloom.functions.hashing import pick

NAMES = {"O": "open", "H": "high", "L": "low", "C": "close"}
TOP = BINS - 1


def _between(low: Column, high: Column, *keys: Column | str) -> Column:
    """A hashed number from ``low`` to ``high``, both included."""
    return (low + pick(42, *keys) % (high - low + 1)).cast("int")


def _row(df: DataFrame, text: Column, kind: str, source: str = "trading", *keep: str) -> DataFrame:
    meta = F.to_json(F.struct(F.lit(kind).alias("type")))
    return df.select(*keep, text.alias("text"), F.lit(source).alias("source"), F.lit(0).cast("long").alias("token_length"), meta.alias("meta"))


def price_facts(spark: SparkSession, count: int = BINS) -> DataFrame:
    """Four rows for each number: what each letter's token says."""
    letters = F.explode(F.array(*map(F.lit, LETTERS))).alias("letter")
    d = spark.range(count).select(F.col("id").cast("int").alias("i"), letters)
    name = F.lit(None).cast("string")
    for k, v in NAMES.items():
        name = F.when(F.col("letter") == k, v).otherwise(name)
    first = F.format_string("%s_%d is a %s at bin %d.", "letter", "i", name, "i")
    second = F.format_string("A %s at bin %d is written %s_%d.", name, "i", "letter", "i")
    return _row(d, F.when(pick(42, "letter", "i") % 2 == 0, first).otherwise(second), "basic_chart", "trading", "i", "letter")


def _candle(d: DataFrame, o: Column, tag: str) -> DataFrame:
    """Adds a candle struct named ``tag`` round the open ``o``: high and low up to 20 bins away, within the scale."""
    keys = ("i", "k", F.lit(tag))
    high = F.least(o + _between(F.lit(0), F.lit(20), *keys, F.lit("h")), F.lit(TOP))
    low = F.greatest(o - _between(F.lit(0), F.lit(20), *keys, F.lit("l")), F.lit(0))
    d = d.withColumns({"o_": o.cast("int"), "h_": high.cast("int"), "l_": low.cast("int")})
    d = d.withColumn("c_", _between(F.col("l_"), F.col("h_"), *keys, F.lit("c")))
    return d.withColumn(tag, F.struct(F.col("o_").alias("o"), F.col("h_").alias("h"), F.col("l_").alias("l"), F.col("c_").alias("c"))).drop("o_", "h_", "l_", "c_")


def full_candles(spark: SparkSession, count: int = BINS, each: int = 50) -> DataFrame:
    """``each`` candles for each open, with the bounds of body and wicks."""
    d = spark.range(count * each).select(F.floor(F.col("id") / each).cast("int").alias("i"), (F.col("id") % each).cast("int").alias("k"))
    d = _candle(d, F.col("i"), "a")
    lo, hi = F.least("a.o", "a.c"), F.greatest("a.o", "a.c")
    text = F.format_string("%s has its body from %d to %d, its upper wick from %d to %d and its lower wick from %d to %d.", candle_text(F.col("a")), lo, hi, hi, F.col("a.h"), F.col("a.l"), lo)
    return _row(d.withColumns({"high": F.col("a.h"), "low": F.col("a.l"), "close": F.col("a.c")}), text, "full_candlestick", "trading", "i", "k", "high", "low", "close")


def gap_pairs(spark: SparkSession, count: int = BINS, each: int = 5) -> DataFrame:
    """Pairs of candles with a gap up and down; none where the second open leaves the scale."""
    d = spark.range(count * each).select(F.floor(F.col("id") / each).cast("int").alias("i"), (F.col("id") % each).cast("int").alias("j"), F.explode(F.array(F.lit("GAP_UP"), F.lit("GAP_DOWN"))).alias("way"))
    d = d.withColumn("k", F.concat_ws("/", "j", "way"))
    d = _candle(d, F.col("i"), "a")
    gap = _between(F.lit(1), F.lit(10), "i", "k", F.lit("gap"))
    d = d.withColumn("open2", (F.col("a.c") + F.when(F.col("way") == "GAP_UP", gap).otherwise(-gap)).cast("int")).where(F.col("open2").between(0, TOP))
    d = _candle(d, F.col("open2"), "b").withColumns({"gap_low": F.least("a.c", "open2"), "gap_high": F.greatest("a.c", "open2")})
    told = F.when(F.col("way") == "GAP_UP", "rises").otherwise("falls")
    text = F.format_string("%s The open %s past the last close and leaves bins %d to %d.", chart_text(F.array("a", "b")), told, "gap_low", "gap_high")
    return _row(d, text, "gap", "trading", "i", "j", "way", "gap_low", "gap_high")


def arithmetic(spark: SparkSession, count: int = BINS) -> DataFrame:
    """A difference and a distance for each number."""
    d = spark.range(count).select(F.col("id").cast("int").alias("x"), F.explode(F.array(F.lit("sub"), F.lit("dist"))).alias("op"))
    b = _between(F.lit(0), F.lit(20), "x", "op")
    d = d.withColumn("b_", b).withColumn("c_", F.abs(F.col("x") - F.col("b_")))
    d = d.withColumns({"a": F.greatest("x", "c_"), "b": F.least("x", "c_")}).withColumn("res", F.col("a") - F.col("b"))
    text = F.when(F.col("op") == "sub", F.format_string("%d minus %d is %d.", "a", "b", "res")).otherwise(F.format_string("From bin %d to bin %d it is %d bins.", "b", "a", "res"))
    return _row(d, text, "basic_math", "math", "x", "op", "a", "b", "res")


def shifted_charts(charts: DataFrame, most: int = 10) -> DataFrame:
    """Each chart and up to ``most`` copies moved by different bins that keep it on the scale: ``symbol, start_idx, by, text, meta``."""
    k = charts.withColumn("k_", parse_candles(F.col("text")))
    low = F.array_min(F.flatten(F.transform("k_", lambda c: F.array(c["o"], c["h"], c["l"], c["c"]))))
    high = F.array_max(F.flatten(F.transform("k_", lambda c: F.array(c["o"], c["h"], c["l"], c["c"]))))
    k = k.withColumns({"lo_": low, "hi_": high})
    moves = F.filter(F.sequence(-F.col("lo_"), F.lit(TOP) - F.col("hi_")), lambda x: x != 0)
    ranked = F.array_sort(F.transform(moves, lambda x: F.struct(pick(42, F.col("symbol"), F.col("start_idx"), x).alias("h"), x.alias("by"))))
    chosen = F.concat(F.array(F.lit(0)), F.transform(F.slice(ranked, 1, most), lambda x: x["by"]))
    meta = F.to_json(F.struct(F.lit("raw_chart").alias("type"), "anchor_open", "anchor_atr"))
    out = k.withColumn("by", F.explode(chosen))
    return out.select("symbol", "start_idx", "by", chart_text(shifted(F.col("k_"), F.col("by"))).alias("text"), meta.alias("meta"))
