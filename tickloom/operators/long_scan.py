"""The two scans with state over series of any length, as blocks that agree on their states.

A block of a series is folded from a state: the swings of its lookback that serve no more, and the trend. All blocks are folded at
once from a guessed state, and then again where the block before has ended in another state than the one guessed, until all agree. A
state forgets soon: only broken swings within the lookback count, and the first break of structure sets the trend, so that
a few rounds do, whatever the number of blocks; the first blocks are right in any case, so it always ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.detect import _check, with_nearest_swings, with_swings
from tickloom.sources.sinks import dropped, materialised

BLOCK = 4096
_EVENT = "struct<i:bigint,type:string,direction:string,swing_idx:bigint,swing_level:bigint,depth:bigint,broken_type:string>"
_STATE = f"struct<broken:array<bigint>,trend:string,out:array<{_EVENT}>>"


def blocks_of(series: DataFrame, window: int, lookback: int, block: int) -> DataFrame:
    """``symbol, block, rows``: the candles of each block in order, with their nearest swings.

    Each block borrows as many candles of its neighbours as swings and lookback reach, so swings are those of the whole series.
    ``series`` has ``symbol, idx, h, l, c``; idx counts from 0 without gaps.
    """
    before, after = lookback + window, window
    if before > block or after > block:
        raise ValueError(f"blocks of {block} are shorter than what they borrow")
    b, at = F.floor(F.col("idx") / block), F.col("idx") % block
    parts = F.array_compact(F.array(b, F.when(at >= block - before, b + 1), F.when((at < after) & (b > 0), b - 1)))
    d = series.select("symbol", "idx", "h", "l", "c", F.explode(parts).alias("start_idx"))
    first = F.greatest(F.col("start_idx") * block - before, F.lit(0))
    d = d.withColumn("i", (F.col("idx") - first).cast("int"))
    near = with_nearest_swings(with_swings(d, window), lookback)
    own = near.where(F.floor(F.col("idx") / block) == F.col("start_idx"))
    swing = lambda s: F.when(F.col(s).isNotNull(), F.struct((F.col(f"{s}.idx") + first).cast("long").alias("idx"), F.col(f"{s}.level").cast("long").alias("level"))).alias(s)
    row = F.struct(F.col("idx").cast("long").alias("i"), *(F.col(c).cast("long").alias(c) for c in "hlc"), swing("near_high"), swing("near_low"))
    return own.groupBy("symbol", F.col("start_idx").alias("block")).agg(F.array_sort(F.collect_list(row)).alias("rows"))


def _folded(rows: Column, broken: Column, trend: Column, lookback: int, sweeps: bool) -> Column:
    """State after a block, with its events."""

    def step(acc: Column, x: Column) -> Column:
        high, low = x["near_high"], x["near_low"]
        usable = lambda s: s.isNotNull() & ~F.array_contains(acc["broken"], s["idx"])
        up = F.coalesce(usable(high) & ((x["h"] if sweeps else x["c"]) > high["level"]), F.lit(False))
        down = F.coalesce(usable(low) & ((x["l"] if sweeps else x["c"]) < low["level"]), F.lit(False))
        first = F.lit(True) if sweeps else acc["trend"] == "BULL"
        side = F.when(first & up, "HIGH").when(down, "LOW").when(up, "HIGH")
        swing = F.when(side == "HIGH", high).otherwise(low)
        way = F.when(side == "HIGH", "BULL").otherwise("BEAR")
        kind = F.concat(F.lit("SWEEP_"), side) if sweeps else F.when(way == acc["trend"], "BOS").otherwise("CHoCH")
        depth = F.when(side == "HIGH", x["h"] - high["level"]).otherwise(low["level"] - x["l"]) if sweeps else F.lit(None)
        none = F.lit(None).cast("string")
        event = F.struct(x["i"].alias("i"), kind.alias("type"), (none if sweeps else way).alias("direction"), swing["idx"].alias("swing_idx"), swing["level"].alias("swing_level"), depth.cast("long").alias("depth"), (none if sweeps else side).alias("broken_type"))
        seen = F.filter(F.concat(acc["broken"], F.array(swing["idx"], x["i"])), lambda k: k > x["i"] - lookback)  # older ones are out of reach
        new = F.struct(seen.alias("broken"), (acc["trend"] if sweeps else way).alias("trend"), F.concat(acc["out"], F.array(event.cast(_EVENT))).alias("out")).cast(_STATE)
        return F.when(side.isNull(), acc).otherwise(new)

    start = F.struct(broken.alias("broken"), trend.alias("trend"), F.array().cast(f"array<{_EVENT}>").alias("out")).cast(_STATE)
    last = F.element_at(rows, -1)["i"]
    return F.aggregate(rows, start, step, lambda a: F.struct(F.array_sort(F.filter(a["broken"], lambda k: k > last - lookback)).alias("broken"), a["trend"].alias("trend"), a["out"].alias("out")))


def _scan(series: DataFrame, trend: str, sweeps: bool, window: int, lookback: int, block: int) -> DataFrame:
    rows = materialised(blocks_of(series, window, lookback, block))
    none = F.array().cast("array<bigint>")
    fold = lambda: _folded(F.col("rows"), F.col("broken"), F.col("trend"), lookback, sweeps)
    done = materialised(rows.select("symbol", "block", none.alias("broken"), F.lit(trend).alias("trend"), _folded(F.col("rows"), none, F.lit(trend), lookback, sweeps).alias("end")))
    while True:
        ends = done.select(F.col("symbol").alias("s_"), (F.col("block") + 1).alias("b_"), F.col("end.broken").alias("is_"), F.col("end.trend").alias("was_"))
        both = done.join(ends, F.col("symbol").eqNullSafe(F.col("s_")) & (F.col("block") == F.col("b_")), "left")
        other = (F.col("b_").isNotNull()) & ((F.col("is_") != F.col("broken")) | (F.col("was_") != F.col("trend")))
        wrong = materialised(both.where(other).select("symbol", "block", F.col("is_").alias("broken"), F.col("was_").alias("trend")))
        if wrong.isEmpty():
            dropped(wrong)
            break
        keys = wrong.select(F.col("symbol").alias("s_"), F.col("block").alias("b_"), "broken", "trend")
        same = F.col("symbol").eqNullSafe(F.col("s_")) & (F.col("block") == F.col("b_"))
        again = rows.join(keys, same).select("symbol", "block", "broken", "trend", fold().alias("end"))
        new = materialised(done.join(keys.select("s_", "b_"), same, "left_anti").unionByName(again))
        dropped(done)
        dropped(wrong)
        done = new
    return done.select("symbol", F.explode("end.out").alias("e")).select("symbol", "e.*")


def sweeps_of_series(series: DataFrame, window: int = 2, lookback: int = 10, block: int = BLOCK) -> DataFrame:
    """``symbol, i, type, swing_idx, swing_level, depth`` of the sweeps of whole series, as ``detect.sweep_scan`` has them of a chart."""
    return _scan(series, "BULL", True, window, lookback, block).select("symbol", "i", "type", "swing_idx", "swing_level", "depth")


def shifts_of_series(series: DataFrame, trend: str, window: int = 2, lookback: int = 10, block: int = BLOCK) -> DataFrame:
    """``symbol, i, type, direction, swing_idx, swing_level, broken_type`` of the shifts of whole series, as ``detect.shift_scan`` has them of a chart."""
    _check(trend)
    return _scan(series, trend, False, window, lookback, block).select("symbol", "i", "type", "direction", "swing_idx", "swing_level", "broken_type")
