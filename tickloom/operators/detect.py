"""Pattern detectors over charts in long form: ``symbol, start_idx, i, o, h, l, c``.

What looks at neighbours only is a window function. The two scans that carry state from candle to
candle fold over a chart's candles, which are as few as the window is long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHART = ("symbol", "start_idx")
EVENT = ("kind", "seq", "type", "direction", "candle_idx", "swing_idx", "swing_level", "depth", "gap_low", "gap_high", "gap_size", "fill_pct", "broken_type")


def _w() -> Window:
    return Window.partitionBy(*CHART).orderBy("i")


def with_swings(candles: DataFrame, window: int = 2) -> DataFrame:
    """Adds ``n`` (candles of the chart), ``swing_high`` and ``swing_low``: extremes of a centred window with both sides whole; ties all count."""
    around = _w().rowsBetween(-window, window)
    n = F.count("*").over(Window.partitionBy(*CHART)).cast("int")
    out = candles.withColumns({"n": n, "top_": F.max("h").over(around), "low_": F.min("l").over(around)})
    inside = (F.col("i") >= window) & (F.col("i") + window < F.col("n"))
    return out.withColumns({"swing_high": inside & (F.col("h") == F.col("top_")), "swing_low": inside & (F.col("l") == F.col("low_"))}).drop("top_", "low_")


def with_nearest_swings(swings: DataFrame, lookback: int = 10) -> DataFrame:
    """Adds ``near_high`` and ``near_low``: place and level of the nearest swing in the ``lookback`` candles before, or null."""
    past = _w().rowsBetween(-lookback, -1)
    find = lambda flag, level: F.last(F.when(F.col(flag), F.struct(F.col("i").alias("idx"), F.col(level).alias("level"))), ignorenulls=True).over(past)
    return swings.withColumns({"near_high": find("swing_high", "h"), "near_low": find("swing_low", "l")})


def gaps(candles: DataFrame, *more: str) -> DataFrame:
    """Three-candle gaps: ``i, type, gap_low, gap_high, gap_size`` and the columns ``more``; the last two candles' lows and highs do not meet those two before."""
    out = candles.withColumns({"h2": F.lag("h", 2).over(_w()), "l2": F.lag("l", 2).over(_w())})
    bull, bear = F.col("l") > F.col("h2"), F.col("h") < F.col("l2")
    out = out.withColumn("type", F.when(bull, "BULL").when(bear, "BEAR")).where("type is not null")
    low, high = F.when(F.col("type") == "BULL", F.col("h2")).otherwise(F.col("h")), F.when(F.col("type") == "BULL", F.col("l")).otherwise(F.col("l2"))
    return out.select(*CHART, "i", "type", low.alias("gap_low"), high.alias("gap_high"), (high - low).alias("gap_size"), *more)


def graded_gaps(candles: DataFrame, upto: int | None = None) -> DataFrame:
    """Gaps with ``fill_pct``: how much of the gap the candle ``upto`` (default: the last) covers; 0 up to the gap itself."""
    w = Window.partitionBy(*CHART)
    if upto is None:
        ends = {"upto": F.max("i").over(w), "uh": F.max_by("h", "i").over(w), "ul": F.max_by("l", "i").over(w)}
    else:
        ends = {"upto": F.lit(upto), "uh": F.max(F.when(F.col("i") == upto, F.col("h"))).over(w), "ul": F.max(F.when(F.col("i") == upto, F.col("l"))).over(w)}
    found = gaps(candles.withColumns(ends), *ends)
    cover = F.greatest(F.least("uh", "gap_high") - F.greatest("ul", "gap_low"), F.lit(0))
    fill = F.when(F.col("upto") <= F.col("i"), 0.0).otherwise(F.bround(cover * 100.0 / F.col("gap_size"), 1))
    return found.select(*CHART, "i", "type", "gap_low", "gap_high", "gap_size", fill.alias("fill_pct"))


def sweeps_at(near: DataFrame) -> DataFrame:
    """Sweep of each candle by itself (nothing is broken before): ``type, swing_idx, swing_level, depth``; highs first."""
    high, low = F.col("h") > F.col("near_high.level"), F.col("l") < F.col("near_low.level")
    kind = F.when(high, "SWEEP_HIGH").when(low, "SWEEP_LOW")
    swing = F.when(high, F.col("near_high")).otherwise(F.col("near_low"))
    depth = F.when(high, F.col("h") - F.col("near_high.level")).otherwise(F.col("near_low.level") - F.col("l"))
    return near.withColumn("type", kind).where("type is not null").select(*CHART, "i", "type", swing["idx"].alias("swing_idx"), swing["level"].alias("swing_level"), depth.alias("depth"))


def _check(trend: str) -> None:
    if trend not in ("BULL", "BEAR"):
        raise ValueError(f"trend must be BULL or BEAR, not {trend!r}")


def _shift(x: Column, trend: Column, broken: Column | None) -> Column:
    """Shift of a candle given the trend: struct of type, direction, idx, swing, level, broken; or null."""
    usable = lambda s: s.isNotNull() if broken is None else s.isNotNull() & ~F.array_contains(broken, s["idx"])
    up = F.coalesce(usable(x["near_high"]) & (x["c"] > x["near_high"]["level"]), F.lit(False))
    down = F.coalesce(usable(x["near_low"]) & (x["c"] < x["near_low"]["level"]), F.lit(False))
    bull = trend == "BULL"
    made = lambda kind, way, s, side: F.struct(F.lit(kind).alias("type"), F.lit(way).alias("direction"), x["i"].alias("i"), s["idx"].alias("swing_idx"), s["level"].alias("swing_level"), F.lit(side).alias("broken_type"))
    high, low = x["near_high"], x["near_low"]
    return F.when(bull & up, made("BOS", "BULL", high, "HIGH")).when(bull & down, made("CHoCH", "BEAR", low, "LOW")).when(~bull & down, made("BOS", "BEAR", low, "LOW")).when(~bull & up, made("CHoCH", "BULL", high, "HIGH"))


def shifts_at(near: DataFrame, trend: str) -> DataFrame:
    """Structure shift of each candle by itself, by close, for one trend: a break with it (BOS) comes before one against it (CHoCH)."""
    _check(trend)
    x = {c: F.col(c) for c in ("near_high", "near_low", "c", "i")}
    return near.withColumn("s_", _shift(x, F.lit(trend), None)).where("s_ is not null").select(*CHART, "s_.*")


_SWEEP = "struct<type:string,i:int,swing_idx:int,swing_level:int,depth:int>"
_SHIFT = "struct<type:string,direction:string,i:int,swing_idx:int,swing_level:int,broken_type:string>"


def _per_chart(near: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return near.groupBy(*CHART).agg(F.array_sort(F.collect_list(F.struct("i", *columns))).alias("rows"))


def sweep_scan(near: DataFrame) -> DataFrame:
    """Sweeps of a whole chart in order: a swept swing, and the candle that swept, serve no more.

    The nearest swing hides older ones even when it no longer serves.
    """
    rows = _per_chart(near, ("h", "l", "near_high", "near_low"))
    start = F.struct(F.array().cast("array<int>").alias("broken"), F.array().cast(f"array<{_SWEEP}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        usable = lambda s: s.isNotNull() & ~F.array_contains(acc["broken"], s["idx"])
        high, low = x["near_high"], x["near_low"]
        up = F.coalesce(usable(high) & (x["h"] > high["level"]), F.lit(False))
        down = F.coalesce(usable(low) & (x["l"] < low["level"]), F.lit(False))
        made = lambda kind, s, depth: F.struct(F.lit(kind).alias("type"), x["i"].alias("i"), s["idx"].alias("swing_idx"), s["level"].alias("swing_level"), depth.alias("depth")).cast(_SWEEP)
        add = lambda s, event: F.struct(F.concat(acc["broken"], F.array(s["idx"], x["i"])).alias("broken"), F.concat(acc["out"], F.array(event)).alias("out"))
        return F.when(up, add(high, made("SWEEP_HIGH", high, x["h"] - high["level"]))).when(down, add(low, made("SWEEP_LOW", low, low["level"] - x["l"]))).otherwise(acc)

    found = rows.select(*CHART, F.explode(F.aggregate("rows", start, step, lambda a: a["out"])).alias("e"))
    return found.select(*CHART, "e.*")


def shift_scan(near: DataFrame, trend: str) -> DataFrame:
    """Shifts of a whole chart in order; a CHoCH turns the trend, and broken swings serve no more."""
    _check(trend)
    rows = _per_chart(near, ("c", "near_high", "near_low"))
    start = F.struct(F.array().cast("array<int>").alias("broken"), F.lit(trend).alias("trend"), F.array().cast(f"array<{_SHIFT}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        def go(e: Column) -> Column:
            turned = F.when(e["type"] == "CHoCH", e["direction"]).otherwise(acc["trend"])
            new = F.struct(F.concat(acc["broken"], F.array(e["swing_idx"], e["i"])).alias("broken"), turned.alias("trend"), F.concat(acc["out"], F.array(e)).alias("out"))
            return F.when(e.isNull(), acc).otherwise(new)

        one = _shift(x, acc["trend"], acc["broken"]).cast(_SHIFT)
        return F.element_at(F.transform(F.array(one), go), 1)

    found = rows.select(*CHART, F.explode(F.aggregate("rows", start, step, lambda a: a["out"])).alias("e"))
    return found.select(*CHART, "e.*")


def rejection_sweeps(candles: DataFrame, window: int = 2, lookback: int = 20) -> DataFrame:
    """Sweeps that the close rejects, of the nearest swing that no close has passed since.

    Unlike the scan, a broken swing does not hide older ones. A swing is dealt to the ``lookback`` candles after it.
    """
    s = with_swings(candles, window)
    swings = s.where("swing_high or swing_low").select(*CHART, F.col("i").alias("j"), "h", "l", "swing_high", "swing_low")
    # each swing meets the candles after it, within the lookback, by equal keys
    after = F.explode(F.sequence(F.col("j") + 1, F.col("j") + lookback))
    seen = swings.withColumn("i", after).join(s.select(*CHART, "i", F.col("h").alias("hi"), F.col("l").alias("li"), F.col("c").alias("ci")), [*CHART, "i"])
    # a close beyond the level, before this candle
    past = Window.partitionBy(*CHART, "j").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    first = lambda hit: F.min(F.when(hit, F.col("i"))).over(past)
    pairs = seen.withColumns({"up_at": first(F.col("swing_high") & (F.col("ci") > F.col("h"))), "down_at": first(F.col("swing_low") & (F.col("ci") < F.col("l")))})
    pairs = pairs.where((F.col("j") <= F.col("i") - window - 1) & (F.col("j") >= window))
    whole = lambda at: F.col(at).isNull() | (F.col(at) >= F.col("i"))
    near = lambda flag, at, level: F.max(F.when(F.col(flag) & whole(at), F.struct("j", F.col(level).alias("level"))))
    found = pairs.groupBy(*CHART, "i", "hi", "li", "ci").agg(near("swing_high", "up_at", "h").alias("sh"), near("swing_low", "down_at", "l").alias("sl"))
    bear = (F.col("hi") > F.col("sh.level")) & (F.col("ci") < F.col("sh.level"))
    bull = (F.col("li") < F.col("sl.level")) & (F.col("ci") > F.col("sl.level"))
    kind = F.when(bear, "BEARISH_SWEEP").when(bull, "BULLISH_SWEEP")
    swing = F.when(bear, F.col("sh")).otherwise(F.col("sl"))
    depth = F.when(bear, F.col("hi") - F.col("sh.level")).otherwise(F.col("sl.level") - F.col("li"))
    return found.withColumn("type", kind).where("type is not null").select(*CHART, "i", "type", swing["j"].alias("swing_idx"), swing["level"].alias("swing_level"), depth.alias("depth"))


def _shaped(df: DataFrame, kind: str, rank: int) -> DataFrame:
    have = set(df.columns)
    kinds = {"type": "string", "direction": "string", "swing_idx": "int", "swing_level": "int", "depth": "int", "gap_low": "int", "gap_high": "int", "gap_size": "int", "fill_pct": "double", "broken_type": "string"}
    cols = [F.col(c).cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in kinds.items()]
    return df.select(*CHART, F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), F.col("i").alias("candle_idx"), *cols)


def trendless(candles: DataFrame, window: int = 2, lookback: int = 10) -> tuple[DataFrame, DataFrame]:
    """What events of both trends share: candles with their nearest swings, and the sweeps and gaps, which no trend changes.

    Callers that want events of more than one trend write both (``materialised``) and give them to ``events``.
    """
    near = with_nearest_swings(with_swings(candles, window), lookback)
    return near, _shaped(sweep_scan(near), "sweep", 0).unionByName(_shaped(graded_gaps(candles), "gap", 1))


def events(candles: DataFrame, trend: str, window: int = 2, lookback: int = 10, shared: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """All events of each chart (the fact): sweeps, then gaps, then shifts, numbered by ``seq`` from 0. ``shared`` is what ``trendless`` gives."""
    _check(trend)
    near, fixed = shared or trendless(candles, window, lookback)
    out = fixed.unionByName(_shaped(shift_scan(near, trend), "shift", 2))
    seq = F.row_number().over(Window.partitionBy(*CHART).orderBy("rank", "candle_idx")).cast("int") - 1
    return out.withColumn("seq", seq).select(*CHART, *EVENT)


def relations(found: DataFrame) -> DataFrame:
    """Every pair of a chart's events: ``event_a_idx, event_b_idx, order, same_direction, overlap``.

    Order is by candle; on one candle a sweep comes before a shift, others are SAME_CANDLE. Direction
    is the explicit one or that of the type. Overlap is strict, so that a point overlaps nothing.
    Pairs stay within a chart, whose events are bounded by its candles.
    """
    way = F.coalesce("direction", F.when(F.col("type").contains("HIGH") | (F.col("type") == "BEAR"), "BEAR").when(F.col("type").contains("LOW") | (F.col("type") == "BULL"), "BULL"))
    low, high = F.coalesce("gap_low", "swing_level"), F.coalesce("gap_high", "swing_level")
    e = found.select(*CHART, "seq", "kind", "candle_idx", way.alias("way"), low.alias("lo"), high.alias("hi"))
    a, b = (e.select(*CHART, *(F.col(c).alias(f"{c}_{x}") for c in ("seq", "kind", "candle_idx", "way", "lo", "hi"))) for x in "ab")
    pairs = a.join(b, list(CHART)).where("seq_a < seq_b")
    both = F.concat_ws(" ", "kind_a", "kind_b")
    order = F.when(F.col("candle_idx_a") < F.col("candle_idx_b"), "A_BEFORE_B").when(F.col("candle_idx_a") > F.col("candle_idx_b"), "B_BEFORE_A").when(both == "sweep shift", "A_BEFORE_B").when(both == "shift sweep", "B_BEFORE_A").otherwise("SAME_CANDLE")
    same = F.when(F.col("way_a").isNotNull() & F.col("way_b").isNotNull(), F.col("way_a") == F.col("way_b"))
    over = F.least("hi_a", "hi_b") > F.greatest("lo_a", "lo_b")
    return pairs.select(*CHART, F.col("seq_a").alias("event_a_idx"), F.col("seq_b").alias("event_b_idx"), order.alias("order"), same.alias("same_direction"), over.alias("overlap"))
