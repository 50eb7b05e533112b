"""Distributions of detector results over all charts; percentiles are exact, interpolated linearly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import detect as D


def percentiles(df: DataFrame, group: Sequence[str], value: str, at: Sequence[int]) -> DataFrame:
    """``n`` and ``p<k>`` columns of ``value`` for each group."""
    q = F.percentile(F.col(value), F.array(*(F.lit(k / 100) for k in at)))
    out = df.groupBy(*group).agg(F.count(value).alias("n"), q.alias("q_"))
    return out.select(*group, "n", *(F.col("q_")[i].alias(f"p{k}") for i, k in enumerate(at)))


def swing_measures(candles: DataFrame, windows: Sequence[int] = (1, 2, 3, 5)) -> DataFrame:
    """Every swing for each window size: ``win, kind, gap`` (candles since the last of its kind) and ``prominence`` over its neighbours."""
    w = Window.partitionBy(*D.CHART).orderBy("i")
    around = {"n": F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))}
    for size in windows:
        left, right = w.rowsBetween(-size, -1), w.rowsBetween(1, size)
        around |= {f"oh{size}": F.greatest(F.max("h").over(left), F.max("h").over(right)), f"ol{size}": F.least(F.min("l").over(left), F.min("l").over(right))}
    # all sizes in one pass: a candle is a row for each size and kind that it is a swing of
    found = []
    for size in windows:
        inside = (F.col("i") >= size) & (F.col("i") + size < F.col("n"))
        for kind, prominence in (("high", F.col("h") - F.col(f"oh{size}")), ("low", F.col(f"ol{size}") - F.col("l"))):
            found.append(F.when(inside & (prominence >= 0), F.struct(F.lit(size).alias("win"), F.lit(kind).alias("kind"), prominence.alias("prominence"))))
    s = candles.withColumns(around).select(*D.CHART, "i", F.explode(F.array_compact(F.array(*found))).alias("s")).select(*D.CHART, "s.win", "s.kind", "i", "s.prominence")
    return s.withColumn("gap", F.col("i") - F.lag("i").over(Window.partitionBy(*D.CHART, "win", "kind").orderBy("i")))


def swing_report(candles: DataFrame, windows: Sequence[int] = (1, 2, 3, 5), at: Sequence[int] = (10, 25, 50, 75, 90, 95, 99)) -> DataFrame:
    m = swing_measures(candles, windows)
    total = candles.agg(F.count("*").alias("total"))
    q = F.percentile("prominence", F.array(*(F.lit(k / 100) for k in at)))
    g = m.groupBy("win", "kind").agg(F.count("*").alias("n"), F.percentile("gap", F.lit(0.5)).alias("gap_p50"), q.alias("q"))
    return g.crossJoin(F.broadcast(total)).select("win", "kind", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"), "gap_p50", *(F.col("q")[i].alias(f"prominence_p{k}") for i, k in enumerate(at)))  # total is one row


def sweep_report(candles: DataFrame, lookbacks: Sequence[int] = (5, 10, 15, 20), at: Sequence[int] = (10, 25, 50, 75, 90, 95, 99)) -> DataFrame:
    """By lookback and type: number, share of all candles and of the lookback's sweeps, percentiles of depth."""
    swings = D.with_swings(candles, 2)
    found = None
    for lookback in lookbacks:
        one = D.sweep_scan(D.with_nearest_swings(swings, lookback)).withColumn("lookback", F.lit(lookback))
        found = one if found is None else found.unionByName(one)
    total = candles.agg(F.count("*").alias("total"))
    g = percentiles(found, ("lookback", "type"), "depth", at)
    share = F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("lookback"))
    return g.withColumn("share", share).crossJoin(F.broadcast(total)).withColumn("pct", F.col("n") * 100.0 / F.col("total")).drop("total")


def shift_breaks(candles: DataFrame, lookback: int = 10) -> DataFrame:
    """Shifts from both initial trends with ``distance``, how far the close lies beyond the level."""
    near = D.with_nearest_swings(D.with_swings(candles, 2), lookback)
    both = D.shift_scan(near, "BULL").withColumn("trend", F.lit("BULL")).unionByName(D.shift_scan(near, "BEAR").withColumn("trend", F.lit("BEAR")))
    closes = candles.select(*D.CHART, "i", "c")
    return both.join(closes, [*D.CHART, "i"]).withColumn("distance", F.abs(F.col("c") - F.col("swing_level")))


def shift_report(candles: DataFrame, at: Sequence[int] = (10, 25, 50, 75, 90, 95, 99)) -> DataFrame:
    total = candles.agg(F.count("*").alias("total"))
    g = percentiles(shift_breaks(candles), ("trend", "type"), "distance", at)
    return g.crossJoin(F.broadcast(total)).withColumn("pct", F.col("n") * 100.0 / F.col("total")).drop("total")


def run_lengths(shifts: DataFrame) -> DataFrame:
    """Lengths of runs of BOS: one for each CHoCH (0 if none came before it), and a last one if it has any."""
    keys = (*D.CHART, "trend")
    w = Window.partitionBy(*keys).orderBy("i")
    turn = (F.col("type") == "CHoCH").cast("int")
    # a CHoCH closes the run that it ends
    marked = shifts.withColumn("run", F.sum(turn).over(w) - turn)
    runs = marked.groupBy(*keys, "run").agg(F.count_if(F.col("type") == "BOS").alias("length"), F.max(turn).alias("closed"))
    return runs.where("closed = 1 or length > 0").select(*keys, "run", "length")
