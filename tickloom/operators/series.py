"""Operators on bar series: ``symbol, idx, open, high, low, close``, ordered by the position idx.

Series have no other order than idx, and every operator partitions by symbol *and* by ranges of
idx where it can, so that a long series is not one task.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.codec import chart_text, to_bin, true_range
from tickloom.functions.quantile import percentiles
from tickloom.functions.ranking import with_position

PRICES = ("open", "high", "low", "close")
#: Scale factors by symbol and timeframe are a table that callers join; this is the default.
DEFAULT_SCALE = 24.0
EWM_BLOCK = 256


def bars_from_events(events: DataFrame, per_bar: int = 3) -> DataFrame:
    """Random-walk bars of ``per_bar`` events for each event type: an input adapter for event tables.

    Prices are integers (hundredths) summed exactly; incomplete last bars are left out. Events are numbered and summed within days,
    and the days' own totals, a row a type and day, give each its start.
    """
    d = events.select(F.col("event_type").alias("symbol"), "ts", "event_id", F.to_date("ts").alias("day"), (F.round(F.col("value") * 100).cast("long") - 5000).alias("step"))
    inner = Window.partitionBy("symbol", "day").orderBy("ts", "event_id")
    totals = d.groupBy("symbol", "day").agg(F.count("*").alias("n"), F.sum("step").alias("s"))
    before = Window.partitionBy("symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("symbol").alias("symbol_"), F.col("day").alias("day_"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s_"))
    d = d.select("symbol", "day", F.row_number().over(inner).alias("k"), F.sum("step").over(inner.rowsBetween(Window.unboundedPreceding, 0)).alias("sum"))
    d = d.join(starts, F.col("symbol").eqNullSafe(F.col("symbol_")) & F.col("day").eqNullSafe(F.col("day_")))
    walk = d.select("symbol", (F.col("k") - 1 + F.col("n_")).alias("rn"), (F.lit(100000) + F.coalesce("sum", F.lit(0)) + F.col("s_")).alias("p"))
    bars = walk.groupBy("symbol", F.floor(F.col("rn") / per_bar).cast("long").alias("idx")).agg(F.count("*").alias("n"), F.min_by("p", "rn").alias("o"), F.max("p").alias("h"), F.min("p").alias("l"), F.max_by("p", "rn").alias("c"))
    return bars.where(F.col("n") == per_bar).select("symbol", "idx", *((F.col(x[0]) / 100.0).alias(x) for x in PRICES))


def _with_previous(df: DataFrame, value: str, out: str, key: str, order: str, size: int) -> DataFrame:
    """Adds the value of the row before. Rows meet within blocks of ``size``; a block's first row gets the last of the block before by a join on blocks."""
    w = Window.partitionBy(key, "block_").orderBy(order)
    d = df.withColumn("block_", F.floor(F.col(order) / size)).withColumn("within_", F.lag(value).over(w))
    first = F.col(order) == F.min(order).over(Window.partitionBy(key, "block_"))
    ends = d.groupBy(F.col(key).alias("key_"), (F.col("block_") + 1).alias("next_")).agg(F.max_by(value, order).alias("end_"))
    d = d.withColumn("first_", first).join(ends, (F.col(key) == F.col("key_")) & (F.col("block_") == F.col("next_")), "left")
    return d.withColumn(out, F.when(F.col("first_"), F.col("end_")).otherwise(F.col("within_"))).drop("block_", "within_", "first_", "key_", "next_", "end_")


def with_true_range(bars: DataFrame) -> DataFrame:
    d = _with_previous(bars, "close", "last_", "symbol", "idx", EWM_BLOCK)
    return d.withColumn("tr", true_range(F.col("high"), F.col("low"), F.col("last_"))).drop("last_")


def with_ewm(df: DataFrame, value: str, out: str, period: int, key: str = "symbol", order: str = "idx") -> DataFrame:
    """Exponential mean with weight 2/(period+1) that begins at the first value (no bias correction).

    The recurrence is a weighted sum with powers of the decay. Within blocks of ``EWM_BLOCK`` rows
    it is a window sum; a block's start adds what earlier blocks left, of which only as many count as
    the decay leaves above double precision. A series so is as many tasks as it has blocks. Rows
    with a null value get null and must come before all others; ``order`` counts rows without gaps.
    """
    alpha = 2.0 / (period + 1)
    if alpha >= 1:
        return df.withColumn(out, F.col(value))
    keep = 1.0 - alpha
    size = min(EWM_BLOCK, max(1, int(250 / -math.log10(keep))))  # powers stay within a double
    block, at = F.floor(F.col(order) / size), F.col(order) % size
    rows = Window.partitionBy(key, "block_").orderBy(order)
    df = df.withColumns({"block_": block, "at_": at})
    # the first value of all counts whole; one at a block's beginning is made up for once it is known what is before the block
    weight = F.when(F.lag(order).over(rows).isNotNull() & F.lag(value).over(rows).isNull(), 1.0).otherwise(alpha)
    df = df.withColumn("term_", F.col(value) * weight * F.pow(F.lit(keep), -F.col("at_").cast("double")))
    df = df.withColumn("local_", F.sum("term_").over(rows.rowsBetween(Window.unboundedPreceding, 0)) * F.pow(F.lit(keep), F.col("at_").cast("double")))
    ends = df.groupBy(key, "block_").agg(F.max_by("local_", order).alias("end_"), F.min_by(value, order).alias("first_"), F.min("at_").alias("from_"), F.max("at_").alias("to_"))
    decay = keep**size
    reach = max(1, math.ceil(math.log(1e-18) / math.log(decay))) if decay > 0 else 1
    before = Window.partitionBy(key).orderBy("block_")
    ends = ends.withColumn("rest_", F.when(F.lag("end_").over(before).isNull(), F.coalesce(F.col("first_") * keep, F.lit(0.0))).otherwise(0.0))
    ends = ends.withColumn("end_", F.col("end_") + F.col("rest_") * F.pow(F.lit(keep), (F.col("to_") - F.col("from_")).cast("double")))
    carried = F.lit(0.0)
    for k in range(1, reach + 1):
        carried = carried + F.coalesce(F.lag("end_", k).over(before), F.lit(0.0)) * decay ** (k - 1)
    ends = ends.select(F.col(key).alias("key_"), F.col("block_").alias("b_"), carried.alias("carried_"), "rest_", "from_")
    joined = df.join(ends, (F.col(key) == F.col("key_")) & (F.col("block_") == F.col("b_")))
    power = lambda x: F.pow(F.lit(keep), x.cast("double"))
    mean = F.col("local_") + F.col("rest_") * power(F.col("at_") - F.col("from_")) + F.col("carried_") * power(F.col("at_") + 1)
    return joined.withColumn(out, F.when(F.col(value).isNotNull(), mean)).drop("block_", "at_", "term_", "local_", "key_", "b_", "carried_", "rest_", "from_")


def with_atr(bars: DataFrame, period: int = 100) -> DataFrame:
    return with_ewm(with_true_range(bars), "tr", "atr", period)


def windows(bars: DataFrame, window: int = 200, stride: int = 10, ahead: int = 0) -> DataFrame:
    """Rows of every window with their place ``i`` in it and the window's anchor (its first open and range).

    Windows begin at multiples of ``stride`` and are whole, with ``ahead`` more rows behind them;
    those whose anchor range is null or not positive are left out. A row is copied to the windows
    that hold it, and meets its anchor by an equal key; nothing is joined by range.
    """
    length = window + ahead
    starts = F.sequence(F.floor((F.greatest(F.col("idx") - length + 1, F.lit(0)) + stride - 1) / stride) * stride, F.floor(F.col("idx") / stride) * stride, F.lit(stride).cast("long"))
    some = F.floor(F.col("idx") / stride) * stride > F.col("idx") - length
    dealt = bars.where(some).withColumn("start_idx", F.explode(starts)).withColumn("i", (F.col("idx") - F.col("start_idx")).cast("int"))
    w = Window.partitionBy("symbol", "start_idx")
    anchor = lambda c: F.max(F.when(F.col("i") == 0, F.col(c))).over(w)
    dealt = dealt.withColumns({"anchor_open": anchor("open"), "anchor_atr": anchor("atr"), "n_": F.count("*").over(w)})
    return dealt.where((F.col("n_") == length) & (F.col("anchor_atr") > 0)).drop("n_")


def candles(wins: DataFrame, scale: float | Column = DEFAULT_SCALE) -> DataFrame:
    """``symbol, start_idx, i, o, h, l, c``: the windows' prices as bins."""
    bins = (to_bin(F.col(p), F.col("anchor_open"), F.col("anchor_atr"), scale).alias(p[0]) for p in PRICES)
    return wins.select("symbol", "start_idx", "i", *bins)


def chart_texts(candles: DataFrame) -> DataFrame:
    """``symbol, start_idx, text`` of charts whose candles are there already."""
    listed = F.array_sort(F.collect_list(F.struct("i", "o", "h", "l", "c")))
    return candles.groupBy("symbol", "start_idx").agg(chart_text(listed).alias("text"))


def chart_dataset(bars: DataFrame, window: int = 200, stride: int = 10, period: int = 100, scale: float = DEFAULT_SCALE) -> DataFrame:
    """``symbol, start_idx, end_idx, anchor_open, anchor_atr, text`` for every window; ``atr`` is used where it is already there."""
    bars = bars if "atr" in bars.columns else with_atr(bars, period)
    wins = windows(bars, window, stride)
    one = F.struct("i", *(to_bin(F.col(p), F.col("anchor_open"), F.col("anchor_atr"), scale).alias(p[0]) for p in PRICES))
    grouped = wins.groupBy("symbol", "start_idx", "anchor_open", "anchor_atr").agg(F.array_sort(F.collect_list(one)).alias("candles"))
    return grouped.select("symbol", "start_idx", (F.col("start_idx") + window - 1).alias("end_idx"), "anchor_open", "anchor_atr", chart_text(F.col("candles")).alias("text"))


def forward_moves(bars: DataFrame, window: int, forward: int, stride: int, scale: float) -> DataFrame:
    """Bins between the highest high and the lowest low of the ``forward`` rows from each start; starts begin at ``window``, and one row more must follow.

    Rows are dealt to the starts that see them and aggregated there.
    """
    last = window + F.floor((F.col("idx") - window) / stride) * stride
    least = F.greatest(F.col("idx") - forward, F.lit(window))
    first = window + F.ceil((least - window) / stride) * stride
    dealt = bars.where(F.col("idx") >= window).where(first <= last).withColumn("start", F.explode(F.sequence(first.cast("long"), last.cast("long"), F.lit(stride).cast("long"))))
    i = F.col("idx") - F.col("start")
    at = lambda c: F.max(F.when(i == 0, F.col(c))).alias(c)
    g = dealt.groupBy("symbol", "start").agg(F.max(F.when(i < forward, F.col("high"))).alias("top"), F.min(F.when(i < forward, F.col("low"))).alias("bottom"), F.count("*").alias("n"), at("open"), at("atr"))
    g = g.where((F.col("n") == forward + 1) & (F.col("atr") > 0))
    return g.select("symbol", F.col("start").alias("idx"), (to_bin(F.col("top"), F.col("open"), F.col("atr"), scale) - to_bin(F.col("bottom"), F.col("open"), F.col("atr"), scale)).alias("move"))


def range_report(moves: DataFrame) -> DataFrame:
    q = F.percentile("move", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return moves.groupBy("symbol").agg(F.avg("move").alias("mean"), q.alias("q")).select("symbol", "mean", F.col("q")[1].alias("median"), F.col("q")[0].alias("p25"), F.col("q")[2].alias("p75"))


def drop_null_and_reindex(df: DataFrame, key: str = "symbol", order: str = "idx") -> DataFrame:
    """Rows without nulls, counted anew from 0."""
    return with_position(df.na.drop(), order, "r_", [key]).withColumn(order, F.col("r_") - 1).drop("r_")


def with_trailing(df: DataFrame, values: Mapping[str, tuple[Column, bool]], rows: int, key: str = "symbol", order: str = "idx") -> DataFrame:
    """Adds, for each name of ``values``, the greatest (True) or least value of the last ``rows`` rows, this one included.

    Blocks of ``rows`` rows each have running extremes from both ends; a window reaches over the end
    of the block before, from one place on, and over the beginning of its own.
    """
    d = df.withColumns({"block_": F.floor(F.col(order) / rows), "at_": F.col(order) % rows} | {f"v_{c}": v for c, (v, _) in values.items()})
    w = Window.partitionBy(key, "block_").orderBy(order)
    ahead, behind = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    f = {c: F.max if most else F.min for c, (_, most) in values.items()}
    d = d.withColumns({f"head_{c}": f[c](f"v_{c}").over(ahead) for c in values} | {f"tail_{c}": f[c](f"v_{c}").over(behind) for c in values})
    ends = d.select(F.col(key).alias("key_"), (F.col("block_") + 1).alias("next_"), (F.col("at_") - 1).alias("from_"), *(F.col(f"tail_{c}").alias(f"end_{c}") for c in values))
    d = d.join(ends, (F.col(key) == F.col("key_")) & (F.col("block_") == F.col("next_")) & (F.col("at_") == F.col("from_")), "left")
    both = {c: (F.greatest if most else F.least)(f"head_{c}", f"end_{c}") for c, (_, most) in values.items()}  # both skip a null
    return d.withColumns(both).drop("block_", "at_", "key_", "next_", "from_", *(f"{x}_{c}" for c in values for x in ("v", "head", "tail", "end")))


def scale_factors(bars: DataFrame, period: int = 100, share: float = 0.999) -> DataFrame:
    """By symbol, the percentile of how far prices of the last ``period`` rows lie from the open, in ranges."""
    rows = drop_null_and_reindex(bars)
    rows = with_trailing(rows, {"top": (F.greatest(*PRICES), True), "bottom": (F.least(*PRICES), False)}, period)
    rows = rows.withColumn("ratio", F.greatest(F.col("top") - F.col("open"), F.col("open") - F.col("bottom")) / F.col("atr")).where("idx >= 1")
    return percentiles(rows, ["symbol"], "ratio", [share]).select("symbol", F.col("percentiles")[0].alias("scale"))
