"""Curricula: a chart explained in layers, from what a candle is to what candles do together.

The layers' wording is our own. A chart's lines are aggregates over its candles in long form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import candles as C
from tickloom.functions.hashing import pick

from . import detect as D

HEADS = ("candles", "directions", "current price", "swings", "gaps", "roles", "patterns")
CONCEPT = "A candle has an open, a high, a low and a close. It rises if it closes over its open, and falls if it closes under it."
NONE = "None."
SEPARATOR = "\n\n"


def layers(candles: DataFrame, threshold: int = 1, window: int = 2) -> DataFrame:
    """``symbol, start_idx, layer0 .. layer6``: each layer's lines, without heads. Candles count from 1."""
    w = Window.partitionBy(*D.CHART).orderBy("i")
    way = C.direction(F.col("o"), F.col("c"), threshold)
    k = D.with_swings(candles, window).withColumns({"way": way, "po": F.lag("o").over(w), "pc": F.lag("c").over(w), "h2": F.lag("h", 2).over(w), "l2": F.lag("l", 2).over(w)})
    gap = F.when(F.col("l") > F.col("h2"), "rising").when(F.col("h") < F.col("l2"), "falling")
    pin = C.pin_bar(F.col("o"), F.col("h"), F.col("l"), F.col("c"))
    engulfing = C.engulfing(F.col("po"), F.col("pc"), F.col("o"), F.col("c"), threshold)
    k = k.withColumns({"no": F.col("i") + 1, "gap": gap, "pin": pin, "engulfing": engulfing})
    pattern = F.coalesce("pin", "engulfing")
    role = F.concat_ws(", ", F.when(F.col("swing_high"), "swing high"), F.when(F.col("swing_low"), "swing low"), F.when(F.col("gap").isNotNull(), "gap"))
    line = lambda text, when: F.when(when, text)
    lines = {
        1: F.format_string("Candle %d: %s.", "no", F.lower("way")),
        3: line(F.format_string("Candle %d: %s.", "no", F.concat_ws(", ", F.when(F.col("swing_high"), F.format_string("high at %d", "h")), F.when(F.col("swing_low"), F.format_string("low at %d", "l")))), F.col("swing_high") | F.col("swing_low")),
        4: line(F.format_string("Candle %d: %s.", "no", "gap"), F.col("gap").isNotNull()),
        5: line(F.format_string("Candle %d: %s, %s.", "no", F.lower("way"), role), (F.col("way") != "DOJI") & (role != "")),
        6: line(F.format_string("Candle %d: %s.", "no", F.lower(pattern)), pattern.isNotNull()),
    }
    k = k.withColumns({f"x{n}": c for n, c in lines.items()})
    joined = lambda n: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(f"x{n}").isNotNull(), F.struct("i", F.col(f"x{n}").alias("x"))))), lambda s: s["x"]), "\n")
    g = k.groupBy(*D.CHART).agg(F.max_by("c", "i").alias("price"), *(joined(n).alias(f"j{n}") for n in lines))
    text = lambda n: F.when(F.col(f"j{n}") == "", NONE).otherwise(F.col(f"j{n}")).alias(f"layer{n}")
    return g.select(*D.CHART, F.lit(CONCEPT).alias("layer0"), text(1), F.format_string("The last close is at %d.", "price").alias("layer2"), text(3), text(4), text(5), text(6))


def assemble(layered: DataFrame, chosen: Column, headed: bool = True) -> DataFrame:
    """``symbol, start_idx, num_layers, text`` of the layers whose numbers are in the array ``chosen``, in order."""
    parts = [F.when(F.array_contains(chosen, n), F.concat(F.lit(f"=== {head} ===\n"), F.col(f"layer{n}")) if headed else F.col(f"layer{n}")) for n, head in enumerate(HEADS)]
    return layered.select(*D.CHART, F.size(chosen).alias("num_layers"), F.concat_ws(SEPARATOR, *parts).alias("text"))


def random_layers(*keys: str, least: int = 2, seed: int = 42) -> Column:
    """A hashed choice of at least ``least`` layers, sorted: either a run of them or any."""
    n = len(HEADS)
    size = least + pick(seed, *keys, F.lit("size")) % (n - least + 1)
    start = pick(seed, *keys, F.lit("start")) % (n - size + 1)
    run = F.transform(F.sequence(F.lit(0), (size - 1).cast("int")), lambda k: (k + start).cast("int"))
    order = F.array_sort(F.array(*(F.struct(pick(seed, *keys, F.lit(f"layer{k}")).alias("h"), F.lit(k).alias("k")) for k in range(n))))
    subset = F.array_sort(F.transform(F.slice(order, F.lit(1), size.cast("int")), lambda s: s["k"]))
    return F.when(pick(seed, *keys, F.lit("mode")) % 2 == 0, run).otherwise(subset)
