"""Exact percentiles of groups of any size, by selection: no buffer holds a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.sources.sinks import dropped, materialised

#: Cells of an interval that a round counts, and rows of the largest group up to which the built-in percentile's buffer is small.
CELLS, AT_ONCE = 512, 1_000_000
#: Targets up to which they are sent to every task.
SENT = 20_000


def percentiles(df: DataFrame, groups: Sequence[str], value: str, shares: Sequence[float], at_once: int = AT_ONCE) -> DataFrame:
    """``*groups, percentiles``: an array with the percentile of each share, linear between neighbours. Nulls and NaN do not count.

    Groups of up to ``at_once`` rows go through the built-in function, whose buffer holds a group's distinct values. Where any is larger, order
    statistics are selected instead: each round counts the rows of the interval that is left in ``CELLS`` cells and goes on with
    the cell that has the wanted rank, cut to the values that are in it, until it holds a single one. A group without values has no row.
    """
    d = df.select(*groups, F.col(value).cast("double").alias("v_")).where("v_ IS NOT NULL AND NOT isnan(v_)")
    sizes = d.groupBy(*groups).agg(F.count("*").alias("n_"), F.min("v_").alias("lo_"), F.max("v_").alias("hi_"))
    most = sizes.agg(F.max("n_")).first()[0] or 0
    if most <= at_once:
        return d.groupBy(*groups).agg(F.percentile("v_", F.array(*map(F.lit, shares))).alias("percentiles"))
    # two neighbours a share: the rank below its place and the one above
    places = F.array(*(F.struct(F.lit(k).alias("k_"), (F.lit(float(s)) * (F.col("n_") - 1)).alias("at_")) for k, s in enumerate(shares)))
    t = sizes.withColumn("p_", F.explode(places)).select(*groups, "lo_", "hi_", "n_", "p_.k_", "p_.at_")
    t = t.withColumn("up_", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("rank_", F.least(F.floor("at_") + F.col("up_"), F.col("n_") - 1).cast("long")).drop("n_")
    t = materialised(t)
    rows = d
    while True:
        left, total = t.agg(F.count_if(F.col("lo_") < F.col("hi_")), F.count("*")).first()
        if not left:
            break
        wanted = t.where("lo_ < hi_")
        small = F.broadcast(wanted) if total <= SENT else wanted
        at = F.least(F.floor((F.col("v_") / 2 - F.col("lo_") / 2) / (F.col("hi_") / 2 - F.col("lo_") / 2) * CELLS), F.lit(CELLS - 1)).cast("int")
        inside = _joined(rows, small, groups).where("v_ >= lo_ AND v_ <= hi_")
        keys = [*groups, "k_", "up_"]
        cells = inside.groupBy(*keys, at.alias("c_")).agg(F.count("*").alias("n_"), F.min("v_").alias("min_"), F.max("v_").alias("max_"), F.first("rank_").alias("rank_"), F.first("at_").alias("at_"))
        w = Window.partitionBy(*keys).orderBy("c_").rowsBetween(Window.unboundedPreceding, -1)  # at most CELLS rows
        cells = cells.withColumn("before_", F.coalesce(F.sum("n_").over(w), F.lit(0))).where("rank_ >= before_ AND rank_ < before_ + n_")
        new = cells.select(*groups, F.col("min_").alias("lo_"), F.col("max_").alias("hi_"), "k_", "at_", "up_", (F.col("rank_") - F.col("before_")).alias("rank_"))
        new = materialised(new.unionByName(t.where("NOT lo_ < hi_")))
        dropped(t)
        t = new
    both = t.groupBy(*groups, "k_").agg(F.first("at_").alias("at_"), F.max(F.when(F.col("up_") == 0, F.col("lo_"))).alias("low_"), F.max(F.when(F.col("up_") == 1, F.col("lo_"))).alias("high_"))
    part = F.col("at_") - F.floor("at_")
    both = both.withColumn("q_", F.when(part == 0, F.col("low_")).otherwise((1 - part) * F.col("low_") + part * F.col("high_")))
    return both.groupBy(*groups).agg(F.transform(F.array_sort(F.collect_list(F.struct("k_", "q_"))), lambda x: x["q_"]).alias("percentiles"))


def _joined(rows: DataFrame, targets: DataFrame, groups: Sequence[str]) -> DataFrame:
    if not groups:
        return rows.crossJoin(F.broadcast(targets))  # two rows a share
    same = F.lit(True)
    names = [f"g{k}_" for k, _ in enumerate(groups)]
    for g, n in zip(groups, names, strict=True):
        same = same & F.col(g).eqNullSafe(F.col(n))
    return rows.join(targets.withColumnsRenamed(dict(zip(groups, names, strict=True))), same).drop(*names)
