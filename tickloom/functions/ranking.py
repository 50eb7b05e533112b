"""Exact row numbers of a whole table, or of groups of any size, without a task that holds a group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.sources.sinks import materialised

BUCKETS = 1 << 14
#: Ranges of the order of a column.
RANGES = 2048


def with_rank(df: DataFrame, number: Column, ties: Sequence[str], out: str = "rank", groups: Sequence[str] = (), total: str | None = None, upper: float = float(1 << 32)) -> DataFrame:
    """Adds ``out``, the row's place from 1 by ``number`` (from 0 up to ``upper``) and ``ties``, within ``groups``; and the group's size.

    Rows are numbered within ranges of the hash, which are as many tasks; the ranges' counts, at
    most ``BUCKETS`` a group, give each range its start.
    """
    return _ranked(df, number, F.floor(F.col("number_") * BUCKETS / F.lit(upper)).cast("int"), ties, out, groups, total)


def _ranked(df: DataFrame, number: Column, bucket: Column, ties: Sequence[str], out: str, groups: Sequence[str], total: str | None) -> DataFrame:
    """``bucket`` must not fall as ``number`` (``number_`` in it) rises."""
    d = df.withColumn("number_", number).withColumn("b_", bucket)
    sizes = d.groupBy(*groups, "b_").agg(F.count("*").alias("c_"))
    w = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    ahead = F.coalesce(F.sum("c_").over(w.orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*(F.col(g).alias(f"{g}_g_") for g in groups), F.col("b_").alias("bb_"), ahead.alias("ahead_"), F.sum("c_").over(w).alias("total_"))
    same = F.col("b_") == F.col("bb_")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}_g_"))
    inside = F.row_number().over(Window.partitionBy(*groups, "b_").orderBy("number_", *ties))
    d = d.withColumn("place_", inside).join(sizes, same).withColumn(out, (F.col("place_") + F.col("ahead_")).cast("long"))
    if total:
        d = d.withColumn(total, F.col("total_"))
    return d.drop("number_", "b_", "place_", "bb_", "ahead_", "total_", *(f"{g}_g_" for g in groups))


def with_order(df: DataFrame, key: str, out: str = "rank", groups: Sequence[str] = (), total: str | None = None) -> DataFrame:
    """``with_rank`` by an integer column of any values; a null comes first.

    Ranges are of like numbers of rows, between quantiles that are looked up first, so that a few outlying values
    do not put all others into one range.
    """
    bounds = df.agg(F.percentile_approx(key, [k / RANGES for k in range(1, RANGES)], 20 * RANGES)).first()[0]
    bounds = F.expr("cast(array(" + ", ".join(f"'{int(x)}'" for x in sorted(set(bounds or []))) + ") as array<bigint>)")
    return _ranked(df, F.col(key), _place(F.col(key), bounds), [key], out, groups, total)


def with_position(df: DataFrame, key: str, out: str = "rank", groups: Sequence[str] = (), total: str | None = None, width: int = 4096) -> DataFrame:
    """``with_order`` for a column that counts rows already, but for gaps: its ranges need no look at the data."""
    return _ranked(df, F.col(key), F.floor(F.col(key) / width), [key], out, groups, total)


def _place(value: Column, bounds: Column) -> Column:
    """How many of the sorted ``bounds`` are below a value, by halving; 0 for null."""
    state = F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi"))

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        more = (acc["lo"] < acc["hi"]) & (F.get(bounds, mid) < value)
        return F.struct(F.when(more, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(more, acc["hi"]).otherwise(F.least(mid, acc["hi"])).alias("hi"))

    halvings = F.sequence(F.lit(1), F.lit(max(1, RANGES.bit_length())))
    return F.coalesce(F.aggregate(halvings, state, step, lambda acc: acc["lo"]), F.lit(0))


def with_index(df: DataFrame, order: Sequence[str], out: str = "index", sums: Mapping[str, str] = {}) -> DataFrame:
    """Adds ``out``, the row's place from 0 by columns of any kind, and for each name of ``sums`` the total of its column over the rows up to this one.

    Rows are dealt by ranges of the order, written, and numbered and summed within the ranges; the ranges' own totals give each its start.
    """
    d = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"range_": F.spark_partition_id(), "at_": F.monotonically_increasing_id()})
    d = materialised(d)
    inner = Window.partitionBy("range_").orderBy("at_")
    d = d.withColumns({out: (F.row_number().over(inner) - 1).cast("long")} | {name: F.sum(c).over(inner) for name, c in sums.items()})
    totals = d.groupBy("range_").agg(F.count("*").alias("n_"), *(F.max(F.struct("at_", name))[name].alias(f"t_{name}") for name in sums))
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    totals = totals.select(F.col("range_").alias("key_"), F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("b_"), *(F.coalesce(F.sum(f"t_{name}").over(before), F.lit(0)).alias(f"b_{name}") for name in sums))
    d = d.join(totals, F.col("range_") == F.col("key_")).withColumns({out: F.col(out) + F.col("b_")} | {name: F.coalesce(name, F.lit(0)) + F.col(f"b_{name}") for name in sums})
    return d.drop("range_", "at_", "key_", "b_", *(f"b_{name}" for name in sums))
