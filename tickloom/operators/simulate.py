"""Trade simulation over the bins that follow a window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.codec import to_bin
from tickloom.functions.hashing import pick
from tickloom.functions.ranking import with_rank

#: The actions of the sample format.
ACTIONS = ("buy_25", "buy_50", "buy_100", "sell_25", "sell_50", "sell_100")
STOPS = (-20, -40, -60, -80)
TARGETS = (40, 80, 120, 160)


def setups(stops: Sequence[int] = STOPS, targets: Sequence[int] = TARGETS, min_ratio: float = 1.0, strict: bool = False) -> list[tuple[int, int]]:
    """Pairs of stop and target whose reward is at least (``strict``: more than) ``min_ratio`` times the risk."""
    return [(s, t) for s in stops for t in targets if (t > abs(s) * min_ratio if strict else t >= abs(s) * min_ratio)]


def forward_bins(wins: DataFrame, window: int, scale: float) -> DataFrame:
    """Rows behind each window: ``symbol, start_idx, k`` (from 1), bins ``h, l, c`` and the entry bin of the first open."""
    b = lambda c: to_bin(F.col(c), F.col("anchor_open"), F.col("anchor_atr"), scale)
    out = wins.where(F.col("i") >= window).select("symbol", "start_idx", (F.col("i") - window + 1).alias("k"), b("open").alias("o"), b("high").alias("h"), b("low").alias("l"), b("close").alias("c"))
    return out.withColumn("entry", F.max(F.when(F.col("k") == 1, F.col("o"))).over(Window.partitionBy("symbol", "start_idx"))).drop("o")


def score(exit_type: Column, pnl: Column, drawdown: Column, candle: Column, forward: int, worst_stop: int) -> Column:
    speed = 1.0 - candle / F.lit(float(forward))
    clean = F.greatest(1.0 - F.abs(drawdown) / F.lit(float(max(abs(worst_stop), 1))), F.lit(0.0))
    hit = F.bround(F.least(5.0 + speed * 2.5 + clean * 2.5, F.lit(10.0)), 1)
    return F.when(exit_type == "sl_hit", 0.0).when(exit_type == "timeout", F.when(pnl > 0, 3.0).otherwise(1.0)).otherwise(hit)


def simulate(forward: DataFrame, length: int, spread: int = 2, stops: Sequence[int] = STOPS, targets: Sequence[int] = TARGETS, min_ratio: float = 1.0, strict: bool = False) -> DataFrame:
    """``symbol, start_idx, side, sl, tp, exit_type, candle_exit, pnl_bins, max_dd_bins, score`` of every setup on both sides.

    The first candle that reaches stop or target ends a trade; on one candle the stop counts. What
    a trade risks before its exit is a running minimum, taken at the exit. A chart is one row of aggregates of fixed size, the
    first hit of each stop and each target with the extreme up to it, and becomes its trades only then: no candle is copied to them.
    """
    long = [("long", 1, s, t) for s, t in setups(stops, targets, min_ratio, strict)] + [("short", -1, s, t) for s, t in setups(stops, targets, min_ratio, strict)]
    w = Window.partitionBy("symbol", "start_idx").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    f = forward.withColumns({"low_so_far": F.min("l").over(w), "high_so_far": F.max("h").over(w)})
    stop_of = {(g, s): f"stop{n}_" for n, (g, s) in enumerate(sorted({(g, s) for _, g, s, _ in long}))}
    target_of = {(g, t): f"target{n}_" for n, (g, t) in enumerate(sorted({(g, t) for _, g, _, t in long}))}
    # a hit is its candle and the extreme up to it, packed in one number, so that the least is the first
    hit = lambda test, extreme: F.min(F.when(test, F.shiftleft(F.col("k").cast("long"), 32) + F.col(extreme) + F.lit(1 << 31)))
    level = lambda g, x: F.col("entry") + g * spread + g * x
    seen = {1: "low_so_far", -1: "high_so_far"}
    hits = [hit(F.col("l") <= level(g, s) if g > 0 else F.col("h") >= level(g, s), seen[g]).alias(n) for (g, s), n in stop_of.items()]
    hits += [hit(F.col("h") >= level(g, t) if g > 0 else F.col("l") <= level(g, t), seen[g]).alias(n) for (g, t), n in target_of.items()]
    g = f.groupBy("symbol", "start_idx", "entry").agg(*hits, F.max_by("c", "k").alias("last"), F.min("l").alias("low_"), F.max("h").alias("high_"))
    table = F.array(*(F.struct(F.lit(n).alias("side"), F.lit(g).alias("sign"), F.lit(s).alias("sl"), F.lit(t).alias("tp"), F.col(stop_of[g, s]).alias("s_"), F.col(target_of[g, t]).alias("t_"), F.col("low_" if g > 0 else "high_").alias("all_")) for n, g, s, t in long))
    g = g.select("symbol", "start_idx", "entry", "last", F.explode(table).alias("x")).select("symbol", "start_idx", "entry", "last", "x.*")
    at = lambda x: F.shiftright(x, 32)
    stopped = F.col("s_").isNotNull() & (F.col("t_").isNull() | (at(F.col("s_")) <= at(F.col("t_"))))
    kind = F.when(stopped, "sl_hit").when(F.col("t_").isNotNull(), "tp_hit").otherwise("timeout")
    g = g.withColumns({"e": F.col("entry") + F.col("sign") * spread, "exit_type": kind, "hit_": F.when(stopped, F.col("s_")).otherwise(F.col("t_"))})
    extreme = F.coalesce((F.col("hit_").bitwiseAND(F.lit((1 << 32) - 1)) - F.lit(1 << 31)).cast("int"), F.col("all_"))
    pnl = F.when(F.col("exit_type") == "sl_hit", F.col("sl")).when(F.col("exit_type") == "tp_hit", F.col("tp")).otherwise(F.col("sign") * (F.col("last") - F.col("e")))
    drawdown = F.least(F.col("sign") * (extreme - F.col("e")), F.lit(0))
    g = g.select("symbol", "start_idx", "side", "sl", "tp", "exit_type", F.coalesce(at(F.col("hit_")).cast("int"), F.lit(length)).alias("candle_exit"), pnl.alias("pnl_bins"), drawdown.alias("max_dd_bins"))
    return g.withColumn("score", score(F.col("exit_type"), F.col("pnl_bins"), F.col("max_dd_bins"), F.col("candle_exit"), length, min(stops)))


def with_actions(trades: DataFrame) -> DataFrame:
    """A row for each trade and size of position; the size changes nothing but the action."""
    actions = F.when(F.col("side") == "long", F.array(*map(F.lit, ACTIONS[:3]))).otherwise(F.array(*map(F.lit, ACTIONS[3:])))
    return trades.withColumn("action", F.explode(actions))


def trade_samples(actions: DataFrame, charts: DataFrame) -> DataFrame:
    """A sample's text for each row of ``with_actions``."""
    t = actions.join(charts.select("symbol", "start_idx", F.col("text").alias("chart")), ["symbol", "start_idx"])
    text = F.format_string("%s\n<action>%s</action>\n<sl>%d</sl>\n<tp>%d</tp>\n<result>%s | candle:%d | pnl_bins:%+d | max_dd_bins:%+d | score:%s</result>", "chart", "action", "sl", "tp", "exit_type", "candle_exit", "pnl_bins", "max_dd_bins", F.col("score").cast("string"))
    return t.select("symbol", "start_idx", "action", "sl", "tp", "exit_type", text.alias("text"))


def exit_type(text: Column) -> Column:
    """Kind of exit by what occurs in a sample's text."""
    return F.when(text.contains("tp_hit"), "tp_hit").when(text.contains("sl_hit"), "sl_hit").otherwise("timeout")


def balance(samples: DataFrame, bucket: str, keys: Sequence[str], seed: int | str = 42) -> DataFrame:
    """As many rows of each bucket as the smallest that is not empty has, chosen and ordered (``rank``) by a hash of ``keys``."""
    least = samples.groupBy(bucket).agg(F.count("*").alias("n")).agg(F.min("n").alias("least_"))
    ranked = with_rank(samples, pick(seed, *keys), list(keys), "rank", [bucket])
    return ranked.crossJoin(F.broadcast(least)).where(F.col("rank") <= F.col("least_")).drop("least_")  # least is one row


def exit_distribution(samples: DataFrame, bucket: str = "exit_type") -> DataFrame:
    g = samples.groupBy(bucket).agg(F.count("*").alias("n"))
    return g.withColumn("pct", F.bround(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 1))
