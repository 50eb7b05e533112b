"""Evaluation: language metrics, benchmark items and their accuracy, losses and schedules."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.hashing import pick

#: Weights of the partial scores.
WEIGHTS = {"semantic": 0.20, "entity": 0.20, "fact": 0.30, "language": 0.20, "ood": 0.10}
_CANDLE_STEPS, _LEVEL_STEPS, _SIZE_STEPS = (-5, -3, 3, 5), (-30, -20, 20, 30), (-15, -10, 10, 15)


def language_metrics(df: DataFrame, ids: str, *by: str) -> DataFrame:
    """Distinct tokens and pairs over all of them, repeats within sequences, and the score, by group.

    Distinct values are counted by groups of (value), so that no task holds a vocabulary.
    """
    tokens = df.select(*by, F.explode(ids).alias("t")).groupBy(*by, "t").agg(F.count("*").alias("c"))
    one = tokens.groupBy(*by).agg(F.sum("c").alias("n1"), F.count("*").alias("d1"))
    pair = F.transform(F.sequence(F.lit(1), F.size(ids) - 1), lambda k: F.struct(F.element_at(ids, k).alias("a"), F.element_at(ids, k + 1).alias("b")))
    pairs = df.where(F.size(ids) >= 2).select(*by, F.explode(pair).alias("p")).groupBy(*by, "p.a", "p.b").agg(F.count("*").alias("c"))
    two = pairs.groupBy(*by).agg(F.sum("c").alias("n2"), F.count("*").alias("d2"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    g = one.join(two, list(by), "left") if by else one.crossJoin(F.broadcast(two))  # one row each
    d1 = F.col("d1") / F.greatest("n1", F.lit(1))
    d2 = F.coalesce(F.col("d2") / F.greatest("n2", F.lit(1)), F.lit(0.0))
    repeat = F.coalesce("same", F.lit(0)) / F.greatest(F.col("n1") - 1, F.lit(1))
    return g.select(*by, d1.alias("distinct1"), d2.alias("distinct2"), repeat.alias("repeat_ratio"), ((d1 + d2) / 2 - repeat).alias("language_score"))


def total_score() -> Column:
    out = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        out = out + F.col(name) * weight
    return out


def score_report(items: DataFrame, score: str, mode: str) -> DataFrame:
    """Mean score, share over 0 and number, by mode and over all (``ALL``)."""
    g = items.rollup(mode).agg(F.avg(score).alias("avg"), F.avg((F.col(score) > 0).cast("double")).alias("pass_rate"), F.count("*").alias("n"), F.grouping(mode).alias("g"))
    return g.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col(mode)).alias("mode"), F.coalesce("avg", F.lit(0.0)).alias("avg"), F.coalesce("pass_rate", F.lit(0.0)).alias("pass_rate"), "n")


def chosen(scores: Column) -> Column:
    """Place (from 0) of the greatest score, the first of equals."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def accuracy(items: DataFrame, scores: str, label: str, chance: float = 0.25) -> DataFrame:
    right = F.avg((chosen(F.col(scores)) == F.col(label)).cast("double"))
    return items.agg(F.count("*").alias("n"), right.alias("accuracy"), (right - chance).alias("over_chance"))


def first_field(inner: Column, key: str) -> Column:
    """Value of the first ``key`` in ``KEY=VALUE`` pairs, numbered or not; null without one."""
    return F.nullif(F.regexp_extract(inner, rf"(?:^|[ _]){key}=(\S+)", 1), F.lit(""))


def with_first_field(inner: Column, key: str, value: Column) -> Column:
    """``inner`` with that value replaced; null if there is none."""
    pattern = rf"^(.*?(?:^|[ _]){key}=)\S+(.*)$"
    parts = [F.regexp_extract(inner, "(?s)" + pattern, k) for k in (1, 2)]
    return F.when(first_field(inner, key).isNotNull(), F.concat(parts[0], value.cast("string"), parts[1]))


def _step(steps: Sequence[int], *keys: Column | str) -> Column:
    k = pick(42, *keys) % len(steps)
    out = F.lit(steps[-1])
    for i, s in enumerate(steps[:-1]):
        out = F.when(k == i, s).otherwise(out)
    return out


def bench_items(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``prompt, positive, negatives, note, template_mode, n_events``: the true fields of a sample against changed ones.

    Each negative changes the first event: its type (and a shift's direction with it), its candle,
    and its level or a gap's size (at least 1).
    """
    s = samples.where("sample_type <> 'synthesis'").withColumn("positive", F.regexp_extract("eval", "(?s)<eval>(.*)</eval>", 1))
    inner = F.col("positive")
    t, d = first_field(inner, "T"), first_field(inner, "DIR")
    flip = lambda x, a, b: F.when(x == a, b).when(x == b, a)
    kind = F.coalesce(flip(t, "SWEEP_HIGH", "SWEEP_LOW"), flip(t, "BULL", "BEAR"))
    wrong_type = F.when(kind.isNotNull(), with_first_field(inner, "T", kind)).otherwise(with_first_field(with_first_field(inner, "T", flip(t, "BOS", "CHoCH")), "DIR", flip(d, "BULL", "BEAR")))
    number = lambda key: first_field(inner, key).cast("int")
    candle = with_first_field(inner, "C", number("C") + _step(_CANDLE_STEPS, *keys, F.lit("C")))
    level = with_first_field(inner, "SL", number("SL") + _step(_LEVEL_STEPS, *keys, F.lit("SL")))
    size = with_first_field(inner, "GS", F.greatest(number("GS") + _step(_SIZE_STEPS, *keys, F.lit("GS")), F.lit(1)))
    negatives = F.filter(F.array(wrong_type, candle, level, size), lambda x: x.isNotNull())
    events = F.size(F.array_distinct(F.regexp_extract_all(inner, F.lit(r"\bE(\d+)_"), F.lit(1))))
    s = s.withColumns({"negatives": negatives, "n_events": F.greatest(events, F.lit(1))}).where(F.size("negatives") > 0)
    prompt = F.concat(F.regexp_extract("text", "(?s)^(.*)<eval>", 1), F.lit("<eval>"))
    return s.select(*keys, prompt.alias("prompt"), "positive", "negatives", F.col("sample_type").alias("note"), F.when(F.col("n_events") > 1, "multi").otherwise("single").alias("template_mode"), "n_events")


def weighted_loss(df: DataFrame, loss: str, n: str, *by: str) -> DataFrame:
    """Loss a token: the sum over the sum, not the mean of means; and its perplexity, the loss cut at 20."""
    mean = F.sum(F.col(loss)) / F.sum(n)
    return df.groupBy(*by).agg(mean.alias("loss"), F.exp(F.least(mean, F.lit(20.0))).alias("perplexity"))


def learning_rate(step: Column, warmup: int, cycle: int, least: float = 0.1) -> Column:
    """Factor of the rate: a line up to ``warmup``, then falling cosines of ``cycle`` steps, down to ``least``."""
    fall = 0.5 * (1 + F.cos(F.lit(math.pi) * (F.pmod(step - warmup, F.lit(cycle)) / F.lit(float(max(cycle, 1))))))
    return F.when(step < warmup, step / F.lit(float(max(1, warmup)))).otherwise(least + (1 - least) * fall)


def step_budget(tokens: Column, block: int, batch: int, warmup_share: float = 0.01) -> tuple[Column, Column]:
    """Steps that so many tokens give, and how many of them warm up."""
    steps = F.floor(tokens / (block * batch))
    return steps, F.floor(steps * warmup_share)


def nucleus(logits: DataFrame, group: str, token: str, logit: str, top_k: int = 50, top_p: float = 0.9, temperature: float = 1.0) -> DataFrame:
    """``group, token, p``: the chances left of each group's tokens after cutting to the ``top_k`` greatest and, of those, to the
    fewest that hold ``top_p``; made to sum to 1. A group is one step's vocabulary. Ties go to the smaller token."""
    w = Window.partitionBy(group).orderBy(F.desc(logit), token)
    d = logits.withColumn("r_", F.row_number().over(w)).where(F.col("r_") <= top_k)
    whole = Window.partitionBy(group)
    e = F.exp((F.col(logit) - F.max(logit).over(whole)) / temperature)
    d = d.withColumn("e_", e).withColumn("p_", F.col("e_") / F.sum("e_").over(whole))
    before = F.coalesce(F.sum("p_").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    d = d.withColumn("b_", before).where(F.col("b_") < top_p)
    return d.select(group, token, (F.col("p_") / F.sum("p_").over(whole)).alias("p"))
