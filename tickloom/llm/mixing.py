"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens to the power of an exponent, normalised. The exponent
is bisected between 0 (all alike) and 1 (as they are): the largest that reaches the target entropy,
raised where a source would be repeated more often than allowed. A source is then read in epochs,
each in a permutation of its own, until its part of the budget is used; its tokens are dealt to
blocks so that each block holds the sources in their weights; within a block rows are permuted.

Positions within an epoch are running sums of tokens in the order of a hash. They are made in two
levels, within buckets of the hash and over the buckets' sums, so that no task holds a source: a
source of n documents has about the square root of n buckets, or one for every 512 documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stash


#: Sources up to which their table (about 60 bytes a source) is broadcast.
MAX_BROADCAST = 50_000


@dataclass(frozen=True)
class SourcePlan:
    """One source's tokens, weight, budget in tokens and documents."""

    source: str
    tokens: int
    docs: int
    weight: float
    budget: float


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def _weights(tokens: list[int], exponent: float) -> list[float]:
    total = sum(tokens)
    raw = [(t / total) ** exponent if t else 0.0 for t in tokens]
    return [r / sum(raw) for r in raw]


def bisect(ok, low: float = 0.0, high: float = 1.0) -> float:
    """Largest exponent for which ``ok`` holds, which must hold below some point only."""
    if ok(high):
        return high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if ok(mid) else (low, mid)
    return low


def plan_weights(sources: list[tuple[str, int, int]], target_entropy: float = 0.9, max_repeats: float = 4.0, budget: float | None = None) -> list[SourcePlan]:
    """Weights of sources (name, tokens, documents).

    ``target_entropy`` is a share of the greatest possible, the logarithm of the number of sources
    with tokens. Without a ``budget`` it is the least for which no source is cut, so that every
    document is taken at least once. Sources without tokens get no weight and are taken once.
    """
    sources = sorted(sources)
    tokens = [t for _, t, _ in sources]
    total = sum(tokens)
    if not total:
        return [SourcePlan(s, 0, d, 0.0, 0.0) for s, _, d in sources]
    goal = target_entropy * math.log(max(1, sum(t > 0 for t in tokens)))

    def asked(w: list[float]) -> float:
        return max(t / x for t, x in zip(tokens, w, strict=True) if t) if budget is None else budget

    def repeats(exponent: float) -> float:
        w = _weights(tokens, exponent)
        return max(x * asked(w) / t for t, x in zip(tokens, w, strict=True) if t)

    exponent = bisect(lambda e: entropy(_weights(tokens, e)) >= goal)
    if repeats(exponent) > max_repeats:  # fewer repeats with a larger exponent
        exponent = 1 - bisect(lambda e: repeats(1 - e) <= max_repeats, 0.0, 1 - exponent)
    w = _weights(tokens, exponent)
    return [SourcePlan(s, t, d, x, x * asked(w)) for (s, t, d), x in zip(sources, w, strict=True)]


def token_count(text: Column) -> Column:
    """Runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hash(seed: int, *cols: Column) -> Column:
    return F.xxhash64(F.lit(seed).cast("long"), *cols)


def schedule(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    target_entropy: float = 0.9,
    max_repeats: float = 4.0,
    budget: float | None = None,
    block_tokens: int = 100_000,
    seed: int = 13,
) -> DataFrame:
    """``doc_id, source, tokens, epoch, block, position``: one row for every time a document is taken.

    A source's last epoch ends with the document that reaches its budget, so that it overshoots by less than that
    document. Rows that share id and source are one document of their tokens' sum. Null sources
    are one source, the empty string; a null id is an id. Texts that are null or have no tokens are taken in
    every whole epoch. One row a source reaches the driver.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), token_count(F.col(text_col)).alias("tokens"))
    rows = stash(rows.groupBy("doc_id", "source").agg(F.sum("tokens").alias("tokens")), "tokens")
    found = rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).collect()
    plans = plan_weights([(r["source"], r["tokens"], r["docs"]) for r in found], target_entropy, max_repeats, budget)
    spark = docs.sparkSession
    fields = {"source": pa.string(), "total": pa.int64(), "quota": pa.float64(), "share": pa.float64(), "buckets": pa.int32(), "epochs": pa.int32()}
    lines = [(p.source, p.tokens, float(p.budget), p.weight * block_tokens, max(1, min(-(-p.docs // 512), math.isqrt(p.docs) * 8)), max(1, math.ceil(p.budget / p.tokens - 1e-9)) if p.tokens else 1) for p in plans]
    # by Arrow, as a list of rows would start Python workers on the executors only to read it
    table = spark.createDataFrame(pa.table([pa.array([r[k] for r in lines], kind) for k, kind in enumerate(fields.values())], names=list(fields)))
    # a row a source: broadcast up to a bound, so that a hot source is not one task; beyond it AQE splits it
    table = F.broadcast(table) if len(plans) <= MAX_BROADCAST else table.hint("merge")
    taken = rows.join(table, "source").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    taken = taken.withColumn("h", _hash(seed, F.col("epoch"), F.col("doc_id"))).withColumn("bucket", F.floor(F.shiftrightunsigned("h", 32) / F.lit(float(1 << 32)) * F.col("buckets")).cast("int"))
    sums = taken.groupBy("source", "epoch", "bucket").agg(F.sum("tokens").alias("n"))
    ahead = Window.partitionBy("source", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "epoch", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "epoch", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    taken = taken.withColumn("within", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(sums, ["source", "epoch", "bucket"])
    # a text without tokens behind the last one with tokens belongs to this epoch, not to the next
    start = F.least(F.col("epoch") * F.col("total") + F.col("before") + F.col("within"), F.greatest((F.col("epoch") + 1) * F.col("total") - 1, F.lit(0)))
    taken = taken.withColumn("start", start).where((F.col("start") < F.col("quota") - 1e-6) | (F.col("epoch") == 0) & (F.col("total") == 0))
    block = F.when(F.col("share") > 0, F.floor(F.col("start") / F.col("share"))).otherwise(0).cast("long")
    mixed = Window.partitionBy("block").orderBy(_hash(seed + 1, F.col("block"), F.col("epoch"), F.col("doc_id")), "source", "epoch", "doc_id")
    return taken.withColumn("block", block).withColumn("position", F.row_number().over(mixed).cast("long") - 1).select("doc_id", "source", "tokens", "epoch", "block", "position")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options: float) -> DataFrame:
    """``docs``, each row as often as it is taken, with ``epoch, block, position`` (leading underscores where names clash)."""
    plan = schedule(docs, id_col, source_col, text_col, **options)
    names = fresh(docs, "epoch", "block", "position", "plan_id", "plan_source")
    plan = plan.select(F.col("doc_id").alias(names[3]), F.col("source").alias(names[4]), *(F.col(c).alias(n) for c, n in zip(("epoch", "block", "position"), names, strict=False)))
    same = docs[id_col].cast("long").eqNullSafe(plan[names[3]]) & (F.coalesce(docs[source_col].cast("string"), F.lit("")) == plan[names[4]])
    return docs.join(plan, same).drop(names[3], names[4])
