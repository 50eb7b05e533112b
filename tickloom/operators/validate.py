"""Checks of rendered samples: parsing them back, numbers that leak, fields that contradict each other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .render import REQUESTS

NUMBER = r"\d+(?:\.\d+)?"


def split_sample(text: Column) -> Column:
    """``chart, request, explanation, eval`` of a sample's text, or null if it is none (under four lines, or wrong ends)."""
    lines = F.split(text, "\n")
    last = F.element_at(lines, -1)
    ok = (F.size(lines) >= 4) & F.startswith(lines[0], F.lit("<chart>")) & F.startswith(last, F.lit("<eval>")) & F.endswith(last, F.lit("</eval>"))
    middle = F.array_join(F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 3, F.lit(0))), "\n")
    return F.when(ok, F.struct(lines[0].alias("chart"), lines[1].alias("request"), middle.alias("explanation"), last.alias("eval")))


def request_type(request: Column) -> Column:
    """Sample type of a known request, else ``unknown``."""
    out = F.lit("unknown")
    for kind, options in REQUESTS.items():
        out = F.when(request.isin(*options), kind).otherwise(out)
    return out


def eval_fields(block: Column) -> Column:
    """``KEY=VALUE`` pairs of an evaluation block as a map; of a repeated key the last counts.

    A block is parsed once: what is used again inside a lambda is bound to a variable, as an expression there would be evaluated anew for each element.
    """
    inner = F.regexp_extract(block, "(?s)<eval>(.*)</eval>", 1)
    found = F.regexp_extract_all(inner, F.lit(r"(\w+)=(\S+)"), F.lit(0))

    def last(pairs: Column) -> Column:
        back = F.reverse(F.transform(pairs, lambda p: p["key"]))
        return _bound(back, lambda keys: F.filter(pairs, lambda p, i: F.array_position(keys, p["key"]) == F.size(keys) - i))

    def unique(pairs: Column) -> Column:
        keys = F.transform(pairs, lambda p: p["key"])
        return F.when(F.size(F.array_distinct(keys)) == F.size(pairs), pairs).otherwise(last(pairs))

    pairs = F.transform(found, lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.substring(x, F.position(F.lit("="), x) + 1, F.length(x)).alias("value")))
    return F.map_from_entries(_bound(pairs, unique))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def event_fields(samples: DataFrame, block: str = "eval") -> DataFrame:
    """One row for each field of each event: adds ``event`` (1 where fields are not numbered), ``key, value``."""
    out = samples.select("*", F.explode(eval_fields(F.col(block))).alias("k_", "value"))
    number = F.regexp_extract("k_", r"^E(\d+)_", 1)
    return out.withColumns({"event": F.when(number == "", 1).otherwise(number.try_cast("int")), "key": F.regexp_replace("k_", r"^E\d+_", "")}).drop("k_")


def leaks(explanation: Column, block: Column) -> Column:
    """True if the explanation has a number that the evaluation block lacks."""
    numbers = lambda c: F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0))
    return F.size(F.array_except(numbers(explanation), numbers(block))) > 0


def inconsistent_fields(fields: DataFrame, group: tuple[str, ...], order: str) -> DataFrame:
    """Fields of one event, told by type and candle, that differ from the first sample's in the group: ``group, T, C, key`` and how often."""
    event = Window.partitionBy(*group, order, "event")
    told = lambda key: F.max(F.when(F.col("key") == key, F.col("value"))).over(event)
    named = fields.withColumns({"T": told("T"), "C": told("C")}).where("key not in ('T', 'C')")
    w = Window.partitionBy(*group, "T", "C", "key").orderBy(order, "event").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return named.withColumn("first_", F.first("value").over(w)).where("value <> first_").groupBy(*group, "T", "C", "key").agg(F.count("*").alias("n"))


def report(samples: DataFrame, length: str = "token_length", limit: int = 512) -> DataFrame:
    """By sample type, and for all (``type`` is ALL): samples, parse failures, leaks, percentiles of length and the share over ``limit``."""
    s = samples.withColumn("p_", split_sample(F.col("text")))
    s = s.withColumns({"type_": F.coalesce(request_type(F.col("p_.request")), F.lit("unknown")), "bad_": F.col("p_").isNull(), "leak_": F.coalesce(leaks(F.col("p_.explanation"), F.col("p_.eval")), F.lit(False))})
    q = F.percentile(length, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    g = s.rollup("type_").agg(F.count("*").alias("n"), F.count_if("bad_").alias("unparsed"), F.count_if("leak_").alias("leaking"), q.alias("q"), (F.count_if(F.col(length) > limit) * 100.0 / F.count("*")).alias("over_pct"), F.grouping("type_").alias("g"))
    return g.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("type_")).alias("type"), "n", "unparsed", "leaking", *(F.col("q")[i].alias(f"length_p{k}") for i, k in enumerate((50, 90, 99))), "over_pct")
