"""Spans of regular-expression matches as native columns: positions in code points, ends exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"
CHUNK = 256


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches (strings)."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def located(text: Column, found: Column, pattern: str) -> Column:
    """``start, end, value`` of each match: what splitting leaves between the matches gives the positions.

    Texts without a match, which are most, are not split.
    """
    gaps = F.slice(F.transform(F.split(text, pattern, -1), F.length), F.lit(1), F.size(found))
    zipped = F.arrays_zip(found.alias("m"), gaps.alias("gap"))

    def inside(chunk: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.array().cast(SPAN).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            lo = acc["at"] + x["gap"]
            hi = lo + F.length(x["m"])
            return F.struct(hi.alias("at"), F.concat(acc["out"], F.array(F.struct(lo.alias("start"), hi.alias("end"), x["m"].alias("value")))).alias("out"))

        return F.aggregate(chunk, start, step, lambda acc: acc["out"])

    # in chunks, as a fold that appends copies what it has: first each chunk's length, then its start, then its spans
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / CHUNK).cast("int")), lambda c: F.slice(zipped, c * CHUNK + 1, F.lit(CHUNK)))
    sizes = F.transform(chunks, lambda chunk: F.aggregate(chunk, F.lit(0), lambda n, x: n + x["gap"] + F.length(x["m"])))
    starts = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    many = F.flatten(F.transform(F.arrays_zip(chunks.alias("chunk"), F.slice(starts, F.lit(1), F.size(chunks)).alias("at")), lambda z: inside(z["chunk"], z["at"])))
    return F.when(F.size(found) > CHUNK, many).when(F.size(found) > 0, inside(zipped, F.lit(0))).otherwise(F.array().cast(SPAN))


def surroundings(text: Column, found: Column, pattern: str, size: int) -> Column:
    """``before, after`` of each match: the last ``size`` code points before it, back to the start of the match before at most, and the one behind it.

    They are taken from the pieces between the matches, so a text with many matches is not gone through for each.
    """
    pieces = F.split(text, pattern, -1)
    n = F.size(found)
    ending = lambda c: F.right(c, F.lit(size))
    last = F.concat(F.array(F.lit("")), F.slice(found, F.lit(1), n - 1))
    zipped = F.arrays_zip(last.alias("last"), F.slice(pieces, F.lit(1), n).alias("gap"), F.slice(pieces, F.lit(2), n).alias("gap2"), F.slice(found, F.lit(2), n).alias("next"))

    def one(x: Column) -> Column:
        before = ending(F.concat(ending(x["last"]), ending(x["gap"])))
        return F.struct(before.alias("before"), F.left(F.concat(x["gap2"], F.coalesce(x["next"], F.lit(""))), F.lit(1)).alias("after"))

    return F.when(n > 0, F.transform(zipped, one)).otherwise(F.array().cast("array<struct<before:string,after:string>>"))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True if a string of digits passes the Luhn check."""
    back = F.reverse(number)

    def part(i: Column) -> Column:
        d = F.substr(back, i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.length(number) - 1), part), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def listed(kinds_and_spans: Column, order: str) -> Column:
    """``kind:start:end`` comma-joined; ``order`` is "start" or "kind". Input: array<struct<rank,kind,start,end,...>>."""
    keys = ("start", "rank", "end") if order == "start" else ("rank", "start", "end")
    ordered = F.array_sort(F.transform(kinds_and_spans, lambda s: F.struct(*(s[k].alias(k) for k in keys), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def overlaps(one: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < one["end"]) & (one["start"] < o["end"]))


def apart(spans: Column, others: Column) -> Column:
    """The ``spans``, in order of their starts and not overlapping, that overlap none of ``others``.

    Many are taken in chunks, each with the ``others`` within its bounds, so that not all meet all.
    """

    def alone(chunk: Column, near: Column) -> Column:
        return F.filter(chunk, lambda s: ~overlaps(s, near))

    def within(chunk: Column) -> Column:
        lo, hi = F.element_at(chunk, 1)["start"], F.element_at(chunk, -1)["end"]
        return F.filter(others, lambda o: (o["start"] < hi) & (lo < o["end"]))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / CHUNK).cast("int")), lambda c: F.slice(spans, c * CHUNK + 1, F.lit(CHUNK)))
    many = F.flatten(F.transform(F.transform(chunks, lambda chunk: F.struct(chunk.alias("chunk"), within(chunk).alias("near"))), lambda z: alone(z["chunk"], z["near"])))
    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).when(F.size(spans) > CHUNK, many).otherwise(alone(spans, others))


def how_many(spans: Column | str, field: str, value: object) -> Column:
    """Number of spans whose ``field`` is ``value``."""
    return F.size(F.filter(spans, lambda s: s[field] == value)).cast("long")
