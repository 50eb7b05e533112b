"""Samples: a chart, a request, sentences about its events, and the events' fields to be evaluated.

Sentences are our own; which of them an event gets follows from a hash of the chart and the event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.hashing import pick

from .detect import CHART

TOP_K = 4
SHORT_FROM = 3
#: (full, short) sentences by type of event.
SENTENCES: dict[str, tuple[tuple[str, str], tuple[str, str]]] = {
    "SWEEP_HIGH": (
        ("Candle {c} runs {depth} bins over the high at {level} that candle {s} left, and takes it.", "The resting high of candle {s} at {level} is taken by candle {c}, {depth} bins further up."),
        ("Candle {c} takes the high at {level}.", "High {level} is taken at candle {c}."),
    ),
    "SWEEP_LOW": (
        ("Candle {c} runs {depth} bins under the low at {level} that candle {s} left, and takes it.", "The resting low of candle {s} at {level} is taken by candle {c}, {depth} bins further down."),
        ("Candle {c} takes the low at {level}.", "Low {level} is taken at candle {c}."),
    ),
    "BULL": (
        ("A rising gap of {size} bins opens at candle {c}; the last candle covers {fill} percent of it.", "Candle {c} leaves {size} bins untraded below it, {fill} percent of which are covered by now."),
        ("Rising gap of {size} at candle {c}.", "Candle {c} leaves a rising gap of {size}."),
    ),
    "BEAR": (
        ("A falling gap of {size} bins opens at candle {c}; the last candle covers {fill} percent of it.", "Candle {c} leaves {size} bins untraded above it, {fill} percent of which are covered by now."),
        ("Falling gap of {size} at candle {c}.", "Candle {c} leaves a falling gap of {size}."),
    ),
    "BOS": (
        ("Candle {c} closes beyond {level}, the swing of candle {s}, and carries the {dir} trend on.", "The {dir} trend goes on as candle {c} closes past {level} from candle {s}."),
        ("Candle {c} carries the {dir} trend past {level}.", "Past {level} at candle {c}, still {dir}."),
    ),
    "CHoCH": (
        ("Candle {c} closes beyond {level}, the swing of candle {s}, and turns the trend to {dir}.", "The trend turns to {dir} as candle {c} closes past {level} from candle {s}."),
        ("Candle {c} turns the trend to {dir} at {level}.", "Turn to {dir} past {level} at candle {c}."),
    ),
}
REQUESTS = {
    "sweep": ("Which swings does this chart take?", "List the levels that are swept here."),
    "gap": ("Where does this chart leave gaps?", "List the gaps of this chart."),
    "shift": ("Where does the structure shift?", "List the shifts of structure here."),
    "synthesis": ("What happens in this chart?", "Read this chart from left to right."),
}
FIELDS = {
    "sweep": (("T", "type"), ("C", "c"), ("SC", "s"), ("SL", "swing_level"), ("D", "depth")),
    "gap": (("T", "type"), ("C", "c"), ("GL", "gap_low"), ("GH", "gap_high"), ("GS", "gap_size"), ("FP", "fill_pct")),
    "shift": (("T", "type"), ("DIR", "direction"), ("C", "c"), ("SC", "s"), ("SL", "swing_level"), ("BR", "broken_type")),
}
_SLOTS = (("{c}", "c"), ("{s}", "s"), ("{level}", "swing_level"), ("{depth}", "depth"), ("{size}", "gap_size"), ("{fill}", "fill_pct"), ("{dir}", "direction"))


def top_gaps(events: DataFrame, last: DataFrame, k: int = TOP_K) -> DataFrame:
    """``events`` with ``shown``: of gaps the ``k`` with the least sum of ranks by distance from the last close and by age.

    ``last`` has each chart's number of candles ``n`` and last close ``close_last``. All gaps are
    shown where there are ``k`` or fewer, and every other event. Ties go to the earlier gap.
    """
    e = events.join(last, list(CHART)).withColumns({"pd_": F.abs((F.col("gap_low") + F.col("gap_high")) / 2.0 - F.col("close_last")), "td_": F.col("n") - 1 - F.col("candle_idx")})
    w = Window.partitionBy(*CHART, "kind")
    e = e.withColumns({"pr_": F.row_number().over(w.orderBy("pd_", "seq")), "tr_": F.row_number().over(w.orderBy("td_", "seq"))})
    e = e.withColumn("fr_", F.row_number().over(w.orderBy(F.col("pr_") + F.col("tr_"), "seq")))
    return e.withColumn("shown", (F.col("kind") != "gap") | (F.col("fr_") <= k)).drop("n", "close_last", "pd_", "td_", "pr_", "tr_", "fr_")


def last_candles(candles: DataFrame) -> DataFrame:
    return candles.groupBy(*CHART).agg(F.count("*").cast("int").alias("n"), F.max_by("c", "i").alias("close_last"))


def _fill(template: Column) -> Column:
    for slot, col in _SLOTS:
        template = F.replace(template, F.lit(slot), F.coalesce(F.col(col).cast("string"), F.lit("")))
    return template


def _choose(options: tuple[str, str], which: Column) -> Column:
    return F.when(which == 0, options[0]).otherwise(options[1])


def samples(events: DataFrame, candles: DataFrame, charts: DataFrame, seed: int | str = 42) -> DataFrame:
    """``symbol, start_idx, sample_type, request, explanation, eval, text, event_count, total_event_count``.

    One sample for each kind of event that the chart has, and one of all kinds in the order of time
    (at one candle: sweeps, gaps, shifts). ``charts`` has the charts' ``text``. Up to two events get
    full sentences, more get short ones. Candles count from 1 in what is shown.
    """
    e = top_gaps(events, last_candles(candles)).withColumns({"c": F.col("candle_idx") + 1, "s": F.col("swing_idx") + 1})
    e = e.withColumn("sample_type", F.explode(F.array(F.col("kind"), F.lit("synthesis"))))
    by = Window.partitionBy(*CHART, "sample_type")
    e = e.withColumns({"total_event_count": F.count("*").over(by), "event_count": F.count_if("shown").over(by)}).where("shown")
    e = e.withColumn("at", F.row_number().over(by.orderBy("candle_idx", "seq")))
    which = pick(seed, *CHART, "sample_type", "seq") % 2
    short = F.col("event_count") >= SHORT_FROM
    sentence = F.lit(None).cast("string")
    for kind, (full, brief) in SENTENCES.items():
        sentence = F.when(F.col("type") == kind, F.when(short, _choose(brief, which)).otherwise(_choose(full, which))).otherwise(sentence)
    prefix = F.when(F.col("event_count") > 1, F.concat(F.lit("E"), F.col("at").cast("string"), F.lit("_"))).otherwise("")
    fields = F.lit(None).cast("string")
    for kind, names in FIELDS.items():
        line = F.concat_ws(" ", *(F.concat(prefix, F.lit(f"{key}="), F.col(col).cast("string")) for key, col in names))
        fields = F.when(F.col("kind") == kind, line).otherwise(fields)
    e = e.withColumns({"sentence": _fill(sentence), "fields": fields})
    ordered = F.array_sort(F.collect_list(F.struct("at", "sentence", "fields")))
    g = e.groupBy(*CHART, "sample_type", "event_count", "total_event_count").agg(ordered.alias("rows"))
    asked = F.lit(None).cast("string")
    for kind, options in REQUESTS.items():
        asked = F.when(F.col("sample_type") == kind, _choose(options, pick(seed, *CHART, "sample_type") % 2)).otherwise(asked)
    g = g.withColumns({"request": asked, "explanation": F.array_join(F.transform("rows", lambda r: r["sentence"]), " "), "eval": F.concat(F.lit("<eval>"), F.array_join(F.transform("rows", lambda r: r["fields"]), " "), F.lit("</eval>"))})
    g = g.join(charts.select(*CHART, F.col("text").alias("chart")), list(CHART))
    return g.select(*CHART, "sample_type", "request", "explanation", "eval", F.concat_ws("\n", "chart", "request", "explanation", "eval").alias("text"), "event_count", "total_event_count")


def slices(charts: DataFrame, length: int = 20, count: int = 4, seed: int | str = 42) -> DataFrame:
    """Sub-charts of ``length`` candles at hashed places: ``symbol, start_idx`` (of the slice: chart times ten and its number), ``source_idx, lo, hi, candles``.

    ``charts`` has ``candles`` arrays. A shorter chart is one slice, whole.
    """
    n = F.size("candles")
    k = F.explode(F.when(n < length, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(count - 1)))).alias("k")
    s = charts.select("symbol", F.col("start_idx").alias("source_idx"), "candles", n.alias("n"), k)
    lo = F.when(F.col("n") < length, 0).otherwise(pick(seed, "symbol", "source_idx", "k") % (F.col("n") - length + 1)).cast("int")
    s = s.withColumn("lo", lo).withColumn("hi", F.least(F.col("lo") + length, F.col("n")))
    return s.select("symbol", (F.col("source_idx") * 10 + F.col("k")).alias("start_idx"), "source_idx", "lo", "hi", F.slice("candles", F.col("lo") + 1, F.col("hi") - F.col("lo")).alias("candles"))


def without_overlaps(spans: DataFrame, keys: tuple[str, ...], order: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Spans ``[lo, hi)`` of each group that overlap no span kept before them, in order: a fold over a group's few spans."""
    g = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(lo).cast("long").alias("lo"), F.col(hi).cast("long").alias("hi")))).alias("all"))
    kind = dict(g.dtypes)["all"]
    clear = lambda kept, x: ~F.exists(kept, lambda k: (k["lo"] < x["hi"]) & (x["lo"] < k["hi"]))
    kept = F.aggregate("all", F.array().cast(kind), lambda acc, x: F.when(clear(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return g.select(*keys, F.explode(kept).alias("k")).select(*keys, F.col("k.o").alias(order), F.col("k.lo").alias(lo), F.col("k.hi").alias(hi))
