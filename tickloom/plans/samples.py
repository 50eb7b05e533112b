"""Queries over events: statistics, samples and their validation, trade simulation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import codec
from tickloom.functions.hashing import pick_sql
from tickloom.operators import detect as D
from tickloom.operators import render as R
from tickloom.operators import series as S
from tickloom.operators import simulate as T
from tickloom.operators import stats as A
from tickloom.operators import validate as V
from tickloom.sources.sinks import materialised

from . import sql as Q
from .market import candles, ranged
from .registry import register


def _quantiles(value: str, at: tuple[int, ...], prefix: str = "p") -> str:
    return ", ".join(f"round(quantile_cont({value}, {k / 100})::DOUBLE, 6) AS {prefix}{k}" for k in at)


P7 = (10, 25, 50, 75, 90, 95, 99)


def _swings(size: int, kind: str) -> str:
    x, cmp, f = ("h", "max", "greatest") if kind == "high" else ("l", "min", "least")
    prom = "h - oo" if kind == "high" else "oo - l"
    return f"""SELECT symbol, start_idx, {size} AS win, '{kind}' AS kind, i, {prom} AS prominence FROM (SELECT *, {f}({cmp}({x}) OVER ({Q.CW} ROWS BETWEEN {size} PRECEDING AND 1 PRECEDING), {cmp}({x}) OVER ({Q.CW} ROWS BETWEEN 1 FOLLOWING AND {size} FOLLOWING)) AS oo,
      count(*) OVER (PARTITION BY symbol, start_idx) AS n FROM candles) WHERE i >= {size} AND i + {size} < n AND {'h >= oo' if kind == 'high' else 'l <= oo'}"""


@register(
    "a1_swing_stats",
    Q.query(
        f"""{Q.candles()}, m0 AS ({' UNION ALL '.join(_swings(w, k) for w in (1, 2, 3, 5) for k in ('high', 'low'))}),
        m AS (SELECT *, i - lag(i) OVER (PARTITION BY symbol, start_idx, win, kind ORDER BY i) AS gap FROM m0)""",
        f"SELECT win::BIGINT AS win, kind, count(*)::BIGINT AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM candles), 6) AS pct, quantile_cont(gap, 0.5)::DOUBLE AS gap_p50, {_quantiles('prominence', P7, 'prominence_p')} FROM m GROUP BY win, kind",
    ),
)
def _(spark, d):
    return A.swing_report(materialised(candles(spark, d)))


def _sweeps(lookback: int) -> str:
    ctes = Q.near(2, lookback) + ", " + Q.SWEEPS
    return f"(WITH RECURSIVE {ctes} SELECT {lookback} AS lookback, type, depth FROM sweeps)"


@register(
    "a2_sweep_stats",
    f"""WITH s AS ({' UNION ALL '.join(f'SELECT * FROM {_sweeps(k)}' for k in (5, 10, 15, 20))}), t AS (SELECT count(*) AS total FROM (WITH RECURSIVE {Q.candles()} SELECT * FROM candles))
    SELECT lookback::BIGINT AS lookback, type, count(*)::BIGINT AS n, {_quantiles('depth', P7)}, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY lookback), 6) AS share, round(count(*) * 100.0::DOUBLE / any_value(total), 6) AS pct FROM s, t GROUP BY lookback, type""",
)
def _(spark, d):
    return A.sweep_report(candles(spark, d))


_BREAKS = f"""{Q.near()}, {Q.shifts('BULL', 'bull')}, {Q.shifts('BEAR', 'bear')}, sh AS (SELECT 'BULL' AS trend, * FROM bull UNION ALL SELECT 'BEAR', * FROM bear),
brk AS (SELECT sh.*, abs(c - swing_level) AS distance FROM sh JOIN candles USING (symbol, start_idx, i))"""


@register("a3_shift_stats", Q.query(_BREAKS, f"SELECT trend, type, count(*)::BIGINT AS n, {_quantiles('distance', P7)}, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM candles), 6) AS pct FROM brk GROUP BY trend, type"))
def _(spark, d):
    return A.shift_report(candles(spark, d))


@register(
    "a4_run_lengths",
    Q.query(
        f"""{_BREAKS}, marked AS (SELECT *, sum((type = 'CHoCH')::INT) OVER (PARTITION BY symbol, start_idx, trend ORDER BY i) - (type = 'CHoCH')::INT AS run FROM sh),
        runs AS (SELECT trend, count(*) FILTER (type = 'BOS') AS length, bool_or(type = 'CHoCH') AS closed FROM marked GROUP BY symbol, start_idx, trend, run)""",
        "SELECT trend, length::BIGINT AS length, count(*)::BIGINT AS n FROM runs WHERE closed OR length > 0 GROUP BY trend, length",
    ),
)
def _(spark, d):
    runs = A.run_lengths(A.shift_breaks(candles(spark, d)))
    return runs.groupBy("trend", "length").agg(F.count("*").alias("n"))


_P5 = (1, 5, 10, 25, 50, 75, 90)


@register("a5_gap_sizes", Q.query(f"{Q.candles()}, {Q.GAPS}", f"SELECT type, count(*)::BIGINT AS n, {_quantiles('gap_size', _P5)} FROM graded GROUP BY type"))
def _(spark, d):
    return A.percentiles(D.gaps(candles(spark, d)), ("type",), "gap_size", _P5)


@register("a6_body_percentiles", Q.query(Q.candles(), f"SELECT symbol, count(*)::BIGINT AS n, {_quantiles('abs(c - o)', (50, 75, 90, 95, 99))} FROM candles GROUP BY symbol"))
def _(spark, d):
    return A.percentiles(candles(spark, d).withColumn("body", F.abs(F.col("c") - F.col("o"))), ("symbol",), "body", (50, 75, 90, 95, 99))


SHOWN = f"""lastc AS (SELECT symbol, start_idx, count(*) AS n, max_by(c, i) AS close_last FROM candles GROUP BY 1, 2),
ranked AS (SELECT f.*, row_number() OVER (PARTITION BY symbol, start_idx, kind ORDER BY abs((gap_low + gap_high) / 2.0::DOUBLE - close_last), seq) AS pr, row_number() OVER (PARTITION BY symbol, start_idx, kind ORDER BY n - 1 - candle_idx, seq) AS tr FROM facts f JOIN lastc USING (symbol, start_idx)),
shown AS MATERIALIZED (SELECT *, kind <> 'gap' OR row_number() OVER (PARTITION BY symbol, start_idx, kind ORDER BY pr + tr, seq) <= {R.TOP_K} AS shown FROM ranked)"""


@register("o1_top_gaps", Q.query(f"{Q.events()}, {SHOWN}", "SELECT symbol, start_idx, seq::BIGINT AS seq, candle_idx::BIGINT AS candle_idx, gap_size::BIGINT AS gap_size FROM shown WHERE kind = 'gap' AND shown"))
def _(spark, d):
    k = candles(spark, d)
    return R.top_gaps(D.events(k, "BULL"), R.last_candles(k)).where("kind = 'gap' and shown").select("symbol", "start_idx", "seq", "candle_idx", "gap_size")


@register("o2_events_in_time", Q.query(Q.events(), "SELECT symbol, start_idx, row_number() OVER (PARTITION BY symbol, start_idx ORDER BY candle_idx, seq)::BIGINT AS at, kind, candle_idx::BIGINT AS candle_idx FROM facts"))
def _(spark, d):
    from pyspark.sql import Window

    e = D.events(candles(spark, d), "BULL")
    at = F.row_number().over(Window.partitionBy(*D.CHART).orderBy("candle_idx", "seq"))
    return e.select(*D.CHART, at.alias("at"), "kind", "candle_idx")


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sentence() -> str:
    out = "CASE"
    for kind, (full, short) in R.SENTENCES.items():
        for test, options in ((f"event_count >= {R.SHORT_FROM}", short), ("true", full)):
            out += f" WHEN type = '{kind}' AND {test} THEN CASE WHEN {pick_sql(42, 'symbol', 'start_idx', 'sample_type', 'seq')} % 2 = 0 THEN {_lit(options[0])} ELSE {_lit(options[1])} END"
    out += " END"
    for slot, col in (("{c}", "candle_idx + 1"), ("{s}", "swing_idx + 1"), ("{level}", "swing_level"), ("{depth}", "depth"), ("{size}", "gap_size"), ("{fill}", "fill_pct"), ("{dir}", "direction")):
        out = f"replace({out}, '{slot}', coalesce(({col})::VARCHAR, ''))"
    return out


def _fields() -> str:
    col = {"c": "candle_idx + 1", "s": "swing_idx + 1"}
    cases = []
    for kind, names in R.FIELDS.items():
        cases.append(f"WHEN kind = '{kind}' THEN " + " || ' ' || ".join(f"prefix || '{key}=' || ({col.get(c, c)})::VARCHAR" for key, c in names))
    return "CASE " + " ".join(cases) + " END"


def _requests() -> str:
    return "CASE " + " ".join(f"WHEN sample_type = '{k}' THEN CASE WHEN {pick_sql(42, 'symbol', 'start_idx', 'sample_type')} % 2 = 0 THEN {_lit(a)} ELSE {_lit(b)} END" for k, (a, b) in R.REQUESTS.items()) + " END"


_SAMPLES = f"""{SHOWN}, charts AS (SELECT symbol, start_idx, '<chart> ' || string_agg(format('O_{{}} H_{{}} L_{{}} C_{{}}', o, h, l, c), ' ' ORDER BY i) || ' </chart>' AS chart FROM candles GROUP BY 1, 2),
typed AS (SELECT *, kind AS sample_type FROM shown UNION ALL SELECT *, 'synthesis' FROM shown),
counted AS (SELECT *, count(*) OVER w AS total_event_count, count(*) FILTER (shown) OVER w AS event_count FROM typed WINDOW w AS (PARTITION BY symbol, start_idx, sample_type)),
placed AS (SELECT *, row_number() OVER (PARTITION BY symbol, start_idx, sample_type ORDER BY candle_idx, seq) AS place FROM counted WHERE shown),
told AS (SELECT *, CASE WHEN event_count > 1 THEN 'E' || place || '_' ELSE '' END AS prefix, {_sentence()} AS sentence FROM placed),
grouped AS (SELECT symbol, start_idx, sample_type, event_count, total_event_count, {_requests()} AS request, string_agg(sentence, ' ' ORDER BY place) AS explanation, '<eval>' || string_agg({_fields()}, ' ' ORDER BY place) || '</eval>' AS eval FROM told GROUP BY ALL),
samples AS MATERIALIZED (SELECT g.*, chart || chr(10) || request || chr(10) || explanation || chr(10) || eval AS text FROM grouped g JOIN charts USING (symbol, start_idx))"""
SAMPLES = f"{Q.events()}, {_SAMPLES}"


#: Events that a task makes samples of: their number of tasks grows with the table, and no task's memory does.
EVENTS_A_TASK = 1 << 16


def dealt(events):
    """Events written and dealt by charts to as many tasks as there are ``EVENTS_A_TASK`` of them."""
    e = materialised(events)
    return e.repartition(-(-e.count() // EVENTS_A_TASK) or 1, *D.CHART)


def samples(spark, d, trend: str = "BULL"):
    k = materialised(candles(spark, d))  # for the events, the ranks of gaps and the texts
    return R.samples(dealt(D.events(k, trend)), k, S.chart_texts(k))


@register("r1_sentences", Q.query(SAMPLES, "SELECT symbol, start_idx, sample_type, explanation FROM samples"))
def _(spark, d):
    return samples(spark, d).select("symbol", "start_idx", "sample_type", "explanation")


@register("r3_eval_blocks", Q.query(SAMPLES, "SELECT symbol, start_idx, sample_type, eval FROM samples"))
def _(spark, d):
    return samples(spark, d).select("symbol", "start_idx", "sample_type", "eval")


@register("r4_single_samples", Q.query(SAMPLES, "SELECT symbol, start_idx, sample_type, text, event_count::BIGINT AS event_count, total_event_count::BIGINT AS total_event_count FROM samples WHERE sample_type <> 'synthesis'"))
def _(spark, d):
    return samples(spark, d).where("sample_type <> 'synthesis'").select("symbol", "start_idx", "sample_type", "text", "event_count", "total_event_count")


@register("r5_synthesis_samples", Q.query(SAMPLES, "SELECT symbol, start_idx, text, event_count::BIGINT AS event_count, total_event_count::BIGINT AS total_event_count FROM samples WHERE sample_type = 'synthesis'"))
def _(spark, d):
    return samples(spark, d).where("sample_type = 'synthesis'").select("symbol", "start_idx", "text", "event_count", "total_event_count")


@register("r6_all_samples", Q.query(SAMPLES, "SELECT symbol, start_idx, sample_type, md5(text) AS digest, request FROM samples"))
def _(spark, d):
    return samples(spark, d).select("symbol", "start_idx", "sample_type", F.md5("text").alias("digest"), "request")


@register("p7_split_samples", Q.query(SAMPLES, "SELECT symbol, start_idx, sample_type, split_part(text, chr(10), 1) AS chart, request, explanation, eval FROM samples"))
def _(spark, d):
    p = V.split_sample(F.col("text"))
    return samples(spark, d).select("symbol", "start_idx", "sample_type", p.alias("p")).select("symbol", "start_idx", "sample_type", "p.*")


@register("p8_request_types", Q.query(SAMPLES, "SELECT sample_type AS type, count(*)::BIGINT AS n FROM samples WHERE length(text) % 7 > 0 GROUP BY 1 UNION ALL SELECT 'unknown', count(*) FROM samples WHERE length(text) % 7 = 0"))
def _(spark, d):
    asked = F.when(F.length("text") % 7 > 0, F.col("request")).otherwise(F.concat("request", F.lit("?")))
    return samples(spark, d).groupBy(V.request_type(asked).alias("type")).agg(F.count("*").alias("n"))


_EVENTS_OF = """fields AS MATERIALIZED (SELECT symbol, start_idx, sample_type, event_count, unnest(regexp_extract_all(eval, '(\\w+)=([^ <]+)')) AS pair FROM samples),
ev_fields AS MATERIALIZED (SELECT symbol, start_idx, sample_type, CASE WHEN event_count = 1 THEN 1 ELSE regexp_extract(pair, '^E(\\d+)_', 1)::BIGINT END AS event, regexp_replace(split_part(pair, '=', 1), '^E\\d+_', '') AS key, split_part(pair, '=', 2) AS value FROM fields)"""


@register("p10_eval_fields", Q.query(f"{SAMPLES}, {_EVENTS_OF}", "SELECT symbol, start_idx, sample_type, event, key, value FROM ev_fields"))
def _(spark, d):
    return V.event_fields(samples(spark, d)).select("symbol", "start_idx", "sample_type", "event", "key", "value")


@register("p11_events_of_samples", Q.query(f"{SAMPLES}, {_EVENTS_OF}", "SELECT symbol, start_idx, sample_type, event, count(*)::BIGINT AS n_fields, max(value) FILTER (key = 'T') AS type FROM ev_fields GROUP BY ALL"))
def _(spark, d):
    f = V.event_fields(samples(spark, d))
    return f.groupBy("symbol", "start_idx", "sample_type", "event").agg(F.count("*").alias("n_fields"), F.max(F.when(F.col("key") == "T", F.col("value"))).alias("type"))


@register("p13_event_modes", Q.query(SAMPLES, "SELECT sample_type, CASE WHEN event_count = 1 THEN 'single' ELSE 'multi' END AS mode, count(*)::BIGINT AS n FROM samples GROUP BY ALL"))
def _(spark, d):
    numbers = F.size(F.array_distinct(F.regexp_extract_all("eval", F.lit(r"\bE(\d+)_"), F.lit(1))))
    return samples(spark, d).groupBy("sample_type", F.when(numbers > 1, "multi").otherwise("single").alias("mode")).agg(F.count("*").alias("n"))


@register("j5_inconsistent_fields", Q.query(f"{SAMPLES}, {_EVENTS_OF}, t AS (SELECT symbol, start_idx, sample_type, event, max(value) FILTER (key = 'T') AS \"T\", max(value) FILTER (key = 'C') AS \"C\" FROM ev_fields GROUP BY ALL), v AS (SELECT f.*, \"T\", \"C\", CASE WHEN sample_type = 'synthesis' AND key IN ('D', 'GS') THEN value || '9' ELSE value END AS seen FROM ev_fields f JOIN t USING (symbol, start_idx, sample_type, event) WHERE key NOT IN ('T', 'C'))",
    "SELECT symbol, start_idx, \"T\", \"C\", key, count(*)::BIGINT AS n FROM (SELECT *, first_value(seen) OVER (PARTITION BY symbol, start_idx, \"T\", \"C\", key ORDER BY sample_type, event) AS f FROM v) WHERE seen <> f GROUP BY ALL"))
def _(spark, d):
    f = V.event_fields(samples(spark, d))
    wrong = (F.col("sample_type") == "synthesis") & F.col("key").isin("D", "GS")
    f = f.withColumn("value", F.when(wrong, F.concat("value", F.lit("9"))).otherwise(F.col("value")))  # a fault to be found
    return V.inconsistent_fields(f, ("symbol", "start_idx"), "sample_type")


@register("j6_leaks", Q.query(SAMPLES, "SELECT symbol, start_idx, sample_type, len(list_filter(regexp_extract_all(explanation || ' ' || (length(text) % 3 * 997), '\\d+(\\.\\d+)?'), lambda x: NOT list_contains(regexp_extract_all(eval, '\\d+(\\.\\d+)?'), x))) > 0 AS leak FROM samples"))
def _(spark, d):
    told = F.concat("explanation", F.lit(" "), (F.length("text") % 3 * 997).cast("string"))
    return samples(spark, d).select("symbol", "start_idx", "sample_type", V.leaks(told, F.col("eval")).alias("leak"))


#: Faults to be found: texts without their last mark, and a number in the explanation that no evaluation has.
_FAULTY = "faulty AS (SELECT *, CASE WHEN length(text) % 7 = 0 THEN 'unknown' ELSE sample_type END AS type, length(text) % 7 = 0 AS cut, length(text) % 7 <> 0 AND length(text) % 5 = 0 AS leak, CASE WHEN length(text) % 7 = 0 THEN length(text) - 7 WHEN length(text) % 5 = 0 THEN length(text) + 7 ELSE length(text) END AS size FROM samples)"


@register("a7_validation_report", Q.query(f"{SAMPLES}, {_FAULTY}", f"SELECT coalesce(type, 'ALL') AS type, count(*)::BIGINT AS n, count(*) FILTER (cut)::BIGINT AS unparsed, count(*) FILTER (leak)::BIGINT AS leaking, {_quantiles('size', (50, 90, 99), 'length_p')}, round(count(*) FILTER (size > 512) * 100.0::DOUBLE / count(*), 6) AS over_pct FROM faulty GROUP BY ROLLUP (type)"))
def _(spark, d):
    n = F.length("text")
    cut = F.substr(F.col("text"), F.lit(1), n - 7)
    text = F.when(n % 7 == 0, cut).when(n % 5 == 0, F.replace(F.col("text"), F.lit("\n<eval>"), F.lit(" 987654\n<eval>"))).otherwise(F.col("text"))
    return V.report(samples(spark, d).withColumn("text", text).withColumn("token_length", F.length("text")))


@register("a8_sample_groups", Q.query(SAMPLES, "SELECT symbol, start_idx, count(*)::BIGINT AS n, sum(event_count)::BIGINT AS events FROM samples GROUP BY ALL"))
def _(spark, d):
    return samples(spark, d).groupBy("symbol", "start_idx").agg(F.count("*").alias("n"), F.sum("event_count").alias("events"))


_SLICE = f"{pick_sql(42, 'symbol', 'start_idx', 'k')} % 81"
SLICES = f"""{Q.candles(100, 10, 100)}, ks AS (SELECT unnest([0, 1, 2, 3]) AS k), sl AS (SELECT DISTINCT symbol, start_idx, k, {_SLICE} AS lo FROM candles, ks)"""


@register("o8_slices", Q.query(SLICES, "SELECT symbol, start_idx * 10 + k AS start_idx, lo::BIGINT AS lo, lo::BIGINT + 20 AS hi, string_agg(c::VARCHAR, ' ' ORDER BY i) AS closes FROM sl JOIN candles USING (symbol, start_idx) WHERE i >= lo AND i < lo + 20 GROUP BY symbol, start_idx, k, lo"))
def _(spark, d):
    return long_slices(spark, d).select("symbol", "start_idx", "lo", "hi", F.array_join(F.transform("candles", lambda c: c["c"].cast("string")), " ").alias("closes"))


@register(
    "j8_disjoint_slices",
    Q.query(
        f"""{SLICES}, keep(symbol, start_idx, k, kept) AS (SELECT symbol, start_idx, 0, [lo] FROM sl WHERE k = 0 UNION ALL SELECT s.symbol, s.start_idx, s.k, CASE WHEN len(list_filter(kept, lambda x: x < s.lo + 20 AND s.lo < x + 20)) = 0 THEN list_append(kept, s.lo) ELSE kept END
        FROM keep p JOIN sl s ON s.symbol = p.symbol AND s.start_idx = p.start_idx AND s.k = p.k + 1)""",
        "SELECT symbol, start_idx AS source_idx, unnest(kept)::BIGINT AS lo FROM keep WHERE k = 3",
    ),
)
def _(spark, d):
    s = long_slices(spark, d).withColumn("k", F.col("start_idx") % 10)
    return R.without_overlaps(s, ("symbol", "source_idx"), "k").select("symbol", "source_idx", "lo")


def long_slices(spark, d):
    texts = S.chart_dataset(ranged(spark, d, 100), 100, 10, 100, Q.SCALE)
    return R.slices(texts.select("symbol", "start_idx", codec.parse_candles(F.col("text")).alias("candles")))


def corpus(spark, d):
    """Sliced charts, both trends, all samples: rows of the corpus schema."""
    s = materialised(long_slices(spark, d))
    k = materialised(s.select("symbol", "start_idx", F.posexplode("candles").alias("i", "x")).select("symbol", "start_idx", "i", "x.*"))
    texts = s.select("symbol", "start_idx", codec.chart_text(F.col("candles")).alias("text"))
    shared = tuple(map(materialised, D.trendless(k)))
    both = R.samples(dealt(D.events(k, "BULL", shared=shared)), k, texts).unionByName(R.samples(dealt(D.events(k, "BEAR", shared=shared)), k, texts))
    rows = both.join(s.select("symbol", "start_idx", "source_idx", "lo", "hi"), ["symbol", "start_idx"])
    meta = F.to_json(F.struct(F.col("source_idx").alias("chart_index"), F.array("lo", "hi").alias("sub_range"), "sample_type"))
    return rows.select("text", F.col("request").alias("source"), F.length("text").cast("long").alias("token_length"), meta.alias("meta"))


_SLICED = f"""candles AS MATERIALIZED (WITH RECURSIVE {SLICES} SELECT symbol, start_idx * 10 + k AS start_idx, start_idx AS source_idx, lo, CAST(i - lo AS INTEGER) AS i, o, h, l, c FROM sl JOIN candles USING (symbol, start_idx) WHERE i >= lo AND i < lo + 20)"""


def _corpus_sql(trend: str) -> str:
    meta = "'{\"chart_index\":' || source_idx || ',\"sub_range\":[' || lo || ',' || (lo + 20) || '],\"sample_type\":\"' || sample_type || '\"}'"
    places = "(SELECT DISTINCT symbol, start_idx, source_idx, lo FROM candles)"
    return f"(WITH RECURSIVE {Q.events(trend, _SLICED)}, {_SAMPLES} SELECT text, request AS source, length(text)::BIGINT AS token_length, {meta} AS meta FROM samples JOIN {places} USING (symbol, start_idx))"


@register("r7_sample_corpus", f"SELECT * FROM {_corpus_sql('BULL')} UNION ALL SELECT * FROM {_corpus_sql('BEAR')}")
def _(spark, d):
    return corpus(spark, d)


@register("p9_meta_json", "SELECT event_type, json_valid(props) AS ok, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def _(spark, d):
    from .registry import table

    e = table(spark, d, "events")
    return e.groupBy("event_type", F.coalesce(F.try_parse_json("props").isNotNull(), F.lit(False)).alias("ok")).agg(F.count("*").alias("n"))


FWD = 60
TRADES = f"""{Q.wins(20, 10, 14, FWD)}, fw AS MATERIALIZED (SELECT symbol, start_idx, i - 19 AS k, {Q.binned('open')} AS o, {Q.binned('high')} AS h, {Q.binned('low')} AS l, {Q.binned('close')} AS c FROM wins WHERE i >= 20),
setups AS (SELECT side, sign, sl, tp FROM (VALUES ('long', 1), ('short', -1)) a(side, sign), (VALUES (-20), (-40), (-60), (-80)) b(sl), (VALUES (40), (80), (120), (160)) c(tp) WHERE tp >= -sl),
tr AS MATERIALIZED (SELECT w.symbol, w.start_idx, side, sign, sl, tp, entry + sign * 2 AS e, entry + sign * 2 + sign * sl AS stop, entry + sign * 2 + sign * tp AS target FROM (SELECT symbol, start_idx, o AS entry FROM fw WHERE k = 1) w, setups),
hits AS (SELECT t.*, k_sl, k_tp, last_c FROM tr t JOIN (SELECT t.symbol, t.start_idx, side, sl, tp, min(k) FILTER (CASE WHEN sign = 1 THEN l <= stop ELSE h >= stop END) AS k_sl, min(k) FILTER (CASE WHEN sign = 1 THEN h >= target ELSE l <= target END) AS k_tp, max_by(c, k) AS last_c
  FROM tr t JOIN fw USING (symbol, start_idx) GROUP BY ALL) USING (symbol, start_idx, side, sl, tp)),
ends AS (SELECT *, CASE WHEN k_sl IS NULL AND k_tp IS NULL THEN 'timeout' WHEN k_tp IS NULL OR k_sl <= k_tp THEN 'sl_hit' ELSE 'tp_hit' END AS exit_type, coalesce(least(k_sl, k_tp), {FWD}) AS candle_exit FROM hits),
outs AS (SELECT n.symbol, n.start_idx, side, sl, tp, exit_type, candle_exit, any_value(sign * (CASE exit_type WHEN 'timeout' THEN last_c WHEN 'sl_hit' THEN stop ELSE target END - e)) AS pnl_bins,
  least(0, min(CASE WHEN sign = 1 THEN l - e ELSE e - h END)) AS max_dd_bins FROM ends n JOIN fw f ON f.symbol = n.symbol AND f.start_idx = n.start_idx AND f.k <= n.candle_exit GROUP BY ALL),
trades AS MATERIALIZED (SELECT *, CASE exit_type WHEN 'sl_hit' THEN 0.0::DOUBLE WHEN 'timeout' THEN CASE WHEN pnl_bins > 0 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END ELSE
  round_even(least(5.0::DOUBLE + (1.0::DOUBLE - candle_exit / {FWD}.0::DOUBLE) * 2.5 + greatest(1.0::DOUBLE - abs(max_dd_bins) / 80.0::DOUBLE, 0) * 2.5, 10), 1) END AS score FROM outs)"""


def trades(spark, d, windows=None):
    w = S.windows(ranged(spark, d), 20, 10, FWD) if windows is None else windows
    return T.simulate(T.forward_bins(w, 20, Q.SCALE), FWD)


@register("t1_trades", Q.query(TRADES, "SELECT symbol, start_idx, side, sl::BIGINT AS sl, tp::BIGINT AS tp, exit_type, candle_exit::BIGINT AS candle_exit, pnl_bins::BIGINT AS pnl_bins, max_dd_bins::BIGINT AS max_dd_bins FROM trades"))
def _(spark, d):
    return trades(spark, d).drop("score")


@register("t2_scores", Q.query(TRADES, "SELECT symbol, start_idx, side, sl::BIGINT AS sl, tp::BIGINT AS tp, score FROM trades"))
def _(spark, d):
    return trades(spark, d).select("symbol", "start_idx", "side", "sl", "tp", "score")


TRADE_TEXTS = f"""{TRADES}, tc AS (SELECT symbol, start_idx, '<chart> ' || string_agg(format('O_{{}} H_{{}} L_{{}} C_{{}}', {Q.binned('open')}, {Q.binned('high')}, {Q.binned('low')}, {Q.binned('close')}), ' ' ORDER BY i) || ' </chart>' AS chart FROM wins WHERE i < 20 GROUP BY 1, 2),
acts AS (SELECT * FROM (VALUES ('long', 'buy_25'), ('long', 'buy_50'), ('long', 'buy_100'), ('short', 'sell_25'), ('short', 'sell_50'), ('short', 'sell_100')) x(side, action)),
texts AS MATERIALIZED (SELECT symbol, start_idx, action, sl, tp, exit_type, chart || chr(10) || '<action>' || action || '</action>' || chr(10) || '<sl>' || sl || '</sl>' || chr(10) || '<tp>' || tp || '</tp>' || chr(10) || '<result>' || exit_type || ' | candle:' || candle_exit
  || ' | pnl_bins:' || CASE WHEN pnl_bins >= 0 THEN '+' ELSE '' END || pnl_bins || ' | max_dd_bins:' || CASE WHEN max_dd_bins >= 0 THEN '+' ELSE '' END || max_dd_bins || ' | score:' || score::VARCHAR || '</result>' AS text FROM trades JOIN acts USING (side) JOIN tc USING (symbol, start_idx))"""


def trade_texts(spark, d):
    w = materialised(S.windows(ranged(spark, d), 20, 10, FWD))  # for the trades and for the texts
    texts = w.where("i < 20").groupBy("symbol", "start_idx")
    bins = F.struct("i", *(codec.to_bin(F.col(p), F.col("anchor_open"), F.col("anchor_atr"), Q.SCALE).alias(p[0]) for p in S.PRICES))
    texts = texts.agg(codec.chart_text(F.array_sort(F.collect_list(bins))).alias("text"))
    return T.trade_samples(T.with_actions(trades(spark, d, w)), texts)


@register("t3_trade_samples", Q.query(TRADE_TEXTS, "SELECT symbol, start_idx, action, sl::BIGINT AS sl, tp::BIGINT AS tp, md5(text) AS digest, text[strpos(text, '<result>'):] AS result FROM texts"))
def _(spark, d):
    t = trade_texts(spark, d)
    return t.select("symbol", "start_idx", "action", "sl", "tp", F.md5("text").alias("digest"), F.expr("substring(text, locate('<result>', text))").alias("result"))


@register("t4_trade_counts", Q.query(TRADE_TEXTS, "SELECT symbol, start_idx, count(*)::BIGINT AS n, count(DISTINCT sl || '|' || tp)::BIGINT AS setups FROM texts GROUP BY ALL"))
def _(spark, d):
    return trade_texts(spark, d).groupBy("symbol", "start_idx").agg(F.count("*").alias("n"), F.count_distinct(F.concat_ws("|", "sl", "tp")).alias("setups"))


_BALANCED = f"""{TRADE_TEXTS}, h AS (SELECT *, row_number() OVER (PARTITION BY exit_type ORDER BY {pick_sql(42, 'symbol', 'start_idx', 'action', 'sl', 'tp')}, symbol, start_idx, action, sl, tp) AS rank FROM texts),
b AS (SELECT * FROM h WHERE rank <= (SELECT min(n) FROM (SELECT count(*) AS n FROM texts GROUP BY exit_type)))"""


@register("t5_balanced_trades", Q.query(_BALANCED, "SELECT symbol, start_idx, action, sl::BIGINT AS sl, tp::BIGINT AS tp, exit_type, rank::BIGINT AS rank FROM b"))
def _(spark, d):
    rows = materialised(T.with_actions(trades(spark, d)).select("symbol", "start_idx", "action", "sl", "tp", "exit_type"))  # texts can be joined to those that are chosen
    return T.balance(rows, "exit_type", ("symbol", "start_idx", "action", "sl", "tp"))


@register("t6_exit_distribution", Q.query(TRADE_TEXTS, "SELECT exit_type, count(*)::BIGINT AS n, round_even(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS pct FROM texts GROUP BY exit_type"))
def _(spark, d):
    return T.exit_distribution(trade_texts(spark, d))


@register("p18_exit_types", Q.query(TRADE_TEXTS, "SELECT exit_type, split_part(split_part(text, 'score:', 2), '<', 1) AS score, count(*)::BIGINT AS n FROM texts GROUP BY ALL"))
def _(spark, d):
    t = trade_texts(spark, d)
    return t.groupBy(T.exit_type(F.col("text")).alias("exit_type"), F.regexp_extract("text", "score:([^<]*)</result>", 1).alias("score")).agg(F.count("*").alias("n"))


@register("j3_trade_setups", "SELECT action, sl::BIGINT AS sl, tp::BIGINT AS tp FROM (VALUES ('buy_25'), ('buy_50'), ('buy_100'), ('sell_25'), ('sell_50'), ('sell_100')) a(action), (VALUES (-20), (-40), (-60), (-80)) b(sl), (VALUES (40), (80), (120), (160)) c(tp) WHERE tp > -sl")
def _(spark, d):
    return spark.createDataFrame([(a, s, t) for a in T.ACTIONS for s, t in T.setups(strict=True)], "action string, sl long, tp long")
