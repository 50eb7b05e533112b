"""Queries over bars and charts: the codec, the detectors, events and their relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import candles as C
from tickloom.functions import codec
from tickloom.operators import detect as D
from tickloom.operators import long_scan as L
from tickloom.operators import series as S

from . import sql as Q
from .registry import register, table


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bars_from_events(table(spark, sf_dir, "events"))


def ranged(spark: SparkSession, sf_dir: str, period: int = Q.PERIOD) -> DataFrame:
    return S.with_atr(bars(spark, sf_dir), period)


def wins(spark: SparkSession, sf_dir: str, window: int = Q.WINDOW, stride: int = Q.STRIDE, period: int = Q.PERIOD) -> DataFrame:
    return S.windows(ranged(spark, sf_dir, period), window, stride)


def candles(spark: SparkSession, sf_dir: str, **sizes: int) -> DataFrame:
    return S.candles(wins(spark, sf_dir, **sizes), Q.SCALE)


def near(spark: SparkSession, sf_dir: str, window: int = 2, lookback: int = 10) -> DataFrame:
    return D.with_nearest_swings(D.with_swings(candles(spark, sf_dir), window), lookback)


def charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charts as texts, of the standard windows."""
    return S.chart_dataset(ranged(spark, sf_dir), Q.WINDOW, Q.STRIDE, Q.PERIOD, Q.SCALE)


TEXTS = f"""{Q.candles()}, charts AS MATERIALIZED (SELECT symbol, start_idx, '<chart> ' || string_agg(format('O_{{}} H_{{}} L_{{}} C_{{}}', o, h, l, c), ' ' ORDER BY i) || ' </chart>' AS text FROM candles GROUP BY 1, 2)"""


@register("n1_true_range", Q.query(Q.BARS, "SELECT symbol, idx, round(tr, 6) AS tr FROM trs"))
def _(spark, d):
    return S.with_true_range(bars(spark, d)).select("symbol", "idx", "tr")


@register("n2_atr", Q.query(Q.atr(), "SELECT symbol, idx, round(atr, 6) AS atr FROM abars"))
def _(spark, d):
    return ranged(spark, d).select("symbol", "idx", "atr")


@register("n2_atr_100", Q.query(Q.atr(100), "SELECT symbol, idx, round(atr, 6) AS atr FROM abars"))
def _(spark, d):
    return ranged(spark, d, 100).select("symbol", "idx", "atr")


@register("n3_price_bins", Q.query(Q.candles(), "SELECT symbol, start_idx, i::BIGINT AS i, o::BIGINT AS o, h::BIGINT AS h, l::BIGINT AS l, c::BIGINT AS c FROM candles"))
def _(spark, d):
    return candles(spark, d)


_P = "(c::DOUBLE / 1023 * 2 - 1) * 12.0::DOUBLE * anchor_atr + anchor_open"


@register("n4_bin_prices", Q.query(Q.candles(), f"SELECT symbol, start_idx, i::BIGINT AS i, round({_P}, 6) AS price FROM candles JOIN starts USING (symbol, start_idx)"))
def _(spark, d):
    w = wins(spark, d)
    price = codec.to_price(codec.to_bin(F.col("close"), F.col("anchor_open"), F.col("anchor_atr"), Q.SCALE), F.col("anchor_open"), F.col("anchor_atr"), Q.SCALE)
    return w.select("symbol", "start_idx", "i", price.alias("price"))


@register("n5_chart_texts", Q.query(TEXTS, "SELECT symbol, start_idx, start_idx + 19 AS end_idx, round(anchor_open, 6) AS anchor_open, round(anchor_atr, 6) AS anchor_atr, text FROM charts JOIN starts USING (symbol, start_idx)"))
def _(spark, d):
    return charts(spark, d)


@register("n6_decoded_windows", Q.query(Q.candles(), f"SELECT symbol, start_idx, i::BIGINT AS i, round({_P}, 6) AS close FROM candles JOIN starts USING (symbol, start_idx)"))
def _(spark, d):
    back = codec.decode_window(F.col("text"), F.col("anchor_open"), F.col("anchor_atr"), Q.SCALE)
    return charts(spark, d).select("symbol", "start_idx", F.posexplode(back).alias("i", "p")).select("symbol", "start_idx", "i", F.col("p.c").alias("close"))


@register("n7_windows", Q.query(Q.wins(100, 10, 100), "SELECT symbol, start_idx, count(*)::BIGINT AS n, round(min(low), 6) AS low, round(max(high), 6) AS high, round(any_value(anchor_atr), 6) AS anchor_atr FROM wins GROUP BY 1, 2"))
def _(spark, d):
    return wins(spark, d, 100, 10, 100).groupBy("symbol", "start_idx").agg(F.count("*").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("anchor_atr").alias("anchor_atr"))


@register(
    "n8_forward_ranges",
    Q.query(
        f"""{Q.atr()}, m AS (SELECT symbol, {Q.binned('top', 'open', 'atr')} - {Q.binned('bottom', 'open', 'atr')} AS move FROM (SELECT *, max(high) OVER w AS top, min(low) OVER w AS bottom,
        count(*) OVER (PARTITION BY symbol) AS n FROM abars WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN CURRENT ROW AND 59 FOLLOWING)) WHERE idx >= 20 AND idx < n - 60 AND (idx - 20) % 10 = 0 AND atr > 0)""",
        "SELECT symbol, round(avg(move), 6) AS mean, quantile_cont(move, 0.5)::DOUBLE AS median, quantile_cont(move, 0.25)::DOUBLE AS p25, quantile_cont(move, 0.75)::DOUBLE AS p75 FROM m GROUP BY 1",
    ),
)
def _(spark, d):
    return S.range_report(S.forward_moves(ranged(spark, d), 20, 60, 10, Q.SCALE))


_DROP = "re AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY idx) - 1 AS idx, open, high, low, close, tr, atr FROM abars WHERE atr IS NOT NULL AND tr IS NOT NULL)"


@register(
    "n9_scale_factors",
    Q.query(
        f"""{Q.atr(100)}, {_DROP}, r AS (SELECT symbol, idx, greatest(max(greatest(open, high, low, close)) OVER w - open, open - min(least(open, high, low, close)) OVER w) / atr AS ratio FROM re
        WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))""",
        "SELECT symbol, round(quantile_cont(ratio, 0.999), 6) AS scale FROM r WHERE idx >= 1 GROUP BY 1",
    ),
)
def _(spark, d):
    return S.scale_factors(ranged(spark, d, 100))


@register("n10_reindexed", Q.query(f"{Q.atr()}, {_DROP}", "SELECT symbol, idx, round(close, 6) AS close, round(atr, 6) AS atr FROM re"))
def _(spark, d):
    return S.drop_null_and_reindex(ranged(spark, d)).select("symbol", "idx", "close", "atr")


_SCALES = [("click", "M1", 12.0), ("view", "M1", 10.0), ("purchase", "M1", 14.0), ("signup", "M1", 8.0)]


@register(
    "n11_scale_lookup",
    Q.query(
        f"{Q.wins()}, t(symbol, scale) AS (VALUES {', '.join(f'({s!r}, {x}::DOUBLE)' for s, _, x in _SCALES)})",
        f"""SELECT symbol, start_idx, i::BIGINT AS i, CAST(round_even((greatest(least((close - anchor_open) / (coalesce(t.scale, 24.0::DOUBLE) * anchor_atr), 1.0::DOUBLE), -1.0::DOUBLE) + 1) / 2 * 1023, 0) AS BIGINT) AS c
        FROM wins LEFT JOIN t USING (symbol)""",
    ),
)
def _(spark, d):
    scales = spark.createDataFrame([(s, x) for s, _, x in _SCALES], "symbol string, scale double")  # a literal table
    w = wins(spark, d).join(F.broadcast(scales), "symbol", "left")
    return w.select("symbol", "start_idx", "i", codec.to_bin(F.col("close"), F.col("anchor_open"), F.col("anchor_atr"), F.coalesce("scale", F.lit(S.DEFAULT_SCALE))).alias("c"))


@register("n12_round_trip_error", Q.query(Q.candles(), f"SELECT symbol, round(max(abs({_P} - close) / anchor_atr), 6) AS worst, count(*)::BIGINT AS n FROM candles JOIN wins USING (symbol, start_idx, i) WHERE abs(close - anchor_open) <= 12 * anchor_atr GROUP BY 1"))
def _(spark, d):
    w = wins(spark, d)
    price = codec.to_price(codec.to_bin(F.col("close"), F.col("anchor_open"), F.col("anchor_atr"), Q.SCALE), F.col("anchor_open"), F.col("anchor_atr"), Q.SCALE)
    inside = F.abs(F.col("close") - F.col("anchor_open")) <= Q.SCALE * F.col("anchor_atr")
    return w.where(inside).groupBy("symbol").agg(F.max(F.abs(price - F.col("close")) / F.col("anchor_atr")).alias("worst"), F.count("*").alias("n"))


_CANDLE = "SELECT symbol, start_idx, i::BIGINT AS i, abs(c - o)::BIGINT AS body, CASE WHEN h = l THEN 1 ELSE h - l END::BIGINT AS span, (h - greatest(o, c))::BIGINT AS upper_wick, (least(o, c) - l)::BIGINT AS lower_wick FROM candles"


@register("p1_parsed_candles", Q.query(Q.candles(), "SELECT symbol, start_idx, i::BIGINT AS i, o::BIGINT AS o, h::BIGINT AS h, l::BIGINT AS l, c::BIGINT AS c FROM candles"))
def _(spark, d):
    return charts(spark, d).select("symbol", "start_idx", F.posexplode(codec.parse_candles(F.col("text"))).alias("i", "k")).select("symbol", "start_idx", "i", "k.*")


@register("p1_malformed_candles", Q.query(TEXTS, "SELECT symbol, start_idx, len(regexp_extract_all(replace(text, 'C_5', 'X_5'), 'O_(\\d+)\\s+H_(\\d+)\\s+L_(\\d+)\\s+C_(\\d+)'))::BIGINT AS n FROM charts"))
def _(spark, d):
    broken = F.replace(F.col("text"), F.lit("C_5"), F.lit("X_5"))
    return charts(spark, d).select("symbol", "start_idx", F.size(codec.parse_candles(broken)).alias("n"))


@register("p2_rebuilt_texts", Q.query(TEXTS, "SELECT symbol, start_idx, text, regexp_replace(text, '([OHLC]_\\d+)', '<px_\\1>', 'g') AS pixel FROM charts"))
def _(spark, d):
    k = codec.parse_candles(F.col("text"))
    return charts(spark, d).select("symbol", "start_idx", codec.chart_text(k).alias("text"), codec.chart_text(k, pixel=True).alias("pixel"))


@register("p3_slices", Q.query(Q.candles(), "SELECT symbol, start_idx, '<chart> ' || string_agg(format('O_{} H_{} L_{} C_{}', o, h, l, c), ' ' ORDER BY i) || ' </chart>' AS text FROM candles WHERE i >= 5 AND i < 12 GROUP BY 1, 2"))
def _(spark, d):
    return charts(spark, d).select("symbol", "start_idx", codec.chart_text(codec.slice_candles(codec.parse_candles(F.col("text")), 5, 12)).alias("text"))


@register("p4_centre_windows", Q.query(Q.candles(), "SELECT a.symbol, a.start_idx, a.i::BIGINT AS i, CASE WHEN a.i >= 3 AND a.i + 2 < 20 THEN (SELECT count(*) FROM candles b WHERE b.symbol = a.symbol AND b.start_idx = a.start_idx AND b.i BETWEEN a.i - 3 AND a.i + 2) ELSE 0 END::BIGINT AS n FROM candles a"))
def _(spark, d):
    k = charts(spark, d).select("symbol", "start_idx", codec.parse_candles(F.col("text")).alias("k"))
    return k.select("symbol", "start_idx", "k", F.posexplode("k").alias("i", "one")).select("symbol", "start_idx", "i", F.size(codec.centred(F.col("k"), F.col("i"), 3, 2)).alias("n"))


@register("p5_candle_tags", Q.query(Q.candles(), "SELECT symbol, start_idx, i::BIGINT AS i, format('O_{} H_{} L_{} C_{}', o, h, l, c) AS tag FROM candles"))
def _(spark, d):
    return candles(spark, d).select("symbol", "start_idx", "i", codec.candle_text(F.struct("o", "h", "l", "c")).alias("tag"))


@register("p6_candle_measures", Q.query(Q.candles(), _CANDLE))
def _(spark, d):
    o, h, low, c = (F.col(x) for x in "ohlc")
    return candles(spark, d).select("symbol", "start_idx", "i", C.body(o, c).alias("body"), C.span(h, low).alias("span"), C.upper_wick(o, h, c).alias("upper_wick"), C.lower_wick(o, low, c).alias("lower_wick"))


def _way(t: int, o: str = "o", c: str = "c") -> str:
    return f"CASE WHEN {c} - {o} > {t} THEN 'BULL' WHEN {o} - {c} > {t} THEN 'BEAR' ELSE 'DOJI' END"


@register("d1_directions", Q.query(Q.candles(), f"SELECT symbol, start_idx, i::BIGINT AS i, {_way(2)} AS direction, {_way(1)} AS direction_1 FROM candles"))
def _(spark, d):
    return candles(spark, d).select("symbol", "start_idx", "i", C.direction(F.col("o"), F.col("c")).alias("direction"), C.direction(F.col("o"), F.col("c"), 1).alias("direction_1"))


@register(
    "d2_pin_bars",
    Q.query(Q.candles(), f"SELECT * FROM (SELECT symbol, start_idx, i, CASE WHEN body <= 0.3::DOUBLE * span AND lower_wick >= 0.6::DOUBLE * span AND upper_wick < 0.5::DOUBLE * lower_wick THEN 'HAMMER' WHEN body <= 0.3::DOUBLE * span AND upper_wick >= 0.6::DOUBLE * span AND lower_wick < 0.5::DOUBLE * upper_wick THEN 'SHOOTING_STAR' END AS pin FROM ({_CANDLE})) WHERE pin IS NOT NULL"),
)
def _(spark, d):
    return candles(spark, d).select("symbol", "start_idx", "i", C.pin_bar(*(F.col(x) for x in "ohlc")).alias("pin")).where("pin is not null")


@register(
    "d3_engulfings",
    Q.query(
        Q.candles(),
        f"""SELECT * FROM (SELECT symbol, start_idx, i::BIGINT AS i, CASE WHEN {_way(2, 'po', 'pc')} = 'BEAR' AND {_way(2)} = 'BULL' AND o <= pc AND c >= po THEN 'BULLISH_ENGULFING'
        WHEN {_way(2, 'po', 'pc')} = 'BULL' AND {_way(2)} = 'BEAR' AND o >= pc AND c <= po THEN 'BEARISH_ENGULFING' END AS pattern FROM (SELECT *, lag(o) OVER ({Q.CW}) AS po, lag(c) OVER ({Q.CW}) AS pc FROM candles)) WHERE pattern IS NOT NULL""",
    ),
)
def _(spark, d):
    w = D._w()
    k = candles(spark, d).withColumns({"po": F.lag("o").over(w), "pc": F.lag("c").over(w)})
    return k.select("symbol", "start_idx", "i", C.engulfing(F.col("po"), F.col("pc"), F.col("o"), F.col("c")).alias("pattern")).where("pattern is not null")


@register("d4_swing_highs", Q.query(Q.near(), "SELECT symbol, start_idx, i::BIGINT AS i, h::BIGINT AS level FROM sw WHERE swing_high"))
def _(spark, d):
    return D.with_swings(candles(spark, d)).where("swing_high").select("symbol", "start_idx", "i", F.col("h").alias("level"))


@register("d5_swing_lows", Q.query(Q.near(3), "SELECT symbol, start_idx, i::BIGINT AS i, l::BIGINT AS level FROM sw WHERE swing_low"))
def _(spark, d):
    return D.with_swings(candles(spark, d), 3).where("swing_low").select("symbol", "start_idx", "i", F.col("l").alias("level"))


@register("d6_gaps", Q.query(f"{Q.candles()}, {Q.GAPS}", "SELECT symbol, start_idx, i::BIGINT AS i, type, gap_low::BIGINT AS gap_low, gap_high::BIGINT AS gap_high, gap_size::BIGINT AS gap_size FROM graded"))
def _(spark, d):
    return D.gaps(candles(spark, d))


@register("d7_graded_gaps", Q.query(f"{Q.candles()}, {Q.GAPS}", "SELECT symbol, start_idx, i::BIGINT AS i, type, gap_size::BIGINT AS gap_size, fill_pct FROM graded"))
def _(spark, d):
    return D.graded_gaps(candles(spark, d)).drop("gap_low", "gap_high")


@register("d8_nearest_swings", Q.query(Q.near(), "SELECT symbol, start_idx, i::BIGINT AS i, nh.idx::BIGINT AS high_idx, nh.level::BIGINT AS high_level, nl.idx::BIGINT AS low_idx, nl.level::BIGINT AS low_level FROM near"))
def _(spark, d):
    return near(spark, d).select("symbol", "start_idx", "i", F.col("near_high.idx").alias("high_idx"), F.col("near_high.level").alias("high_level"), F.col("near_low.idx").alias("low_idx"), F.col("near_low.level").alias("low_level"))


@register(
    "d9_sweeps_at",
    Q.query(Q.near(), "SELECT symbol, start_idx, i::BIGINT AS i, CASE WHEN h > nh.level THEN 'SWEEP_HIGH' ELSE 'SWEEP_LOW' END AS type, CASE WHEN h > nh.level THEN nh.idx ELSE nl.idx END::BIGINT AS swing_idx, CASE WHEN h > nh.level THEN nh.level ELSE nl.level END::BIGINT AS swing_level, CASE WHEN h > nh.level THEN h - nh.level ELSE nl.level - l END::BIGINT AS depth FROM near WHERE h > nh.level OR l < nl.level"),
)
def _(spark, d):
    return D.sweeps_at(near(spark, d))


@register("d10_sweep_scan", Q.query(f"{Q.near()}, {Q.SWEEPS}", "SELECT symbol, start_idx, i::BIGINT AS i, type, swing_idx::BIGINT AS swing_idx, swing_level::BIGINT AS swing_level, depth::BIGINT AS depth FROM sweeps"))
def _(spark, d):
    return D.sweep_scan(near(spark, d))


@register(
    "d11_shifts_at",
    Q.query(
        Q.near(),
        " UNION ALL ".join(
            f"""SELECT symbol, start_idx, i::BIGINT AS i, '{t}' AS trend, CASE WHEN {first} THEN 'BOS' ELSE 'CHoCH' END AS type, CASE WHEN {first} = ('{t}' = 'BULL') THEN 'BULL' ELSE 'BEAR' END AS direction,
            CASE WHEN {first} = ('{t}' = 'BULL') THEN nh.idx ELSE nl.idx END::BIGINT AS swing_idx FROM (SELECT *, coalesce(c > nh.level, false) AS up, coalesce(c < nl.level, false) AS down FROM near) WHERE up OR down"""
            for t, first in (("BULL", "up"), ("BEAR", "down"))
        ),
    ),
)
def _(spark, d):
    n = near(spark, d)
    return D.shifts_at(n, "BULL").withColumn("trend", F.lit("BULL")).unionByName(D.shifts_at(n, "BEAR").withColumn("trend", F.lit("BEAR"))).drop("swing_level", "broken_type")


@register("d12_shift_scan", Q.query(f"{Q.near()}, {Q.shifts('BULL')}", "SELECT symbol, start_idx, i::BIGINT AS i, type, direction, swing_idx::BIGINT AS swing_idx, swing_level::BIGINT AS swing_level, broken_type FROM shifts"))
def _(spark, d):
    return D.shift_scan(near(spark, d), "BULL")


#: Whole series as one chart each, in hundredths.
_SERIES = Q.near(base=Q.BARS + ", candles AS MATERIALIZED (SELECT symbol, 0::BIGINT AS start_idx, idx::INTEGER AS i, round(open * 100)::INTEGER AS o, round(high * 100)::INTEGER AS h, round(low * 100)::INTEGER AS l, round(close * 100)::INTEGER AS c FROM bars)")


def series(spark, d):
    return bars(spark, d).select("symbol", "idx", *(F.round(F.col(c) * 100).cast("int").alias(c[0]) for c in ("high", "low", "close")))


@register("d10_sweeps_of_series", Q.query(f"{_SERIES}, {Q.SWEEPS}", "SELECT symbol, i::BIGINT AS i, type, swing_idx::BIGINT AS swing_idx, swing_level::BIGINT AS swing_level, depth::BIGINT AS depth FROM sweeps"))
def _(spark, d):
    return L.sweeps_of_series(series(spark, d))


@register("d12_shifts_of_series", Q.query(f"{_SERIES}, {Q.shifts('BEAR')}", "SELECT symbol, i::BIGINT AS i, type, direction, swing_idx::BIGINT AS swing_idx, swing_level::BIGINT AS swing_level, broken_type FROM shifts"))
def _(spark, d):
    return L.shifts_of_series(series(spark, d), "BEAR")


_REJ = """pairs AS (SELECT a.symbol, a.start_idx, a.i, a.h, a.l, a.c, max(CASE WHEN s.swing_high AND NOT EXISTS (SELECT 1 FROM sw k WHERE k.symbol = a.symbol AND k.start_idx = a.start_idx AND k.i > s.i AND k.i < a.i AND k.c > s.h) THEN s.i END) AS jh,
  max(CASE WHEN s.swing_low AND NOT EXISTS (SELECT 1 FROM sw k WHERE k.symbol = a.symbol AND k.start_idx = a.start_idx AND k.i > s.i AND k.i < a.i AND k.c < s.l) THEN s.i END) AS jl
  FROM sw a JOIN sw s ON s.symbol = a.symbol AND s.start_idx = a.start_idx AND s.i <= a.i - 3 AND s.i >= greatest(a.i - 20, 2) GROUP BY ALL),
leveled AS (SELECT p.*, x.h AS lh, y.l AS ll FROM pairs p LEFT JOIN sw x ON x.symbol = p.symbol AND x.start_idx = p.start_idx AND x.i = p.jh LEFT JOIN sw y ON y.symbol = p.symbol AND y.start_idx = p.start_idx AND y.i = p.jl)"""


@register(
    "d13_rejection_sweeps",
    Q.query(
        f"{Q.near()}, {_REJ}",
        """SELECT * FROM (SELECT symbol, start_idx, i::BIGINT AS i, CASE WHEN h > lh AND c < lh THEN 'BEARISH_SWEEP' WHEN l < ll AND c > ll THEN 'BULLISH_SWEEP' END AS type, CASE WHEN h > lh AND c < lh THEN jh ELSE jl END::BIGINT AS swing_idx,
        CASE WHEN h > lh AND c < lh THEN lh ELSE ll END::BIGINT AS swing_level, CASE WHEN h > lh AND c < lh THEN h - lh ELSE ll - l END::BIGINT AS depth FROM leveled) WHERE type IS NOT NULL""",
    ),
)
def _(spark, d):
    return D.rejection_sweeps(candles(spark, d))


_FACT = "symbol, start_idx, kind, seq::BIGINT AS seq, type, direction, candle_idx::BIGINT AS candle_idx, swing_idx::BIGINT AS swing_idx, swing_level::BIGINT AS swing_level, depth::BIGINT AS depth, gap_low::BIGINT AS gap_low, gap_high::BIGINT AS gap_high, gap_size::BIGINT AS gap_size, fill_pct, broken_type"


@register("d14_facts", Q.query(Q.events("BULL"), f"SELECT {_FACT} FROM facts"))
def _(spark, d):
    return D.events(candles(spark, d), "BULL")


@register(
    "j1_relations",
    Q.query(
        f"""{Q.events('BEAR')}, e AS MATERIALIZED (SELECT symbol, start_idx, seq, kind, candle_idx, coalesce(direction, CASE WHEN type LIKE '%HIGH%' OR type = 'BEAR' THEN 'BEAR' WHEN type LIKE '%LOW%' OR type = 'BULL' THEN 'BULL' END) AS way,
        coalesce(gap_low, swing_level) AS lo, coalesce(gap_high, swing_level) AS hi FROM facts),
        l AS MATERIALIZED (SELECT symbol, start_idx, list({{'seq': seq, 'kind': kind, 'candle_idx': candle_idx, 'way': way, 'lo': lo, 'hi': hi}} ORDER BY seq) AS ev FROM e GROUP BY symbol, start_idx),
        f AS (SELECT symbol, start_idx, ev, unnest(ev) AS a FROM l), p AS (SELECT symbol, start_idx, a, unnest(list_filter(ev, lambda x: x.seq > a.seq)) AS b FROM f)""",
        """SELECT symbol, start_idx, a.seq::BIGINT AS event_a_idx, b.seq::BIGINT AS event_b_idx, CASE WHEN a.candle_idx < b.candle_idx THEN 'A_BEFORE_B' WHEN a.candle_idx > b.candle_idx THEN 'B_BEFORE_A'
        WHEN a.kind = 'sweep' AND b.kind = 'shift' THEN 'A_BEFORE_B' WHEN a.kind = 'shift' AND b.kind = 'sweep' THEN 'B_BEFORE_A' ELSE 'SAME_CANDLE' END AS "order", a.way = b.way AS same_direction, least(a.hi, b.hi) > greatest(a.lo, b.lo) AS overlap
        FROM p""",
    ),
)
def _(spark, d):
    return D.relations(D.events(candles(spark, d), "BEAR"))
