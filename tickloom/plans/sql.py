"""Shared parts of the SQL that states, independently of the DataFrame code, what queries return."""

from __future__ import annotations

WINDOW, STRIDE, PERIOD, SCALE = 20, 10, 14, 12.0

BARS = """
ev AS (SELECT event_type AS symbol, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS rn,
  100000 + sum(CAST(round(value * 100) AS BIGINT) - 5000) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS p FROM events),
bars AS MATERIALIZED (SELECT symbol, CAST(rn // 3 AS BIGINT) AS idx, min_by(p, rn)::DOUBLE / 100 AS open, max(p)::DOUBLE / 100 AS high,
  min(p)::DOUBLE / 100 AS low, max_by(p, rn)::DOUBLE / 100 AS close FROM ev GROUP BY symbol, rn // 3 HAVING count(*) = 3),
trs AS MATERIALIZED (SELECT *, CASE WHEN lag(close) OVER w IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY idx))"""


def atr(period: int = PERIOD) -> str:
    a = f"(2.0::DOUBLE / {period + 1})"
    return f"""{BARS},
ewm(symbol, idx, atr) AS (SELECT symbol, idx, tr FROM trs WHERE idx = 1
  UNION ALL SELECT t.symbol, t.idx, e.atr * (1 - {a}) + t.tr * {a} FROM ewm e JOIN trs t ON t.symbol = e.symbol AND t.idx = e.idx + 1),
abars AS MATERIALIZED (SELECT b.*, e.atr FROM trs b LEFT JOIN ewm e USING (symbol, idx))"""


def binned(price: str, anchor: str = "anchor_open", rng: str = "anchor_atr", scale: float = SCALE) -> str:
    return f"CAST(round_even((greatest(least(({price} - {anchor}) / ({scale}::DOUBLE * {rng}), 1.0::DOUBLE), -1.0::DOUBLE) + 1) / 2 * 1023, 0) AS INTEGER)"


def wins(window: int = WINDOW, stride: int = STRIDE, period: int = PERIOD, ahead: int = 0) -> str:
    return f"""{atr(period)},
starts AS (SELECT symbol, idx AS start_idx, open AS anchor_open, atr AS anchor_atr FROM abars JOIN (SELECT symbol, count(*) AS n FROM bars GROUP BY 1) USING (symbol)
  WHERE idx % {stride} = 0 AND idx <= n - {window + ahead} AND atr > 0),
wins AS MATERIALIZED (SELECT s.*, b.idx, CAST(b.idx - s.start_idx AS INTEGER) AS i, b.open, b.high, b.low, b.close FROM starts s
  JOIN bars b ON b.symbol = s.symbol AND b.idx >= s.start_idx AND b.idx < s.start_idx + {window + ahead})"""


def candles(window: int = WINDOW, stride: int = STRIDE, period: int = PERIOD, scale: float = SCALE) -> str:
    cols = ", ".join(f"{binned(p, scale=scale)} AS {p[0]}" for p in ("open", "high", "low", "close"))
    return f"{wins(window, stride, period)},\ncandles AS MATERIALIZED (SELECT symbol, start_idx, i, {cols} FROM wins)"


CW = "PARTITION BY symbol, start_idx ORDER BY i"


def near(window: int = 2, lookback: int = 10, base: str | None = None) -> str:
    """Swings of the table ``candles``, which ``base`` defines."""
    return f"""{base or candles()},
sw AS (SELECT *, i >= {window} AND i + {window} < n AND h = mh AS swing_high, i >= {window} AND i + {window} < n AND l = ml AS swing_low FROM
  (SELECT *, count(*) OVER (PARTITION BY symbol, start_idx) AS n, max(h) OVER ({CW} ROWS BETWEEN {window} PRECEDING AND {window} FOLLOWING) AS mh,
   min(l) OVER ({CW} ROWS BETWEEN {window} PRECEDING AND {window} FOLLOWING) AS ml FROM candles)),
near AS MATERIALIZED (SELECT *, last_value(CASE WHEN swing_high THEN {{'idx': i, 'level': h}} END IGNORE NULLS) OVER w AS nh,
  last_value(CASE WHEN swing_low THEN {{'idx': i, 'level': l}} END IGNORE NULLS) OVER w AS nl
  FROM sw WINDOW w AS ({CW} ROWS BETWEEN {lookback} PRECEDING AND 1 PRECEDING))"""


GAPS = f"""gaps AS MATERIALIZED (SELECT symbol, start_idx, i, CASE WHEN l > h2 THEN 'BULL' ELSE 'BEAR' END AS type, CASE WHEN l > h2 THEN h2 ELSE h END AS gap_low,
  CASE WHEN l > h2 THEN l ELSE l2 END AS gap_high, h_last, l_last, i_last FROM (SELECT *, lag(h, 2) OVER w AS h2, lag(l, 2) OVER w AS l2, last_value(h) OVER e AS h_last,
  last_value(l) OVER e AS l_last, last_value(i) OVER e AS i_last FROM candles
  WINDOW w AS ({CW}), e AS ({CW} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WHERE l > h2 OR h < l2),
graded AS MATERIALIZED (SELECT symbol, start_idx, i, type, gap_low, gap_high, gap_high - gap_low AS gap_size, CASE WHEN i_last <= i THEN 0.0::DOUBLE ELSE
  round_even(greatest(least(h_last, gap_high) - greatest(l_last, gap_low), 0) * 100.0::DOUBLE / (gap_high - gap_low), 1) END AS fill_pct FROM gaps)"""

#: The scans step over all charts at once, candle by candle.
SWEEPS = """scan(symbol, start_idx, i, broken, type, swing_idx, swing_level, depth) AS (
  SELECT DISTINCT symbol, start_idx, -1, []::INTEGER[], NULL::VARCHAR, NULL::INTEGER, NULL::INTEGER, NULL::INTEGER FROM near
  UNION ALL SELECT symbol, start_idx, i, CASE WHEN up THEN list_append(list_append(broken, nh.idx), i) WHEN down THEN list_append(list_append(broken, nl.idx), i) ELSE broken END,
    CASE WHEN up THEN 'SWEEP_HIGH' WHEN down THEN 'SWEEP_LOW' END, CASE WHEN up THEN nh.idx WHEN down THEN nl.idx END,
    CASE WHEN up THEN nh.level WHEN down THEN nl.level END, CASE WHEN up THEN h - nh.level WHEN down THEN nl.level - l END
  FROM (SELECT n.*, s.broken, coalesce(NOT list_contains(s.broken, n.nh.idx) AND n.h > n.nh.level, false) AS up, coalesce(NOT list_contains(s.broken, n.nl.idx) AND n.l < n.nl.level, false) AS down
    FROM scan s JOIN near n ON n.symbol = s.symbol AND n.start_idx = s.start_idx AND n.i = s.i + 1)),
sweeps AS MATERIALIZED (SELECT symbol, start_idx, i, type, swing_idx, swing_level, depth FROM scan WHERE type IS NOT NULL)"""


def shifts(trend: str, name: str = "shifts") -> str:
    return f"""scan_{name}(symbol, start_idx, i, broken, trend, type, direction, swing_idx, swing_level, broken_type) AS (
  SELECT DISTINCT symbol, start_idx, -1, []::INTEGER[], '{trend}', NULL::VARCHAR, NULL::VARCHAR, NULL::INTEGER, NULL::INTEGER, NULL::VARCHAR FROM near
  UNION ALL SELECT symbol, start_idx, i, CASE WHEN hit = 'HIGH' THEN list_append(list_append(broken, nh.idx), i) WHEN hit = 'LOW' THEN list_append(list_append(broken, nl.idx), i) ELSE broken END,
    CASE WHEN hit = 'HIGH' THEN 'BULL' WHEN hit = 'LOW' THEN 'BEAR' ELSE trend END,
    CASE WHEN hit IS NULL THEN NULL WHEN (hit = 'HIGH') = (trend = 'BULL') THEN 'BOS' ELSE 'CHoCH' END, CASE WHEN hit = 'HIGH' THEN 'BULL' WHEN hit = 'LOW' THEN 'BEAR' END,
    CASE WHEN hit = 'HIGH' THEN nh.idx WHEN hit = 'LOW' THEN nl.idx END, CASE WHEN hit = 'HIGH' THEN nh.level WHEN hit = 'LOW' THEN nl.level END, hit
  FROM (SELECT *, CASE WHEN trend = 'BULL' AND up THEN 'HIGH' WHEN down THEN 'LOW' WHEN up THEN 'HIGH' END AS hit FROM (SELECT n.*, s.broken, s.trend,
    coalesce(NOT list_contains(s.broken, n.nh.idx) AND n.c > n.nh.level, false) AS up, coalesce(NOT list_contains(s.broken, n.nl.idx) AND n.c < n.nl.level, false) AS down
    FROM scan_{name} s JOIN near n ON n.symbol = s.symbol AND n.start_idx = s.start_idx AND n.i = s.i + 1))),
{name} AS MATERIALIZED (SELECT symbol, start_idx, i, type, direction, swing_idx, swing_level, broken_type FROM scan_{name} WHERE type IS NOT NULL)"""


def events(trend: str = "BULL", base: str | None = None) -> str:
    return f"""{near(base=base)}, {GAPS}, {SWEEPS}, {shifts(trend)},
facts AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY symbol, start_idx ORDER BY rank, candle_idx) - 1 AS INTEGER) AS seq FROM (
  SELECT symbol, start_idx, 'sweep' AS kind, 0 AS rank, i AS candle_idx, type, NULL AS direction, swing_idx, swing_level, depth, NULL AS gap_low, NULL AS gap_high, NULL AS gap_size, NULL AS fill_pct, NULL AS broken_type FROM sweeps
  UNION ALL SELECT symbol, start_idx, 'gap', 1, i, type, NULL, NULL, NULL, NULL, gap_low, gap_high, gap_size, fill_pct, NULL FROM graded
  UNION ALL SELECT symbol, start_idx, 'shift', 2, i, type, direction, swing_idx, swing_level, NULL, NULL, NULL, NULL, NULL, broken_type FROM shifts))"""


def query(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{select}"
