"""Golden charts of the detectors, the codec and what is built on them."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions import candles as C
from tickloom.functions import codec
from tickloom.operators import detect as D
from tickloom.operators import long_scan
from tickloom.operators import render as R
from tickloom.operators import stats as A
from tickloom.operators import validate as V
from tickloom.plans import samples

M16 = [(495, 505, 490, 500), (498, 508, 493, 503), (505, 530, 500, 525), (520, 518, 510, 515), (515, 513, 505, 510), (510, 535, 505, 512), (512, 516, 508, 514), (514, 522, 510, 518), (519, 521, 517, 520), (525, 535, 524, 530), (528, 532, 522, 525), (523, 528, 518, 520), (520, 545, 515, 540), (535, 533, 525, 528), (525, 523, 515, 518), (515, 555, 510, 550)]
T12 = [(525, 530, 520, 525), (520, 525, 515, 520), (505, 510, 480, 495), (495, 505, 490, 500), (500, 510, 495, 505), (510, 515, 470, 475), (470, 475, 460, 465), (465, 480, 460, 475), (475, 495, 470, 490), (480, 485, 470, 475), (475, 470, 460, 465), (470, 505, 465, 500)]
FIVE = M16[:5]


@pytest.fixture(scope="module")
def frame(spark):
    def make(*charts):
        rows = [("x", n, i, *c) for n, chart in enumerate(charts) for i, c in enumerate(chart)]
        return spark.createDataFrame(rows, "symbol string, start_idx long, i int, o int, h int, l int, c int")

    return make


def near(df, lookback=10):
    return D.with_nearest_swings(D.with_swings(df, 2), lookback)


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column().alias("x")).first()["x"]


def cols():
    return [F.col(x) for x in "ohlc"]


@pytest.mark.parametrize(("c", "want"), [((500, 525, 495, 520), "BULL"), ((520, 525, 495, 500), "BEAR"), ((500, 510, 490, 502), "DOJI"), ((500, 510, 490, 503), "BULL"), ((500, 600, 400, 501), "DOJI")])
def test_direction(spark, c, want):
    assert one(spark, lambda: C.direction(F.col("o"), F.col("c")), **dict(zip("ohlc", c, strict=True))) == want


@pytest.mark.parametrize(("c", "want"), [((590, 600, 500, 595), "HAMMER"), ((510, 600, 500, 505), "SHOOTING_STAR"), ((560, 565, 500, 560), "HAMMER"), ((520, 600, 500, 580), None), ((545, 600, 500, 555), None)])
def test_pin_bar(spark, c, want):
    assert one(spark, lambda: C.pin_bar(*cols()), **dict(zip("ohlc", c, strict=True))) == want


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [((510, 507), (506, 515), "BULLISH_ENGULFING"), ((505, 508), (509, 500), "BEARISH_ENGULFING"), ((510, 507), (507, 510), "BULLISH_ENGULFING"), ((510, 507), (507, 509), None)],
)
def test_engulfing(spark, a, b, want):
    got = one(spark, lambda: C.engulfing(F.col("po"), F.col("pc"), F.col("o"), F.col("c")), po=a[0], pc=a[1], o=b[0], c=b[1])
    assert got == want


def test_swings(frame):
    chart = lambda highs: [(h - 5, h, h - 10, h - 5) for h in highs]
    df = frame(chart([500, 505, 530, 505, 500]), chart([500, 505, 530, 505, 530, 505, 500]), chart([540, 505, 500, 505, 540]))
    got = {(r["start_idx"], r["i"]) for r in D.with_swings(df, 2).where("swing_high").collect()}
    assert got == {(0, 2), (1, 2), (1, 4)}


def test_gaps(frame):
    up = [(500, 510, 495, 505), (515, 525, 512, 520), (530, 540, 525, 535)]
    df = frame(up, [(540, 545, 530, 535), (525, 528, 515, 520), (510, 512, 500, 505)], up[:2] + [(530, 540, 511, 535)], up[:2] + [(530, 540, 510, 535)], [*up, (530, 530, 505, 515)], [*up, (520, 520, 508, 516), (516, 520, 518, 519)])
    got = {(r["start_idx"], r["i"]): (r["type"], r["gap_size"], r["fill_pct"]) for r in D.graded_gaps(df).collect()}
    assert got[0, 2] == ("BULL", 15, 0.0)
    assert got[1, 2][0] == "BEAR" and got[2, 2] == ("BULL", 1, 0.0) and (3, 2) not in got
    assert got[4, 2][2] == 100.0 and got[5, 2][2] == 13.3


def test_many_events(frame):
    got = D.events(frame(M16), "BULL").orderBy("seq").collect()
    told = [(r["kind"], r["type"], r["candle_idx"], r["swing_idx"], r["swing_level"], r["depth"]) for r in got if r["kind"] != "gap"]
    assert told == [("sweep", "SWEEP_HIGH", 5, 2, 530, 5), ("sweep", "SWEEP_HIGH", 12, 9, 535, 10), ("shift", "BOS", 12, 9, 535, None)]
    gaps = [(r["type"], r["candle_idx"], r["gap_low"], r["gap_high"], r["fill_pct"]) for r in got if r["kind"] == "gap"]
    assert gaps == [("BULL", 3, 508, 510, 0.0), ("BULL", 8, 516, 517, 100.0), ("BULL", 9, 522, 524, 100.0), ("BULL", 10, 521, 522, 100.0)]
    rel = D.relations(D.events(frame(M16), "BULL")).collect()
    assert len(rel) == 21
    both = [r for r in rel if (r["event_a_idx"], r["event_b_idx"]) == (1, 6)]
    assert both[0]["order"] == "A_BEFORE_B" and both[0]["overlap"] is False and both[0]["same_direction"] is False


def test_scans(frame):
    df = frame([*FIVE, (510, 535, 505, 520)], [*FIVE, (510, 540, 505, 535)], [*FIVE, (510, 535, 505, 530)], T12, [*FIVE, (510, 540, 505, 535), (520, 525, 510, 515), (510, 505, 495, 500), (495, 545, 490, 540)])
    n = near(df)
    sweeps = {(r["start_idx"], r["i"]): (r["type"], r["swing_idx"], r["depth"]) for r in D.sweep_scan(n).collect()}
    assert sweeps[0, 5] == ("SWEEP_HIGH", 2, 5)
    bull = {(r["start_idx"], r["i"]): (r["type"], r["direction"], r["swing_level"]) for r in D.shift_scan(n, "BULL").collect()}
    bear = {(r["start_idx"], r["i"]): (r["type"], r["direction"]) for r in D.shift_scan(n, "BEAR").collect()}
    assert bull[1, 5] == ("BOS", "BULL", 530) and bear[1, 5] == ("CHoCH", "BULL")
    assert (0, 5) not in bull and (2, 5) not in bull
    assert {k: v for k, v in bull.items() if k[0] == 3} == {(3, 5): ("CHoCH", "BEAR", 480), (3, 11): ("CHoCH", "BULL", 495)}
    assert [k for k in bull if k[0] == 4] == [(4, 5)]
    with pytest.raises(ValueError):
        D.shift_scan(n, "SIDEWAYS")


def test_top_gaps(frame):
    chart = []
    for k in range(3):
        b = 1000 + 300 * k
        chart += [(b, b + 10, b - 5, b + 5), (b + 15, b + 25, b + 12, b + 20), (b + 30, b + 40, b + 25, b + 35), (b + 20, b + 24, b + 10, b + 15), (b + 15, b + 30, b + 5, b + 20)]
    df = frame(chart)
    e = R.top_gaps(D.events(df, "BULL"), R.last_candles(df)).where("kind = 'gap'")
    assert e.count() == 7
    assert [r["candle_idx"] for r in e.where("shown").orderBy("candle_idx").collect()] == [7, 10, 11, 12]


def sampled(frame, *charts):
    df = frame(*charts)
    texts = df.groupBy("symbol", "start_idx").agg(codec.chart_text(F.transform(F.array_sort(F.collect_list(F.struct("i", "o", "h", "l", "c"))), lambda c: F.struct(c["o"].alias("o"), c["h"].alias("h"), c["l"].alias("l"), c["c"].alias("c")))).alias("text"))
    return R.samples(D.events(df, "BULL"), df, texts)


def test_samples(frame):
    got = {(r["start_idx"], r["sample_type"]): r for r in sampled(frame, M16, [(500 + k, 502 + k, 498 + k, 501 + k) for k in range(5)]).collect()}
    assert {k for _, k in got} == {"sweep", "gap", "shift", "synthesis"} and {n for n, _ in got} == {0}
    assert got[0, "synthesis"]["total_event_count"] == 7 and "E1_T=" in got[0, "synthesis"]["eval"]
    assert got[0, "shift"]["eval"] == "<eval>T=BOS DIR=BULL C=13 SC=10 SL=535 BR=HIGH</eval>"


def test_samples_do_not_leak(frame):
    s = sampled(frame, M16, T12)
    assert s.where(V.leaks(F.col("explanation"), F.col("eval"))).count() == 0
    bad = s.withColumn("explanation", F.concat("explanation", F.lit(" 999")))
    assert bad.where(V.leaks(F.col("explanation"), F.col("eval"))).count() == s.count()


def test_parsing(spark):
    texts = ["<chart> O_500 H_510 L_490 O_520 H_530 L_510 C_525 </chart>", "<chart> </chart>", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["k"] for r in df.select(codec.parse_candles(F.col("t")).alias("k")).collect()]
    assert [len(k) for k in got[:3]] == [1, 0, 0] and got[0][0]["o"] == 520 and got[3] is None


def test_quantise_halves_to_even(spark):
    price = lambda p: codec.to_bin(F.lit(p), F.lit(100.0), F.lit(1.0), 24.0)
    row = spark.range(1).select(price(100.0).alias("a"), price(1e9).alias("b"), price(-1e9).alias("c"), codec.to_bin(F.lit(1.0), F.lit(1.0), F.lit(0.0), 24.0).alias("d")).first()
    assert tuple(row) == (512, 1023, 0, None)


def test_rejection_sweeps(frame):
    # a high at 2 is passed by a wick whose candle closes back under it
    flat = [(10, 11, 9, 10), (10, 12, 9, 11), (11, 15, 10, 12), (11, 12, 9, 10), (10, 11, 8, 9), (9, 16, 9, 14), (12, 13, 11, 12)]
    closed = flat[:5] + [(9, 16, 9, 16)] + flat[6:]
    got = {r["start_idx"]: r for r in D.rejection_sweeps(frame(flat, closed, [(10, 10, 10, 10)] * 7)).collect()}
    assert got[0]["type"] == "BEARISH_SWEEP" and got[0]["swing_level"] == 15 and got[0]["depth"] == 1
    assert set(got) == {0}


@pytest.mark.parametrize("block", [12, 40, 4096])
def test_scans_of_series_are_those_of_one_chart(spark, block):
    rng = random.Random(block)
    rows = []
    for symbol, n in (("a", 400), ("b", 37), ("c", 3), ("d", 12), (None, 60)):
        at = 1000
        for k in range(n):
            at += rng.randint(-6, 6)
            high, low = at + rng.randint(0, 5), at - rng.randint(0, 5)
            rows.append((symbol, k, at, high, low, rng.randint(low, high)))
    df = spark.createDataFrame(rows, "symbol string, idx long, o int, h int, l int, c int").repartition(4)
    near = D.with_nearest_swings(D.with_swings(df.select("symbol", F.lit(0).alias("start_idx"), F.col("idx").cast("int").alias("i"), "o", "h", "l", "c"), 2), 10)
    plain = lambda f, drop: sorted((tuple(x for c, x in r.asDict().items() if c not in drop) for r in f.collect()), key=str)
    assert plain(long_scan.sweeps_of_series(df, block=block), ()) == plain(D.sweep_scan(near).select("symbol", "i", "type", "swing_idx", "swing_level", "depth"), ())
    for trend in ("BULL", "BEAR"):
        assert plain(long_scan.shifts_of_series(df, trend, block=block), ()) == plain(D.shift_scan(near, trend).select("symbol", "i", "type", "direction", "swing_idx", "swing_level", "broken_type"), ())
    with pytest.raises(ValueError):
        long_scan.sweeps_of_series(df, block=11)


def test_fields_of_a_block_are_parsed_once(spark):
    block = "<eval>" + " ".join(f"E{k}_T=BULL E{k}_C={k} E{k}_FP={k}.5 E3_GS={k}" for k in range(1, 30)) + " E2_T=a=b E20000_C=7</eval>"
    df = spark.createDataFrame([(block,), ("",), ("<eval>T=BOS C=4</eval>",)], "eval string")
    plan = df.select(V.eval_fields(F.col("eval")).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1  # not again for each field
    got = {(r["event"], r["key"]): r["value"] for r in V.event_fields(df.where("eval like '%E1_%'")).collect()}
    want = {(k, key): v for k in range(1, 30) for key, v in (("T", "BULL"), ("C", str(k)), ("FP", f"{k}.5"))}
    assert got == want | {(3, "GS"): "29", (2, "T"): "a=b", (20000, "C"): "7"}
    assert sorted((r["event"], r["key"], r["value"]) for r in V.event_fields(df.where("eval like '%BOS%'")).collect()) == [(1, "C", "4"), (1, "T", "BOS")]


def test_inconsistent_fields_read_the_fields_once(spark):
    rows = [("a", s, e, k, v) for s, e, size in (("gap", 1, "5"), ("gap", 2, "6"), ("synthesis", 1, "5"), ("synthesis", 2, "7")) for k, v in (("T", "BULL"), ("C", str(e)), ("GS", size), ("GL", "1"))]
    df = spark.createDataFrame(rows, "symbol string, sample_type string, event int, key string, value string")
    found = V.inconsistent_fields(df, ("symbol",), "sample_type")
    assert [tuple(r) for r in found.collect()] == [("a", "BULL", "2", "GS", 1)]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_swings_of_all_sizes_in_one_pass(frame):
    charts = [M16, T12, M16[::-1], FIVE]
    m = A.swing_measures(frame(*charts), (1, 2, 3))
    assert "Union" not in m._jdf.queryExecution().optimizedPlan().toString()
    want = set()
    for n, c in enumerate(charts):
        for size in (1, 2, 3):
            for kind, col, sign in (("high", 1, 1), ("low", 2, -1)):
                before = None
                for i in range(size, len(c) - size):
                    least = min(sign * (c[i][col] - x[col]) for x in c[i - size : i] + c[i + 1 : i + size + 1])
                    if least >= 0:
                        want.add((n, size, kind, i, least, None if before is None else i - before))
                        before = i
    assert {(r["start_idx"], r["win"], r["kind"], r["i"], r["prominence"], r["gap"]) for r in m.collect()} == want


def test_events_are_dealt_to_tasks_of_like_numbers(frame, monkeypatch):
    monkeypatch.setattr(samples, "EVENTS_A_TASK", 10)
    found = D.events(frame(M16, T12, M16, T12), "BULL")
    n = found.count()
    assert n > 20
    assert samples.dealt(found).rdd.getNumPartitions() == -(-n // 10)
    assert samples.dealt(found.where("false")).count() == 0
