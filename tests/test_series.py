"""Series, simulation, corpora, tokens, the mixer and evaluation against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions.ranking import with_order, with_rank
from tickloom.functions.hashing import pick
from tickloom.operators import corpus as K
from tickloom.operators import evaluate as E
from tickloom.operators import mixer as M
from tickloom.operators import series as S
from tickloom.operators import simulate as T
from tickloom.operators import tokens as X
from tickloom.sources import readers, sinks


@pytest.mark.parametrize("period", [1, 2, 14, 100, 1000])
def test_long_exponential_mean(spark, period):
    rng = random.Random(period)
    values = [None] + [rng.random() * 10 for _ in range(3000)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)] + [("b", 0, None), ("b", 1, 2.0)], "symbol string, idx long, v double")
    got = {(r["symbol"], r["idx"]): r["m"] for r in S.with_ewm(df, "v", "m", period).collect()}
    alpha, mean = 2 / (period + 1), None
    for i, v in enumerate(values):
        if v is not None:
            mean = v if mean is None else (1 - alpha) * mean + alpha * v
        assert got["a", i] == (None if mean is None else pytest.approx(mean, rel=1e-9))
    assert got["b", 1] == pytest.approx(2.0)


def test_windows_are_whole(spark):
    bars = spark.createDataFrame([("a", i, 1.0, 2.0, 0.5, 1.5, None if i == 0 else 1.0) for i in range(57)], "symbol string, idx long, open double, high double, low double, close double, atr double")
    got = S.windows(bars, 20, 10).groupBy("start_idx").count().collect()
    assert {r["start_idx"]: r["count"] for r in got} == {10: 20, 20: 20, 30: 20}  # 0 has no range


def simulate(forward, entry, side, sl, tp, length, spread=2):
    sign = 1 if side == "long" else -1
    e = entry + sign * spread
    stop, target, dd = e + sign * sl, e + sign * tp, 0
    for k, (h, low, _) in enumerate(forward, 1):
        dd = min(dd, low - e if sign > 0 else e - h)
        if low <= stop if sign > 0 else h >= stop:
            return "sl_hit", k, sign * (stop - e), dd
        if h >= target if sign > 0 else low <= target:
            return "tp_hit", k, sign * (target - e), dd
    return "timeout", length, sign * (forward[-1][2] - e), dd


def test_trades(spark):
    rng = random.Random(3)
    rows, charts = [], {}
    for n in range(40):
        p, fw = 500, []
        for k in range(1, 31):
            p += rng.randint(-25, 25)
            h, low = p + rng.randint(0, 20), p - rng.randint(0, 20)
            fw.append((h, low, p))
            rows.append(("a", n, k, h, low, p, 500))
        charts[n] = fw
    df = spark.createDataFrame(rows, "symbol string, start_idx long, k int, h int, l int, c int, entry int")
    got = T.simulate(df, 30).collect()
    assert len(got) == 40 * 2 * len(T.setups()) == 40 * 28
    for r in got:
        want = simulate(charts[r["start_idx"]], 500, r["side"], r["sl"], r["tp"], 30)
        assert (r["exit_type"], r["candle_exit"], r["pnl_bins"], r["max_dd_bins"]) == want
    assert len(T.setups(strict=True)) == 12


def test_trades_copy_no_candle(spark):
    df = spark.createDataFrame([("a", 0, k, 500 + k, 500 - k, 500, 500) for k in range(1, 31)], "symbol string, start_idx long, k int, h int, l int, c int, entry int")
    plan = T.simulate(df, 30)._jdf.queryExecution()
    nodes = plan.optimizedPlan().toString()
    assert nodes.index("Generate") < nodes.index("Aggregate")  # above it: charts become trades once they are one row
    assert "SortAggregate" not in plan.executedPlan().toString()


def test_balance(spark):
    df = spark.createDataFrame([(i, "a" if i % 5 else "b") for i in range(100)], "i long, b string")
    got = T.balance(df, "b", ["i"]).groupBy("b").count().collect()
    assert {r["b"]: r["count"] for r in got} == {"a": 20, "b": 20}
    assert T.balance(df.limit(0), "b", ["i"]).count() == 0


def test_ranks(spark):
    df = spark.range(5000).withColumn("g", F.col("id") % 3)
    got = [r["id"] for r in with_rank(df, pick(1, "id"), ["id"]).orderBy("rank").collect()]
    want = [r["id"] for r in df.withColumn("h", pick(1, "id")).orderBy("h", "id").collect()]
    assert got == want
    assert with_order(df, "id", "rank", ["g"]).where((F.col("id") - F.col("g")) / 3 + 1 != F.col("rank")).count() == 0


def test_split_and_interleave(spark):
    df = spark.createDataFrame([(i, "abc"[min(i % 5, 2)]) for i in range(50)], "i long, s string")
    assert {r["split"]: r["count"] for r in K.split(df, ["i"], 0.1).groupBy("split").count().collect()} == {"val": 5, "train": 45}
    assert K.split(df.limit(3), ["i"], 0.1).where("split = 'val'").count() == 1
    first = K.interleave(df, "s", "i")
    assert first.groupBy("round").count().where("count <> 3").count() == 0 and first.count() == 30
    every = K.interleave(df, "s", "i", "all_exhausted")
    assert every.groupBy("round").count().where("count <> 3").count() == 0 and every.count() == 90


def test_paragraphs(spark):
    rows = [(1, 0, 0, "one  two", 0.0, 10.0), (1, 0, 1, "three", 12.0, 22.0), (1, 0, 2, "four", 24.0, 34.0), (1, 0, 3, "five", 60.0, 70.0), (2, 0, 0, " alone ", 5.0, 6.0)]
    df = spark.createDataFrame(rows, "doc long, page int, line_no int, text string, top double, bottom double")
    got = [(r["doc"], r["text"]) for r in K.paragraphs(df).orderBy("doc", "paragraph").collect()]
    assert got == [(1, "one two three four"), (1, "five"), (2, "alone")]
    merged = [(r["doc"], r["text"]) for r in K.merge_short(K.paragraphs(df), 10).orderBy("doc", "part").collect()]
    assert merged == [(1, "one two three four five"), (2, "alone")]


def test_compaction(spark, tmp_path):
    files = spark.createDataFrame([(f"f{i}", s) for i, s in enumerate([40, 50, 30, 200, 10, 90])], "name string, bytes long")
    got = [r["part"] for r in K.compaction_parts(files, 100).orderBy("name").collect()]
    assert got == [0, 0, 1, 2, 3, 3]
    rows = spark.createDataFrame([(f"f{i}", i) for i in range(6)], "file string, v long")
    sinks.compact(rows, files, str(tmp_path / "out"), 100)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["v"], r["part"]) for r in back.collect()} == {(0, 0), (1, 0), (2, 1), (3, 2), (4, 3), (5, 3)}


def test_sources(spark, tmp_path):
    (tmp_path / "t.txt").write_text(" a \n\n b\n")
    assert sorted(r["token"] for r in readers.token_lines(spark, str(tmp_path / "t.txt")).collect()) == ["a", "b"]
    warned = []
    assert readers.existing(spark, [str(tmp_path / "none.parquet")], warned.append) is None and len(warned) == 1
    sinks.write_parquet(sinks.to_corpus(spark.createDataFrame([("x", 3)], "text string, other int")), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).first().asDict() == {"text": "x", "source": "", "token_length": 0, "meta": "{}"}


def test_mix_plan(spark):
    units = spark.createDataFrame([(c, "f", g, 100) for c, n in (("a", 60), ("b", 30), ("c", 10)) for g in range(n)], "category string, file string, row_group long, tokens long")
    ratios = {"a": 0.6, "b": 0.3, "c": 0.1}
    plan = M.mix_plan(units, ratios, turn=100, part=1000, chunk=5000)
    got = plan.collect()
    assert len(got) == 100 and {(r["category"], r["row_group"]) for r in got} == {(c, g) for c, n in (("a", 60), ("b", 30), ("c", 10)) for g in range(n)}
    for chunk in (0, 1):
        own = [r["category"] for r in got if r["chunk"] == chunk]
        assert len(own) == 50 and abs(own.count("a") - 30) <= 1 and abs(own.count("b") - 15) <= 1
        assert len({r["part"] for r in got if r["chunk"] == chunk}) == 5
    resumed = M.mix_plan(units, ratios, 100, 1000, 5000, resume={"a": 59, "b": 30, "c": 10}).collect()
    assert [(r["category"], r["row_group"]) for r in resumed] == [("a", 59)]
    with pytest.raises(ValueError):
        M.check_ratios({"a": 0.5})


def test_segments(spark):
    lengths = [0, 5, 8, 64, 65, 100, 129, 130, 193, 194, 258, 400]
    df = spark.createDataFrame([(n, list(range(n))) for n in lengths], "n int, ids array<int>")
    for r in df.select("n", X.segments(F.col("ids"), 128).alias("a"), X.strided(F.col("ids"), 128, 64).alias("b")).collect():
        doc, a, b = list(range(r["n"])), [], []
        if r["n"] >= 8:
            full = len(doc) // 129
            a = [doc[k * 129 : (k + 1) * 129] for k in range(full)]
            if len(doc) - full * 129 >= 65:
                a.append(doc[-129:])
            start = 0
            while start + 129 <= len(doc):
                b.append(doc[start : start + 129])
                start += 64
            if len(doc) - (max(len(b) - 1, 0) * 64 + 129) >= 64:
                b.append(doc[-129:])
        assert r["a"] == a and r["b"] == b


def test_packing(spark):
    df = spark.createDataFrame([(g, i, [10 * g + i] * 3) for g in range(3) for i in range(g)], "g long, i long, ids array<int>")
    got = {(r["g"], r["block"]): r["ids"] for r in X.packed(df, "g", "i", "ids", 6).collect()}
    assert got == {(1, 0): [10, 10, 10, 2], (2, 0): [20, 20, 20, 2, 21, 21]}


def test_closed_vocabulary(spark):
    df = spark.createDataFrame([("<chart> O_0 C_1023 O_1024 hello </chart>",)], "t string")
    r = df.select(X.closed_ids(F.col("t")).alias("i"), X.closed_text(X.closed_ids(F.col("t"))).alias("back")).first()
    assert r["i"] == [4, 6, 6 + 4 * 1024 - 1, 3, 3, 5] and r["back"] == "<chart> O_0 C_1023 </chart>"


def test_first_fields(spark):
    df = spark.createDataFrame([("E1_T=BULL E1_C=4 E2_T=BEAR",)], "t string")
    t = F.col("t")
    r = df.select(E.with_first_field(t, "T", F.lit("BEAR")).alias("a"), E.with_first_field(t, "ZZ", F.lit("1")).alias("b"), E.first_field(t, "C").alias("c")).first()
    assert tuple(r) == ("E1_T=BEAR E1_C=4 E2_T=BEAR", None, "4")


@pytest.mark.parametrize("rows", [1, 7, 100])
def test_trailing_extremes(spark, rows):
    rng = random.Random(rows)
    values = [rng.randrange(1000) for _ in range(450)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "symbol string, idx long, v int")
    df = S.with_trailing(df, {"hi": (F.col("v"), True), "lo": (F.col("v"), False)}, rows)
    got = {r["idx"]: (r["hi"], r["lo"]) for r in df.collect()}
    for i in range(len(values)):
        part = values[max(0, i - rows + 1) : i + 1]
        assert got[i] == (max(part), min(part))
