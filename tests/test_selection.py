"""Percentiles by selection, places by ranges, parts by doubling."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions.quantile import percentiles
from tickloom.functions.ranking import with_index
from tickloom.operators.corpus import compaction_parts

SHARES = [0.0, 0.001, 0.25, 0.5, 0.9, 0.999, 1.0]


@pytest.mark.parametrize("at_once", [0, 10**9])
def test_percentiles_against_numpy(spark, at_once):
    rng = random.Random(2)
    values = {
        "even": [rng.random() for _ in range(3000)],
        "ties": [rng.choice([1.0, 2.0, 2.0, 7.5]) for _ in range(999)],
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(500)],
        "huge": [1.7e308, -1.7e308, 0.0],
        "one": [3.0],
        None: [5.0, 6.0],
        "none": [None, math.nan],
    }
    rows = [(g, v) for g, vs in values.items() for v in vs]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r["percentiles"] for r in percentiles(df, ["g"], "v", SHARES, at_once).collect()}
    assert set(got) == set(values) - {"none"}
    for g, q in got.items():
        want = np.percentile(values[g], [100 * s for s in SHARES])
        assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=0) or g == "huge" for a, b in zip(q, want, strict=True)), g
    assert got["huge"][3] == 0.0 and got["huge"][-1] == 1.7e308


def test_percentiles_of_a_whole_table(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    assert percentiles(df, [], "v", [0.5, 0.999], 0).first()[0] == [500.0, 999.0]
    assert percentiles(df.where("v < 0"), ["v"], "v", [0.5], 0).count() == 0


def test_index_and_running_sums(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abcde") * rng.randint(1, 3), k, rng.choice([None, 1, 5])) for k in range(500)]
    df = spark.createDataFrame(rows, "s string, k int, n long").repartition(7)
    got = sorted(with_index(df, ["s", "k"], "i", {"upto": "n"}).collect(), key=lambda r: r["i"])
    want = sorted(rows)
    assert [(r["s"], r["k"]) for r in got] == [(s, k) for s, k, _ in want] and [r["i"] for r in got] == list(range(500))
    assert [r["upto"] for r in got] == list(np.cumsum([n or 0 for *_, n in want]))


def one_by_one(sizes, target):
    parts, part, now = [], -1, 0
    for n in sizes:
        if part < 0 or now + n > target:
            part, now = part + 1, 0
        now += n
        parts.append(part)
    return parts


@pytest.mark.parametrize("seed", range(3))
def test_parts_against_a_pass_over_the_files(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, rng.randint(1, 40), rng.randint(1, 300)]) for _ in range([1, 37, 200][seed])]
    files = spark.createDataFrame([(f"f{k:04}", n, "x") for k, n in enumerate(sizes)], "name string, bytes long, part_ string").repartition(3)
    for target in (0, 100, 10**9):
        got = compaction_parts(files, target).orderBy("name").collect()
        assert [r["part"] for r in got] == one_by_one(sizes, target)
        assert got[0]["part_"] == "x"


def test_parts_of_no_files(spark):
    assert compaction_parts(spark.createDataFrame([], "name string, bytes long"), 5).count() == 0


def plain_plan(units, ratios, turn, part, chunk, resume):
    """Unit by unit, as the rule says it."""
    queues = {c: sorted(u for u in units if u[0] == c)[resume.get(c, 0) :] for c in ratios}
    given, rows = dict.fromkeys(ratios, 0), []
    at_chunk = at_part = in_chunk = in_part = 0
    while any(queues.values()):
        pick = min((c for c in ratios if queues[c]), key=lambda c: given[c] / max(in_chunk, 1) - ratios[c])
        room = min(part, chunk - (in_chunk - in_part)) - in_part
        taken = 0
        while queues[pick] and taken < max(1, min(turn, room)):
            unit = queues[pick].pop(0)
            rows.append((*unit[:3], unit[3] or 0, at_chunk, at_part, len(rows)))
            taken += unit[3] or 0
        given[pick] += taken
        in_chunk, in_part = in_chunk + taken, in_part + taken
        if in_part >= min(part, chunk - (in_chunk - in_part)):
            at_part, in_part = at_part + 1, 0
        if in_chunk >= chunk:
            at_chunk, at_part, in_chunk, in_part = at_chunk + 1, 0, 0, 0
            given = dict.fromkeys(ratios, 0)
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_plan_against_one_unit_at_a_time(spark, seed):
    from tickloom.operators import mixer

    rng = random.Random(seed)
    ratios = {"b": 0.5, "a": 0.3, "c": 0.15, "none": 0.05}
    units = [(c, f"f{k // 5}", k % 5, rng.choice([0, None, rng.randint(1, 9), rng.randint(1, 60)])) for c, n in (("a", 23), ("b", 40), ("c", 3), ("other", 4)) for k in range(n)]
    df = spark.createDataFrame(units, "category string, file string, row_group long, tokens long").repartition(3)
    resume = {"a": 4, "c": 9} if seed % 2 else {}
    for turn, part, chunk in ((10, 50, 200), (1, 7, 30), (1000, 100, 10**6)):
        got = mixer.mix_plan(df, ratios, turn, part, chunk, resume, block=[4, 16384][seed // 2]).orderBy("seq").collect()
        assert [tuple(r) for r in got] == plain_plan(units, ratios, turn, part, chunk, resume)
    assert mixer.mix_plan(df.limit(0), ratios).count() == 0
