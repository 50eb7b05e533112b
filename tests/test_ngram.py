"""The trigram model against its definition."""

import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tickloom.operators import ngram


def plain(sequences):
    """p(u, v, w) by the definition."""
    three = Counter()
    for s in sequences:
        t = ["<s>", "<s>", *s, "</s>"]
        three.update(zip(t, t[1:], t[2:], strict=False))
    two = Counter((v, w) for _, v, w in three)
    one = Counter(w for _, w in two)

    def discount(c):
        n1, n2 = (sum(x == k for x in c.values()) for k in (1, 2))
        return n1 / (n1 + 2 * n2) if n1 else 0.5

    d1, d2, d3 = map(discount, (one, two, three))
    after = {n: defaultdict(list) for n in (2, 3)}
    for (u, v, _), c in three.items():
        after[3][u, v].append(c)
    for (v, _), c in two.items():
        after[2][v].append(c)

    def p(u, v, w):
        n = sum(one.values())
        p1 = max(one[w] - d1, 0) / n + d1 * len(one) / n / (len(one) + 1)
        p2 = p1
        if v in after[2]:
            c = after[2][v]
            p2 = max(two[v, w] - d2, 0) / sum(c) + d2 * len(c) / sum(c) * p1
        if (u, v) not in after[3]:
            return p2
        c = after[3][u, v]
        return max(three[u, v, w] - d3, 0) / sum(c) + d3 * len(c) / sum(c) * p2

    return p, set(one)


def test_model_against_the_definition(spark):
    rng = random.Random(1)
    seqs = [[rng.choice("aaabbcdefg") for _ in range(rng.randint(0, 12))] for _ in range(60)]
    test = [[rng.choice("aabcdxyz") for _ in range(rng.randint(0, 9))] for _ in range(40)]
    p, known = plain(seqs)
    model = ngram.fit(spark.createDataFrame([(i, s) for i, s in enumerate([*seqs, None])], "i int, t array<string>").repartition(3), "t")
    rows = [(i, s) for i, s in enumerate(test)]
    got = {r["i"]: r for r in ngram.losses(spark.createDataFrame([*rows, (99, None)], "i int, t array<string>"), "t", model, "i").collect()}
    assert set(got) == {i for i, _ in rows}
    for i, s in rows:
        t = ["<s>", "<s>", *s, "</s>"]
        assert got[i]["n"] == len(s) + 1
        assert math.isclose(got[i]["loss"], -sum(math.log(p(*g)) for g in zip(t, t[1:], t[2:], strict=False)), rel_tol=1e-9)
    inner = {r["i"]: r for r in ngram.losses(spark.createDataFrame(rows, "i int, t array<string>"), "t", model, "i", whole=False).collect()}
    assert set(inner) == {i for i, s in rows if len(s) > 2}


def test_chances_of_each_context_sum_to_one(spark):
    rng = random.Random(2)
    seqs = [[rng.choice("aaabbcdefg") for _ in range(rng.randint(0, 12))] for _ in range(50)]
    model = ngram.fit(spark.createDataFrame([(s,) for s in seqs], "t array<string>"), "t")
    contexts = spark.createDataFrame([("a", "b"), ("<s>", "<s>"), ("x", "a"), ("x", "y"), ("g", "g"), ("<s>", "c")], "u string, v string")
    every = ngram.next_chances(contexts, model)
    unknown = ngram.with_chance(contexts.withColumn("w", F.lit("not known")), model)
    sums = every.unionByName(unknown).groupBy("u", "v").agg(F.sum("p").alias("s"), F.min("p").alias("least")).collect()
    assert len(sums) == 6 and all(abs(r["s"] - 1) < 1e-12 and r["least"] > 0 for r in sums)


def test_model_of_nothing(spark):
    none = spark.createDataFrame([], "i int, t array<string>")
    model = ngram.fit(none, "t")
    got = ngram.losses(spark.createDataFrame([(1, ["a"])], "i int, t array<string>"), "t", model, "i").first()
    assert got["n"] == 2 and got["loss"] == 0.0  # one token, the unknown one, is all there is
    assert ngram.losses(none, "t", model, "i").count() == 0


def test_packs_send_distinct_trigrams_only():
    import pyarrow as pa

    rows = pa.RecordBatch.from_arrays([pa.array([["a", "b"] * 200_000, None, [], ["a"] * ngram.PACK] * 3)], names=["t"])
    packs = list(ngram._packs(iter([rows]), "t"))
    assert sum(p.num_rows for p in packs) == 9 and len(packs) > 2
    grams = ngram._grams(packs[0], "t", ("<s>", "</s>"))
    place, first = ngram._dense(grams.parts())
    assert len(grams.row) >= 400_001 and len(first) < 12
    seen = set(zip(*(c.to_pylist() for c in grams.columns(first)), strict=True))
    assert {("<s>", "<s>", "a"), ("a", "b", "a"), ("a", "b", "</s>")} <= seen


def test_losses_of_rows_in_many_packs_and_by_several_columns(spark):
    seqs = [(i % 5, None if i % 7 == 0 else "x", [3, i % 4, 3] * (i % 6)) for i in range(90)]
    df = spark.createDataFrame(seqs, "i int, k string, t array<int>").repartition(7)
    model = ngram.fit(df, "t", -1, -2)
    got = {(r["i"], r["k"]): r["n"] for r in ngram.losses(df, "t", model, "i", "k").collect()}
    want = Counter()
    for i, k, t in seqs:
        want[i, k] += len(t) + 1
    assert got == dict(want)
    by = ngram.counted(df, "t", "k", marks=(-1, -2)).groupBy("k").agg(F.sum("c").alias("c")).collect()
    assert {r["k"]: r["c"] for r in by} == {k: sum(n for (_, x), n in want.items() if x == k) for k in (None, "x")}


def test_packs_serve_the_model_and_its_losses(spark):
    seqs = [(i, i % 3 == 0 if i % 10 else None, [i % 4, 2, i % 5] * (i % 4)) for i in range(60)]
    df = spark.createDataFrame(seqs, "i int, held boolean, t array<int>").repartition(3)
    packs = ngram.packed(df, "t", "i", "held", marks=(-1, -2), apart="held")
    model = ngram.fit(df.where("NOT held"), "t", -1, -2)
    both = ngram.fit_counts(packs.counts(False), -1, -2)
    assert sorted(both.three.collect()) == sorted(model.three.collect())
    want = {r["i"]: r for r in ngram.losses(df, "t", model, "i").collect()}
    got = {r["i"]: r for r in ngram.losses_of(packs, both).collect()}
    assert set(got) == set(want) == set(range(60))
    assert all(got[i]["n"] == want[i]["n"] and math.isclose(got[i]["loss"], want[i]["loss"], rel_tol=1e-9) for i in want)
