"""Operators on what lies beyond sizes at which they once did less than the whole."""

import random
import re

from pyspark.sql import functions as F

from tickloom.llm import decontam, fingerprint, line_dedup, mixing


def paragraphs(text):
    return {p for p in re.split(r"[.\n\r]+", text) if p.strip(" ")}


def versioned(spark):
    """Texts of 1 to 3,000 paragraphs, with the sets of each, of its edit and of the next one."""
    sizes = (1, 3, 25, 40, 3000, 7, 90, 400, 12)
    texts = [". ".join(f"text {i} says {k * 7919 % 1009} of {k}" for k in range(n)) for i, n in enumerate(sizes)]
    texts[6] = texts[5] + ". " + texts[6]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = []
    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        q = len(t) // 4
        sets.append((paragraphs(t), paragraphs(t[: len(t) - q] + after[:q]), paragraphs(after)))
    return sets, {r["doc_id"]: r for r in fingerprint.fingerprints(docs).collect()}


def test_likeness_of_long_texts_is_exact(spark):
    sets, got = versioned(spark)
    for i, (a, b, c) in enumerate(sets):
        assert abs(got[i]["near_edited"] - (1 - len(a ^ b) / (len(a) + len(b)))) < 1e-12, i
        assert abs(got[i]["near_next"] - (1 - len(a ^ c) / (len(a) + len(c)))) < 1e-12, i


def test_published_sketch_has_all_paragraphs(spark):
    sets, got = versioned(spark)
    for i, (a, b, _) in enumerate(sets):
        for paras, text in ((a, got[i]["fingerprint"]), (b, got[i]["edited_fingerprint"])):
            n, total, _, body = text.split("|")
            cells = [[tuple(int(x, 16) for x in c.split(":")) for c in g.split(";")] for g in body.split("/")]
            width = fingerprint.WIDTHS[0]
            assert int(n, 16) == len(paras)
            for t in range(3):  # each table holds every paragraph once
                table = [c for g in cells for c in g[t * width : (t + 1) * width]]
                assert sum(c[0] for c in table) == len(paras), i
                mixed = 0
                for c in table:
                    mixed ^= c[1]
                assert mixed == int(total, 16)


def test_short_lines_are_deduplicated_by_equality(spark):
    long = "a line that is longer than the floor"
    docs = spark.createDataFrame([(1, f"short\n\n{long}\nshort"), (2, "shorn\nshort\n\nx"), (3, f"x\n{long}s\n\n")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs, short=True).collect()}
    assert got[1]["text"] == f"short\n\n{long}" and got[2]["text"] == "shorn\n\nx" and got[3]["text"] == "\n"
    assert [(got[i]["n_lines"], got[i]["n_removed"], got[i]["n_near"]) for i in (1, 2, 3)] == [(4, 1, 0), (4, 1, 0), (4, 2, 1)]


def test_texts_without_tokens_come_in_every_whole_epoch(spark):
    rows = [(i, "a", "one two three" if i < 10 else "" if i % 2 else None) for i in range(60)]
    rows += [(100 + i, "b", "one two three" if i < 2 else "") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    plan = mixing.schedule(docs).collect()
    assert {r["doc_id"] for r in plan} == {r[0] for r in rows}
    for source in "ab":
        for epoch in range(1 + max(r["epoch"] for r in plan if r["source"] == source)):
            whole = sum(r["tokens"] for r in plan if r["source"] == source and r["epoch"] == epoch) == sum(3 for r in rows if r[1] == source and r[2])
            if whole:
                assert sum(r["source"] == source and r["epoch"] == epoch for r in plan) == sum(r[1] == source for r in rows)


def test_short_items_are_always_found(spark):
    rng = random.Random(4)
    words = [f"v{k}" for k in range(400)]
    items = [[rng.choice(words) for _ in range(rng.randint(2, 14))] for _ in range(300)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    rows = []
    for i, w in enumerate(items):
        t = [rng.choice(words) for _ in range(rng.randint(0, 300))]
        at = rng.randint(0, len(t))
        rows.append((i, " ".join(t[:at] + w + t[at:])))
    docs = spark.createDataFrame([*rows, (1000, ""), (1001, "none of these")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontam.find_leaks(docs, bench).collect()}
    assert [i for i in range(len(items)) if str(i) not in got[i]["items"].split(",")] == []
    assert not got[1000]["contaminated"] and not got[1001]["contaminated"]


def test_subtracted_sketches_are_those_of_the_difference(spark):
    rng = random.Random(5)
    rows = [(k, [rng.getrandbits(62) for _ in range(20)], [rng.getrandbits(62) for _ in range(3 * k)]) for k in range(8)]
    df = spark.createDataFrame([(k, a, b + a[:9]) for k, a, b in rows], "i int, a array<bigint>, b array<bigint>")
    for width in fingerprint.WIDTHS:
        one = fingerprint.sketch(F.col("a"), width, F.col("b"))
        apart = fingerprint.subtract(fingerprint.sketch(F.col("a"), width), fingerprint.sketch(F.col("b"), width))
        assert df.where(~one.eqNullSafe(apart)).count() == 0


def test_large_groups_are_peeled_and_not_settled_by_sets(spark, monkeypatch):
    rng = random.Random(6)
    draw = lambda n: [rng.getrandbits(62) for _ in range(n)]
    few, many = draw(3), draw(900)
    rows = [(few, many), (many, []), (few, few), (many, [*many[5:], *draw(40)]), ([], [])]
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>")
    df = df.withColumns({f"{c}_parts": fingerprint.grouped(F.col(c)) for c in "ab"}).withColumns({f"{c}_cells": fingerprint.sketches(F.col(f"{c}_parts")) for c in "ab"})
    with monkeypatch.context() as m:
        m.setattr(fingerprint.F, "array_except", lambda one, other: F.array().cast("array<bigint>"))
        found = fingerprint.differing_of(*(F.col(f"{c}_{x}") for x in ("cells", "parts") for c in "ab"))
    for r in df.select("a", "b", found.alias("found")).collect():
        assert sorted(r["found"]) == sorted(set(r["a"]) ^ set(r["b"]))
