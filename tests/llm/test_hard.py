"""Operators on groups and texts that are hard for their methods, against brute force; queries against their SQL."""

import glob
import itertools
import math
import os
import random
import re

import pytest

from tests.llm.test_operators import brute_components, edit_distance
from tickloom.llm import decontam, fingerprint, line_dedup, mixing, near_dup, pii, queries, secrets

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_with_sql(spark, small, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, small).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_personal_data_in_hard_texts(spark):
    texts = [
        "mail a@" + ".".join(["b"] * 50_000) + ".com",
        "1" * 300_000,
        "1234567 " * 20_000,
        " ".join(f"u{i}@ex.com 555-123-{1000 + i}" for i in range(3_000)),
        " ".join("4111 1111 1111 1111" for _ in range(500)),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert got[0]["n_email"] == 1 and got[1]["base_spans"] == got[2]["base_spans"] == ""
    assert got[3]["base_spans"] == ",".join(f"email:{m.start()}:{m.end()}" for m in EMAIL.finditer(texts[3]))


def test_secrets_in_hard_texts(spark):
    texts = [" ".join(f"password=abcdef{i} Ab{i:030d}" for i in range(2_000)), "password=" + "a1B" * 100_000]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in secrets.scan(docs).collect()}
    assert got[0]["n_assign"] == 2_000 and got[0]["n_hex"] == 2_000 and got[1]["n_assign"] == 1
    assert got[0]["spans"].count("mixed") == 0  # each overlaps a hex span


def test_secret_verdicts_by_repositories_and_owners(spark):
    values = {"one": "password=Zx81kQpL0aa", "own": "password=Qw72mRtY1bb", "two": "password=Er63nSuI2cc", "wide": "password=Ty54oTvO3dd"}
    places = {"one": ["a/1"], "own": ["a/1", "a/2"], "two": ["a/1", "b/1"], "wide": [f"{o}/{k}" for o in "ab" for k in range(3)]}
    rows = [(10 * i + k, values[name], p, p[0]) for i, (name, at) in enumerate(places.items()) for k, p in enumerate(at)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, repo string, owner string")
    got = {r["doc_id"]: r for r in secrets.scan(docs, repository=docs["repo"], owner=docs["owner"]).collect()}
    assert [got[10 * i][f"n_{v}"] for i, v in enumerate(("live", "reused", "shared", "copied"))] == [1, 1, 1, 1]
    assert [got[10 * i]["most_repositories"] for i in range(4)] == [1, 2, 2, 6]


def test_estimates_agree_with_em_over_single_candidates():
    rng = random.Random(21)
    names, rows = pii.LABELERS, []
    for _ in range(600):
        true = rng.random() < 0.4
        votes = tuple(rng.choice((1, -1)) if rng.random() < 0.2 else (1 if true else -1) if rng.random() < 0.9 else 0 for _ in names)
        rows.append((rng.choice(("email", "social")), votes))
    counts = {}
    for r in rows:
        counts[r] = counts.get(r, 0) + 1
    model = pii.estimate([(k, v, 1, 1, n) for (k, v), n in counts.items()])
    trust, share, post = dict.fromkeys(names, 0.8), dict.fromkeys(pii.BASE + pii.LOOSE, 0.5), []
    for _ in range(60):
        post = []
        for kind, votes in rows:
            yes, no = share[kind], 1 - share[kind]
            for name, v in zip(names, votes, strict=True):
                yes *= trust[name] if v > 0 else 1 - trust[name] if v < 0 else 1
                no *= 1 - trust[name] if v > 0 else trust[name] if v < 0 else 1
            post.append(yes / (yes + no))
        for j, name in enumerate(names):
            cast = [(p, v[j]) for p, (_, v) in zip(post, rows, strict=True) if v[j]]
            trust[name] = min(0.99, max(0.55, (8 + sum(p if v > 0 else 1 - p for p, v in cast)) / (10 + len(cast))))
        for kind in share:
            own = [p for p, r in zip(post, rows, strict=True) if r[0] == kind]
            share[kind] = min(0.99, max(0.01, (1 + sum(own)) / (2 + len(own))))
    assert all(abs(model.reliability[x] - trust[x]) < 1e-6 for x in names)
    assert all(abs(model.share[x] - share[x]) < 1e-6 for x in share)


def test_next_documents_of_outlying_ids(spark):
    ids = [-(2**63), -5, 0, 1, 2, 7, 2**63 - 1]
    docs = spark.createDataFrame([(i, f"text {k}. shared") for k, i in enumerate(ids)], "doc_id long, text string")
    after = {r["doc_id"]: r["next_id"] for r in fingerprint.successors(docs).collect()}
    assert after == dict(zip(ids, ids[1:] + ids[:1], strict=True))
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(docs).collect()}
    assert got[0]["near_next"] == pytest.approx(0.5)


def test_fingerprints_tell_order(spark):
    docs = spark.createDataFrame([(1, "Alpha.Beta.Gamma"), (2, "Gamma.Beta.Alpha"), (3, "Alpha.Beta.Gamma"), (4, "Alpha.Beta.Gamma.Gamma")], "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(docs).collect()}
    assert got[1] == got[3] and len({got[1], got[2], got[4]}) == 3


def template_texts():
    """Many documents of one template: alike, but for most pairs not enough; the rest of them round the threshold."""
    rng = random.Random(31)
    shared = [f"s{k}" for k in range(120)]
    out = {}
    for i in range(260):
        own = [f"o{rng.randrange(10**6)}" for _ in range(rng.choice((2, 6, 9, 12, 60)))]
        out[i] = " ".join(shared + own if i % 2 else shared[:60] + own + shared[60:])
    for i in range(260, 300):
        t = out[i - 200].split()
        t[rng.randrange(len(t))] = "changed"
        out[i] = " ".join(t)
    return out


@pytest.mark.parametrize("few", [4, 64])
def test_near_duplicates_of_a_template(spark, monkeypatch, few):
    monkeypatch.setattr(near_dup, "FEW", few)
    texts = template_texts()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(docs, width=3, num=85).collect()}
    assert got == brute_components(texts, 3, 85, 100)


def test_lines_of_one_form(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", 64)
    rng = random.Random(32)
    lines = [f"Order number {rng.randrange(10**7):08d} was shipped on day {rng.randrange(30):02d}" for _ in range(220)]
    lines += ["".join(c for k, c in enumerate(x) if k != rng.randrange(len(x))) for x in lines[:40]]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    root = {x: x for x in lines}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(root), 2):
        if abs(len(a) - len(b)) <= 2 and edit_distance(a, b) <= 2:
            root[top(a)] = top(b)
    first = {}
    for x in lines:
        first.setdefault(top(x), x)
    seen = set()
    for k, x in enumerate(lines):
        kept = first[top(x)] == x and top(x) not in seen
        seen |= {top(x)} if kept else set()
        assert got[k] == (x if kept else "")


def test_leaks_by_text_whatever_the_blocks(spark):
    items = [(i, " ".join(f"{w}{k * k % 7}{k}" for k in range(12))) for i, w in enumerate(("river", "harbour", "tower", "bridge", "market"))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    leak = lambda i: f"before it all {items[i][1]} and behind it"
    rows = [(None, leak(0)), (None, "clean text without any of it"), (7, leak(1)), (7, "another clean text"), (8, f"{leak(2)} {leak(3)}"), (9, None), (10, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shown = lambda **k: sorted(((r["doc_id"], r["contaminated"], r["items"]) for r in decontam.find_leaks(docs, bench, **k).collect()), key=str)
    one = shown()
    assert one == shown(block_items=2) == shown(block_chars=100)
    assert sum(x[1] for x in one) == 3 and (8, True, "2,3") in one


def test_leaks_against_all_pairs(spark):
    rng = random.Random(33)
    words = [f"v{k}" for k in range(1500)]
    items = [[rng.choice(words) for _ in range(rng.randint(16, 40))] for _ in range(40)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    texts = []
    for i in range(300):
        t = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        if i % 3 == 0:  # an item with words exchanged, taken out and put in
            w = [x if rng.random() > 0.15 else rng.choice(words) for x in items[i % 40] if rng.random() > 0.05]
            at = rng.randint(0, len(t))
            t[at:at] = w
        texts.append(t)

    def share(item, text):
        best = 0
        for at in range(0, len(text), 12):  # every stretch that an item could be in
            row = [0] * (len(item) + 1)
            for x in text[max(0, at - len(item)) : at + 2 * len(item)]:
                last = 0
                for k, y in enumerate(item, 1):
                    last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
            best = max(best, row[-1])
        return best / len(item)

    want = {(i, k) for i, t in enumerate(texts) for k, item in enumerate(items) if len(set(item) & set(t)) >= 0.6 * len(item) and share(item, t) >= 0.7}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r["doc_id"], int(k)) for r in decontam.find_leaks(docs, bench).collect() for k in r["items"].split(",") if k}
    assert len(want) > 60 and len(got & want) >= 0.9 * len(want)
    assert all(share(items[k], texts[i]) >= 0.55 for i, k in got - want)  # those that have the answer's words


def test_weights_against_a_grid_of_exponents():
    rng = random.Random(34)
    for _ in range(20):
        tokens = [rng.randint(1, 10**6) for _ in range(rng.randint(2, 9))]
        total = sum(tokens)
        goal = 0.9 * math.log(len(tokens))
        best = None
        for e in range(10_000, -1, -1):
            raw = [(t / total) ** (e / 10_000) for t in tokens]
            w = [x / sum(raw) for x in raw]
            budget = max(t / x for t, x in zip(tokens, w, strict=True))
            if -sum(x * math.log(x) for x in w) >= goal:
                best = best or w
                entropy_ok = e
                break
        for e in range(entropy_ok, 10_001):  # raised until nothing is repeated more than four times
            raw = [(t / total) ** (e / 10_000) for t in tokens]
            w = [x / sum(raw) for x in raw]
            budget = max(t / x for t, x in zip(tokens, w, strict=True))
            if max(x * budget / t for t, x in zip(tokens, w, strict=True)) <= 4:
                break
        plan = mixing.plan_weights([(f"s{k}", t, 1) for k, t in enumerate(tokens)], 0.9, 4.0)
        assert all(abs(p.weight - x) < 2e-3 for p, x in zip(plan, w, strict=True))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, "which river runs past the old stone tower in the north of the city of lights")], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, row_key string, n_removed long, old_length int, gone_id long, epoch int"


def odd_rows():
    more = ("k", 1, 2, 3, 4)
    body = "\n".join(f"{w} {w[::-1]} is what this line of a document is about" for w in ("river", "harbour", "tower", "bridge", "market", "garden", "winter", "engine", "letter", "copper"))
    return [
        (1, body, "en", "a", len(body), *more),
        (1, body, "en", "a", len(body), *more),
        (2, body.replace("bridge egdirb", "a rather different beginning"), "en", "a", 1, *more),
        (6, "\n".join(["one line that is there again and again"] * 30), "en", "a", 1, *more),
        (3, None, None, None, None, *[None] * 5),
        (4, "", "en", "a", 0, *more),
        (None, "a text without an id, which stays", "en", "b", 3, *more),
        (None, "so: which river runs past the old stone tower in the north of the city of lights", "en", "b", 3, *more),
        (5, "a text of one line, which is like no other here", "en", None, 5, *more),
    ]


def test_pipeline_stages_on_odd_rows(spark, tables):
    import corpus_pipeline

    docs = spark.createDataFrame(odd_rows(), DOCUMENTS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        assert name == "mixing" or out.columns == docs.columns
        assert stage(spark, docs.limit(0), tables).count() == 0
        ids = [r["doc_id"] for r in out.collect()]
        assert {3, 4, 5, 6, None} <= set(ids), name
        if name == "decontamination":
            assert ids.count(None) == 1
        if name == "line_dedup":  # what is a document's own stays, however little it is
            assert ids.count(1) == 2 and [r["text"] for r in out.collect() if r["doc_id"] == 2] == ["a rather different beginning is what this line of a document is about"]
