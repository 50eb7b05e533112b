"""The pipeline as it is run, and the tables that its stages write on their way."""

import os
import random
import threading
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tickloom.llm import common, line_dedup, mixing, near_dup, textnum


def there(spark):
    where = common.shared_dir(spark).removeprefix("file:")
    return {f for f in os.listdir(where) if f.startswith("stash-")}


def one(spark, k):
    return common.stash(spark.range(k), "one")


def test_scopes_are_nested(spark):
    before = there(spark)
    with common.working(spark) as keep:
        with common.working(spark) as inner:
            gone, kept = one(spark, 1), inner(one(spark, 2))
        assert kept.count() == 2 and not os.path.exists(gone._stash_path.removeprefix("file:"))
        top = keep(one(spark, 3))
    assert top.count() == 3
    assert there(spark) - before == {os.path.basename(top._stash_path)}


def test_scopes_end_with_an_exception(spark):
    before = there(spark)
    with pytest.raises(RuntimeError), common.working(spark), common.working(spark):
        one(spark, 1)
        raise RuntimeError
    assert there(spark) == before
    assert common._scopes.get() == ()


def test_threads_leave_each_others_tables_alone(spark):
    written, ended, seen = threading.Event(), threading.Event(), []

    def other():
        df = one(spark, 7)
        written.set()
        ended.wait(60)
        seen.append(df.count())

    with common.working(spark):
        thread = threading.Thread(target=other)
        thread.start()
        assert written.wait(60)
    ended.set()
    thread.join(60)
    assert seen == [7]


def test_run_of_given_documents(spark, small):
    before = there(spark)
    out = corpus_pipeline.run(spark, small)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = out.collect()
    ids = {r["doc_id"] for r in rows}
    assert 0 < len(ids) < docs.count() and set(docs.columns) <= set(out.columns)
    bench = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert not any(b in r["text"] for r in rows for b in bench)
    assert len(there(spark) - before) == 1  # the result's own


def test_near_copies_go_and_own_lines_stay(spark, small):
    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in ("a", "e", "io", "ou") for c in ("n", "r", "st", "lk", "m")]
    draw = lambda n: [rng.choice(words) for _ in range(n)]
    rows = []
    for i in range(10):  # one line each, so that the copies get through the line stage
        base = draw(300)
        rows.append((10 * i, " ".join(base)))
        for k in (1, 2):
            near = list(base)
            for at in rng.sample(range(300), 4):
                near[at] = rng.choice(words)
            rows.append((10 * i + k, " ".join(near)))
    shared = [" ".join(draw(12)) for _ in range(90)]
    rows += [(200 + k, "\n".join([line, " ".join(draw(12))])) for k, line in enumerate(shared)]
    own = [" ".join(draw(12)) for _ in range(10)]
    rows.append((900, "\n".join(shared + own)))  # nine tenths of its lines are others'
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    lines = common.settled(spark, lambda: corpus_pipeline.line_filter(spark, docs, small), "lines")
    assert lines.count() == len(rows)
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.near_duplicate_filter(spark, lines, small).collect()}
    assert kept[900] == "\n".join(own)
    assert set(kept) == {i for i, _ in rows} - {10 * i + k for i in range(10) for k in (1, 2)}


def test_components_end_when_edges_are_stars(spark, monkeypatch):
    def found(pairs):
        written = []
        with monkeypatch.context() as m:
            m.setattr(common, "stash", lambda df, name="t", real=common.stash: written.append(name) or real(df, name))
            rows = common.components(spark.createDataFrame(pairs, "a long, b long")).collect()
        assert len(rows) == len({r["node"] for r in rows})
        return {r["node"]: r["root"] for r in rows}, len(written)

    stars = [(10 * i, 10 * i + k) for i in range(5) for k in range(1, 6)]
    roots = {x: 10 * i for i in range(5) for x in range(10 * i, 10 * i + 6)}
    assert found([*stars, *stars, (7, 7), (None, 3)]) == (roots, 1)  # no round
    assert found([]) == ({}, 1)
    chain = [(k, k + 1) for k in range(40)]
    assert found([*chain, (100, 101)])[0] == dict.fromkeys(range(41), 0) | {100: 100, 101: 100}
    assert found([(1, 5), (2, 5), (2, 9), (3, 9), (20, 21)])[0] == dict.fromkeys((1, 2, 3, 5, 9), 1) | {20: 20, 21: 20}


def test_near_duplicates_leave_only_their_result(spark):
    before = there(spark)
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "x y"), (None, "a")], "doc_id long, text string")
    out = near_dup.near_duplicates(docs)
    assert len(there(spark) - before) == 1
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in out.collect() if r["doc_id"]) == [(1, 1, True), (2, 1, False), (3, 3, True)]


def test_few_rows_that_go_are_sent_to_the_texts(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x "), 200).alias("text"))
    out = corpus_pipeline._without(docs, "doc_id", spark.range(0, 1000, 10).select(F.col("id").alias("doc_id")))
    assert out.count() == 900
    assert "SortMergeJoin" not in out._jdf.queryExecution().sparkPlan().toString()


def test_sources_reach_the_plan_without_python_workers(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], "w " * (i % 7 + 1)) for i in range(60)], "doc_id long, source string, text string")
    plan = mixing.schedule(docs, block_tokens=50)
    assert {r["doc_id"] for r in plan.collect()} == set(range(60))
    assert "LogicalRDD" not in plan._jdf.queryExecution().analyzed().toString()


def _traced(run, batch):
    """MB of Python memory at most (numpy's included) while ``run`` works on one batch."""
    tracemalloc.start()
    for _ in run(iter([batch])):
        pass
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return most


def test_tasks_work_in_small_slices():
    rng = random.Random(3)
    word = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(3000)]
    texts = ["\n".join(" ".join(rng.choices(word, k=8)) for _ in range(40)) for _ in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array(texts)], names=["id", "text"])
    assert _traced(line_dedup._emit_lines(2, 20, 0), batch) < 40


def test_workers_give_memory_back_at_the_end_of_a_task(monkeypatch):
    said = []
    monkeypatch.setattr(textnum.pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda self: said.append("freed")})())
    run = textnum.freed(lambda batches: (said.append(x) or x for x in batches))
    assert list(run(iter([1, 2]))) == [1, 2] and said == [1, 2, "freed"]
    part = run(iter([3, 4]))  # a task that is not read to its end, as under a limit
    next(part)
    part.close()
    assert said[3:] == [3, "freed"]
