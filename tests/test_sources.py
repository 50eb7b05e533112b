"""Readers of files that are not tables, and orders of columns of any values."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tickloom.functions.ranking import with_order
from tickloom.operators import corpus, mixer
from tickloom.sources import readers, sinks


def test_row_groups_of_several_files(spark, tmp_path):
    tables = {"a b.parquet": [3, None, 5, 7, 11], "c%20d.parquet": [1, 2]}
    for name, sizes in tables.items():
        pq.write_table(pa.table({"text": ["x"] * len(sizes), "token_length": pa.array(sizes, pa.int64())}), tmp_path / name, row_group_size=2)
    got = sorted((r["file"].rsplit("/", 1)[1], r["row_group"], r["rows"], r["tokens"]) for r in readers.row_groups(spark, f"{tmp_path}/*.parquet", "token_length").collect())
    assert [x[1:] for x in got] == [(0, 2, 3), (1, 2, 12), (2, 1, 11), (0, 2, 3)]
    assert "tokens" not in readers.row_groups(spark, f"{tmp_path}/*.parquet").columns
    units = mixer.units_of_row_groups(readers.row_groups(spark, f"{tmp_path}/*.parquet", "token_length"), "books")
    plan = mixer.mix_plan(units, {"books": 1.0}, 5, 20, 100).collect()
    assert sorted(r["tokens"] for r in plan) == [3, 3, 11, 12]


def test_page_lines_of_binary_documents(spark, tmp_path):
    def extract(content):
        pages = content.decode().split("\f")
        return [(p, k, line, float(k), float(k + 1)) for p, page in enumerate(pages, 1) for k, line in enumerate(page.split("\n"))]

    (tmp_path / "one.txt").write_bytes(b"first\nsecond\fthird")
    (tmp_path / "bad.txt").write_bytes(b"\xff")
    (tmp_path / "none.txt").write_bytes(b"")
    rows = readers.page_lines(spark, str(tmp_path), extract).collect()
    own = {}
    for r in rows:
        own.setdefault(r["doc"].rsplit("/", 1)[1], []).append((r["page"], r["line_no"], r["text"]))
    assert sorted(own["one.txt"]) == [(1, 0, "first"), (1, 1, "second"), (2, 0, "third")]
    assert "none.txt" not in own and own["bad.txt"][0][0] is None and "Unicode" in own["bad.txt"][0][2]


def test_csv_positions_of_many_pieces(spark, tmp_path):
    rows = [(float(k), k + 1.0, k - 1.0, k + 0.5) for k in range(5000)]
    for part in range(3):
        lines = ["Open,High,Low,Close"] + [",".join(map(str, r)) for r in rows[part * 1700 : (part + 1) * 1700]]
        (tmp_path / f"{part}.csv").write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = readers.ohlc_csv(spark, str(tmp_path), "X").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r["idx"], r["open"]) for r in got) == [(k, float(k)) for k in range(5000)]


@pytest.mark.parametrize("outlier", [2**63 - 1, -(2**63)])
def test_order_of_any_values(spark, outlier):
    values = [None, outlier, 0, *range(-50, 50), *range(10**9, 10**9 + 50)]
    df = spark.createDataFrame([(v,) for v in values], "id long")
    got = {r["id"]: r["rank"] for r in with_order(df, "id").where("id is null or id <> 0").collect()}
    want = sorted(values, key=lambda v: (v is not None, v or 0))
    assert all(want[k - 1] == v for v, k in got.items()) and len(got) == len(set(values)) - 1
    assert with_order(df.limit(0), "id").count() == 0


def test_weighted_turns(spark):
    rows = [("a", k) for k in range(60)] + [("b", k) for k in range(10)] + [("c", k) for k in range(4)]
    df = spark.createDataFrame(rows, "source string, id long")
    first = corpus.interleave_weighted(df, "source", "id", {"a": 0.6, "b": 0.4}).collect()
    assert sum(r["source"] == "a" for r in first) == 15 and sum(r["source"] == "b" for r in first) == 10
    every = corpus.interleave_weighted(df, "source", "id", {"a": 0.6, "b": 0.4}, "all_exhausted").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("id").alias("d")).collect()
    assert {r["source"]: (r["n"], r["d"]) for r in every} == {"a": (60, 60), "b": (40, 10)}


def test_unit_rows_read_their_row_groups_only(spark, tmp_path):
    n = 40
    table = pa.table({"id": range(n), "text": [f"t{k}" for k in range(n)], "other": ["x" * 10] * n})
    pq.write_table(table, tmp_path / "a.parquet", row_group_size=8)
    pq.write_table(table.slice(0, 0), tmp_path / "none.parquet")
    units = readers.row_groups(spark, f"{tmp_path}/*.parquet")
    some = readers.unit_rows(units.where("row_group IN (1, 4)"), "text string, id long").collect()
    assert sorted((r["row_group"], r["position"], r["id"], r["text"]) for r in some) == [(g, k, 8 * g + k, f"t{8 * g + k}") for g in (1, 4) for k in range(8)]
    mix = mixer.mix_plan(mixer.units_of_row_groups(units, "books", "rows"), {"books": 1.0}, 5, 16, 100)
    for part in range(2):  # a part of the mix is two row groups here
        own = mix.where(F.col("part") == part).join(units.select("file", "row_group"), ["file", "row_group"])
        assert readers.unit_rows(own, "id long").count() == 16


def test_only_changed_files_are_built_again(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "cache")
    source.mkdir()
    built = spark.sparkContext.accumulator(0)

    def build(df):
        def count(batches):
            for b in batches:
                built.add(b.num_rows)
                yield b

        return df.withColumn("n", F.length("text").cast("long")).mapInArrow(count, "id long, text string, shard_ long, n long")

    def write(name, k):
        pq.write_table(pa.table({"id": pa.array([k, k + 1], pa.int64()), "text": ["x" * k, "y"]}), source / name)

    def run(version="1"):
        before = built.value
        rows = sorted((r["id"], r["n"]) for r in sinks.cached_shards(spark, path, str(source), build, version).collect())
        return rows, built.value - before

    write("a.parquet", 10), write("b c.parquet", 20), write("d.parquet", 30)
    assert run() == ([(10, 10), (11, 1), (20, 20), (21, 1), (30, 30), (31, 1)], 6)
    assert run()[1] == 0
    write("b c.parquet", 25)
    assert run() == ([(10, 10), (11, 1), (25, 25), (26, 1), (30, 30), (31, 1)], 2)
    (source / "a.parquet").unlink()
    write("e.parquet", 40)
    assert run() == ([(25, 25), (26, 1), (30, 30), (31, 1), (40, 40), (41, 1)], 2)
    assert run("2")[1] == 6
    kept = [p for p in (tmp_path / "cache").glob("shards-*/shard_=*")]
    assert len(kept) == 3  # old shards are gone


def test_append_is_resumed_without_loss_or_repetition(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    for k in range(5):
        pq.write_table(pa.table({"id": pa.array([10 * k, 10 * k + 1], pa.int64())}), f"{source}/{k}.parquet")

    def fault(number):
        if number == 2:
            raise RuntimeError("killed")

    with pytest.raises(StreamingQueryException):
        sinks.append_stream(spark, source, "id long", target, state, files=1, fault=fault)
    read = lambda: sorted(r["id"] for r in spark.read.schema("id long").option("recursiveFileLookup", "true").parquet(target).collect())
    assert len(read()) == 6  # the third batch is there, but not committed
    sinks.append_stream(spark, source, "id long", target, state, files=1)
    assert read() == [10 * k + j for k in range(5) for j in (0, 1)]
    pq.write_table(pa.table({"id": pa.array([99], pa.int64())}), f"{source}/9.parquet")
    sinks.append_stream(spark, source, "id long", target, state, files=1)
    assert read()[-1] == 99 and len(read()) == 11
