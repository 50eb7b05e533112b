"""Arrays of token ids: collation, also of texts without ids."""

import pytest
from pyspark.sql import functions as F

from tickloom.operators import tokens as X
from tickloom.plans import ORACLE_SQL, QUERIES

PAD, IGNORED = X.PAD, X.IGNORED


def test_batches_with_rows_of_no_ids(spark):
    rows = spark.createDataFrame([(0, 0, [5, 6, 7, 8]), (1, 0, [9]), (2, 0, []), (3, 0, None), (4, 1, []), (5, 1, None), (6, None, [5, 6])], "k long, batch long, ids array<int>")
    got = {r["k"]: (r["length"], r["input_ids"], r["labels"]) for r in X.collated(rows, ["batch"], "ids").collect()}
    assert got == {
        0: (3, [5, 6, 7], [6, 7, 8]),
        1: (3, [PAD] * 3, [IGNORED] * 3),
        2: (3, [PAD] * 3, [IGNORED] * 3),
        3: (3, [PAD] * 3, [IGNORED] * 3),
        4: (-1, [], []),
        5: (-1, [], []),
        6: (1, [5], [6]),
    }


def test_collated_documents_without_text_or_id(spark, small, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = [(1000, ""), (1001, None), (1002, "some text"), (1003, "a"), (2000, ""), (2001, None), (None, "a text"), (None, None), (-1, "ab cd"), (-7, "a text of more words"), (-9, "x y"), (2**62 + 7, "a b c d"), (2**62 + 8, "")]
    more = spark.createDataFrame([(k, t, "en", "web", len(t or "")) for k, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    docs.where("doc_id < 40").unionByName(more.select(*(F.col(c).cast(t).alias(c) for c, t in docs.dtypes))).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(ORACLE_SQL["x10_collated"]).fetchall()
    assert len(want) == 40 + len(odd)
    got = QUERIES["x10_collated"](spark, str(tmp_path)).select("doc_id", "n", "inputs", "labels").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
