"""Every operator on rows that are out of the ordinary."""

import pytest
from pyspark.sql import functions as F

from tickloom.llm import chat, decontam, fingerprint, language, line_dedup, mixing, near_dup, pii, secrets, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, root string, key string, n_lines int, block int"
BENCH = "item_id long, text string"
LABELS = "doc_id long, quality int, toxic int"
LONG = " ".join(f"word{k % 977}x{k % 13}" for k in range(40_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 5, "n", "r", "k", 1, 2),
    (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 5, "n", "r", "k", 1, 2),
    (2, None, None, None, None, None, None, None, None, None),
    (3, "", "de", "a", 0, "n", "r", "k", 1, 2),
    (4, "\n\n", "de", "b", 2, "n", "r", "k", 1, 2),
    (None, "a text without an id, mail a.b@c.com and password=abcdef123", "en", "b", 9, "n", "r", "k", 1, 2),
    (5, LONG, "en", "b", 9, "n", "r", "k", 1, 2),
    (6, "12345 .. !! 678", None, "b", 9, "n", "r", "k", 1, 2),
    (7, "the quick brown fox jumps over the lazy dog near the river bank today!", "en", "c", 9, "n", "r", "k", 1, 2),
    (8, "\U0001f600 ünïcödé \x00 text\twith odd chars   and more", "fr", "c", 9, "n", "r", "k", 1, 2),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "brown fox jumps over the lazy dog near the river"), (2, None), (3, ""), (None, "x y z"), (4, "unrelated words that are nowhere else to be found here")], BENCH)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (6, None, None), (None, 1, 1), (99, 1, 1)], LABELS)


def run(name, docs, bench, labels):
    return {
        "toxicity": lambda: toxicity.score(docs, toxicity.train(docs, labels)),
        "fingerprint": lambda: fingerprint.fingerprints(docs),
        "secrets": lambda: secrets.scan(docs),
        "near_dup": lambda: near_dup.near_duplicates(docs),
        "line_dedup": lambda: line_dedup.dedup_lines(docs),
        "mixing": lambda: mixing.mix(docs),
        "language": lambda: language.predict(docs, language.train(docs)),
        "pii": lambda: pii.find(docs),
        "decontam": lambda: decontam.find_leaks(docs, bench),
    }[name]()


NAMES = ["toxicity", "fingerprint", "secrets", "near_dup", "line_dedup", "language", "pii", "decontam"]


@pytest.mark.parametrize("name", NAMES)
def test_a_row_for_every_row(name, docs, bench, labels):
    out = run(name, docs, bench, labels).collect()
    assert len(out) == len(ROWS)
    assert sorted((r["doc_id"] for r in out), key=str) == sorted((r[0] for r in ROWS), key=str)


@pytest.mark.parametrize("name", [*NAMES, "mixing"])
def test_empty_table(name, none, bench, labels):
    assert run(name, none, bench, labels).count() == 0


def test_mixing_takes_every_document(docs):
    # the two rows of document 1 are one document; each comes back as often as it is taken
    out = mixing.mix(docs).collect()
    assert {r["doc_id"] for r in out} == {r[0] for r in ROWS}
    assert {"_block", "epoch", "position", "block"} <= set(out[0].asDict())


def test_repeated_rows_get_the_same(docs, bench, labels):
    for name in NAMES:
        one = [r.asDict(recursive=True) for r in run(name, docs, bench, labels).where("doc_id = 1").collect()]
        assert len(one) == 2 and one[0] == one[1], name


def test_null_and_empty_texts(docs, bench, labels):
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(docs, width=3).collect()}
    assert got[2]["n_shingles"] == got[3]["n_shingles"] == got[4]["n_shingles"] == 0
    assert got[2]["component_id"] == 2 and got[2]["kept"]
    assert got[None]["component_id"] is None and got[None]["kept"]
    spoken = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, language.train(docs)).collect()}
    assert spoken[2] == spoken[3] == spoken[6] == "und" != spoken[1]
    found = {r["doc_id"]: r for r in decontam.find_leaks(docs, bench).collect()}
    assert found[1]["items"] == "1" and found[7]["items"] == "1" and not found[2]["contaminated"]
    texts = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert texts[2] is None and texts[3] == "" and texts[7] == ""  # one edit from document 1
    assert texts[1] == ROWS[0][1]


def test_chat_edges(spark):
    turns = spark.createDataFrame([(1, 0, "user", None), (1, 0, "user", None), (2, None, None, "x"), (None, 1, "assistant", ""), (3, 2, "tool", "a\\[b<c")], "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.format_conversations(turns).withColumn("back", chat.read_back(F.col("formatted"))).collect()}
    assert [t["text"] for t in out[1]["back"]] == ["", ""] and not out[1]["valid"] and out[1]["bad_turn"] == 1
    assert out[2]["back"][0]["role"] == "" and not out[2]["valid"]
    assert out[3]["back"][0]["role"] == "tool" and out[3]["back"][0]["text"] == "a\\[b<c"
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_very_long_turns_and_conversations(spark):
    long = "</s>[INST] word " * 60_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long)] + [(2, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(4000)]
    got = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumn("back", chat.read_back(F.col("formatted"))).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["back"]] == [("user", long), ("assistant", long)]
    assert [t["text"] for t in got[2]["back"]] == [f"turn {k}" for k in range(4000)] and got[2]["valid"]
