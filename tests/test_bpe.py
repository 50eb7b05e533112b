"""Byte-pair training and encoding against plain single-process versions."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import bpe


def plain_training(words, n_merges, least=2):
    state = [(list(w.encode()), n) for w, n in words]
    out = []
    for rank in range(n_merges):
        counts = {}
        for ids, n in state:
            for pair in zip(ids, ids[1:]):
                counts[pair] = counts.get(pair, 0) + n
        if not counts:
            break
        pair, n = min(counts.items(), key=lambda x: (-x[1], x[0]))
        if n < least:
            break
        out.append((rank, *pair, n))
        state = [(plain_merge(ids, pair, bpe.BYTES + rank), n) for ids, n in state]
    return out


def plain_merge(ids, pair, made):
    out, k = [], 0
    while k < len(ids):
        if tuple(ids[k : k + 2]) == pair:
            out.append(made)
            k += 2
        else:
            out.append(ids[k])
            k += 1
    return out


def plain_encoding(word, merges):
    ids = list(word.encode())
    for m in merges:
        ids = plain_merge(ids, (m.left, m.right), m.made)
    return ids


def frame(spark, words):
    return spark.createDataFrame(words, "word string, n long")


@pytest.mark.parametrize("seed", range(4))
def test_training_against_a_plain_trainer(spark, seed):
    rng = random.Random(seed)
    letters = ["ab", "abcdefgh", "aé日", "abcdefghijklmnopqrstuvwxyz "][seed]
    words = {"".join(rng.choices(letters, k=rng.randint(1, 9))): rng.randint(1, 30) for _ in range(120)}
    words |= {"aaaaaaa": 9, "a": 100, "": 4}
    got = bpe.train(frame(spark, list(words.items())).repartition(3), 24)
    assert [(m.rank, m.left, m.right, m.count) for m in got] == plain_training(list(words.items()), 24)


def test_training_ends_where_nothing_is_frequent(spark):
    assert bpe.train(frame(spark, [("xy", 1), (None, 9), ("z", 5)]), 10) == []
    assert [(m.left, m.right, m.count) for m in bpe.train(frame(spark, [("xy", 2), ("xy", 3)]), 10)] == [(120, 121, 5)]
    assert bpe.train(frame(spark, []), 3) == []


def test_a_round_does_only_what_is_sure(spark):
    # the merge of a and b makes a pair as frequent as (c, d), with smaller ids than a later one
    words = [("abx", 10), ("cd", 9), ("ef", 10)]
    got = bpe.train(frame(spark, words), 6)
    assert [(m.rank, m.left, m.right, m.count) for m in got] == plain_training(words, 6)


def test_encoder_against_merges_one_by_one():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdé", k=rng.randint(0, 30))) for _ in range(300)]
    merges = [bpe.Merge(*m) for m in plain_training([(w, 1 + len(w)) for w in words], 60)]
    encoder = bpe.Encoder(merges, most=50)
    for w in [*words, "zzz", "aaaaaaaa", "ab" * 500]:
        assert encoder.word(w) == plain_encoding(w, merges)
        assert b"".join(bpe.token_bytes(merges)[i] for i in encoder.word(w)).decode() == w


TEXTS = ["", None, "Hello  world, it's 12 o'clock\n\n done ", " a \t b　 c  ", "x" * 50, "<chart> O_1 H_2000 C_7 </chart> then O_5 and </chart>", "naïve 日本語 text 😀", "O_1023O_1024", "a\u0000b"]


def test_ids_spell_the_text(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    merges = bpe.train(bpe.words_of(docs, "text"), 20)
    got = bpe.encoded(docs, "text", merges, prices=False).withColumn("back", bpe.decoded(F.col("ids"), merges)).orderBy("i").collect()
    assert [r["back"] for r in got] == TEXTS
    assert got[1]["ids"] is None and got[0]["ids"] == []
    pieces = docs.select("i", F.regexp_extract_all("text", F.lit(bpe.WORD), F.lit(0)).alias("p")).where("p IS NOT NULL").collect()
    import regex

    assert all(r["p"] == regex.findall(bpe.WORD, TEXTS[r["i"]]) for r in pieces)  # words are the same on both sides


def test_price_tokens_come_after_the_words(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    base = bpe.BYTES
    strict = {r["i"]: r["ids"] for r in bpe.encoded(docs, "text", [], strict=True).collect()}
    loose = {r["i"]: r["ids"] for r in bpe.encoded(docs, "text", [], strict=False).collect()}
    price = lambda ids: [i - base for i in ids if i >= base]
    assert price(strict[5]) == [4096, 1, 3 * 1024 + 7, 4097] and price(loose[5]) == [4096, 1, 3 * 1024 + 7, 4097, 5, 4097]
    assert price(strict[7]) == [] and price(loose[7]) == [1023]
    assert bytes(i for i in strict[5] if i < base).decode() == " H_2000  then O_5 and </chart>"


class _Map:
    """Stands for a table: gives the function that would run on its batches."""

    def __init__(self, schema):
        self.schema = schema

    def mapInArrow(self, run, schema):
        return run


def test_an_encoder_sends_rows_in_batches_of_bounded_size():
    import pyarrow as pa
    from pyspark.sql import types as T

    words = bpe.FLUSH // 8
    batch = pa.RecordBatch.from_arrays([pa.array(["ab " * words, None, ""] * 10)], names=["t"])
    run = bpe.encoded(_Map(T.StructType([T.StructField("t", T.StringType())])), "t", [bpe.Merge(0, 97, 98, 1)], prices=False)
    out = list(run(iter([batch])))
    assert sum(b.num_rows for b in out) == 30 and len(out) > 1
    assert all(sum(len(t.split()) for t in b.column("t").to_pylist() if t) <= bpe.FLUSH + words for b in out)
    assert out[0].column("ids").to_pylist()[:3] == [[256, *[32, 256] * (words - 1), 32], None, []]


def test_words_are_packed_many_a_row():
    import numpy as np
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([b"aaaa", b"", b"xaab"] * 1000), pa.array([3, 5, 2] * 1000)], names=["word", "n"])
    packed = list(bpe._cut(iter([batch.slice(1)])))
    assert [b.num_rows for b in packed] == [1]
    pairs = dict(zip(*(c.to_pylist() for c in next(bpe._pair_counts([bpe.Merge(0, 97, 97, 1)], 257)(iter(packed))).columns), strict=True))
    assert pairs == {256 * 257 + 256: 999 * 3, 120 * 257 + 256: 2000, 256 * 257 + 98: 2000}
    assert bpe._merged(np.array([97, 97, 97, bpe.GAP, 97, 97], np.int32), [bpe.Merge(0, 97, 97, 1)]).tolist() == [256, 97, bpe.GAP, 256]
