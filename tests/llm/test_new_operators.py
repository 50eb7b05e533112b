"""Operators 11 to 13 against brute force and round trips."""

import gzip
import hashlib
import io
import random
import zlib

import pytest

from tickloom.llm import align, queries, trie, warc

# prefix trie


def brute_trie(convs):
    """``convs``: id -> list of (role, text)."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q != p and q[: len(p)] == p for q in below)]
        saved = sum((len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0) for p in below)
        ends = sorted(c for c in members if len(convs[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(children), len(leaves), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def some_convs(rng, n, turns=5, words=3):
    said = [("user", "a" * k) for k in range(words)] + [("assistant", f"b{k}") for k in range(words)]
    return {c * 7 - 20: [rng.choice(said) for _ in range(rng.randint(0, turns))] for c in range(n)}


TURNS = "conv_id long, turn long, role string, text string, cell string, node string"


def turns_of(spark, convs):
    rows = [(c, k, *t, "x", "y") for c, ts in convs.items() for k, t in enumerate(ts)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, TURNS)


@pytest.mark.parametrize("ranges", [1, 4, 40])
def test_trie_against_brute_force(spark, ranges):
    convs = {c: t for c, t in some_convs(random.Random(ranges), 150).items() if t}
    convs |= {1000 + k: [("user", "a"), ("assistant", "b1")] for k in range(60)}  # one that many are
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = sorted((tuple(r) for r in trie.prefix_trie(trie.turn_cells(turns_of(spark, convs))).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute_trie(convs)


def test_trie_of_odd_rows(spark):
    long = [("user", f"turn {k}") for k in range(3000)]
    rows = [(1, None, "user", "first", "", ""), (1, 0, None, None, "", ""), (1, 1, "user", "x", "", ""), (2, 5, "user", "first", "", ""), (None, 0, "user", "no one's", "", "")]
    rows += [(c, k, *t, "", "") for c in (-7, 9) for k, t in enumerate(long)]
    got = {(r["conv_id"], r["depth"]): r for r in trie.prefix_trie(trie.turn_cells(spark.createDataFrame(rows, TURNS))).collect()}
    assert got[-7, 0]["n_convs"] == 4 and got[-7, 0]["n_children"] == 2 and got[-7, 0]["n_leaves"] == 2
    assert got[1, 1]["n_convs"] == 2 and got[1, 1]["saved_tokens"] == len("first") and got[1, 2]["parent_conv_id"] == 1
    assert got[-7, 3000]["ends_sha256"] == hashlib.sha256(b"-7,9").hexdigest() and len(got) == 3000 + 1 + 3
    assert trie.prefix_trie(trie.turn_cells(spark.createDataFrame([], TURNS))).count() == 0


def test_turnless_conversations_end_at_the_root(spark):
    convs = spark.createDataFrame([(3, []), (4, []), (5, ["00" * trie.CELL])], "conv_id long, cells array<string>")
    got = {(r["conv_id"], r["depth"]): r for r in trie.prefix_trie(convs).collect()}
    assert got[3, 0]["ends_sha256"] == hashlib.sha256(b"3,4").hexdigest() and got[3, 0]["n_convs"] == 3 and got[3, 0]["n_leaves"] == 1


def test_merge_looks_at_no_shared_cell_twice():
    rng = random.Random(3)
    deep = b"".join(bytes([7]) * trie.CELL for _ in range(50))
    rows = sorted({(deep + bytes(rng.choices(range(4), k=3)) * (trie.CELL // 3) * rng.randint(0, 3), k, 1) for k in range(400)})
    strings = {r[0]: r for r in rows}
    runs = [r for r in trie.form_runs(iter(rng.sample(list(strings.values()), len(strings))), 0, most_rows=37)]
    assert len(runs) > 2 and all(r[2] == trie.shared_cells(before[3] if before else b"", r[3]) for run in runs for before, r in zip([None, *run], run))
    tree = trie.LoserTree(trie.in_runs(row for run in runs for row in run))
    merged = list(tree)
    assert [m[1][0] for m in merged] == sorted(strings)
    assert all(lcp == trie.shared_cells(merged[k - 1][1][0] if k else b"", row[0]) for k, (lcp, row) in enumerate(merged))
    shuffled = [row for run in runs for row in run]
    rng.shuffle(shuffled)  # rows of a range can come in any order
    assert list(trie.LoserTree(trie.in_runs(iter(shuffled)))) == merged


def test_rebuilt_conversations(spark):
    convs = {c: [("user", f"{c} {k}") for k in range(c % 9)] for c in (*range(0, 210, 3), 300, 305, 407)}
    rows = [(c, k, *t, "", "") for c, ts in convs.items() for k, t in enumerate(ts)]
    convs = {c: t for c, t in convs.items() if t}
    want = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        want[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    got = sorted((tuple(r) for r in trie.prefix_trie(queries._rebuilt(trie.turn_cells(spark.createDataFrame(rows, TURNS)))).collect()), key=str)
    assert got == brute_trie(want)


# alignment


def brute_alignments(texts):
    """Whole texts, without segments: rows of the query, from a scan of byte positions."""
    t, a_bytes = align.byte_tokenizer(align.A_PATH)
    sp, b_bytes = align.piece_tokenizer(align.B_PATH)
    rows, links = [], []
    for text in texts:
        a = t.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        whole = f" {text}".encode()
        if not text or b"".join(a_bytes[i] for i in a) != whole or b"".join(b_bytes[i] for i in b) != whole:
            rows.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        spans = []
        for ids, table in ((a, a_bytes), (b, b_bytes)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(table[i]), i))
                at += len(table[i])
            spans.append(out)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, low = [], 0
        for high in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in side if s >= low and e <= high) for side in spans))
            low = high
        pairs = [(i, j) for s, e, i in spans[0] for u, v, j in spans[1] if s < v and u < e]
        links.append(pairs)
        rows.append((len(a), len(b), len(groups), len(pairs), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = {}
    for pairs in links:
        for p in set(pairs):
            count[p] = count.get(p, 0) + 1
    most = {}
    for (i, _), n in count.items():
        most[i] = max(most.get(i, 0), n)
    return [(*r[:4], sum(count[p] == most[p[0]] for p in pairs), sum(count[p] for p in pairs), r[4]) for r, pairs in zip(rows, links, strict=True)]


ODD = [
    "", None, " ", "   ", "foo", "foo  bar", "  foo", "foo ", "foo   ", "a  b", "\n", " \n x", "x \n y\n\n z", "tab\t tab \t x", "▁x y", "a ▁b c", "<s>x</s> <|endoftext|> y", "<0x0A> \x00 z",
    "\r\n a\r b", "﻿x ​q", "😀 😀😀 ünïcödé naïve", "ｆｕｌｌ ｗｉｄｔｈ", "don't we'll I'm 'tis 's", "1234 56,789 0.5 $5", "日本語 の 文章 です", "é é ́x", " em 　wide x　 y", "a\x1c b \x1f c \x85 d", "....  !!! ?  -- x", "#" * 300, "x" * 999 + " y",
]


def test_alignment_against_whole_texts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("text").limit(60).collect()
    rng = random.Random(5)
    letters = ["a", "b", " ", "  ", " \n", "\t", "é", "'s", "9", ".", "　", "the", " The", "▁", "😀", " "]
    texts = ODD + [r["text"] for r in docs] + ["".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(400)] + ["foo  bar"] * 5
    ids = [None if k % 50 == 3 else k // 2 for k in range(len(texts))]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, n_a int, chunk string").repartition(3)
    got = align.alignments(df, groups=True).collect()
    want = sorted(((i, *r) for i, r in zip(ids, brute_alignments(texts), strict=True)), key=str)
    assert sorted(((r["doc_id"], *(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))) for r in got), key=str) == want
    assert all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] for r in got if r["n_a"])


def test_alignment_in_many_chunks_and_without_rows(spark, monkeypatch):
    texts = [f"word{k % 37} and  the {k % 11} rest of it\n" * (k % 5) for k in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    one = sorted(map(tuple, align.alignments(df).collect()))
    assert [r[1:8] for r in one] == brute_alignments(texts)
    monkeypatch.setattr(align, "CHUNK", 400)
    assert sorted(map(tuple, align.alignments(df).collect())) == one
    monkeypatch.setattr(align, "check_cuts", lambda *_: False)  # whole texts are the segments then
    assert sorted(map(tuple, align.alignments(df).collect())) == one
    assert align.alignments(df.limit(0)).count() == 0


def test_cuts_hold_for_the_given_files_only():
    assert align.check_cuts(align.A_PATH, align.B_PATH)
    assert not align.check_cuts(align.A_PATH.replace("byte_bpe_50k", "word_bpe_49k"), align.B_PATH)


# archives


PAGES = "page_id long, url string, html string, digest string, first long"


def pages_of(spark):
    same, small = "<p>" + "é" * 60 + "</p>", "short"
    rows = [(5, "http://a/1 2\r\nX: y", same), (3, "http://a/3", same), (9, None, same), (None, "http://n", same), (7, "u", small), (8, "u", small), (10, "u", None), (11, "u", ""), (12, "u", "WARC/1.1\r\n\r\n\x1f\x8b\r\n\r\n" * 9), (13, "u", "x" * 3_000_000), (14, "u", "y" * 100), (15, "u", "y" * 100), (16, "u", "z" * 99), (17, "u", "z" * 99), (3, "http://a/3", same)]
    return rows, spark.createDataFrame([(*r, "d", 1) for r in rows], PAGES)


def expected(rows):
    texts = [r[2] or "" for r in rows]
    out = []
    for (page, _, _), text in zip(rows, texts, strict=True):
        data = text.encode()
        same = [r[0] for r, t in zip(rows, texts, strict=True) if t == text and r[0] is not None]
        first = min(same, default=None) if len(data) >= 100 else None
        revisit = first is not None and first != page
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_archives_round_trip(spark):
    from tickloom.llm.common import stash

    rows, pages = pages_of(spark)
    manifest = stash(warc.write_archives(pages.repartition(3), archive_bytes=500))
    assert sum(r["records"] for r in manifest.collect()) == len(rows) and manifest.count() > 3
    got = warc.resolved(warc.read_archives(manifest, payloads=True)).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == expected(rows)
    assert all(r["verified"] and r["error"] is None for r in got)
    texts = {(r[0]): (r[2] or "").encode() for r in rows}
    assert all(r["payload"] == texts[r["page_id"]] for r in got if r["record_type"] == "response" and r["page_id"] is not None)
    for r in manifest.collect():  # any tool can read them, a member at a time or as one stream
        raw = open(r["path"].removeprefix("file:"), "rb").read()
        assert len(raw) == r["bytes"] and gzip.decompress(raw).count(b"WARC-Record-ID: ") == r["records"]
    none = stash(warc.write_archives(pages.limit(0)))
    assert none.count() == 0 and warc.resolved(warc.read_archives(none)).count() == 0


def archive(*payloads):
    return [warc.member(k, f"http://x/{k}", p, hashlib.sha256(p).hexdigest(), None, "2000-01-01T00:00:00Z") for k, p in enumerate(payloads)]


class Drip(io.BytesIO):
    """Gives a few bytes at a time."""

    def read(self, n=-1):
        return super().read(min(n, 7) if n > 0 else n)


def test_reader_takes_pieces_of_any_size(monkeypatch):
    rng = random.Random(9)
    payloads = [rng.randbytes(k) for k in (0, 1, 5000, 70_000)] + [b"a" * 200_000]
    raw = b"".join(archive(*payloads))
    monkeypatch.setattr(warc, "PIECE", 512)
    for stream in (io.BytesIO(raw), Drip(raw)):
        got = list(warc.read_stream(stream, "x", payloads=True))
        assert [r["payload"] for r in got] == payloads and all(r["payload_ok"] and r["block_ok"] for r in got)
        assert [r["offset"] for r in got] == [sum(map(len, archive(*payloads)[:k])) for k in range(5)]


def test_damaged_records_are_told_and_passed(monkeypatch):
    payloads = [bytes([65 + k]) * 300 + random.Random(k).randbytes(400) for k in range(6)]
    for piece in (1 << 18, 64):
        monkeypatch.setattr(warc, "PIECE", piece)
        parts = archive(*payloads)
        parts[1] = parts[1][:300] + b"\x00\xff" * 20 + parts[1][340:]  # bytes overwritten
        parts[3] = parts[3][: len(parts[3]) // 2]  # cut short
        parts[5] = parts[5][:-30]  # the archive ends within it
        got = list(warc.read_stream(io.BytesIO(b"".join(parts)), "x"))
        fine = [r["page_id"] for r in got if not r.get("error")]
        assert {0, 2, 4} <= set(fine) and not {1, 3, 5} & set(fine)
        assert len([r for r in got if r.get("error")]) >= 3
    wrong = zlib.compressobj(6, zlib.DEFLATED, warc.GZIP)
    text = gzip.decompress(archive(b"abc" * 50)[0]).replace(b"abcabc", b"abcabd", 1)
    raw = wrong.compress(text) + wrong.flush()
    row = next(warc.read_stream(io.BytesIO(raw), "x"))
    assert row["block_ok"] is False and row["payload_ok"] is False  # a digest that is not that of the bytes
    for bad in (text[:-2], text + b"more", b"HTTP/1.1 200\r\n\r\n"):
        assert next(warc.read_stream(io.BytesIO(gzip.compress(bad)), "x"))["error"]
