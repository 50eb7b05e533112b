"""Near-duplicate documents by circulant MinHash, with exact Jaccard verification.

A document's set holds the hashes of its runs of ``width`` words. Two fixed permutations make all
signature coordinates: the first scatters a set's elements over a ring, the second, shifted round
the ring by 0, 1, 2, ..., gives each coordinate its minimum. Bands of coordinates are buckets.

Within a bucket not all pairs are compared. Documents with equal sets are one class; each bucket
has one hub, its member that meets the most other documents over all its buckets; members are
verified against their hubs on full sets; links give components. What a bucket leaves open, pairs
of different components, is settled exactly. The members of such buckets are grouped by the
components that open buckets have in common. Two sets of a group that are alike enough share one of the rarest
runs of each, at a place that their sizes bound, so a document that shares no rare run with another
component is done with. Runs that few have give pairs, which are verified; the members with a rare
run that many share are compared in blocks of bounded size, which only links leave.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stash, working
from .textnum import U64, freed, mix64, shingle_sets, slices

RING = 1 << 17
BLOCK = 256
#: Members that may share a rare run for it to give pairs.
FEW = 64


def band_count(share: float, rows: int, miss: float = 1e-6) -> int:
    """Bands for which a pair of similarity ``share`` meets in none with a chance of at most ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - share**rows))


@cache
def _ring(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    scatter, order = rng.permutation(RING), rng.permutation(RING).astype(np.int32)
    turned = np.concatenate([order, order[: count - 1]])
    return scatter, np.lib.stride_tricks.sliding_window_view(turned, count)


def signature(hashes: np.ndarray, count: int) -> np.ndarray:
    """``count`` circulant MinHash coordinates of a non-empty set of 64-bit hashes."""
    scatter, turned = _ring(count)
    at = scatter[(hashes & U64(RING - 1)).astype(np.int64)]
    out = turned[at[:2048]].min(axis=0)
    for k in range(2048, len(at), 2048):
        np.minimum(out, turned[at[k : k + 2048]].min(axis=0), out=out)
    return out


def _sign(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                sets = shingle_sets(batch.column(1).slice(lo, hi - lo), width)
                sigs = np.zeros((len(sets), bands * rows), dtype=np.uint64)
                size, k1, k2 = (np.zeros(len(sets), dtype=np.int64) for _ in range(3))
                for i, x in enumerate(sets):
                    size[i] = len(x)
                    if len(x):
                        sigs[i] = signature(x, bands * rows)
                        k1[i], k2[i] = np.frombuffer(hashlib.blake2b(x.tobytes(), digest_size=16).digest(), dtype=np.int64)
                keys = np.zeros((len(sets), bands), dtype=U64)
                for k in range(rows):
                    keys = mix64(keys * U64(0x9E3779B97F4A7C15) + sigs[:, k::rows] + U64(1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(size), pa.array(k1), pa.array(k2), lists], names=["id", "n", "k1", "k2", "bands"])

    return run


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _verify(width: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, dtype=bool)
            left, right = batch.column(2), batch.column(3)
            for lo, hi in slices(left):
                a = shingle_sets(left.slice(lo, hi - lo), width)
                for lo2, hi2 in slices(right.slice(lo, hi - lo)):
                    b = shingle_sets(right.slice(lo + lo2, hi2 - lo2), width)
                    for k, y in enumerate(b):
                        x = a[lo2 + k]
                        both = _shared(x, y)
                        ok[lo + lo2 + k] = den * both >= num * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return run


def _tokens(width: int):
    """Sets as arrays of hashes, in which the group is mixed in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(3)):
                part = batch.slice(lo, hi - lo)
                group = mix64(part.column(2).to_numpy().view(U64))
                sets = [mix64(x ^ g) for x, g in zip(shingle_sets(part.column(3), width), group, strict=True)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], names=["node", "root", "tokens"])

    return run


def _compare(width: int, num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        """Links between members of different components: of the first half's rows with the second's."""
        table = table.combine_chunks()
        node, root, half = (table.column(c).to_numpy() for c in ("node", "root", "half"))
        column = table.column("text").chunk(0)
        sets: list[np.ndarray] = []
        for lo, hi in slices(column):
            sets += shingle_sets(column.slice(lo, hi - lo), width)
        own, others = np.flatnonzero(half == 0), np.flatnonzero(half == 1)
        sizes = np.array([len(x) for x in sets])
        joined: dict[int, int] = {}

        def top(x: int) -> int:
            while joined.get(x, x) != x:
                x = joined[x]
            return x

        token, of = np.concatenate([sets[i] for i in others]), np.repeat(others, sizes[others])
        order = np.argsort(token, kind="stable")
        token, of = token[order], of[order]
        links = []
        for i in own:
            lo, hi = np.searchsorted(token, sets[i], side="left"), np.searchsorted(token, sets[i], side="right")
            runs = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())
            both = np.bincount(of[at], minlength=len(sets))
            found = others[(den * both[others] >= num * (sizes[i] + sizes[others] - both[others])) & (root[others] != root[i])]
            for j in found:
                x, y = top(int(root[i])), top(int(root[j]))
                if x != y:  # one link of each pair of components is enough
                    joined[max(x, y)] = min(x, y)
                    links.append((int(node[i]), int(node[j])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    num: int = 80,
    den: int = 100,
    rows: int = 5,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Texts are lower-cased (A-Z only) and cut at ASCII white space; the set of a text is its
    distinct runs of ``width`` words, or all its words as one run if it has fewer. Documents link if
    den * intersection >= num * union; component_id is the smallest id that links reach.

    Null and empty texts have an empty set, link with nothing and keep their own id. Rows with the same id are
    one document, of which the smallest text counts for links. A null id gives a null component_id
    and is kept. Ids must be integers. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    with working(spark) as keep:
        bands = band_count(num / den, rows)
        base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        signed = stash(base.mapInArrow(freed(_sign(width, bands, rows)), "id long, n long, k1 long, k2 long, bands array<long>"), "signed")
        full = signed.where("n > 0 and id is not null")

        # equal sets, told by a digest of all their elements in order, are one class, named by its smallest id
        classes = full.groupBy("n", "k1", "k2").agg(F.min("id").alias("node"), F.min_by("bands", "id").alias("bands"))
        classes = stash(classes, "classes")
        member = classes.select("node", "n", F.posexplode("bands").alias("band", "key")).select("node", "n", F.xxhash64("band", "key").alias("key"))
        buckets = member.groupBy("key").agg(F.count("*").alias("met")).where("met > 1")
        # counts and hubs are joined back by another key than their own, so that a bucket with very many members can be split
        turned = F.bitwise_not(F.col("key"))

        def with_bucket(rows: DataFrame, of_bucket: DataFrame) -> DataFrame:
            return rows.join(of_bucket.withColumn("turned", turned).drop("key"), turned == F.col("turned")).drop("turned")

        member = stash(with_bucket(member, buckets), "member")
        fame = member.groupBy("node").agg(F.sum("met").alias("fame"))
        hubs = member.join(fame, "node").groupBy("key").agg(F.max(F.struct("fame", F.bitwise_not("node").alias("node"), "n")).alias("hub"))
        hubs = hubs.select("key", F.bitwise_not(F.col("hub.node")).alias("hub"), F.col("hub.n").alias("hub_n"))
        star = with_bucket(member, hubs).where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"), "n", "hub_n").distinct()
        star = stash(star, "star")
        close = star.where(den * F.least("n", "hub_n") >= num * F.greatest("n", "hub_n")).select("a", "b")

        named = star.select(F.col("a").alias("id")).unionByName(star.select(F.col("b").alias("id"))).distinct()
        texts = base.hint("merge").join(named, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
        texts = stash(texts, "texts")
        left, right = (texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
        pairs = close.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
        links = stash(pairs.mapInArrow(freed(_verify(width, num, den)), "a long, b long"), "links")
        found = stash(components(links), "found")

        # buckets with members of different components are open
        rooted = member.join(found, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
        open_ = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key", "lo")
        open_nodes = stash(with_bucket(rooted, open_).select("node", "root", "lo").distinct(), "open")
        more = _settle(open_nodes, texts, width, num, den)
        # what the links reach is stars already, which only the links between them join
        found = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

        named = classes.select("n", "k1", "k2", "node").join(found, "node", "left").select("n", "k1", "k2", F.coalesce("root", "node").alias("component"))
        out = signed.select("id", "n", "k1", "k2").join(named.withColumnRenamed("n", "n_").withColumnRenamed("k1", "k1_").withColumnRenamed("k2", "k2_"), (F.col("n") == F.col("n_")) & (F.col("k1") == F.col("k1_")) & (F.col("k2") == F.col("k2_")), "left")
        component = F.when(F.col("id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "id"))
        out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
        return keep(stash(out, "near"))  # a few numbers a document; bands and classes go


def _settle(open_nodes: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links between different components that share an open bucket; ``lo`` is the least component of a bucket."""
    group = stash(components(open_nodes.select(F.col("root").alias("a"), F.col("lo").alias("b"))), "groups")
    nodes = open_nodes.select("node", "root").distinct().join(group.select(F.col("node").alias("root"), F.col("root").alias("grp")), "root")
    nodes = stash(nodes, "nodes")
    texts = texts.withColumnRenamed("id", "node")
    pairs, crowded = _rare(nodes.join(texts, "node").select("node", "root", "grp", "text"), width, num, den)
    left, right = (texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    links = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(freed(_verify(width, num, den)), "a long, b long")
    nodes = nodes.join(crowded, "node")
    sized = nodes.groupBy("grp", "root").agg(F.count("*").alias("k"))
    main = sized.groupBy("grp").agg(F.max(F.struct("k", "root")).getField("root").alias("main"), F.sum("k").alias("size"), F.max("k").alias("most"))
    nodes = nodes.join(main, "grp").select("node", "root", "grp", (F.col("root") == F.col("main")).alias("in_main"), "size", "most")
    # the largest component's members are compared with the others' only; those are compared with all
    cut = lambda n: F.greatest(F.ceil(n / F.lit(BLOCK)), F.lit(1)).cast("int")
    nodes = nodes.withColumn("rest", cut(F.col("size") - F.col("most"))).withColumn("bulk", cut(F.col("most")))
    at = F.when(F.col("in_main"), F.pmod(F.hash("node"), "bulk")).otherwise(F.pmod(F.hash("node"), "rest"))
    nodes = nodes.withColumn("at", at).join(texts, "node")
    row = lambda x, y, h: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), F.lit(h).alias("half"))
    of_main = F.transform(F.sequence(F.lit(0), F.col("rest") - 1), lambda r: row(r, F.col("rest") + F.col("at"), 1))
    own = F.transform(F.sequence(F.lit(0), F.col("rest") + F.col("bulk") - 1), lambda y: row(F.col("at"), y, 0))
    other = F.transform(F.sequence(F.lit(0), F.col("rest") - 1), lambda r: row(r, F.col("at"), 1))
    # of two blocks of the rest, the pair (x, y) with x <= y is enough
    own, other = (F.filter(c, lambda s: s.x <= s.y) for c in (own, other))
    dealt = nodes.withColumn("to", F.explode(F.when(F.col("in_main"), of_main).otherwise(F.concat(own, other))))
    dealt = dealt.select("grp", "to.x", "to.y", "to.half", "node", "root", "text")
    return stash(links.unionByName(dealt.groupBy("grp", "x", "y").applyInArrow(_compare(width, num, den), "a long, b long")), "settled")


def _rare(rows: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a, b`` of different components that share a rare run which few have, and the members (``node``) with one that many have.

    Runs are ordered by how many of the group have them. Sets of sizes n <= m that are alike enough have
    c = num * (n + m) / (den + num) runs in common or more; the first of those, in that order, is
    then at a place before n - c + 1 in the one and before m - c + 1 in the other.
    """
    sets = rows.mapInArrow(freed(_tokens(width)), "node long, root long, tokens array<long>")
    each = stash(sets.select("node", "root", F.size("tokens").alias("n"), F.explode("tokens").alias("token")), "runs")
    # counts are joined back by another key than their own, so that a very common run can be split
    count = each.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select(F.bitwise_not("token").alias("key"), "k")
    ordered = each.join(count, F.bitwise_not(F.col("token")) == F.col("key"), "left").groupBy("node", "root", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("k", F.lit(1)).alias("k"), "token"))).alias("runs"))
    head = ordered.select("node", "root", "n", F.posexplode(F.slice("runs", F.lit(1), (F.col("n") - F.floor((F.col("n") * num + den - 1) / den) + 1).cast("int"))).alias("at", "run"))
    head = stash(head.where("run.k > 1").select("node", "root", "n", "at", F.col("run.token").alias("token")), "rare")
    shared = head.groupBy("token").agg(F.count("*").alias("k"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select(F.bitwise_not("token").alias("key"), "k")
    head = stash(head.join(shared, F.bitwise_not(F.col("token")) == F.col("key")).select("node", "root", "n", "at", "token", "k"), "shared")
    few, many = head.where(F.col("k") <= FEW), head.where(F.col("k") > FEW)
    a, b = (few.select("token", *(F.col(x).alias(f"{x}_{c}") for x in ("node", "root", "n", "at"))) for c in "ab")
    common = F.floor((num * (F.col("n_a") + F.col("n_b")) + den + num - 1) / (den + num))
    smaller = (F.col("n_a") < F.col("n_b")) | (F.col("n_a") == F.col("n_b")) & (F.col("node_a") < F.col("node_b"))
    near = (den * F.col("n_a") >= num * F.col("n_b")) & (F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= common)
    pairs = a.join(b, "token").where((F.col("root_a") != F.col("root_b")) & smaller & near)
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), many.select("node").distinct()
