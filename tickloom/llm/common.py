"""What the operators share: tables written to the shared folder, components of a graph, folds of labels."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary one is set if all executors are in this process; else that is an error."""
    sc = spark.sparkContext
    where = sc.getCheckpointDir()
    if where is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            where = tempfile.mkdtemp(prefix="tickloom-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str = "t") -> str:
    """A path in the shared folder that nothing has; the open scopes delete what is written there."""
    path = f"{shared_dir(spark)}/stash-{name}-{uuid.uuid4().hex}"
    for made in _scopes.get():
        made.append(path)
    return path


def stash(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors.

    The frame that is returned reads the files lazily. ``drop_stash`` removes those that a loop has
    replaced, ``working`` those that only led to a result; what a result reads stays until the folder is cleared.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def drop_stash(df: DataFrame) -> None:
    """Delete the files of a stash that nothing reads any more."""
    path = getattr(df, "_stash_path", None)
    if path is not None:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: The lists of paths of the scopes that are open in this thread (or task), outermost first.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def working(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes every table that is written within, but those that the function it gives has been called with.

    Scopes can be nested; what an inner one keeps is still the outer one's to delete. A scope holds only what
    its own thread writes, so two queries of one session leave each other's tables alone.
    """
    made: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._stash_path)
        return df

    token = _scopes.set((*_scopes.get(), made))
    try:
        yield keep
    finally:
        _scopes.reset(token)
        for path in made:
            if path not in kept:
                _delete(spark, path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``make()`` written to the shared folder; every table that was written there on the way is deleted."""
    with working(spark) as keep:
        return keep(stash(make(), name))


def _stars(edges: DataFrame) -> bool:
    """True where each ``u`` of the edges has one ``v``, which is no edge's ``u``."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least")).where("up > 1 or up = 1 and least = 0").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of an edge list: root is the smallest node that it reaches.

    Alternates large-star and small-star steps, so the number of rounds is logarithmic in the
    longest path. Least neighbours are partial aggregates. They are joined back by another key than
    the aggregate's, so that both sides of the join are dealt anew and the adaptive planner can
    split a node with very many neighbours. Edges with a null end and loops are left out. The rounds
    end as soon as the edges are stars, which one aggregate tells.
    """
    pair = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v")
    now = stash(pair.distinct(), "edges")

    def with_least(rows: DataFrame, low: DataFrame) -> DataFrame:
        return rows.join(low.select(F.bitwise_not("u").alias("key"), "m"), F.bitwise_not(F.col("u")) == F.col("key"))

    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = with_least(both.where("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v"))  # a row an edge; what repeats goes below
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = with_least(large, low).select(F.explode(F.array(*(F.struct(F.col(c).alias("u"), F.col("m").alias("v")) for c in "uv"))).alias("e")).select("e.*")
        new = stash(small.where("u <> v").distinct(), "edges")
        drop_stash(now)
        now = new
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    out._stash_path = now._stash_path
    return out


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 1 modulo 3; such rows never train anything."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that clash with none of ``df`` (whatever their case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
