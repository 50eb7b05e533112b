"""Sinks: distributed writes; one file only where it is asked for."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CORPUS = "text string, source string, token_length long, meta string"


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share. Where that is unset, a temporary one if all executors are in this process; else that is an error."""
    sc = spark.sparkContext
    base = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tickloom-")
    return f"{base}/{uuid.uuid4().hex}"


def materialised(df: DataFrame, rows_a_file: int = 0) -> DataFrame:
    """``df`` written once and read back, for plans that use it in many places. Files of few rows (``rows_a_file``) keep a reader's batch small where rows are large."""
    path = scratch(df.sparkSession)
    df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the files of a ``materialised`` table that nothing reads any more."""
    target, fs = _path(df.sparkSession, df._scratch_path)
    fs.delete(target, True)


def to_corpus(df: DataFrame) -> DataFrame:
    """``df`` in the corpus schema; missing columns get empty values."""
    empty = {"text": F.lit(""), "source": F.lit(""), "token_length": F.lit(0), "meta": F.lit("{}")}
    kinds = {"text": "string", "source": "string", "token_length": "long", "meta": "string"}
    return df.select(*(F.coalesce(F.col(c) if c in df.columns else v, v).cast(kinds[c]).alias(c) for c, v in empty.items()))


def write_parquet(df: DataFrame, path: str, one_file: bool = False, compression: str = "snappy", mode: str = "errorifexists") -> None:
    (df.coalesce(1) if one_file else df).write.mode(mode).option("compression", compression).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, header=True)


def append_log(df: DataFrame, path: str) -> None:
    """Appends rows to a table of text lines."""
    df.select(F.concat_ws(": ", *(F.col(c).cast("string") for c in df.columns)).alias("value")).write.mode("append").text(path)


def compact(df: DataFrame, files: DataFrame, path: str, target: int, compression: str = "zstd") -> None:
    """Writes the rows of ``df`` (with their ``file``) in parts of about ``target`` bytes of input files, one folder each."""
    from tickloom.operators.corpus import compaction_parts  # which uses this module

    parts = compaction_parts(files, target).select(F.col("name").alias("file"), "part")
    df.join(parts, "file").drop("file").repartition("part").write.partitionBy("part").option("compression", compression).parquet(path)


def stats_json(df: DataFrame) -> DataFrame:
    """One row of JSON for a report of few rows."""
    return df.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*df.columns)))).alias("json"))


def preview(df: DataFrame, order: str, n: int = 3, text: str = "text") -> DataFrame:
    return df.orderBy(order).limit(n).withColumn(text, F.substring(text, 1, 200))


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def save_state(spark: SparkSession, path: str, state: dict) -> None:
    """Writes a small JSON state so that a reader sees the old one or the new one: a file beside it is renamed over it."""
    target, fs = _path(spark, path)
    new, _ = _path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
    out.close()
    if not fs.rename(new, target):  # some stores do not rename over a file
        fs.delete(target, False)
        if not fs.rename(new, target):
            raise OSError(f"cannot replace {path}")


def load_state(spark: SparkSession, path: str) -> dict | None:
    target, fs = _path(spark, path)
    if not fs.exists(target):
        return None
    return json.loads("".join(r["value"] for r in spark.read.text(path).collect()))  # one small file


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], previous: str | None = None) -> DataFrame:
    """The table at ``path``, built if it is not there whole; ``previous`` is then deleted."""
    done, fs = _path(spark, f"{path}/_SUCCESS")
    if not fs.exists(done):
        build().write.mode("overwrite").parquet(path)
        if previous is not None:
            fs.delete(_path(spark, previous)[0], True)
    return spark.read.parquet(path)


def _listed(spark: SparkSession, path: str) -> dict[str, tuple[int, str, int]]:
    """Size, time and key of each parquet file of a glob, by name: metadata, without a look into the files. The key is a hash of the name as rows have it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = found.select("path", "length", "modificationTime", F.xxhash64("_metadata.file_path")).collect()
    return {r[0]: (r[1], str(r[2]), r[3]) for r in sorted(rows) if r[0].endswith(".parquet")}


def cached_shards(spark: SparkSession, path: str, source: str, build: Callable[[DataFrame], DataFrame], version: str = "") -> DataFrame:
    """What ``build`` makes of the parquet files of ``source``, kept at ``path`` by input file: only files that are new or changed are built.

    A manifest lists the input files with sizes and times, and the folder that holds what was made of each. Changed files are built in one
    job into a folder of their own; then the manifest is swapped, and shards that it no longer names are deleted, so a reader sees
    the old state or the new one, and a run that is stopped leaves the old. ``build`` must work row by row, as a file's rows are its shard's; ``version``
    names it, and another one builds all anew. Files are metadata on the driver; their rows never are.
    """
    state = load_state(spark, f"{path}/manifest.json") or {"version": version, "files": {}}
    known = state["files"] if state["version"] == version else {}
    now = _listed(spark, source)
    kept = {name: known[name] for name, (size, time, _) in now.items() if name in known and known[name][:2] == [size, time]}
    fresh = sorted(set(now) - set(kept))
    if fresh:
        folder = f"shards-{uuid.uuid4().hex}"
        rows = build(spark.read.parquet(*fresh).withColumn("shard_", F.xxhash64("_metadata.file_path")))
        rows.write.partitionBy("shard_").parquet(f"{path}/{folder}")
        schema = rows.drop("shard_").schema.json()
        kept |= {name: [*now[name][:2], folder, now[name][2], schema] for name in fresh}
    if fresh or set(kept) != set(known) or state["version"] != version:
        save_state(spark, f"{path}/manifest.json", {"version": version, "files": kept})
        live = {(v[2], v[3]) for v in kept.values()}
        for _, _, folder, key, _ in state["files"].values():
            if (folder, key) not in live:
                target, fs = _path(spark, f"{path}/{folder}/shard_={key}")
                fs.delete(target, True)
    if not kept:
        raise FileNotFoundError(source)
    schema = StructType.fromJson(json.loads(next(iter(kept.values()))[4]))
    shards = [p for p in (f"{path}/{v[2]}/shard_={v[3]}" for v in kept.values()) if (t := _path(spark, p))[1].exists(t[0])]  # a file without rows has none
    return spark.read.schema(schema).parquet(*shards) if shards else spark.createDataFrame([], schema)


def append_stream(spark: SparkSession, source: str, schema: str | StructType, path: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] = lambda df: df, files: int = 100, fault: Callable[[int], None] | None = None) -> None:
    """Appends what ``change`` makes of parquet files that are new at ``source`` to ``path``, each file's rows once, whatever fails between.

    A stream reads files in batches of ``files``; which files are in which batch is in its checkpoint before the batch is written. A batch's
    folder is named by its number and written over, so a batch that is done again after a failure replaces what the first try left.
    ``fault`` is called after a batch is written and before it is committed, for tests.
    """

    def write(batch: DataFrame, number: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if fault is not None:
            fault(number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
