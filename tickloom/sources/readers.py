"""Readers: every source is a DataFrame; filters and column choices reach the scan."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StringType, StructField, StructType

OHLC = "Open double, High double, Low double, Close double"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def ohlc_csv(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """Bars of CSV files: one symbol's, or, without ``symbol``, those of folders ``symbol=...`` below the path, read at once.

    Positions follow the files' names and the rows' order within them. Rows are numbered within the pieces that tasks read; the
    pieces' counts, one row each, give their starts.
    """
    fields = OHLC if symbol is not None else f"{OHLC}, symbol string"
    raw = spark.read.schema(fields).csv(path, header=True)
    name = F.lit(symbol) if symbol is not None else F.col("symbol")
    piece = [name.alias("symbol"), F.col("_metadata.file_path").alias("file_"), F.col("_metadata.file_block_start").alias("from_")]
    rows = raw.select("Open", "High", "Low", "Close", *piece, F.monotonically_increasing_id().alias("row_"))
    sizes = rows.groupBy("symbol", "file_", "from_").agg(F.count("*").alias("n_"), F.min("row_").alias("least_"))
    ahead = F.coalesce(F.sum("n_").over(Window.partitionBy("symbol").orderBy("file_", "from_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("file_").alias("f_"), F.col("from_").alias("b_"), "least_", ahead.alias("ahead_"))
    placed = rows.join(sizes, (F.col("file_") == F.col("f_")) & (F.col("from_") == F.col("b_")))
    idx = F.col("row_") - F.col("least_") + F.col("ahead_")
    return placed.select("symbol", idx.cast("long").alias("idx"), *(F.col(c).alias(c.lower()) for c in ("Open", "High", "Low", "Close")))


def unit_rows(units: DataFrame, schema: str, tasks: int | None = None) -> DataFrame:
    """The rows of chosen row groups: ``file, row_group, position`` and the columns of ``schema``, of the units (``file, row_group``) given.

    Units are dealt to tasks one by one; a task opens a unit's file, reads that row group and of it the columns asked for, and nothing else.
    ``position`` is the row's place in its row group. A reader resumes by the units that are left. Files must be in a store that Arrow knows.
    """
    spark = units.sparkSession
    columns = spark.createDataFrame([], schema).schema
    out = StructType([StructField("file", StringType()), StructField("row_group", LongType()), StructField("position", LongType()), *columns.fields])
    kinds = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out.fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, group in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _parquet_file(name) as f:
                    at = 0
                    for part in f.iter_batches(8192, row_groups=[group], columns=columns.names):
                        n = part.num_rows
                        own = [pa.array([name] * n, pa.string()), pa.array([group] * n, pa.int64()), pa.array(range(at, at + n), pa.int64())]
                        yield pa.RecordBatch.from_arrays([*own, *(part.column(part.schema.get_field_index(c.name)).cast(kinds.field(c.name).type) for c in columns.fields)], schema=kinds)
                        at += n

    dealt = units.select("file", F.col("row_group").cast("long")).repartition(tasks or spark.sparkContext.defaultParallelism * 4, "file", "row_group")
    return dealt.mapInArrow(read, out)


def parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: Column | Callable[[DataFrame], Column] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where(df) if callable(where) else where)
    return df.select(*columns) if columns else df


def existing(spark: SparkSession, paths: Sequence[str], warn: Callable[[str], None] = print) -> DataFrame | None:
    """Those of the parquet paths that there are; others give a warning. None if there are none."""
    found = []
    for p in paths:
        if _exists(spark, p):
            found.append(p)
        else:
            warn(f"skipped: {p}")
    return spark.read.option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").parquet(*found) if found else None


def with_file(df: DataFrame) -> DataFrame:
    """Adds ``file``, the name of the row's file."""
    return df.select("*", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("file"))


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of a glob; a count needs the files' footers only."""
    return spark.read.parquet(path).count()


def row_groups(spark: SparkSession, path: str, tokens: str | None = None) -> DataFrame:
    """``file, row_group, rows, bytes`` of parquet files, from their footers; with ``tokens``, also that column's sum by row group.

    The files' names are dealt to tasks, which read footers (and, of one column, the row groups)
    through the file system of each name, one that Arrow knows. Units for the mixer.
    """
    files = sorted(spark.read.parquet(path).inputFiles())
    names = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, min(len(files), 10_000)), "file")

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with _parquet_file(name) as f:
                    groups = [f.metadata.row_group(k) for k in range(f.num_row_groups)]
                    n = pa.array([g.num_rows for g in groups], pa.int64())
                    size = pa.array([g.total_byte_size for g in groups], pa.int64())
                    sums = [int(pc.sum(f.read_row_group(k, [tokens]).column(0)).as_py() or 0) if tokens else None for k in range(len(groups))]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(groups), pa.string()), pa.array(range(len(groups)), pa.int64()), n, size, pa.array(sums, pa.int64())], names=["file", "row_group", "rows", "bytes", "tokens"])

    out = names.mapInArrow(footers, "file string, row_group long, rows long, bytes long, tokens long")
    return out if tokens else out.drop("tokens")


def _parquet_file(name: str) -> pq.ParquetFile:
    store, where = fs.FileSystem.from_uri(name)
    return pq.ParquetFile(store.open_input_file(where))


def page_lines(spark: SparkSession, path: str, extract: Callable[[bytes], Iterable[tuple[int, int, str, float, float]]], glob: str = "*") -> DataFrame:
    """``doc, page, line_no, text, top, bottom`` of binary documents, by an extractor from bytes to such lines.

    Files are read by executors, one document at a time; a document that the extractor fails on gives
    a row with page null and the error as its text. Empty files give no rows.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    lines = [tuple(x) for x in extract(content.as_py())]
                except Exception as e:  # noqa: BLE001 - one bad document is reported, not fatal
                    lines = [(None, None, f"{type(e).__name__}: {e}", None, None)]
                columns = list(zip(*lines, strict=True)) if lines else [()] * 5
                kinds = (pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(lines), pa.string()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc", "page", "line_no", "text", "top", "bottom"])

    return raw.select("path", "content").mapInArrow(run, "doc string, page int, line_no int, text string, top double, bottom double")


def token_lines(spark: SparkSession, path: str) -> DataFrame:
    """``token``: the lines of text files, trimmed, without blank ones."""
    return spark.read.text(path).select(F.trim("value").alias("token")).where("token <> ''")


def choice_items(df: DataFrame, label: str, context: str, n: int | None = None, order: str | None = None) -> DataFrame:
    """Multiple-choice items whose context begins with their label; the first ``n`` in order."""
    out = df.withColumn("ctx", F.concat_ws(": ", label, context))
    return out.orderBy(order).limit(n) if n is not None and order else out


def by_domain(df: DataFrame, column: str, domains: Sequence[str]) -> DataFrame:
    return df.where(F.col(column).isin(*domains))
