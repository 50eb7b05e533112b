"""Structured Streaming over events: bars by event time, and their gaps with state. An extension beyond batch.

``bar_stream`` aggregates event-time windows behind a watermark. ``gap_stream`` keeps, for each
symbol, the last two bars as state and emits a gap as soon as its third bar is complete, with the
same rule as the batch detector. Both resume from their checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
GAPS = "symbol string, start timestamp, type string, gap_low double, gap_high double"
_STATE = "highs array<double>, lows array<double>"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def bar_stream(events: DataFrame, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """``symbol, start, open, high, low, close, n`` of each window that the watermark has passed."""
    first, last = F.min_by("value", F.struct("ts", "event_id")), F.max_by("value", F.struct("ts", "event_id"))
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("symbol"))
    bars = grouped.agg(first.alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), last.alias("close"), F.count("*").alias("n"))
    return bars.select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "n")


def _gaps(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    highs, lows = (list(x) for x in state.get) if state.exists else ([], [])
    rows = pd.concat(list(frames)).sort_values("start")
    out = []
    for r in rows.itertuples():
        if len(highs) == 2:
            if r.low > highs[0]:
                out.append((key[0], r.start, "BULL", highs[0], r.low))
            elif r.high < lows[0]:
                out.append((key[0], r.start, "BEAR", r.high, lows[0]))
        highs, lows = (highs + [r.high])[-2:], (lows + [r.low])[-2:]
    state.update((highs, lows))
    yield pd.DataFrame(out, columns=["symbol", "start", "type", "gap_low", "gap_high"])


def gap_stream(bars: DataFrame) -> DataFrame:
    """Gaps of a stream of bars that come in order of time; state is two bars a symbol."""
    return bars.groupBy("symbol").applyInPandasWithState(_gaps, GAPS, _STATE, "append", GroupStateTimeout.NoTimeout)


def write_all(df: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over what there is now and stops; run again, it goes on from its checkpoint."""
    df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
