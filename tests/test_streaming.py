"""Streams against the batch computation of the same."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.streaming import bars as B


def test_bars_and_gaps(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    files = tmp_path / "in"
    ordered = events.orderBy("ts")
    cuts = [r["ts"] for r in ordered.select("ts").collect()]
    thirds = [cuts[0], cuts[len(cuts) // 3], cuts[2 * len(cuts) // 3]]
    for k, lo in enumerate(thirds):
        part = events.where(F.col("ts") >= lo)
        if k + 1 < len(thirds):
            part = part.where(F.col("ts") < thirds[k + 1])
        part.coalesce(1).write.mode("append").parquet(str(files))
    # files are read in the order of their times, one a trigger
    out = tmp_path / "bars"
    B.write_all(B.bar_stream(B.event_stream(spark, str(files)), "1 day", "1 day"), str(out), str(tmp_path / "c1"))
    got = spark.read.parquet(str(out))
    days = F.window(F.col("ts").cast("timestamp"), "1 day")
    want = events.groupBy(days.alias("w"), "event_type").agg(F.max("value").alias("high"), F.min("value").alias("low"), F.count("*").alias("n"))
    want = {(r["event_type"], r["w"]["start"]): (r["high"], r["low"], r["n"]) for r in want.collect()}
    seen = {(r["symbol"], r["start"]): (r["high"], r["low"], r["n"]) for r in got.collect()}
    assert seen and all(want[k] == v for k, v in seen.items())
    assert len(seen) > 0.5 * len(want)  # the last windows wait for the watermark

    stream = spark.readStream.schema(got.schema).parquet(str(out))
    B.write_all(B.gap_stream(stream), str(tmp_path / "gaps"), str(tmp_path / "c2"))
    w = Window.partitionBy("symbol").orderBy("start")
    g = got.withColumns({"h2": F.lag("high", 2).over(w), "l2": F.lag("low", 2).over(w)})
    batch = {(r["symbol"], r["start"]) for r in g.where("low > h2 or high < l2").collect()}
    assert {(r["symbol"], r["start"]) for r in spark.read.parquet(str(tmp_path / "gaps")).collect()} == batch
