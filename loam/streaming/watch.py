"""Change events: filtering, debouncing, and rebuilding by micro-batch.

Event times without a zone are taken as UTC. Events later than the watermark are dropped; a burst is given out once the
watermark has passed its end, so the last one of a stream stays open until later events come.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def relevant(events: DataFrame) -> DataFrame:
    """events (ts, filename) outside the engine's own folder and installed packages."""
    return events.where(~F.col("filename").startswith(".ctx") & ~F.contains("filename", F.lit("node_modules")))


SPAN = 4096  # gaps in one stretch of time


def bursts(events: DataFrame, gap: str = "1500 milliseconds", late: str | None = None) -> DataFrame:
    """(start, end, events, filename): events no more than the gap apart are one burst; its last file names it.

    Works on streams (late: the watermark) and on tables. On a table time is cut into stretches, each with its own
    sessions; only those that reach within a gap of a stretch's ends, two at most, are merged in one task. A stream needs
    a key beside the session, so there all events have the same one.
    """
    e = events.select(F.col("ts").cast("timestamp").alias("ts"), "filename")
    wait = F.expr(f"interval {gap}")
    # Ends are aggregates: a filter on those of the window itself would be pushed below the merging of windows.
    told = [F.min("ts").alias("start"), (F.max("ts") + wait).alias("end"), F.count(F.lit(1)).alias("events"), F.max_by("filename", "ts").alias("filename")]
    if events.isStreaming or late is not None:
        e = e if late is None else e.withWatermark("ts", late)
        return e.withColumn("all", F.lit(0)).groupBy("all", F.session_window("ts", gap)).agg(*told).drop("all", "session_window")
    width = F.unix_micros(F.timestamp_micros(F.lit(0)) + wait)
    stretch = F.floor(F.unix_micros("ts") / (width * SPAN))
    s = e.withColumn("stretch", stretch).groupBy("stretch", F.session_window("ts", gap)).agg(*told).drop("session_window")
    first = F.col("stretch") * SPAN * width
    at_edge = (F.unix_micros("start") <= first + width) | (F.unix_micros("end") >= first + SPAN * width)
    inner, edge = s.where(~at_edge).drop("stretch"), s.where(at_edge)
    reach = F.concat((F.unix_micros("end") - F.unix_micros("start")).cast("string"), F.lit(" microseconds"))
    parts = [F.min("start").alias("start"), F.max("end").alias("end"), F.sum("events").alias("events"), F.max_by("filename", "end").alias("filename")]
    return inner.unionByName(edge.groupBy(F.session_window("start", reach)).agg(*parts).drop("session_window"))


def rebuild_on_change(events: DataFrame, build: Callable[[DataFrame, int], None], checkpoint: str, gap: str = "1500 milliseconds", late: str = "0 seconds") -> StreamingQuery:
    """Calls build(bursts, batch id) for each micro-batch with closed bursts, one at a time."""

    def each(df: DataFrame, batch: int) -> None:
        if not df.isEmpty():
            build(df, batch)

    return bursts(relevant(events), gap, late).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
