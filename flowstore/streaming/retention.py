"""Short-term memory: retention, first-wins dedupe and micro-batches; each with a batch twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: A micro-batch is committed after so many seconds.
EVERY = "5 seconds"


def retained(df: DataFrame, at: str, age: str, now: str | None = None) -> DataFrame:
    """Rows not older than age (such as "30 minutes") before `now` (the newest row, by default)."""
    if now is not None:
        return df.where(F.col(at) >= F.lit(now).cast("timestamp") - F.expr(f"interval {age}"))
    newest = df.agg(F.max(at).alias("__now"))
    return df.crossJoin(F.broadcast(newest)).where(F.col(at) >= F.col("__now") - F.expr(f"interval {age}")).drop("__now")  # one row


def first_of_each(df: DataFrame, key: str, at: str) -> DataFrame:
    """The first row of each key by time, ties by all columns: the batch twin of `deduplicated`."""
    w = Window.partitionBy(key).orderBy(at, *[c for c in df.columns if c not in (key, at)])
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def deduplicated(stream: DataFrame, key: str, at: str, age: str) -> DataFrame:
    """The first row of each key within `age`; state older than the watermark is dropped."""
    return stream.withWatermark(at, age).dropDuplicatesWithinWatermark([key])


def commit(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = EVERY) -> StreamingQuery:
    """Commits micro-batches through `write(rows, batch_id)`; with every None all that is there, once. A
    batch comes again under its id after a failure, so that writes can be made once.
    """
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def windowed(stream: DataFrame, at: str, size: str, slide: str | None, late: str, by: list[str], value: str) -> DataFrame:
    """(window_start, by, n, total) in tumbling or sliding windows; rows later than `late` are dropped in a stream."""
    rows = stream.withWatermark(at, late) if stream.isStreaming else stream
    out = rows.groupBy(F.window(at, size, slide) if slide else F.window(at, size), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), *by, "n", "total")


def sessions(stream: DataFrame, at: str, gap: str, late: str, by: str) -> DataFrame:
    """(by, session_start, session_end, n): runs of rows with no gap of `gap` or more."""
    rows = stream.withWatermark(at, late) if stream.isStreaming else stream
    out = rows.groupBy(F.session_window(at, gap), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")
