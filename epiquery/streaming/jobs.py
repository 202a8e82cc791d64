"""Streams of texts to labels, and windowed counts of events (an extension: the batch engine has no windows)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def diagnose_stream(texts: DataFrame, diagnose: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True):
    """Starts a query that labels each micro-batch with a batch plan and appends the rows to `out`; restarts continue at the
    checkpoint, and a batch that is written again replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        diagnose(batch).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    w = texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="10 seconds")).start()


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, per_batch: int = 64) -> DataFrame:
    """The Parquet files of a folder as they come, or a single file."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p) and fs.getFileStatus(p).isFile():
        return r.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return r.parquet(path)


def windowed_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(window_start, kind, n, value) per tumbling window; rows later than the watermark are dropped."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events
    g = e.groupBy(F.window(ts, window).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return g.select(F.col("w.start").alias("window_start"), kind, "n", "value")


def collected_windows(spark: SparkSession, path: str, schema, root: str, per_batch: int = 64) -> DataFrame:
    """windowed_counts of a folder (or file) of events read as a stream until its end: every window with all that was counted for it."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/windows-{epoch % 2}")
        seen.append(epoch % 2)

    seen: list[int] = []
    counts = windowed_counts(file_stream(spark, path, schema, per_batch))
    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/windows-{seen[-1]}") if seen else windowed_counts(spark.createDataFrame([], schema))


class Breaker:
    """After more than `most` failures in a row, calls are refused until `rest` seconds after the last one. Driver side."""

    def __init__(self, most: int = 4, rest: float = 12 * 3600):
        self.most, self.rest, self.failures, self.last = most, rest, 0, float("-inf")

    def allows(self, now: float) -> bool:
        return self.failures <= self.most or now - self.last >= self.rest

    def record(self, ok: bool, now: float) -> None:
        self.failures, self.last = (0, self.last) if ok else (self.failures + 1, now)
