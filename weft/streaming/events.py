"""Streams with the results of their batch queries: sessions, windows, duplicates, upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """(user_id, start, end, events) of sessions by gap; state is dropped once the watermark is past a session."""
    e = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    w = e.withWatermark("ts", late) if e.isStreaming else e
    g = w.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def windowed(events: DataFrame, window: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """(start, event_type, n) of tumbling or sliding windows."""
    e = events.select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    w = e.withWatermark("ts", late) if e.isStreaming else e
    g = w.groupBy(F.window("ts", window, slide).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n")


def distinct_events(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event_id once; a stream keeps ids only within the watermark."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if e.isStreaming else e.dropDuplicates(["event_id"])


def upsert_stream(changes: DataFrame, target: str, key: str, version: str, checkpoint: str):
    """Keeps ``target`` (Parquet, a folder per version of the table) at the latest row of each key.

    Every micro-batch writes a whole new version and then moves the pointer file, so a batch that is run again after a
    failure gives the same table.
    """
    from weft.operators.dml import upsert

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), version).alias("r")).select("r.*")
        old = current(spark, target, before=n)
        if old is not None:
            newer = old.join(rows.select(key, F.col(version).alias("__v")), key).where(F.col(version) > F.col("__v")).select(*old.columns)
            rows = rows.join(newer.select(key), key, "left_anti")
            rows = upsert(old, rows, key)
        rows.write.mode("overwrite").parquet(f"{target}/v={n}")

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """The latest whole version of a table kept by ``upsert_stream``."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(target)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    have = [int(s.getPath().getName()[2:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v=") and fs.exists(hadoop.Path(s.getPath(), "_SUCCESS"))]
    have = [v for v in have if before is None or v < before]
    return spark.read.parquet(f"{target}/v={max(have)}") if have else None


def run_once(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over what is there into a memory table; for tests and small reports."""
    w = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    q = (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


Step = Callable[[DataFrame, int], None]
