"""Structured Streaming forms of the monitoring aggregates over an events stream (event_id, ts, user_id, event_type, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def timed(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """``ts`` as a zoned timestamp under a watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def _counted(events: DataFrame, window, *keys: str) -> DataFrame:
    g = events.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), *keys, "n", "total")


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    return _counted(events, F.window("ts", width), "event_type")


def sliding(events: DataFrame, width: str = "24 hours", slide: str = "6 hours") -> DataFrame:
    return _counted(events, F.window("ts", width, slide), "event_type")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return _counted(events, F.session_window("ts", gap), "user_id")


def deduplicated(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Drops repeats of a key that come within the watermark; the state is bounded by it."""
    return events.dropDuplicatesWithinWatermark([key])


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is available now, written to Parquet under ``path`` by the executors and read back; checkpoint: a folder for state and offsets.

    In complete mode each batch replaces the result, in append mode it is a folder of its own, so a batch that is run again leaves no rows twice.
    """
    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={batch}")

    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path if mode == "complete" else f"{path}/batch=*")


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """Continuous append of a stream to Parquet files (exactly once by the sink's log)."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def in_order(spark: SparkSession, path: str) -> None:
    """Has files of a folder read by a stream in the order of their names, which is that of their times then; a store that keeps no such times is an error."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = {f.getPath().getName(): f for f in fs.listStatus(folder) if f.getPath().getName()[0] not in "._"}
    first = max((f.getModificationTime() for f in files.values()), default=0) - 2000 * len(files)
    for i, name in enumerate(sorted(files)):
        fs.setTimes(files[name].getPath(), first + 2000 * i, -1)
    times = [fs.getFileStatus(files[name].getPath()).getModificationTime() for name in sorted(files)]
    if any(a >= b for a, b in zip(times, times[1:], strict=False)):
        raise ValueError(f"times of the files of {path} can't be set")
