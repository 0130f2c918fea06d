"""An index of chunks of a folder's files that is brought up to date by what changed: new and changed files are read, deleted ones go.

The index is a versioned collection of rows (path, modified, length, chunk_idx, chunk); its manifest of files is these rows' (path, modified,
length).  ``refresh`` lists the folder without reading contents, compares it with the manifest, reads the files whose time or length differ
(those older than the oldest of them are not opened) and puts one version.  So a run that fails leaves the version before, and one that is
repeated changes nothing.  ``follow`` refreshes at each trigger of a stream.

A file without chunks is one row of a null chunk, so that it is known; one without bytes is not listed.  Bytes that are not UTF-8 are replaced.  An empty folder gives an empty index.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import curate
from . import collection

SCHEMA = "path string, modified timestamp, length long, chunk_idx int, chunk string"
FILE_KEY = ["path", "modified", "length"]


def listing(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, modified, length) of the files; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return rows.select("path", F.col("modificationTime").alias("modified"), "length")


def known(spark: SparkSession, root: str) -> DataFrame:
    """The files of the latest version."""
    if collection.latest(spark, root)[1] is None:
        return spark.createDataFrame([], SCHEMA).select(*FILE_KEY)
    return collection.read(spark, root).select(*FILE_KEY).distinct()


def changes(spark: SparkSession, path: str, root: str, glob: str) -> DataFrame:
    """(path, status): NEW, CHANGED, DELETED or SAME."""
    version = F.struct("modified", "length").alias("version")
    return curate.manifest_diff(known(spark, root).select("path", version), listing(spark, path, glob).select("path", version), "path")


def refresh(spark: SparkSession, path: str, root: str, chunks: Callable[[Column], Column], glob: str = "*.{md,txt}") -> dict[str, int]:
    """Brings the index under ``root`` up to date with the files under ``path``; how many were new, changed, deleted and the same.

    chunks: of a text the array of its chunks.
    """
    from ..session import written

    status = written(changes(spark, path, root, glob), "changes")
    told = {r["status"]: r["n"] for r in status.groupBy("status").agg(F.count("*").alias("n")).collect()}
    counts = {s: told.get(s, 0) for s in ("NEW", "CHANGED", "DELETED", "SAME")}
    if not (counts["NEW"] or counts["CHANGED"] or counts["DELETED"]):
        return counts
    stale = status.filter("status in ('NEW', 'CHANGED')").select("path")
    oldest = listing(spark, path, glob).join(stale, "path", "left_semi").agg(F.min("modified")).first()[0]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    some = files.filter(F.col("modificationTime") >= F.lit(oldest)).join(stale, "path", "left_semi") if oldest else files.limit(0)
    rows = some.select("path", F.col("modificationTime").alias("modified"), "length", F.posexplode_outer(chunks(F.make_valid_utf8(F.col("content").cast("string")))).alias("chunk_idx", "chunk"))
    fresh = written(rows, "chunks")
    if collection.latest(spark, root)[1] is None:
        collection.write(fresh, root)
        return counts
    gone = status.filter("status in ('CHANGED', 'DELETED')").select("path")

    def change(old: DataFrame) -> DataFrame:
        return old.join(gone, "path", "left_anti").join(fresh.select("path").distinct(), "path", "left_anti").unionByName(fresh)

    collection.rewrite(spark, root, change, "refresh")
    return counts


def follow(spark: SparkSession, path: str, root: str, chunks: Callable[[Column], Column], checkpoint: str, every: str = "1 minute", glob: str = "*.{md,txt}"):
    """A query that refreshes the index at each trigger; a trigger that is run again changes nothing."""

    def step(_: DataFrame, batch: int) -> None:
        refresh(spark, path, root, chunks, glob)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
