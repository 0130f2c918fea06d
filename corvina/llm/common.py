"""Shared helpers: scratch tables in the cluster's shared folder and size-checked joins on id sets."""

from __future__ import annotations

import contextlib
import ctypes
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_at_exit, scratch  # operators take both from here

#: An id set of at most this many rows (about 50 bytes each once hashed) may be broadcast; a larger one is joined by shuffle.
BROADCAST_IDS = 1_000_000

#: The module name under which a Python worker keeps what later tasks of one operator use again.
STORE = "corvina_worker_store"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Within it, actions hand at most ``rows`` rows at once to Python workers, as a row may be a long text."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def saved(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, survives lost executors, and goes with the driver."""
    path = scratch(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.option("compression", codec).parquet(path)
    drop_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_ids(df: DataFrame, ids: DataFrame, how: str, key: str | list[str] = "doc_id") -> DataFrame:
    """Semi or anti join of wide rows with a materialised set of ids.

    The ids are counted first.  Up to BROADCAST_IDS they are broadcast, so the wide rows stay where they are;
    beyond it both sides are shuffled on the key.
    """
    ids = ids.select(key) if isinstance(key, str) else ids.select(*key)
    if how == "left_anti" and ids.isEmpty():
        return df
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, how)


#: Freed memory of a Python worker from which it goes back to the system at once, and glibc's numbers of the two settings for it.
KEPT, SETTINGS = 1 << 20, (-1, -3)


def trim() -> None:
    """Hands freed memory of a Python worker back to the system, now and from now on, where the allocator can (glibc).

    Arrow's own allocator would keep what it frees, and the thresholds of glibc's grow with what is allocated: a worker that then
    stands idle beside other stages would hold the most that it ever had.
    """
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        for setting in SETTINGS:
            libc.mallopt(setting, KEPT)
        pa.default_memory_pool().release_unused()
        pa.set_memory_pool(pa.system_memory_pool())
        libc.malloc_trim(0)


def release() -> None:
    """In a Python worker: drops what an earlier operator kept there."""
    sys.modules.pop(STORE, None)
    trim()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
