"""N-gram counts over token ids: contexts as 64-bit FNV-1a values, words kept once in a dictionary.

1. ``dictionary``: the distinct words, numbered from 0 in the order of the words.
2. ``counts``: tasks turn tokens into ids, hash the ids of each window and count (ctx_hash, next) of what they hold, so a shuffled
   row is three numbers, whatever the length of the words.
3. ``contexts`` and ``decoded`` give the words back where they are wanted, from one row for each distinct context.

A dictionary of up to WORDS words goes to the tasks whole; a larger one is joined by shuffle.  Two contexts with one hash, which the table
file cannot tell apart either, are refused by ``contexts``.  Documents are rows: repeated ids are several documents.  Null token arrays have no
windows, null tokens are the empty word.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

#: Words of a dictionary that is sent to the tasks (some 20 MB), windows of a task that are counted together.
WORDS, STEP = 1_000_000, 2_000_000

# Offset and prime of FNV-1a with 64 bits.
OFFSET, PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)


def dictionary(docs: DataFrame, column: str = "tokens") -> DataFrame:
    """(word, id), written: ids from 0 without gaps, in the order of the words."""
    spark = docs.sparkSession
    words = written(docs.select(F.explode(column).alias("word")).select(F.coalesce("word", F.lit("")).alias("word")).distinct(), "words")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = words.repartitionByRange(parts, "word").sortWithinPartitions("word")
    # the lower bits of the number are the place within the partition
    rows = written(rows.select("word", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("nth")), "numbered")
    sizes = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row for each partition
    before, table = 0, []
    for part in sorted(sizes):
        table.append((part, before))
        before += sizes[part]
    if before >= 1 << 32:
        raise ValueError(f"{before} words do not fit ids of 32 bits")
    offsets = spark.createDataFrame(table, "part int, before long")
    return written(rows.join(F.broadcast(offsets), "part").select("word", (F.col("before") + F.col("nth")).alias("id")), "dictionary")


def coded(docs: DataFrame, words: DataFrame, column: str = "tokens") -> DataFrame:
    """(ids): the ids of each document's tokens, in order."""
    rows = docs.select(F.transform(column, lambda w: F.coalesce(w, F.lit(""))).alias("tokens")).filter("tokens is not null")
    if words.count() <= WORDS:
        known = words.orderBy("id").toArrow().column("word").combine_chunks()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column(0)
                ids = pc.index_in(column.flatten(), value_set=known.cast(column.type.value_type)).cast(pa.int64())
                sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), ids)], ["ids"])

        return rows.mapInArrow(run, "ids array<long>")
    rows = written(rows.withColumn("doc", F.monotonically_increasing_id()), "numbered-docs")
    each = rows.select("doc", F.posexplode("tokens").alias("pos", "word")).join(words, "word")
    return each.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "id")))["id"].alias("ids")).select("ids")


def hashes(ids: np.ndarray, order: int) -> np.ndarray:
    """FNV-1a of the little-endian 32-bit ids of each window of ``order``."""
    n = max(0, len(ids) - order + 1)
    h = np.full(n, OFFSET)
    for k in range(order):
        part = ids[k : k + n].astype(np.uint64)
        for shift in range(0, 32, 8):
            h = (h ^ (part >> np.uint64(shift) & np.uint64(0xFF))) * PRIME
    return h


def _windows(batch: pa.RecordBatch, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows with a next: where they begin in the flat ids, their hash and next; the ids."""
    column = batch.column(0)
    ids = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))
    starts = np.arange(max(0, len(ids) - order))
    # a window and its next lie in one document
    whole = starts + order < ends[np.searchsorted(ends, starts, "right")] if len(starts) else np.zeros(0, bool)
    at = starts[whole]
    return at, hashes(ids, order)[at].view(np.int64), ids


def counts(docs: DataFrame, words: DataFrame, order: int = 5, column: str = "tokens") -> DataFrame:
    """(ctx_hash, next, freq) of the windows of ``order`` tokens that have a next within their document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ctx, ids = _windows(batch, order)
            for a in range(0, len(at), STEP):
                pairs = np.stack([ctx[a : a + STEP], ids[at[a : a + STEP] + order]], 1)
                pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
                first = np.flatnonzero(np.append(True, (pairs[1:] != pairs[:-1]).any(1)))
                freq = np.diff(np.append(first, len(pairs)))
                yield pa.RecordBatch.from_arrays([pa.array(pairs[first, 0]), pa.array(pairs[first, 1]), pa.array(freq)], ["ctx_hash", "next", "freq"])

    rows = coded(docs, words, column).mapInArrow(run, "ctx_hash long, next long, freq long")
    return rows.groupBy("ctx_hash", "next").agg(F.sum("freq").alias("freq"))


def contexts(docs: DataFrame, words: DataFrame, order: int = 5, column: str = "tokens") -> DataFrame:
    """(ctx_hash, ids): the ids of each distinct context, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ctx, ids = _windows(batch, order)
            ctx, place = np.unique(ctx, return_index=True)
            packed = ids[at[place, None] + np.arange(order)].astype("<u4") if len(at) else np.zeros((0, order), "<u4")
            yield pa.RecordBatch.from_arrays([pa.array(ctx), pa.array([p.tobytes() for p in packed], pa.binary())], ["ctx_hash", "ids"])

    rows = coded(docs, words, column).mapInArrow(run, "ctx_hash long, ids binary")
    found = written(rows.groupBy("ctx_hash").agg(F.min("ids").alias("ids"), F.max("ids").alias("other")), "contexts")
    if not found.filter("ids <> other").isEmpty():
        raise ValueError("two contexts have one hash")
    return found.select("ctx_hash", "ids")


def decoded(table: DataFrame, known: DataFrame, words: DataFrame, order: int = 5) -> DataFrame:
    """``table`` (ctx_hash, next, ...) with ctx and next as words; known: ``contexts``."""
    named = words if words.count() > WORDS else F.broadcast(words)
    part = lambda k: F.expr(f"cast(conv(hex(concat(substring(ids, {4 * k + 4}, 1), substring(ids, {4 * k + 3}, 1), substring(ids, {4 * k + 2}, 1), substring(ids, {4 * k + 1}, 1))), 16, 10) as long)")
    rows = known.select("ctx_hash", F.posexplode(F.array(*[part(k) for k in range(order)])).alias("pos", "id")).join(named, "id")
    texts = rows.groupBy("ctx_hash").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "word")))["word"], " ").alias("ctx"))
    rest = [c for c in table.columns if c not in ("ctx_hash", "next")]
    out = table.join(texts, "ctx_hash").join(named.withColumnRenamed("id", "next").withColumnRenamed("word", "_next"), "next")
    return out.select("ctx", F.col("_next").alias("next"), *rest)
