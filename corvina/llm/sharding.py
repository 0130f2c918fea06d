"""Global shuffle into shards in two passes over external storage.

Pass one scatters rows by a seeded hash of doc_id and content into buckets that fit a task's memory.  Pass two draws a
Fisher-Yates permutation of each bucket (seeded by the bucket), gives every row its place in the global order and writes
the rows; ``rows`` is the law: shard s holds the places from ceil(s N / shards) on, so counts differ by one at most.

The scatter has two levels: at most PARTITIONS reduce partitions, each of consecutive buckets, which Spark sorts (and
spills) by bucket, so that a task holds one bucket at a time.  Bucket counts come from a pass of their own and are the only figures on
the driver: at most BUCKETS of them (8 bytes each), beyond which buckets grow (250 MB at 100 TB).

A bucket is sorted by (doc_id, text) before it is permuted, so a rerun after a lost executor gives the same order.  Rows that repeat a
doc_id are scattered by content; rows equal in both share a bucket, unless they would fill one: such copies are counted and
scattered one by one.  A null text has size 8.  Empty tables give an empty result; extra columns are carried along to the files, whatever their
names, but for ``shard`` and ``slot``, which are the results'.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_at_exit, scratch

BUCKET_BYTES, BUCKETS, PARTITIONS = 16 << 20, 400_000, 50_000
#: A bucket of so many times the wanted bytes is looked through for rows that repeat.
CROWDED = 3
#: Bytes of rows, about.
SIZE = "sum(coalesce(octet_length(text), 0) + 64)"


def _bucket(seed: int, buckets: int, nth: str = "cast(null as bigint)") -> Column:
    """A bucket by doc_id and text; of very common rows also by which of the copies it is (nulls do not change a hash)."""
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text", F.expr(nth)), F.lit(buckets))


def _free(name: str, columns: list[str]) -> str:
    """``name``, or one like it that is none of the columns."""
    while name in columns:
        name = f"_{name}"
    return name


def _permuted(seed: int, offsets: np.ndarray, total: int, shards: int, own: list[str]):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[-1].as_py()
        order = pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]).to_numpy()
        order = order[np.random.default_rng([seed, bucket]).permutation(len(order))]  # Fisher-Yates
        place = offsets[bucket] + np.arange(len(order), dtype=np.int64)
        shard = place * shards // total
        slot = place + (-shard * total // shards)  # less the first place of the shard, rounded up
        out = table.drop(own).take(pa.array(order))
        return out.append_column("shard", pa.array(shard, pa.int32())).append_column("slot", pa.array(slot, pa.int64()))

    return run


def _counts(rows: DataFrame, bucket: Column) -> list:
    return rows.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.expr(SIZE).alias("bytes")).collect()


def _split(rows: DataFrame, seed: int, buckets: int, crowded: list[int], limit: float, nth: str) -> DataFrame:
    """``rows`` with ``nth``: null, but numbers of the copies of rows (equal in every column) that would fill a bucket alone.

    Copies are counted, combined map-side, and made again from their number, so they are no task's alone and equal at every rerun.
    """
    key = ["doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")]
    hot = rows.filter(_bucket(seed, buckets).isin(crowded)).groupBy(*key).agg(F.expr(SIZE).alias("bytes")).filter(F.col("bytes") > limit).select("doc_id", "h")
    # a key for each full bucket's worth of bytes, so as few as buckets
    hot = F.broadcast(hot.withColumn("hot", F.lit(True)))
    x, y = rows.withColumn(nth, F.lit(None).cast("long")).alias("x"), hot.alias("y")
    same = F.expr("x.doc_id <=> y.doc_id and xxhash64(coalesce(x.text, '')) = y.h")
    rest = x.join(y, same, "left_anti")
    copies = x.join(y, same, "left_semi").groupBy(*[F.col(f"x.`{c}`") for c in rows.columns]).agg(F.count("*").alias(nth))
    chunk, run = _free("chunk", rows.columns), 4096
    runs = copies.withColumn(chunk, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({nth} - 1) div {run}")))).repartition(chunk)
    each = runs.withColumn(nth, F.explode(F.sequence(F.col(chunk) * run, F.least(F.col(nth), (F.col(chunk) + 1) * run) - 1)))
    return rest.select(*rows.columns, nth).unionByName(each.select(*rows.columns, nth))


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes ``docs`` (doc_id, text, ...) under ``path`` in ``shard=`` folders and returns what the files hold, with slot."""
    rows = docs.drop("shard", "slot")
    size = rows.agg(F.expr(SIZE)).first()[0] or 0
    wanted = max(bucket_bytes, size / BUCKETS)
    buckets = max(1, math.ceil(size / wanted))
    parts = min(buckets, PARTITIONS)
    part, bucket, nth = own = [_free(c, rows.columns) for c in ("part", "bucket", "nth")]
    found = _counts(rows, _bucket(seed, buckets))
    crowded = [r["b"] for r in found if r["bytes"] > CROWDED * wanted]
    if crowded and buckets > 1:
        rows = _split(rows, seed, buckets, crowded, wanted, nth)
        found = _counts(rows, _bucket(seed, buckets, f"`{nth}`"))
    else:
        rows = rows.withColumn(nth, F.lit(None).cast("long"))
    each = np.zeros(buckets, np.int64)
    for r in found:
        each[r["b"]] = r["n"]
    total = max(1, int(each.sum()))
    if total * shards >= 1 << 62:
        raise ValueError("places of so many rows and shards do not fit 64 bits")
    kept = [f for f in rows.schema.fields if f.name not in own]
    schema = T.StructType([*kept, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    dealt = rows.withColumn(bucket, _bucket(seed, buckets, f"`{nth}`")).withColumn(part, F.expr(f"cast(`{bucket}` * {parts}L div {buckets} as int)"))
    dealt = dealt.repartitionById(parts, part)
    mixed = dealt.groupBy(part, bucket).applyInArrow(_permuted(seed, np.cumsum(each) - each, total, shards, own), schema)
    mixed.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def shuffled_shards(docs: DataFrame, shards: int, seed: int = 42) -> DataFrame:
    """``write_shards`` to the shared folder, and per document where it went."""
    path = scratch(docs.sparkSession, "shards")
    files = write_shards(docs, path, shards, seed)
    drop_at_exit(docs.sparkSession, path)
    return files.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
