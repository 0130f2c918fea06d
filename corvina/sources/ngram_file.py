"""The n-gram table file as a Spark data source, read and written by tasks: one row for each next of a context.

``spark.read.format("ngram_file").load(path)`` reads a table file, or a folder of them.  ``write_table`` writes such a folder: each task
writes the shards of its range of hashes, table files like any other, and what the tasks report makes the header ``table.json`` in the
commit.  A folder without a header is none: readers refuse it, and a write that fails leaves what was there.  Paths must be reachable under their
name from every executor (a shared mount).  An empty table is a folder without shards.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..operators.ngram import TOLD

#: Slots to a task that reads, contexts to a shard that one writes.
SLOTS, SHARD = 1 << 20, 1 << 20
HEADER_FILE = "table.json"
#: A slot, as ``sinks.SLOT``.
_SLOT = np.dtype([("hash", "<u8"), ("offset", "<u4"), ("total", "<u4")])


class _Slots(InputPartition):
    """Ranges of slots (file, first, last)."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        super().__init__(ranges)
        self.ranges = ranges


def shards(path: str) -> list[dict]:
    """The shards of a folder in the order of their hashes (file, first, last, contexts), or the one file itself."""
    if not os.path.isdir(path):
        return [{"file": path, "first": -(1 << 63), "last": (1 << 63) - 1}]
    if not os.path.exists(header := os.path.join(path, HEADER_FILE)):
        raise ValueError(f"{path} has no {HEADER_FILE}: not an n-gram table, or one that is being written")
    with open(header, encoding="utf-8") as f:
        return [s | {"file": os.path.join(path, s["file"])} for s in json.load(f)["shards"]]


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def _header(self, f) -> int:
        from .sinks import HEADER, MAGIC, VERSION

        raw = f.read(HEADER.size)
        if len(raw) < HEADER.size:
            raise ValueError("truncated header")
        magic, version, _, size, _ = HEADER.unpack(raw)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not an n-gram table of this version")
        return size

    def partitions(self) -> list[_Slots]:
        out, ranges, slots = [], [], 0
        for shard in shards(self.path):
            with open(shard["file"], "rb") as f:
                size = self._header(f)
            for a in range(0, size, SLOTS):
                n = min(SLOTS, size - a)
                if ranges and slots + n > SLOTS:
                    out, ranges, slots = [*out, _Slots(ranges)], [], 0
                ranges.append((shard["file"], a, a + n))
                slots += n
        return [*out, _Slots(ranges)]

    def read(self, partition: _Slots) -> Iterator[pa.RecordBatch]:
        """Rows of a context lie side by side, and in one partition."""
        from .sinks import HEADER, SLOT

        for path, first, last in partition.ranges:
            with open(path, "rb") as f:
                data = HEADER.size + self._header(f) * SLOT.size
                f.seek(HEADER.size + first * SLOT.size)
                slots = np.frombuffer(f.read((last - first) * SLOT.size), _SLOT)
            slots = slots[slots["hash"] != 0]
            if not len(slots):
                continue
            words, at = np.memmap(path, "<u4", "r", offset=data), slots["offset"].astype(np.int64) // 4
            n = words[at].astype(np.int64)
            ends = np.cumsum(n)
            place = np.arange(ends[-1])
            place = np.repeat(at + 1 - 2 * (ends - n), n) + 2 * place
            told = [np.repeat(slots["hash"].copy().view("<i8"), n), words[place].astype(np.int64), words[place + 1].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(t) for t in told], ["ctx_hash", "next", "freq"])


@dataclass
class _Shards(WriterCommitMessage):
    shards: list[dict]


class _Writer(DataSourceArrowWriter):
    """Tasks get rows (ctx_hash, next, freq) of one range of hashes each, in the order of hash and next, and write the shards of it."""

    def __init__(self, path: str, order: int, overwrite: bool, shard: int):
        self.path, self.order, self.overwrite = path, order, overwrite
        # slots are a power of two, of which such a number of contexts fills half
        self.shard = 1 << max(3, shard.bit_length() - 1)

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Shards:
        os.makedirs(self.path, exist_ok=True)
        told, held, heads, last = [], [], 0, None
        try:
            for batch in batches:
                if batch.num_rows:
                    part = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
                    heads += int((part[0][1:] != part[0][:-1]).sum()) + (last is None or last != part[0][0])
                    last = part[0][-1]
                    held.append(part)
                    if heads > self.shard:
                        held, heads = self._put(held, told, False)
            self._put(held, told, True)
        except BaseException:
            self.abort([_Shards(told)])
            raise
        return _Shards(told)

    def _put(self, held: list, told: list, end: bool) -> tuple[list, int]:
        """Writes whole shards of what is held, and at the end the rest; what stays."""
        if not held:
            return [], 0
        found, following, freq = (np.concatenate(c) for c in zip(*held, strict=True))
        heads = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
        a = 0
        # the last context may have more rows
        while a < (len(heads) if end else len(heads) - self.shard):
            rows = slice(heads[a], heads[a + self.shard] if a + self.shard < len(heads) else len(found))
            told.append(self._shard(found[rows], following[rows], freq[rows]))
            a += self.shard
        if a >= len(heads):
            return [], 0
        return [[c[heads[a] :] for c in (found, following, freq)]], len(heads) - a

    def _shard(self, found: np.ndarray, following: np.ndarray, freq: np.ndarray) -> dict:
        from .sinks import HEADER, MAGIC, VERSION

        # rows of one next are added up
        new = np.flatnonzero(np.append(True, (found[1:] != found[:-1]) | (following[1:] != following[:-1])))
        freq, found, following = np.add.reduceat(freq, new), found[new], following[new]
        heads = np.append(True, found[1:] != found[:-1])
        nth = np.cumsum(heads) - 1
        by = np.lexsort((following, -freq, nth))
        freq, following, heads = freq[by], following[by], np.flatnonzero(heads)
        n, total = np.diff(np.append(heads, len(found))), np.add.reduceat(freq, heads)
        body = np.zeros(len(heads) + 2 * len(found), np.int64)
        at = np.arange(len(heads)) + 2 * heads
        body[at] = n
        place = nth + 1 + 2 * np.arange(len(found))
        body[place], body[place + 1] = following, freq
        if min(body.min(), total.min()) < 0 or max(body.max(), total.max(), 4 * len(body)) >> 32:
            raise ValueError("a table file holds numbers of 32 bits")
        size = 1 << (max(2 * len(heads), 16) - 1).bit_length()
        slots = np.zeros(size, _SLOT)
        h = found[heads].view(np.uint64)
        k, rest = (h % np.uint64(size)).astype(np.int64), np.arange(len(h))
        while len(rest):  # the first of those that want a free slot gets it, the others go on
            free = np.flatnonzero(slots["hash"][k] == 0)
            slot, first = np.unique(k[free], return_index=True)
            put = free[first]
            slots["hash"][slot], slots["offset"][slot], slots["total"][slot] = h[rest[put]], 4 * at[rest[put]], total[rest[put]]
            left = np.ones(len(rest), bool)
            left[put] = False
            k, rest = (k[left] + 1) % size, rest[left]
        name = f"shard-{uuid.uuid4().hex}.bin"
        with open(os.path.join(self.path, name), "wb") as f:
            f.write(HEADER.pack(MAGIC, VERSION, self.order, size, len(heads)))
            f.write(slots.tobytes())
            f.write(body.astype("<u4").tobytes())
        return {"file": name, "first": int(found[0]), "last": int(found[-1]), "contexts": len(heads)}

    def commit(self, messages: list) -> None:
        """The header of the shards takes the place of an older one in one step; then the older shards go."""
        os.makedirs(self.path, exist_ok=True)
        if not self.overwrite and os.path.exists(os.path.join(self.path, HEADER_FILE)):
            self.abort(messages)
            raise ValueError(f"{self.path} holds an n-gram table")
        some = sorted((s for m in messages if m is not None for s in m.shards), key=lambda s: s["first"])
        told = {"order": self.order, "contexts": sum(s["contexts"] for s in some), "shards": some}
        fresh = os.path.join(self.path, f".{uuid.uuid4().hex}.json")
        with open(fresh, "w", encoding="utf-8") as f:
            json.dump(told, f)
        os.replace(fresh, os.path.join(self.path, HEADER_FILE))
        kept = {s["file"] for s in some}
        for name in os.listdir(self.path):
            if name.startswith("shard-") and name not in kept:
                os.unlink(os.path.join(self.path, name))

    def abort(self, messages: list) -> None:
        for s in (s for m in messages if m is not None for s in m.shards):
            if os.path.exists(at := os.path.join(self.path, s["file"])):
                os.unlink(at)


class NgramFileSource(DataSource):
    """ctx_hash (FNV-1a of the context, as a signed long), next, freq."""

    @classmethod
    def name(cls) -> str:
        return "ngram_file"

    def schema(self) -> str:
        return "ctx_hash long, next long, freq long"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], int(self.options.get("order", "5")), overwrite, int(self.options.get("shard", str(SHARD))))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NgramFileSource)


def _hashes(lists: pa.Array) -> np.ndarray:
    """FNV-1a over the little-endian bytes of ids, as ``sinks.fnv1a``."""
    ids, sizes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).astype(np.uint32), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    first, h = np.cumsum(sizes) - sizes, np.full(len(sizes), 0xCBF29CE484222325, np.uint64)
    for i in range(int(sizes.max(initial=0))):
        some = np.flatnonzero(sizes > i)
        token, part = ids[first[some] + i], h[some]
        for shift in (0, 8, 16, 24):
            part = (part ^ (token >> np.uint32(shift) & np.uint32(255)).astype(np.uint64)) * np.uint64(0x100000001B3)
        h[some] = part
    return h


def write_table(table: DataFrame, path: str, order: int, shard: int = SHARD) -> None:
    """Writes (ctx array<int>, next int, freq int) as a folder of shards of at most ``shard`` contexts (a power of two, 8 at least), SHARD rows to a task.

    Rows of one context and next are added up.  The table is counted, then read once; ranges of hashes are equal, as hashes are even.
    """
    tasks = max(1, -(-table.count() // SHARD))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if any(c.null_count for c in batch.columns) or batch.column(0).flatten().null_count:
                raise ValueError("contexts, nexts or frequencies are null")
            h = _hashes(batch.column(0)).view(np.int64)
            part = ((h >> 32) + (1 << 31)) * tasks >> 32
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(h), batch.column(1), batch.column(2)], ["part", "ctx_hash", "next", "freq"])

    rows = table.select("ctx", F.col("next").cast("long").alias("next"), F.col("freq").cast("long").alias("freq")).mapInArrow(hashed, "part int, ctx_hash long, next long, freq long")
    rows = rows.repartitionById(tasks, "part").select("ctx_hash", "next", "freq").sortWithinPartitions("ctx_hash", "next")
    register(table.sparkSession)
    rows.write.format("ngram_file").option("order", order).option("shard", shard).mode("overwrite").save(path)


def write_packed(packed: DataFrame, path: str, order: int, shard: int = SHARD) -> None:
    """As ``write_table``, of windows as ``ngram.id_counts`` packs them: each range of hashes is a task's."""
    parts = (packed.agg(F.max("part")).first()[0] or 0) + 1
    writer = _Writer(path, order, True, shard)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = [np.frombuffer(t.as_buffer(), TOLD) for batch in batches for t in batch.column(0)]
        if told:
            told = np.concatenate(told)
            told = told[np.lexsort((told["next"], told["hash"].astype(np.int64)))]
            rows = [pa.array(told["hash"].astype(np.int64)), pa.array(told["next"].astype(np.int64)), pa.array(told["freq"])]
            found = writer.write(iter([pa.RecordBatch.from_arrays(rows, ["ctx_hash", "next", "freq"])]))
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(s) for s in found.shards])], ["shard"])

    found = packed.select("part", "told").repartitionById(parts, "part").select("told").mapInArrow(put, "shard string").collect()
    writer.commit([_Shards([json.loads(r["shard"]) for r in found])])


def totals(spark: SparkSession, path: str) -> DataFrame:
    """contexts, entries and freq of a table as tasks read it; a context is counted where its rows begin."""
    reader = _Reader(path)
    ranges = pa.table({"ranges": [json.dumps(p.ranges) for p in reader.partitions()]})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in batch.column(0).to_pylist():
                for rows in reader.read(_Slots(json.loads(some))):
                    h = rows.column(0).to_numpy()
                    told = [int((h[1:] != h[:-1]).sum()) + 1, len(h), pc.sum(rows.column(2)).as_py()]
                    yield pa.RecordBatch.from_arrays([pa.array([t], pa.int64()) for t in told], ["contexts", "entries", "freq"])

    each = spark.createDataFrame(ranges).repartition(len(ranges)).mapInArrow(count, "contexts long, entries long, freq long")
    return each.agg(F.coalesce(F.sum("contexts"), F.lit(0)).alias("contexts"), F.sum("entries").alias("entries"), F.sum("freq").alias("freq"))


class NgramTable:
    """Lookups in a folder of shards (or a table file): the shard by the range of the hash, then the file's slots."""

    def __init__(self, path: str):
        self.shards, self.open = shards(path), {}

    def lookup(self, ctx: list[int]) -> list[tuple[int, int]]:
        """(next, freq), most frequent first."""
        from .sinks import NgramFile, fnv1a

        h = fnv1a(ctx)
        signed = h - (1 << 64) if h >> 63 else h
        for s in self.shards:
            if s["first"] <= signed <= s["last"]:
                if s["file"] not in self.open:
                    self.open[s["file"]] = NgramFile(s["file"])
                return self.open[s["file"]].lookup(ctx)
        return []
