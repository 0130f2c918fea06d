"""Token ids in a binary format: canonical Huffman blocks in Parquet containers, written in doc_id order and read back.

1. Texts are encoded with the tokenizers library: their distinct chunks are found by Arrow, their words as the file's split
   pattern cuts them, and every word not met before goes to the library's batch call, many to a call; its ids are kept for
   the next time.  The end id is appended, and ids are kept in the shared folder as 16-bit integers (a vocabulary of more
   than 65,536 ids is refused); counts of each id are summed over all documents by the aggregation.
2. Counts (at most one for each id of the vocabulary) give code lengths of at most 16 bits.
3. Rows are range-partitioned and sorted by doc_id, and packed in blocks of whole documents; each block holds its document
   ids and lengths, the bit stream, and the bit offset of every 256th id.  The code lengths are stored with every file set.
4. Blocks are read back and decoded on their own; the offset of a document is the sum of the blocks before it.

Nulls and empty texts are the end id alone.  Rows that repeat a doc_id follow each other, in order of their ids' bytes.
An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import huffman
from .bpe import WordBpe, text_runs, vocabulary, worker_bpe
from .common import drop_at_exit, partitions, saved, scratch, small_batches

#: Ids to a block; a longer document is a block of its own.
BLOCK = 1 << 18
#: Words, and half as many chunks, that a worker keeps with their ids (about 200 bytes each).
STORED = 800_000
#: Bytes of text that are encoded together: more than elsewhere, as fewer runs look fewer chunks up.
RUN = 8 << 20
#: Words to one call of the library.
CALL = 20_000
BLOCK_SCHEMA = "part int, block int, n long, doc_ids binary, lengths binary, checkpoints binary, bits binary"


class LibraryBpe(WordBpe):
    """Encodes new words with the tokenizers library instead of merge rounds."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        super().__init__(spec)
        self.library = Tokenizer.from_str(spec)
        end = json.loads(spec)["model"]["end_of_word_suffix"]
        self.closing = np.array([s.endswith(end) for s in self.strings])

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [], []
        for a in range(0, len(words), CALL):
            some = words[a : a + CALL]
            flat = np.array(self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.closing[flat]) + 1  # the last id of each word bears the suffix
            if len(ends) == len(some):
                sizes.append(np.diff(ends, prepend=0))
            else:  # the library cuts one of these words again
                each = [e.ids for e in self.library.encode_batch_fast(some, add_special_tokens=False)]
                flat, n = np.array([i for e in each for i in e], np.int64), np.array([len(e) for e in each], np.int64)
                sizes.append(n)
            ids.append(flat)
        return np.concatenate(ids), np.append(0, np.cumsum(np.concatenate(sizes)))


def _ids(spec: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        bpe = worker_bpe(spec, LibraryBpe, STORED)
        if len(bpe.strings) > 1 << 16 or end >= 1 << 16:
            raise ValueError(f"{len(bpe.strings)} ids do not fit 16 bits")
        for rows, texts in text_runs(batches, limit=RUN):
            flat, n = bpe.encode(texts)
            flat = np.insert(flat, np.cumsum(n), end).astype(np.uint16)
            offsets = pa.py_buffer(np.append(0, np.cumsum(n + 1) * 2).astype(np.int64))
            counts = np.bincount(flat)
            used = np.flatnonzero(counts)
            ids = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, offsets, pa.py_buffer(flat)]).cast(pa.binary())
            # the first row of a run bears the run's counts
            pad = [None] * (len(texts) - 1)
            told = [pa.array([used.tolist(), *pad], pa.list_(pa.int32())), pa.array([counts[used].tolist(), *pad], pa.list_(pa.int64()))]
            yield from pa.table([rows.column("doc_id"), pa.array(n + 1, pa.int64()), ids, *told], ["doc_id", "n", "ids", "symbols", "counts"]).to_batches()

    return run


def _blocks(lengths: np.ndarray):
    codes = huffman.canonical_codes(lengths)

    def block(part: int, number: int, docs: list, sizes: list, ids: list) -> pa.RecordBatch:
        flat = np.frombuffer(b"".join(ids), np.uint16)
        bits, checkpoints = huffman.pack(flat, lengths, codes)
        values = [part, number, len(flat), np.array(docs, np.int64).tobytes(), np.array(sizes, np.int64).tobytes(), checkpoints.astype(np.int64).tobytes(), bits]
        types = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], ["part", "block", "n", "doc_ids", "lengths", "checkpoints", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, 0
        docs, sizes, ids = [], [], []
        for batch in batches:
            for doc, n, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if docs and held + n > BLOCK:
                    yield block(part, number, docs, sizes, ids)
                    docs, sizes, ids, held, number = [], [], [], 0, number + 1
                docs.append(doc)
                sizes.append(n)
                ids.append(x.as_buffer())
                held += n
        if docs:
            yield block(part, number, docs, sizes, ids)

    return run


def _read(lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = huffman.decoding_table(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                flat = huffman.unpack(row["bits"], np.frombuffer(row["checkpoints"], np.int64), row["n"], table)
                docs, sizes = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["lengths"], np.int64)
                ends = np.cumsum(sizes)
                raw = memoryview(flat.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                k = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(np.full(k, row["part"]), pa.int32()), pa.array(np.full(k, row["block"]), pa.int32()), pa.array(ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "part", "block", "inner", "n_tokens", "ids_crc32"],
                )

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary_path: str, end: int = 2) -> DataFrame:
    """Writes the ids of ``docs`` (doc_id, text) under ``path``/blocks and the code lengths under ``path``/codes; returns the blocks."""
    spark = docs.sparkSession
    encoded = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_ids(vocabulary(vocabulary_path), end), "doc_id long, n long, ids binary, symbols array<int>, counts array<long>")
    encoded = saved(encoded, "ids")
    counted = encoded.filter("symbols is not null").select(F.explode(F.arrays_zip("symbols", "counts")).alias("x")).groupBy("x.symbols").agg(F.sum("x.counts").alias("n")).collect()
    counts = np.zeros(1 << 16, np.int64)
    for symbol, n in counted:
        counts[symbol] = n
    lengths = huffman.code_lengths(counts)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codes")
    rows = encoded.select("doc_id", "n", "ids").repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "ids")
    with small_batches(spark):
        rows.mapInArrow(_blocks(lengths), BLOCK_SCHEMA).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    return spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")


def read_tokens(spark, path: str) -> DataFrame:
    """Per document of written files: doc_id, start, n_tokens, ids_crc32."""
    lengths = np.frombuffer(spark.read.schema("lengths binary").parquet(f"{path}/codes").first()[0], np.uint8)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    # Offsets: of parts (one row each on the driver's side of a window), then of blocks within their part.
    sizes = blocks.select("part", "block", "n")
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", F.coalesce("before", F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("inside", inside).join(parts, "part").select("part", "block", (F.col("before") + F.col("inside")).alias("offset"))
    docs = blocks.mapInArrow(_read(lengths), "doc_id long, part int, block int, inner long, n_tokens long, ids_crc32 long")
    return docs.join(offsets, ["part", "block"]).select("doc_id", (F.col("offset") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, vocabulary_path: str, end: int = 2) -> DataFrame:
    """Writes ``docs`` to token files in the shared folder and reads them back."""
    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, vocabulary_path, end)
    drop_at_exit(docs.sparkSession, path)
    return read_tokens(docs.sparkSession, path)
