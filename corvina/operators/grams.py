"""Gram posting lists: which of many short strings are part of which texts, without comparing each with each.

A gram is a run of one to SIZE bytes of a text's UTF-8 form, as a number.  A string that is part of a text has all its grams among the
text's, so the documents that hold the rarest grams of a string are all that can hold it; ``contains`` then decides.
Postings (gram, doc) are distinct; a gram that most texts have is never the rarest of a string that has any other.

Null texts and strings have no grams and are never part of anything; the empty string is part of nothing here.  Rows that repeat an id
with different texts are told apart where the texts are joined back.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import retrieve

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

#: Bytes to the longest gram, grams of a string that candidates must hold, folders of an index, bytes of text to a step of a task.
SIZE, RAREST, BUCKETS, STEP = 3, 3, 64, 1 << 20
#: Rows of grams or ids that may be broadcast (some 100 bytes each once hashed).
BROADCAST = 500_000


def _distinct(raw: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram) of the distinct grams of ``size`` bytes of texts that lie one after the other."""
    n = len(raw) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.full(n, size, np.int64)
    for k in range(size):
        code = code << 8 | raw[k : k + n]
    row = np.searchsorted(off, np.arange(n), "right") - 1
    whole = np.arange(n) + size <= off[row + 1]
    both = np.unique(row[whole] << 32 | code[whole])
    return both >> 32, both & 0xFFFFFFFF


def _grams(sizes: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            _, offsets, data = texts.buffers()
            off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw, a = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), 0
            while a < len(texts):  # whole texts, some STEP bytes at once
                b = max(a + 1, int(np.searchsorted(off, off[a] + STEP, "right")) - 1)
                for size in sizes:
                    row, gram = _distinct(raw[off[a] : off[b]], off[a : b + 1] - off[a], size)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + a)), pa.array(gram)], ["id", "gram"])
                a = b

    return run


def postings(rows: DataFrame, key: str, text: str, *sizes: int) -> DataFrame:
    """(id, gram): the distinct grams of each row's text, of ``sizes`` bytes (SIZE if none are given)."""
    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("id"), F.col(text).alias("text")).filter("text <> ''").mapInArrow(_grams(sizes or (SIZE,)), f"id {kind}, gram long")


def string_grams(strings: DataFrame, string: str) -> DataFrame:
    """(string, gram): the longest grams of each distinct string, so one gram of a string of SIZE bytes or fewer."""
    rows = strings.select(F.col(string).alias("string")).filter("string <> ''").distinct()
    size = F.least(F.octet_length("string"), F.lit(SIZE))
    every = [postings(rows.filter(size == n), "string", "string", n) for n in range(1, SIZE + 1)]
    out = every[0]
    for more in every[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("id", "string")


def _broadcast(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= BROADCAST else rows


def candidates(grams: DataFrame, texts: DataFrame, rarest: int = RAREST) -> DataFrame:
    """(string, id) of texts that hold the ``rarest`` rarest grams of a string.  grams: string, gram; texts: postings, written."""
    from ..session import written

    asked = written(grams, "asked")
    wanted = asked.select("gram").distinct()
    held = written(texts.join(_broadcast(wanted, wanted.count()), "gram", "left_semi"), "held")
    # counted by the tasks first: a gram that a third of all texts hold is one row a task
    often = held.groupBy("gram").agg(F.count("*").alias("n"))
    ranked = asked.join(often, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    chosen = ranked.groupBy("string").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "gram"))), 1, rarest).alias("g"))
    chosen = chosen.filter(F.col("g")[0]["n"] > 0)  # a gram that no text has
    probes = written(chosen.select("string", F.size("g").alias("need"), F.explode("g.gram").alias("gram")), "probes")
    met = held.join(_broadcast(probes, probes.count()), "gram").groupBy("string", "id").agg(F.count("*").alias("n"), F.first("need").alias("need"))
    return met.filter("n = need").select("string", "id")


def contained(texts: DataFrame, strings: DataFrame, key: str = "text_id", text: str = "text", string: str = "string") -> DataFrame:
    """Distinct (``key``, string): which ``strings`` are part of which texts, as written.  texts: ``key``, ``text``."""
    rows = texts.select(F.col(key).alias("id"), F.col(text).alias("_text"))
    sizes = tuple(range(1, SIZE + 1))
    short = strings.filter(F.octet_length(string) < SIZE).limit(1)
    found = candidates(string_grams(strings, string), postings(rows, "id", "_text", *((SIZE,) if short.isEmpty() else sizes)))
    hits = found.join(rows, "id").filter(F.contains("_text", "string"))
    return hits.select(F.col("id").alias(key), F.col("string").alias(string)).distinct()


def windows(texts: DataFrame, strings: DataFrame, key: str, text: str, string: str) -> DataFrame:
    """(``key``, string) of the runs of characters of short texts that may be one of ``strings``: by length, first and last SIZE characters.

    For strings with few rare grams, such as numbered names, whose texts would be candidates of each other.  The shapes of the strings
    are counted: where they are too many to broadcast, the last characters are left out, and what is left is joined by shuffle.
    """
    from ..session import written

    told = strings.select(F.col(string).alias("string")).filter("string <> ''")
    shape = [F.substring("string", 1, SIZE).alias("head"), F.length("string").alias("n")]
    shapes = written(told.select(*shape, F.right("string", F.lit(SIZE)).alias("tail")).distinct(), "shapes")
    few = written(shapes.select("head", "n").distinct(), "short-shapes")
    short = not few.filter(F.col("n") < SIZE).isEmpty()
    rows = texts.select(F.col(key).alias("_id"), F.col(text).alias("_text"), F.explode(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))).alias("_at"))
    rows = rows.withColumn("_size", F.explode(F.sequence(F.lit(1), F.lit(SIZE)))) if short else rows.withColumn("_size", F.lit(SIZE))
    rows = rows.filter(F.col("_at") + F.col("_size") - 1 <= F.length("_text")).withColumn("head", F.substring("_text", F.col("_at"), F.col("_size")))
    met = rows.join(_broadcast(few, few.count()), "head").filter(F.col("_at") + F.col("n") - 1 <= F.length("_text")).withColumn("string", F.substring("_text", F.col("_at"), F.col("n")))
    if shapes.count() <= BROADCAST:
        met = met.withColumn("tail", F.right("string", F.lit(SIZE))).join(F.broadcast(shapes), ["head", "n", "tail"], "left_semi")
    return met.select(F.col("_id").alias(key), F.col("string").alias(string))


@dataclass(frozen=True)
class GramIndex:
    """Postings of a collection under ``root``, in folders by gram; readers of a few grams read their folders only."""

    root: str
    spark: SparkSession

    def postings(self, grams: DataFrame) -> DataFrame:
        """Of the grams asked for (gram): (id, gram)."""
        rows = self.spark.read.parquet(self.root)
        # at most BUCKETS numbers
        some = sorted(r["bucket"] for r in grams.select(F.expr(f"cast(pmod(gram, {BUCKETS}) as int)").alias("bucket")).distinct().collect())
        return rows.filter(F.col("bucket").isin(some)).select("id", "gram")

    def holding(self, strings: DataFrame, string: str = "string") -> DataFrame:
        """(string, id) of documents that may hold a string of SIZE bytes or more."""
        grams = string_grams(strings.filter(F.octet_length(string) >= SIZE), string)
        return candidates(grams, self.postings(grams))


def build(docs: DataFrame, root: str, key: str = "doc_id", text: str = "text") -> GramIndex:
    """Writes the postings of ``docs`` under ``root``; ``add`` of further documents is a second call."""
    rows = postings(docs, key, text).withColumn("bucket", F.expr(f"cast(pmod(gram, {BUCKETS}) as int)"))
    # a folder is several files, so that a common gram is no task's alone
    rows = rows.repartition(F.col("bucket"), F.expr("pmod(xxhash64(id), 4)")).sortWithinPartitions("bucket", "gram")
    rows.write.mode("append").partitionBy("bucket").parquet(root)
    return GramIndex(root, docs.sparkSession)


def keyword_hits(index: GramIndex, queries: DataFrame, docs: DataFrame, k: int, first: int = 4) -> DataFrame:
    """``retrieve.keyword_hits`` by an index: the same rows for keywords of SIZE bytes or more, but documents meet only queries whose keywords they may hold.

    queries: query_id, words (array); docs: doc_id, text, of which the index was built.
    """
    from ..session import written

    asked = queries.select("query_id", F.explode(F.slice("words", 1, first)).alias("string"))
    pairs = index.holding(asked).join(asked, "string").select("query_id", F.col("id").alias("doc_id")).distinct()
    pairs = written(pairs, "pairs")
    ids = pairs.select("doc_id").distinct()
    some = docs.select("doc_id", "text").join(_broadcast(ids, ids.count()), "doc_id", "left_semi")
    rows = some.join(pairs, "doc_id").join(_broadcast(queries.select("query_id", "words"), queries.count()), "query_id")
    held = F.exists(F.slice("words", 1, first), lambda w: F.contains("text", w))
    hits = F.expr("cast(transform(array(lower(text)), low -> size(filter(words, w -> contains(low, w))))[0] as long)")
    flat = rows.filter(held).select("query_id", "doc_id", hits.alias("hits"), F.substring("text", 1, 100).alias("head")).filter("hits > 0")
    return retrieve.ranked_heads(flat, k)
