"""N-gram tables: contexts of ``order`` tokens and what follows, in long form (ctx, next, freq).

Whole tables are counted in ``buckets``: neighbouring windows that have the least pair of tokens (by hash) in common move as one run of
tokens, some three tokens a window, to the bucket of that pair.  A context is in one bucket, so what is counted, ranked or summed by bucket
and context needs no other shuffle.  Tokens move and are counted as characters: the WORDS most frequent are numbered by falling frequency, and
each is the character of its number (one to four bytes); the others stand between two TOKEN_END as they are.  ``spelled`` gives words back.
"""

from __future__ import annotations

import hashlib
import re
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

#: Tokens to a step of a task, buckets to a partition; what ends a token and a run.
STEP, BUCKETS = 1_000_000, 8
TOKEN_END, RUN_END = "\x1f", "\x1e"
#: Words that have a character (some 20 MB in a join), tokens to a partition as far as there are PARTS at most.
WORDS, TOKENS, PARTS = 250_000, 1_000_000, 20_000
#: The characters, those of fewer bytes first.
CHARACTERS = np.r_[1:0x1E, 0x20:0xD800, 0xE000:0x110000]


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z]+", " "), " "), lambda w: w != "")


_LETTERS = bytes(c if ord("a") <= c <= ord("z") else 32 for c in range(256))


def _lists(c: pa.Array) -> pa.Array:
    """Lists of tokens; texts are split as ``tokens`` does."""
    if not (pa.types.is_string(c.type) or pa.types.is_large_string(c.type)):
        return c
    plain = pa.array([None if t is None else t.lower().encode().translate(_LETTERS).strip() or None for t in c.to_pylist()], pa.binary())
    return pc.ascii_split_whitespace(plain.cast(pa.string()))


def windows(docs: DataFrame, order: int = 5, column: str = "tokens", *keep: str, separator: str = " ") -> DataFrame:
    """One row for each run of ``order`` tokens that has a next: ctx (joined), next."""
    starts = F.when(F.size(column) > order, F.sequence(F.lit(1), F.size(column) - order)).otherwise(F.array().cast("array<int>"))
    rows = docs.withColumn("_at", F.explode(starts))
    return rows.select(*keep, F.array_join(F.slice(column, F.col("_at"), F.lit(order)), separator).alias("ctx"), F.element_at(column, F.col("_at") + order).alias("next"))


def crossing(docs: DataFrame, order: int = 5, key: str = "doc_id") -> DataFrame:
    """``docs`` in the order of ``key`` as one corpus: windows that lie in one document, and those that cross a boundary."""
    edge = crossing_edges(docs, order, key)
    return windows(docs, order).unionByName(windows(edge, order))


def crossing_edges(docs: DataFrame, order: int = 5, key: str = "doc_id") -> DataFrame:
    """(tokens): the ``order`` + 1 tokens of each window of ``docs``, in the order of ``key`` as one corpus, that crosses a boundary.

    Only the ends of documents are moved: the first and last ``order`` tokens of each, or all of a short one.  They are
    range-partitioned by ``key``, and windows are taken within each range; a range also gets the first tokens of
    those after it, from a table of one row for each range.
    """
    n = F.size("tokens")
    gap = F.array(F.lit(None).cast("string"))
    ends = docs.filter(n > 0).select(key, F.when(n >= 2 * order, F.concat(F.slice("tokens", F.lit(1), F.lit(order)), gap, F.slice("tokens", F.lit(-order), F.lit(order)))).otherwise(F.col("tokens")).alias("edge"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = ends.repartitionByRange(parts, key).withColumn("part", F.spark_partition_id()).select("part", key, F.posexplode("edge").alias("pos", "token"))
    first = cells.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy(key, "pos"))).filter(F.col("nth") <= order)
    heads = first.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "token"))), lambda x: x["token"]).alias("head"))
    later = F.slice(F.flatten(F.collect_list("head").over(Window.orderBy("part").rowsBetween(1, order))), 1, order)
    after = heads.select("part", later.alias("later")).select("part", F.posexplode("later").alias("pos", "token")).select("part", F.lit(None).cast(docs.schema[key].dataType).alias(key), "pos", "token")
    w = Window.partitionBy("part").orderBy(F.col(key).isNull(), key, "pos")
    rows = cells.unionByName(after).select(key, *[F.lead("token", i).over(w).alias(f"t{i}") for i in range(order + 1)], F.lead(key, order).over(w).alias("end"))
    whole = F.col("t0").isNotNull()
    for i in range(1, order + 1):
        whole = whole & F.col(f"t{i}").isNotNull()
    edge = rows.filter(F.col(key).isNotNull() & whole & (F.col("end").isNull() | (F.col("end") != F.col(key))))
    return edge.select(F.array(*[F.col(f"t{i}") for i in range(order + 1)]).alias("tokens"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


@dataclass(frozen=True)
class Vocabulary:
    """The most frequent words, by falling frequency, and how many tokens there are in all."""

    words: pa.Array
    tokens: int

    def frame(self, spark: SparkSession) -> DataFrame:
        """(code, word): the number of a word's character."""
        return spark.createDataFrame(pa.table([pa.array(CHARACTERS[: len(self.words)], pa.int32()), self.words], ["code", "word"]))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pc.value_counts(_lists(batch.column(0)).flatten())
        yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"])


def vocabulary(docs: DataFrame, column: str = "tokens") -> Vocabulary:
    """Words are counted over all of ``docs`` (tokens, or texts that tasks split); the driver holds the WORDS most frequent alone."""
    rows = docs.select(column).mapInArrow(_word_counts, "word string, n long").filter("word is not null")
    table = written(rows.groupBy("word").agg(F.sum("n").alias("n")), "words")
    top = 10_000  # rarer words are told apart by their number, one row for each
    by = table.groupBy(F.least("n", F.lit(top)).alias("n")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).orderBy(F.desc("n")).collect()
    held, least = 0, top
    for r in by:
        held += r["words"]
        if held > WORDS:
            break
        least = r["n"]
    some = table.filter(F.col("n") >= least).toArrow() if least < top else table.orderBy(F.desc("n"), "word").limit(WORDS).toArrow()
    some = some.sort_by([("n", "descending"), ("word", "ascending")])
    return Vocabulary(some.column("word").cast(pa.string()).combine_chunks() if some.num_rows else pa.array([], pa.string()), sum(r["tokens"] for r in by))


def _runs(words: pa.Array, sizes: np.ndarray, flags: np.ndarray, order: int, buckets: int, known: pa.Array, characters: pa.Array) -> pa.RecordBatch | None:
    """(bucket, flag, runs) of documents that lie one after the other."""
    if words.null_count:
        raise ValueError("tokens are null")
    coded = words.dictionary_encode()
    distinct, at = coded.dictionary.cast(pa.string()), coded.indices.to_numpy()
    if pc.any(pc.match_substring_regex(distinct, f"[{RUN_END}{TOKEN_END}]")).as_py():
        raise ValueError("tokens hold the characters U+001E or U+001F")
    number = pc.index_in(distinct, value_set=known)
    named = pc.coalesce(characters.take(number), pc.binary_join_element_wise(TOKEN_END, distinct, TOKEN_END, ""))
    joined = named.cast(pa.large_string()).take(pa.array(at))
    _, offsets, data = joined.buffers()
    off = np.frombuffer(offsets, np.int64)[joined.offset : joined.offset + len(joined) + 1]
    raw = np.frombuffer(data, np.uint8)
    h = np.array([zlib.crc32(w) for w in distinct.cast(pa.binary()).to_pylist()], np.uint64)[at]
    unit = h if order < 2 else _mixed(h[:-1] << np.uint64(32) | h[1:])
    n = len(words) - order
    least = np.min([unit[k : k + n] for k in range(max(1, order - 1))], 0)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(row[:n] == row[order:])
    if not len(at):
        return None
    least = least[at]
    new = np.append(True, (np.diff(at) != 1) | (least[1:] != least[:-1]))
    first, last = at[new], at[np.append(new[1:], True)] + order
    key = (_mixed(least[new]) >> np.uint64(20)) % np.uint64(buckets) * np.uint64(4) + flags[row[first]].astype(np.uint64)
    by = np.argsort(key, kind="stable")
    key, first, last = key[by], first[by], last[by]
    size = off[last + 1] - off[first] + 1  # one for the end of the run
    end = np.cumsum(size)
    place = np.arange(end[-1])
    place += np.repeat(off[first] - (end - size), size)
    out = raw[np.minimum(place, len(raw) - 1, out=place)]
    out[end - 1] = ord(RUN_END)
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    texts = pa.LargeStringArray.from_buffers(len(heads), pa.py_buffer(np.append((end - size)[heads], end[-1])), pa.py_buffer(out)).cast(pa.string())
    key = key[heads].astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(key // 4, pa.int32()), pa.array(key % 4, pa.int32()), texts], ["bucket", "flag", "runs"])


def _characters(c: Column) -> Column:
    """The tokens of a coded string."""
    return F.when(F.contains(c, F.lit(TOKEN_END)), F.regexp_extract_all(c, F.lit(f"{TOKEN_END}[^{TOKEN_END}]*{TOKEN_END}|[^{TOKEN_END}]"), F.lit(0))).otherwise(F.split(c, ""))


def spelled(table: DataFrame, words: Vocabulary, columns: tuple[str, ...] = ("ctx", "next"), order: int = 5) -> DataFrame:
    """``table`` with words for the characters of ``columns``; its rows stay in their partitions."""
    named, every = words.frame(table.sparkSession), table.columns
    for column in columns:
        rows, parts = table.withColumn("_tokens", _characters(F.col(column))), []
        for i in range(order if column == "ctx" else 1):
            word = named.select(F.col("code").alias("_code"), F.col("word").alias(f"_word{i}"))
            rows = rows.withColumn(f"_token{i}", F.col("_tokens")[i]).join(F.broadcast(word), F.ascii(f"_token{i}") == F.col("_code"), "left").drop("_code")
            parts.append(F.coalesce(f"_word{i}", F.expr(f"substring(_token{i}, 2, char_length(_token{i}) - 2)")))
        table = rows.withColumn(column, F.concat_ws(" ", *parts)).select(*every)
    return table


def _dealt(docs: DataFrame, order: int, words: Vocabulary) -> DataFrame:
    """(bucket, flag, runs) of documents (tokens, flag), dealt by bucket."""
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(PARTS, -(-words.tokens // TOKENS)))
    known, numbers = words.words, CHARACTERS[: len(words.words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        characters = pa.array([chr(c) for c in numbers], pa.string())
        for batch in batches:
            lists, flags = _lists(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            tokens, sizes = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, a = np.append(0, np.cumsum(sizes)), 0
            while a < len(sizes):  # whole documents, some STEP tokens at once
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + STEP, "right")) - 1)
                if ends[b] - ends[a] > order and (found := _runs(tokens.slice(ends[a], ends[b] - ends[a]), sizes[a:b], flags[a:b], order, parts * BUCKETS, known, characters)) is not None:
                    yield found
                a = b

    return docs.mapInArrow(run, "bucket int, flag int, runs string").repartition(parts, "bucket")


def bucket_counts(docs: DataFrame, order: int = 5, column: str = "tokens", held: Column | None = None, asked: Column | None = None, words: Vocabulary | None = None, spell: tuple[str, ...] = ("ctx", "next")) -> DataFrame:
    """(bucket, ctx, next, freq, asked): how often a window occurs in the documents that are ``held`` (all if none are told), and in those ``asked`` (none).

    Tokens must not be null or hold the characters U+001E and U+001F.  Null token arrays have no windows.  words: the ``vocabulary``
    of these or other documents, if it is there.  What ``spell`` leaves out stays coded, to be ``spelled`` when there are fewer rows.
    """
    words = words or vocabulary(docs, column)
    flag = F.coalesce(held if held is not None else F.lit(True), F.lit(False)).cast("int") + 2 * F.coalesce(asked if asked is not None else F.lit(False), F.lit(False)).cast("int")
    rows = _dealt(docs.select(F.col(column).alias("tokens"), flag.alias("flag")), order, words)
    rows = rows.select("bucket", "flag", F.explode(F.split("runs", RUN_END)).alias("run")).select("bucket", "flag", _characters(F.col("run")).alias("tokens"))
    both = [F.count_if(F.col("flag").bitwiseAND(bit) > 0).alias(name) for bit, name in ((1, "freq"), (2, "asked"))]
    table = windows(rows, order, "tokens", "bucket", "flag", separator="").groupBy("bucket", "ctx", "next").agg(*(both if asked is not None else [both[0]]))
    return spelled(table, words, spell, order)


#: Bits of a code within a key; windows that a task holds, rows that it gives at once; the first id of words without a character.
CODE, HELD, GIVEN = 21, 3_000_000, 200_000
RARE = 0x110000
#: What is told of a window: the hash of its context, its next, and how often it occurs.
TOLD = np.dtype([("hash", "<u8"), ("next", "<u4"), ("freq", "<i8")])


class _Windows:
    """Windows of a task as whole numbers, three codes to a key, and how often each occurs.  Words without a character get unused ones, of this task."""

    def __init__(self, order: int, first: int):
        self.order, self.first = order, first
        self._cleared()

    def _cleared(self) -> None:
        self.rare, self.told, self.size = {}, [], 0

    def _rare(self, found: re.Match) -> str:
        return chr(self.first + self.rare.setdefault(found[0], len(self.rare)))

    @property
    def full(self) -> bool:
        return self.size > HELD or 2 * len(self.rare) > RARE - self.first

    def add(self, text: str) -> None:
        if TOKEN_END in text:
            text = re.sub(f"{TOKEN_END}[^{TOKEN_END}]*{TOKEN_END}", self._rare, text)
        codes, width = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64), self.order + 1
        ends = np.append(0, np.cumsum(codes == ord(RUN_END)))
        at = np.flatnonzero(ends[width:] == ends[:-width]) if len(codes) >= width else np.array([], np.int64)
        keys = []
        for k in range(0, width, 3):
            key = np.zeros(len(at), np.uint64)
            for i in range(k, min(k + 3, width)):
                key = key << np.uint64(CODE) | codes[at + i]
            keys.append(key)
        self._merged([(keys, np.ones(len(at), np.int64))])
        if len(self.told) > 8:
            told, self.told, self.size = self.told, [], 0
            self._merged(told)

    def _merged(self, some: list) -> None:
        keys, n = [np.concatenate(k) for k in zip(*(k for k, _ in some), strict=True)], np.concatenate([n for _, n in some])
        if not len(n):
            return
        by = np.lexsort(keys[::-1])
        keys = [k[by] for k in keys]
        heads = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], 0)))
        self.told.append(([k[heads] for k in keys], np.add.reduceat(n[by], heads)))
        self.size += len(heads)

    def given(self, parts: int) -> Iterator[pa.RecordBatch]:
        if self.told:
            told, self.told = self.told, []
            self._merged(told)
            [(keys, n)] = self.told
            # a digest tells rare words apart in all tasks alike
            rare = [RARE + int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") % ((1 << 31) - RARE) for w in self.rare]
            ids, width = np.append(np.arange(self.first), rare).astype("<u4"), self.order + 1
            rows = np.empty((len(n), width), "<u4")
            for i in range(width):
                after = min(i // 3 * 3 + 3, width) - 1 - i
                rows[:, i] = ids[keys[i // 3] >> np.uint64(CODE * after) & np.uint64((1 << CODE) - 1)]
            h = fnv1a_rows(rows[:, :-1])
            # in the order of signed numbers
            part = ((h >> np.uint64(32) ^ np.uint64(1 << 31)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
            by = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[by], np.arange(parts + 1))
            for k in np.flatnonzero(np.diff(edges)):
                for a in range(edges[k], edges[k + 1], GIVEN):
                    some = by[a : min(a + GIVEN, edges[k + 1])]
                    told = np.empty(len(some), TOLD)
                    told["hash"], told["next"], told["freq"] = h[some], rows[some, -1], n[some]
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([len(some)], pa.int64()), pa.array([rows[some, :-1].tobytes()], pa.binary()), pa.array([told.tobytes()], pa.binary())], ["part", "n", "ctx", "told"])
        self._cleared()


def fnv1a_rows(ids: np.ndarray) -> np.ndarray:
    """FNV-1a over the little-endian bytes of the ids of each row."""
    h = np.full(len(ids), 0xCBF29CE484222325, np.uint64)
    for i in range(ids.shape[1]):
        for shift in (0, 8, 16, 24):
            h = (h ^ (ids[:, i].astype(np.uint32) >> np.uint32(shift) & np.uint32(255)).astype(np.uint64)) * np.uint64(0x100000001B3)
    return h


def id_counts(docs: DataFrame, order: int = 5, column: str = "tokens") -> DataFrame:
    """(part, n, ctx, told): how often windows occur, by ids of words: that of a frequent word is its character, that of another a digest of 31 bits.

    A row packs ``n`` windows, of one of equal ranges of the hash of contexts: ``ctx`` are the ids of each, ``told`` the TOLD of each.  Tasks count
    the windows of their buckets as numbers.  Where more than HELD differ in one task, a window may come several times, to be added up.
    """
    words = vocabulary(docs, column)
    first, parts = int(CHARACTERS[len(words.words)]), max(1, -(-words.tokens // TOKENS))
    rows = _dealt(docs.select(F.col(column).alias("tokens"), F.lit(1).alias("flag")), order, words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, texts, size = _Windows(order, first), [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                texts.append(text)
                size += len(text)
                if size >= STEP:
                    found.add("".join(texts))
                    texts, size = [], 0
                    if found.full:
                        yield from found.given(parts)
        found.add("".join(texts))
        yield from found.given(parts)

    return rows.select("runs").mapInArrow(count, "part int, n long, ctx binary, told binary")


def id_rows(packed: DataFrame, order: int = 5, share: float = 1.0) -> DataFrame:
    """(ctx array<int>, next int, freq long) of ``id_counts``: of the ``share`` of contexts whose hash, mixed again, is least."""
    most = np.uint64(min(int(share * 2**32), 2**32))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ctx, told in zip(batch.column(0), batch.column(1), strict=True):
                told = np.frombuffer(told.as_buffer(), TOLD)
                some = np.flatnonzero(_mixed(_mixed(told["hash"])) >> np.uint64(32) < most)
                ids = np.frombuffer(ctx.as_buffer(), "<u4").reshape(-1, order)[some].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * order), pa.array(ids.ravel()))
                yield pa.RecordBatch.from_arrays([lists, pa.array(told["next"][some].astype(np.int32)), pa.array(told["freq"][some])], ["ctx", "next", "freq"])

    return packed.select("ctx", "told").mapInArrow(unpack, "ctx array<int>, next int, freq long")


def counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("ctx", "next").agg(F.count("*").alias("freq"))


def _context(table: DataFrame) -> list[str]:
    """What tells contexts apart, and how they are dealt."""
    return ["bucket", "ctx"] if "bucket" in table.columns else ["ctx"]


def pruned(table: DataFrame, least: int = 1, most: int = 64) -> DataFrame:
    """Contexts with a total of ``least`` or more, and of each the ``most`` most frequent nexts (ties by next); by bucket, if there is one."""
    w = Window.partitionBy(*_context(table))
    rows = table.withColumn("total", F.sum("freq").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.col("freq").desc(), "next")))
    return rows.filter((F.col("total") >= least) & (F.col("rank") <= most))


def lookup(queries: DataFrame, table: DataFrame, top: int = 3, least: float = 0.05) -> DataFrame:
    """queries: query_id, ctx; the ``top`` nexts of each with probability ``least`` or more."""
    rows = table if "total" in table.columns else table.join(table.groupBy("ctx").agg(F.sum("freq").alias("total")), "ctx")
    hits = queries.select("query_id", "ctx").distinct().join(rows, "ctx").withColumn("p", F.round(F.col("freq") / F.col("total"), 6)).filter(F.col("p") >= least)
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "ctx").orderBy(F.col("freq").desc(), "next"))).filter(F.col("rank") <= top).drop("total")


def asked_nexts(table: DataFrame) -> DataFrame:
    """(ctx, next, freq, total) of the contexts of ``bucket_counts`` that are asked for."""
    w = Window.partitionBy("bucket", "ctx")
    rows = table.withColumn("total", F.sum("freq").over(w)).withColumn("_asked", F.sum("asked").over(w))
    return rows.filter("_asked > 0 and freq > 0").select("ctx", "next", "freq", "total")


def bucket_coverage(table: DataFrame) -> DataFrame:
    """``coverage`` of what is asked by what is held, of ``bucket_counts``."""
    w = Window.partitionBy("bucket", "ctx")
    rows = table.withColumn("total", F.sum("freq").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.col("freq").desc(), "next")))
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("asked")).otherwise(0)), F.lit(0))
    return rows.agg(some(F.lit(True)).alias("windows"), some(F.col("total") > 0).alias("covered"), some((F.col("freq") > 0) & (F.col("rank") == 1)).alias("top1"), some((F.col("freq") > 0) & (F.col("rank") <= 5)).alias("top5"))


def coverage(queries: DataFrame, table: DataFrame) -> DataFrame:
    """Of windows (ctx, next): how many contexts are known, and how often the next is the first or in the first five."""
    ranked = table.withColumn("rank", F.row_number().over(Window.partitionBy("ctx").orderBy(F.col("freq").desc(), "next")))
    best = ranked.filter("rank <= 5").select("ctx", F.col("next").alias("guess"), "rank")
    hit = queries.join(best.withColumnRenamed("guess", "next"), ["ctx", "next"], "left").select("ctx", "rank")
    known = table.select("ctx").distinct().withColumn("known", F.lit(True))
    rows = hit.join(known, "ctx", "left")
    return rows.agg(F.count("*").alias("windows"), F.count_if(F.col("known")).alias("covered"), F.count_if(F.col("rank") == 1).alias("top1"), F.count_if(F.col("rank") <= 5).alias("top5"))


def stats(table: DataFrame) -> DataFrame:
    by = table.groupBy(*_context(table)).agg(F.count("*").alias("nexts"), F.sum("freq").alias("freq"))
    return by.agg(F.count("*").alias("entries"), F.sum("freq").alias("total_freq"), F.max("freq").alias("max_freq"), F.round(F.avg("nexts"), 4).alias("avg_nexts"), F.max("nexts").alias("max_nexts"))
