"""Dense and keyword retrieval, rank fusion, diversity.  Rank is an explicit column; equal scores are ordered by id."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lexicons import DEFAULT, Lexicon

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def top_k(rows: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each group with ``rank``; planned as a group limit before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= k)


#: Rows of a stated query set to a block (64 floats take 0.3 KB, 20 words as much), and the blocks that are broadcast together.
QUERY_BLOCK, BLOCKS = 4096, 32


def _blocks(queries: DataFrame, *fields: str) -> tuple[DataFrame, int]:
    """A counted query set as rows (block, qs): arrays of about half of QUERY_BLOCK (query_id, fields...), and how many blocks there are."""
    n = queries.count()
    blocks = -(-2 * n // QUERY_BLOCK) if n > QUERY_BLOCK else 1  # by hash: half full on average, so that none is too large
    packed = queries.groupBy(F.expr(f"cast(pmod(xxhash64(query_id), {blocks}) as int)").alias("block")).agg(F.collect_list(F.struct("query_id", *fields)).alias("qs"))
    return packed, blocks


def _asked(rows: DataFrame, packed: tuple[DataFrame, int], keep: list[str], hits: Column) -> DataFrame:
    """Rows met by each block of queries: ``keep`` and the fields of the structs that ``hits`` makes of ``qs``.

    A row is read once for BLOCKS blocks, which it is joined to by their number.
    """
    blocks, n = packed
    found = []
    for a in range(0, n, BLOCKS):
        dealt = rows.withColumn("block", F.explode(F.sequence(F.lit(a), F.lit(min(n, a + BLOCKS) - 1))))
        some = dealt.join(F.broadcast(blocks.filter(F.col("block").between(a, a + BLOCKS - 1))), "block")
        found.append(some.select(*keep, hits.alias("hits")).select(*keep, F.inline("hits")))
    return reduce(lambda x, y: x.unionByName(y), found)


#: Queries that a task multiplies with a batch at once.
STEP = 256


def _by_width(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Arrays without nulls by their length: where they are, and a matrix.  A null makes every product null, as another length does."""
    bad = np.zeros(len(column), bool)
    flat, sizes = column.flatten(), pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    if flat.null_count:
        row = np.repeat(np.arange(len(column)), np.maximum(sizes, 0))
        bad[row[flat.is_null().to_numpy(zero_copy_only=False)]] = True
    start = np.append(0, np.cumsum(np.maximum(sizes, 0)))
    values = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.float64)
    told = {}
    for width in np.unique(sizes[(sizes >= 0) & ~bad]):
        at = np.flatnonzero((sizes == width) & ~bad)
        told[int(width)] = at, values[start[at, None] + np.arange(width)]
    return told


def _nearest(asked: pa.Table, k: int, least: float):
    """Of batches (vec_id, embedding): (query_id, vec_id, product) of all that may be among the k best of a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = asked.column("query_id").combine_chunks(), _by_width(asked.column("q").combine_chunks())
        with np.errstate(all="ignore"):
            for batch in batches:
                for width, (rows, vectors) in _by_width(batch.column(1)).items():
                    where, m = queries.get(width, ([], None))
                    longest = np.sqrt((vectors * vectors).sum(1)).max()
                    for a in range(0, len(where), STEP):
                        some = m[a : a + STEP]
                        sims = some @ vectors.T
                        sims[np.isnan(sims)] = np.inf  # the largest of all, as Spark has it
                        best = np.partition(sims, -k, 1)[:, -k] if len(rows) > k else np.full(len(some), -np.inf)
                        # rounding to five places and another order of summing move a product by less
                        slack = 2e-5 + 1e-12 * longest * np.sqrt((some * some).sum(1))
                        q, v = np.nonzero(~(sims < (np.maximum(best, least) - slack)[:, None]))
                        total = np.zeros(len(q))
                        for i in range(width):  # in order, as an aggregate adds them up
                            total += some[q, i] * vectors[v, i]
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(where[q + a])), batch.column(0).take(pa.array(rows[v])), pa.array(total)], ["query_id", "vec_id", "product"])

    return run


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int, least: float = 0.0) -> DataFrame:
    """(query_id, vec_id, sim, rank) by inner product.  queries: query_id, q; vectors: vec_id, embedding.

    Up to BLOCKS * QUERY_BLOCK queries go to the tasks as a matrix, more are joined in blocks.
    """
    if queries.count() <= BLOCKS * QUERY_BLOCK:
        kind = {**dict(queries.dtypes), **dict(vectors.dtypes)}
        rows = vectors.select("vec_id", "embedding").mapInArrow(_nearest(queries.select("query_id", "q").toArrow(), k, float(least)), f"query_id {kind['query_id']}, vec_id {kind['vec_id']}, product double")
        flat = rows.select("vec_id", "query_id", F.round("product", 5).alias("sim")).filter(F.col("sim") >= float(least))
    else:
        sims = "transform(qs, s -> struct(s.query_id as query_id, round(aggregate(zip_with(s.q, embedding, (x, y) -> cast(x as double) * cast(y as double)), 0D, (a, x) -> a + x), 5) as sim))"
        flat = _asked(vectors, _blocks(queries, "q"), ["vec_id"], F.expr(f"filter({sims}, s -> s.sim >= {float(least)})"))
    return top_k(flat, "query_id", k, F.col("sim").desc(), F.col("vec_id"))


def keywords(c: Column, lex: Lexicon = DEFAULT, least: int = 3) -> Column:
    """Lower-cased words of a query of ``least`` characters or more, without stop words, in order."""
    return F.filter(F.split(F.lower(c), r"\s+"), lambda w: (F.length(w) >= least) & ~w.isin(*lex.keyword_stops))


def keyword_hits(queries: DataFrame, docs: DataFrame, k: int, first: int = 4) -> DataFrame:
    """(query_id, doc_id, hits, rank): how many of a query's keywords a document holds, as parts of its lower-cased text.

    queries: query_id, words (array); docs: doc_id, text.  A document is a hit if it holds one of the ``first`` keywords as
    written; of documents whose first 100 characters agree the first stands for all.
    """
    any_of = f"exists(slice(s.words, 1, {first}), w -> contains(text, w))"
    counted = f"transform(qs, s -> struct(s.query_id as query_id, if({any_of}, cast(size(filter(s.words, w -> contains(low, w))) as long), 0L) as hits))"
    flat = _asked(docs.select("doc_id", "text"), _blocks(queries, "words"), ["doc_id", "text"], F.expr(f"transform(array(lower(text)), low -> filter({counted}, s -> s.hits > 0))[0]"))
    flat = flat.select("query_id", "doc_id", "hits", F.substring("text", 1, 100).alias("head"))
    return ranked_heads(flat, k)


def ranked_heads(hits: DataFrame, k: int) -> DataFrame:
    """The k documents with most hits of each query; hits: query_id, doc_id, hits, and the ``head`` that copies share."""
    once = hits.withColumn("_rn", F.row_number().over(Window.partitionBy("query_id", "head").orderBy("doc_id"))).filter("_rn = 1").drop("_rn", "head")
    return top_k(once, "query_id", k, F.col("hits").desc(), F.col("doc_id"))


def keyword_hits_by_word(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, hits, rank) by whole words, by an inverted join: for query sets of any size.

    queries: query_id, words (array); docs: doc_id, words (array).  Rare keywords meet few rows; a frequent keyword's
    rows are split by AQE.
    """
    asked = queries.select("query_id", F.explode("words").alias("word"))
    held = docs.select("doc_id", F.explode("words").alias("word")).join(asked.select("word").distinct(), "word", "left_semi")
    hits = asked.join(held, "word").groupBy("query_id", "doc_id").agg(F.count("*").alias("hits"))
    return top_k(hits, "query_id", k, F.col("hits").desc(), F.col("doc_id"))


def bm25(queries: DataFrame, docs: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """True BM25 (an extra): docs: doc_id, words with repeats."""
    sized = docs.select("doc_id", "words", F.size("words").alias("dl"))
    stats = sized.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    asked = queries.select("query_id", F.explode(F.array_distinct("words")).alias("word"))
    tf = sized.select("doc_id", "dl", F.explode("words").alias("word")).join(asked.select("word").distinct(), "word", "left_semi").groupBy("doc_id", "dl", "word").agg(F.count("*").alias("tf"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    part = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = asked.join(tf, "word").join(df, "word").join(F.broadcast(stats)).groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 4).alias("score"))
    return top_k(scored, "query_id", k, F.col("score").desc(), F.col("doc_id"))


def rrf_by_url(hits: DataFrame, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of lists (query_id, list_id, rank, url): repeats and blanks within a list go before ranks are given."""
    rows = hits.filter("url is not null and url <> ''").groupBy("query_id", "list_id", "url").agg(F.min("rank").alias("rank"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "list_id").orderBy("rank")))
    fused = rows.groupBy("query_id", "url").agg(F.sum(1 / (constant + F.col("place"))).alias("s"), F.min(F.struct("list_id", "place")).alias("seen"))
    fused = fused.withColumn("rrf", F.round("s", 5)).withColumn("relevance", F.round(F.col("s") * 20, 3))
    order = Window.partitionBy("query_id").orderBy(F.col("rrf").desc(), F.col("seen.list_id"), F.col("seen.place"))
    return fused.withColumn("position", F.row_number().over(order)).select("query_id", "url", "rrf", "relevance", "position")


def rrf_hybrid(dense: DataFrame, sparse: DataFrame, constant: int = 60) -> DataFrame:
    """Fusion of two lists (query_id, doc_id, rank), without removing repeats within a list."""
    every = dense.select("query_id", "doc_id", "rank").unionByName(sparse.select("query_id", "doc_id", "rank"))
    fused = every.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (constant + F.col("rank"))), 6).alias("rrf"))
    return fused.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rrf").desc(), "doc_id")))


def rrf_by_text(dense: DataFrame, sparse: DataFrame, constant: int = 60) -> DataFrame:
    """Fusion of two lists (query_id, doc_id, text, rank) whose entries are one where their first 100 characters agree.

    Scores of repeats add up.  An entry carries its last dense document, else its first sparse one; equal scores keep the order of arrival.
    """
    lists = [x.select("query_id", "doc_id", "text", "rank", F.lit(i).alias("list")) for i, x in enumerate((dense, sparse))]
    every = lists[0].unionByName(lists[1]).withColumn("head", F.substring("text", 1, 100))
    # the last of the dense list, the first of the sparse one
    told = F.struct((1 - F.col("list")).alias("dense"), F.when(F.col("list") == 0, F.col("rank")).otherwise(-F.col("rank")).alias("late"))
    fused = every.groupBy("query_id", "head").agg(F.round(F.sum(1 / (constant + F.col("rank"))), 6).alias("rrf"), F.min(F.struct("list", "rank")).alias("seen"), F.max_by(F.struct("doc_id", "text"), told).alias("d"))
    order = Window.partitionBy("query_id").orderBy(F.col("rrf").desc(), "seen.list", "seen.rank")
    return fused.withColumn("position", F.row_number().over(order)).select("query_id", "d.doc_id", "d.text", "rrf", "position")


def diverse(chunks: DataFrame, ratio: float = 0.5, by_rank: bool = False) -> DataFrame:
    """At most a share of a query's chunks from one url, unchanged where there is one; chunks: query_id, url, rank.

    The first chunk of each url comes first, then the second, urls in the order in which they first occur, or ``by_rank`` of the chunks of that turn.
    """
    w = Window.partitionBy("query_id")
    rows = chunks.withColumn("urls", F.size(F.collect_set(F.coalesce("url", F.lit(""))).over(w))).withColumn("cap", F.greatest(F.lit(1), F.floor(F.count("*").over(w) * ratio)))
    of_url = Window.partitionBy("query_id", "url")
    rows = rows.withColumn("turn", F.row_number().over(of_url.orderBy("rank"))).withColumn("first", F.min("rank").over(of_url))
    rows = rows.filter("urls <= 1 or turn <= cap")
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("urls") <= 1, F.lit(0)).otherwise(F.col("turn")), *([] if by_rank else ["first"]), "rank")
    return rows.withColumn("position", F.row_number().over(order)).drop("urls", "cap", "turn", "first")


def interleaved(chunks: DataFrame, k: int) -> DataFrame:
    """Chunk 0 of each url by the url's rank, then chunk 1, until k."""
    return chunks.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("idx", "url_rank"))).filter(F.col("position") <= k)


def deduped_by_prefix(chunks: DataFrame, order: str = "rank") -> DataFrame:
    key = F.concat(F.substring("url", 1, 80), F.lit("|"), F.substring(F.regexp_replace(F.lower("text"), "[ \\n\\t]+", " "), 1, 60))
    return chunks.withColumn("_k", key).withColumn("_rn", F.row_number().over(Window.partitionBy("query_id", "_k").orderBy(order))).filter("_rn = 1").drop("_k", "_rn")


def few_shots(queries: DataFrame, examples: DataFrame, k: int, least: float = 0.30, penalty: float = 0.7) -> DataFrame:
    """Top 3k candidates by similarity, then other routes' scores times ``penalty``, then top k."""
    near = dense_top_k(queries.select("query_id", "q"), examples.select("vec_id", "embedding"), 3 * k, least).drop("rank")
    near = near.join(examples.select("vec_id", "route"), "vec_id").join(queries.select("query_id", F.col("route").alias("asked")), "query_id")
    near = near.withColumn("score", F.round(F.when(F.col("route") != F.col("asked"), F.col("sim") * penalty).otherwise(F.col("sim")), 6))
    return top_k(near, "query_id", k, F.col("score").desc(), F.col("vec_id"))


def few_shots_by_word(queries: DataFrame, examples: DataFrame, k: int) -> DataFrame:
    """3 for each tag among the query's words and 1 for each shared word; queries: query_id, route, words; examples: example_id, route, tags, words."""
    terms = lambda c, w: F.transform(c, lambda x: F.struct(x.alias("term"), F.lit(w).alias("weight")))
    offered = examples.select("example_id", "route", F.inline(F.concat(terms("tags", 3), terms("words", 1))))
    asked = queries.select("query_id", "route", F.explode("words").alias("term"))
    hits = asked.join(offered, ["route", "term"]).groupBy("query_id", "example_id").agg(F.sum("weight").alias("score"))
    return top_k(hits, "query_id", k, F.col("score").desc(), F.col("example_id"))


def fallback_scores(chunks: DataFrame, most: int = 15) -> DataFrame:
    scored = chunks.withColumn("final", F.coalesce("score", "relevance", "rrf", F.lit(0.45)))
    return top_k(scored, "query_id", most, F.col("final").desc(), F.col("chunk_id"))


def reranked(chunks: DataFrame, scorer: Column, k: int) -> DataFrame:
    """Order by a model's score (a column expression or pandas UDF), the earlier score kept as embed_score."""
    return top_k(chunks.withColumnRenamed("score", "embed_score").withColumn("score", scorer), "query_id", k, F.col("score").desc(), F.col("chunk_id"))


def merged_lists(backends: list[DataFrame], academic: DataFrame | None = None, first: int = 2) -> DataFrame:
    """One list for each query text (query_id, list_id): the backends' results one after the other, with new ranks.

    Lists hold query_id, list_id, rank and url.  Academic results are added to the ``first`` query texts only.
    """
    every = [*backends, academic.filter(F.col("list_id") < first)] if academic is not None else backends
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [x.withColumn("_b", F.lit(i)) for i, x in enumerate(every)])
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "list_id").orderBy("_b", "rank", "url"))).drop("_b")


def local_chunks(hits: DataFrame) -> DataFrame:
    """Hits of a local collection (query_id, text, title, collection, file_path, score) in the shape of web chunks."""
    url = F.concat(F.lit("local://"), "collection", F.lit("/"), "file_path")
    score = F.coalesce("score", F.lit(0.0)).cast("double")
    return hits.select("query_id", "text", F.coalesce("title", F.lit("")).alias("title"), url.alias("url"), score.alias("relevance"), score.alias("score"), F.lit(True).alias("local"))


def context(chunks: DataFrame, most: int = 600) -> DataFrame:
    """Blocks in order of rank, each cut to ``most`` characters, joined to one text for each query."""
    block = F.struct("rank", F.substring("text", 1, most).alias("t"))
    return chunks.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda b: b["t"]), "\n---\n").alias("context"))
