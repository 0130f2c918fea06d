"""Deep search and knowledge retrieval as compositions of the retrieval operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..lexicons import DEFAULT, Lexicon
from ..operators import chunk, retrieve


def readable(hits: DataFrame, most: int, lex: Lexicon = DEFAULT) -> DataFrame:
    """The first ``most`` hits of each query that can be read, among the first 2 * most: web addresses that name no site without texts."""
    named = F.array_contains(F.array(*[F.contains("url", F.lit(s)) for s in lex.skipped_sites]), True)
    rows = hits.filter(F.col("rank") <= 2 * most).filter(F.col("url").startswith("http") & ~named).withColumnRenamed("rank", "place")
    return retrieve.top_k(rows, "query_id", most, F.col("place"), F.col("url"))


def deep_search(lists: DataFrame, pages: DataFrame, scorer, top: int = 8, most_pages: int = 5, size: int = 512, local: DataFrame | None = None, lex: Lexicon = DEFAULT) -> DataFrame:
    """Ranked lists (query_id, query, list_id, rank, url) to the best diverse chunks: query_id, url, position, score, text.

    local: hits of a local collection, which compete with the pages' chunks.
    """
    fused = retrieve.rrf_by_url(lists)
    fetched = readable(fused.withColumn("rank", F.col("position")).select("query_id", "url", "rank"), most_pages, lex).join(pages.select("url", tx.main_text(F.col("html")).alias("body")), "url")
    chunks = fetched.select("query_id", "url", F.posexplode(chunk.paragraph_chunks(F.col("body"), size)).alias("idx", "text"))
    if local is not None:
        chunks = chunks.unionByName(retrieve.local_chunks(local).select("query_id", "url", F.lit(0).alias("idx"), "text"))
    asked = lists.groupBy("query_id").agg(F.min_by("query", "list_id").alias("query"))
    scored = chunks.join(asked, "query_id").withColumn("score", scorer(F.col("query"), F.col("text")))
    best = retrieve.top_k(scored, "query_id", top, F.col("score").desc(), F.col("url"), F.col("idx"))
    return retrieve.diverse(retrieve.deduped_by_prefix(best)).select("query_id", "url", "position", "score", "text")


def hybrid(queries: DataFrame, docs: DataFrame, collections: list[str], fetch: int, top: int, least: float = 0.25, scorer=None) -> DataFrame:
    """Dense and keyword retrieval over collections, fused by rank, then reordered by a scorer: query_id, doc_id, text, rrf, score, rank.

    queries: query_id, query, q, words; docs: doc_id, collection, text, embedding.  Each collection gives its ``fetch`` nearest
    documents of similarity ``least`` or more; keyword hits are of all collections together.
    """
    some = docs.filter(F.col("collection").isin(*collections))
    near = None
    for name in collections:
        of_one = retrieve.dense_top_k(queries.select("query_id", "q"), some.filter(F.col("collection") == name).select(F.col("doc_id").alias("vec_id"), "embedding"), fetch, least)
        near = of_one if near is None else near.unionByName(of_one)
    texts = some.select("doc_id", "text")
    dense = near.drop("rank").withColumnRenamed("vec_id", "doc_id").join(texts, "doc_id")
    dense = dense.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "doc_id")))
    sparse = retrieve.keyword_hits(queries.select("query_id", "words"), texts, fetch).join(texts, "doc_id")
    fused = retrieve.rrf_by_text(dense, sparse)
    score = F.col("rrf") if scorer is None else scorer(F.col("query"), F.col("text"))
    scored = fused.join(queries.select("query_id", "query"), "query_id").withColumn("score", score)
    return retrieve.top_k(scored, "query_id", top, F.col("score").desc(), F.col("position")).select("query_id", "doc_id", "text", "rrf", "score", "rank")
