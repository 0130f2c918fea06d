"""Nightly curation as one plan: pairs and scores to curated pairs, chat examples and n-gram tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import curate, ngram


def curated(pairs: DataFrame, scores: DataFrame, as_of: str, least: int = 3) -> DataFrame:
    """Pairs (prompt_hash, seq, ts, prompt, reasoning, response) that are recent, long enough, scored well, and the last of their prompt."""
    rows = curate.keep_last(pairs, "prompt_hash")
    rows = curate.scored_pairs(rows, scores, default=3)
    rows = curate.decayed(rows, as_of)
    return rows.filter((F.length("response") >= 50) & (F.length("reasoning") >= 100) & (F.col("score") >= least))


def examples(rows: DataFrame) -> DataFrame:
    chat = rows.select("prompt_hash", curate.sharegpt(F.col("prompt"), F.col("reasoning"), F.col("response")).alias("conversations"))
    return curate.hash_split(chat, "prompt_hash")


def ngram_tables(rows: DataFrame, order: int = 5, least: int = 2) -> DataFrame:
    """N-gram counts of good responses by route."""
    docs = rows.select("route", ngram.tokens(F.col("response")).alias("tokens"))
    wide = ngram.windows(docs, order, "tokens", "route")
    return wide.groupBy("route", "ctx", "next").agg(F.count("*").alias("freq")).filter(F.col("freq") >= least)
