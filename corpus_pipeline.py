"""A corpus pipeline of five stages over ``documents``, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir).  All but the last return the columns of documents: rows go, none change.  A document is a
doc_id with its text: rows of one doc_id and different texts are decided one by one, rows that repeat both are one document.  Null texts
count as empty.  Texts of any length are read whole.  Empty tables give empty tables; extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.llm import bpe, decontaminate, exact_dedup, langid, ngram_join
from corvina.llm.common import BROADCAST_IDS, drop_at_exit, saved, scratch
from corvina.llm.queries import vocabulary_path

KEY = ["doc_id", "text_xxh"]


def _keyed(docs: DataFrame) -> DataFrame:
    """KEY with the whole row as ``row``, so that no column of the documents is overwritten."""
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_xxh"), F.struct("*").alias("row"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the documents ``gone`` (KEY), which are counted: few are broadcast, many joined by shuffle."""
    gone = saved(gone.select(*KEY).distinct(), "dropped")
    n = gone.count()
    if not n:
        return docs
    return _keyed(docs).join(F.broadcast(gone) if n <= BROADCAST_IDS else gone, KEY, "left_anti").select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are in no language known from the declared ones.

    Null and empty texts, and texts without letters, are in none and go; short texts of a few letters stay.
    """
    return _without(docs, langid.document_languages(docs).filter("rejected"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts (null and empty are equal) the document with the largest doc_id, once."""
    found = saved(exact_dedup.copies(docs), "copies")
    kept = _without(docs, found.filter("not kept"))
    if found.filter("kept").groupBy(*KEY).count().filter("count > 1").isEmpty():
        return kept
    return _keyed(kept).dropDuplicates(KEY).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the document with the smallest doc_id, and of that the text with the smallest hash.

    Texts without words are in no group and stay.
    """
    ids = _keyed(docs.select("doc_id", "text")).select(*KEY, "row.text")
    if ids.groupBy("doc_id").agg(F.min("text_xxh").alias("lo"), F.max("text_xxh").alias("hi")).filter("lo <> hi").isEmpty():
        found = ngram_join.jaccard_classes(docs).filter("doc_id <> component_id").select("doc_id")
        return _without(docs, ids.join(saved(found, "near"), "doc_id", "left_semi"))
    # some doc_id has several texts: rows are numbered in a written table, and classes are of rows
    rows = saved(ids.dropDuplicates(KEY).withColumn("row", F.monotonically_increasing_id()), "rows")
    classes = saved(ngram_join.jaccard_classes(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id"), "row-classes")
    named = classes.join(rows.select("row", *KEY), "row")
    least = named.groupBy("component_id").agg(F.min(F.struct(*KEY)).alias("stays"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return _without(docs, named.join(least, "component_id").filter("struct(doc_id, text_xxh) <> stays"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item: ten words in a row, or all of a shorter item.  Texts without words stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontaminate.contamination(docs, items).filter("contaminated"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes what is left, and decodes it: doc_id, n_tokens, ids_sha256, decoded_sha256.  Null and empty texts have no tokens."""
    return bpe.round_trip(docs, vocabulary_path())


STAGES = [("language", language), ("exact_duplicates", exact_duplicates), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("tokens", tokens)]

#: SQL expresses neither language identification nor BPE; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        drop_at_exit(spark, path)
        docs = spark.read.parquet(path)
    return docs
