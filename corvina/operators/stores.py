"""Small stores kept beside the data: capped example stores, vectors without repeats, merged result lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lexicons import DEFAULT, Lexicon


def example(question: Column, answer: Column) -> list[Column]:
    """Fields of a stored example: input and output cut to 500 and 2000 characters, and as tags the first eight distinct words of over four letters."""
    words = F.filter(F.split(F.lower(question), "[ \\t\\n\\r]+"), lambda w: F.length(w) > 4)
    return [F.substring(question, 1, 500).alias("input"), F.substring(answer, 1, 2000).alias("output"), F.slice(F.array_distinct(words), 1, 8).alias("tags")]


def capped_store(old: DataFrame, new: DataFrame, cap: int = 10, head: int = 100) -> DataFrame:
    """Of each route the ``cap`` best examples by (score, ts); an input whose first ``head`` characters, in any case, are there already stays out."""
    every = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    first = Window.partitionBy("route", F.lower(F.substring("input", 1, head))).orderBy("_new", "ts")
    best = Window.partitionBy("route").orderBy(F.col("score").desc(), F.col("ts").desc())
    rows = every.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1")
    return rows.withColumn("_rn", F.row_number().over(best)).filter(F.col("_rn") <= cap).drop("_rn", "_new")


def add_vectors(old: DataFrame, new: DataFrame, size: int, key: str = "prompt_hash") -> DataFrame:
    """Vectors of ``size`` dimensions that are not in store; vectors in store of another size go, as the model has changed."""
    old = old.filter(F.size("embedding") == size)
    fresh = new.filter(F.size("embedding") == size).dropDuplicates([key])
    return old.unionByName(fresh.join(old.select(key), key, "left_anti"))


def merged_by_url(first: DataFrame, second: DataFrame) -> DataFrame:
    """A result list, then those of a second whose url it lacks."""
    return first.unionByName(second.join(first.select("query_id", "url"), ["query_id", "url"], "left_anti"), allowMissingColumns=True)


def academic(hits: DataFrame, most: int, lex: Lexicon = DEFAULT) -> DataFrame:
    """The first ``most`` of the first 2 * most hits of each query whose address names an academic site."""
    named = F.array_contains(F.array(*[F.contains("url", F.lit(s)) for s in lex.academic_sites]), True)
    order = Window.partitionBy("query_id").orderBy("rank", "url")
    rows = hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= 2 * most).filter(named)
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
