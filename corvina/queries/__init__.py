"""Named queries over the test tables, each with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            kinds = dict(df.dtypes)  # ranks are long, as SQL has them
            return df.withColumns({c: df[c].cast("long") for c in ("rank", "position", "place") if kinds.get(c) == "int"})

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


for _module in ("texts", "scores", "curation", "retrieval", "grams", "monitoring", "streams", "more", "files"):
    importlib.import_module(f"{__name__}.{_module}")
