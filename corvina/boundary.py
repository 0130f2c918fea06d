"""Boundaries: what needs a model or a network is a function from outside.  The stubs are deterministic."""

from __future__ import annotations

import hashlib
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Generator(Protocol):
    """Adds a column ``answer`` to rows with ``prompt``."""

    def __call__(self, rows: DataFrame) -> DataFrame: ...


class Scorer(Protocol):
    """A score column from a query and a text."""

    def __call__(self, query: Column, text: Column) -> Column: ...


def echo_generator(rows: DataFrame) -> DataFrame:
    return rows.withColumn("answer", F.concat(F.lit("answer: "), F.substring("prompt", 1, 200)))


def overlap_scorer(query: Column, text: Column) -> Column:
    from .functions.scoring import keyword_overlap

    return F.round(keyword_overlap(query, text), 4)


def hash_embedding(c: Column, size: int = 64) -> Column:
    """A stable stand-in for an embedding: counts of words by hash bucket, scaled to unit length."""
    def let(value: Column, body) -> Column:
        """``body`` of a value that is computed once a row."""
        return F.transform(F.array(value), body)[0]

    def scaled(counts: Column) -> Column:
        norm = F.greatest(F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x)), F.lit(1.0))
        return let(norm, lambda n: F.transform(counts, lambda x: (x / n).cast("float")))

    words = F.transform(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: F.pmod(F.xxhash64(w), F.lit(size)))
    return let(words, lambda w: let(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(w, lambda x: x == i)).cast("double")), scaled))


def stub_json(prompt: str) -> str:
    """A fixed answer for tests of parsers."""
    return '{"score": %d}' % (1 + int(hashlib.sha256(prompt.encode()).hexdigest(), 16) % 5)
