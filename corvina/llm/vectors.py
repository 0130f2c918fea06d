"""Embedding vectors as whole numbers, so that sums and distances are exact however rows are dealt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def integer_vectors(rows: DataFrame, ids: str, vectors: str, scale: int, largest: int, name: str, dims: int | None = None) -> DataFrame:
    """(id, ``name``): entries c of the usable vectors as floor(scale * c), at most ``largest`` in size.

    Usable is what has entries (``dims`` of them, if given), none of them null or non-finite.
    """
    finite = F.forall(vectors, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    usable = rows.filter(F.col(vectors).isNotNull() & (F.size(vectors) > 0 if dims is None else F.size(vectors) == dims) & finite)
    whole = lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(largest))), F.lit(-float(largest)))).cast("int")
    return usable.select(F.col(ids).cast("long").alias("id"), F.transform(vectors, whole).alias(name))
