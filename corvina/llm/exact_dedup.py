"""Exact deduplication by skew-safe combining, DataFrame operations only.

1. Digests alone (SHA-256, 64 bits of xxHash and the length) are counted over all rows, combined map-side; only texts whose
   digest repeats go on, so a text without copies is never moved.
2. These are combined in three steps that each group by digest *and* whole content: within a map task (partial
   aggregation), within a salted digest group, and over the salts' winners.  A group that holds a third of all rows thus
   arrives as one row per map task and salt, then as SALTS rows.
3. A digest whose rows had one content, as that comparison has shown, gives its winner to all rows of the digest; were there a digest with
   several contents, its rows would be joined to their winners by content.  AQE splits the skewed side of the joins.

Nulls count as the empty text.  Of equal texts the row with the largest doc_id stays; rows that repeat that doc_id with the
same text are all kept.  An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

SALTS = 16
#: Digests that may be broadcast (about 200 bytes each once hashed).
BROADCAST = 250_000
DIGESTS = ["text_sha256", "text_xxh", "text_len"]


def digested(docs: DataFrame) -> DataFrame:
    """doc_id, text (null is empty) and the DIGESTS of the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("text_sha256"), F.xxhash64(text).alias("text_xxh"), F.length(text).alias("text_len"))


def _small(rows: DataFrame, count: int) -> DataFrame:
    return F.broadcast(rows) if count <= BROADCAST else rows


def combined(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """Of ``digested`` rows per content: DIGESTS, text, keep_id, group_size."""
    salted = rows.groupBy(*DIGESTS, F.expr(f"pmod(xxhash64(doc_id), {salts})").alias("salt"), "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    return salted.groupBy(*DIGESTS, "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def copies(docs: DataFrame, salts: int = SALTS, digest=digested) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, text_xxh."""
    rows = digest(docs)
    keys = saved(rows.drop("text"), "digests")
    again = saved(keys.groupBy(*DIGESTS).agg(F.count("*").alias("n")).filter("n > 1").select(*DIGESTS), "repeated")
    some = rows.join(_small(again, again.count()), DIGESTS, "left_semi")
    winners = combined(some, salts)
    # one row for each digest that repeats; its text is only kept where the digest has several contents
    per = saved(winners.groupBy(*DIGESTS).agg(F.count("*").alias("contents"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")), "winners")
    one, several = per.filter("contents = 1").drop("contents"), per.filter("contents > 1").select(*DIGESTS)
    found = keys.join(_small(one, one.count()), DIGESTS, "left")
    columns = ["doc_id", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "text_sha256", "text_xxh"]
    if several.isEmpty():
        out = found.select(*columns)
    else:
        several = _small(several, several.count())
        apart = rows.join(several, DIGESTS, "left_semi").join(winners.join(several, DIGESTS, "left_semi"), [*DIGESTS, "text"])
        out = found.join(several, DIGESTS, "left_anti").select(*columns).unionByName(apart.select("doc_id", "keep_id", "group_size", "text_sha256", "text_xxh"))
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256", "text_xxh")
