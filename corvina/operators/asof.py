"""As-of joins and counts by merging: both sides are united, sorted within a key and a stretch of time, and read once.

A stretch is STRETCH seconds of one key, so a key that holds a third of all rows is many tasks' work; what went before a stretch comes from
one row for each stretch.  Times of a row are ``ts``; rows without a time or with a null key find nothing, and facts without
them are never found.  Of facts at one time the greatest (by its values) is the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds to a stretch.
STRETCH = 6 * 3600


def _seconds(c: Column) -> Column:
    return c.cast("timestamp").cast("double")


def _key(rows: DataFrame, keys: list[str]) -> Column:
    return F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]) if keys else F.struct(F.lit(0).alias("k0"))


def _named(keys: list[str]) -> Column:
    """Whether no part of the key is null."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def last_before(asked: DataFrame, facts: DataFrame, keys: list[str], values: list[str], at: bool = False, ts: str = "ts", stretch: int = STRETCH) -> DataFrame:
    """``asked`` with ``values`` of the last fact of its ``keys`` before its time (``at``: or at it); null where there is none.

    The names of values may not be among the columns of ``asked``.
    """
    if clash := set(values) & set(asked.columns):
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    told = F.struct(_seconds(F.col(ts)).alias("t"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
    f = facts.filter(_named(keys) & F.col(ts).isNotNull()).select(_key(facts, keys).alias("k"), told.alias("f"))
    f = f.select("k", "f.t", F.lit(0).alias("side"), "f")
    a = asked.select(_key(asked, keys).alias("k"), _named(keys).alias("ok"), _seconds(F.col(ts)).alias("t"), F.lit(1 if at else -1).alias("side"), F.struct("*").alias("a"))
    known = a.filter("ok and t is not null").drop("ok")
    rows = known.unionByName(f, allowMissingColumns=True).withColumn("part", F.floor(F.col("t") / stretch))
    inside = Window.partitionBy("k", "part").orderBy("t", "side", "f").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    past = rows.groupBy("k", "part").agg(F.max("f").alias("f")).withColumn("past", F.last("f", ignorenulls=True).over(whole)).drop("f")
    found = rows.withColumn("near", F.last("f", ignorenulls=True).over(inside)).filter("a is not null").join(past, ["k", "part"])
    found = found.select("a", F.coalesce("near", "past").alias("f"))
    nothing = a.filter("not ok or t is null").select("a", F.lit(None).cast(found.schema["f"].dataType).alias("f"))
    return found.unionByName(nothing).select("a.*", *[F.col(f"f.v{i}").alias(v) for i, v in enumerate(values)])


def counted(asked: DataFrame, facts: DataFrame, keys: list[str], since: Column | None = None, at: bool = True, ts: str = "ts", stretch: int = STRETCH, name: str = "n") -> DataFrame:
    """``asked`` with ``name``: the facts of its ``keys`` from ``since`` (a time of asked; null: all) until its time, with those at it if ``at``."""
    f = facts.filter(_named(keys) & F.col(ts).isNotNull()).select(_key(facts, keys).alias("k"), _seconds(F.col(ts)).alias("t"), F.lit(1).alias("one"), F.lit(0).alias("side"))
    a = asked.select(_key(asked, keys).alias("k"), _named(keys).alias("ok"), _seconds(F.col(ts)).alias("t"), (F.lit(None).cast("double") if since is None else _seconds(since)).alias("since"), F.struct("*").alias("a"))
    a = a.withColumn("id", F.monotonically_increasing_id())
    known = a.filter("ok and t is not null")
    # a mark at the end counts what lies up to it (side 1: also at it), a mark at the begin takes off what lies before it
    marks = [F.struct(F.col("t").alias("m"), F.lit(1 if at else -1).alias("side"), F.lit(1).alias("sign"), F.col("a").alias("a")), F.struct(F.col("since").alias("m"), F.lit(-1).alias("side"), F.lit(-1).alias("sign"), F.col("a").alias("a"))]
    ends = known.select("k", "id", F.explode(F.array(*marks)).alias("e")).select("k", "id", F.col("e.m").alias("t"), "e.side", "e.sign", "e.a").filter("t is not null")
    rows = ends.withColumn("one", F.lit(0)).unionByName(f, allowMissingColumns=True).withColumn("part", F.floor(F.col("t") / stretch))
    whole = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    past = rows.groupBy("k", "part").agg(F.sum("one").alias("d")).withColumn("past", F.coalesce(F.sum("d").over(whole), F.lit(0))).drop("d")
    inside = Window.partitionBy("k", "part").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    some = rows.withColumn("near", F.sum("one").over(inside)).filter("a is not null").join(past, ["k", "part"])
    out = some.groupBy("id").agg(F.any_value("a").alias("a"), F.sum(F.col("sign") * (F.col("past") + F.col("near"))).alias("n")).drop("id")
    out = out.unionByName(a.filter("not ok or t is null").select("a", F.lit(0).cast("long").alias("n")))
    return out.select("a.*", F.greatest("n", F.lit(0)).cast("long").alias(name))
