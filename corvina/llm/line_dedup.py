r"""Cross-site line deduplication, DataFrame operations only.

The spread of a line is the number of distinct sites that have it.  HyperLogLog sketches of the sites, one for each line hash (128
bits), are merged by the aggregation, so a line that a third of all rows hold is one sketch per map task.  Lines whose
estimate is within MARGIN of the threshold get an exact distinct count; all others are decided by the sketch, whose error
(1.6 % at 2^12 registers, exact for small counts) is under a third of the margin.  Lines on ``sites`` sites or more are boilerplate
and are removed everywhere.

Removed places, not texts, are joined back: broadcast up to BYTES (a document about 80 bytes, a place 4), else by shuffle.  Blank lines stay.
Null texts count as empty, null sites as none.  Rows that repeat a doc_id are joined by (doc_id, hash of the text).  Empty tables give
an empty result; extra columns are kept, whatever their names, but for those named like a result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Lines, or bytes of places, that may be broadcast.
SITES, MARGIN, LINES, BYTES = 10, 0.1, 500_000, 64 << 20
RESULTS = ("kept_text", "n_lines", "n_removed")


def boilerplate(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """(h1, h2) of lines on ``sites`` distinct sites or more; lines: h1, h2, site."""
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", 12).alias("sketch")).select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites"))
    margin = max(1.0, sites * MARGIN)
    spread = saved(spread.filter(F.col("sites") >= sites - margin), "spread")
    sure = spread.filter(F.col("sites") > sites + margin).select("h1", "h2")
    near = spread.filter(F.col("sites") <= sites + margin).select("h1", "h2")
    exact = lines.join(F.broadcast(near) if near.count() <= LINES else near, ["h1", "h2"]).groupBy("h1", "h2", "site").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("site").alias("sites"))
    return sure.unionByName(exact.filter(F.col("sites") >= sites).select("h1", "h2"))


def without_boilerplate(docs: DataFrame, site: str = "source", sites: int = SITES) -> DataFrame:
    """``docs`` (doc_id, text, site) with kept_text, n_lines and n_removed, in place of columns that have these names."""
    text = F.coalesce("text", F.lit(""))
    # the user's columns ride along in one of a name of their own
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64(text).alias("own"), text.alias("text"), F.col(site).alias("site"))
    parts = F.posexplode(F.split("text", "\n")).alias("pos", "line")
    lines = rows.select("doc_id", "own", "site", parts).filter("trim(line) <> ''")
    # split and hashed once
    lines = saved(lines.select("doc_id", "own", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2")), "lines")
    common = saved(boilerplate(lines, sites), "common")
    common = F.broadcast(common) if common.count() <= LINES else common
    gone = saved(lines.join(common, ["h1", "h2"]).groupBy("doc_id", "own").agg(F.array_sort(F.collect_set("pos")).alias("gone")), "gone")
    few = (gone.agg(F.sum(4 * F.size("gone") + 80)).first()[0] or 0) <= BYTES
    out = rows.join(F.broadcast(gone) if few else gone, ["doc_id", "own"], "left")
    kept = "if(gone is null, text, array_join(transform(array(split(text, '\\n')), l -> filter(l, (x, i) -> not array_contains(gone, i)))[0], '\\n'))"
    told = [F.expr(kept).alias("kept_text"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed")]
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in RESULTS], *told)
