"""Streaming forms over events, run to the end of what is available.  Append mode gives the windows the watermark has closed."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import scratch_folder
from ..streaming import monitor, stateful
from . import query, table
from .monitoring import GATES, proposed
from .scores import CERTAIN, token_chunks

#: Rows of a batch of gates (and four batches at least).
BATCH = 500_000
#: Rows of a batch to a partition of state.
PART = 40_000

_MARK = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


def _events(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return monitor.timed(spark.readStream.schema(schema).option("pathGlobFilter", "*events*").load(sf_dir, format="parquet"))


def _run(spark, stream, mode="complete"):
    return monitor.run_once(stream, scratch_folder(spark, "stream"), scratch_folder(spark, "stream-state"), mode)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2024-01-01') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    return _run(spark, monitor.tumbling(_events(spark, sf_dir)))


@query("""WITH s AS (SELECT unnest(range(0, 4)) AS k), e AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') - k * INTERVAL 6 HOUR AS start, event_type, value FROM events, s) SELECT start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM e GROUP BY 1, 2""")
def stream_sliding(spark, sf_dir):
    return _run(spark, monitor.sliding(_events(spark, sf_dir)))


@query("""WITH l AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS cut FROM events), s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l)
    SELECT min(ts) AS start, user_id, count(*) AS n, round(sum(value), 2) AS total FROM s GROUP BY user_id, k""")
def stream_session(spark, sf_dir):
    return _run(spark, monitor.sessions(_events(spark, sf_dir)))


@query("SELECT event_id, user_id FROM events")
def stream_dedupe(spark, sf_dir):
    e = _events(spark, sf_dir)
    return _run(spark, monitor.deduplicated(e.unionByName(e)).select("event_id", "user_id"), "append")


@query(f"""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2024-01-01') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2) SELECT * FROM w WHERE start + INTERVAL 1 HOUR <= {_MARK}""")
def stream_late(spark, sf_dir):
    """Append mode: only windows that ended before the final watermark are given out."""
    return _run(spark, monitor.tumbling(_events(spark, sf_dir)), "append")



@query(CERTAIN)
def stream_certainty_state(spark, sf_dir):
    """The certainty of answers from state kept by request, over chunks that come in no order."""
    path = scratch_folder(spark, "chunks")
    rows = token_chunks(spark, sf_dir).withColumn("seq", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("long") - 1)
    rows.repartition(3, F.crc32(F.col("vec_id").cast("string"))).write.parquet(path)
    stream = stateful.prepared(spark).readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    found = _run(spark, stateful.certainty(stream, "label", threshold=0.2), "append")
    return found.join(rows.select("label", "seq", "vec_id"), ["label", "seq"]).select("vec_id", F.round("mean", 4).alias("mean"), "halted")


@query(GATES)
def stream_gates(spark, sf_dir):
    """Gates from state kept by agent and by day, over batches in the order of time: four, or more of some BATCH rows."""
    e, runs, judged = proposed(spark, sf_dir)
    patched, undone = runs.filter("patched").withColumn("kind", F.lit("patch")), runs.filter("reverted").withColumn("kind", F.lit("revert"))
    every = [e.withColumn("kind", F.lit("proposal")), patched, undone, judged.withColumn("kind", F.lit("judgement"))]
    columns = ["id", "agent", "pattern", F.col("ts").cast("timestamp").alias("ts"), "kind"]
    rows = every[0].select(*columns)
    for more in every[1:]:
        rows = rows.unionByName(more.select(*columns))
    path = scratch_folder(spark, "gate-events")
    batches = max(4, -(-rows.count() // BATCH))
    # a file each, so that it is one batch: state, not the batch, holds what was before; rows of one time share a batch
    rows.repartitionByRange(batches, "ts").write.parquet(path)
    monitor.in_order(spark, path)
    stream = stateful.prepared(spark).readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    # a batch of BATCH rows needs no more partitions of state than these
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", min(int(parts), max(4, BATCH // PART)))
    try:
        return _run(spark, stateful.gates(stream), "append").select("id", "agent", "gate")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
