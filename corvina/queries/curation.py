"""Joins, deduplication and training-set curation.  Labelled documents stand for scored pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as sc
from ..operators import curate
from ..plans import nightly
from . import query, table
from .scores import PAIRS, pairs

AS_OF = "2024-03-15 00:00:00"

#: Several scores for a key, in the order of seq: from labels (1 to 5) and from ids.
SCORES = """scores AS (SELECT substr(sha256(text), 1, 16) AS prompt_hash, doc_id AS seq, 1 + 3 * quality + (1 - toxic) AS score, length(text) AS prompt_len FROM documents JOIN labels USING (doc_id)
    UNION ALL SELECT substr(sha256(text), 1, 16), doc_id + 1000000, 1 + doc_id % 5, length(text) FROM documents WHERE doc_id % 3 = 0)"""
KEYED = "keyed AS (SELECT substr(sha256(text), 1, 16) AS prompt_hash, doc_id AS seq, length(text) AS prompt_len, source AS route FROM documents)"


def scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("prompt_hash"), F.length("text").alias("prompt_len"))
    one = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("prompt_hash", F.col("doc_id").alias("seq"), (1 + 3 * F.col("quality") + (1 - F.col("toxic"))).cast("long").alias("score"), "prompt_len")
    two = docs.filter("doc_id % 3 = 0").select("prompt_hash", (F.col("doc_id") + 1000000).alias("seq"), (1 + F.col("doc_id") % 5).alias("score"), "prompt_len")
    return one.unionByName(two)


def keyed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.substring(F.sha2("text", 256), 1, 16).alias("prompt_hash"), F.col("doc_id").alias("seq"), F.length("text").alias("prompt_len"), F.col("source").alias("route"))


def _dedupe(order: str, extra: str = "") -> str:
    return f"WITH {SCORES} SELECT prompt_hash, seq, score FROM (SELECT *, row_number() OVER (PARTITION BY prompt_hash ORDER BY {order}) AS rn FROM scores {extra}) WHERE rn = 1"


@query(_dedupe("seq DESC"))
def dedupe_keep_last(spark, sf_dir):
    return curate.keep_last(scores(spark, sf_dir), "prompt_hash").select("prompt_hash", "seq", "score")


@query(_dedupe("seq"))
def dedupe_keep_first(spark, sf_dir):
    return curate.keep_first(scores(spark, sf_dir), "prompt_hash").select("prompt_hash", "seq", "score")


@query(_dedupe("score DESC, seq"))
def dedupe_keep_best(spark, sf_dir):
    return curate.keep_best(scores(spark, sf_dir), "prompt_hash").select("prompt_hash", "seq", "score")


@query(f"WITH {SCORES} SELECT prompt_hash, arg_max(score, seq) AS score FROM scores GROUP BY prompt_hash")
def latest_score(spark, sf_dir):
    return curate.latest_score(scores(spark, sf_dir))


@query(f"WITH {SCORES} SELECT prompt_hash, arg_max(score, seq) AS score FROM scores WHERE score >= 4 GROUP BY prompt_hash")
def latest_good_score(spark, sf_dir):
    return curate.latest_score(scores(spark, sf_dir), least=4)


LAST = "last AS (SELECT prompt_hash, arg_max(score, seq) AS score FROM scores GROUP BY prompt_hash)"


@query(f"WITH {SCORES}, {KEYED}, {LAST} SELECT k.seq, k.prompt_hash, score FROM keyed k JOIN last USING (prompt_hash)")
def score_pair_join(spark, sf_dir):
    return curate.scored_pairs(keyed(spark, sf_dir), scores(spark, sf_dir)).select("seq", "prompt_hash", "score")


@query(f"WITH {SCORES}, {KEYED}, {LAST} SELECT k.seq, k.prompt_hash, coalesce(score, 3) AS score FROM keyed k LEFT JOIN last USING (prompt_hash)")
def left_default_score(spark, sf_dir):
    return curate.scored_pairs(keyed(spark, sf_dir), scores(spark, sf_dir), default=3).select("seq", "prompt_hash", "score")


@query(f"WITH {SCORES}, {KEYED} SELECT seq, prompt_hash FROM keyed WHERE prompt_hash NOT IN (SELECT prompt_hash FROM scores)")
def unscored_anti(spark, sf_dir):
    return curate.unscored(keyed(spark, sf_dir), scores(spark, sf_dir)).select("seq", "prompt_hash")


@query(f"""WITH {SCORES}, {KEYED}, {LAST}, old AS (SELECT doc_id % 7 AS route, length(text) AS pl, min(doc_id) AS s, arg_max(1 + doc_id % 5, doc_id) AS near FROM documents WHERE doc_id % 4 = 1 GROUP BY ALL),
    h AS (SELECT k.prompt_len, arg_min(near, s) AS near FROM (SELECT DISTINCT prompt_len FROM keyed) k JOIN old ON abs(k.prompt_len - pl) <= 5 GROUP BY k.prompt_len)
    SELECT k.seq, coalesce(score, near) AS score FROM keyed k LEFT JOIN last USING (prompt_hash) LEFT JOIN h USING (prompt_len)""")
def banded_theta_fallback(spark, sf_dir):
    """Scores by hash, else by the length of the prompt among older entries without a hash."""
    i = F.col("doc_id")
    old = table(spark, sf_dir, "documents").filter(i % 4 == 1).select(F.lit(None).cast("string").alias("prompt_hash"), i.alias("seq"), (1 + i % 5).alias("score"), F.length("text").alias("prompt_len"), (i % 7).cast("string").alias("route"))
    every = scores(spark, sf_dir).withColumn("route", F.lit("r")).unionByName(old)
    return curate.near_length_score(keyed(spark, sf_dir).drop("route"), every).select("seq", "score")


@query("""WITH s AS (SELECT concat(source, '-', n_chars // 500) AS k, CASE lang WHEN 'es' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END AS o, doc_id AS v FROM documents)
    SELECT k, o AS source_order, v FROM s WHERE o = (SELECT min(o) FROM s t WHERE t.k = s.k)""")
def first_nonempty_source(spark, sf_dir):
    """Documents of a source and size in Spanish, else in French, else in other languages."""
    d = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("-"), F.expr("n_chars div 500")).alias("k"), F.col("doc_id").alias("v"), "lang")
    some = [d.filter("lang = 'es'"), d.filter("lang = 'fr'"), d.filter("lang is null or lang not in ('es', 'fr')")]
    return curate.first_filled([x.select("k", "v") for x in some], "k")


@query(f"""SELECT event_id, CASE WHEN ts < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY THEN greatest(1, (1 + event_id % 5) // 2) ELSE 1 + event_id % 5 END AS score FROM (SELECT event_id, coalesce(CASE WHEN event_id % 50 <> 0 THEN ts END, TIMESTAMP '{AS_OF}') AS ts FROM events)
    WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY""")
def decay_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 50 != 0, F.col("ts").cast("timestamp")).alias("ts"), (1 + F.col("event_id") % 5).alias("score"))
    return curate.decayed(rows, AS_OF).select("event_id", "score")


@query(f"""WITH {PAIRS} SELECT count(*) AS total, count(*) FILTER (length(prompt) < 20) AS short_prompt, count(*) FILTER (length(prompt) > 4000) AS long_prompt, count(*) FILTER (length(answer) < 100) AS short_answer,
    count(*) FILTER (contains(answer, 'tool_call')) AS tool_text, count(*) FILTER (NOT (length(prompt) < 20 OR length(prompt) > 4000 OR length(answer) < 100 OR contains(answer, 'tool_call'))) AS kept FROM pairs""")
def training_filter_counters(spark, sf_dir):
    p, a = F.length("prompt"), F.length("answer")
    return curate.filter_counts(pairs(spark, sf_dir), short_prompt=p < 20, long_prompt=p > 4000, short_answer=a < 100, tool_text=F.contains("answer", F.lit("tool_call")))


@query("SELECT doc_id, CASE WHEN ('0x' || md5(doc_id::VARCHAR)[1:4])::INT % 10 < 1 THEN 'eval' ELSE 'train' END AS split FROM documents")
def hash_split(spark, sf_dir):
    return curate.hash_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query(f"WITH {PAIRS} SELECT conv_id, turn, 'human' AS f1, prompt AS v1, 'gpt' AS f2, CASE WHEN turn % 4 = 0 THEN concat('<think>', chr(10), prompt[1:50], chr(10), '</think>', chr(10), answer) ELSE answer END AS v2 FROM pairs")
def sharegpt_pairs(spark, sf_dir):
    c = curate.sharegpt(F.col("prompt"), F.when(F.col("turn") % 4 == 0, F.substring("prompt", 1, 50)), F.col("answer"))
    return pairs(spark, sf_dir).select("conv_id", "turn", c.alias("c")).select("conv_id", "turn", F.col("c")[0]["from"].alias("f1"), F.col("c")[0]["value"].alias("v1"), F.col("c")[1]["from"].alias("f2"), F.col("c")[1]["value"].alias("v2"))


@query(f"WITH {PAIRS} SELECT conv_id, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS turns, string_agg(((turn % 5) / 4.0)::DECIMAL(4,2)::VARCHAR, ',' ORDER BY turn) AS rewards FROM pairs GROUP BY conv_id HAVING count(*) >= 2")
def grpo_groups(spark, sf_dir):
    rows = pairs(spark, sf_dir).select("conv_id", F.col("turn").alias("seq"), F.col("turn").cast("string").alias("completion"), (F.col("turn") % 5 / 4).cast("decimal(4,2)").cast("string").alias("reward"))
    return curate.grouped_answers(rows, "conv_id").select("conv_id", F.array_join("completions", ",").alias("turns"), F.array_join("rewards", ",").alias("rewards"))


@query("""WITH o AS (SELECT doc_id AS file_key, n_chars AS version FROM documents WHERE doc_id % 10 <> 0), n AS (SELECT doc_id AS file_key, n_chars + (doc_id % 7 = 0)::INT AS version FROM documents WHERE doc_id % 10 <> 1)
    SELECT file_key, CASE WHEN o.version IS NULL THEN 'NEW' WHEN n.version IS NULL THEN 'DELETED' WHEN o.version = n.version THEN 'SAME' ELSE 'CHANGED' END AS status FROM o FULL JOIN n USING (file_key)""")
def manifest_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_key"), F.col("n_chars").alias("version"))
    return curate.manifest_diff(d.filter("file_key % 10 <> 0"), d.filter("file_key % 10 <> 1").withColumn("version", F.col("version") + (F.col("file_key") % 7 == 0).cast("int")))


@query("SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, label + 100 FROM embeddings WHERE vec_id % 30 = 0")
def collection_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    new = e.filter("id % 3 = 0").withColumn("label", F.col("label") + 100)
    return curate.upserted(e, new.unionByName(new.filter("id % 30 = 0").withColumn("id", F.col("id") + 1000000)), "id")


@query(f"""WITH {PAIRS}, a AS (SELECT prompt[1:500] AS question, answer[1:2000] AS answer, conv_id * 1000 + turn AS id, conv_id % 2 AS priority FROM pairs WHERE prompt <> '' AND length(answer) > 50)
    SELECT id, priority::INT AS priority, length(question) AS asked, length(answer) AS told FROM a ORDER BY md5(id::VARCHAR), id LIMIT 50""")
def priority_union(spark, sf_dir):
    rows = pairs(spark, sf_dir).select(F.col("prompt").alias("question"), "answer", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id")
    return curate.capped_union(rows.filter("conv_id % 2 = 0"), rows.filter("conv_id % 2 = 1"), 50, "id").select("id", "priority", F.length("question").cast("long").alias("asked"), F.length("answer").cast("long").alias("told"))


@query(f"""WITH {SCORES}, {LAST}, p AS (SELECT substr(sha256(text), 1, 16) AS prompt_hash, doc_id AS seq, text, doc_id % 120 AS age, row_number() OVER (PARTITION BY substr(sha256(text), 1, 16) ORDER BY doc_id DESC) AS rn FROM documents),
    d AS (SELECT *, CASE WHEN age > 30 THEN greatest(1, coalesce(score, 3) // 2) ELSE coalesce(score, 3) END AS now FROM p LEFT JOIN last USING (prompt_hash) WHERE rn = 1 AND age <= 90)
    SELECT seq, now AS score, CASE WHEN ('0x' || md5(prompt_hash)[1:4])::INT % 10 < 1 THEN 'eval' ELSE 'train' END AS split FROM d WHERE length(text) >= 100 AND now >= 3""")
def nightly_curation(spark, sf_dir):
    """Documents as pairs of the last 120 days."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.substring(F.sha2("text", 256), 1, 16).alias("prompt_hash"), F.col("doc_id").alias("seq"), F.expr(f"timestamp '{AS_OF}' - make_interval(0, 0, 0, cast(doc_id % 120 as int))").alias("ts"), F.lit("q").alias("prompt"), F.col("text").alias("reasoning"), F.col("text").alias("response"))
    kept = nightly.curated(rows, scores(spark, sf_dir), AS_OF)
    return nightly.examples(kept).join(kept.select("prompt_hash", "seq", "score"), "prompt_hash").select("seq", "score", "split")


@query("SELECT event_id, CASE WHEN s < 0 THEN 3 WHEN s >= 0.9 THEN 5 WHEN s >= 0.7 THEN 4 WHEN s >= 0.5 THEN 3 WHEN s >= 0.3 THEN 2 ELSE 1 END AS legacy FROM (SELECT event_id, (event_id % 12 - 1) / 10.0 AS s FROM events)")
def unit_bands(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", sc.five_from_unit((F.col("event_id") % 12 - 1) / 10.0).alias("legacy"))


@query(f"""WITH {PAIRS}, g AS (SELECT conv_id, turn, answer AS completion, turn % 5 / 4.0 AS reward, 0 AS k FROM pairs UNION ALL SELECT conv_id, turn, concat('generated ', turn), (turn % 3) / 2.0, 1 FROM pairs)
    SELECT conv_id * 1000 + turn AS id, count(*) AS n, max(reward)::DOUBLE AS best, min(reward)::DOUBLE AS worst FROM g GROUP BY 1 HAVING count(*) >= 2""")
def reference_groups(spark, sf_dir):
    """Groups of a stored answer and a generated one."""
    rows = pairs(spark, sf_dir).withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    made = rows.select("id", F.concat(F.lit("generated "), "turn").alias("completion"), (F.col("turn") % 3 / 2.0).alias("reward"))
    g = curate.reference_groups(rows.select("id", F.col("answer").alias("completion"), (F.col("turn") % 5 / 4.0).alias("reward")), made, "id")
    return g.select("id", F.size("completions").cast("long").alias("n"), F.array_max("rewards").alias("best"), F.array_min("rewards").alias("worst"))
