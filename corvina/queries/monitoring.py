"""Monitoring aggregates: events stand for decisions and judgements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import monitor
from ..sources import readers
from . import query, table

_DECIDED = "SELECT event_id, ts, event_type AS route, CASE WHEN event_id % 3 = 0 THEN 'think/on' ELSE 'fast' END AS decision, (event_id % 100) / 100.0 AS probe_entropy, event_id % 500 AS probe_ms, value AS total_ms, event_id % 4 AS budget_retries FROM events"
_LAST = "(SELECT max(ts) FROM events)"


def decisions(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("event_type").alias("route"), F.when(i % 3 == 0, "think/on").otherwise("fast").alias("decision"), (i % 100 / 100.0).alias("probe_entropy"), (i % 500).alias("probe_ms"), F.col("value").alias("total_ms"), (i % 4).alias("budget_retries"))


@query(f"""WITH d AS ({_DECIDED}) SELECT count(*) AS n, round(avg(probe_entropy), 4) AS avg_entropy, count(*) FILTER (split_part(decision, '/', 1) = 'think') AS thinking, round(avg(probe_ms), 4) AS avg_probe_ms, round(avg(total_ms), 4) AS avg_ms, count(*) FILTER (budget_retries > 0) AS retried,
    round(avg(budget_retries) FILTER (budget_retries > 0), 4) AS avg_retries FROM d WHERE ts > {_LAST} - INTERVAL 24 HOUR""")
def stats_24h(spark, sf_dir):
    last = table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    return monitor.day_stats(decisions(spark, sf_dir), F.lit(last).cast("timestamp_ntz"))


@query(f"WITH d AS ({_DECIDED}) SELECT route, count(*) AS n, round(avg(probe_entropy), 4) AS mean FROM d GROUP BY route")
def route_distribution(spark, sf_dir):
    return monitor.distribution(decisions(spark, sf_dir), "route", "probe_entropy")


@query(f"WITH d AS ({_DECIDED}) SELECT CASE WHEN probe_entropy <= 0.28 THEN 'low' WHEN probe_entropy >= 0.52 THEN 'high' ELSE 'medium' END AS class, count(*) AS n, round(avg(total_ms), 4) AS mean FROM d GROUP BY 1")
def entropy_distribution(spark, sf_dir):
    from ..functions.scoring import entropy_class

    return monitor.distribution(decisions(spark, sf_dir).withColumn("class", entropy_class(F.col("probe_entropy"))), "class", "total_ms")


_JUDGED = "SELECT source AS agent, text AS weakness, doc_id AS id, 1 + doc_id % 5 AS c1, 1 + doc_id % 4 AS c2, 1 + doc_id % 3 AS c3 FROM documents"
_CRITERIA = ["c1", "c2", "c3"]


def judged(spark, sf_dir):
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(F.col("source").alias("agent"), F.col("text").alias("weakness"), i.alias("id"), (1 + i % 5).alias("c1"), (1 + i % 4).alias("c2"), (1 + i % 3).alias("c3"))


@query(f"""WITH j AS ({_JUDGED}), k AS (SELECT *, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(weakness), '[^\\p{{L}}\\p{{N}}_ \\t\\n\\r]+', '', 'g'), '[ \\t\\n\\r]+'), lambda w: w <> '')[1:5], ' ') AS key FROM j),
    a AS (SELECT agent, list_min(list_filter([{{m: avg(c1), o: 0, c: 'c1'}}, {{m: avg(c2), o: 1, c: 'c2'}}, {{m: avg(c3), o: 2, c: 'c3'}}], lambda x: x.m < 5)) AS w FROM j GROUP BY agent),
    g AS (SELECT agent, key, count(*) AS n, list_sort(list(DISTINCT id))[1:3] AS ids FROM k WHERE key <> '' GROUP BY agent, key), t AS (SELECT *, row_number() OVER (ORDER BY n DESC, agent, key) AS rank FROM g QUALIFY rank <= 20)
    SELECT agent, key, n, w.c AS weakest, round(w.m, 4) AS mean, array_to_string(ids, ',') AS ids, rank FROM t JOIN a USING (agent) WHERE n >= 2""")
def pattern_mining(spark, sf_dir):
    return monitor.patterns(judged(spark, sf_dir), _CRITERIA).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query(f"WITH j AS ({_JUDGED}), u AS (SELECT agent, 'c1' AS criterion, c1 AS v FROM j UNION ALL SELECT agent, 'c2', c2 FROM j UNION ALL SELECT agent, 'c3', c3 FROM j) SELECT agent, criterion, count(*) AS n, round(avg(v), 4) AS mean FROM u GROUP BY ALL HAVING count(*) >= 3 AND avg(v) < 2.5")
def low_criterion(spark, sf_dir):
    return monitor.low_criteria(judged(spark, sf_dir), _CRITERIA)


GATES = """WITH e AS (SELECT event_id AS id, ts, event_type AS agent, concat('Pattern of Customers No ', user_id % 7, ' that is long') AS pattern FROM events), r AS (SELECT *, concat('seen again: ', upper(pattern), '; and more') AS summary FROM e WHERE id % 97 = 0), x AS (SELECT id, agent, ts,
        (SELECT max(r.ts) FROM r WHERE r.agent = e.agent AND r.ts < e.ts) AS last, (SELECT count(*) FROM r WHERE r.ts::DATE = e.ts::DATE AND r.ts < e.ts) AS today,
        (SELECT count(*) FROM e j WHERE j.id % 2 = 0 AND j.agent = e.agent AND j.ts <= e.ts AND j.ts >= e.ts - INTERVAL 7 DAY) AS n,
        (SELECT count(*) FROM r WHERE r.id % 194 = 0 AND r.agent = e.agent AND r.ts <= e.ts AND contains(lower(r.summary), lower(e.pattern[1:30]))) AS undone FROM e)
    SELECT id, agent, CASE WHEN ts < last + INTERVAL 1 HOUR THEN 'cooldown' WHEN today >= 3 THEN 'cap' WHEN n < 10 THEN 'judgements' WHEN undone >= 2 THEN 'blocked' ELSE 'run' END AS gate FROM x"""


def proposed(spark, sf_dir):
    """Every event as a proposal; every 97th made a patch, every other of these was reverted; every second is a judgement."""
    i = F.col("id")
    pattern = F.concat(F.lit("Pattern of Customers No "), F.col("user_id") % 7, F.lit(" that is long"))
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("agent"), pattern.alias("pattern"))
    runs = e.filter(i % 97 == 0).withColumns({"patched": F.lit(True), "reverted": i % 194 == 0, "pattern": F.concat(F.lit("seen again: "), F.upper("pattern"), F.lit("; and more"))})
    return e, runs, e.filter(i % 2 == 0)


@query(GATES)
def gates_cooldown(spark, sf_dir):
    return monitor.gates(*proposed(spark, sf_dir)).select("id", "agent", "gate")


@query("SELECT concat(event_type, '-', user_id) AS rule, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM events GROUP BY 1")
def rule_first_last(spark, sf_dir):
    return monitor.rule_life(table(spark, sf_dir, "events").select(F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("rule"), "ts"))


@query("""WITH g AS (SELECT user_id, avg(value) FILTER (ts < TIMESTAMP '2024-01-10') AS b, avg(value) FILTER (ts >= TIMESTAMP '2024-01-10') AS a FROM events GROUP BY user_id)
    SELECT user_id, round(b, 3) AS before, round(a, 3) AS after, CASE WHEN round(a - b, 6) >= 0.2 THEN 'keep' WHEN round(a - b, 6) < -0.2 THEN 'revert' ELSE 'neutral' END AS verdict FROM g""")
def patch_verdict(spark, sf_dir):
    return monitor.before_after(table(spark, sf_dir, "events"), "user_id", F.lit("2024-01-10").cast("timestamp_ntz"), "value")


@query("""WITH g AS (SELECT user_id, avg(value) FILTER (ts < TIMESTAMP '2024-01-10') AS b, avg(value) FILTER (ts >= TIMESTAMP '2024-01-10') AS a FROM events GROUP BY user_id),
    v AS (SELECT user_id % 5 AS agent, CASE WHEN round(a - b, 6) >= 0.2 THEN 'keep' WHEN round(a - b, 6) < -0.2 THEN 'revert' ELSE 'neutral' END AS verdict FROM g) SELECT agent, verdict, count(*) AS n FROM v GROUP BY CUBE (agent, verdict) HAVING verdict IS NOT NULL""")
def patch_status(spark, sf_dir):
    rows = monitor.before_after(table(spark, sf_dir, "events"), "user_id", F.lit("2024-01-10").cast("timestamp_ntz"), "value")
    return monitor.status_rollup(rows.withColumn("agent", F.col("user_id") % 5), "agent")


@query("SELECT source, count(*) AS n, round(avg(length(lang)), 4) AS avg_prompt, round(avg(length(text)), 4) AS avg_answer, count(DISTINCT doc_id % 3) AS iterations FROM documents GROUP BY source")
def dataset_stats(spark, sf_dir):
    return monitor.dataset_stats(table(spark, sf_dir, "documents").select("source", F.col("lang").alias("prompt"), F.col("text").alias("answer"), (F.col("doc_id") % 3).alias("iteration")))


@query("""SELECT conv_id, turn, coalesce(string_agg(text, chr(10) || chr(10)) OVER w, '') AS context, coalesce(max((turn % 7 = 5)::INT) OVER w, 0) = 0 AS reached FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def step_accumulation(spark, sf_dir):
    """The whole texts of all earlier turns."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("out"), (F.col("turn") % 7 == 5).alias("error"))
    return monitor.accumulated(rows, "conv_id", "turn", "out").select("conv_id", "turn", "context", "reached")


@query("SELECT event_id, event_type, 1 + event_id % 5 AS score FROM events ORDER BY event_id DESC LIMIT 200")
def tail_scan(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", (1 + F.col("event_id") % 5).alias("score"))
    return readers.tail(rows, 200, "event_id")


@query("SELECT page_id FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def new_urls(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return readers.not_ingested(p.select("page_id", "url"), p.filter("page_id % 3 = 0")).select("page_id")
