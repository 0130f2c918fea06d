"""Monitoring aggregates over decision logs, judgements and rules.  Times are explicit arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from . import asof, grams


def day_stats(rows: DataFrame, as_of: Column) -> DataFrame:
    """Of the last 24 hours: rows (ts, decision, probe_entropy, probe_ms, total_ms, budget_retries)."""
    recent = rows.filter((F.col("ts") > as_of - F.expr("interval 24 hours")) & (F.col("ts") <= as_of))
    again = F.col("budget_retries") > 0
    return recent.agg(
        F.count("*").alias("n"), F.round(F.avg("probe_entropy"), 4).alias("avg_entropy"), F.count_if(F.split_part("decision", F.lit("/"), F.lit(1)) == "think").alias("thinking"),
        F.round(F.avg("probe_ms"), 4).alias("avg_probe_ms"), F.round(F.avg("total_ms"), 4).alias("avg_ms"), F.count_if(again).alias("retried"), F.round(F.avg(F.when(again, F.col("budget_retries"))), 4).alias("avg_retries"),
    )


def distribution(rows: DataFrame, column: str, value: str) -> DataFrame:
    """Rows and mean of each value, most first; nulls stay out."""
    return rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean")).orderBy(F.col("n").desc(), column)


def weakness_key(c: Column, words: int = 5) -> Column:
    """The first words of a lower-cased text, punctuation taken out (digits stay, and words it parted are joined)."""
    flat = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_ \t\n\r]+", "")
    return F.array_join(F.slice(F.filter(F.split(flat, "[ \\t\\n\\r]+"), lambda w: w != ""), 1, words), " ")


def patterns(rows: DataFrame, criteria: list[str], least: int = 2, top: int = 20, examples: int = 3) -> DataFrame:
    """The ``top`` weaknesses of all agents by frequency, of those that occur ``least`` times: rows (agent, weakness, id, criteria...).

    Each bears its agent's weakest criterion, the first of least mean (under 5) over all of the agent's rows.
    """
    # the key of a text is computed once
    keyed = written(rows.select("agent", "id", weakness_key(F.col("weakness")).alias("key")).filter("key <> ''"), "keyed")
    best = keyed.groupBy("agent", "key").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "agent", "key").limit(top).filter(F.col("n") >= least)
    best = written(best, "best")
    near = keyed.join(F.broadcast(best.select("agent", "key")), ["agent", "key"], "left_semi").distinct()
    # planned as a group limit: a frequent weakness sends few rows of each task
    near = near.withColumn("_rn", F.row_number().over(Window.partitionBy("agent", "key").orderBy("id"))).filter(F.col("_rn") <= examples)
    ids = near.groupBy("agent", "key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    means = [F.struct(F.avg(c).alias("mean"), F.lit(i).alias("order"), F.lit(c).alias("name")) for i, c in enumerate(criteria)]
    weak = rows.groupBy("agent").agg(F.array_min(F.filter(F.array(*means), lambda m: m["mean"] < 5)).alias("weak"))
    out = best.join(ids, ["agent", "key"]).join(weak, "agent")
    rank = F.row_number().over(Window.orderBy(F.col("n").desc(), "agent", "key"))  # over ``top`` rows at most
    return out.withColumn("rank", rank).select("agent", "key", "n", F.col("weak.name").alias("weakest"), F.round("weak.mean", 4).alias("mean"), "ids", "rank")


def low_criteria(rows: DataFrame, criteria: list[str], below: float = 2.5, least: int = 3) -> DataFrame:
    """Long form of mean criteria of each agent that fall below a limit."""
    flat = rows.select("agent", F.expr(f"stack({len(criteria)}, {', '.join(f'{c!r}, cast({c} as double)' for c in criteria)}) as (criterion, value)"))
    return flat.groupBy("agent", "criterion").agg(F.count("value").alias("n"), F.round(F.avg("value"), 4).alias("mean")).filter((F.col("n") >= least) & (F.col("mean") < below))


def gates(proposals: DataFrame, runs: DataFrame, judgements: DataFrame, key: str = "agent", cooldown: str = "1 hour", daily: int = 3, least: int = 10, days: int = 7, reverts: int = 2, head: int = 30) -> DataFrame:
    """Which proposals (key, pattern, ts, ...) may run, against what had run by then: ``gate`` is run or the first gate that holds it.

    runs: key, pattern (a summary), ts, patched, reverted; judgements: key, ts.  cooldown: since the agent's last run that made a patch;
    cap: patches of all agents on that day so far; judgements: too few in the last ``days``; blocked: so many of the agent's
    reverts so far name the first ``head`` characters of the pattern in their summary, in any case of ASCII letters.  A proposal without a pattern is not blocked.
    """
    patched = runs.filter("patched").select(F.col(key), "ts", F.col("ts").alias("_last"))
    rows = proposals.withColumn("_head", F.lower(F.substring("pattern", 1, head)))
    heads = rows.select("_head").distinct()
    rows = asof.last_before(rows, patched, [key], ["_last"])
    rows = asof.counted(rows, patched, [], F.date_trunc("day", "ts"), at=False, name="_today")
    rows = asof.counted(rows, judgements, [key], F.col("ts") - F.expr(f"interval {days} days"), name="_judged")
    undone = runs.filter("reverted").select(F.col(key), "ts", F.lower("pattern").alias("_text"))
    # which heads lie in which summaries: both are distinct texts, and met by their rare grams
    told = grams.contained(undone.select("_text").distinct(), heads, "_text", "_text", "_head")
    told = told.unionByName(undone.filter("_text is not null").select("_text", F.lit("").alias("_head")).distinct())
    rows = asof.counted(rows, undone.join(told, "_text"), [key, "_head"], name="_undone")
    gate = (
        F.when(F.col("ts") < F.col("_last") + F.expr(f"interval {cooldown}"), "cooldown").when(F.col("_today") >= daily, "cap")
        .when(F.col("_judged") < least, "judgements").when(F.col("_undone") >= reverts, "blocked").otherwise("run")
    )
    return rows.withColumn("gate", gate).drop("_head", "_last", "_today", "_judged", "_undone")


def rule_life(rows: DataFrame) -> DataFrame:
    return rows.groupBy("rule").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("n"))


def verdict(delta: Column, keep: float = 0.2, revert: float = -0.2) -> Column:
    """A patch is undone below ``revert``, kept from ``keep`` on."""
    return F.when(delta < revert, "revert").when(delta >= keep, "keep").otherwise("neutral")


def before_after(rows: DataFrame, key: str, at: Column, score: str) -> DataFrame:
    """Mean score before and from a patch on, and what to do with the patch."""
    g = rows.groupBy(key).agg(F.avg(F.when(F.col("ts") < at, F.col(score))).alias("b"), F.avg(F.when(F.col("ts") >= at, F.col(score))).alias("a"))
    return g.select(key, F.round("b", 3).alias("before"), F.round("a", 3).alias("after"), verdict(F.round(F.col("a") - F.col("b"), 6)).alias("verdict"))


def status_rollup(rows: DataFrame, key: str, status: str = "verdict") -> DataFrame:
    """How many patches of each agent, and of all (key null), have each status."""
    return rows.cube(key, status).agg(F.count("*").alias("n")).filter(F.col(status).isNotNull())


def dataset_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(F.length("prompt")), 4).alias("avg_prompt"), F.round(F.avg(F.length("answer")), 4).alias("avg_answer"), F.countDistinct("iteration").alias("iterations"))


def accumulated(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """The context each step sees: all earlier outputs of its run, joined; an error ends the run's usable steps."""
    w = Window.partitionBy(key).orderBy(order)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    ok = F.coalesce(F.max(F.col("error").cast("int")).over(past), F.lit(0)) == 0
    return rows.withColumn("context", F.array_join(F.collect_list(text).over(past), "\n\n")).withColumn("reached", ok)
