"""Joins, deduplication and training-set curation.  Ties are decided by an explicit ``seq``, never by arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def keep_last(rows: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    return _ranked(rows, key, F.col(seq).desc())


def keep_first(rows: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    return _ranked(rows, key, F.col(seq).asc())


def keep_best(rows: DataFrame, key: str, score: str = "score", seq: str = "seq") -> DataFrame:
    """Highest score, the first on a tie; rows without a key go."""
    return _ranked(rows.filter(F.col(key).isNotNull() & (F.col(key) != "")), key, F.col(score).desc(), F.col(seq).asc())


def _ranked(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """Row number 1 for each key; Spark plans a group limit, so each map task sends one row for each key."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_rn = 1").drop("_rn")


def best_answers(rows: DataFrame, key: str, order: str, answer: str) -> DataFrame:
    """Of each key's candidates with an answer the one of highest score, the first in ``order`` on a tie; a lone one has 0.5."""
    g = rows.filter(F.length(answer) > 0).groupBy(key).agg(F.max_by(F.struct(order, "score"), F.struct("score", -F.col(order))).alias("b"), F.count("*").alias("n"))
    return g.select(key, f"b.{order}", F.when(F.col("n") == 1, 0.5).otherwise(F.col("b.score")).alias("score"))


def latest_score(scores: DataFrame, key: str = "prompt_hash", least: float | None = None) -> DataFrame:
    """The last score of each key; with ``least``, the last of those that reach it."""
    rows = scores if least is None else scores.filter(F.col("score") >= least)
    return rows.groupBy(key).agg(F.max_by("score", "seq").alias("score"))


def scored_pairs(pairs: DataFrame, scores: DataFrame, default: int | None = None, key: str = "prompt_hash") -> DataFrame:
    """Pairs with their latest score: inner, or left with a default."""
    last = latest_score(scores, key)
    if default is None:
        return pairs.join(last, key)
    return pairs.join(last, key, "left").withColumn("score", F.coalesce("score", F.lit(default)))


def unscored(pairs: DataFrame, scores: DataFrame, key: str = "prompt_hash") -> DataFrame:
    return pairs.join(scores.select(key).distinct(), key, "left_anti")


def near_length_score(pairs: DataFrame, scores: DataFrame, width: int = 5) -> DataFrame:
    """Scores by hash; for misses those of entries without a hash whose prompt_len is within ``width``, by an equi-join on bands.

    scores: prompt_hash, route, prompt_len, score, seq.  Entries without a hash are one for each (route, prompt_len), in the order in which
    they first occur and with their last score; the first that is near enough counts.  A missing score is 3.
    """
    known = F.coalesce("prompt_hash", F.lit("")) != ""
    scores = scores.withColumn("score", F.coalesce("score", F.lit(3)))
    exact = scores.filter(known).groupBy("prompt_hash").agg(F.max_by("score", "seq").alias("score"))
    rows = pairs.join(exact, "prompt_hash", "left")
    band = width + 1
    old = scores.filter(~known).groupBy("route", "prompt_len").agg(F.min("seq").alias("seq"), F.max_by("score", "seq").alias("near"))
    first = old.groupBy("prompt_len").agg(F.min("seq").alias("seq"), F.min_by("near", "seq").alias("near"))
    spread = first.withColumn("band", F.explode(F.expr(f"array(prompt_len div {band} - 1, prompt_len div {band}, prompt_len div {band} + 1)")))
    missed = rows.filter("score is null").select("prompt_len").distinct().withColumn("band", F.expr(f"prompt_len div {band}"))
    hits = missed.alias("m").join(spread.alias("s"), F.expr(f"m.band = s.band and abs(m.prompt_len - s.prompt_len) <= {width}"))
    hits = hits.groupBy(F.col("m.prompt_len").alias("prompt_len")).agg(F.min_by("s.near", "s.seq").alias("near"))
    return rows.join(hits, "prompt_len", "left").withColumn("score", F.coalesce("score", "near")).drop("near")


def first_filled(sources: list[DataFrame], key: str) -> DataFrame:
    """Of several sources the rows of the first that has any, for each key."""
    every = None
    for k, s in enumerate(sources):
        s = s.withColumn("source_order", F.lit(k))
        every = s if every is None else every.unionByName(s, allowMissingColumns=True)
    best = every.groupBy(key).agg(F.min("source_order").alias("source_order"))
    return every.join(best, [key, "source_order"])


def search_result(rows: DataFrame) -> DataFrame:
    """``rows`` of a search backend with title, url and content alone, beside the other columns: content is the snippet, where there is one; missing ones are empty."""
    rows = rows.withColumn("content", F.coalesce(*[F.col(c) for c in ("snippet", "content") if c in rows.columns], F.lit("")))
    for c in ("title", "url"):
        rows = rows.withColumn(c, F.coalesce(F.col(c), F.lit("")) if c in rows.columns else F.lit(""))
    return rows.drop("snippet")


def answered(backends: list[tuple[str, DataFrame]], asked: DataFrame, answer: str, key: str = "query_id") -> tuple[DataFrame, DataFrame]:
    """(results, one row for each of ``asked``: key, answer, backend) of search backends (name, rows) in order of preference.

    The first backend that has results for a query gives them all; a row with the title ``answer`` is its synthesised answer, no result, and is
    split off: a backend that has nothing else has no results.  Queries that no backend has results for have the backend ``none``.
    """
    shaped = [(name, search_result(rows)) for name, rows in backends]
    chosen = first_filled([rows.filter(F.col("title") != answer).withColumn("backend", F.lit(name)) for name, rows in shaped], key)
    told = None
    for name, rows in shaped:
        one = rows.filter(F.col("title") == answer).groupBy(key).agg(F.max("content").alias("answer")).withColumn("backend", F.lit(name))
        told = one if told is None else told.unionByName(one)
    by = asked.select(key).distinct().join(chosen.select(key, "backend").distinct(), key, "left").withColumn("backend", F.coalesce("backend", F.lit("none")))
    return chosen.drop("source_order"), by.join(told, [key, "backend"], "left").select(key, "answer", "backend")


def decayed(rows: DataFrame, as_of: str, score: str = "score", ts: str = "ts") -> DataFrame:
    """Drops rows of over 90 days, halves scores (1 at least) of over 30, to the second; bad times count as now."""
    now = F.lit(as_of).cast("timestamp")
    at = F.coalesce(F.col(ts).cast("timestamp"), now)
    half = F.greatest(F.lit(1), F.floor(F.col(score).cast("int") / 2))
    return rows.filter(at >= now - F.expr("interval 90 days")).withColumn(score, F.when(at < now - F.expr("interval 30 days"), half).otherwise(F.col(score)).cast("long"))


def filter_counts(rows: DataFrame, **reasons: Column) -> DataFrame:
    """Counts of rows for each reason and of rows without any, in one pass."""
    return rows.agg(*_counters(reasons))


def _counters(reasons: dict[str, Column]) -> list[Column]:
    return [F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(k) for k, c in reasons.items()], F.count_if(~_any(reasons)).alias("kept")]


def _any(reasons: dict[str, Column]) -> Column:
    bad = F.lit(False)
    for c in reasons.values():
        bad = bad | F.coalesce(c, F.lit(False))
    return bad


def filtered(rows: DataFrame, **reasons: Column) -> tuple[DataFrame, Observation]:
    """Rows without any of the reasons, and an observation that has the counts of ``filter_counts`` once an action has read the rows.

    The counts are taken by the pass that filters, so nothing is read twice.  A null reason is none.
    """
    seen = Observation()
    return rows.observe(seen, *_counters(reasons)).filter(~_any(reasons)), seen


def hash_split(rows: DataFrame, key: str, tenths: int = 1) -> DataFrame:
    """``split`` eval or train by the first digit of the key's md5: the same on any engine and for any order."""
    digit = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 4), 16, 10).cast("int") % 10
    return rows.withColumn("split", F.when(digit < tenths, "eval").otherwise("train"))


def sharegpt(prompt: Column, reasoning: Column, answer: Column) -> Column:
    told = F.when(F.length(F.coalesce(reasoning, F.lit(""))) > 0, F.concat(F.lit("<think>\n"), reasoning, F.lit("\n</think>\n"), answer)).otherwise(answer)
    return F.array(F.struct(F.lit("human").alias("from"), prompt.alias("value")), F.struct(F.lit("gpt").alias("from"), told.alias("value")))


def grouped_answers(rows: DataFrame, key: str = "prompt", order: str = "seq") -> DataFrame:
    """Ordered completions and rewards of each prompt that has two or more."""
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "completion", "reward"))).alias("g")).filter(F.size("g") >= 2)
    return g.select(key, F.transform("g", lambda x: x["completion"]).alias("completions"), F.transform("g", lambda x: x["reward"]).alias("rewards"))


def reference_groups(stored: DataFrame, generated: DataFrame, key: str = "prompt") -> DataFrame:
    """Groups of generated answers with the stored one as a further, first candidate: key, completions, rewards of two or more.

    stored and generated: key, completion, reward; empty completions count with a reward of 0.
    """
    every = stored.select(key, F.lit(0).alias("seq"), "completion", "reward").unionByName(generated.select(key, F.lit(1).alias("seq"), "completion", "reward"))
    return grouped_answers(every.withColumn("reward", F.when(F.length("completion") > 0, F.col("reward")).otherwise(0.0)), key, "seq")


def manifest_diff(old: DataFrame, new: DataFrame, key: str = "file_key", version: str = "version") -> DataFrame:
    o, n = old.select(key, F.col(version).alias("old")), new.select(key, F.col(version).alias("new"))
    status = F.when(F.col("old").isNull(), "NEW").when(F.col("new").isNull(), "DELETED").when(F.col("old") == F.col("new"), "SAME").otherwise("CHANGED")
    return o.join(n, key, "full").select(key, status.alias("status"))


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A new snapshot: old rows without those that ``new`` replaces, and ``new``."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def capped_union(first: DataFrame, second: DataFrame, cap: int, key: str) -> DataFrame:
    """Pairs (question, answer) of two sources, ``priority`` 0 and 1: with a question and an answer of over 50 characters, cut to 500 and 2000.

    Of more than ``cap`` a sample of both together stays: the first in the order of a hash of the key.
    """
    every = first.withColumn("priority", F.lit(0)).unionByName(second.withColumn("priority", F.lit(1)))
    every = every.filter("question <> '' and length(answer) > 50").withColumns({"question": F.substring("question", 1, 500), "answer": F.substring("answer", 1, 2000)})
    return every.orderBy(F.md5(F.col(key).cast("string")), key, "priority").limit(cap)


def listed(rows: DataFrame, key: str, size: str) -> DataFrame:
    """A listing of what is stored under each name: number and largest entry, by name."""
    return rows.groupBy(F.col(key).alias("name")).agg(F.count("*").alias("n"), F.max(size).alias("largest")).orderBy("name")
