"""Request planning as one select: last user text, route, complexity, entropy, decision and the route's parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as sc
from ..lexicons import DEFAULT, Lexicon

ROLES = {"system": "system", "user": "user", "assistant": "assistant", "tool": "tool", "tool_result": "tool", "tool_response": "tool", "function": "tool"}

#: Parameters of the three modes; they override a route's own.
MODES = [("fast", 1024, 4096, False), ("quality", 4096, 8192, True), ("ultra", 8192, 16384, True)]


def last_user_text(turns: DataFrame) -> DataFrame:
    """(conv_id, text) of the last user turn; combines map-side."""
    return turns.filter("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


def sanitized(turns: DataFrame) -> DataFrame:
    """Known roles only; all system texts of a conversation become its first turn."""
    table = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    rows = turns.withColumn("role", F.coalesce(F.try_element_at(table, F.lower("role")), F.lit("user")))
    system = rows.filter("role = 'system'").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "\n\n").alias("text"))
    return rows.filter("role <> 'system'").select("conv_id", "turn", "role", "text").unionByName(system.select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"), "text"))


def route_history(scores: DataFrame, last: int = 200) -> DataFrame:
    """(route, n, mean, deviation) over the last rows overall; scores: seq, route, score."""
    recent = scores.orderBy(F.col("seq").desc()).limit(last)
    return recent.groupBy("route").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("deviation"))


#: Routes are few: a history of more rows than this is no table of routes, and is joined by shuffle.
ROUTES = 10_000


def planned(requests: DataFrame, history: DataFrame, lex: Lexicon = DEFAULT) -> DataFrame:
    """requests (conv_id, text and, where there are any, files, image, model_route, model_confidence) with route, confidence, strategy, complexity,
    entropy and its class.  ``history`` has a row for each route."""
    has = requests.columns
    files = F.coalesce("files", F.array().cast("array<string>")) if "files" in has else F.array().cast("array<string>")
    image = F.coalesce("image", F.lit(False)) if "image" in has else F.lit(False)
    told = [F.col(c) if c in has else None for c in ("model_route", "model_confidence")]
    talk = F.lower(F.trim("text")).rlike(lex.small_talk) & (F.size(files) == 0) & ~image
    rows = requests.withColumn("r", sc.cascade(talk, sc.keyword_route(F.col("text"), lex), sc.file_route(files, image, lex), *told, lex))
    small = history.limit(ROUTES + 1).count() <= ROUTES
    rows = rows.select("conv_id", "text", "r.route", "r.confidence", "r.strategy").join(F.broadcast(history) if small else history, "route", "left")
    rows = rows.withColumn("complexity", F.round(sc.complexity(F.col("text"), lex), 4))
    score = sc.composite(F.col("complexity"), sc.confidence_entropy(F.col("confidence")), sc.history_entropy(F.col("n"), F.col("mean"), F.col("deviation")))
    return rows.withColumn("entropy", score).withColumn("entropy_class", sc.entropy_class(F.col("entropy"))).drop("n", "mean", "deviation")


def with_mode(rows: DataFrame) -> DataFrame:
    """Adds budget, max_tokens and deep of the row's mode; unknown modes are fast."""
    modes = rows.sparkSession.createDataFrame(MODES, "mode string, budget int, max_tokens int, deep boolean")
    known = [m[0] for m in MODES]
    return rows.withColumn("mode", F.when(F.col("mode").isin(known), F.col("mode")).otherwise("fast")).join(F.broadcast(modes), "mode")


def flagship(turns: DataFrame, scores: DataFrame, lex: Lexicon = DEFAULT) -> DataFrame:
    """Requests by route and entropy class: number and mean complexity."""
    rows = planned(last_user_text(turns), route_history(scores), lex)
    return rows.groupBy("route", "entropy_class").agg(F.count("*").alias("n"), F.round(F.avg("complexity"), 4).alias("avg_complexity"))
