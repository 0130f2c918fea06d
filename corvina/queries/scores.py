"""Routing, complexity, entropy, decisions and rewards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring as sc
from ..operators import curate
from ..plans import requests as rq
from . import query, table
from .texts import _IP, _SHA, _TOLD, LAST_USER, count_sql, has_sql, quoted
from .words import LEXICON as lx

_COUNTS = ", ".join(f"{{n: {count_sql('lower(text)', p)}, o: {-i}, r: '{r}'}}" for i, (r, p) in enumerate(lx.routes))
_HITS = f"list_reverse_sort(list_filter([{_COUNTS}], lambda s: s.n > 0))"
ROUTED = f"""routed AS (SELECT conv_id, text, h[1].r AS kw, CASE WHEN len(h) = 1 THEN least(0.95, 0.7 + 0.05 * h[1].n) WHEN len(h) > 1 THEN least(0.85, 0.5 + 0.05 * (h[1].n - h[2].n)) ELSE 0.0 END::DOUBLE AS kc
    FROM (SELECT *, {_HITS} AS h FROM ({LAST_USER})))"""


@query(f"WITH {ROUTED} SELECT conv_id, kw AS route, round(kc, 4) AS confidence FROM routed")
def keyword_route(spark, sf_dir):
    r = rq.last_user_text(table(spark, sf_dir, "conversations")).select("conv_id", sc.keyword_route(F.col("text"), lx).alias("r"))
    return r.select("conv_id", "r.route", F.round("r.confidence", 4).alias("confidence"))


_EXT = "CASE page_id % 6 WHEN 0 THEN 'py' WHEN 1 THEN 'pdf' WHEN 2 THEN 'csv' WHEN 3 THEN 'xyz' WHEN 4 THEN 'png' ELSE 'log' END"

@query("""WITH f AS (SELECT page_id, ['py', CASE page_id % 6 WHEN 0 THEN 'py' WHEN 1 THEN 'pdf' WHEN 2 THEN 'csv' WHEN 3 THEN 'xyz' WHEN 4 THEN 'png' ELSE 'log' END, CASE WHEN page_id % 2 = 0 THEN 'pdf' ELSE 'zip' END] AS fs FROM pages),
    x AS (SELECT page_id, unnest(fs) AS e, generate_subscripts(fs, 1) AS i FROM f), v AS (SELECT page_id, r, count(*) AS n, min(i) AS i FROM x JOIN (VALUES """ + ", ".join(f"('{k}', '{v}')" for k, v in lx.file_routes) + """) m(e, r) USING (e) GROUP BY page_id, r),
    b AS (SELECT page_id, arg_min(r, i - 100 * n) AS r FROM v GROUP BY page_id)
    SELECT f.page_id, CASE WHEN list_contains(fs, 'png') THEN 'vision' ELSE r END AS route, CASE WHEN list_contains(fs, 'png') THEN 0.9 WHEN r IS NOT NULL THEN 0.85 ELSE 0.0 END::DOUBLE AS confidence FROM f LEFT JOIN b USING (page_id)""")
def filetype_route(spark, sf_dir):
    ext = F.expr(_EXT)
    files = F.array(F.lit("a.py"), F.concat(F.lit("b."), ext), F.when(F.col("page_id") % 2 == 0, "c.PDF").otherwise("c.zip"))
    return table(spark, sf_dir, "pages").select("page_id", sc.file_route(files, lex=lx).alias("r")).select("page_id", "r.route", "r.confidence")


_N, _LOW = "length(text)", "lower(text)"
_BAND = f"CASE WHEN {_N} < 20 THEN 0.0 WHEN {_N} < 80 THEN 0.05 WHEN {_N} < 200 THEN 0.10 WHEN {_N} < 500 THEN 0.18 ELSE 0.25 END"
_PARTS = "len(regexp_split_to_array(text, '[.!?]+'))"
_MARKS = count_sql("text", "[?]")


def _cap(pattern: str, unit: float, most: float) -> str:
    return f"least({most}, {unit} * {count_sql(_LOW, pattern)})"


COMPLEXITY = f"""(CASE WHEN {has_sql(_LOW, lx.greeting)} THEN 0.0 WHEN {has_sql(_LOW, lx.factual)} THEN least({_BAND} + 0.05, 0.20) ELSE least(1.0, {_BAND}
    + CASE WHEN {_MARKS} >= 3 THEN 0.15 WHEN {_MARKS} = 2 THEN 0.08 WHEN {_MARKS} = 1 THEN 0.03 ELSE 0.0 END + {_cap(lx.ambiguity, 0.10, 0.25)} + {_cap(lx.multistep, 0.08, 0.20)} + {_cap(lx.technical, 0.06, 0.20)}
    + CASE WHEN {has_sql('text', lx.code_blocks)} THEN 0.05 ELSE 0.0 END + CASE WHEN {_PARTS} >= 5 THEN 0.10 WHEN {_PARTS} >= 3 THEN 0.05 ELSE 0.0 END) END)::DOUBLE"""


@query(f"WITH r AS ({LAST_USER}) SELECT conv_id, round({COMPLEXITY}, 4) AS complexity FROM r")
def query_complexity(spark, sf_dir):
    return rq.last_user_text(table(spark, sf_dir, "conversations")).select("conv_id", F.round(sc.complexity(F.col("text"), lx), 4).alias("complexity"))


_ROUTE_OF = "CASE event_type WHEN 'click' THEN 'code' WHEN 'view' THEN 'research' WHEN 'error' THEN 'kine' ELSE 'general' END"
HISTORY = f"hist AS (SELECT route, count(*) AS n, avg(score) AS m, stddev_pop(score) AS d FROM (SELECT {_ROUTE_OF} AS route, 1 + event_id % 5 AS score FROM events ORDER BY event_id DESC LIMIT 200) GROUP BY route)"
_HIST = "CASE WHEN n IS NULL OR n < 3 THEN 0.5 ELSE least(1.0, CASE WHEN m >= 4.5 THEN 0.0 WHEN m >= 4 THEN 0.15 WHEN m >= 3 THEN 0.5 - 0.15 * (m - 3) WHEN m >= 2 THEN 0.5 + 0.25 * (1 - (m - 2)) ELSE 0.85 END + least(0.15, 0.1 * d)) END"


def _history(spark, sf_dir):
    scores = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.expr(_ROUTE_OF).alias("route"), (1 + F.col("event_id") % 5).alias("score"))
    return rq.route_history(scores)


@query(f"WITH {HISTORY} SELECT route, n, round({_HIST}, 4) AS entropy FROM hist")
def history_entropy(spark, sf_dir):
    return _history(spark, sf_dir).select("route", "n", F.round(sc.history_entropy(F.col("n"), F.col("mean"), F.col("deviation")), 4).alias("entropy"))


def _normal(route: str) -> str:
    return f"CASE WHEN {route} IN ({', '.join(quoted(r) for r in lx.known_routes)}) THEN {route} ELSE '{lx.default_route}' END"


PLANNED = f"""WITH {ROUTED}, {HISTORY}, c AS (SELECT conv_id, CASE WHEN g THEN 'default' WHEN kc >= 0.5 THEN {_normal('kw')} ELSE 'default' END AS route, CASE WHEN g THEN 0.9 WHEN kc >= 0.5 THEN kc ELSE 0.3 END AS confidence,
    CASE WHEN g THEN 'fastpath' WHEN kc >= 0.5 THEN 'keyword' ELSE 'llm' END AS strategy, round({COMPLEXITY}, 4) AS complexity FROM (SELECT *, {has_sql('lower(trim(text))', lx.small_talk)} AS g FROM routed)),
    e AS (SELECT c.*, round(0.45 * complexity + 0.30 * least(1.0, greatest(0.0, 1 - confidence)) + 0.25 * {_HIST}, 4) AS entropy FROM c LEFT JOIN hist USING (route)),
    p AS (SELECT *, CASE WHEN entropy <= 0.28 THEN 'low' WHEN entropy >= 0.52 THEN 'high' ELSE 'medium' END AS entropy_class FROM e)"""


@query(f"{PLANNED} SELECT conv_id, route, round(confidence, 4) AS confidence, strategy, complexity, round(entropy, 3) AS entropy, entropy_class FROM p")
def composite_entropy(spark, sf_dir):
    rows = rq.planned(rq.last_user_text(table(spark, sf_dir, "conversations")), _history(spark, sf_dir), lx)
    return rows.select("conv_id", "route", F.round("confidence", 4).alias("confidence"), "strategy", "complexity", F.round("entropy", 3).alias("entropy"), "entropy_class")


@query(f"{PLANNED} SELECT route, entropy_class, count(*) AS n, round(avg(complexity), 4) AS avg_complexity FROM p GROUP BY route, entropy_class")
def route_summary(spark, sf_dir):
    """The flagship: requests by route and entropy class."""
    scores = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.expr(_ROUTE_OF).alias("route"), (1 + F.col("event_id") % 5).alias("score"))
    return rq.flagship(table(spark, sf_dir, "conversations"), scores, lx)


_KW, _FR = "CASE event_id % 4 WHEN 1 THEN 'code' WHEN 2 THEN 'data' WHEN 3 THEN 'vision' END", "CASE event_id % 3 WHEN 1 THEN 'code' WHEN 2 THEN 'vision' END"
_KC, _FC = "CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE event_id % 7 / 10.0 END", "CASE event_id % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.85 ELSE 0.9 END"


@query(f"""WITH r AS (SELECT event_id, event_id % 11 = 0 AS g, {_KW} AS kw, ({_KC})::DOUBLE AS kc, {_FR} AS fr, ({_FC})::DOUBLE AS fc FROM events)
    SELECT event_id, CASE WHEN g THEN 'default' WHEN kc >= 0.5 THEN {_normal('kw')} WHEN fc >= 0.5 THEN {_normal('fr')} WHEN kc > 0 THEN {_normal('kw')} ELSE 'default' END AS route,
    round(CASE WHEN g THEN 0.9 WHEN kc >= 0.5 THEN kc WHEN fc >= 0.5 THEN CASE WHEN kw = fr THEN least(0.95, fc + 0.1) ELSE fc END WHEN kc > 0 THEN kc ELSE 0.3 END, 4)::DOUBLE AS confidence,
    CASE WHEN g THEN 'fastpath' WHEN kc >= 0.5 THEN 'keyword' WHEN fc >= 0.5 THEN 'filetype' WHEN kc > 0 THEN 'keyword_weak' ELSE 'llm' END AS strategy FROM r""")
def route_cascade(spark, sf_dir):
    """Every tier of the cascade, with confidences given."""
    told = lambda r, c: F.struct(F.expr(r).alias("route"), F.expr(c).cast("double").alias("confidence"))
    rows = table(spark, sf_dir, "events").select("event_id", sc.cascade(F.col("event_id") % 11 == 0, told(_KW, _KC), told(_FR, _FC), lex=lx).alias("r"))
    return rows.select("event_id", "r.route", F.round("r.confidence", 4).alias("confidence"), "r.strategy")


_THINK = f"""CASE WHEN conv_id % 13 = 0 THEN 'off/tools' WHEN conv_id % 11 = 0 THEN CASE WHEN conv_id % 2 = 0 THEN 'on/caller' ELSE 'off/caller' END WHEN conv_id % 17 = 0 THEN 'on/vision' WHEN {_N} < 20 THEN 'off/short'
    WHEN {has_sql(_LOW, lx.greeting)} AND {_N} < 80 THEN 'off/greeting' WHEN conv_id % 7 = 0 THEN CASE WHEN conv_id % 2 = 0 THEN 'on/pipeline' ELSE 'off/pipeline' END WHEN conv_id % 5 = 0 AND conv_id % 19 <> 0 THEN 'off/hint' WHEN conv_id % 19 = 0 THEN 'on/force'
    WHEN conv_id % 23 = 0 THEN 'on/probe-fail' WHEN conv_id % 10 / 10.0 > 0.8 THEN 'on/probe' ELSE 'off/probe' END"""


@query(f"WITH r AS ({LAST_USER}) SELECT conv_id, {_THINK} AS decision FROM r")
def thinking_decision(spark, sf_dir):
    i = F.col("conv_id")
    probe = F.when(i % 23 != 0, i % 10 / 10.0)
    d = sc.thinking(F.col("text"), i % 13 == 0, F.when(i % 11 == 0, i % 2 == 0), i % 17 == 0, F.when(i % 7 == 0, i % 2 == 0), F.when(i % 5 == 0, "no-think").otherwise("none"), i % 19 == 0, probe, lex=lx)
    return rq.last_user_text(table(spark, sf_dir, "conversations")).select("conv_id", d.alias("decision"))


@query("""WITH r AS (SELECT DISTINCT conv_id, CASE conv_id % 4 WHEN 0 THEN 'fast' WHEN 1 THEN 'quality' WHEN 2 THEN 'ultra' ELSE 'odd' END AS asked FROM conversations)
    SELECT conv_id, CASE WHEN asked = 'odd' THEN 'fast' ELSE asked END AS mode, CASE asked WHEN 'quality' THEN 4096 WHEN 'ultra' THEN 8192 ELSE 1024 END AS budget,
    CASE WHEN asked IN ('quality', 'ultra') THEN greatest(4096, least(2000 + conv_id * 100, CASE asked WHEN 'quality' THEN 8192 ELSE 16384 END)) ELSE least(2000 + conv_id * 100, 4096) END::BIGINT AS max_tokens FROM r""")
def mode_overlay(spark, sf_dir):
    i = F.col("conv_id")
    rows = table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("mode", F.when(i % 4 == 0, "fast").when(i % 4 == 1, "quality").when(i % 4 == 2, "ultra").otherwise("odd"))
    rows = rq.with_mode(rows)
    return rows.select("conv_id", "mode", "budget", sc.merged_tokens(2000 + i * 100, F.col("max_tokens").cast("long"), F.col("deep")).alias("max_tokens"))


PAIRS = "pairs AS (SELECT conv_id, turn, text AS prompt, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations QUALIFY role = 'user' AND next = 'assistant')"


def pairs(spark, sf_dir):
    """User turns with the assistant turn that follows."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("prompt"), F.lead("text").over(w).alias("answer"), F.lead("role").over(w).alias("next"))
    return rows.filter("role = 'user' and next = 'assistant'").drop("role", "next")


def _set(c: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda w: w <> ''))"


_SHAPES = [r"(?m)^\s*[-*0-9]+[.)]\s", r"(?m)^#+\s", r"\[[^\n]*?\]"]
CANDIDATE = f"""(CASE WHEN length(answer) = 0 THEN 0.0 ELSE round(CASE WHEN length(answer) > 100 THEN least(0.3::DOUBLE, 0.1::DOUBLE + 0.2::DOUBLE * least(length(answer)::DOUBLE / 2000, 1.0::DOUBLE)) ELSE 0.0::DOUBLE END
    + least(0.3::DOUBLE, 0.03::DOUBLE * ({' + '.join(f"least({count_sql('answer', p)}, 5)" for p in _SHAPES)})) + CASE WHEN len({_set('prompt')}) > 0 THEN 0.4::DOUBLE * len(list_intersect({_set('prompt')}, {_set('answer')})) / len({_set('prompt')}) ELSE 0.0::DOUBLE END, 3) END)::DOUBLE"""


@query(f"WITH {PAIRS} SELECT conv_id, turn, {CANDIDATE} AS score FROM pairs")
def candidate_heuristic(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", sc.candidate_score(F.col("prompt"), F.col("answer")).alias("score"))


@query(f"WITH {PAIRS}, s AS (SELECT *, {CANDIDATE} AS score FROM pairs WHERE length(answer) > 0), b AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS rn FROM s) SELECT conv_id, turn, CASE WHEN n = 1 THEN 0.5 ELSE score END AS score FROM b WHERE rn = 1")
def best_of_k(spark, sf_dir):
    rows = pairs(spark, sf_dir).withColumn("score", sc.candidate_score(F.col("prompt"), F.col("answer")))
    return curate.best_answers(rows, "conv_id", "turn", "answer")


@query(f"""WITH {PAIRS}, x AS (SELECT *, {_set('prompt')} AS r, {_set('answer')} AS a, length(answer) / greatest(length(prompt), 1) AS q FROM pairs)
    SELECT conv_id, turn, round((CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(r, a)) / greatest(len(r), 1) * CASE WHEN q > 0.3 AND q < 3 THEN 1.0 ELSE 0.5 END END)::DOUBLE, 4) AS overlap FROM x""")
def keyword_overlap_metric(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", F.round(sc.keyword_overlap(F.col("prompt"), F.col("answer")), 4).alias("overlap"))


@query()
def step_extract(spark, sf_dir):
    """Steps of answers; conversations are made into numbered, headed and bulleted forms by turn."""
    lines = F.filter(F.split("answer", "\n"), lambda x: F.length(x) > 0)
    form = F.when(F.col("turn") % 3 == 0, F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")).when(F.col("turn") % 3 == 1, F.array_join(F.transform(lines, lambda x: F.concat(F.lit("## "), x)), "\n")).otherwise(F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n"))
    return pairs(spark, sf_dir).select("conv_id", "turn", sc.steps(form, F.when(F.col("conv_id") % 2 == 0, "code").otherwise("research")).alias("steps"))


_SCORE_TEXT = "CASE event_id % 5 WHEN 0 THEN concat('x {\"score\": ', event_id % 9, '} y') WHEN 1 THEN concat('score ', event_id % 7) WHEN 2 THEN '{\"note\": 2}' WHEN 3 THEN '{\"score\": 4.7}' ELSE concat('a', event_id % 100, 'b') END"


@query(f"""WITH t AS (SELECT event_id, {_SCORE_TEXT} AS t FROM events), d AS (SELECT *, nullif(regexp_extract(t, '(?:^|[^0-9])([1-5])(?:[^0-9]|$)', 1), '')::INT AS digit FROM t)
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN least(5, greatest(1, event_id % 9)) WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE coalesce(digit, 3) END::INT AS parsed, nullif(regexp_extract(t, '([1-5])', 1), '')::INT AS first FROM d""")
def score_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(_SCORE_TEXT).alias("t"))
    return rows.select("event_id", sc.parsed_score(F.col("t")).alias("parsed"), sc.first_digit(F.col("t")).alias("first"))


_TOOL = "CASE event_id % 4 WHEN 0 THEN concat('{\"name\": \"f', event_id, '\", \"arguments\": {\"a\": 1}}') WHEN 1 THEN '{\"name\": \"\", \"arguments\": {}}' WHEN 2 THEN 'no call' ELSE 'x {\"a\": 1} {\"name\": \"g\", \"arguments\": {}}' END"


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 0.5 ELSE 1.0 END::DOUBLE AS tool, least(1.0, greatest(0.0, (event_id % 7 - 1) / 4))::DOUBLE AS prm FROM events")
def json_tool_reward(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(_TOOL).alias("t"))
    return rows.select("event_id", sc.tool_reward(F.col("t")).alias("tool"), sc.unit_reward(F.col("event_id") % 7).alias("prm"))


_LABELS = "case event_id % 4 when 0 then 'a \\\\boxed{correct} b \\\\boxed{INCORRECT} step 1 is wrong' when 1 then 'Step 1 is right. step 2: wrong' when 2 then '✓ x ✗ ☑' else 'nothing' end"
_TOKENS = "transform(sequence(1, 3), k -> array(struct(if(k < 3, ' Yes', 'x') as token, -cast(event_id % 5 as double) as logprob), struct(if(event_id % 3 = 0, 'maybe', 'no') as token, -1.0D as logprob)))"


@query("""WITH s AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '1,0' WHEN 1 THEN '1,0' WHEN 2 THEN '1,0,1' ELSE '' END AS labels, CASE WHEN event_id % 3 <> 0 THEN exp(-(event_id % 5)) / (exp(-(event_id % 5)) + exp(-1)) END AS p,
    CASE event_id % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 0.5 WHEN 2 THEN 2.0 / 3 END AS share, CASE event_id % 2 WHEN 0 THEN 0.9 ELSE 0.1 END AS said FROM events), x AS (SELECT event_id, labels, round(coalesce(p, share, said)::DOUBLE, 6) AS score FROM s)
    SELECT event_id, labels, score, CASE WHEN score >= 0.9 THEN 5 WHEN score >= 0.7 THEN 4 WHEN score >= 0.5 THEN 3 WHEN score >= 0.3 THEN 2 ELSE 1 END AS legacy FROM x""")
def step_labels(spark, sf_dir):
    """A verifier's labels, its score and the score's place on the scale of 1 to 5."""
    rows = table(spark, sf_dir, "events").select("event_id", sc.step_labels(F.expr(_LABELS)).alias("labels"), F.expr(_TOKENS).alias("t"), F.when(F.col("event_id") % 2 == 0, "So: Yes.").otherwise("So: no").alias("answer"))
    rows = rows.withColumn("score", F.round(sc.step_score(F.col("t"), F.col("labels"), F.col("answer")), 6))
    return rows.select("event_id", F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"), "score", sc.five_from_unit(F.col("score")).alias("legacy"))


@query(f"WITH r AS ({LAST_USER}) SELECT conv_id, array_to_string([text] || list_filter([concat('q', conv_id), 'more'], lambda x: x <> text), '|') AS queries FROM r")
def query_expansion(spark, sf_dir):
    answer = F.concat(F.lit('Sure: ["q'), "conv_id", F.lit('", "more"] done'))
    return rq.last_user_text(table(spark, sf_dir, "conversations")).select("conv_id", F.array_join(sc.expanded_queries(F.col("text"), answer), "|").alias("queries"))


_IOC = f"({_IP} <> '' AND ({_TOLD} OR NOT regexp_matches({_IP}, '^(?:127[.]|192[.]168[.]|10[.])')) OR {_SHA} <> '' AND ({_TOLD} OR {_N} < 80))"


@query(f"""WITH {ROUTED}, x AS (SELECT conv_id, {has_sql(_LOW, lx.deep_research)} AND coalesce(kw, '') = 'research' AS deep, coalesce(CASE WHEN conv_id % 5 = 0 THEN conv_id % 2 = 0 END, coalesce(kw, '') IN ({', '.join(quoted(r) for r in lx.knowledge_routes)})) AS r,
        CASE conv_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS web, {has_sql(_LOW, lx.recent)} AND {_N} >= 40 AS recent, coalesce(kw, '') = 'research' OR {has_sql(_LOW, lx.searchable)} AS search, regexp_extract(text, {quoted(lx.csv)}, 1) <> '' AS csv, {_IOC} AS ioc FROM routed),
    y AS (SELECT *, coalesce(NOT web, false) AND recent AND conv_id % 4 > 0 AS probe FROM x)
    SELECT conv_id, array_to_string(list_filter([CASE WHEN probe THEN 'probe' END, CASE WHEN csv THEN 'csv' END, CASE WHEN ioc THEN 'ioc' END, CASE WHEN deep THEN 'deep' END, CASE WHEN r AND NOT deep THEN 'rag' END, CASE WHEN (coalesce(web, search) OR probe) AND NOT deep THEN 'web' END], lambda t: t IS NOT NULL), ',') AS tools FROM y""")
def enrichment_plan(spark, sf_dir):
    i = F.col("conv_id")
    web, rag = F.when(i % 3 == 0, True).when(i % 3 == 1, False), F.when(i % 5 == 0, i % 2 == 0)
    rows = rq.last_user_text(table(spark, sf_dir, "conversations")).withColumn("route", F.coalesce(sc.keyword_route(F.col("text"), lx)["route"], F.lit("")))
    return rows.select("conv_id", F.array_join(sc.enrichment_plan(F.col("text"), F.col("route"), web, rag, i % 4 > 0, lx), ",").alias("tools"))


#: Log probabilities of four alternatives for each of 16 tokens, from all of a vector's values.
_TOPS = "transform(sequence(0, 15), t -> transform(sequence(1, 4), k -> cast(embedding[4 * t + k - 1] as double) * 4))"
_TOPS_SQL = "list_transform(range(0, 16), lambda t: list_transform(range(1, 5), lambda k: embedding[4 * t + k]::DOUBLE * 4))"
_P_SQL = f"list_transform({_TOPS_SQL}, lambda x: list_transform(x, lambda y: exp(y) / list_sum(list_transform(x, lambda z: exp(z)))))"


@query(f"""WITH p AS (SELECT vec_id, {_P_SQL} AS ps FROM embeddings), e AS (SELECT vec_id, list_transform(ps, lambda p: -list_sum(list_transform(p, lambda x: x * ln(x + 1e-10)))) AS h, list_transform(ps, lambda p: list_max(p)) AS m FROM p)
    SELECT vec_id, round(list_avg(h), 4) AS entropy, round(0.625 * list_avg(m) + 0.375 * (1 - list_avg(h) / 11.93), 4) AS certainty FROM e""")
def token_entropy(spark, sf_dir):
    tops = F.expr(_TOPS)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", tops.alias("tops"))
    return rows.select("vec_id", F.round(sc.token_entropy(F.col("tops")), 4).alias("entropy"), F.round(sc.certainty(F.col("tops")), 4).alias("certainty"))


#: Vectors as tokens, a chunk each: their entries are log probabilities, the first that of the token; every eighth chunk of a label is an answer's.
_HALT = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE * 4 - 2) AS l, vec_id % 8 = 7 AS said FROM embeddings), e AS (SELECT *, list_transform(l, lambda x: exp(x)) AS e FROM v),
    p AS (SELECT *, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e), o AS (SELECT *, sum(CASE WHEN said THEN 0 ELSE 30 END) OVER (PARTITION BY label ORDER BY vec_id) AS chars FROM p),
    c AS (SELECT vec_id, label, 0.625 * exp(l[1]) + 0.375 * (1 + list_sum(list_transform(p, lambda x: x * ln(x + 1e-10))) / ln(64 + 1e-10)) AS c FROM o WHERE NOT said AND chars >= 100),
    w AS (SELECT vec_id, label, CASE WHEN count(*) OVER x = 5 THEN avg(c) OVER x END AS m FROM c WINDOW x AS (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
    h AS (SELECT label, min(vec_id) AS ends FROM w WHERE m > 0.2 GROUP BY label), f AS (SELECT w.* FROM w LEFT JOIN h USING (label) WHERE ends IS NULL OR vec_id <= ends)"""


def token_chunks(spark, sf_dir):
    said, logs = F.col("vec_id") % 8 == 7, F.transform("embedding", lambda x: x.cast("double") * 4 - 2)
    e = table(spark, sf_dir, "embeddings")
    text = lambda on, n: F.when(on, F.repeat(F.lit("x"), n)).otherwise("")
    return e.select("vec_id", "label", text(~said, 30).alias("reasoning"), text(said, 5).alias("content"), F.array(F.struct(F.get(logs, F.lit(0)).alias("logprob"), logs.alias("top"))).alias("tokens"))


CERTAIN = f"""WITH {_HALT} SELECT v.vec_id, round(last_value(m IGNORE NULLS) OVER (PARTITION BY v.label ORDER BY v.vec_id), 4) AS mean, coalesce(v.vec_id >= ends, false) AS halted FROM v LEFT JOIN f USING (vec_id) LEFT JOIN h ON h.label = v.label"""


@query(CERTAIN)
def stream_certainty_window(spark, sf_dir):
    """Labels as requests, vectors as their chunks in order."""
    return sc.halted_stream(token_chunks(spark, sf_dir), "label", "vec_id", threshold=0.2).select("vec_id", F.round("mean", 4).alias("mean"), "halted")


@query("""WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt, value / 30 AS certain, (event_id % 7) * 90 AS len FROM events)
    SELECT user_id, min(event_id) AS event_id FROM a WHERE (certain >= 0.7 AND len >= 100) OR len >= 500 OR attempt >= 3 GROUP BY user_id""")
def abf_accept(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("attempt", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    ok = sc.accepts(F.col("value") / 30, F.col("event_id") % 7 * 90, F.col("attempt"))
    return rows.filter(ok).groupBy("user_id").agg(F.min("event_id").alias("event_id"))


@query(f"""WITH r AS ({LAST_USER}), e AS (SELECT *, CASE WHEN conv_id % 4 = 0 THEN NULL ELSE conv_id % 10 / 10.0 END AS h FROM r)
    SELECT conv_id, CASE WHEN {has_sql(_LOW, lx.hedges)} THEN 'deep' WHEN h > 0.6 THEN 'deep' WHEN h > 0.35 THEN 'quick' WHEN (h IS NULL OR h = 0) AND {_N} > 20 AND (length(trim(text, concat(' ', chr(9), chr(10), chr(13)))) < 80 OR {has_sql(_LOW, lx.cutoff)}) THEN 'quick' ELSE 'none' END AS depth FROM e""")
def probe_confidence(spark, sf_dir):
    h = F.when(F.col("conv_id") % 4 != 0, F.col("conv_id") % 10 / 10.0)
    return rq.last_user_text(table(spark, sf_dir, "conversations")).select("conv_id", sc.probe_depth(h, F.col("text"), lx).alias("depth"))


@query("""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l, instr(text, 'en') AS p, rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS t FROM documents)
    SELECT doc_id, array_to_string(list_filter(l, lambda x: NOT contains(x, 'the')), chr(10)) AS removed, CASE WHEN l[1] <> '' THEN array_to_string(l[1:1] || ['NEW'] || l[2:], chr(10)) ELSE concat(t, chr(10), 'NEW', chr(10)) END AS added,
    CASE WHEN p > 0 THEN concat(text[1:p - 1], 'NEW', text[p + 2:]) ELSE text END AS replaced, concat(t, chr(10), 'NEW', chr(10)) AS appended, text AS kept FROM l""")
def line_edit(spark, sf_dir):
    rows, c = table(spark, sf_dir, "documents"), F.col("text")
    first = F.substring(F.get(F.split("text", "\n"), F.lit(0)), 1, 1)
    return rows.select(
        "doc_id", sc.edited_lines(c, F.lit("remove"), F.lit("the"), F.lit("")).alias("removed"), sc.edited_lines(c, F.lit("add"), first, F.lit("NEW")).alias("added"),
        sc.edited_lines(c, F.lit("replace"), F.lit("en"), F.lit("NEW")).alias("replaced"), sc.edited_lines(c, F.lit("add"), F.lit("no such line"), F.lit("NEW")).alias("appended"), sc.edited_lines(c, F.lit("remove"), F.lit(""), F.lit("")).alias("kept"),
    )


_RULE = "concat('1. **', source, '** rule', chr(10), '## short', chr(10), '  **', upper(lang), ' ', doc_id, ' rule**')"


@query(f"SELECT doc_id, concat('1. **', source, '** rule') AS rule, substr(sha256(concat('1. **', source, '** rule')), 1, 16) AS hash FROM documents UNION ALL SELECT doc_id, r, substr(sha256(r), 1, 16) FROM (SELECT doc_id, concat('**', upper(lang), ' ', doc_id, ' rule**') AS r FROM documents) WHERE length(r) > 10")
def rule_extract(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(sc.rule_lines(F.expr(_RULE.replace("chr(10)", "char(10)")))))


@query("""SELECT doc_id, doc_id % 5 <= 3 AND doc_id % 4 <= 2 AND NOT contains(lower(text), 'token') AND NOT (doc_id % 4 > 0 AND lang = 'es') AND 96 + doc_id % 7 + doc_id % 5 - doc_id % 4 <= 100 AS allowed FROM documents""")
def patch_gate(spark, sf_dir):
    i = F.col("doc_id")
    touched = F.array_compact(F.array("text", F.when(i % 4 > 0, F.concat(F.lit("rule "), F.upper("lang")))))
    return table(spark, sf_dir, "documents").select("doc_id", sc.patch_allowed(i % 5, touched, i % 4, 96 + i % 7, ["Token", "rule ES"]).alias("allowed"))


@query(f"""WITH t AS (SELECT conv_id, turn, role, text FROM conversations), l AS (SELECT conv_id, max(turn) FILTER (role = 'user') AS last, count(*) AS n, max(turn) AS top FROM t GROUP BY conv_id)
    SELECT l.conv_id, string_agg(CASE WHEN turn = last THEN concat('Q|A|', text) ELSE text END, '|' ORDER BY turn) || CASE WHEN last IS NULL THEN '|Q|A' ELSE '' END AS texts FROM l JOIN t USING (conv_id) GROUP BY l.conv_id, last""")
def example_injection(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    turns = turns.withColumn("t", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))))
    example = F.array(F.struct(F.lit("user").alias("role"), F.lit("Q").alias("text")), F.struct(F.lit("assistant").alias("role"), F.lit("A").alias("text")))
    return turns.select("conv_id", F.array_join(F.transform(sc.with_example(F.col("t"), example), lambda x: x["text"]), "|").alias("texts"))
