"""Gates, builders, stores and the remaining retrieval compositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import boundary
from ..functions import turns as tn
from ..operators import asof, retrieve, stores
from ..plans import debate, search
from . import query, table
from .retrieval import item_queries
from .scores import PAIRS, pairs
from .texts import quoted
from .words import LEXICON as lx


@query("SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS text, bool_or(turn % 5 = 3) AS image FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'user') > 0")
def chat_request_arrays(spark, sf_dir):
    """Requests as arrays of turns with typed parts."""
    part = F.struct(F.lit("text").alias("type"), "text")
    image = F.struct(F.lit("image_url").alias("type"), F.lit("x").alias("text"))
    turn = F.struct("turn", "role", F.when(F.col("turn") % 5 == 3, F.array(part, image)).otherwise(F.array(part)).alias("parts"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return rows.filter(F.exists("turns", lambda t: t["role"] == "user")).select("conv_id", tn.last_user(F.col("turns")).alias("text"), tn.has_image(F.col("turns")).alias("image"))


_ROUTE = "CASE conv_id % 5 WHEN 0 THEN 'code' WHEN 1 THEN 'research' WHEN 2 THEN 'kine' WHEN 3 THEN 'vision' ELSE 'data' END"


@query(f"WITH {PAIRS} SELECT conv_id, turn, {_ROUTE} IN ('code', 'research', 'kine', 'data') AND length(answer) >= 100 AS scored, length(prompt) < 30 OR conv_id % 7 = 0 OR NOT conv_id % 3 <> 0 AS skipped FROM pairs")
def answer_gates(spark, sf_dir):
    i = F.col("conv_id")
    return pairs(spark, sf_dir).select("conv_id", "turn", tn.should_score(F.expr(_ROUTE), F.col("answer"), lx).alias("scored"), tn.skips_enrichment(F.col("prompt"), i % 7 == 0, i % 3 != 0).alias("skipped"))


_ALLOWED = {"search": "doc_id % 2 = 0", "calculator": "true", "files": "doc_id % 3 = 0"}


@query("SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_ALLOWED[t]} AND ({' OR '.join(f'contains(lower(text), {quoted(x)})' for x in w)}) THEN '{t}' END" for t, w in lx.tools) + "], lambda t: t IS NOT NULL), ',') AS tools FROM documents")
def tool_trigger(spark, sf_dir):
    allowed = F.array_compact(F.array(*[F.when(F.expr(c), t) for t, c in _ALLOWED.items()]))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tn.triggered_tools(F.col("text"), allowed, lx), ",").alias("tools"))


_DOM = ", ".join("{n: " + " + ".join(f"contains(lower(text), '{w}')::INT" for w in ws) + f", o: {-i}, d: '{d}'}}" for i, (d, ws) in enumerate(lx.training_domains))


@query(f"WITH b AS (SELECT doc_id, list_max([{_DOM}]) AS b FROM documents), d AS (SELECT doc_id, CASE WHEN b.n > 0 THEN b.d ELSE 'general' END AS domain FROM b) SELECT doc_id, domain, CASE domain WHEN 'code' THEN coalesce(CASE WHEN doc_id % 2 = 0 THEN 1.0 END, 0.5) WHEN 'tools' THEN 0.0 ELSE coalesce(CASE WHEN doc_id % 3 > 0 THEN (doc_id % 5) / 4 END, 0.5) END::DOUBLE AS reward FROM d")
def training_domain(spark, sf_dir):
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", tn.training_domain(F.col("text"), lx).alias("domain"))
    return rows.withColumn("reward", tn.combined_reward(F.col("domain"), F.lit(0.0), F.when(i % 2 == 0, 1.0), F.when(i % 3 > 0, i % 5 + 1)))


@query(f"""WITH {PAIRS} SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN prompt ELSE concat(array_to_string(CASE WHEN turn % 3 = 1 THEN [answer] ELSE [answer, prompt] END, chr(10) || '---' || chr(10)), chr(10), chr(10),
    CASE {_ROUTE} WHEN 'code' THEN 'Answer with code.' WHEN 'research' THEN 'Cite the sources.' WHEN 'kine' THEN 'Answer in short steps.' ELSE 'Use the context.' END, chr(10), chr(10), prompt) END AS prompt FROM pairs""")
def context_prompt(spark, sf_dir):
    one, two = F.col("answer"), F.col("prompt")
    blocks = F.when(F.col("turn") % 3 == 0, F.array().cast("array<string>")).when(F.col("turn") % 3 == 1, F.array(one)).otherwise(F.array(one, two))
    return pairs(spark, sf_dir).select("conv_id", "turn", tn.prompt_with_context(F.col("prompt"), blocks, F.expr(_ROUTE)).alias("prompt"))


@query(f"WITH {PAIRS} SELECT conv_id, turn, 'rag,web' AS tools, length(prompt) + length(answer) AS chars, substr(sha256(prompt), 1, 16) AS hash, CASE WHEN 1 + turn % 5 >= 4 THEN 'store' WHEN 1 + turn % 5 <= 2 THEN 'flag' ELSE 'none' END AS action FROM pairs")
def enrichment_accounting(spark, sf_dir):
    blocks = F.array(F.struct(F.lit("rag").alias("tool"), F.col("prompt").alias("text")), F.struct(F.lit("web").alias("tool"), F.col("answer").alias("text")))
    rows = pairs(spark, sf_dir).select("conv_id", "turn", tn.accounting(blocks).alias("a"), tn.preference(F.col("prompt"), F.col("answer"), F.lit("no"), 1).alias("p"), tn.score_action(1 + F.col("turn") % 5).alias("action"))
    return rows.select("conv_id", "turn", F.array_join("a.tools_used", ",").alias("tools"), "a.chars", F.col("p.prompt_hash").alias("hash"), "action")


_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


@query(f"""WITH l AS (SELECT doc_id, {_LINES} AS l FROM documents) SELECT doc_id, coalesce(l[1], '') AS title, array_to_string(list_transform(range(1, len(l) + 1), lambda i: concat('Step ', i, ': ', l[i])), chr(10)) AS steps,
    concat('Question: ', coalesce(l[1], ''), chr(10), chr(10), 'First view:', chr(10), coalesce(l[2], '-'), chr(10), chr(10), 'Second view:', chr(10), coalesce(l[3], '-'), chr(10), chr(10), 'Name what is wrong in each.') AS debate FROM l""")
def model_prompts(spark, sf_dir):
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = table(spark, sf_dir, "documents").withColumn("l", lines)
    at = lambda k, d: F.coalesce(F.get("l", F.lit(k)), F.lit(d))
    return rows.select("doc_id", tn.summary(F.col("text"))["title"].alias("title"), tn.step_prompt(F.col("l")).alias("steps"), tn.debate_prompt(at(0, ""), at(1, "-"), at(2, "-")).alias("debate"))


_MODE = "CASE doc_id % 4 WHEN 0 THEN 'general' WHEN 1 THEN 'code' WHEN 2 THEN 'medical' ELSE 'odd' END"


def _debate_sql() -> str:
    """The three passes with the echoing generator, whose answers are the first 200 characters of the prompts."""
    def told(role: str) -> str:
        text = " ".join(f"WHEN mode = '{m}' THEN {quoted(getattr(r, role))}" for m, r in debate.MODES.items() if m != "general")
        text = f"CASE {text} ELSE {quoted(getattr(debate.MODES['general'], role))} END"
        for said in {"critic": ("advocate", "opponent"), "synthesis": ("advocate", "opponent", "critic")}.get(role, ()):
            text = f"replace({text}, '{{{said}}}', {said})"
        return f"concat('answer: ', concat({text}, CASE WHEN length(coalesce(context, '')) > 0 THEN concat(chr(10), chr(10), '--- Context ---', chr(10), context) ELSE '' END, chr(10), chr(10), question)[1:200])"

    return f"""WITH q AS (SELECT doc_id AS key, text AS question, {_MODE} AS mode, CASE WHEN doc_id % 3 = 0 THEN source END AS context FROM documents), a AS (SELECT *, {told('advocate')} AS advocate, {told('opponent')} AS opponent FROM q),
        c AS (SELECT *, {told('critic')} AS critic FROM a) SELECT key, advocate, opponent, critic, {told('synthesis')} AS synthesis FROM c"""


@query(_debate_sql())
def debate_rounds(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("question"), F.expr(_MODE).alias("mode"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("context"))
    return debate.debate(rows, boundary.echo_generator).select("key", "advocate", "opponent", "critic", "synthesis")


@query("""WITH e AS (SELECT source AS route, text AS input, doc_id % 5 + 1 AS score, doc_id AS ts, doc_id % 2 AS n FROM documents), f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY route, lower(input[1:100]) ORDER BY n, ts) = 1)
    SELECT route, ts, score, array_to_string(list_filter(regexp_split_to_array(lower(input), '[ \\t\\n\\r]+'), lambda w, i: length(w) > 4 AND i = list_position(regexp_split_to_array(lower(input), '[ \\t\\n\\r]+'), w))[1:8], ' ') AS tags, length(input[1:500]) AS kept
    FROM f QUALIFY row_number() OVER (PARTITION BY route ORDER BY score DESC, ts DESC) <= 10""")
def capped_fewshot_store(spark, sf_dir):
    i = F.col("doc_id")
    e = table(spark, sf_dir, "documents").select(F.col("source").alias("route"), *stores.example(F.col("text"), F.col("text")), (i % 5 + 1).alias("score"), i.alias("ts"))
    kept = stores.capped_store(e.filter("ts % 2 = 0"), e.filter("ts % 2 = 1"))
    return kept.select("route", "ts", "score", F.array_join("tags", " ").alias("tags"), F.length("input").cast("long").alias("kept"))


@query("SELECT vec_id FROM embeddings WHERE vec_id % 5 <> 4")
def vectors_add_if_absent(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    old = e.filter("vec_id % 5 < 3").unionByName(e.filter("vec_id % 5 = 4").withColumn("embedding", F.slice("embedding", 1, 32)))
    return stores.add_vectors(old, e.filter("vec_id % 5 in (2, 3)"), 64, "vec_id").select("vec_id")


_HITS = "hits AS (SELECT page_id % 5 AS query_id, url, page_id AS rank FROM pages)"


@query(f"WITH {_HITS}, a AS (SELECT query_id, url FROM hits WHERE rank % 3 = 0) SELECT query_id, url FROM a UNION ALL SELECT query_id, url FROM hits h WHERE rank % 2 = 0 AND NOT EXISTS (SELECT 1 FROM a WHERE a.query_id = h.query_id AND a.url = h.url)")
def category_merge(spark, sf_dir):
    h = table(spark, sf_dir, "pages").select((F.col("page_id") % 5).alias("query_id"), "url", F.col("page_id").alias("rank"))
    return stores.merged_by_url(h.filter("rank % 3 = 0"), h.filter("rank % 2 = 0")).select("query_id", "url")


_NAMED = lambda sites: "(" + " OR ".join(f"contains(url, {quoted(x)})" for x in sites) + ")"


@query(f"WITH {_HITS}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, url) AS place FROM hits QUALIFY place <= 40) SELECT query_id, url, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank, url) AS place FROM p WHERE {_NAMED(lx.academic_sites)} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, url) <= 20")
def academic_keep(spark, sf_dir):
    h = table(spark, sf_dir, "pages").select((F.col("page_id") % 5).alias("query_id"), "url", F.col("page_id").alias("rank"))
    return stores.academic(h, 20, lx)


@query(f"WITH {_HITS}, r AS (SELECT query_id, url, rank AS place FROM hits WHERE rank <= 40 AND starts_with(url, 'http') AND NOT {_NAMED(lx.skipped_sites)}) SELECT query_id, url, place, row_number() OVER (PARTITION BY query_id ORDER BY place, url) AS rank FROM r QUALIFY rank <= 20")
def low_value_drop(spark, sf_dir):
    h = table(spark, sf_dir, "pages").select((F.col("page_id") % 5).alias("query_id"), "url", F.col("page_id").alias("rank"))
    return search.readable(h, 20, lx)


@query()
def hybrid_query(spark, sf_dir):
    """Dense (stub embeddings) and keyword retrieval of documents in two collections for benchmark items, fused and reranked (a test holds it against plain Python)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, "medical").otherwise("code").alias("collection"), boundary.hash_embedding(F.col("text")).alias("embedding"))
    q = item_queries(spark, sf_dir).withColumn("q", boundary.hash_embedding(F.col("query")))
    return search.hybrid(q, d, ["medical", "code"], 20, 5, 0.25, boundary.overlap_scorer).select("query_id", "doc_id", "rrf", "score", "rank")


@query("""WITH c AS (SELECT doc_id AS chunk_id, doc_id % 4 AS query_id, doc_id % 10 / 10.0 AS embed_score, (doc_id * 7 % 11)::DOUBLE AS score FROM documents) SELECT query_id, chunk_id, embed_score::DOUBLE AS embed_score, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM c QUALIFY rank <= 6""")
def rerank(spark, sf_dir):
    i = F.col("doc_id")
    c = table(spark, sf_dir, "documents").select(i.alias("chunk_id"), (i % 4).alias("query_id"), (i % 10 / 10.0).alias("score"))
    return retrieve.reranked(c, (F.col("chunk_id") * 7 % 11).cast("double"), 6)


@query("SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS n FROM events")
def rolling_week(spark, sf_dir):
    """Each event's number of the same user's events in the week until it."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return asof.counted(e, e, ["user_id"], F.col("ts") - F.expr("interval 7 days")).select("user_id", "event_id", "n")
