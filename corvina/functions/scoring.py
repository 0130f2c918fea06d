"""Scoring cascades as Column expressions: routes, complexity, entropy, decisions, rewards and parsers of model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lexicons import DEFAULT, Lexicon

# Thresholds of the entropy classes, weights of the composite; the bands of the functions below are fixed too.
LOW, HIGH = 0.28, 0.52
WEIGHTS = (0.45, 0.30, 0.25)


def _strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(" \t\n\r\x0b\x0c"))


def keyword_route(c: Column, lex: Lexicon = DEFAULT) -> Column:
    """{route, confidence}: most matches, ties to the first in order; null without any."""
    low = F.lower(c)
    counts = F.array(*[F.struct(F.regexp_count(low, F.lit(p)).alias("n"), F.lit(-i).alias("order"), F.lit(r).alias("route")) for i, (r, p) in enumerate(lex.routes)])
    hit = F.sort_array(F.filter(counts, lambda s: s["n"] > 0), asc=False)
    first, second = F.get(hit, F.lit(0)), F.get(hit, F.lit(1))
    alone = F.least(F.lit(0.95), 0.7 + 0.05 * first["n"])
    several = F.least(F.lit(0.85), 0.5 + 0.05 * (first["n"] - second["n"]))
    return F.struct(first["route"].alias("route"), F.when(F.size(hit) == 1, alone).when(F.size(hit) > 1, several).otherwise(0.0).alias("confidence"))


def file_route(files: Column, image: Column | None = None, lex: Lexicon = DEFAULT) -> Column:
    """{route, confidence} of file names: an image (among them, or told) decides at once, else most votes, ties to the first seen."""
    suffix = F.transform(files, lambda f: F.lower(F.regexp_extract(f, "[.]([^./]*)$", 1)))
    table = F.create_map(*[F.lit(x) for pair in lex.file_routes for x in pair])
    routes = F.filter(F.transform(suffix, lambda s: F.try_element_at(table, s)), lambda r: r.isNotNull())
    seen = F.exists(suffix, lambda s: s.isin(*lex.image_suffixes))
    seen = seen if image is None else seen | image
    votes = F.transform(F.array_distinct(routes), lambda r, i: F.struct(F.size(F.filter(routes, lambda x: x == r)).alias("n"), (-i).alias("order"), r.alias("route")))
    best = F.array_max(votes)
    return F.struct(F.when(seen, "vision").otherwise(best["route"]).alias("route"), F.when(seen, 0.9).when(best.isNotNull(), 0.85).otherwise(0.0).alias("confidence"))


def normal_route(route: Column, lex: Lexicon = DEFAULT) -> Column:
    """Routes without a pipeline of their own become the default."""
    return F.when(route.isin(*lex.known_routes), route).otherwise(lex.default_route)


def cascade(plain_talk: Column, by_word: Column, by_file: Column, model_route: Column | None = None, model_confidence: Column | None = None, lex: Lexicon = DEFAULT) -> Column:
    """{route, confidence, strategy}: small talk, strong keywords, files (0.1 more where weak keywords agree), weak keywords, else a model's answer.

    model_route and model_confidence are boundary columns; without them the answer is general with 0.3.
    """
    model_route = F.lit("general") if model_route is None else model_route
    model_confidence = F.lit(0.3) if model_confidence is None else model_confidence
    word, file, weak = by_word["confidence"] >= 0.5, by_file["confidence"] >= 0.5, by_word["confidence"] > 0
    backed = F.when(F.coalesce(by_word["route"] == by_file["route"], F.lit(False)), F.least(F.lit(0.95), by_file["confidence"] + 0.1)).otherwise(by_file["confidence"])
    route = F.when(word, by_word["route"]).when(file, by_file["route"]).when(weak, by_word["route"]).otherwise(model_route)
    return F.struct(
        F.when(plain_talk, lex.default_route).otherwise(normal_route(route, lex)).alias("route"),
        F.when(plain_talk, 0.9).when(word, by_word["confidence"]).when(file, backed).when(weak, by_word["confidence"]).otherwise(model_confidence).alias("confidence"),
        F.when(plain_talk, "fastpath").when(word, "keyword").when(file, "filetype").when(weak, "keyword_weak").otherwise("llm").alias("strategy"),
    )


def complexity(c: Column, lex: Lexicon = DEFAULT) -> Column:
    """0 for a greeting, little for a factual question, else the sum of bands and capped counts."""
    low, n = F.lower(c), F.length(c)
    marks, parts = F.regexp_count(c, F.lit("[?]")), F.size(F.split(c, "[.!?]+"))
    band = F.when(n < 20, 0.0).when(n < 80, 0.05).when(n < 200, 0.10).when(n < 500, 0.18).otherwise(0.25)

    def capped(pattern: str, unit: float, most: float) -> Column:
        return F.least(F.lit(most), unit * F.regexp_count(low, F.lit(pattern)))

    score = band + F.when(marks >= 3, 0.15).when(marks == 2, 0.08).when(marks == 1, 0.03).otherwise(0.0)
    score = score + capped(lex.ambiguity, 0.10, 0.25) + capped(lex.multistep, 0.08, 0.20) + capped(lex.technical, 0.06, 0.20)
    score = score + F.when(c.rlike(lex.code_blocks), 0.05).otherwise(0.0) + F.when(parts >= 5, 0.10).when(parts >= 3, 0.05).otherwise(0.0)
    short = F.least(band + 0.05, F.lit(0.20))
    return F.when(low.rlike(lex.greeting), 0.0).when(low.rlike(lex.factual), short).otherwise(F.least(score, F.lit(1.0)))


def confidence_entropy(confidence: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - confidence))


def history_entropy(n: Column, mean: Column, deviation: Column) -> Column:
    """From the last scores of a route: their number, mean and population deviation."""
    band = F.when(mean >= 4.5, 0.0).when(mean >= 4, 0.15).when(mean >= 3, 0.5 - 0.15 * (mean - 3)).when(mean >= 2, 0.5 + 0.25 * (1 - (mean - 2))).otherwise(0.85)
    return F.when(n.isNull() | (n < 3), 0.5).otherwise(F.least(F.lit(1.0), band + F.least(F.lit(0.15), 0.1 * deviation)))


def composite(query: Column, confidence: Column, history: Column) -> Column:
    return F.round(WEIGHTS[0] * query + WEIGHTS[1] * confidence + WEIGHTS[2] * history, 4)


def entropy_class(score: Column) -> Column:
    return F.when(score <= LOW, "low").when(score >= HIGH, "high").otherwise("medium")


def thinking(c: Column, tools: Column, caller: Column, image: Column, pipeline: Column, hint: Column, force: Column, probe: Column, threshold: float = 0.8, lex: Lexicon = DEFAULT) -> Column:
    """The first of nine rules that holds.

    tools, image, force: boolean; caller and pipeline: true, false or null where not told; hint: ``no-think`` of the
    entropy router; probe: the entropy of a short answer, null where the probe failed, which means to think.
    """
    return (
        F.when(tools, "off/tools").when(caller.isNotNull(), F.when(caller, "on/caller").otherwise("off/caller")).when(image, "on/vision").when(F.length(c) < 20, "off/short")
        .when(F.lower(c).rlike(lex.greeting) & (F.length(c) < 80), "off/greeting").when(pipeline.isNotNull(), F.when(pipeline, "on/pipeline").otherwise("off/pipeline"))
        .when((hint == "no-think") & ~force, "off/hint").when(force, "on/force").when(probe.isNull(), "on/probe-fail").when(probe > threshold, "on/probe").otherwise("off/probe")
    )


def merged_tokens(caller: Column, profile: Column, thinks: Column) -> Column:
    """The smaller of both limits; at least 4096 while thinking."""
    limit = F.least(F.coalesce(caller, profile), profile)
    return F.when(thinks, F.greatest(limit, F.lit(4096))).otherwise(limit)


def _normal(top: Column) -> Column:
    p = F.transform(top, lambda x: F.exp(x))
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return F.transform(p, lambda x: x / total)


def _entropy(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a - x * F.log(x + 1e-10))


def token_entropy(tops: Column) -> Column:
    """Mean entropy of renormalised top log probabilities, an array for each token; 999 without tokens."""
    each = F.transform(tops, lambda t: _entropy(_normal(t)))
    return F.when(F.size(tops) == 0, 999.0).otherwise(F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.size(tops))


def certainty(tops: Column, window: int = 32) -> Column:
    """Weighted mean of the largest probability and of one less the scaled entropy, over the last ``window`` tokens; 0 without any."""
    last = F.when(F.size(tops) > window, F.slice(tops, -window, window)).otherwise(tops)
    n = F.size(last)
    peak = F.aggregate(F.transform(last, lambda t: F.array_max(_normal(t))), F.lit(0.0), lambda a, x: a + x) / n
    spread = F.aggregate(F.transform(last, lambda t: _entropy(_normal(t)) / 11.93), F.lit(0.0), lambda a, x: a + x) / n
    return F.when(n == 0, 0.0).otherwise(0.625 * peak + 0.375 * (1 - spread))


#: Fixed values of the certainty of a stream: its threshold, tokens to a window, characters of thinking before it counts.
HALT, STREAM_WINDOW, LEAST_THINKING = 0.55, 5, 100


def step_certainty(logprob: Column, top: Column) -> Column:
    """Of one token: its own probability, and one less the entropy of the ``top`` log probabilities scaled by its largest value; null without any.

    A null ``logprob`` is that of the first of them.
    """
    most = F.log(F.size(top).cast("double") + 1e-10)
    entropy = F.when(most > 0, _entropy(_normal(top)) / most).otherwise(0.0)
    return F.when(F.size(top) > 0, 0.625 * F.exp(F.coalesce(logprob, F.get(top, F.lit(0)))) + 0.375 * (1 - entropy))


def halted_stream(chunks: DataFrame, key: str, seq: str, threshold: float = HALT, window: int = STREAM_WINDOW, least: int = LEAST_THINKING) -> DataFrame:
    """Of each chunk of an answer (key, seq, reasoning, content, tokens) the ``mean`` certainty of the last tokens and whether thinking is ``halted``.

    tokens: structs (logprob, top).  A chunk with content ends thinking until there is reasoning again; tokens count
    while thinking, once ``least`` characters were thought; a halt is kept.  ``mean`` is null until ``window`` tokens count.  ``streaming.certainty`` is the same on a stream.
    """
    past = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    thinks = F.when(F.length("content") > 0, False).when(F.length("reasoning") > 0, True)
    rows = chunks.withColumn("_on", F.coalesce(F.last(thinks, ignorenulls=True).over(past), F.lit(False)))
    rows = rows.withColumn("_chars", F.sum(F.coalesce(F.length("reasoning"), F.lit(0))).over(past))
    sure = F.filter(F.transform("tokens", lambda t: step_certainty(t["logprob"], t["top"])), lambda x: x.isNotNull())
    none = F.array().cast("array<double>")
    rows = rows.withColumn("_c", F.when(F.col("_on") & (F.col("_chars") >= least), F.coalesce(sure, none)).otherwise(none))
    flat = rows.select(key, seq, F.posexplode_outer("_c").alias("_pos", "_sure"))
    order = Window.partitionBy(key).orderBy(seq, "_pos")
    told = flat.filter("_sure is not null").withColumn("_m", F.avg("_sure").over(order.rowsBetween(1 - window, 0))).withColumn("_n", F.count("*").over(order.rowsBetween(1 - window, 0)))
    told = told.withColumn("_m", F.when(F.col("_n") == window, F.col("_m")))
    over = F.max(F.col("_m") > threshold).over(order.rowsBetween(Window.unboundedPreceding, -1))  # a halt ends the count
    told = told.withColumn("_over", over).filter("not coalesce(_over, false)").groupBy(key, seq).agg(F.max_by("_m", "_pos").alias("_m"), F.max(F.col("_m") > threshold).alias("_halt"))
    rows = rows.join(told, [key, seq], "left")
    halted = F.coalesce(F.max("_halt").over(past), F.lit(False))
    return rows.select(key, seq, F.last("_m", ignorenulls=True).over(past).alias("mean"), halted.alias("halted"))


def accepts(certain: Column, length: Column, attempt: Column, threshold: float = 0.7) -> Column:
    return ((certain >= threshold) & (length >= 100)) | (length >= 500) | (attempt >= 3)


def probe_depth(entropy: Column, text: Column, lex: Lexicon = DEFAULT) -> Column:
    """deep, quick or none by a probe's answer: hedges first, then its entropy; without one (null or 0) by evasive answers."""
    by_text, silent = F.when(F.lower(text).rlike(lex.hedges), "deep"), entropy.isNull() | (entropy == 0)
    evasive = (F.length(text) > 20) & ((F.length(_strip(text)) < 80) | F.lower(text).rlike(lex.cutoff))
    return by_text.when(entropy > 0.6, "deep").when(entropy > 0.35, "quick").when(silent & evasive, "quick").otherwise("none")


def steps(c: Column, route: Column | None = None, most: int = 10) -> Column:
    """Steps of an answer by the first strategy that finds enough: numbered lines, headed sections, long bullets, code blocks
    (of the code route), paragraphs, else sentences.  Numbers and labels are kept."""

    def found(pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), _strip)

    numbered = found(r"(?:^|\n)\s*([0-9]+[.)]\s*[^\n]+)")
    headers, sections = found(r"(?:^|\n)(#{1,4}\s+[^\n]+)"), F.split(c, r"\n#{1,4}\s+")
    headed = F.transform(F.slice(sections, 2, F.greatest(F.size(sections), F.lit(1))), lambda x, i: F.concat(F.get(headers, F.least(i, F.size(headers) - 1)), F.lit(": "), F.substring(_strip(x), 1, 300)))
    bullets = F.transform(found(r"(?:^|\n)\s*[-*]\s+([^\n]{20,})"), lambda x: F.substring(x, 1, 300))
    blocks = F.transform(F.split(c, r"```[\w]*\n|```\n?"), lambda x, i: F.struct(_strip(x).alias("t"), F.when(i % 2 == 1, "Code: ").otherwise("Explanation: ").alias("label")))
    blocks = F.transform(F.filter(blocks, lambda b: F.length(b["t"]) > 30), lambda b: F.concat(b["label"], F.substring(b["t"], 1, 500)))
    paragraphs = F.filter(F.transform(F.split(c, "\n\n"), _strip), lambda x: F.length(x) > 30)
    sentences = F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda x: F.length(x) > 20)
    of_code = F.lit(False) if route is None else F.coalesce(route == "code", F.lit(False))
    chosen = F.coalesce(
        F.when(F.size(numbered) >= 2, numbered), F.when((F.size(headers) >= 2) & (F.size(headed) >= 2), headed), F.when(F.size(bullets) >= 3, bullets),
        F.when(of_code & (F.size(blocks) >= 2), blocks), F.when(F.size(paragraphs) >= 2, paragraphs), sentences,
    )
    return F.slice(chosen, 1, most)


def step_labels(c: Column) -> Column:
    """1 or 0 for each verdict on a step: boxed ones, else ``Step n is right``, else check marks."""

    def told(pattern: str, good: list[str]) -> Column:
        return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda m: F.lower(m).isin(*good).cast("int"))

    boxed = told(r"(?i)\\boxed\{(correct|incorrect)\}", ["correct"])
    said = told(r"(?i)step\s*[0-9]+\s*(?:is\s+|:\s*)(correct|incorrect|right|wrong)", ["correct", "right"])
    marks = told("(✓|✗|✔|✘|☑|☒)", ["✓", "✔", "☑"])
    return F.when(F.size(boxed) > 0, boxed).when(F.size(said) > 0, said).otherwise(marks)


def yes_share(tokens: Column) -> Column:
    """P(yes) at the last token whose alternatives hold both yes and no: yes / (yes + no); null without such."""

    def first(t: Column, *words: str) -> Column:
        return F.get(F.filter(t, lambda x: x["token"].isin(*words)), F.lit(0))["logprob"]

    pairs = F.transform(tokens, lambda t: F.struct(first(t, " Yes", "Yes", " yes", "yes", " YES").alias("y"), first(t, " No", "No", " no", "no", " NO").alias("n")))
    told = F.filter(pairs, lambda s: s["y"].isNotNull() & s["n"].isNotNull())
    last = F.get(told, F.size(told) - 1)
    return F.exp(last["y"]) / (F.exp(last["y"]) + F.exp(last["n"]))


def step_score(tokens: Column, labels: Column, answer: Column) -> Column:
    """A verifier's score: P(yes), else the share of good steps, else what the answer says, else 0.5."""
    share = F.when(F.size(labels) > 0, F.aggregate(labels, F.lit(0), lambda a, x: a + x) / F.size(labels))
    said = F.when(answer.rlike(r"(?i)\byes\b"), 0.9).when(answer.rlike(r"(?i)\bno\b"), 0.1).otherwise(0.5)
    return F.coalesce(yes_share(tokens), share, said)


def five_from_unit(score: Column) -> Column:
    """1 to 5 of a score in 0..1; 3 where there is none (below 0)."""
    return F.when(score < 0, 3).when(score >= 0.9, 5).when(score >= 0.7, 4).when(score >= 0.5, 3).when(score >= 0.3, 2).otherwise(1)


def word_set(c: Column) -> Column:
    """Distinct lower-cased words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))


def candidate_score(query: Column, answer: Column) -> Column:
    """0 to 1 by length, structure (list items, headings, references) and shared words; 0 for an empty answer."""
    n = F.length(answer)
    length = F.when(n > 100, F.least(F.lit(0.3), 0.1 + 0.2 * F.least(n / 2000, F.lit(1.0)))).otherwise(0.0)
    shape = [F.least(F.regexp_count(answer, F.lit(p)), F.lit(5)) for p in (r"(?m)^\s*[-*0-9]+[.)]\s", r"(?m)^#+\s", r"\[[^\n]*?\]")]
    asked = word_set(query)
    shared = F.when(F.size(asked) > 0, 0.4 * F.size(F.array_intersect(asked, word_set(answer))) / F.size(asked)).otherwise(0.0)
    return F.when(n == 0, 0.0).otherwise(F.round(length + F.least(F.lit(0.3), 0.03 * (shape[0] + shape[1] + shape[2])) + shared, 3))


def keyword_overlap(reference: Column, answer: Column) -> Column:
    """Share of the reference's words that the answer has, halved where their lengths differ by a factor of 3 / 0.3 or more."""
    ref, got = word_set(reference), word_set(answer)
    ratio = F.length(answer) / F.greatest(F.length(reference), F.lit(1))
    return F.when(F.size(got) == 0, 0.0).otherwise(F.size(F.array_intersect(ref, got)) / F.greatest(F.size(ref), F.lit(1)) * F.when((ratio > 0.3) & (ratio < 3), 1.0).otherwise(0.5))


def tool_reward(c: Column) -> Column:
    """1 where an object has a name and an object of arguments, 0 where there are only others, 0.5 without any."""
    objects = F.regexp_extract_all(c, F.lit(r"(\{(?:[^{}]|\{[^{}]*\})*\})"), F.lit(1))
    good = F.exists(objects, lambda o: (F.length(F.coalesce(F.get_json_object(o, "$.name"), F.lit(""))) > 0) & F.coalesce(F.get_json_object(o, "$.arguments"), F.lit("")).startswith("{"))
    return F.when(F.size(objects) == 0, 0.5).when(good, 1.0).otherwise(0.0)


def unit_reward(score: Column) -> Column:
    return F.when(score.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (score - 1) / 4)))


def parsed_score(c: Column) -> Column:
    """``score`` of the outermost object, clamped to 1..5, 3 where it has none; without a readable object the first lone digit 1 to 5; else 3."""
    obj = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    told = F.get_json_object(obj, "$.score")
    number = F.when(told.isNull() & F.get_json_object(obj, "$").isNotNull(), 3).otherwise(told.try_cast("double").cast("int"))
    digit = F.nullif(F.regexp_extract(c, "(?:^|[^0-9])([1-5])(?:[^0-9]|$)", 1), F.lit("")).cast("int")
    return F.coalesce(F.when(number.isNotNull(), F.least(F.lit(5), F.greatest(F.lit(1), number))), digit, F.lit(3))


def first_digit(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, "([1-5])", 1), F.lit("")).cast("int")


def expanded_queries(query: Column, answer: Column, n: int = 3) -> Column:
    """The query, then at most n others of the first JSON array in a model's answer."""
    told = F.from_json(F.regexp_extract(answer, r"(?s)(\[.*?\])", 1), "array<string>")
    others = F.filter(F.coalesce(told, F.array().cast("array<string>")), lambda x: (F.trim(x) != "") & (x != query))
    return F.slice(F.array_prepend(others, query), 1, n + 1)


def few_shot_allowed(c: Column, lex: Lexicon = DEFAULT) -> Column:
    """Examples are for open questions; asked for facts to recall, they mislead."""
    return ~F.lower(c).rlike(lex.recall)


def enrichment_plan(c: Column, route: Column, web: Column, rag: Column | None = None, unsure: Column | None = None, lex: Lexicon = DEFAULT) -> Column:
    """Names of the tools to run, in order.  web, rag: the route's settings, null where it has none; unsure: what a confidence probe would say.

    A search that the route forbids is only made for questions about recent things of which a probe is unsure.
    """
    low, unsure = F.lower(c), F.lit(True) if unsure is None else unsure
    deep = low.rlike(lex.deep_research) & F.coalesce(route == "research", F.lit(False))
    asked = F.coalesce(~web, F.lit(False)) & low.rlike(lex.recent) & (F.length(c) >= 40)
    probe = asked & unsure
    search = F.coalesce(web, F.coalesce(route == "research", F.lit(False)) | low.rlike(lex.searchable)) | probe
    known = F.coalesce(route.isin(*lex.knowledge_routes), F.lit(False))
    knowledge = known if rag is None else F.coalesce(rag, known)
    from .text import csv_path, ioc

    return F.array_compact(F.array(
        F.when(probe, "probe"), F.when(csv_path(c, lex) != "", "csv"), F.when(ioc(c, lex)["kind"].isNotNull(), "ioc"), F.when(deep, "deep"), F.when(knowledge & ~deep, "rag"), F.when(search & ~deep, "web"),
    ))


def with_example(turns: Column, example: Column) -> Column:
    """``turns`` (structs with role) with two example turns before the last user turn."""
    users = F.filter(F.transform(turns, lambda t, i: F.when(t["role"] == "user", i + 1)), lambda i: i.isNotNull())
    at = F.coalesce(F.array_max(users), F.size(turns) + 1)
    return F.concat(F.slice(turns, F.lit(1), at - 1), example, F.slice(turns, at, F.size(turns) + 1))


def edited_lines(c: Column, op: Column, anchor: Column, line: Column) -> Column:
    """add after the first line with the anchor, remove all lines with it, or replace its first occurrence.

    An empty or null anchor names no line: nothing is removed or replaced by it.  What is added by an anchor that the text lacks goes to the end,
    in a line of its own after the text without white space at its end.
    """
    anchor = F.coalesce(anchor, F.lit(""))
    held = (anchor != "") & F.contains(c, anchor)
    lines = F.split(c, "\n")
    at = F.array_position(F.transform(lines, lambda x: F.contains(x, anchor)), True).cast("int")  # 0: the anchor spans lines
    within = F.when(at == 0, c).otherwise(F.array_join(F.concat(F.slice(lines, F.lit(1), at), F.array(line), F.slice(lines, at + 1, F.size(lines))), "\n"))
    added = F.when(held, within).otherwise(F.concat(F.rtrim(c, F.lit(" \t\n\r\x0b\x0c")), F.lit("\n"), line, F.lit("\n")))
    kept = F.when(held, F.array_join(F.filter(lines, lambda x: ~F.contains(x, anchor)), "\n")).otherwise(c)
    where = F.instr(c, anchor)
    swapped = F.when(held, F.concat(F.substring(c, F.lit(1), where - 1), line, F.substring(c, where + F.length(anchor), F.length(c)))).otherwise(c)
    return F.when(op == "add", added).when(op == "remove", kept).when(op == "replace", swapped).otherwise(c)


def patch_allowed(adds: Column, touched: Column, removes: Column, lines: Column, protected: list[str], most_adds: int = 3, most_removes: int = 2, most_lines: int = 100) -> Column:
    """Whether a patch passes: numbers of added and removed lines, none of the protected rules (any case) in what it removes or
    replaces (``touched``, an array), and the file within ``most_lines`` afterwards."""
    hit = F.exists(touched, lambda x: F.lit(False) if not protected else F.array_contains(F.array(*[F.contains(F.lower(x), F.lit(p.lower())) for p in protected]), True))
    return (adds <= most_adds) & (removes <= most_removes) & ~hit & (lines + adds - removes <= most_lines)


def rule_lines(c: Column) -> Column:
    """{rule, hash} of the rules of a text: numbered or bold lines and headings of over 10 characters, cut to 200."""
    lines = F.transform(F.split(c, "\n"), _strip)
    rules = F.filter(lines, lambda x: x.rlike(r"^(?:[0-9]+[.]?\s+[*][*]|[*][*][A-Z]|##\s+)") & (F.length(x) > 10))
    return F.transform(F.transform(rules, lambda x: F.substring(x, 1, 200)), lambda x: F.struct(x.alias("rule"), F.substring(F.sha2(x, 256), 1, 16).alias("hash")))
