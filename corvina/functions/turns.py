"""Chat turns, gates before and after a model call, and builders of its texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicons import DEFAULT, Lexicon

INSTRUCTIONS = {"code": "Answer with code.", "research": "Cite the sources.", "kine": "Answer in short steps."}
INSTRUCTION = "Use the context."


def last_user(turns: Column) -> Column:
    """Text of the last user turn of an array of {role, parts: array<{type, text}>}; parts are joined by spaces."""
    users = F.filter(turns, lambda t: t["role"] == "user")
    last = F.get(users, F.size(users) - 1)
    return F.array_join(F.transform(F.filter(last["parts"], lambda p: p["type"] == "text"), lambda p: p["text"]), " ")


def has_image(turns: Column) -> Column:
    return F.exists(turns, lambda t: F.exists(t["parts"], lambda p: p["type"] == "image_url"))


def should_score(route: Column, answer: Column, lex: Lexicon = DEFAULT) -> Column:
    return route.isin(*lex.scored_routes) & (F.length(answer) >= 100)


def skips_enrichment(text: Column, tools: Column, thinking: Column) -> Column:
    return (F.length(text) < 30) | tools | ~thinking


def triggered_tools(text: Column, allowed: Column, lex: Lexicon = DEFAULT) -> Column:
    """Allowed tools of which a keyword occurs in the lower-cased text."""
    low = F.lower(text)
    hit = {t: F.array_contains(F.array(*[F.contains(low, F.lit(w)) for w in words]), True) for t, words in lex.tools}
    return F.array_compact(F.array(*[F.when(F.array_contains(allowed, t) & h, t) for t, h in hit.items()]))


def request_flags(text: Column, lex: Lexicon = DEFAULT) -> Column:
    """{code, complex, searchable, deep, temporal, ingest} of a request."""
    low = F.lower(text)
    temporal = F.array_contains(F.array(*[low.rlike(p) for p in lex.temporal]), True)
    return F.struct(
        low.rlike(lex.code_request).alias("code"), low.rlike(lex.complex_request).alias("complex"), low.rlike(lex.searchable).alias("searchable"),
        low.rlike(lex.deep_research).alias("deep"), temporal.alias("temporal"), ingest_url(text, lex).alias("ingest"),
    )


def training_domain(text: Column, lex: Lexicon = DEFAULT) -> Column:
    """The domain of which most keywords occur, the first on a tie; general without any."""
    low = F.lower(text)
    counts = [F.struct(sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)).alias("n"), F.lit(-i).alias("order"), F.lit(d).alias("d")) for i, (d, words) in enumerate(lex.training_domains)]
    best = F.array_max(F.array(*counts))
    return F.when(best["n"] > 0, best["d"]).otherwise("general")


def combined_reward(domain: Column, tool: Column, executed: Column, stepwise: Column) -> Column:
    """The reward that a domain is judged by: running its code, the form of its tool call, else a verifier's score (1 to 5).

    executed and stepwise are boundary columns; 0.5 where they are null.
    """
    unit = F.when(stepwise.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (stepwise - 1) / 4)))
    return F.when(domain == "code", F.coalesce(executed, F.lit(0.5))).when(domain == "tools", tool).otherwise(F.coalesce(unit, F.lit(0.5)))


def prompt_with_context(text: Column, blocks: Column, route: Column) -> Column:
    """Blocks joined by rules, the route's instruction, then the question; the bare question without blocks."""
    table = F.create_map(*[F.lit(x) for pair in INSTRUCTIONS.items() for x in pair])
    told = F.coalesce(F.try_element_at(table, route), F.lit(INSTRUCTION))
    return F.when(F.size(blocks) == 0, text).otherwise(F.concat(F.array_join(blocks, "\n---\n"), F.lit("\n\n"), told, F.lit("\n\n"), text))


def accounting(blocks: Column) -> Column:
    """{tools_used, chars} of structs (tool, text)."""
    chars = F.aggregate(F.transform(blocks, lambda b: F.length(b["text"]).cast("long")), F.lit(0).cast("long"), lambda a, n: a + n)
    return F.struct(F.transform(blocks, lambda b: b["tool"]).alias("tools_used"), chars.alias("chars"))


def preference(prompt: Column, chosen: Column, rejected: Column, iteration: int) -> Column:
    return F.struct(prompt.alias("prompt"), chosen.alias("chosen"), rejected.alias("rejected"), F.substring(F.sha2(prompt, 256), 1, 16).alias("prompt_hash"), F.lit(iteration).alias("iteration"))


def step_prompt(steps: Column) -> Column:
    return F.array_join(F.transform(steps, lambda s, i: F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(": "), s)), "\n")


def debate_prompt(question: Column, first: Column, second: Column) -> Column:
    return F.format_string("Question: %s\n\nFirst view:\n%s\n\nSecond view:\n%s\n\nName what is wrong in each.", question, first, second)


def score_action(score: Column) -> Column:
    return F.when(score >= 4, "store").when(score <= 2, "flag").otherwise("none")


def summary(c: Column) -> Column:
    """{title, body, bullets} of a model's summary: the first line that is not blank, other lines, listed lines as they are.

    Without other lines the body is the whole text.
    """
    strip = lambda x: F.btrim(x, F.lit(" \t\n\r"))
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")
    # a line of mere # is no title: the next one is looked at
    at = F.array_position(F.transform(lines, lambda x: strip(F.ltrim(x, F.lit("#"))) != ""), True).cast("int")
    rest = F.when(at > 0, F.slice(lines, at + 1, F.greatest(F.size(lines), F.lit(1)))).otherwise(F.array().cast("array<string>"))
    listed = lambda x: x.rlike("^[-*•] ")
    body = F.filter(rest, lambda x: ~listed(x))
    return F.struct(
        F.coalesce(strip(F.ltrim(F.get(lines, at - 1), F.lit("#"))), F.lit("")).alias("title"),
        F.when(F.size(body) > 0, F.array_join(body, "\n")).otherwise(c).alias("body"), F.filter(rest, listed).alias("bullets"),
    )


def ingest_url(c: Column, lex: Lexicon = DEFAULT) -> Column:
    """The address of an ingest command, else empty."""
    return F.regexp_extract(c, lex.ingest, 1)
