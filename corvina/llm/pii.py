r"""Personal data by bootstrapped contextual extraction, DataFrame operations only.

Base kinds are found by patterns (leftmost, not overlapping, per kind); places come from the lengths of what lies between the matches.
Their matches are seeds, and so are credentials of public formats (kind ``secret``).  Every seed, and every other run of
characters without white space that holds a digit or an at sign and LETTERS letters or digits or more (a candidate), is an
instance.  Three lexical patterns are induced by an instance:

- its context: the word before it, with the word before that where it is but symbols, and what opens it, a bracket, quote or key
  such as ``mail=``, split off seeds and candidates alike;
- the key alone, where it has a name;
- its spelling, where it mixes letters and digits: the classes of its characters, and whether it is LONG.

The pattern-instance graph is scored in rounds until no confidence changes, ROUNDS at most, and in none if no candidate meets a pattern that
has seeds: an instance's score in a kind is what its patterns' confidences leave no
doubt of (noisy or), 1 for seeds.  A pattern's confidence is the mean over its distinct instances (and one doubtful one more) of 1
for seeds and, for others, of the score that the instance has by its *other* patterns, so that contexts, keys and
spellings teach each other.  A pattern counts once seeds and such scores sum to SUPPORT.  A context of mere prose is held to more:
there only what other patterns hold CONFIDENT counts fully and towards SUPPORT, the rest by half its score.
Candidates that score CONFIDENT or more, under a context or key of half that confidence, are new spans, unless
they overlap a base span or an earlier new one.  What has the form of an address or card and fails its check is never new.

Groupings combine map-side, so a word before a third of all instances is one row per task.  Only texts with a digit or an
at sign run the patterns, which are written so that no text makes them backtrack more than linearly.  No context or instance is
cut; a row is as long as the words it names.

Nulls and texts without matches give zero counts and empty strings.  Rows that repeat a doc_id give one row for each distinct
text.  An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Rounds of scoring at most; instances that a pattern needs; score of a new span; letters or digits of a candidate; characters of a long one.
#: Two instances make a pattern in a table of any size: how far it is believed is its smoothed share of seeds, which two alone leave low.
ROUNDS, SUPPORT, CONFIDENT, LETTERS, LONG = 8, 2, 0.9, 6, 16

KINDS = ["email", "ip", "card", "phone", "secret"]
BASE, SECRET, CANDIDATE = 4, 4, 5
# The base patterns.  Possessive repeats and the look-behinds (a match begins where a run begins, or where the
# last match ended) change no match; they keep long runs linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Public formats of credentials.
CREDENTIALS = [
    r"A[KS]IA[A-Z0-9]{16}", r"gh[pousr]_[A-Za-z0-9]{36,}", r"xox[abprs]-[A-Za-z0-9-]{10,}", r"AIza[A-Za-z0-9_-]{35}", r"sk_live_[A-Za-z0-9]{24,}",
    r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
]
#: A digest-like value is a seed where it is given to a name that tells so.
DIGEST, NAMED = r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})", r"(?:token|secret|api[_-]?key|access[_-]?key)[\x22' ]*[=:][\x22' ]*"

# What opens an instance and belongs to its pattern: brackets, quotes and a key (mail=, token:").
OPENING = r"[(\[{<\"']*+(?:[A-Za-z_]++[=:][\"']?)?"
# What closes one: signs at its end, or the quote that opened it and all behind that.
CLOSING = "!\"#$%&'()*,-./:;<>?@[\\]^`{|}~"
BLANKS = "\t\n\x0b\x0c\r"


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``value``, which is so computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _last(t: str) -> str:
    return f"substring_index({t}, ' ', -1)"


def _matches(kind: int, guard: str, pattern: str) -> str:
    """SQL: structs of the matches of a pattern in ``text``: its key and the word (or word and symbols) before that."""
    both = f"struct(split(text, {_lit(pattern)}, -1) as g, regexp_extract_all(text, {_lit(pattern)}, 0) as m)"
    # the match before may hold the word before this one
    before = f"translate(concat(coalesce(get(x.m, i - 1), ''), x.g[i]), '{BLANKS}', '{' ' * len(BLANKS)}')"
    if kind == CANDIDATE:
        key = f"regexp_extract(m, {_lit('^' + OPENING)}, 0)"
        rest = "rtrim(t)"
    else:  # what stands between the last white space and the match, where it is an opening
        key = f"if({_last('t')} rlike {_lit('^(?:' + OPENING + ')$')}, {_last('t')}, '')"
        rest = "rtrim(left(t, length(t) - length(k)))"
    rare = f"not w rlike {_lit(r'[\p{L}\p{N}]')} and w != ''"
    two = f"if({rare}, concat_ws(' ', {_last('rtrim(left(r, length(r) - length(w)))')}, w), w)"
    word = _let("r", rest, _let("w", _last("r"), two))
    row = _let("t", before, _let("k", key, f"struct({kind} as kind, i as i, m as m, length(x.g[i]) as gap, k as key, lower({word}) as word)"))
    none = "cast(array() as array<struct<kind:int,i:int,m:string,gap:int,key:string,word:string>>)"
    return f"if({guard}, transform(array({both}), x -> transform(x.m, (m, i) -> {row}))[0], {none})"


def _luhn(m: Column) -> Column:
    digits = F.reverse(F.regexp_replace(m, "[^0-9]", ""))
    each = F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.length(digits).between(12, 19) & (F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0)


def _valid(kind: Column, m: Column) -> Column:
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    n = F.length(F.regexp_replace(m, "[^0-9]", ""))
    return F.when(kind == 1, m.rlike(rf"^{part}\.{part}\.{part}\.{part}$")).when(kind == 2, _luhn(m)).when(kind == 3, n.between(9, 15)).otherwise(True)


def spots(docs: DataFrame, letters: int = LETTERS, hide: Column | None = None) -> DataFrame:
    """(doc_id, own, kind, start, end, m, word, key): valid base matches, secrets, candidates, and one row of kind -1 for each document.

    hide: a condition on ``m``; secrets that meet it are candidates like others, marked ``hidden``, to measure what patterns find.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("own"), text.alias("text"))
    digit = "(text rlike '[0-9]')"
    found = [
        "array(struct(-1 as kind, 0 as i, '' as m, 0 as gap, '' as key, '' as word))",
        _matches(0, "contains(text, '@')", EMAIL), _matches(1, digit, IP), _matches(2, digit, CARD), _matches(3, "contains(text, '+')", PHONE),
        _matches(CANDIDATE, f"({digit} or contains(text, '@'))", r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"),
    ]
    rows = rows.select("doc_id", "own", F.expr(f"inline(concat({', '.join(found)}))"))
    rows = rows.dropDuplicates(["doc_id", "own", "kind", "i"])  # combined map-side: rows repeated by the million are one a task
    w = Window.partitionBy("doc_id", "own", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.length("m")).over(w)).withColumn("start", F.col("end") - F.length("m")).filter(_valid(F.col("kind"), F.col("m")))
    open_ = F.col("kind") == CANDIDATE
    value, quote = F.substring("m", F.length("key") + 1, F.length("m")), F.right("key", F.lit(1))
    bare = F.rtrim(F.when(quote.isin('"', "'"), F.call_function("substring_index", value, quote, F.lit(1))).otherwise(value), F.lit(CLOSING))
    rows = rows.withColumn("start", F.when(open_, F.col("start") + F.length("key")).otherwise(F.col("start")))
    rows = rows.withColumn("m", F.when(open_, bare).otherwise(F.col("m"))).withColumn("end", F.col("start") + F.length("m"))
    rows = rows.filter(~open_ | (F.length(F.regexp_replace("m", r"[^\p{L}\p{N}]", "")) >= letters))
    told = F.concat_ws(" ", "word", F.lower("key"))
    secret = F.col("m").rlike(f"^(?:{'|'.join(CREDENTIALS)})$") | (F.col("m").rlike(f"^{DIGEST}$") & told.rlike(f"{NAMED}$"))
    seed = open_ & secret if hide is None else open_ & secret & ~hide
    told = ["doc_id", "own", F.when(seed, SECRET).otherwise(F.col("kind")).alias("kind"), "start", "end", "m", "word", F.lower("key").alias("key")]
    return rows.select(*told) if hide is None else rows.select(*told, (open_ & secret & hide).alias("hidden"))


def _spelling(m: Column) -> Column:
    """Classes of the characters, null unless letters and digits are mixed: a short string that many instances share."""
    signs = F.array_join(F.array_sort(F.array_distinct(F.split(F.regexp_replace(m, r"[\p{L}\p{N}]+", ""), ""))), "")
    classes = F.concat(*[F.when(m.rlike(p), F.lit(n)).otherwise("") for n, p in (("A", "[A-Z]"), ("a", "[a-z]"), ("x", r"[\p{L}&&[^A-Za-z]]"))], signs)
    mixed = m.rlike("[0-9]") & m.rlike(r"\p{L}")
    return F.when(mixed, F.concat(F.when(m.rlike("^[0-9a-f]+$"), "hex").otherwise(classes), F.when(F.length(m) >= LONG, "+").otherwise("")))


def graph(rows: DataFrame) -> DataFrame:
    """Distinct edges (pattern, form, m, kind) of ``spots``; form: context (of prose), opened (a context with an opening), key or spelling."""
    opened = F.when(F.col("key") == "", "context").otherwise("opened")
    induced = F.array(
        F.struct(opened.alias("form"), F.concat_ws(" ", "word", "key").alias("pattern")),
        F.struct(F.lit("key").alias("form"), F.when(F.col("key").rlike("[a-z_][=:]"), F.col("key")).alias("pattern")),
        F.struct(F.lit("spelling").alias("form"), _spelling(F.col("m")).alias("pattern")),
    )
    edges = rows.filter("kind >= 0").select("m", "kind", F.inline(induced)).filter("pattern is not null")
    return edges.groupBy("form", "pattern", "m").agg(F.min("kind").alias("kind"))


def learned(rows: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """(word, key, m, kind) of candidates that the patterns of a kind vouch for; rows as ``spots`` gives them."""
    edges = saved(graph(rows), "edges")
    node, kinds = ["form", "pattern"], range(len(KINDS))
    sizes = saved(edges.groupBy(*node).agg(F.count("*").alias("n"), F.array(*[F.count_if(F.col("kind") == k) for k in kinds]).alias("seeds")), "sizes")
    failed = F.col("m").rlike(r"^[0-9]+(?:\.[0-9]+){3}$") | F.regexp_replace("m", r"[\x20-]", "").rlike("^[0-9]{12,19}$")
    open_ = edges.filter((F.col("kind") == CANDIDATE) & ~failed).select(*node, "m")
    seeded = sizes.select(*node, "n", F.posexplode("seeds").alias("of", "seeds"))
    patterns = saved(seeded.filter(F.col("seeds") >= support).select(*node, "of", (F.col("seeds") / (F.col("n") + 1)).alias("confidence")), "patterns")
    if open_.join(patterns.select(*node).distinct(), node, "left_semi").isEmpty():
        return rows.sparkSession.createDataFrame([], "form string, pattern string, m string, of int, score double")
    before = None
    for _ in range(rounds):
        doubts = patterns.select(*node, "of", F.log1p(-F.least(F.col("confidence"), F.lit(0.999))).alias("doubt"))
        scores = saved(open_.join(doubts, node).groupBy("m", "of").agg(F.sum("doubt").alias("doubts")).withColumn("score", 1 - F.exp("doubts")), "scores")
        now = _digest(patterns)
        if now == before:
            break
        before = now
        held = open_.join(scores, "m").join(doubts, [*node, "of"], "left").withColumn("others", 1 - F.exp(F.col("doubts") - F.coalesce("doubt", F.lit(0.0))))
        prose, sure = F.col("form") == "context", F.col("others") >= confident
        counted = F.sum(F.when(prose & ~sure, 0.0).otherwise(F.when(prose, 1.0).otherwise(F.col("others")))).alias("counted")
        sums = held.groupBy(*node, "of").agg(counted, F.sum(F.when(prose & ~sure, F.col("score") / 2).otherwise(F.col("others"))).alias("mass"))
        every = seeded.join(sums, [*node, "of"], "left").filter(F.col("seeds") + F.coalesce("counted", F.lit(0.0)) >= support)
        patterns = saved(every.select(*node, "of", ((F.col("seeds") + F.coalesce("mass", F.lit(0.0))) / (F.col("n") + 1)).alias("confidence")), "patterns")
    vouched = open_.filter("form != 'spelling'").join(patterns.filter(F.col("confidence") >= confident / 2), node).select("form", "pattern", "m", "of")
    return vouched.join(scores.filter(F.col("score") >= confident), ["m", "of"]).groupBy("form", "pattern", "m").agg(F.max_by("of", F.struct("score", -F.col("of"))).alias("of"), F.max("score").alias("score"))


def _digest(patterns: DataFrame) -> tuple:
    """One row that differs where a pattern, or its confidence to four places, does."""
    told = F.xxhash64("form", "pattern", "of", F.round("confidence", 4))
    return tuple(patterns.agg(F.count("*"), F.bit_xor(told), F.sum(F.pmod(told, F.lit(1 << 20)))).first())


def discovered(rows: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, own, start, end, kind) of the candidates of ``rows`` that ``new`` (as ``learned`` gives it) vouches for."""
    some = rows.filter(F.col("kind") == CANDIDATE)
    by = [
        some.withColumn("pattern", F.concat_ws(" ", "word", "key")).withColumn("form", F.when(F.col("key") == "", "context").otherwise("opened")),
        some.filter("key != ''").withColumn("pattern", F.col("key")).withColumn("form", F.lit("key")),
    ]
    found = by[0].unionByName(by[1]).join(new, ["form", "pattern", "m"])
    return found.groupBy("doc_id", "own", "start", "end").agg(F.max_by("of", F.struct("score", -F.col("of"))).alias("kind"))


def hidden_recall(docs: DataFrame) -> DataFrame:
    """One row: of the credentials whose digest begins with 0 to 7, hidden from the seeds, the values and places, and how many of each the patterns find again."""
    rows = saved(spots(docs, hide=F.substring(F.md5("m"), 1, 1) < "8"), "half-spots")
    found = discovered(rows, saved(learned(rows), "relearned")).withColumn("found", F.lit(True))
    places = rows.filter("hidden").join(found, ["doc_id", "own", "start", "end"], "left").groupBy("m").agg(F.count("*").alias("places"), F.count("found").alias("found"))
    counts = [F.count("*").alias("hidden_values"), F.count_if(F.col("found") > 0).alias("found_values"), F.coalesce(F.sum("places"), F.lit(0)).alias("hidden_places"), F.coalesce(F.sum("found"), F.lit(0)).alias("found_places")]
    return places.agg(*counts)


def personal_data(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, text): doc_id, base and added, arrays of (start, kind, end) in order; kind indexes KINDS."""
    rows = saved(spots(docs), "spots")
    new = saved(learned(rows), "learned")
    known = rows.filter(f"kind < {CANDIDATE}").select("doc_id", "own", "kind", "start", "end", (F.col("kind") == SECRET).alias("new"))
    if not new.isEmpty():
        known = known.unionByName(discovered(rows, new).select("doc_id", "own", "kind", "start", "end", F.lit(True).alias("new")))
    # overlap with a base span: with one that begins before, by the furthest end so far, or with the next
    near = Window.partitionBy("doc_id", "own").orderBy("start", "kind")
    ends = F.max(F.when((F.col("kind") >= 0) & ~F.col("new"), F.col("end"))).over(near.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.min(F.when((F.col("kind") >= 0) & ~F.col("new"), F.col("start"))).over(near.rowsBetween(1, Window.unboundedFollowing))
    clear = (F.coalesce(ends, F.lit(0)) <= F.col("start")) & (F.coalesce(begins, F.col("end")) >= F.col("end"))
    known = known.withColumn("clear", clear)
    span = F.struct("start", "kind", "end")
    return known.groupBy("doc_id", "own").agg(
        F.array_sort(F.collect_list(F.when((F.col("kind") >= 0) & ~F.col("new"), span))).alias("base"),
        F.array_sort(F.collect_list(F.when(F.col("new") & F.col("clear"), span))).alias("added"),
    ).select("doc_id", "base", "added")


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
