"""Benchmark decontamination by winnowing, DataFrame operations only.

Words are runs of 0-9, a-z (A-Z lower-cased) and anything from U+0080 on.  Of every GRAM-word hash window a text keeps the
least in each run of SPAN - GRAM + 1 windows, so a test span of SPAN words leaves at least one fingerprint that is the
same on both sides.  Test fingerprints are few: they are counted, and broadcast up to BROADCAST rows, else shuffled.  Each
hit is extended: the words around it are compared one by one with the item's, and only equal spans of SPAN words count,
so hashes never decide.  Items of fewer than SPAN words are a single window: of GRAM words or more they are winnowed in a
run of their own length, shorter ones are matched by the hash of all their words, for each length that occurs (9 at most).
A document is cut into words and its windows are hashed once for all lengths.

Nulls and texts without words have no words and no hits.  Rows that repeat a doc_id give one row for each distinct text.
Items that repeat, or share windows, all count.  Empty tables give empty or clean results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

SPAN, GRAM = 10, 5
#: A test fingerprint with its words takes under 400 bytes, so this is a bound of about 100 MB.
BROADCAST = 250_000
SELF = -(1 << 62)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"



def _let(name: str, value: str, body: str) -> str:
    """SQL: an array of one, ``body`` with ``name`` bound to ``value``, which is so computed once."""
    return f"transform(array({value}), {name} -> {body})"


def _marks(span: int) -> str:
    """SQL: (span, q, fp) of the windows of ``w`` that spans of ``span`` words are known by; ``g`` holds hashes of its GRAM-word windows."""
    none, width = "cast(array() as array<bigint>)", min(span, GRAM)
    if width == GRAM:
        grams = f"if(size(w) >= {span}, g, {none})"
    else:
        grams = f"if(size(w) >= {span}, transform(sequence(0, size(w) - {width}), i -> xxhash64({', '.join(f'w[i + {j}]' for j in range(width))})), {none})"
    run, mark = span - width + 1, f"struct({span} as span, i as q, x as fp)"
    if run == 1:
        return f"transform({grams}, (x, i) -> {mark})"
    least = f"if(size(h) >= {run}, transform(sequence(0, size(h) - {run}), i -> least({', '.join(f'h[i + {j}]' for j in range(run))})), {none})"
    near = ", ".join(f"get(l, i - {j})" for j in range(run))
    return _let("h", grams, _let("l", least, f"filter(transform(h, (x, i) -> if(x = greatest({near}), {mark}, null)), s -> s is not null)") + "[0]") + "[0]"


def fingerprinted(rows: DataFrame, spans: list[int]) -> DataFrame:
    """Replaces ``text`` by ``w``, its words, and ``marks``: (span, q, fp), fingerprints by place for spans of each length.

    All of it is one generator, which the optimizer does not copy into what refers to its columns.
    """
    lowered = f"if(length(text) = octet_length(text), lower(text), translate(text, '{UPPER}', '{LOWER}'))"
    words = f"array_remove(split({lowered}, '{SEPARATORS}'), '')".replace("\\", "\\\\")
    grams = f"if(size(w) >= {GRAM}, transform(sequence(0, size(w) - {GRAM}), i -> xxhash64({', '.join(f'w[i + {j}]' for j in range(GRAM))})), cast(array() as array<bigint>))"
    marks = [_marks(s) for s in spans]
    every = f"concat({', '.join(marks)})" if len(marks) > 1 else marks[0]
    return rows.select(*[c for c in rows.columns if c != "text"], F.expr("inline(" + _let("w", words, _let("g", grams, f"struct(w as w, {every} as marks)") + "[0]") + ")"))


def _hits(docs: DataFrame, items: DataFrame, spans: list[int]) -> DataFrame:
    """(doc_id, own, n_words, p, item_id, starts, span): first words of spans that equal a test window; each document at least once.

    docs: doc_id, own, text; items: item_id, text.  SPAN is for items of SPAN words or more, another length for those of just as many.
    """
    back = f"(span - least(span, {GRAM}))"
    tests = fingerprinted(items, spans).select("item_id", F.col("w").alias("v"), F.inline("marks")).filter(f"if(span = {SPAN}, size(v) >= span, size(v) = span)")
    tests = tests.select("span", "fp", "item_id", F.expr(f"transform(filter(sequence(greatest(q - {back}, 0), q), s -> s + span <= size(v)), s -> struct(s - q as at, slice(v, s + 1, span) as words))").alias("spans"))
    small = tests.count() <= BROADCAST
    # A fingerprint of its own, met by one row without an item, stands for the document itself: one join gives hits and documents.
    itself = docs.sparkSession.range(1).select(F.lit(0).alias("span"), F.lit(SELF).alias("fp"), F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.expr("cast(array() as array<struct<at:int,words:array<string>>>)").alias("spans"))
    tests = tests.union(itself)
    near = F.expr(f"slice(w, greatest(p - {back}, 0) + 1, {back} + span)").alias("near")  # the words that a hit can extend over
    marked = fingerprinted(docs, spans)
    places = marked.select("doc_id", "own", "w", F.size("w").cast("long").alias("n_words"), F.inline(F.expr(f"array_insert(marks, 1, struct(0 as span, -1 as q, {SELF}L as fp))"))).withColumnRenamed("q", "p")
    if small:
        found = places.select("doc_id", "own", "n_words", "p", "span", "fp", near).join(F.broadcast(tests), ["span", "fp"])
    else:  # no words are carried through a shuffle of fingerprints; they are joined to what was found
        found = places.select("doc_id", "own", "n_words", "p", "span", "fp").join(tests, ["span", "fp"]).join(marked.select("doc_id", "own", "w"), ["doc_id", "own"]).withColumn("near", near)
    at = f"p + s.at - greatest(p - {back}, 0)"
    starts = F.expr(f"transform(filter(spans, s -> p + s.at >= 0 and slice(near, greatest({at}, 0) + 1, span) = s.words), s -> p + s.at)")
    return found.select("doc_id", "own", "n_words", "p", "item_id", starts.alias("starts"), "span").filter("p < 0 or size(starts) > 0")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document (doc_id, text) against items (item_id, text): doc_id, n_words, n_hit, item_ids (sorted as strings), contaminated, text_xxh."""
    text = F.coalesce("text", F.lit("")).alias("text")
    docs = docs.select("doc_id", F.xxhash64(text).alias("own"), text)
    items = items.select("item_id", text)
    sizes = fingerprinted(items, [SPAN]).select(F.size("w").alias("n")).filter(f"n between 1 and {SPAN - 1}").distinct()
    found = _hits(docs, items, [*sorted(r[0] for r in sizes.collect()), SPAN])  # 10 lengths at most
    rows = found.groupBy("doc_id", "own").agg(
        F.max("n_words").alias("n_words"),
        F.collect_set(F.when(F.size("starts") > 0, F.struct("starts", "span"))).alias("hit"),
        F.array_sort(F.collect_set(F.when(F.size("starts") > 0, F.col("item_id").cast("string")))).alias("item_ids"),
    )
    spans = "array_sort(array_distinct(flatten(transform(hit, h -> transform(h.starts, s -> struct(s as a, s + h.span as b))))))"
    covered = f"aggregate({spans}, struct(0 as n, 0 as e), (x, s) -> struct(x.n + greatest(0, s.b - greatest(x.e, s.a)) as n, greatest(x.e, s.b) as e), x -> cast(x.n as bigint))"
    rows = rows.withColumn("n_hit", F.when(F.size("hit") > 0, F.expr(covered)).otherwise(F.lit(0).cast("long")))
    return rows.select("doc_id", "n_words", "n_hit", "item_ids", (F.col("n_hit") > 0).alias("contaminated"), F.col("own").alias("text_xxh"))
