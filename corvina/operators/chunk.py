"""Chunkers: sequential folds over a text's parts, expressed as Catalyst aggregates, so rows stay in the JVM and independent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lexicons import DEFAULT, Lexicon


def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\r"))


def _pieces(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(c, pattern), _strip), lambda p: p != "")


def sentences(c: Column) -> Column:
    return F.split(F.regexp_replace(c, "([.!?])[ \\n\\t]+", "$1\u0001"), "\u0001")


def paragraph_chunks(c: Column, size: int = 512, overlap: int = 50, most: int = 30, separator: str = "\\n[ \\t]*\\n") -> Column:
    """Chunks of about ``size`` tokens of four characters.

    A part that would pass 1.2 sizes closes the chunk; the next begins with its last ``overlap`` tokens.  Paragraphs over
    1.5 sizes are taken sentence by sentence; within these a new chunk begins without overlap.
    """
    limit, tail = size * 1.2 * 4, overlap * 4
    # weight: what is asked of a part before it is taken; the first sentence of a long paragraph asks for all of it
    part = lambda s, carry, weight: F.struct(s.alias("t"), carry.alias("carry"), weight.alias("weight"))
    long_ = lambda p: F.transform(sentences(p), lambda s, i: part(s, i == 0, F.when(i == 0, F.length(p)).otherwise(F.length(s))))
    units = F.flatten(F.transform(_pieces(c, separator), lambda p: F.when(F.length(p) > size * 1.5 * 4, long_(p)).otherwise(F.array(part(p, F.lit(True), F.length(p))))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).cast("double").alias("n"))

    def add(s: Column, u: Column) -> Column:
        full = (s["n"] + u["weight"] > limit) & (s["cur"] != "")
        kept = F.when(u["carry"], F.right(s["cur"], F.lit(tail))).otherwise("")
        carried = F.when(kept != "", F.concat(kept, F.lit("\n\n"), u["t"])).otherwise(u["t"])
        return F.struct(
            F.when(full, F.array_append(s["done"], s["cur"])).otherwise(s["done"]).alias("done"),
            F.when(full, carried).when(s["cur"] == "", u["t"]).otherwise(F.concat(s["cur"], F.lit("\n\n"), u["t"])).alias("cur"),
            (F.when(full, F.length(kept)).otherwise(s["n"]) + F.length(u["t"])).cast("double").alias("n"),
        )

    return F.slice(F.aggregate(units, start, add, lambda s: F.when(s["cur"] != "", F.array_append(s["done"], s["cur"])).otherwise(s["done"])), 1, most)


def section_chunks(c: Column, size: int = 600, overlap: int = 100, least: int = 50, lex: Lexicon = DEFAULT) -> Column:
    """{section, text} of a markdown text: sections begin at ``##`` lines, details blocks go, parts fill chunks greedily.

    A text that says itself to be empty (``empty_notes``) has none.

    A chunk that a part would overfill is closed and its last ``overlap`` characters begin the next; the rest of a section
    is a chunk if it has more than ``least`` characters.
    """
    body = F.regexp_replace(c, "(?s)<details>[ \\n\\t]*<summary>.*?</summary>.*?</details>", "")
    sections = F.split(F.regexp_replace(body, "\n(##[ \\t\\n])", "\u0001$1"), "\u0001")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def add(s: Column, p: Column) -> Column:
        full = (F.length(s["cur"]) + F.length(p) > size) & (s["cur"] != "")
        return F.struct(
            F.when(full, F.array_append(s["done"], _strip(s["cur"]))).otherwise(s["done"]).alias("done"),
            F.when(full, F.concat(F.right(s["cur"], F.lit(overlap)), F.lit(" "), p)).when(s["cur"] == "", p).otherwise(F.concat(s["cur"], F.lit("\n\n"), p)).alias("cur"),
        )

    def chunks(section: Column) -> Column:
        title = F.substring(F.trim(F.regexp_extract(section, "^##[ \\t]+([^\\n]+)", 1)), 1, 100)
        done = F.aggregate(_pieces(section, "\\n{2,}"), start, add, lambda s: F.when(F.length(_strip(s["cur"])) > least, F.array_append(s["done"], _strip(s["cur"]))).otherwise(s["done"]))
        return F.transform(done, lambda t: F.struct(title.alias("section"), t.alias("text")))

    said = F.array_contains(F.array(*[F.contains(F.lower(c), F.lit(m)) for m in lex.empty_notes]), True)
    found = F.flatten(F.transform(sections, chunks))
    return F.when(said, F.slice(found, 1, 0)).otherwise(found)


def exploded_sections(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each section chunk, numbered on across sections, with id ``key_0000``."""
    rows = docs.select(key, F.posexplode(section_chunks(F.col("text"))).alias("chunk_idx", "c"))
    return rows.select(key, "chunk_idx", F.format_string("%s_%04d", F.col(key).cast("string"), "chunk_idx").alias("chunk_id"), "c.section", "c.text")


def distinct_sentences(docs: DataFrame, key: str = "doc_id", most: int = 50, boilerplate: str | None = None) -> DataFrame:
    """First ``most`` sentences of 31 to 499 characters of each document, first of equal (lower-cased) 80-character prefixes."""
    text = F.filter(F.transform(sentences(F.col("text")), lambda s: F.trim(s)), lambda s: F.length(s).between(31, 499))
    if boilerplate:
        text = F.filter(text, lambda s: ~F.lower(s).rlike(boilerplate))
    rows = docs.select(key, text.alias("_s")).select(key, F.posexplode("_s").alias("pos", "sentence"))
    k = F.lower(F.substring("sentence", 1, 80))
    rows = rows.withColumn("_first", F.row_number().over(Window.partitionBy(key, k).orderBy("pos"))).filter("_first = 1").drop("_first")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).filter(F.col("rank") <= most).drop("pos")
