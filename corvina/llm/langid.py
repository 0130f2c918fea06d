"""Language identification by Bayesian evidence fusion.

Text likelihoods come from a multinomial model over hashed byte trigrams, learned from at most TRAIN_ROWS rows of declared language
(chosen by a hash of their id within each language, so that every declared language has some; whole texts).  Likelihoods of long texts are tempered to EVIDENCE trigrams, so that other evidence
keeps its weight: the language the markup declares, the language the address suffix suggests, and a prior of the host.
Host priors are counts of text-only decisions by grouped aggregation, smoothed hierarchically: a host towards its domain,
a domain towards all hosts.  Few hosts are broadcast, many joined by shuffle, where AQE
splits a host with a third of all rows.  A further class, ``und``, is uniform over trigrams; a row whose best class it is is rejected.

Nulls, empty texts and texts without letters have no text evidence; without any other they are ``und`` and rejected.
A few letters are too little for rejection, as ``und`` is improbable beforehand.  Null hosts share one
prior.  Rows that repeat an id are decided one by one; documents are told by doc_id and text_xxh, a hash of their text.  Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import release, saved, small_batches, trim

TRAIN_ROWS, EVIDENCE, STRENGTH = 4_000, 200.0, 20.0
BUCKETS = 1 << 16
#: A prior takes under 200 bytes, so this bounds what is broadcast at 50 MB.
BROADCAST_HOSTS = 250_000
UND, UND_PRIOR = "und", 1e-4
DECLARED, SUFFIX = 0.9, 0.6
#: Country suffixes that suggest a language.
SUFFIXES = {"uk": "en", "us": "en", "au": "en", "ie": "en", "nz": "en", "fr": "fr", "de": "de", "at": "de", "es": "es", "mx": "es", "ar": "es", "co": "es", "cl": "es", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl"}

_fold = np.full(256, 32, np.uint8)
_fold[97:123] = np.arange(97, 123)
_fold[65:91] = np.arange(97, 123)
_fold[128:] = np.arange(128, 256)


def _trigrams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram that holds a letter, and the text it is in."""
    b = _fold[raw].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = ((b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F) >> np.uint32(16)
    good = (b[:-2] != 32) | (b[1:-1] != 32) | (b[2:] != 32)
    inner = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(b))]
    across = np.concatenate([inner - 1, inner - 2])  # trigrams that end in the next text
    good[across[(across >= 0) & (across < len(good))]] = False
    at = np.flatnonzero(good[: len(code)])
    return code[at].astype(np.int64), np.searchsorted(off, at, "right") - 1


def _level(sizes: list[int], limit: int) -> int:
    """How many rows each language may give so that all give ``limit`` together; small ones leave their share to the others."""
    sizes, left = sorted(sizes), limit
    for i, n in enumerate(sizes):
        share = max(1, left // (len(sizes) - i))
        if n > share:
            return share
        left -= n
    return limit


def fit(rows: DataFrame, key: str = "doc_id", limit: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and log likelihoods (language x bucket) from rows (key, text, lang).

    At most ``limit`` rows, or one of each language where there are more, are learned from, one for each id; the list of languages is of all rows.
    Their trigrams are counted by the tasks: what reaches the driver is BUCKETS counts for each language (1 MB), however long the texts.
    """
    usable = rows.filter("lang is not null and length(text) > 0")
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.approx_count_distinct(key).alias("n")).collect()}
    langs = sorted(sizes)
    limit = max(limit, len(langs))
    level = _level(list(sizes.values()), limit)
    # ids alone are compared, and of a large language only those of small hash; texts of the chosen follow
    large = [F.when((F.col("lang") == x) & (F.pmod(F.xxhash64(key), F.lit(1 << 40)) >= int((2 * level + 100) / n * (1 << 40))), True) for x, n in sizes.items() if n > 2 * level + 100]
    ids = usable.filter(F.coalesce(*large).isNull()) if large else usable
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", key))
    chosen = ids.select(key, "lang", F.pmod(F.xxhash64(key), F.lit(1 << 40)).alias("h")).distinct().withColumn("place", place).filter(F.col("place") <= level).orderBy("place", "h", key).limit(limit)
    # of rows that repeat an id one text is taken, so that rows are bounded like ids
    some = usable.join(F.broadcast(chosen.select(key, "lang")), [key, "lang"], "left_semi").groupBy("lang", key).agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))
    coded = F.create_map(*[F.lit(x) for pair in zip(langs, range(len(langs)), strict=True) for x in pair])[F.col("lang")] if langs else F.lit(0)
    summed = some.select(coded.alias("lang"), "text").mapInArrow(_counted, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = np.ones((len(langs), BUCKETS)) * 0.05
    with small_batches(rows.sparkSession):
        found = summed.toArrow() if langs else None
    if found is not None:
        counts[found.column("lang").to_numpy(), found.column("bucket").to_numpy()] += found.column("n").to_numpy()
    return langs, np.log(counts / counts.sum(1, keepdims=True)) if langs else counts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of each language in a task, of the buckets that occur there: many tasks with few texts give few rows each."""
    release()
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        which = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b, raw, off in tb.steps(batch.column(1)):
            code, doc = _trigrams(raw, off)
            for lang in np.unique(which[a:b]):
                mine = (which[a:b] == lang)[doc]
                held.setdefault(int(lang), np.zeros(BUCKETS, np.int64))
                held[int(lang)] += np.bincount(code[mine], minlength=BUCKETS)
    for lang, count in held.items():
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), lang), pa.int32()), pa.array(some, pa.int32()), pa.array(count[some])], ["lang", "bucket", "n"])


def _likelihoods(table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            names = batch.schema.names
            for a, b, raw, off in tb.steps(batch.column(names.index("text"))):
                code, doc = _trigrams(raw, off)
                n = np.bincount(doc, minlength=b - a)
                letters = np.diff(np.append(0, np.cumsum(_fold[raw] != 32))[off])
                scale = np.minimum(1.0, EVIDENCE / np.maximum(n, 1))
                ll = np.stack([np.bincount(doc, weights=row[code], minlength=b - a) * scale for row in table] + [-np.log(BUCKETS) * n * scale], 1)
                part = batch.slice(a, b - a)
                cols = [part.column(i) for i, c in enumerate(names) if c != "text"]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * ll.shape[1], pa.int32()), pa.array(ll.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*cols, pa.array(letters, pa.int64()), pa.array(n, pa.int64()), flat], [c for c in names if c != "text"] + ["n_letters", "n_trigrams", "ll"])
        batch = part = raw = off = code = doc = None
        trim()  # the worker may stand idle beside other stages

    return run


def _array(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], key: str = "doc_id") -> DataFrame:
    """rows: key, text and, where there are any, host, domain, declared, suffix (strings).

    Returns key, lang, text_lang (text evidence alone), probability, rejected.
    """
    langs, table = model
    classes = [*langs, UND]
    m = len(classes)
    for c in ("host", "domain", "declared", "suffix"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    rows = rows.select(F.col(key).alias("id"), F.coalesce("host", F.lit("")).alias("host"), F.coalesce("domain", F.lit("")).alias("domain"), F.lower("declared").alias("declared"), F.lower("suffix").alias("suffix"), "text")
    schema = rows.drop("text").select("*", F.lit(0).cast("long").alias("n_letters"), F.lit(0).cast("long").alias("n_trigrams"), F.array(F.lit(0.0)).alias("ll")).schema
    seen = saved(rows.mapInArrow(_likelihoods(table), schema), "likelihoods")
    text_best = F.array_position("ll", F.array_max("ll")).cast("int") - 1
    votes = seen.filter("n_trigrams > 0").withColumn("c", text_best).groupBy("domain", "host").agg(*[F.count_if(F.col("c") == k).alias(f"v{k}") for k in range(m)])
    votes = votes.select("domain", "host", F.array(*[F.col(f"v{k}").cast("double") for k in range(m)]).alias("v"))
    sums = [F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(m)]
    of_domain = votes.groupBy("domain").agg(*sums).select("domain", F.array(*[F.col(f"v{k}") for k in range(m)]).alias("dv"))
    total = of_domain.agg(*[F.sum(F.col("dv")[k]) for k in range(m)]).first()
    base = np.array([x or 0.0 for x in total]) + 1.0
    base[-1] = 0.0
    base = np.append(base[:-1] / max(base[:-1].sum(), 1.0) * (1 - UND_PRIOR), UND_PRIOR)

    def smooth(counts: str, towards: Column | str) -> Column:
        n = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(counts, towards, lambda c, p: (c + STRENGTH * p) / (n + STRENGTH))

    priors = votes.join(of_domain.withColumn("dp", smooth("dv", _array(list(base)))), "domain").select("domain", "host", smooth("v", "dp").alias("prior"))
    # Written first: hosts are counted, broadcast up to BROADCAST_HOSTS, else both sides are shuffled and a hot host is split.
    priors = saved(priors, "priors")
    out = seen.join(F.broadcast(priors) if priors.count() <= BROADCAST_HOSTS else priors, ["domain", "host"], "left").withColumn("prior", F.coalesce("prior", _array(list(base))))

    def told(column: str, weight: float) -> Column:
        """Log likelihood of a hint: ``weight`` for the language it names, the rest shared; nothing where it names none of ours."""
        share = (1 - weight) / max(1, m - 1)
        by = {x: [np.log(weight if k == x else share) for k in classes] for x in langs}
        each = F.create_map(*[v for x in langs for v in (F.lit(x), _array(by[x]))]) if langs else None
        zero = _array([0.0] * m)
        return F.coalesce(F.try_element_at(each, F.substring_index(F.col(column), "-", 1)), zero) if langs else zero

    suffixes = F.create_map(*[F.lit(v) for pair in SUFFIXES.items() for v in pair])
    out = out.withColumn("suffix", F.try_element_at(suffixes, F.col("suffix")))
    out = out.withColumn("declared_ll", told("declared", DECLARED)).withColumn("suffix_ll", told("suffix", SUFFIX))
    log = F.zip_with(F.zip_with("ll", F.transform("prior", lambda p: F.log(p)), lambda a, b: a + b), F.zip_with("declared_ll", "suffix_ll", lambda a, b: a + b), lambda a, b: a + b)
    out = out.withColumn("log", log).withColumn("best", F.array_position("log", F.array_max("log")).cast("int") - 1)
    nothing = (F.col("n_letters") == 0) & F.col("declared").isNull() & F.col("suffix").isNull()
    names = F.array(*[F.lit(c) for c in classes])
    probability = 1 / F.aggregate(F.transform("log", lambda x: F.exp(x - F.array_max("log"))), F.lit(0.0), lambda a, x: a + x)
    lang = F.when(nothing, F.lit(UND)).otherwise(F.get(names, F.col("best")))
    return out.select(
        F.col("id").alias(key), lang.alias("lang"), F.when(F.col("n_trigrams") > 0, F.get(names, text_best)).otherwise(UND).alias("text_lang"),
        F.round(F.when(nothing, 0.0).otherwise(probability), 6).alias("probability"), (lang == UND).alias("rejected"),
    )


def document_languages(docs: DataFrame) -> DataFrame:
    """``identify`` over documents: model from their declared ``lang`` (rows whose crc32(doc_id) mod 3 is 1 are held out), ``source`` as host."""
    model = fit(docs.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    document = F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_xxh")).alias("document")
    found = identify(docs.select(document, "text", F.col("source").alias("host")), model, "document")
    return found.select("document.doc_id", *[c for c in found.columns if c != "document"], "document.text_xxh")


def page_languages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """``identify`` over web pages (page_id, url, html) with the model of documents and all other evidence."""
    html = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))
    rows = pages.select(
        "page_id", text.alias("text"), host.alias("host"), F.substring_index(host, ".", -2).alias("domain"), F.nullif(F.substring_index(host, ".", -1), F.lit("")).alias("suffix"),
        F.nullif(F.regexp_extract(html, r"(?i)<html[^>]*\blang=[\"']?([A-Za-z-]+)", 1), F.lit("")).alias("declared"),
    )
    return identify(rows, fit(docs), "page_id")
