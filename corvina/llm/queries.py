"""The query of each operator over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, decontaminate, exact_dedup, langid, line_dedup, ngram_join, pii, quality, setsketch, sharding, token_output, whitening

VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffled_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), 24)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary_path())


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.without_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated"
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.document_languages(table(spark, sf_dir, "documents"))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.page_languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_files(table(spark, sf_dir, "documents"), vocabulary_path())


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copies(table(spark, sf_dir, "documents")).drop("text_xxh")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents")).withColumn("every", F.array_sort(F.concat("base", "added")))
    of_kind = lambda c, k: F.size(F.filter(c, lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind("base" if k < pii.BASE else "every", k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.size("every").cast("long").alias("n_spans"), F.sha2(pii.as_text(F.col("base")), 256).alias("base_sha256"), pii.as_text(F.col("every")).alias("spans"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.clusters(table(spark, sf_dir, "embeddings"))
    return found.withColumn("centroid_sha256", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)).drop("centroid")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the contract's long: null where the exact decimal does not fit
    return whitening.whitening(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def op13_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"))


_QUERIES = (
    op1_sharding, op2_ngram_join, op3_bpe, op4_line_dedup, op5_decontamination, op6_quality, op7_language_id, op8_token_output, op9_exact_dedup, op10_personal_data,
    op11_centroids, op12_whitening, op13_setsketch, language_id_pages,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _jaccard_sql(size: int, percent: int) -> str:
    """Classes of documents whose sets of shingles of ``size`` words have a similarity of ``percent`` or more, by links followed."""
    return f"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
                   ELSE list_distinct(list_transform(range(1, len(w) - {size - 2}), lambda i: array_to_string(w[i:i + {size - 1}], ' '))) END AS s FROM words
        ), flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
        ), shared AS (SELECT *, count(*) OVER (PARTITION BY g) AS df FROM flat
        ), live AS (SELECT doc_id FROM shared GROUP BY doc_id, n HAVING 100 * count(*) FILTER (df > 1) >= {percent} * n
        ), few AS (SELECT * FROM shared SEMI JOIN live USING (doc_id)
        ), links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM few a JOIN few b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))
        ), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        ), least_of AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a)
        SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(c, s.doc_id) AS component_id FROM sets s LEFT JOIN least_of ON a = s.doc_id"""


def _lloyd_sql(rounds: int = 3) -> str:
    """Lloyd's rounds one after the other, each from all vectors."""
    parts = [
        """v AS (SELECT row_number() OVER (ORDER BY vec_id, x) AS r, vec_id, x FROM (
            SELECT vec_id, list_transform(embedding, lambda c: floor(c::DOUBLE * 64)::BIGINT) AS x FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: coalesce(isfinite(c), false))) = 64))""",
        "e AS (SELECT r, unnest(range(64)) AS d, unnest(x) AS x FROM v)",
        "f AS (SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR), x) - 1 AS c FROM v ORDER BY c LIMIT 16)",
        "c0 AS (SELECT c, d, x FROM f JOIN e USING (r))",
    ]
    for k in range(rounds + 1):
        parts.append(f"a{k} AS (SELECT r, c, dist FROM (SELECT e.r, m.c, sum((e.x - m.x) * (e.x - m.x)) AS dist FROM e JOIN c{k} m USING (d) GROUP BY e.r, m.c) QUALIFY row_number() OVER (PARTITION BY r ORDER BY dist, c) = 1)")
        if k < rounds:
            parts.append(f"s{k} AS (SELECT c, d, sum(x) AS s, count(*) AS n FROM a{k} JOIN e USING (r) GROUP BY c, d)")
            parts.append(f"c{k + 1} AS (SELECT m.c, m.d, CASE WHEN n IS NULL THEN m.x ELSE ((s - ((s % n) + n) % n) // n)::BIGINT END AS x FROM c{k} m LEFT JOIN s{k} USING (c, d))")
    parts.append(f"h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS sha FROM c{rounds} GROUP BY c)")
    return f"""WITH {", ".join(parts)} SELECT vec_id, c::INTEGER AS cluster, dist::BIGINT AS distance, (sum(dist) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
        (sum(dist) OVER ())::BIGINT AS inertia, sha AS centroid_sha256 FROM a{rounds} JOIN v USING (r) JOIN h USING (c)"""


ORACLE = {
    "op11_centroids": _lloyd_sql(),
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op2_ngram_join": _jaccard_sql(5, 75),
    "op13_setsketch": f"SELECT *, doc_id = component_id AS kept FROM ({_jaccard_sql(4, 80)})",
    "op4_line_dedup": """
        WITH lines AS (
            SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents
        ), common AS (SELECT line FROM lines WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT source) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(c.line) AS n_removed, sha256(coalesce(string_agg(l.line, chr(10) ORDER BY pos) FILTER (c.line IS NULL), '')) AS kept_sha256
        FROM lines l LEFT JOIN common c ON l.line = c.line GROUP BY doc_id""",
    "op5_decontamination": f"""
        WITH dw AS (
            SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
        ), iw AS (
            SELECT item_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark
        ), spans AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS k, unnest(list_transform(range(1, greatest(len(w) - 8, 2)), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS g
            FROM iw WHERE len(w) > 0
        ), ks AS (SELECT DISTINCT k FROM spans
        ), runs AS (
            SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS p, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
            FROM dw, ks WHERE len(w) >= k
        ), hits AS (SELECT doc_id, p, r.k, item_id FROM runs r JOIN spans s ON r.g = s.g AND r.k = s.k
        ), covered AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS x FROM hits) GROUP BY doc_id
        ), items AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS i FROM hits GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(i), 0)::BIGINT AS n_items,
               sha256(coalesce(array_to_string(i, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
