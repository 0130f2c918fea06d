"""Sources and sinks: every query writes a file or folder of its own from a table, and reads it back through the reader."""

from __future__ import annotations

import json
import re
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from ..lexicons import load
from ..operators import curate, ngram
from ..session import scratch_folder, written
from ..sources import ngram_file as source
from ..sources import collection, readers, sinks
from . import query, table
from .grams import COUNTED


_held: list[tempfile.TemporaryDirectory] = []


def _folder(name: str) -> Path:
    """A folder of the driver, for files of one host (a database, a table file, a configuration), removed with the interpreter."""
    _held.append(tempfile.TemporaryDirectory(prefix=f"corvina-{name}-"))
    return Path(_held[-1].name)


@query("SELECT doc_id, text AS response FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT -1, (count(*))::VARCHAR FROM documents WHERE doc_id % 7 = 0")
def jsonl_scan(spark, sf_dir):
    """JSON lines, every seventh broken; the number of broken ones is a row of its own."""
    path = scratch_folder(spark, "lines")
    d = table(spark, sf_dir, "documents")
    line = F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("text").alias("response")))
    sinks.append_json(d.filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("id"), F.col("text").alias("response")), path)
    d.filter("doc_id % 7 = 0").select(F.substring(line, 2, 1 << 30).alias("value")).write.mode("append").text(path)
    good, bad = readers.json_lines(spark, path, "id long, response string")
    return good.select(F.col("id").alias("doc_id"), "response").unionByName(bad.select(F.lit(-1).cast("long").alias("doc_id"), F.col("bad").cast("string").alias("response")))


@query("SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang")
def text_corpus(spark, sf_dir):
    """A folder of text files, one for each language and task, read whole."""
    path = scratch_folder(spark, "corpus")
    table(spark, sf_dir, "documents").select("lang", F.concat(F.base64(F.encode("text", "UTF-8")), F.lit(";")).alias("value")).write.partitionBy("lang").text(path)
    rows = readers.text_corpus(spark, path).select(F.regexp_extract("path", "/lang=([a-z]+)/", 1).alias("lang"), F.explode(F.split("text", ";")).alias("b"))
    rows = rows.withColumn("b", F.regexp_replace("b", r"\s", "")).filter("b <> ''")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length(F.decode(F.unbase64("b"), "UTF-8"))).alias("chars"))


@query("SELECT CASE WHEN doc_id % 3 = 0 THEN 'medical' ELSE 'code' END AS collection, count(*) AS n FROM documents GROUP BY 1")
def knowledge_base(spark, sf_dir):
    """Notes of all documents in three folders, each note a part of a file."""
    root = scratch_folder(spark, "kb")
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "kine").when(F.col("doc_id") % 3 == 1, "tech").otherwise("misc").alias("folder"))
    for name in ("kine", "tech", "misc"):
        d.filter(F.col("folder") == name).select(F.concat(F.lit("# Note "), "doc_id").alias("value")).write.text(f"{root}/{name}")
    rows = readers.knowledge_base(spark, root, {"kine": "medical", "tech": "code"}, suffixes=["txt"])
    return rows.groupBy("collection").agg(F.sum(F.regexp_count("text", F.lit("# Note "))).cast("long").alias("n")).filter("n > 0")


@query("SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings WHERE vec_id % 10 <> 7")
def collection_files(spark, sf_dir):
    """A collection on disk: written, then upserted with deletions, then read in its latest version."""
    root = scratch_folder(spark, "collection")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    collection.write(e, root)
    collection.upsert(spark, root, e.filter("id % 3 = 0 and id % 10 <> 7").withColumn("label", F.col("label") + 100), deleted=e.filter("id % 10 = 7"))
    return collection.read(spark, root)


@query("SELECT event_id, event_type AS route, value AS score FROM events")
def sqlite_scan(spark, sf_dir):
    """Logs of SQLite, a database of each task that wrote one, read by tasks in ranges of rows."""
    path = scratch_folder(spark, "sqlite")
    sinks.write_sqlite(table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("route"), F.col("value").alias("score")).repartition(4, "event_id"), path, "decisions")
    return readers.sqlite_table(spark, path, "decisions", rows=10_000)


@query(f"WITH {COUNTED}, t AS (SELECT ctx, sum(freq) AS total, count(*) AS nexts FROM tab GROUP BY ctx) SELECT count(*) AS contexts, sum(nexts)::BIGINT AS entries, sum(total)::BIGINT AS freq FROM t")
def ngram_file(spark, sf_dir):
    """The n-gram table of all documents, in shards that tasks write: written, verified, and its contexts, entries and frequencies counted by the data source."""
    packed = written(ngram.id_counts(table(spark, sf_dir, "documents"), column="text"), "ngram-table")
    path = re.sub("^file:/*", "/", scratch_folder(spark, "ngrams"))
    source.write_packed(packed, path, 5, shard=20_000)
    n = packed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if sinks.differing(lambda share: ngram.id_rows(packed, 5, share), n, path):
        raise ValueError("the file does not hold what was written")
    return source.totals(spark, path)


@query("SELECT doc_id, concat('# ', source, chr(10), chr(10), '**URL** : u', chr(10), '**Category** : ', lang, chr(10), '**Date** : 2024', chr(10), chr(10), 'body ', doc_id, CASE WHEN doc_id % 2 = 0 THEN concat(chr(10), chr(10), '- a', chr(10), '- b') ELSE '' END) AS note FROM documents")
def notes_sink(spark, sf_dir):
    """Notes written as markdown, one record each."""
    path = scratch_folder(spark, "notes")
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("title"), F.lit("u").alias("url"), F.col("lang").alias("category"), F.lit("2024").alias("date"), F.concat(F.lit("body "), "doc_id").alias("body"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("bullets"))
    sinks.write_notes(d, path)
    rows = spark.read.option("lineSep", sinks.NOTE_END).text(path).filter("value <> ''")
    return rows.select(F.regexp_extract("value", "body ([0-9]+)", 1).cast("long").alias("doc_id"), F.col("value").alias("note"))


@query("""WITH n AS (SELECT doc_id, concat(lang, '/', CASE WHEN doc_id % 2 = 0 THEN 'code/ch' ELSE '' END) AS f, source, doc_id % 2 = 0 AS known, concat('2024-01-0', doc_id % 2 + 1, '_', source) AS base FROM documents),
    p AS (SELECT doc_id, source, known, concat(CASE WHEN known THEN 'code/ch' ELSE 'web' END, '/', base) AS base FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY doc_id) AS nth FROM p)
    SELECT doc_id, concat(base, CASE WHEN nth > 1 THEN concat('_', nth) ELSE '' END, '.md') AS path, CASE WHEN known THEN 'code' ELSE 'general' END AS category FROM r""")
def note_index(spark, sf_dir):
    """Notes of all documents, titled by their source: two thirds are indexed first, then the others beside them."""
    root = scratch_folder(spark, "notes-index")
    known = F.col("doc_id") % 2 == 0
    d = table(spark, sf_dir, "documents").select(
        F.format_string("u%012d", "doc_id").alias("url"), F.col("source").alias("title"), F.lit("general").alias("category"), F.concat(F.lit("2024-01-0"), F.col("doc_id") % 2 + 1).alias("date"), F.lit("web").alias("source_type"),
        F.when(known, "code").alias("domain"), F.when(known, "ch").alias("channel"))
    edge = d.count() * 2 // 3
    none = spark.createDataFrame([], "path string")
    sinks.index_notes(sinks.named_notes(d.filter(F.substring("url", 2, 12).cast("long") < edge), none), root, "2024-01-03")
    sinks.index_notes(sinks.named_notes(d.filter(F.substring("url", 2, 12).cast("long") >= edge), collection.read(spark, root)), root, "2024-01-04")
    return collection.read(spark, root).select(F.substring("url", 2, 12).cast("long").alias("doc_id"), "path", "category")


@query("""WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier), p AS (SELECT k, n, unnest([concat('n=', n, '/', k, '.csv'), concat('n=', n, '/../n=', n, '/', k, '.CSV'), concat('../', k, '.csv'), concat('n=', n, '/', k, '.txt'), concat('n=', n, ';', k, '.csv'), concat('./n=', n, '//all.csv')]) AS path FROM s)
    SELECT k, path, path = concat('./n=', n, '//all.csv') AS allowed FROM p""")
def csv_hardening(spark, sf_dir):
    """Which of many paths may be read, against the files of suppliers by nation: inside the root, plain, and there."""
    root = scratch_folder(spark, "csv")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))
    files = s.select(F.format_string("%s/n=%s/all.csv", F.lit(root), "n").alias("path")).distinct()
    path = lambda t: F.format_string(t, "n", "k")
    asked = s.select("k", F.explode(F.array(path("n=%1$s/%2$s.csv"), path("n=%1$s/../n=%1$s/%2$s.CSV"), path("../%2$s.csv"), path("n=%1$s/%2$s.txt"), path("n=%1$s;%2$s.csv"), path("./n=%1$s//all.csv"))).alias("path"))
    return readers.csv_files_allowed(asked, files, root).select("k", "path", "allowed")


@query("""WITH k AS (SELECT lower(c_name) AS key, c_custkey AS id, 2 * c_custkey AS place FROM customer UNION ALL SELECT concat('c', c_custkey, '-', c_nationkey), c_custkey, 2 * c_custkey + 1 FROM customer),
    n AS (SELECT unnest([upper(c_name), concat(c_name, ' Official'), concat('see c', c_custkey, '-', c_nationkey, ' and ', lower(c_name)), concat('no ', c_custkey)]) AS asked FROM customer),
    p AS (SELECT DISTINCT asked, unnest(list_concat(regexp_extract_all(lower(asked), 'customer#[0-9]{9}'), regexp_extract_all(lower(asked), 'c[0-9]+-[0-9]+'))) AS key FROM n)
    SELECT asked, arg_min(id, place) AS channel_id FROM p JOIN k USING (key) GROUP BY asked""")
def channel_lookup(spark, sf_dir):
    """Customers as a catalog of channels, each asked for by its name in capitals, within longer names, and by a name that holds no key."""
    c = table(spark, sf_dir, "customer")
    mark = F.concat(F.lit("c"), "c_custkey", F.lit("-"), "c_nationkey")
    catalog = c.select(F.col("c_custkey").alias("seq"), F.concat(F.lit("id:"), "c_custkey").alias("channel_id"), F.concat(F.lit("@"), "c_name").alias("handle"), F.lit(None).cast("string").alias("name"), mark.alias("slug"))
    asked = c.select(F.explode(F.array(F.upper("c_name"), F.concat("c_name", F.lit(" Official")), F.concat(F.lit("see "), mark, F.lit(" and "), F.lower("c_name")), F.concat(F.lit("no "), "c_custkey"))).alias("asked"))
    return readers.resolve_channels(asked, catalog).select("asked", F.substring("channel_id", 4, 20).cast("long").alias("channel_id"))


@query("SELECT page_id % 3 AS part, count(*) AS n, sum(octet_length(encode(html)))::BIGINT AS bytes FROM pages GROUP BY 1")
def pdf_files(spark, sf_dir):
    """Binary files by their suffix: pages written to files of a thousand pages of one part, as bytes for an extractor beyond the boundary."""
    path = re.sub("^file:/*", "/", scratch_folder(spark, "pdf"))
    part, i = F.col("page_id") % 3, F.col("page_id")
    pages = table(spark, sf_dir, "pages").select(F.concat(part, F.lit("-"), F.floor(i / 3000), F.lit(".pdf")).alias("file"), i.alias("seq"), F.col("html").alias("body"))
    told = sinks.write_files(pages, path).groupBy(F.substring_index("file", "-", 1).cast("long").alias("part")).agg(F.sum("n").alias("n"))
    Path(path).mkdir(exist_ok=True)
    (Path(path) / "0-0.txt").write_text("not read")
    files = readers.pdf_files(spark, path).select(F.regexp_extract("path", "([0-9])-[0-9]+[.]pdf$", 1).cast("long").alias("part"), F.length("content").cast("long").alias("bytes"))
    return files.groupBy("part").agg(F.sum("bytes").alias("bytes")).join(told, "part")


@query("SELECT lower(r_name) AS route, string_agg(lower(n_name), '|' ORDER BY n_name) AS pattern, 'africa' AS fallback FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def config_scan(spark, sf_dir):
    """A configuration made of regions and their nations, read again when it changes, and the routes of the lexicon that it makes."""
    path = _folder("config") / "lexicon.json"
    path.write_text("{}")
    config = readers.Config(str(path))
    config.get()
    rows = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    rows = rows.groupBy(F.lower("r_name").alias("route")).agg(F.array_join(F.array_sort(F.collect_list(F.lower("n_name"))), "|").alias("pattern"))
    path.write_text(json.dumps({"routes": [[r["route"], r["pattern"]] for r in rows.orderBy("route").collect()], "default_route": "africa"}))  # a region is a row
    config.seen = 0  # written within the clock's resolution
    told, lex = config.get(), load(str(path))
    if [list(r) for r in lex.routes] != told["routes"]:
        raise ValueError("the lexicon is not that of the file")
    return spark.createDataFrame([(route, pattern, lex.default_route) for route, pattern in lex.routes], "route string, pattern string, fallback string")


@query("SELECT source AS name, count(*) AS n, max(n_chars) AS largest FROM documents GROUP BY source")
def listing(spark, sf_dir):
    """A listing of a collection: its groups with their number and largest entry."""
    return curate.listed(table(spark, sf_dir, "documents"), "source", "n_chars")

