"""Results at sizes and shapes that the smallest tables do not have."""

import dataclasses
import random
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from conftest import rows_of
from pyspark.sql import functions as F
from test_sources import shuffled

from corvina import lexicons
from corvina.operators import cache, grams, ngram, retrieve
from corvina.functions import text as tx
from corvina.queries import QUERIES, SQL, streams
from corvina.queries.words import LEXICON as WORDS
from corvina.session import scratch_folder
from corvina.sources import ngram_file, sinks
from corvina.streaming import stateful

SF = "/root/testdata/sf0.01"


def equal_at_a_hundredth(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = QUERIES[name](spark, SF)
    r = con.execute(SQL[name])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in r.description], r.fetchall())


def test_diversity_by_rank_within_a_turn(spark):
    rows = spark.createDataFrame([(1, u, i) for i, u in enumerate("ABBA")], "query_id int, url string, rank int")
    assert [r["rank"] for r in retrieve.diverse(rows, 0.5, by_rank=True).orderBy("position").collect()] == [0, 1, 2, 3]
    assert [r["rank"] for r in retrieve.diverse(rows, 0.5).orderBy("position").collect()] == [0, 1, 3, 2]
    equal_at_a_hundredth(spark, "diversity_cap")


def test_numbered_names_have_few_candidates(spark):
    names = spark.range(3000).selectExpr("id as text_id", "format_string('customer#%09d official c%d-%d', id, id, id % 25) as text", "format_string('customer#%09d', id) as a", "format_string('c%d-%d', id, id % 25) as b")
    keys = names.selectExpr("explode(array(a, b, 'x', null)) as string")
    found = {(r["text_id"], r["string"]) for r in grams.windows(names, keys, "text_id", "text", "string").collect()}
    assert {(r["text_id"], r[k]) for r in names.collect() for k in "ab"} <= found
    assert len(found) < 10 * 3000


def test_counts_by_bucket(spark, monkeypatch):
    r = random.Random(3)
    texts = [[r.choice("a bb ccc é".split()) for _ in range(r.randrange(30))] for _ in range(60)] + [["x"] * 50, [], None, ["a"], list("abcdef"), list("abcdef"), [""] * 8]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, tokens array<string>")
    part = lambda k: docs.filter(f"doc_id % 2 = {k}")
    for step, order in ((200_000, 5), (7, 5), (40, 1), (40, 2)):
        monkeypatch.setattr(ngram, "STEP", step)
        want = sorted(map(tuple, ngram.counts(ngram.windows(docs, order)).collect()))
        assert sorted((x["ctx"], x["next"], x["freq"]) for x in ngram.bucket_counts(docs, order).collect()) == want
        table = ngram.bucket_counts(docs, order, held=F.col("doc_id") % 2 == 0, asked=F.col("doc_id") % 2 == 1)
        assert ngram.bucket_coverage(table).first() == ngram.coverage(ngram.windows(part(1), order), ngram.counts(ngram.windows(part(0), order))).first()
        totals = {}
        for c, _, n in want:
            totals[c] = totals.get(c, 0) + n
        asked = {x["ctx"] for x in ngram.windows(part(1), order).select("ctx").distinct().collect()}
        got = ngram.asked_nexts(ngram.bucket_counts(docs, order, asked=F.col("doc_id") % 2 == 1))
        assert sorted(map(tuple, got.collect())) == [(*x, totals[x[0]]) for x in want if x[0] in asked]
    with pytest.raises(Exception, match="U.001E"):
        ngram.bucket_counts(spark.createDataFrame([(["a\x1fb"] * 9,)], "tokens array<string>")).collect()


def test_counts_move_few_bytes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", ngram.tokens(F.col("text")).alias("tokens"))
    assert shuffled(spark, ngram.stats(ngram.bucket_counts(docs))) < 0.5 * shuffled(spark, ngram.counts(ngram.windows(docs)))


def test_few_words_have_characters(spark, monkeypatch):
    r = random.Random(4)
    texts = [[r.choice(["a", "a", "bb", "é中", "", "d d"]) for _ in range(r.randrange(12))] for _ in range(80)] + [None, ["z"] * 9]
    docs = spark.createDataFrame([(t,) for t in texts], "tokens array<string>")
    want = sorted(map(tuple, ngram.counts(ngram.windows(docs, 3)).collect()))
    monkeypatch.setattr(ngram, "CHARACTERS", np.array([0x10348, 0xE9, 0xFFFF]))
    for words in (0, 3):
        monkeypatch.setattr(ngram, "WORDS", words)
        known = ngram.vocabulary(docs)
        assert len(known.words) <= words and known.tokens == sum(len(t or ()) for t in texts)
        coded = ngram.bucket_counts(docs, 3, words=known, spell=())
        got = ngram.spelled(coded, known, order=3).groupBy("ctx", "next").agg(F.sum("freq"))  # tokens with spaces give one context in several ways
        assert sorted(map(tuple, got.collect())) == want


def test_coded_counts_move_few_bytes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", ngram.tokens(F.col("text")).alias("tokens"))
    assert shuffled(spark, QUERIES["ngram_coded_counts"](spark, SF)) < 0.25 * shuffled(spark, ngram.counts(ngram.windows(docs)))


def test_nearest_by_matrix_equals_blocks(spark, monkeypatch):
    r = random.Random(5)
    odd = [None, [], [1.0], [None, 1.0, 2.0], [float("nan"), 0.0, 1.0], [float("inf"), -1.0, 0.5], [1e7, -3e6, 2.0], [0.0] * 3]
    vectors = odd + [[r.choice([0.1, 0.2, -0.3, r.random()]) for _ in range(3)] for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    queries = rows.filter("vec_id < 60").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    for k, least in ((3, 0.0), (30, -5.0)):
        monkeypatch.setattr(retrieve, "BLOCKS", 32)
        got = retrieve.dense_top_k(queries, rows, k, least)
        assert "MapInArrow" in got._jdf.queryExecution().toString()
        got = sorted(map(repr, got.collect()))
        monkeypatch.setattr(retrieve, "BLOCKS", 1)
        monkeypatch.setattr(retrieve, "QUERY_BLOCK", 59)
        want = retrieve.dense_top_k(queries, rows, k, least)
        assert "MapInArrow" not in want._jdf.queryExecution().toString()
        assert got == sorted(map(repr, want.collect()))
        monkeypatch.undo()


def test_files_are_written_by_tasks(spark, tmp_path):
    rows = spark.createDataFrame([("a.pdf", 2, "é"), ("a.pdf", 1, "x"), ("b.pdf", 1, None)], "file string, seq long, body string")
    assert sorted(map(tuple, sinks.write_files(rows, str(tmp_path)).collect())) == [("a.pdf", 2), ("b.pdf", 1)]
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir()} == {"a.pdf": "xé".encode(), "b.pdf": b""}
    equal_at_a_hundredth(spark, "pdf_files")


def test_expiry_by_any_pattern(spark):
    rows = spark.createDataFrame([("It was A.",), ("b b",), ("c",), (None,)], "text string")
    lex = dataclasses.replace(lexicons.DEFAULT, temporal=("^b", "(?i)A[.]$"))
    got = cache.entries(rows, lex=lex)
    assert [r["ttl"] for r in got.collect()] == [cache.DATED, cache.DATED, cache.PLAIN, cache.PLAIN]
    assert got.select("ttl")._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") == 1


def test_csv_paths_are_sought_where_there_are_ends(spark):
    rows = spark.createDataFrame([("see a/b.csv x",), ("a" * 50_000,), ("b.CSV",), (None,), (".csv",)], "text string")
    for pattern, want in ((WORDS.csv, ["a/b.csv", "", "", None, ""]), ("(?i)([a-z]+[.]csv)", ["b.csv", "", "b.CSV", None, ""])):
        got = rows.select(tx.csv_path(F.col("text"), dataclasses.replace(WORDS, csv=pattern)).alias("x"))
        assert [r["x"] for r in got.collect()] == want
        assert ("Contains" in got._jdf.queryExecution().optimizedPlan().toString()) == (pattern == WORDS.csv)


def test_workers_keep_no_freed_memory():
    code = "import pyarrow as pa; from corvina.llm.common import trim; trim(); print(pa.default_memory_pool().backend_name)"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split() == ["system"]


def test_gates_come_in_bounded_batches(spark, monkeypatch):
    told = []
    monkeypatch.setattr(streams, "BATCH", 250)
    monkeypatch.setattr(streams, "scratch_folder", lambda s, name: told.append(scratch_folder(s, name)) or told[-1])
    found = QUERIES["stream_gates"](spark, "/root/testdata/sf0.001")
    files = [f for f in Path(told[0].removeprefix("file://")).iterdir() if f.name.endswith(".parquet") and f.name[0] != "."]
    rows = [spark.read.parquet(f"file://{f}").count() for f in files]
    assert len(rows) > 4 and max(rows) <= 500
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, QUERIES["gates_cooldown"](spark, "/root/testdata/sf0.001").collect()))


def test_ngram_file_counts_packed_windows(spark, monkeypatch, tmp_path):
    """Windows of frequent and other words, of tasks that give what they hold several times, in shards of which half the slots are full."""
    monkeypatch.setattr(ngram, "WORDS", 9)
    monkeypatch.setattr(ngram, "HELD", 40)
    monkeypatch.setattr(ngram, "STEP", 100)
    r = random.Random(3)
    texts = [" ".join(r.choice(("Ab", "c", "dE-f", "g1", "K", "h" + "xyz"[r.randrange(3)] * r.randrange(5))) for _ in range(r.randrange(90))) for _ in range(40)] + [None, "", " 7 "]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    want = Counter()
    for t in texts:
        w = re.findall("[a-z]+", (t or "").lower())
        want.update((tuple(w[i : i + 2]), w[i + 2]) for i in range(len(w) - 2))
    packed = ngram.id_counts(docs, 2, "text").persist()
    rows = packed.count(), sorted(Counter(want.values()).items())
    some = ngram.id_rows(packed, 2).groupBy("ctx", "next").agg(F.sum("freq").alias("freq")).collect()
    assert sorted(Counter(x["freq"] for x in some).items()) == rows[1] and ngram.id_rows(packed, 2).count() > len(want)
    path = str(tmp_path / "t")
    ngram_file.write_packed(packed, path, 2, shard=20)
    assert all(s["contexts"] <= 16 for s in ngram_file.shards(path)) and sum(s["contexts"] == 16 for s in ngram_file.shards(path)) > 2
    table = ngram_file.NgramTable(path)
    for x in some:
        assert (x["next"], x["freq"]) in table.lookup(x["ctx"])
    assert tuple(ngram_file.totals(spark, path).first()) == (len({c for c, _ in want}), len(want), sum(want.values()))
    assert sinks.differing(lambda share: ngram.id_rows(packed, 2, share), len(want), path, 1000) == 0
    assert sinks.differing(lambda share: ngram.id_rows(packed, 2, share).withColumn("freq", F.col("freq") + 1), len(want), path, 20) == 20


def test_gates_hold_no_more_summaries_than_they_ask_for(spark):
    """Reverts of one summary are counted as far as gates ask, and the batches are written by one pass, whose files come in the order of time."""
    held = {}

    class State:
        def __init__(self):
            self.value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    class Summaries(dict):
        containsKey, getValue, updateValue, iterator = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.items  # noqa: N815

    gates = stateful.AgentGates(3600, 0, 7, 2, 30)
    gates.told, gates.undone = State(), Summaries()
    for start in (0, 100):
        rows = pd.DataFrame({"id": range(100), "agent": "a", "pattern": ["Gone"] * 99 + ["two"], "ts": pd.to_datetime(range(start, start + 100), unit="D"), "kind": ["revert", "proposal"] * 50})
        out = pd.concat(list(gates.handleInputRows(("a",), iter([rows]), None)))
        held[start] = out["late"].tolist()
    assert held == {0: [None] + ["blocked"] * 48 + [None], 100: ["blocked"] * 49 + [None]} and gates.undone == {("gone",): (2,)}


def test_fuzzy_moves_only_prefixes_and_what_is_in_pairs(spark, monkeypatch):
    """The same answers where tokens are numbered, where only some are, and where nothing is broadcast; no set of an entry without pairs moves."""
    monkeypatch.setattr(cache, "written", lambda rows, name: told.append(name) or rows.persist())
    r = random.Random(5)
    text = lambda k: " ".join(f"t{k * 7 + x}" for x in r.sample(range(10), r.randrange(1, 10)))
    e = cache.entries(spark.createDataFrame([(i, text(i // 12)) for i in range(120)], "entry_id long, text string").withColumn("created_at", F.col("entry_id").cast("timestamp")))
    q = cache.entries(spark.createDataFrame([(i, text(i // 3)) for i in range(30)], "query_id long, text string"))
    found = []
    for common, ids, tokens in ((1000, 1000, 1000), (3, 1000, 1000), (1000, 0, 0)):
        for name, x in (("COMMON", common), ("BROADCAST_IDS", ids), ("BROADCAST_TOKENS", tokens)):
            monkeypatch.setattr(cache, name, x)
        told = []
        found.append(sorted(map(tuple, cache.fuzzy(q, e).collect())))
        assert told == ["asked", "held", "pairs"]
    assert len(found[0]) > 5 and found[0] == found[1] == found[2]
