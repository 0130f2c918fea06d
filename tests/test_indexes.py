"""The inverted-file index and the gram index against comparisons with every row."""

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from corvina.operators import grams, retrieve, vector_index
from corvina.session import scratch_folder
from corvina.sources import readers


def vector_rows(n=1500, dims=16, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(30, dims))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 30] + r.normal(scale=0.35, size=dims)]) for i in range(n)]
    rows += [(5000 + i, rows[7][1]) for i in range(300)]  # a very common vector
    rows += [(9000, [0.0] * dims)]
    odd = [(9001, None), (9002, []), (9003, [1.0] * (dims + 1)), (9004, [None] * dims), (9005, [float("nan")] * dims), (9006, [float("inf")] * dims), (None, rows[3][1])]
    return rows, odd


def brute(rows, queries, k, least=0.0):
    out = set()
    for qi, q in queries:
        sims = [(round(float(np.dot(np.array(q, np.float64), np.array(v, np.float64))), 5), i) for i, v in rows]
        best = sorted((s for s in sims if s[0] >= least), key=lambda s: (-s[0], s[1]))[:k]
        out |= {(qi, i, s, rank + 1) for rank, (s, i) in enumerate(best)}
    return out


def triples(df):
    return {(r["query_id"], r["vec_id"], round(r["sim"], 5), r["rank"]) for r in df.collect()}


@pytest.fixture(scope="module")
def index(spark):
    rows, odd = vector_rows()
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumns({"list": F.lit("x"), "off": F.lit(1)})
    return vector_index.build(frame, scratch_folder(spark, "ivf"))


def asked(spark, rows):
    some = [r for r in rows if r[0] is not None and r[0] % 50 == 0]
    return spark.createDataFrame(some, "query_id long, q array<float>"), some


def test_exact_mode_finds_the_nearest(spark, index):
    rows, _ = vector_rows()
    queries, some = asked(spark, rows)
    assert triples(index.search(queries, 5, exact=True)) == brute(rows, some, 5)
    assert triples(index.search(queries, 400, exact=True, probes=1)) == brute(rows, some, 400)
    assert triples(index.search(queries, 5, 3.0, exact=True, probes=2)) == brute(rows, some, 5, 3.0)


def test_exact_mode_in_blocks_of_queries(spark, index, monkeypatch):
    rows, _ = vector_rows()
    queries, some = asked(spark, rows)
    monkeypatch.setattr(vector_index, "QUERIES", 16)
    monkeypatch.setattr(vector_index, "CELLS", 500)
    assert triples(index.search(queries, 5, exact=True)) == brute(rows, some, 5)
    assert index.search(queries.limit(0), 5, exact=True).count() == 0


def test_tasks_send_few_candidates(spark, index):
    """No pairs of queries and lists or vectors: of a very common vector k copies, and of a list nothing that is known to be too far."""
    rows, _ = vector_rows()
    ids, vectors = [i for i, _ in rows], [v for _, v in rows]
    q = np.array([rows[7][1]] * 20)
    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(rows), pa.int32()), pa.array(ids), pa.array(vectors, pa.list_(pa.float32()))], ["list", "vec_id", "embedding"])
    run = vector_index._products(pa.array(range(20)), q, np.zeros((1, 16)), 5, 0.0, np.full(20, -1.0), None, None)
    assert sum(b.num_rows for b in run(iter([batch]))) <= 20 * 10
    files = [p for d in Path(index.root.removeprefix("file://")).glob("vectors/list=*") for p in d.glob("part-*")]
    assert len(files) <= len(index.centroids)  # a small list is one file


def test_probed_lists_hold_nine_tenths(spark, index):
    rows, _ = vector_rows()
    queries, _ = asked(spark, rows)
    assert 1 <= index.probes < len(index.centroids) == 100
    told = vector_index.recall(index.search(queries, 10), retrieve.dense_top_k(queries, index.vectors.select("vec_id", "embedding"), 10)).first()
    assert told["wanted"] == 10 * queries.count() and told["recall"] >= 0.9
    fewer = vector_index.recall(index.search(queries, 10, probes=1), index.search(queries, 10)).first()
    assert fewer["found"] <= told["wanted"]


def test_every_usable_row_is_in_a_list(spark, index):
    rows, _ = vector_rows()
    assert sorted(r["vec_id"] for r in index.vectors.select("vec_id").collect()) == sorted(i for i, _ in rows)


def test_reopened_and_added_to(spark):
    rows, _ = vector_rows(700)
    root = scratch_folder(spark, "ivf")
    built = vector_index.build(spark.createDataFrame(rows[:600], "vec_id long, embedding array<float>"), root)
    again = vector_index.open_index(spark, root)
    assert np.allclose(again.centroids, built.centroids) and again.probes == built.probes
    again.add(spark.createDataFrame(rows[600:], "vec_id long, embedding array<float>"))
    queries, some = asked(spark, rows)
    assert triples(again.search(queries, 6, exact=True)) == brute(rows, some, 6)


def test_small_and_empty_tables(spark):
    rows, odd = vector_rows(20)
    rows = rows[:20]
    small = vector_index.build(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), scratch_folder(spark, "ivf"))
    queries, some = asked(spark, rows)
    assert len(small.centroids) == 1 and triples(small.search(queries, 3)) == brute(rows, some, 3)
    empty = vector_index.build(spark.createDataFrame(odd[:2], "vec_id long, embedding array<float>"), scratch_folder(spark, "ivf"))
    assert empty.search(queries, 3).collect() == [] and empty.search(queries, 3, exact=True).collect() == []
    none = spark.createDataFrame([(1, None), (2, [1.0])], "query_id long, q array<float>")
    assert small.search(none, 3).collect() == []


def test_query_blocks_are_joined_by_number(spark, monkeypatch):
    """Many blocks, read in several passes, give the rows of one."""
    rows, _ = vector_rows(300)
    queries, some = asked(spark, [(50 * i, v) for i, (_, v) in enumerate(rows[:90])])
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    one = triples(retrieve.dense_top_k(queries, vectors, 4))
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 8)
    monkeypatch.setattr(retrieve, "BLOCKS", 5)
    found = retrieve.dense_top_k(queries, vectors, 4)
    assert triples(found) == one == brute(rows, some, 4)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()


ODD = [None, "", "a", "é", "ab", "a b", "the quick brown fox", "THE QUICK", "日本語のテキスト", "🙂🙂", "x" * 5000 + "needle" + "y" * 5000, "needle", "aaaa", "aa", "\x00\x01", "%_\\", "tab\tline\n"]


def test_contained_equals_brute_force(spark):
    r = random.Random(2)
    texts = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, "common " + "".join(r.choice("abé ") for _ in range(r.randrange(40)))) for i in range(300)]
    strings = [*ODD[1:], "common", "common ", "quick", "ックス", "本語", "needley", "zzz", "ba", "é ", "aab", *["".join(r.choice("abé ") for _ in range(r.randrange(1, 7))) for _ in range(200)]]
    frame = spark.createDataFrame(texts, "text_id long, text string").withColumns({"id": F.lit(1), "gram": F.lit(2), "string": F.lit("x")})
    got = {(x["text_id"], x["string"]) for x in grams.contained(frame, spark.createDataFrame([(s,) for s in strings + [None]], "string string")).collect()}
    assert got == {(i, s) for i, t in texts if t for s in set(strings) if s and s in t}


def test_postings_do_not_depend_on_steps(spark, monkeypatch):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "id long, text string").coalesce(1)
    want = {(i, int.from_bytes(bytes([3]) + t.encode()[k : k + 3], "big")) for i, t in enumerate(ODD) if t for k in range(len(t.encode()) - 2)}
    assert {(r["id"], r["gram"]) for r in grams.postings(rows, "id", "text").collect()} == want
    monkeypatch.setattr(grams, "STEP", 4)
    assert {(r["id"], r["gram"]) for r in grams.postings(rows, "id", "text").collect()} == want


def test_keyword_index_equals_scan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    words = [(1, ["the", "und", "que"]), (2, ["needle", "quick"]), (3, ["nowhere-at-all"]), (4, ["日本語", "the"]), (5, []), (6, ["tion", "ment", "ing", "able", "ous"])]
    queries = spark.createDataFrame(words, "query_id long, words array<string>")
    index = grams.build(docs, scratch_folder(spark, "grams"))
    want = [tuple(r) for r in retrieve.keyword_hits(queries, docs, 7).orderBy("query_id", "rank").select("query_id", "doc_id", "hits", "rank").collect()]
    got = grams.keyword_hits(index, queries, docs, 7)
    assert [tuple(r) for r in got.orderBy("query_id", "rank").select("query_id", "doc_id", "hits", "rank").collect()] == want and len(want) > 10
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


CATALOG = [("UC1", "@Vsauce", "Vsauce", "vsauce-main"), ("UC2", "@veritasium", "Veritasium", None), ("UC3", None, "Sau", ""), ("uc4", "@Vsauce", "Other", "x")]


@pytest.mark.parametrize(
    ("asked", "found"),
    [
        ("Vsauce Official", "uc4"),  # the key is part of the name; of channels with one key the last has it
        ("vsauce", "uc4"),
        ("UC1", "UC1"),
        ("uc1", None),  # ids are as written
        ("sau", "UC3"),
        ("sa", None),  # part of a title is not enough
        ("my veritasium clips", "UC2"),
        ("see vsauce-main here", "uc4"),  # the key that comes first in the catalog's order: the handle
        ("a box", "uc4"),  # the slug x
        ("nobody", None),
        ("", None),
        (None, None),
    ],
)
def test_channels(spark, asked, found):
    catalog = spark.createDataFrame([(i, *c) for i, c in enumerate(CATALOG)], "seq int, channel_id string, handle string, name string, slug string")
    got = readers.resolve_channels(spark.createDataFrame([(asked,)], "asked string"), catalog).collect()
    assert [tuple(r) for r in got] == ([(asked, found)] if found else [])


def test_channels_equal_a_loop(spark):
    """Many names against many keys, by the loop over a dictionary in the order of the catalog."""
    r = random.Random(3)
    catalog = [(i, f"id{i}", "@" + "".join(r.choice("abC") for _ in range(r.randrange(0, 6))), "".join(r.choice("abc d") for _ in range(r.randrange(0, 7))) or None, None) for i in range(60)]
    keys = {}
    for _, cid, handle, name, _ in catalog:
        for key in (cid, handle.lstrip("@").lower(), (name or "").lower()):
            if key:
                keys[key] = cid
    names = {"".join(r.choice("abcD 1i") for _ in range(r.randrange(1, 12))) for _ in range(400)}

    def loop(name):
        if name in keys or name.lower() in keys:
            return keys[name] if name in keys else keys[name.lower()]
        return next((c for k, c in keys.items() if k in name.lower()), None)

    frame = spark.createDataFrame(catalog, "seq int, channel_id string, handle string, name string, slug string")
    got = {x["asked"]: x["channel_id"] for x in readers.resolve_channels(spark.createDataFrame([(n,) for n in names], "asked string"), frame).collect()}
    assert got == {n: c for n in names if (c := loop(n))}
