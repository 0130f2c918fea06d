"""Operators against plain Python on small edge cases."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from corvina.functions import hashing
from corvina.functions import scoring as sc
from corvina.functions import text as tx
from corvina.operators import cache, chunk, curate, monitor, ngram, retrieve
from corvina.sources import collection, file_index, readers, sinks


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_fnv_equals_loop(spark):
    ids = [0, 1, 2**32 - 1, 77, 123456]
    h = one(spark, ids, hashing.fnv1a, "array<long>")
    assert h["hi"] << 32 | h["lo"] == sinks.fnv1a(ids)


def test_fnv_query_equals_loop(spark):
    from conftest import SF

    from corvina.queries import QUERIES

    for r in QUERIES["fnv_hash"](spark, SF).take(50):
        assert r["hi"] << 32 | r["lo"] == sinks.fnv1a(r["ids"])


def test_fnv_query_has_every_window(spark):
    from conftest import SF

    from corvina.queries import QUERIES

    got = {(r["doc_id"], r["place"]): (list(r["ids"]), r["hi"] << 32 | r["lo"]) for r in QUERIES["fnv_hash"](spark, SF).filter("doc_id < 40").collect()}
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 40").collect():
        ids = [len(w) for w in r["text"].split(" ")]
        want |= {(r["doc_id"], i): (ids[i : i + 5], sinks.fnv1a(ids[i : i + 5])) for i in range(max(1, len(ids) - 4))}
    assert got == want


def plain_chunks(text, size, overlap, sep):
    limit, done, cur, n = size * 1.2 * 4, [], "", 0
    for p in [p.strip() for p in re.split(sep, text) if p.strip()]:
        long = len(p) > size * 1.5 * 4
        for i, part in enumerate(re.split(r"(?<=[.!?])[ \n\t]+", p) if long else [p]):
            carry = i == 0
            if cur and n + (len(p) if carry else len(part)) > limit:
                done.append(cur)
                cur = cur[-overlap * 4 :] if carry else ""
                n = len(cur)
            cur = cur + "\n\n" + part if cur else part
            n += len(part)
    return (done + [cur] if cur else done)[:30]


@pytest.mark.parametrize("text", ["", "one", "a b. " * 400, "\n".join(f"line {i} " * (i % 40) for i in range(80)), "x" * 5000, "s. t! " * 900 + "\nend"])
def test_paragraph_chunks(spark, text):
    got = one(spark, text, lambda c: chunk.paragraph_chunks(c, 64, 10, separator="\\n"))
    assert got == plain_chunks(text, 64, 10, "\n")


def test_paragraph_chunks_of_documents(spark):
    from conftest import SF

    rows = spark.read.parquet(f"{SF}/documents.parquet").select("text", chunk.paragraph_chunks(F.col("text"), 128, 20, separator="\\n").alias("c")).collect()
    for r in rows:
        assert r["c"] == plain_chunks(r["text"], 128, 20, "\n")


def test_section_chunks(spark):
    text = "intro words that are long enough to be kept, certainly over fifty characters\n## A\n\n" + "\n\n".join(["p" * 250] * 5) + "\n## B\n\nshort\n<details> <summary>x</summary>gone</details>"
    got = one(spark, text, chunk.section_chunks)
    assert [r["section"] for r in got] == ["", "A", "A", "A", "A"]
    assert all("gone" not in r["text"] for r in got) and got[2]["text"].startswith("p" * 100 + " ")


@pytest.mark.parametrize(("text", "want"), [('{"name": "f", "arguments": {"a": 1}}', 1.0), ('{"name": "", "arguments": {}}', 0.0), ("none", 0.5), ('{"name": "f", "arguments": 3}', 0.0)])
def test_tool_reward(spark, text, want):
    assert one(spark, text, sc.tool_reward) == want


@pytest.mark.parametrize(("text", "want"), [('x {"score": 9}', 5), ("a 4 b", 4), ("nothing", 3), ('{"score": "2"}', 2), ("12 34", 3), ('{"reason": "4"}', 3), ('{"score": 2', 2), ('{"score": -4}', 1)])
def test_parsed_score(spark, text, want):
    assert one(spark, text, sc.parsed_score) == want


def test_yes_share(spark):
    kind = "array<array<struct<token:string,logprob:double>>>"
    assert one(spark, [[("Yes", -0.5), ("no", -1.5)], [("yes", -1.0)], [("x", -1.0)]], sc.yes_share, kind) == pytest.approx(0.731059, abs=1e-5)
    assert one(spark, [[("yes", -1.0)], [("maybe", -1.0)]], sc.yes_share, kind) is None  # both are needed


def test_empty_token_lists(spark):
    assert one(spark, [], sc.token_entropy, "array<array<double>>") == 999.0
    assert one(spark, [], sc.certainty, "array<array<double>>") == 0.0


def test_example_before_last_user_turn(spark):
    rows = spark.createDataFrame([([("system", "s"), ("user", "a"), ("assistant", "b"), ("user", "c")], [("user", "q"), ("assistant", "r")])], "t array<struct<role:string,text:string>>, e array<struct<role:string,text:string>>")
    assert [x["text"] for x in rows.select(sc.with_example(F.col("t"), F.col("e")).alias("o")).first()["o"]] == ["s", "a", "b", "q", "r", "c"]


def test_patch_gates_and_rules(spark):
    rows = spark.createDataFrame([(1, ["KEEP this"], 1, 5), (4, [], 0, 5), (1, ["other"], 2, 5), (3, [], 0, 98), (3, [], 1, 98)], "adds int, touched array<string>, removes int, lines int")
    got = [r[0] for r in rows.select(sc.patch_allowed(F.col("adds"), F.col("touched"), F.col("removes"), F.col("lines"), ["keep"])).collect()]
    assert got == [False, False, True, False, True]
    rules = one(spark, "1. **Bold rule**\ntext\n  ## A heading line\n**x**\n**lower case bold**\n12 **Also a rule**", sc.rule_lines)
    assert [r["rule"] for r in rules] == ["1. **Bold rule**", "## A heading line", "12 **Also a rule**"]
    assert rules[0]["hash"] == hashlib.sha256(b"1. **Bold rule**").hexdigest()[:16]


def test_pages(spark):
    assert one(spark, "3-1,2, 5-7,7,99,x", lambda c: tx.pages(c, F.lit(6))) == [2, 5, 6]


def test_fold_and_slug(spark):
    assert one(spark, "Éàç ñ—Über  x!", tx.slug) == "eac-uber-x"
    assert one(spark, "What’s   UP ?!… ", tx.normalise) == "what's up"


def test_cache_symmetry_and_ties(spark):
    e = cache.entries(spark.createDataFrame([(1, "alpha beta gamma delta", "2024-01-01"), (2, "delta gamma beta alpha", "2024-01-02"), (3, "", "2024-01-03")], "entry_id long, text string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp")))
    q = cache.entries(spark.createDataFrame([(9, "alpha beta gamma delta omega"), (8, "")], "query_id long, text string"))
    assert [(r["query_id"], r["entry_id"], r["sim"]) for r in cache.fuzzy(q, e).collect()] == [(9, 2, 0.8)]


def test_rrf_does_not_depend_on_list_order(spark):
    rows = [(1, 0, 1, "a"), (1, 0, 2, "b"), (1, 0, 3, "a"), (1, 1, 1, "b"), (1, 1, 2, "c"), (1, 1, 3, "")]
    flipped = [(q, 1 - k, r, u) for q, k, r, u in rows]
    get = lambda x: {r["url"]: r["rrf"] for r in retrieve.rrf_by_url(spark.createDataFrame(x, "query_id long, list_id int, rank int, url string")).collect()}
    assert get(rows) == get(flipped) == {"a": round(1 / 61, 5), "b": round(1 / 62 + 1 / 61, 5), "c": round(1 / 62, 5)}


def test_dedupe_is_idempotent(spark):
    rows = spark.createDataFrame([("a", 1, 3), ("a", 2, 5), ("a", 3, 5), ("", 4, 9), (None, 5, 9)], "k string, seq int, score int")
    best = curate.keep_best(rows, "k")
    assert [tuple(r) for r in best.collect()] == [tuple(r) for r in curate.keep_best(best, "k").collect()] == [("a", 2, 5)]


def test_decay_edges(spark):
    rows = spark.createDataFrame([("2024-02-14", 5), ("2024-02-13", 5), ("2023-12-16", 1), ("2023-12-15", 5), (None, 4)], "ts string, score int").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r["score"] for r in curate.decayed(rows, "2024-03-15").collect()) == [1, 2, 4, 5]


def test_short_documents_cross_boundaries(spark):
    docs = spark.createDataFrame([(1, list("ab")), (2, []), (3, list("c")), (4, list("defghijklmnop"))], "doc_id long, tokens array<string>")
    flat = [t for d in (list("ab"), list("c"), list("defghijklmnop")) for t in d]
    want = sorted((" ".join(flat[i : i + 3]), flat[i + 3]) for i in range(len(flat) - 3))
    assert sorted(map(tuple, ngram.crossing(docs, 3).collect())) == want


def test_ngram_file_round_trip(spark, tmp_path):
    table = spark.createDataFrame([([1, 2], 3, 5), ([1, 2], 4, 7), ([2, 3], 9, 1)], "ctx array<int>, next int, freq int")
    path = str(tmp_path / "t.bin")
    assert sinks.write_ngram_file(table, path, 2) == 2
    f = sinks.NgramFile(path)
    assert f.lookup([1, 2]) == [(4, 7), (3, 5)] and f.lookup([2, 3]) == [(9, 1)] and f.lookup([5, 5]) == []
    (tmp_path / "bad").write_bytes(b"xx")
    with pytest.raises(ValueError):
        sinks.NgramFile(str(tmp_path / "bad"))


def test_json_lines_count_bad_rows(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"prompt": "p", "response": "r"}\n\nnot json\n{"prompt": "q"}\n')
    good, bad = readers.json_lines(spark, str(tmp_path / "a.jsonl"), readers.TRAINING_PAIR)
    assert good.count() == 2 and bad.first()["bad"] == 1


def test_configuration_is_read_again(spark, tmp_path):
    import os

    path = tmp_path / "route.yaml"
    path.write_text("name: a\nenrich: {rag: true}\n")
    config = readers.Config(str(path))
    assert config.get() == {"name": "a", "enrich": {"rag": True}}
    path.write_text("name: b\n")
    os.utime(path, (2e9, 2e9))
    assert config.get() == {"name": "b"}


def test_sqlite_by_tasks(spark, tmp_path):
    """Databases of several tasks and writes, read in ranges of rows; nulls, deleted rows, empty tables and other databases."""
    import sqlite3

    folder = str(tmp_path / "logs")
    rows = [(i, None if i % 7 == 0 else f"é{i}", None if i % 5 == 0 else i / 4) for i in range(500)]
    frame = spark.createDataFrame(rows, "id long, name string, score double").repartition(3)
    assert sinks.write_sqlite(frame, f"file://{folder}", "told") == 500 and sinks.write_sqlite(frame.filter("id < 10"), folder, "told") == 10
    with sqlite3.connect(f"{folder}/other.db") as con:
        con.execute("CREATE TABLE x (y INTEGER)")
    got = readers.sqlite_table(spark, f"file://{folder}", "told", rows=37)
    assert got.dtypes == [("id", "bigint"), ("name", "string"), ("score", "double")]
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame(rows + rows[:10], got.schema).collect()))
    one = str(tmp_path / "one.db")
    with sqlite3.connect(one) as con:
        con.execute("CREATE TABLE t (a INTEGER, b VARCHAR(9))")
        con.executemany("INSERT INTO t VALUES (?, ?)", [(i, str(i)) for i in range(100)])
        con.execute("DELETE FROM t WHERE a % 2 = 0")
        con.execute("CREATE TABLE none (a INTEGER)")
    assert sorted(tuple(r) for r in readers.sqlite_table(spark, one, "t", rows=9).collect()) == [(i, str(i)) for i in range(1, 100, 2)]
    assert readers.sqlite_table(spark, one, "none").collect() == []
    for name, error in (("missing", "no table"), ("a; drop", "not a table")):
        with pytest.raises(ValueError, match=error):
            readers.sqlite_table(spark, one, name)


def test_many_csv_paths(spark, tmp_path):
    """The rules for one path, over many: against the check of the host."""
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    for name in ("a.csv", "b.CSV", "c.txt", "sub/d.csv", "e;f.csv", "100%.csv", "a+b c.csv"):
        (root / name).write_text("x")
    (tmp_path / "out.csv").write_text("x")
    names = ["a.csv", "b.CSV", "c.txt", "sub/d.csv", "sub/../a.csv", "./a.csv", "sub//d.csv", "../out.csv", "sub/../../out.csv", "e;f.csv", "g.csv", "", "..", "sub", "a.csv/..", "$x.csv", "100%.csv", "a+b c.csv"]
    files = file_index.listing(spark, f"file://{root}", "*")
    got = {r["path"]: r["allowed"] for r in readers.csv_files_allowed(spark.createDataFrame([(n,) for n in names], "path string"), files, f"file://{root}").collect()}
    assert got == {n: readers.csv_allowed(str(root / n), [str(root)]) for n in names}


def test_ngram_file_source(spark, tmp_path, monkeypatch):
    from corvina.sources import ngram_file

    monkeypatch.setattr(ngram_file, "SLOTS", 4)
    table = spark.createDataFrame([([1, 2], 3, 5), ([1, 2], 4, 7), ([2, 3], 9, 1)], "ctx array<int>, next int, freq int")
    path = str(tmp_path / "t.bin")
    sinks.write_ngram_file(table, path, 2)
    ngram_file.register(spark)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    got = {tuple(r) for r in spark.read.format("ngram_file").load(path).collect()}
    assert got == {(signed(sinks.fnv1a([1, 2])), 3, 5), (signed(sinks.fnv1a([1, 2])), 4, 7), (signed(sinks.fnv1a([2, 3])), 9, 1)}
    with pytest.raises(ValueError, match="contexts"):
        sinks.write_ngram_file(table, path, 2, most=1)


def test_text_corpus_and_snapshots(spark, tmp_path):
    (tmp_path / "kb/tech").mkdir(parents=True)
    (tmp_path / "kb/tech/a.md").write_text("# A\ntext")
    (tmp_path / "kb/b.bin").write_text("no")
    assert [(r["text"], r["collection"]) for r in readers.knowledge_base(spark, str(tmp_path / "kb"), {"tech": "science"}).collect()] == [("# A\ntext", "science")]
    root = str(tmp_path / "snap")
    collection.write(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), root)
    collection.upsert(spark, root, spark.createDataFrame([(2, "B"), (3, "c")], "id int, v string"), deleted=spark.createDataFrame([(1,)], "id int"))
    assert sorted(tuple(r) for r in collection.read(spark, root).collect()) == [(2, "B"), (3, "c")]


def test_sqlite_csv_channels(spark, tmp_path):
    import sqlite3

    with sqlite3.connect(tmp_path / "d.db") as con:
        con.execute("CREATE TABLE decisions (id INTEGER, route TEXT, score REAL)")
        con.execute("INSERT INTO decisions VALUES (1, 'code', 0.5)")
    assert readers.sqlite_table(spark, str(tmp_path / "d.db"), "decisions").first().asDict() == {"id": 1, "route": "code", "score": 0.5}
    (tmp_path / "x.csv").write_text("a")
    assert readers.csv_allowed(str(tmp_path / "x.csv"), [str(tmp_path)]) and not readers.csv_allowed(str(tmp_path / "x.csv;rm"), [str(tmp_path)]) and not readers.csv_allowed(str(tmp_path / "x.csv"), ["/nope"])


def test_verdicts(spark):
    assert [one(spark, d, monitor.verdict, "double") for d in (0.2, 0.0, -0.2, -0.21)] == ["keep", "neutral", "neutral", "revert"]


def test_ngram_file_layout_and_verification(spark, tmp_path):
    import struct

    table = spark.createDataFrame([([1, 2], 3, 5), ([1, 2], 4, 7)], "ctx array<int>, next int, freq int")
    path = str(tmp_path / "t.bin")
    sinks.write_ngram_file(table, path, 2)
    raw = (tmp_path / "t.bin").read_bytes()
    assert struct.unpack_from("<5I", raw) == (0x454E4752, 1, 2, 16, 1)
    h = sinks.fnv1a([1, 2])
    assert struct.unpack_from("<QII", raw, 20 + 16 * (h % 16)) == (h, 0, 12)
    assert struct.unpack_from("<5I", raw, 20 + 256) == (2, 4, 7, 3, 5) and len(raw) == 20 + 256 + 20
    assert sinks.verify_ngram_file(table, path) == 0
    assert sinks.verify_ngram_file(table.withColumn("freq", table["freq"] + 1), path) == 1


def counted(spark, name):
    from conftest import SF

    return spark.read.parquet(f"{SF}/{name}.parquet").count()


def result(spark, name):
    from conftest import SF

    from corvina.queries import QUERIES

    return QUERIES[name](spark, SF)


def test_contexts_hold_every_document(spark):
    blocks = [len(r["context"].split("\n---\n")) for r in result(spark, "context_assembly").collect()]
    assert sum(blocks) == counted(spark, "documents") and max(blocks) <= 25


def test_gates_decide_every_event(spark):
    assert result(spark, "gates_cooldown").count() == counted(spark, "events")


def test_rolling_week_of_every_event(spark):
    assert result(spark, "rolling_week").count() == counted(spark, "events")


def test_cache_holds_every_document(spark):
    assert [r["total"] for r in result(spark, "cache_stats").collect() if r["backend"] is None] == [counted(spark, "documents")]
    assert result(spark, "ttl_prune").filter("entry_id % 2 = 1").count() > 0


def test_whole_texts_are_accumulated(spark):
    from conftest import SF

    texts = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    for r in result(spark, "step_accumulation").collect():
        assert r["context"] == "\n\n".join(t for (c, n), t in sorted(texts.items()) if c == r["conv_id"] and n < r["turn"])


def test_notes_hold_whole_texts(spark):
    from conftest import SF

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(texts[r["doc_id"]].rstrip(" ") in r["plain"] for r in result(spark, "note_fields").collect())


def test_ngram_table_of_shards(spark, tmp_path):
    """Tasks write the shards; the header is put last, an older table is replaced, and files, lookups and the data source agree."""
    import os
    import random

    from corvina.sources import ngram_file

    r = random.Random(1)
    rows = {(r.randrange(40), r.randrange(40), r.randrange(99)): r.randrange(1, 50) for _ in range(3000)}
    table = spark.createDataFrame([([a, b], c, f) for (a, b, c), f in rows.items()], "ctx array<int>, next int, freq int")
    path = str(tmp_path / "table")
    os.makedirs(path)
    with pytest.raises(ValueError, match="no table.json"):
        ngram_file.NgramTable(path)
    ngram_file.write_table(table.limit(10), path, 2)
    old = [s["file"] for s in ngram_file.shards(path)]
    ngram_file.write_table(table, path, 2, shard=100)
    found = ngram_file.shards(path)
    assert len(found) > 4 and all(a["last"] < b["first"] for a, b in zip(found, found[1:], strict=False)) and not any(os.path.exists(f) for f in old)
    assert sorted(os.listdir(path)) == sorted([os.path.basename(s["file"]) for s in found] + ["table.json"])
    told = ngram_file.NgramTable(path)
    for a, b in [(1, 2), (39, 39), (40, 1), *{k[:2] for k in list(rows)[:200]}]:
        want = sorted(((c, f) for (x, y, c), f in rows.items() if (x, y) == (a, b)), key=lambda n: (-n[1], n[0]))
        assert told.lookup([a, b]) == want
    assert spark.read.format("ngram_file").load(path).count() == len(rows) and sinks.verify_ngram_file(table, path, 500) == 0
    ngram_file.write_table(table.limit(0), path, 2)
    assert spark.read.format("ngram_file").load(path).count() == 0 and ngram_file.shards(path) == []


def test_collection_readers_between_the_steps(spark, tmp_path, monkeypatch):
    """A reader between any two steps of a writer finds the version before, whole; what it began to read stays."""
    root = f"file://{tmp_path}/c"
    frame = lambda *ids: spark.createDataFrame([(i, f"v{i}") for i in ids], "id int, v string")
    ids = lambda **k: sorted(r["id"] for r in collection.read(spark, root, **k).collect())
    with pytest.raises(ValueError, match="no version"):
        ids()
    assert collection.write(frame(1, 2), root) == 1 and ids() == [1, 2]
    begun = collection.read(spark, root)
    put, seen = collection._put, []

    def spy(*a):
        seen.append(ids())  # data is written, the manifest is not
        put(*a)
        seen.append(ids())

    monkeypatch.setattr(collection, "_put", spy)
    assert collection.append(frame(3), root) == 2 and seen == [[1, 2], [1, 2, 3]]
    monkeypatch.setattr(collection, "_put", put)
    # a manifest that is half written is not the latest
    (tmp_path / "c/manifests/00000003.json").write_text('{"version": 3')
    assert ids() == [1, 2, 3]
    assert collection.upsert(spark, root, frame(2, 9), deleted=frame(1)) == 4 and ids() == [2, 3, 9] and ids(version=1) == [1, 2]
    assert sorted(r["id"] for r in begun.collect()) == [1, 2]
    assert collection.rewrite(spark, root, lambda rows: rows.filter("id > 2"), "expired") == 5 and ids() == [3, 9]
    assert ids(as_of="2999-01-01 00:00:00") == [3, 9]
    gone = collection.vacuum(spark, root, keep=1)
    assert len(gone) == 3 and ids() == [3, 9]  # of the first write, the append and the upsert
    with pytest.raises(ValueError, match="such version"):
        ids(version=1)
    collection.write(frame(), root)
    assert ids() == [] and collection.read(spark, root).columns == ["id", "v"]


def test_collection_writers_do_not_lose_each_others_rows(spark, tmp_path, monkeypatch):
    """Of two writers of one version one is refused, and writes on what the other wrote."""
    root = f"file://{tmp_path}/c"
    frame = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id int")
    collection.write(frame(1), root)
    put, others = collection._put, [lambda: collection.append(frame(50), root)]

    def late(*a):
        if others:
            others.pop()()
        put(*a)

    monkeypatch.setattr(collection, "_put", late)
    assert collection.upsert(spark, root, frame(2)) == 3
    assert sorted(r["id"] for r in collection.read(spark, root).collect()) == [1, 2, 50]
