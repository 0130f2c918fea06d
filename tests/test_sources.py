"""The incremental file index, and n-gram counts over token ids against those over words."""

import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvina.operators import coded_ngram, ngram
from corvina.sources import collection, file_index, sinks


def lines(c):
    return F.filter(F.split(c, "\n"), lambda x: x != "")


def test_file_index_follows_changes(spark, tmp_path, monkeypatch):
    folder, root = tmp_path / "kb", f"file://{tmp_path}/index"
    (folder / "sub").mkdir(parents=True)
    run = lambda: file_index.refresh(spark, f"file://{folder}", root, lines)
    held = lambda: sorted((os.path.basename(r["path"]), r["chunk_idx"], r["chunk"]) for r in collection.read(spark, root).collect())
    (folder / "a.md").write_text("one\ntwo")
    (folder / "sub/b.txt").write_bytes(b"caf\xc3\xa9 \xff")
    (folder / "empty.md").write_text("\n")
    (folder / "no.pdf").write_text("x")
    assert run() == {"NEW": 3, "CHANGED": 0, "DELETED": 0, "SAME": 0}
    assert held() == [("a.md", 0, "one"), ("a.md", 1, "two"), ("b.txt", 0, "café �"), ("empty.md", None, None)]
    version = collection.latest(spark, root)[0]
    # a run that is repeated puts no version
    assert run() == {"NEW": 0, "CHANGED": 0, "DELETED": 0, "SAME": 3} and collection.latest(spark, root)[0] == version
    time.sleep(1.1)
    (folder / "a.md").write_text("two\nthree")
    (folder / "c.md").write_text("new")
    os.utime(folder / "c.md", (1, 1))  # new to the index, though older than what it has
    (folder / "sub/b.txt").unlink()
    # a run that fails before its version leaves the one before; run again it leaves no row twice
    real = collection.rewrite
    monkeypatch.setattr(collection, "rewrite", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        run()
    assert len(held()) == 4
    monkeypatch.setattr(collection, "rewrite", real)
    assert run() == {"NEW": 1, "CHANGED": 1, "DELETED": 1, "SAME": 1}
    assert held() == [("a.md", 0, "two"), ("a.md", 1, "three"), ("c.md", 0, "new"), ("empty.md", None, None)]
    assert run()["SAME"] == 3


def token_rows(spark, seed=1):
    r = random.Random(seed)
    texts = [[r.choice(["a", "b", "être", "longer-word", "", None, "日本"]) for _ in range(r.randrange(60))] for _ in range(200)]
    return spark.createDataFrame([(i % 150, t) for i, t in enumerate([*texts, None, [], ["x"] * 5, ["x"] * 6])], "doc_id long, tokens array<string>").repartition(3)


@pytest.mark.parametrize("bound", [1_000_000, 3])
@pytest.mark.parametrize("order", [1, 3, 5])
def test_coded_counts_equal_those_of_words(spark, monkeypatch, bound, order):
    monkeypatch.setattr(coded_ngram, "WORDS", bound)
    docs = token_rows(spark)
    words = coded_ngram.dictionary(docs)
    table = words.orderBy("id").collect()
    assert [r["id"] for r in table] == list(range(len(table))) and [r["word"] for r in table] == sorted(r["word"] for r in table)
    got = coded_ngram.decoded(coded_ngram.counts(docs, words, order), coded_ngram.contexts(docs, words, order), words, order)
    filled = docs.withColumn("tokens", F.transform("tokens", lambda w: F.coalesce(w, F.lit(""))))
    want = ngram.counts(ngram.windows(filled, order))
    assert sorted(map(tuple, got.select("ctx", "next", "freq").collect())) == sorted(map(tuple, want.select("ctx", "next", "freq").collect()))


def test_hashes_are_fnv1a():
    ids = np.array([0, 1, 2**32 - 1, 77, 123456, 5])
    assert coded_ngram.hashes(ids, 5).tolist() == [sinks.fnv1a(ids[i : i + 5].tolist()) for i in range(2)]
    assert len(coded_ngram.hashes(ids[:3], 5)) == 0


def shuffled(spark, rows):
    """Bytes that the stages of an action shuffled."""
    store = spark.sparkContext._jsc.sc().statusStore()
    total = lambda: sum(s.shuffleWriteBytes() for s in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)))
    before = total()
    rows.write.format("noop").mode("overwrite").save()
    time.sleep(1)
    return total() - before


def test_coded_counts_shuffle_less(spark):
    """Two fifths of the bytes, as compressed: what is left is the hash."""
    from conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", ngram.tokens(F.col("text")).alias("tokens"))
    words = coded_ngram.dictionary(docs)
    coded, plain = shuffled(spark, coded_ngram.counts(docs, words)), shuffled(spark, ngram.counts(ngram.windows(docs)))
    assert 0 < coded < 0.45 * plain
