"""Stateful streams against their batch forms, over micro-batches in odd order."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from corvina.functions import scoring as sc
from corvina.operators import monitor
from corvina.session import scratch_folder
from corvina.streaming import monitor as streams
from corvina.streaming import stateful

CHUNK = "request string, seq long, reasoning string, content string, tokens array<struct<logprob:double,top:array<double>>>"


def chunks(seed=1, requests=6):
    """Answers of many chunks: thinking, content, thinking again; sure and unsure tokens, none, and empty lists."""
    r, rows = random.Random(seed), []
    for q in range(requests):
        for seq in range(40):
            token = lambda: (-r.random() * (0.1 if r.random() < 0.1 * q else 4), sorted((-r.random() * 6 for _ in range(r.randrange(1, 6))), reverse=True) if r.random() > 0.1 else [])
            said = r.random()
            rows.append((f"r{q}", seq, "x" * r.randrange(9) if said < 0.8 else None, "y" if said > 0.7 and seq > 25 else "", [token() for _ in range(r.randrange(4))] if r.random() > 0.1 else None))
    return rows


def loop(rows, threshold, window, least):
    """The loop over the chunks of a request, one after the other."""
    import math

    out = {}
    for q in {x[0] for x in rows}:
        win, halted, thinks, n, mean = [], False, False, 0, None
        for _, seq, reasoning, content, tokens in sorted((x for x in rows if x[0] == q), key=lambda x: x[1]):
            if reasoning:
                thinks, n = True, n + len(reasoning)
            if content:
                thinks = False
            if not halted and thinks and n >= least:
                for logprob, top in tokens or []:
                    if not top or halted:
                        continue
                    p = [math.exp(x) for x in top]
                    p = [x / sum(p) for x in p]
                    most = math.log(len(p) + 1e-10)
                    norm = -sum(x * math.log(x + 1e-10) for x in p) / most if most > 0 else 0.0
                    win = (win + [0.625 * math.exp(logprob) + 0.375 * (1 - norm)])[-window:]
                    if len(win) == window:
                        mean = sum(win) / window
                        halted = mean > threshold
            out[q, seq] = (None if mean is None else round(mean, 9), halted)
    return out


def told(rows):
    return {(r["request"], r["seq"]): (None if r["mean"] is None else round(r["mean"], 9), r["halted"]) for r in rows}


@pytest.mark.parametrize(("threshold", "window", "least"), [(0.55, 5, 100), (0.4, 3, 10), (2.0, 5, 0)])
def test_batch_certainty_equals_the_loop(spark, threshold, window, least):
    got = sc.halted_stream(spark.createDataFrame(chunks(), CHUNK).repartition(3), "request", "seq", threshold, window, least)
    assert told(got.collect()) == loop(chunks(), threshold, window, least)


def test_certainty_uses_the_tokens_own_probability(spark):
    """A token that was not the likeliest: its own log probability counts, not the largest of the renormalised ones."""
    row = spark.createDataFrame([(-3.0, [-0.1, -3.0])], "logprob double, top array<double>").select(sc.step_certainty(F.col("logprob"), F.col("top")).alias("c")).first()
    assert row["c"] == pytest.approx(stateful.token_certainty(-3.0, [-0.1, -3.0])) and row["c"] < 0.5


@pytest.mark.parametrize("seed", [1, 2])
def test_certainty_stream_in_odd_order(spark, seed):
    """Shuffled micro-batches, some chunks twice: each chunk is told once, as in the loop."""
    stateful.prepared(spark)
    rows = chunks()
    shuffled = [*rows, *rows[::7]]
    random.Random(seed).shuffle(shuffled)
    path = scratch_folder(spark, "chunks")
    for k in range(3):
        spark.createDataFrame(shuffled[k::3], CHUNK).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", 1).parquet(path)
    out = streams.run_once(stateful.certainty(stream, "request", 0.4, 3, 10), scratch_folder(spark, "told"), scratch_folder(spark, "state"))
    got = out.collect()
    assert len(got) == len(rows) and told(got) == loop(rows, 0.4, 3, 10)


EVENT = "id long, agent string, pattern string, ts timestamp, kind string"


def events(n=400, seed=3):
    r, at, rows = random.Random(seed), datetime.datetime(2024, 1, 1), []
    for i in range(n):
        at += datetime.timedelta(minutes=r.choice([0, 0, 20, 90, 300]))
        kind = r.choice(["proposal", "proposal", "judgement", "judgement", "judgement", "patch", "revert"])
        rows.append((i, r.choice("ab"), r.choice(["Too Long answers, always and everywhere", "wrong tone", "x", None]) if kind != "judgement" else None, at, kind))
    return [(i, a, f"seen: {p} again" if kind == "revert" and p else p, t, kind) for i, a, p, t, kind in rows]


def test_gates_stream_equals_batch(spark):
    stateful.prepared(spark)
    rows = events()
    path = scratch_folder(spark, "events")
    for k in range(0, len(rows), 100):
        part = rows[k : k + 100]
        # a batch ends between two times, and has any order within
        random.Random(k).shuffle(part)
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(path)
    settings = {"daily": 3, "least": 4, "days": 2, "reverts": 2}
    out = streams.run_once(stateful.gates(stream, 3600, **settings), scratch_folder(spark, "told"), scratch_folder(spark, "state"))
    got = {r["id"]: r["gate"] for r in out.collect()}
    every = spark.createDataFrame(rows, EVENT)
    runs = every.filter("kind in ('patch', 'revert')").withColumns({"patched": F.col("kind") == "patch", "reverted": F.col("kind") == "revert"})
    batch = monitor.gates(every.filter("kind = 'proposal'").drop("kind"), runs.drop("kind", "id"), every.filter("kind = 'judgement'"), cooldown="1 hour", **settings)
    want = {r["id"]: r["gate"] for r in batch.collect()}
    assert got == want and set(want.values()) == {"cooldown", "cap", "judgements", "blocked", "run"}
