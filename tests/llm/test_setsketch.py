"""SetSketch registers against their definition, and near-duplicate classes against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvina.llm import ngram_join, setsketch
from corvina.llm import textbytes as tb


def words(n, seed, size=400):
    r = random.Random(seed)
    return [f"w{r.randrange(size)}" for _ in range(n)]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def brute(rows):
    """doc_id -> sizes of its sets, smallest doc_id reachable."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def found(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit(v) for c, v in more.items()})
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in setsketch.near_duplicates(docs).collect())


def random_sets(sizes, seed=0):
    r = np.random.default_rng(seed)
    return [r.integers(1, 2**63, n, dtype=np.uint64) for n in sizes]


def test_registers_are_truncated_minima():
    """Each register is the exponent of the least value that the series of any element has there."""
    for n in (1, 2, 7, 60):
        tokens = random_sets([n], n)[0]
        got = setsketch.registers(tokens, np.array([n]))[0]
        least = [float("inf")] * setsketch.M
        for t in tokens:
            seed = int(tb.mix(np.array([t ^ tb.LANES[3]]))[0])
            for j in range(setsketch.M):
                at = ((seed >> 32) + ((seed & 0xFF) | 1) * j) % setsketch.M
                h = int(tb.mix(np.array([t + np.uint64(j + 1) * tb.BASE], np.uint64))[0]) >> 8
                place = min(((j << 56 | h) + 0.5) / 2**64, 1 - 2**-53)
                least[at] = min(least[at], -np.log1p(-place) / setsketch.RATE)
        assert got.tolist() == [int(np.floor(1 - np.log(x) / np.log(setsketch.B))) for x in least]


def test_registers_merge_and_do_not_depend_on_order_or_steps(monkeypatch):
    a, b = random_sets([700, 90], 4)
    union = np.unique(np.concatenate([a, b, a[:5]]))
    ra, rb = setsketch.registers(a, np.array([700]))[0], setsketch.registers(b, np.array([90]))[0]
    both = setsketch.registers(union, np.array([len(union)]))[0]
    assert (setsketch.merged(ra, rb) == both).all()
    assert (setsketch.registers(union[::-1].copy(), np.array([len(union)]))[0] == both).all()
    several = setsketch.registers(np.concatenate([a, b]), np.array([700, 0, 90]))
    assert (several[0] == ra).all() and (several[2] == rb).all() and not several[1].any()
    monkeypatch.setattr(setsketch, "STEP", 64)
    assert (setsketch.registers(union, np.array([len(union)]))[0] == both).all()


def pair(n, similarity, seed, ratio=1.0):
    """Two sets of about the given similarity, and what it is."""
    every = random_sets([4 * n], seed)[0]
    common = round(similarity * n * (1 + ratio) / (1 + similarity))
    a, b = every[:n], np.concatenate([every[:common], every[n : n + round(n * ratio) - common]])
    return a, b, common / (n + len(b) - common)


@pytest.mark.parametrize("n", [5, 40, 300, 3000])
@pytest.mark.parametrize("similarity", [0.2, 0.5, 0.8, 0.95])
def test_estimate_and_agreement(n, similarity):
    """Registers agree about as often as sets are similar, and the likelihood finds the similarity."""
    agree, estimates, true = [], [], []
    for seed in range(40):
        a, b, j = pair(n, similarity, seed, 0.9 if n > 40 else 1.0)
        r = setsketch.registers(np.concatenate([a, b]), np.array([len(a), len(b)])).astype(int)
        agree.append((r[0] == r[1]).mean())
        more, less = (np.array([x.sum()]) for x in (r[0] > r[1], r[0] < r[1]))
        estimates.append(setsketch.estimate(more, less, np.array([float(len(a))]), np.array([float(len(b))]))[0])
        true.append(j)
    assert abs(np.mean(agree) - np.mean(true)) < 0.03
    assert abs(np.mean(estimates) - np.mean(true)) < 0.03 and np.std(np.array(estimates) - true) < 0.05


def test_pairs_at_the_threshold_share_a_band_and_are_possible():
    rows = {}
    for seed in range(1500):
        for similarity in (0.8, 0.4):
            a, b, j = pair(random.Random(seed).choice([9, 18, 90, 360]), similarity, seed)
            r = setsketch.registers(np.concatenate([a, b]), np.array([len(a), len(b)]))
            keys = setsketch.band_keys(r)
            rows.setdefault(j >= 0.8, []).append(((keys[0] == keys[1]).any(), setsketch.possible(r[:1], r[1:], np.array([len(a)]), np.array([len(b)]))[0]))
    assert np.all(rows[True]) and len(rows[True]) > 500
    assert np.mean([p for s, p in rows[False] if s]) < 0.5


def odd_rows():
    base = words(300, 1)
    near = []
    for k in range(12):
        w = list(base)
        for i in random.Random(k).sample(range(300), 3 + k):
            w[i] = f"n{k}_{i}"
        near.append(" ".join(w))
    shared = " ".join(words(60, 2))
    texts = [None, "", " \n\t", "one two", "One  TWO", "one two three", "one two three four", *near, " ".join(base), " ".join(base).upper(), *[f"{' '.join(words(30, 50 + k))} {shared}" for k in range(20)], " ".join(words(9000, 3)), "émail: x@y.zz 🙂 1.2.3.4", "x" * 30000]
    return [(i + 10, t) for i, t in enumerate(texts)] + [(1000, near[0]), (1001, near[0])]


def test_odd_rows(spark):
    assert found(spark, odd_rows(), key=1, doc="x", n=2, sig="y", registers=3, own=4, component_id=5, kept="z") == brute(odd_rows())


def test_no_rows_and_no_ids(spark):
    assert found(spark, []) == []
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (5, "a b c d e f"), (None, None)]
    got = setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(4, 3, 4, True), (5, 3, 4, False), (None, 3, None, True), (None, 0, None, True)], key=str)


@pytest.mark.parametrize("pivots", [0, 3])
def test_groups_and_chains(spark, monkeypatch, pivots):
    """Chains of near copies, groups that share half of their words, and sets of every small size; with and without pivot rounds, in blocks of two."""
    monkeypatch.setattr(ngram_join, "PIVOT_ROUNDS", pivots)
    monkeypatch.setattr(setsketch, "BLOCK", 2)
    r, rows = random.Random(5), []
    for g in range(40):
        w = words(r.randrange(4, 90), g, 60)
        for _ in range(8):
            w = list(w)
            for _ in range(r.randrange(3)):
                w[r.randrange(len(w))] = f"z{r.randrange(50)}"
            rows.append((len(rows), " ".join(w)))
    stock = " ".join(words(60, 99))
    rows += [(len(rows) + k, f"{stock} {' '.join(words(40, 700 + k, 5000))}") for k in range(40)]
    assert found(spark, rows) == brute(rows)


def test_one_id_with_several_texts(spark):
    """A document has the links of each of its texts."""
    a, b, c = " ".join(words(50, 1)), " ".join(words(50, 2)), " ".join(words(50, 3))
    rows = [(5, a), (5, b), (3, a), (9, b), (7, c), (7, c)]
    assert found(spark, rows) == [(3, 47, 3, True), (5, 47, 3, False), (5, 47, 3, False), (7, 47, 7, True), (7, 47, 7, True), (9, 47, 3, False)]
