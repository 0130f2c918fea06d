"""Clustering and whitening against plain numpy and whole numbers; null, non-finite, repeated, tied and missing vectors."""

import hashlib
import random

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from corvina.llm import centroids, queries, whitening

ROWS = "vec_id long, embedding array<float>, label int, id long, v string, owner int, x string, component int, deviation string"


def odd_vectors(n=400, dims=64, seed=3):
    """Vectors around a few centres, a very common one, and rows that are not usable; extra columns have the operators' names."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(7, dims))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 7] + r.normal(scale=0.3, size=dims)]) for i in range(n)]
    common = rows[5][1]
    rows += [(1000 + i, common) for i in range(n // 2)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[6][1]), (77, [0.0] * dims), (78, [-0.0] * dims)]
    unusable = [(2000, None), (2001, []), (2002, [1.0] * (dims - 1)), (2003, [None] + [1.0] * (dims - 1)), (2004, [float("nan")] + [1.0] * (dims - 1)), (2005, [float("inf")] * dims)]
    return rows, unusable


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 1, 9, "a", 4, "b", 2, "c") for i, e in rows], ROWS).repartition(5)


def brute_lloyd(rows, k=16, rounds=3):
    v = [(i, [int(np.floor(64.0 * x)) for x in e]) for i, e in rows]
    first = sorted(v, key=lambda p: (hashlib.sha256(f"1:{'' if p[0] is None else p[0]}".encode()).hexdigest(), p[1]))[:k]
    cent = np.array([p[1] for p in first], np.int64)
    m = np.array([p[1] for p in v], np.int64)
    for turn in range(rounds + 1):
        d = ((m[:, None, :] - cent[None]) ** 2).sum(2)
        own = d.argmin(1)
        if turn < rounds:
            cent = np.array([[int(s) // int((own == c).sum()) for s in m[own == c].sum(0)] if (own == c).any() else cent[c] for c in range(len(cent))])
    best = d.min(1)
    return sorted((str(i), int(o), int(b), int(best[own == o].sum()), int(best.sum()), cent[o].tolist()) for (i, _), o, b in zip(v, own, best, strict=True))


def found_clusters(df):
    return sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid"]) for r in df.collect())


def test_clusters_odd_rows(spark):
    rows, unusable = odd_vectors()
    assert found_clusters(centroids.clusters(frame(spark, rows + unusable))) == brute_lloyd(rows)


def test_clusters_of_few_none_and_equal_vectors(spark):
    rows, unusable = odd_vectors()
    assert found_clusters(centroids.clusters(frame(spark, rows[:3]))) == brute_lloyd(rows[:3])
    assert centroids.clusters(frame(spark, unusable)).collect() == []
    assert centroids.clusters(frame(spark, rows).filter("vec_id < -1")).collect() == []
    equal = [(i, rows[0][1]) for i in range(40)]
    got = found_clusters(centroids.clusters(frame(spark, equal)))
    assert got == brute_lloyd(equal) and {r[1] for r in got} == {0}


def test_clusters_query(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    got = sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in queries.op11_centroids(spark, SF).collect())
    assert got == [(*r[:5], centroids.centroid_digest(r[5])) for r in brute_lloyd([(r["vec_id"], r["embedding"]) for r in table])]


def test_many_rounds_by_delta(spark):
    """After many rounds few centroids change, and sums of transfers are the sums of the members."""
    rows, _ = odd_vectors(200)
    assert found_clusters(centroids.clusters(frame(spark, rows), rounds=7, k=5)) == brute_lloyd(rows, 5, 7)


@pytest.mark.parametrize("seed", range(8))
def test_reassigned_equals_full_comparison(seed):
    """Centroids that move, stay and tie: owner and distance are those of a comparison with all."""
    r = np.random.default_rng(seed)
    v = r.integers(-4, 5, (300, 3))
    cent = r.integers(-4, 5, (9, 3))
    own, dist = centroids.reassigned(v, np.full(300, -1), np.zeros(300, np.int64), cent, np.ones(9, bool))
    for _ in range(6):
        after = cent.copy()
        some = r.random(9) < 0.4
        after[some] += r.integers(-2, 3, (int(some.sum()), 3))
        own, dist = centroids.reassigned(v, own, dist, after, (after != cent).any(1))
        cent = after
        every = ((v[:, None] - cent[None]) ** 2).sum(2)
        assert (own == every.argmin(1)).all() and (dist == every.min(1)).all()


def test_distances_beyond_doubles():
    big = centroids.LARGEST
    v, c = np.array([[big, -big, 7], [big - 1, 5, 6]]), np.array([[-big, big, 1], [big, 4, 4]])
    assert centroids.distances(v, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)) for y in c] for x in v]


def test_only_moved_vectors_are_transferred(spark, monkeypatch):
    """Each round's transfers come from the vectors whose owner changed."""
    rows, _ = odd_vectors(300)
    seen, real = [], centroids.transferred

    def spy(state, k, dims):
        seen.append((state.count(), state.filter("owner <> former").count()))
        return real(state, k, dims)

    monkeypatch.setattr(centroids, "transferred", spy)
    centroids.clusters(frame(spark, rows), k=6, rounds=5).collect()
    assert seen[0][0] == seen[0][1] and seen[-1][1] < seen[-1][0] / 4


def brute_whitening(rows, components=4):
    xs = [(i, [int(np.floor(256.0 * c)) for c in e]) for i, e in rows]
    fit = sorted({tuple(x) for _, x in xs})
    n, dims = len(fit), len(fit[0])
    s = [sum(x[d] for x in fit) for d in range(dims)]
    centred = np.array(fit, np.float64) - np.array([a / n for a in s])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    out = {}
    for i, x in xs:
        dev = sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
        for c in range(min(components, dims)):
            w = (np.array(x) - np.array([a / n for a in s])) @ vectors[:, -1 - c] / np.sqrt(values[-1 - c])
            out.setdefault((i, c + 1), []).append((n, dev, abs(w), values[-1 - c] / np.trace(cov)))
    return out


def check_whitening(got, want):
    found = {}
    for r in got:
        found.setdefault((r["vec_id"], r["component"]), []).append((r["n"], int(r["deviation"]), abs(r["whitened"]), r["explained"]))
        assert r["identity_error"] <= 1e-9
    assert found.keys() == want.keys()
    for key, rows in want.items():
        for a, b in zip(sorted(found[key]), sorted(rows), strict=True):
            assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-7, abs=1e-9) and a[3] == pytest.approx(b[3], rel=1e-9)


def test_whitening_odd_rows(spark):
    rows, unusable = odd_vectors()
    check_whitening(whitening.whitening(frame(spark, rows + unusable)).collect(), brute_whitening(rows))


def test_whitening_query(spark):
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = queries.op12_whitening(spark, SF)
    assert dict(got.dtypes)["deviation"] == "bigint"
    check_whitening(got.collect(), brute_whitening(table))


def test_whitening_signs_are_one(spark):
    """The sign of a component is the same for all rows, so whitened values have the covariance of the identity."""
    rows, _ = odd_vectors(300)
    got = whitening.whitening(frame(spark, rows)).filter("vec_id < 300").select("vec_id", "component", "whitened").distinct().groupBy("vec_id").pivot("component").agg(F.first("whitened")).collect()
    w = np.array([[r[str(c)] for c in range(1, 5)] for r in got])
    off = np.corrcoef(w.T) - np.eye(4)
    assert np.abs(off).max() < 0.1


def test_whitening_without_variance(spark):
    rows, unusable = odd_vectors()
    assert whitening.whitening(frame(spark, unusable[:2])).collect() == []
    assert whitening.whitening(frame(spark, rows).filter("vec_id < -1")).collect() == []
    one = whitening.whitening(frame(spark, [(1, rows[0][1]), (2, rows[0][1])])).collect()
    assert len(one) == 8 and {(r["n"], int(r["deviation"]), r["whitened"], r["explained"]) for r in one} == {(1, 0, None, 0.0)}
    line = whitening.whitening(frame(spark, [(k, [float(k)] * 8) for k in range(10)])).collect()
    assert {r["component"] for r in line if r["whitened"] is not None} == {1} and max(r["identity_error"] for r in line) < 1e-9


def test_whitening_of_large_entries(spark):
    """Sums beyond 64 bits are decimals; entries beyond the bound are the bound."""
    r = random.Random(1)
    rows = [(k, [r.uniform(-8e6, 8e6) for _ in range(3)]) for k in range(300)]
    rows = [(k, [float(np.float32(x)) for x in e]) for k, e in rows]
    check_whitening(whitening.whitening(frame(spark, rows)).collect(), brute_whitening(rows, 3))
    assert whitening.whitening(frame(spark, [*rows, (900, [3e38, -3e38, 0.0])])).count() == 903


def test_whitening_mixed_lengths(spark):
    rows = [(k, [float(k % 7), float(k % 5)]) for k in range(20)]
    got = whitening.whitening(frame(spark, [*rows, (99, [1.0, 2.0, 3.0])])).collect()
    check_whitening(got, brute_whitening(rows))
