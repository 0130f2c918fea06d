r"""Delta Lloyd: k-means on integer vectors that carries assignments and sums from round to round.

Components become integers floor(SCALE * x), so every sum and squared distance is exact and no result depends on how rows are
dealt.  Each round

1. compares a vector with the centroids that changed since the last round; with all of them only where its own centroid
   moved away from it (else every unchanged centroid is still no nearer than its own);
2. writes the assignment (owner, distance, former owner) beside the integer vector: the table of the next round;
3. lets the vectors whose owner changed transfer their components, minus to the former owner and plus to the new one.  Tasks
   add these up before anything is shuffled, so k * dims numbers a task travel, and they are added to the global sums.

The sums (k * dims whole numbers) are written with each round too.  The driver holds k centroids, never vectors.

Vectors that are null, of another length, or with null or non-finite components are left out.  Components beyond LARGEST are
taken as LARGEST, as squared distances would leave 64 bits.  Rows that repeat are vectors of their own.  Where ids
repeat, the first centroids are ordered by the vector after the hash; a null id counts as empty in it.  With fewer than k vectors there
are as many centroids as vectors; an empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, saved
from .vectors import integer_vectors

SCALE, ROUNDS, CLUSTERS, DIMS, SEED = 64, 3, 16, 64, 1
#: A component's bound: differences of 2^28 squared and added over 64 dimensions stay below 2^63.
LARGEST = 1 << 27
#: Up to this bound doubles add the products of one distance exactly, at 64 dimensions (2^46 * 64 = 2^52).
EXACT = 1 << 22
#: Vectors to a step of a task.
STEP = 8_192

_STATE = "id long, v array<int>, owner int, distance long, former int"


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors of the k smallest hashes of ``seed:id``, in the order of the hashes."""
    named = vectors.withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256))
    return np.array([r["v"] for r in named.orderBy("hash", "v").limit(k).collect()], np.int64)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``v`` to each centroid, both whole numbers."""
    if max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) * max(1.0, (v.shape[1] / 64) ** 0.5) <= EXACT:
        a, c = v.astype(np.float64), centroids.astype(np.float64)  # every sum is a whole number below 2^53
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
    return np.stack([((v - c) ** 2).sum(1) for c in centroids], 1)


def reassigned(v: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and distances under ``centroids``, of which ``changed`` (flags) are not those of the last round; owner -1: none yet."""
    owner, distance = owner.copy(), distance.copy()
    which = np.flatnonzero(changed)
    if not len(which):
        return owner, distance
    near = distances(v, centroids[which])
    place = np.full(len(centroids), -1)
    place[which] = np.arange(len(which))
    moved = (owner >= 0) & changed[np.maximum(owner, 0)]
    now = np.where(moved, near[np.arange(len(v)), np.maximum(place[owner], 0)], distance)
    whole = (owner < 0) | (moved & (now > distance))  # the own centroid went away: any may be nearer now
    distance = now
    if whole.any():
        every = distances(v[whole], centroids)
        owner[whole] = every.argmin(1)  # the smaller number of equals
        distance[whole] = every.min(1)
    rest = ~whole
    if rest.any():
        best, least = which[near[rest].argmin(1)], near[rest].min(1)
        nearer = (least < distance[rest]) | ((least == distance[rest]) & (best < owner[rest]))
        at = np.flatnonzero(rest)[nearer]
        owner[at], distance[at] = best[nearer], least[nearer]
    return owner, distance


def _assigner(centroids: np.ndarray, changed: np.ndarray):
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for a in range(0, batch.num_rows, STEP):
                part = batch.slice(a, STEP)
                former = part.column("owner").to_numpy().astype(np.int64)
                owner, distance = reassigned(_matrix(part.column("v"), dims), former, part.column("distance").to_numpy().astype(np.int64), centroids, changed)
                columns = [part.column("id"), part.column("v"), pa.array(owner, pa.int32()), pa.array(distance), pa.array(former, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "v", "owner", "distance", "former"])

    return run


def _transfers(k: int, dims: int):
    """What a task's vectors bring to and take from each centroid, as one row each: cluster, members, sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        sums, members = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            v = _matrix(batch.column("v"), dims)
            for column, sign in (("owner", 1), ("former", -1)):
                at = batch.column(column).to_numpy()
                for c in np.unique(at[at >= 0]):
                    some = at == c
                    sums[c] += sign * v[some].sum(0)
                    members[c] += sign * int(some.sum())
        some = np.flatnonzero(members.astype(bool) | sums.any(1))
        values = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(some) + 1) * dims, dims), pa.int32()), pa.array(sums[some].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(members[some]), values], ["cluster", "members", "sums"])

    return run


def transferred(state: DataFrame, k: int, dims: int) -> list:
    """Rows (cluster, members, sums) of the signed transfers of all vectors whose owner changed: k rows at most."""
    rows = state.filter("owner <> former").select("v", "owner", "former").mapInArrow(_transfers(k, dims), "cluster int, members long, sums array<long>")
    flat = rows.select("cluster", F.posexplode(F.array_append("sums", F.col("members"))).alias("dim", "x"))
    flat = flat.groupBy("cluster", "dim").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    every = flat.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("sums"))
    return every.select("cluster", F.col("sums.x").alias("sums")).collect()


def delta_lloyd(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """The last assignment (id, v, owner, distance, former) and the final centroids of ``vectors`` (id, v)."""
    spark = vectors.sparkSession
    state = saved(vectors.withColumns({"owner": F.lit(-1), "distance": F.lit(0).cast("long"), "former": F.lit(-1)}), "vectors")
    centroids = first_centroids(state.select("id", "v"), k, seed)
    if not len(centroids):
        return state, centroids
    k, dims = centroids.shape
    changed, sums, members = np.ones(k, bool), [[0] * dims for _ in range(k)], [0] * k
    for _ in range(rounds):
        state = saved(state.mapInArrow(_assigner(centroids, changed), _STATE), "assigned")
        for c, moved in ((r["cluster"], [int(x) for x in r["sums"]]) for r in transferred(state, k, dims)):
            sums[c] = [a + b for a, b in zip(sums[c], moved[:-1], strict=True)]
            members[c] += moved[-1]
        saved(spark.createDataFrame([(c, members[c], [str(x) for x in sums[c]]) for c in range(k)], "cluster int, members long, sums array<string>"), "sums")
        after = np.array([[x // members[c] for x in sums[c]] if members[c] else centroids[c].tolist() for c in range(k)], np.int64)
        changed = (after != centroids).any(1)
        centroids = after
    return saved(state.mapInArrow(_assigner(centroids, changed), _STATE), "assigned"), centroids


def clusters(rows: DataFrame, ids: str = "vec_id", vectors: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, seed: int = SEED) -> DataFrame:
    """Per usable vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid (array<long>)."""
    state, centroids = delta_lloyd(integer_vectors(rows, ids, vectors, SCALE, LARGEST, "v", dims), k, rounds, seed)
    per = state.groupBy("owner").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    whole = sum(int(r["d"]) for r in per)
    most = (1 << 63) - 1
    about = [(r["owner"], min(int(r["d"]), most), min(whole, most), centroids[r["owner"]].tolist()) for r in per]
    about = rows.sparkSession.createDataFrame(about, "owner int, cluster_inertia long, inertia long, centroid array<long>")
    # one row for each centroid
    out = state.join(F.broadcast(about), "owner")
    return out.select(F.col("id").alias("vec_id"), F.col("owner").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid")


def centroid_digest(centroid) -> str:
    """Lowercase hex SHA-256 of the components as decimal integers joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()
