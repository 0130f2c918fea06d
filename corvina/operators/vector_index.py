"""An inverted-file index for inner-product search: vectors in lists by their nearest coarse centroid, of which a query probes a few.

* **Quantiser.**  Spherical k-means on a bounded sample, TRAIN vectors a list, chosen by a hash of the id.  A round assigns the sample and
  adds it up by aggregation; the driver holds centroids alone (lists * dims numbers).
* **Lists.**  Every vector is written to the folder of its list (``list=…``), so a search reads the folders it probes only.  ``add``
  appends further vectors to the lists they belong to.
* **Probes.**  How many lists a query must probe is measured when the index is built: CALIBRATE vectors of the sample are searched
  for exactly, and probes are the fewest lists that hold a share TARGET of their nearest neighbours.
* **Search** multiplies the vectors of a list with the queries that ask for it, as matrices; QUERIES go to the tasks at once, and more in
  blocks.  ``exact=True`` goes on with every list that could still hold a nearer vector than the k-th found: by
  q.v <= q.c + |q| * radius of the list around its centroid c, which the tasks find out for themselves, so that no pairs are written.
  Of equal vectors those of the k least ids stand for all.

A table of fewer than FLAT vectors has one list.  Vectors that are null, of another length than the most common one, or with null or non-finite
components are not indexed and never found; null ids are none.  Vectors of zeros are in list 0.  Similarities are rounded to five
places and equal ones are ordered by id, as in ``retrieve.dense_top_k``.  An empty table gives an index that finds nothing.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import retrieve

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

#: Below FLAT vectors one list is enough.  LISTS: the fewest of a larger table, and the most of any.
FLAT, LISTS = 500, (100, 1 << 14)
TRAIN, ROUNDS, CALIBRATE, TARGET = 64, 6, 64, 0.97
#: Queries that go to the tasks at once (64 numbers each take 0.5 KB), and numbers of a matrix that are worked on together.
QUERIES, CELLS = 1 << 16, 1 << 20
#: Similarity is rounded to five places; the bound of a list keeps clear of that.
SLACK = 2e-5


def lists_for(n: int) -> int:
    """A tenth of the vectors up to 100 lists, then the square root of their number."""
    return 1 if n < FLAT else max(min(n // 10, LISTS[0]), min(math.isqrt(n), LISTS[1]))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(size > 0, size, 1.0)


def _steps(n: int, width: int) -> Iterator[slice]:
    """Stretches of ``n`` rows of ``width`` numbers, of CELLS numbers at most."""
    step = max(1, CELLS // max(1, width))
    return (slice(a, a + step) for a in range(0, n, step))


def _nearest(m: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *((m[part] @ centroids.T).argmax(1) for part in _steps(len(m), len(centroids)))])


def _assigner(centroids: np.ndarray):
    """Rows (vec_id, embedding) with their list and their distance from its centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column("embedding"), centroids.shape[1])
            at = _nearest(_unit(m), centroids)
            off = np.sqrt(((m - centroids[at]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(off), pa.array(at, pa.int32())], ["vec_id", "embedding", "off", "list"])

    return run


def _adder(centroids: np.ndarray):
    """What a task's vectors add up to in each list, as unit vectors: list, members, sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, members = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            m = _unit(_matrix(batch.column("embedding"), centroids.shape[1]))
            at = _nearest(m, centroids)
            np.add.at(sums, at, m)
            members += np.bincount(at, minlength=len(centroids))
        some = np.flatnonzero(members)
        values = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(some) + 1) * centroids.shape[1], centroids.shape[1]), pa.int32()), pa.array(sums[some].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), values], ["list", "sums"])

    return run


def _least_ids(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that are among the k least ids of their vector."""
    _, same = np.unique(np.ascontiguousarray(vectors).view(f"V{vectors.dtype.itemsize * vectors.shape[1]}").ravel(), return_inverse=True)
    order = np.lexsort((ids, same))
    first = np.flatnonzero(np.append(True, np.diff(same[order]) != 0))
    return order[np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) < k]


def _products(ids: pa.Array, q: np.ndarray, centroids: np.ndarray, k: int, least: float, edge: np.ndarray | None, kth: np.ndarray | None, radius: np.ndarray | None):
    """Of batches (list, vec_id, embedding): (query_id, vec_id, product) of all that may be among the k best of a query.

    A query asks for the lists at least as near as its ``edge``, or for those that can hold something as near as its ``kth``.
    """
    size = np.sqrt((q * q).sum(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.full(len(q), least) if kth is None else np.maximum(kth, least)
        for batch in batches:
            lists, vec = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            every = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(vec), -1)
            for one in np.unique(lists):
                near = q @ centroids[one]
                asking = np.flatnonzero(~(near < edge if kth is None else near + size * radius[one] < floor - SLACK))  # not a number is the largest
                if not len(asking):
                    continue
                rows = np.flatnonzero(lists == one)
                rows = rows[_least_ids(vec[rows], every[rows], k)]
                vectors = every[rows].astype(np.float64)
                # the order of summing moves a product by less
                slack = SLACK + 1e-12 * np.sqrt((vectors * vectors).sum(1)).max() * size
                for part in _steps(len(asking), len(rows)):
                    some = asking[part]
                    sims = q[some] @ vectors.T
                    hit = ~(sims < (floor[some] - slack[some])[:, None])
                    many = np.flatnonzero(hit.sum(1) > k)
                    if len(many):
                        # the k-th of these is as far as the k-th of all at most, but for rounding
                        floor[some[many]] = np.maximum(floor[some[many]], np.partition(sims[many], -k, 1)[:, -k] - SLACK)
                        hit[many] = ~(sims[many] < (floor[some[many]] - slack[some[many]])[:, None])
                    a, b = np.nonzero(hit)
                    a = some[a]
                    total = np.zeros(len(a))
                    for i in range(q.shape[1]):  # in order, as an aggregate adds them up
                        total += q[a, i] * vectors[b, i]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), pa.array(vec[rows[b]], pa.int64()), pa.array(total)], ["query_id", "vec_id", "product"])

    return run


def usable(vectors: DataFrame, dims: int | None = None) -> DataFrame:
    """(vec_id, embedding) of the vectors that can be indexed, of ``dims`` entries if given."""
    finite = F.forall("embedding", lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    size = F.size("embedding") > 0 if dims is None else F.size("embedding") == dims
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & size & finite).select("vec_id", "embedding")


def trained(sample: DataFrame, lists: int, dims: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of the written ``sample`` (vec_id, embedding), begun from its vectors of least hash."""
    first = [r["embedding"] for r in sample.orderBy(F.md5(F.concat(F.lit("first"), F.col("vec_id").cast("string"))), "vec_id").limit(lists).collect()]
    centroids = _unit(np.array(first, np.float64))
    for _ in range(rounds):
        sums = sample.mapInArrow(_adder(centroids), "list int, sums array<double>").select("list", F.posexplode("sums").alias("dim", "x"))
        after = centroids.copy()
        for r in sums.groupBy("list", "dim").agg(F.sum("x").alias("x")).groupBy("list").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v")).collect():
            after[r["list"]] = [x["x"] for x in r["v"]]
        after = _unit(after)
        if np.abs(after - centroids).max() < 1e-6:
            break
        centroids = after
    return centroids


@dataclass(frozen=True)
class VectorIndex:
    """An index under ``root``: its centroids, probes of a query, and the radius of each list."""

    root: str
    centroids: np.ndarray
    probes: int
    spark: SparkSession

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.schema("vec_id long, embedding array<float>, off double, list int").parquet(f"{self.root}/vectors")

    def add(self, vectors: DataFrame) -> None:
        """Appends vectors to their lists."""
        rows = usable(vectors, self.centroids.shape[1]) if len(self.centroids) else vectors.select("vec_id", "embedding").limit(0)
        rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>"))
        if len(self.centroids):
            rows = rows.mapInArrow(_assigner(self.centroids), "vec_id long, embedding array<float>, off double, list int")
        else:
            rows = rows.withColumns({"off": F.lit(0.0), "list": F.lit(0)})
        # a list is one folder, of a file where it is small; AQE deals a list of many vectors to several tasks
        rows.hint("rebalance", F.col("list")).write.mode("append").partitionBy("list").parquet(f"{self.root}/vectors")

    def _places(self, queries: DataFrame, most: int | None = None) -> DataFrame:
        """Queries (query_id, q) with ``places``: the first ``most`` lists in order of similarity to the query, with that similarity (list, near)."""
        centroids, most = self.centroids, min(most or len(self.centroids), len(self.centroids))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = _matrix(batch.column("q"), centroids.shape[1])
                for part in _steps(len(m), len(centroids)):
                    near = m[part] @ centroids.T
                    order = np.argsort(-near, axis=1, kind="stable")[:, :most]
                    structs = pa.StructArray.from_arrays([pa.array(order.reshape(-1), pa.int32()), pa.array(np.take_along_axis(near, order, 1).reshape(-1))], ["list", "near"])
                    places = pa.ListArray.from_arrays(pa.array(np.arange(0, order.size + 1, most), pa.int32()), structs)
                    rows = batch.slice(part.start, len(near))
                    yield pa.RecordBatch.from_arrays([rows.column("query_id"), rows.column("q"), places], ["query_id", "q", "places"])

        kind = queries.schema["query_id"].dataType.simpleString()
        return queries.select("query_id", F.col("q").cast("array<double>")).mapInArrow(run, f"query_id {kind}, q array<double>, places array<struct<list: int, near: double>>")

    def _hits(self, asked: DataFrame, lists: DataFrame, k: int, least: float, radius: np.ndarray | None = None) -> DataFrame:
        """Top k of a block of queries (query_id, q, and ``edge`` or ``kth``), which want ``lists`` (list) at most."""
        held, wanted = asked.toArrow(), [r["list"] for r in lists.distinct().collect()]
        columns = {c: held.column(c).to_numpy() for c in held.column_names[2:]}
        q = _matrix(held.column("q").combine_chunks(), self.centroids.shape[1])
        run = _products(held.column("query_id").combine_chunks(), q, self.centroids, k, float(least), columns.get("edge"), columns.get("kth"), radius)
        rows = self.vectors if len(wanted) == len(self.centroids) else self.vectors.filter(F.col("list").isin(wanted))
        found = rows.select("list", "vec_id", "embedding").mapInArrow(run, f"query_id {asked.schema['query_id'].dataType.simpleString()}, vec_id long, product double")
        sims = found.select("query_id", "vec_id", F.round("product", 5).alias("sim")).filter(F.col("sim") >= least)
        return retrieve.top_k(sims, "query_id", k, F.col("sim").desc(), F.col("vec_id"))

    def search(self, queries: DataFrame, k: int, least: float = 0.0, probes: int | None = None, exact: bool = False) -> DataFrame:
        """(query_id, vec_id, sim, rank) of queries (query_id, q), from ``probes`` lists each, or exactly."""
        from ..session import written

        if not len(self.centroids):
            return self.spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id long, sim double, rank int")
        finite = F.forall("q", lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
        some = queries.filter(F.col("q").isNotNull() & (F.size("q") == self.centroids.shape[1]) & finite)
        every = written(self._places(some, probes or self.probes), "places")
        blocks = -(-2 * n // QUERIES) if (n := every.count()) > QUERIES else 1  # by hash: half full on average
        radius = None
        if exact:  # one row for each list
            radius = np.zeros(len(self.centroids))
            for r in self.vectors.groupBy("list").agg(F.max("off").alias("radius")).collect():
                radius[r["list"]] = r["radius"]
        found = []
        for block in range(blocks):
            places = every if blocks == 1 else every.filter(F.expr(f"pmod(xxhash64(query_id), {blocks}) = {block}"))
            hits = self._hits(places.select("query_id", "q", F.element_at("places", -1)["near"].alias("edge")), places.select(F.explode("places.list").alias("list")), k, least)
            if exact:
                kth = written(hits.filter(F.col("rank") == k).select("query_id", F.col("sim").alias("kth")), "kth")
                asked = places.select("query_id", "q").join(kth, "query_id", "left").select("query_id", "q", F.coalesce("kth", F.lit(float(least))).alias("kth"))
                hits = self._hits(asked, self.spark.range(len(self.centroids)).select(F.col("id").alias("list")), k, least, radius)
            found.append(hits)
        return reduce(DataFrame.unionByName, found)


def build(vectors: DataFrame, root: str, lists: int | None = None, neighbours: int = 10) -> VectorIndex:
    """An index of ``vectors`` (vec_id, embedding) under ``root``, whose probes find TARGET of the ``neighbours`` nearest."""
    from ..session import written

    spark = vectors.sparkSession
    rows = usable(vectors)
    top = rows.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
    if top is None:
        index = VectorIndex(root, np.zeros((0, 0)), 1, spark)
        index.add(rows)
        _keep(index)
        return index
    dims, rows = top["dims"], rows.filter(F.size("embedding") == top["dims"])
    lists = lists or lists_for(top["n"])
    sample = written(rows.orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id").limit(max(TRAIN * lists, CALIBRATE)), "sample")
    index = VectorIndex(root, trained(sample, lists, dims), 1, spark)
    index.add(rows)
    queries = sample.orderBy(F.md5(F.concat(F.lit("calibrate"), F.col("vec_id").cast("string")))).limit(CALIBRATE).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    index = VectorIndex(root, index.centroids, _needed(index, written(queries, "calibrate"), neighbours), spark)
    _keep(index)
    return index


def _needed(index: VectorIndex, queries: DataFrame, k: int) -> int:
    """The fewest probes that reach a share TARGET of the k nearest vectors of ``queries``."""
    found = retrieve.dense_top_k(queries, index.vectors.select("vec_id", "embedding"), k, -1e30)
    held = found.join(index.vectors.select("vec_id", "list"), "vec_id").select("query_id", "list")
    places = index._places(queries).select("query_id", F.posexplode("places").alias("place", "p")).select("query_id", "place", "p.list")
    # CALIBRATE * k rows at most, counted by place
    by = {r["place"]: r["n"] for r in held.join(places, ["query_id", "list"]).groupBy("place").agg(F.count("*").alias("n")).collect()}
    all_, so_far = sum(by.values()), 0
    for place in sorted(by):
        so_far += by[place]
        if so_far >= TARGET * all_:
            return place + 1
    return 1


def _keep(index: VectorIndex) -> None:
    rows = [(i, c.tolist(), index.probes) for i, c in enumerate(index.centroids)]
    index.spark.createDataFrame(rows, "list int, centroid array<double>, probes int").coalesce(1).write.parquet(f"{index.root}/centroids")


def open_index(spark: SparkSession, root: str) -> VectorIndex:
    rows = spark.read.parquet(f"{root}/centroids").orderBy("list").collect()
    return VectorIndex(root, np.array([r["centroid"] for r in rows]) if rows else np.zeros((0, 0)), rows[0]["probes"] if rows else 1, spark)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: neighbours wanted and found, and the share, of two results (query_id, vec_id)."""
    hit = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.agg(F.count("*").alias("wanted"), F.count("hit").alias("found")).withColumn("recall", F.col("found") / F.col("wanted"))
