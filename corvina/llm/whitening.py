r"""Embedding whitening from upper-triangle column aggregates; JVM expressions but for the decomposition of one dims x dims matrix.

1. Components become integers x = floor(SCALE * c).  Each distinct vector is written once: the fit list of n vectors.  Copies are
   combined by the tasks before the shuffle, so one very common vector is a row a task.
2. One aggregation gives n, the sums S and the range of every dimension.
3. One aggregation of generated expressions sums the centred product of every pair of dimensions i <= j.  Dimensions are centred at
   their mean rounded to a whole number, so products and sums are whole and exact; what rounding left over
   (D = S - n * centre) goes out of the assembled covariance exactly, V = (n * P - D D') / n^2 in whole numbers before the division.
4. LAPACK decomposes V; components are in order of falling eigenvalue, their largest entry positive.
5. Rows are projected by generated expressions; the covariance of the whitened fit list is aggregated to measure how far from the identity it is.

Vectors that are null or hold null or non-finite entries are left out, and those of another length than the most common one (the
smaller of equals).  Entries beyond LARGEST are taken as LARGEST.  Rows that repeat have results of their own but count once in the
fit.  Components without variance have null as ``whitened`` (all of them, if there is one distinct vector).  ``deviation`` is a
decimal of 38 digits.  An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .vectors import integer_vectors

SCALE, COMPONENTS = 256, 4
#: A component's bound (|c| of 8 million).
LARGEST = (1 << 31) - 1
#: A share of the trace below which an eigenvalue is rounding, not variance.
RANK = 1e-13


@dataclass(frozen=True)
class Whitening:
    """n and sums of the fit list, its largest entry by size, eigenvalues of the components in falling order, their vectors as rows, and the trace."""

    n: int
    sums: list[int]
    largest: int
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def ranked(self) -> list[int]:
        return [c for c, e in enumerate(self.values) if e > RANK * self.trace]


def common_length(vectors: DataFrame) -> int:
    """The most common length, the smaller of equals; 0 of no vectors."""
    first = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return first["d"] if first else 0


def _columns(rows: DataFrame, dims: int) -> DataFrame:
    return rows.select(*[F.col("x")[i].alias(f"x{i}") for i in range(dims)])


def centred_products(fit: DataFrame, centres: list[int], exact_in_long: bool) -> np.ndarray:
    """Sums of (x_i - centre_i) * (x_j - centre_j) over ``fit`` for all i <= j, in one aggregation; whole numbers."""
    dims, kind = len(centres), "bigint" if exact_in_long else "decimal(20,0)"
    centred = _columns(fit, dims).selectExpr(*[f"cast(cast(x{i} as bigint) - ({c}) as {kind}) as d{i}" for i, c in enumerate(centres)])
    pairs = [(i, j) for i in range(dims) for j in range(i, dims)]
    sums = centred.selectExpr(*[f"sum(d{i} * d{j})" for i, j in pairs]).first()
    out = np.zeros((dims, dims), object)
    for (i, j), p in zip(pairs, sums, strict=True):
        out[i, j] = out[j, i] = int(p)
    return out


def fitted(fit: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening:
    """Means, eigenvalues and components of the distinct vectors ``fit`` (x)."""
    stats = _columns(fit, dims).agg(
        F.count("*"), *[F.sum(F.col(f"x{i}").cast("decimal(20,0)")) for i in range(dims)], *[f(f"x{i}") for f in (F.min, F.max) for i in range(dims)]
    ).first()
    n, sums, low, high = int(stats[0]), *([int(s) for s in stats[1 + k * dims : 1 + (k + 1) * dims]] for k in range(3))
    centres = [(2 * s + n) // (2 * n) for s in sums]
    widest = max(max(h - c, c - a) for a, h, c in zip(low, high, centres, strict=True))
    products = centred_products(fit, centres, n * widest * widest < 1 << 62)
    left = [s - n * c for s, c in zip(sums, centres, strict=True)]
    cov = np.array([[float((n * products[i, j] - left[i] * left[j]) / (n * n)) for j in range(dims)] for i in range(dims)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors.T[::-1][:components]
    largest = vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)]
    return Whitening(n, sums, max(map(abs, low + high)), np.maximum(values, 0.0), vectors * np.where(largest < 0, -1.0, 1.0)[:, None], float(np.trace(cov)))


def _projections(model: Whitening) -> list[str]:
    """One expression over d0, d1, ... (centred entries) for each component; null for those without variance."""
    some = set(model.ranked)
    weights = [model.vectors[c] / np.sqrt(model.values[c]) if c in some else None for c in range(len(model.values))]
    return ["cast(null as double)" if w is None else " + ".join(f"d{i} * {float(x)!r}D" for i, x in enumerate(w)) for w in weights]


def whitened(rows: DataFrame, model: Whitening, *keep: str) -> DataFrame:
    """``keep`` of ``rows`` (x) with w1, w2, ... and the exact ``deviation``."""
    n, sums = model.n, model.sums
    most = n * model.largest + max(abs(s) for s in sums)
    off = [f"{n} * x{i} - ({s})" for i, s in enumerate(sums)]
    if len(sums) * most * most < 1 << 62:
        deviation = " + ".join(f"({o}) * ({o})" for o in off)
    else:  # null beyond 38 digits
        deviation = reduce("try_add({}, {})".format, [f"try_multiply(cast({o} as decimal(38,0)), cast({o} as decimal(38,0)))" for o in off])
    entry = "bigint" if most < 1 << 62 else "decimal(38,0)"
    flat = rows.select(*keep, *[F.col("x")[i].cast(entry).alias(f"x{i}") for i in range(len(sums))])
    centred = [f"(x{i} - {float(s / n)!r}D) as d{i}" for i, s in enumerate(sums)]
    flat = flat.selectExpr(*keep, *centred, f"cast({deviation} as decimal(38,0)) as deviation")
    return flat.selectExpr(*keep, "deviation", *[f"{p} as w{c + 1}" for c, p in enumerate(_projections(model))])


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity, over components with variance."""
    some = [c + 1 for c in model.ranked]
    if not some:
        return 0.0
    w = whitened(fit, model)
    means = w.agg(*[F.avg(f"w{c}") for c in some]).first()
    pairs = [(a, b) for a in range(len(some)) for b in range(a, len(some))]
    cov = w.agg(*[F.avg((F.col(f"w{some[a]}") - means[a]) * (F.col(f"w{some[b]}") - means[b])) for a, b in pairs]).first()
    return max(abs(x - (a == b)) for (a, b), x in zip(pairs, cov, strict=True))


def whitening(rows: DataFrame, ids: str = "vec_id", vectors: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per usable row and component (from 1): vec_id, component, n, deviation, whitened, explained, identity_error."""
    every = saved(integer_vectors(rows, ids, vectors, SCALE, LARGEST, "x"), "integers")
    dims = common_length(every)
    if not dims:
        return rows.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    every = every.filter(F.size("x") == dims)
    fit = saved(every.select("x").distinct(), "fit")
    model = fitted(fit, dims, components)
    error = identity_error(fit, model)
    explained = [float(e / model.trace) if model.trace else 0.0 for e in model.values]
    out = whitened(every, model, "id")
    each = F.explode(F.array(*[F.struct(F.lit(c + 1).alias("component"), F.col(f"w{c + 1}").alias("whitened"), F.lit(e).alias("explained")) for c, e in enumerate(explained)])).alias("c")
    out = out.select("id", "deviation", each)
    n, error = F.lit(model.n).cast("long").alias("n"), F.lit(float(error)).alias("identity_error")
    return out.select(F.col("id").alias("vec_id"), "c.component", n, "deviation", "c.whitened", "c.explained", error)
