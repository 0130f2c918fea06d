"""Quality classifier: a generalised additive model with pairwise interactions, fitted by cyclic boosting of shallow trees.

Features are counts and shares of whole texts (no label, language, source or id is an input).  The model is fitted on the
driver from at most TRAIN_ROWS labelled rows (chosen by a hash of their id; features only, under 10 MB): each turn fits, for one
feature after the other, a tree of at most three leaves to the residuals over the feature's bins and adds it to that
feature's lookup table; then pairs that lower the loss most get tables of their own.  Scoring bins the features and adds the
tables' entries, vectorised over the rows of a batch.

Nulls and empty texts are scored as texts of no characters.  Without labelled rows every score is 0.5; with labels of one kind all
rows get that share.  Rows are independent: repeats, ties and extra columns have no effect.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import release, saved

TRAIN_ROWS, BINS, PAIR_BINS, ROUNDS, PAIRS, RATE = 20_000, 32, 8, 60, 6, 0.15
FEATURES = [
    "log_bytes", "upper", "lower", "digit", "space", "newline", "stop", "symbol", "pipe", "exclaim", "high", "log_words", "word_length",
    "distinct_words", "distinct_shingles", "distinct_lines", "line_length", "longest_line",
]


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256)
    out[[ord(c) for c in chars]] = 1
    return out


_SHARES = [
    _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("abcdefghijklmnopqrstuvwxyz"), _class("0123456789"), _class(" \t\r\v\f\n"), _class("\n"), _class(".,;:?"),
    _class("#$%&*+/<=>@[\\]^_`{}~"), _class("|"), _class("!"), np.append(np.zeros(128), np.ones(128)),
]


def _distinct(h: np.ndarray) -> int:
    return len(np.unique(h))


def features(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = np.diff(off)
    owner = np.repeat(np.arange(len(n)), n)
    safe = np.maximum(n, 1)
    hist = np.bincount(owner * 256 + raw, minlength=256 * len(n)).reshape(len(n), 256)
    shares = [hist @ s / safe for s in _SHARES]
    h, bounds = tb.word_hashes(raw, off)
    words = np.diff(bounds)
    sets = tb.shingle_sets(raw, off, 3)
    cuts = np.flatnonzero(raw == 10)
    line = np.sort(np.concatenate([off[:-1], cuts + 1]))
    line = line[line <= len(raw)]
    ends = np.append(line[1:], len(raw))
    text_of = np.searchsorted(off, line, "right") - 1
    ok = (ends > line) & (text_of < len(n))
    line, ends, text_of = line[ok], ends[ok], text_of[ok]
    lines = np.bincount(text_of, minlength=len(n))
    longest = np.zeros(len(n))
    np.maximum.at(longest, text_of, ends - line)
    # a line is told by its length and the sum of its bytes' keys: enough for a share of distinct lines
    plain = np.append(np.uint64(0), np.cumsum(tb.BYTE_KEY[raw], dtype=np.uint64))
    key = tb.mix((plain[ends] - plain[line]) ^ (ends - line).astype(np.uint64))
    first = np.searchsorted(text_of, np.arange(len(n) + 1))
    out = np.zeros((len(n), len(FEATURES)))
    out[:, 0] = np.log1p(n)
    out[:, 1:11] = np.stack(shares, 1)
    out[:, 11] = np.log1p(words)
    out[:, 12] = (n - hist @ _SHARES[3]) / np.maximum(words, 1)
    for i in range(len(n)):
        a, b = bounds[i], bounds[i + 1]
        if b > a:
            out[i, 13] = _distinct(h[a:b]) / (b - a)
            out[i, 14] = len(sets[i]) / max(1, b - a - 2)
        if first[i + 1] > first[i]:
            out[i, 15] = _distinct(key[first[i] : first[i + 1]]) / (first[i + 1] - first[i])
    out[:, 16] = np.log1p(n / np.maximum(lines, 1))
    out[:, 17] = longest / safe
    return out


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        for a, b, raw, off in tb.steps(batch.column(1), 2 << 20):
            x = features(raw, off)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), flat], ["doc_id", "features"])


class AdditiveModel:
    """Bin edges, one table for each feature and one for each chosen pair."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS, rate: float = RATE):
        k = x.shape[1]
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(k)]
        self.coarse = [e[:: max(1, -(-len(e) // (PAIR_BINS - 1)))] for e in self.edges]
        self.tables, self.pairs, self.pair_tables = [np.zeros(BINS + 1) for _ in range(k)], [], []
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
        self.base = float(np.log(share / (1 - share)))
        if not len(y) or y.min() == y.max():
            return
        bins, small = self._bins(x, self.edges), self._bins(x, self.coarse)
        f = np.full(len(y), self.base)
        for _ in range(rounds):
            for j in range(k):
                step = rate * self._tree(bins[:, j], *self._residuals(f, y), BINS + 1)
                self.tables[j] += step
                f += step[bins[:, j]]
        gains = []
        g, h = self._residuals(f, y)
        for i in range(k):
            for j in range(i):
                cell = small[:, i] * PAIR_BINS + small[:, j]
                gs, hs = np.bincount(cell, g, PAIR_BINS**2), np.bincount(cell, h, PAIR_BINS**2)
                gains.append((float((gs**2 / (hs + 5)).sum()), j, i))
        self.pairs = [(i, j) for _, j, i in sorted(gains, reverse=True)[:pairs]]
        self.pair_tables = [np.zeros(PAIR_BINS**2) for _ in self.pairs]
        for _ in range(rounds // 2):
            for p, (i, j) in enumerate(self.pairs):
                step = rate * self._pair_tree(small[:, i], small[:, j], *self._residuals(f, y))
                self.pair_tables[p] += step
                f += step[small[:, i] * PAIR_BINS + small[:, j]]

    @staticmethod
    def _bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)], 1)

    @staticmethod
    def _residuals(f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    @staticmethod
    def _tree(cell: np.ndarray, g: np.ndarray, h: np.ndarray, size: int, leaves: int = 3) -> np.ndarray:
        """Values by bin of the tree that splits greedily where the loss falls most."""
        gs, hs = np.cumsum(np.bincount(cell, g, size)), np.cumsum(np.bincount(cell, h, size))
        G, H = np.append(0, gs), np.append(0, hs)
        cuts = [0, size]
        for _ in range(leaves - 1):
            best = (1e-9, None)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                c = np.arange(a + 1, b)
                if len(c):
                    gl, hl, gr, hr = G[c] - G[a], H[c] - H[a], G[b] - G[c], H[b] - H[c]
                    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - (G[b] - G[a]) ** 2 / (H[b] - H[a] + 1)
                    at = int(gain.argmax())
                    best = max(best, (float(gain[at]), int(c[at])), key=lambda t: t[0])
            if best[1] is None:
                break
            cuts = sorted([*cuts, best[1]])
        out = np.zeros(size)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + 1)
        return out

    @classmethod
    def _pair_tree(cls, ci: np.ndarray, cj: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """A split of one feature and one of the other within each side."""
        first = cls._tree(ci, g, h, PAIR_BINS, 2)
        side = (first != first[0])[ci]
        out = np.zeros((PAIR_BINS, PAIR_BINS))
        for s in (False, True):
            if (side == s).any():
                out[(first != first[0]) == s] = cls._tree(cj[side == s], g[side == s], h[side == s], PAIR_BINS, 2)
        return out.reshape(-1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        bins, small = self._bins(x, self.edges), self._bins(x, self.coarse)
        f = self.base + sum(t[bins[:, j]] for j, t in enumerate(self.tables))
        f = f + sum((t[small[:, i] * PAIR_BINS + small[:, j]] for (i, j), t in zip(self.pairs, self.pair_tables, strict=True)), np.zeros(len(x)))
        return 1 / (1 + np.exp(-f))


def _scored(model: AdditiveModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], ["doc_id", "score"])

    return run


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string")) % 3 == 1


def quality_scores(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted; labels (doc_id, quality) of held-out rows are never read."""
    rows = saved(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_featured, "doc_id long, features array<double>"), "features")
    marks = labels.filter(~held_out()).filter("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # one row of a doc_id, so that repeats neither weigh more nor fill the limit
    one = rows.join(marks, "doc_id").groupBy("doc_id").agg(F.min("features").alias("features"), F.min("quality").alias("quality"))
    some = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select("doc_id", "features", "quality").orderBy("doc_id").toArrow()
    x = np.array(some.column("features").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    model = AdditiveModel(x, np.array(some.column("quality").to_pylist(), np.float64))
    out = rows.mapInArrow(_scored(model), "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
