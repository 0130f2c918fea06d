r"""Near-duplicate classes by SetSketch registers (4-word shingles, Jaccard similarity of 0.80 or more).

1. **Registers.**  A set has M registers.  Every shingle draws an ascending series of exponential values, the j-th from the j-th
   of M stretches of equal probability, and deals them over the registers in an order of its own; a register keeps the
   least, truncated to the exponent floor(1 - log_B(value / RATE)).  So registers are larger the more shingles there are, two
   sets agree in a register about as often as they are similar, and the registers of a union are the maxima (``merged``).  A
   register that the first values fill is not changed by later ones: series end when all are filled, so a large set costs its size, not M times it.
2. **Bands.**  BANDS keys of BAND registers each.  A pair of similarity 0.80 shares none with a probability of 2e-9; one
   of similarity 0.3 shares one with a probability of a ninth.
3. **Likelihood.**  Of a pair that shares a key, the registers that are greater, less and equal, with both set sizes, give the
   likelihood of each similarity (``log_likelihood``).  A pair goes on unless 0.80 is e^-DOUBT less likely than the best similarity.
4. **Verification** on the full sets of shingle hashes, 100 |A and B| >= 80 |A or B|.  Only verified pairs link.

Documents with identical sets are one node.  Lists of a key are joined to a pivot each, never to all pairs; verified links are merged
into classes, and only pairs of different classes stay open (as in the n-gram join).  So a group of n near copies costs n
comparisons a key.  Of the documents in lists that are open after the pivot rounds those go that share fewer than 80 % of their shingles with
all the others together, which no partner of theirs could have; the most ordinary one of a list is its last pivot.  What is open
then is compared exactly within tasks, block by block, which give links and not pairs.

Nulls and texts without words have no shingles and no links, and are kept; texts of one to three words are one shingle.  Rows that repeat a
doc_id are one document that has the links of each of its texts.  Rows without a doc_id are in no class (component_id is null) and are kept.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngram_join
from . import textbytes as tb
from .common import join_ids, release, saved, trim

WORDS, PERCENT = 4, 80
#: Registers, registers to a band, bands; base and rate of the exponents, which end at 2^16 - 1.
M, BAND, BANDS, B, RATE, TOP = 256, 5, 51, 1.001, 64.0, (1 << 16) - 1
#: A pair is given up where the threshold is e^-16 times as likely as the best estimate (that of a linked pair, about 1e-8).
DOUBT = 16.0
#: Shingles that a step of the registers takes at once; the rest of a longer set is merged in.
STEP = 1 << 20
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)

#: Sizes that may link, of two list entries.
FITS = f"100 * least({{0}}n, {{1}}n) >= {PERCENT} * greatest({{0}}n, {{1}}n)"
#: Blocks of a group of open documents: of BLOCK documents at least, PARTS of them unless they would hold over BLOCK_TOKENS shingles.
BLOCK, PARTS, BLOCK_TOKENS = 64, 64, 2_000_000


def _least_values(tokens: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """(n, M): of each document and register the least place, in 1/2^64, that a shingle has on the unit of probability."""
    low = np.full(n * M, EMPTY)
    seed = tb.mix(tokens ^ tb.LANES[3])
    first, step = (seed >> np.uint64(32)).astype(np.int64), (seed & np.uint64(0xFF) | np.uint64(1)).astype(np.int64)
    j = 0
    while j < M and len(tokens):
        turns = np.arange(j, min(M, j + max(1, j // 4)))
        for a in range(0, len(tokens), max(1, STEP // len(turns))):
            some = slice(a, a + max(1, STEP // len(turns)))
            # an odd step visits each of the M registers once
            at = doc[some, None] * M + ((first[some, None] + step[some, None] * turns) & (M - 1))
            place = (turns.astype(np.uint64) << np.uint64(56)) | (tb.mix(tokens[some, None] + (turns.astype(np.uint64) + np.uint64(1)) * tb.BASE) >> np.uint64(8))
            np.minimum.at(low, at.reshape(-1), place.reshape(-1))
        j = int(turns[-1]) + 1
        open_ = (low.reshape(n, M) == EMPTY).any(1)[doc]
        tokens, doc, first, step = tokens[open_], doc[open_], first[open_], step[open_]
    return low.reshape(n, M)


def registers(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(sets, M) registers of the sets that lie one after the other in ``tokens``; empty sets have zeros."""
    n = len(sizes)
    low = _least_values(tokens, np.repeat(np.arange(n), sizes), n)
    place = np.minimum((low.astype(np.float64) + 0.5) / 2.0**64, 1 - 2.0**-53)
    exponent = np.floor(1 - np.log(-np.log1p(-place) / RATE) / math.log(B))
    return np.where(low == EMPTY, 0, np.clip(exponent, 0, TOP)).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the unions."""
    return np.maximum(a, b)


def _p(x: np.ndarray) -> np.ndarray:
    """The probability that a share x of the union's shingles, all in one set alone, holds the register's greatest exponent."""
    return -np.log1p(-x * (B - 1) / B) / math.log(B)


def log_likelihood(j, more: np.ndarray, less: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Of similarity j, given that ``more`` registers of A are greater, ``less`` are less and the rest equal, and both sizes."""
    u, v = na / (na + nb), nb / (na + nb)
    pa_, pb = _p(np.clip(u - v * j, 1e-12, 1)), _p(np.clip(v - u * j, 1e-12, 1))
    return more * np.log(pa_) + less * np.log(pb) + (M - more - less) * np.log(np.clip(1 - pa_ - pb, 1e-12, 1))


def estimate(more: np.ndarray, less: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The similarity of the greatest likelihood, which is concave in it."""
    lo, hi = np.zeros(len(more)), np.minimum(na / nb, nb / na)
    for _ in range(40):
        x, y = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        right = log_likelihood(x, more, less, na, nb) < log_likelihood(y, more, less, na, nb)
        lo, hi = np.where(right, x, lo), np.where(right, hi, y)
    return (lo + hi) / 2


def possible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Of rows of registers and set sizes: whether the threshold may be met."""
    a, b = a.astype(np.int32), b.astype(np.int32)
    more, less, na, nb = (a > b).sum(1), (a < b).sum(1), na.astype(np.float64), nb.astype(np.float64)
    edge = np.minimum(PERCENT / 100, np.minimum(na / nb, nb / na))
    best = estimate(more, less, na, nb)
    return (best >= edge) | (log_likelihood(best, more, less, na, nb) - log_likelihood(edge, more, less, na, nb) <= DOUBT)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and own of each row, with size, digest and registers of its set."""
    release()
    for batch in batches:
        for a, b, raw, off in tb.steps(batch.column(1)):
            sets = tb.shingle_sets(raw, off, WORDS)
            size = np.array([len(s) for s in sets], np.int64)
            digest = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
            rows = registers(np.concatenate(sets), size)
            columns = [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(size), pa.array(digest, pa.binary()), pa.array([r.tobytes() for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "own", "n_shingles", "sig", "registers"])
    batch = raw = off = sets = rows = None
    trim()  # the worker may stand idle beside other stages


def _rows_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, M)


def band_keys(rows: np.ndarray) -> np.ndarray:
    """(sets, BANDS) keys of rows of registers."""
    bands = rows[:, : BAND * BANDS].reshape(-1, BANDS, BAND).astype(np.uint64)
    return tb.mix((bands * tb.LANES[:BAND]).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * tb.BASE)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = band_keys(_rows_of(batch.column("registers"))).reshape(-1)
        flat = [np.repeat(batch.column(c).to_numpy(), BANDS) for c in ("doc_id", "n_shingles")]
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *map(pa.array, flat)], ["key", "doc", "n"])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = possible(_rows_of(batch.column("ra")), _rows_of(batch.column("rb")), batch.column("na").to_numpy(), batch.column("nb").to_numpy())
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _with_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        for a, b, raw, off in tb.steps(batch.column(1)):
            sets = tb.shingle_sets(raw, off, WORDS)
            n = np.array([len(s) for s in sets], np.int64)
            tokens = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), tokens], ["doc_id", "n", "tokens"])
    batch = raw = off = sets = None
    trim()


def _verifier(heads: DataFrame, sketches: DataFrame):
    """Of pairs (a, b): a, b and ``linked``, tested on the full sets; pairs that the likelihood rules out are not among them."""

    def verify(pairs: DataFrame) -> DataFrame:
        one = sketches.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("registers").alias("ra"))
        two = sketches.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("registers").alias("rb"))
        likely = saved(pairs.join(one, "a").join(two, "b").mapInArrow(_likely, "a long, b long").distinct(), "likely")
        some = saved(likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "in-pairs")
        sets = saved(join_ids(heads, some, "left_semi").mapInArrow(_with_tokens, "doc_id long, n long, tokens array<long>").filter("n > 0"), "tokens", "none")
        return ngram_join.verified(likely, sets, PERCENT)

    return verify


class _Open:
    """What is done about documents of different classes that share a list after the pivot rounds."""

    def __init__(self, heads: DataFrame):
        self.heads, self.sets = heads, None

    def prune(self, open_: DataFrame) -> DataFrame:
        """Of nodes (doc) those that share PERCENT of their shingles with all others together, with ``apart``: how many they share with none.

        A partner has PERCENT of a node's shingles, so the others go without loss.
        """
        ids = open_.withColumnRenamed("doc", "doc_id")
        self.sets = saved(join_ids(self.heads, ids, "left_semi").mapInArrow(_with_tokens, "doc_id long, n long, tokens array<long>"), "open-tokens", "none")
        each = self.sets.select("doc_id", "n", F.explode("tokens").alias("t"))
        often = each.groupBy("t").agg(F.count("*").alias("df")).filter("df > 1").select("t")
        shared = each.join(often, "t", "left_semi").groupBy("doc_id", "n").agg(F.count("*").alias("shared"))
        return shared.filter(f"100 * shared >= {PERCENT} * n").groupBy(F.col("doc_id").alias("doc")).agg(F.min(F.col("n") - F.col("shared")).alias("apart"))

    def links(self, now: DataFrame, lists: DataFrame, tested: DataFrame) -> DataFrame:
        """Links (a, b) between different classes, found by exact comparison in blocks; of a document one link to each class.

        Lists with the same most frequent class are one group, so a document is in few groups, however many lists it is in.  Documents of
        other classes are compared with all of the group, in blocks against blocks: the rows are those of blocks, not of pairs.
        """
        entries = now.join(lists.select("key"), "key").select("key", "doc", "label")
        most = entries.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("g"))
        rows = saved(entries.join(most, "key").select("g", "doc", "label").distinct(), "groups")
        rows = rows.join(self.sets.select(F.col("doc_id").alias("doc"), "n", "tokens"), "doc").withColumn("out", F.col("label") != F.col("g"))
        parts = lambda c: F.greatest(F.least(F.ceil(F.count_if(c) / BLOCK), F.lit(PARTS)), F.ceil(F.sum(F.when(c, F.col("n"))) / BLOCK_TOKENS), F.lit(1)).cast("int")
        groups = rows.select("g", "doc", "n", "out").groupBy("g").agg(parts(F.lit(True)).alias("kb"), parts(F.col("out")).alias("ka")).filter("ka > 0")
        dealt = rows.join(groups, "g").select("g", "doc", "label", "tokens", "out", "ka", "kb")
        part = lambda k, salt: F.pmod(F.xxhash64(F.lit(salt), "doc"), F.col(k)).cast("int")
        every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
        a = dealt.filter("out").select("g", part("ka", 1).alias("i"), every("kb").alias("j"), F.lit(True).alias("left"), "doc", "label", "tokens")
        b = dealt.select("g", every("ka").alias("i"), part("kb", 2).alias("j"), F.lit(False).alias("left"), "doc", "label", "tokens")
        # dealt by block: rows that lie by group already would stay so
        return a.unionByName(b).repartition("g", "i", "j").groupBy("g", "i", "j").applyInArrow(_compared, "a long, b long").distinct()


def _sets_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels, all tokens, and where those of each row begin and end."""
    column = table.column("tokens").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    return table.column("doc").to_numpy(), table.column("label").to_numpy(), column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(sizes))


def _compared(blocks: pa.Table) -> pa.Table:
    """Exact links between the rows of two blocks: for each on the left one to each other class on the right."""
    release()
    left, right = blocks.filter(blocks.column("left")), blocks.filter(pc.invert(blocks.column("left")))
    found: list[tuple[int, int]] = []
    if left.num_rows and right.num_rows:
        ids, labels, tokens, at = _sets_of(left)
        others, classes, every, ends = _sets_of(right)
        size = np.diff(ends)
        place = np.searchsorted(known := np.unique(tokens), every)
        place[place == len(known)] = 0
        inside = known[place] == every
        mark = np.zeros(len(known), bool)
        for k in range(len(ids)):
            own = np.searchsorted(known, tokens[at[k] : at[k + 1]])
            mark[own] = True
            total = np.append(0, np.cumsum(mark[place] & inside))
            mark[own] = False
            common = total[ends[1:]] - total[ends[:-1]]
            linked = (classes != labels[k]) & (100 * common >= PERCENT * (len(own) + size - common)) & (common > 0)
            for c in np.unique(classes[linked]):
                found.append((int(ids[k]), int(others[linked & (classes == c)].min())))
    return pa.table({"a": pa.array([min(p) for p in found], pa.int64()), "b": pa.array([max(p) for p in found], pa.int64())})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept."""
    texts = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("own"))
    every = saved(texts.mapInArrow(_sketched, "doc_id long, own long, n_shingles long, sig binary, registers binary"), "sketches", "none")
    texts, info = texts.filter("doc_id is not null"), every.filter("doc_id is not null")
    # Written first, so that joins on ``sig`` shuffle both sides and AQE can split the copies of one set.
    nodes = saved(info.filter("n_shingles > 0").groupBy("sig").agg(F.min("doc_id").alias("rep")), "nodes")
    copies = saved(info.filter("n_shingles > 0").select("doc_id", "own", "sig").join(nodes, "sig").filter("doc_id != rep").select("doc_id", "own"), "copies")
    repeated = saved(info.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id"), "repeated")
    again = not repeated.isEmpty()
    one = lambda rows: rows.dropDuplicates(["doc_id", "own"]) if again else rows
    sketches = one(join_ids(info.filter("n_shingles > 0").select("doc_id", "own", "n_shingles", "registers"), copies, "left_anti", ["doc_id", "own"]))
    sketches = saved(sketches.select("doc_id", "n_shingles", "registers"), "heads", "none")
    heads = one(join_ids(texts, copies, "left_anti", ["doc_id", "own"])).select("doc_id", "text")
    keys = sketches.mapInArrow(_banded, "key long, doc long, n long")
    lists = keys.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo != hi").select("key")
    members = saved(keys.join(lists, "key").withColumn("shared", F.col("n")).distinct(), "lists")
    labels = None
    if not members.isEmpty():
        rest = _Open(heads)
        labels = ngram_join.classes(members, _verifier(heads, sketches), rest.links, FITS, rest.prune)
    out = ngram_join.labelled(info, nodes, labels, repeated if again else None)
    nameless = every.filter("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
