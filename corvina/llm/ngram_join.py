"""Exact Jaccard self-join of shingle sets (5 words, similarity 0.75 or more) and its connected classes.

A size-aware heavy-light join on the signatures that can still form a link:

1. Documents with identical sets are one node (a 128-bit digest of the sorted set, combined map-side).
2. A node whose set holds fewer than 75 % shingles that any other node has cannot link.  Shingle counts are exchanged as
   packed runs (32 bits a shingle within a hash bucket, each shingle once a chunk), so a shingle held by a third of all
   documents costs one entry a chunk.  A chunk is dealt over 2^DEAL buckets at most, so runs stay long; a corpus that needs more
   buckets is dealt once more from chunks of one bucket each (64 bits a shingle on the first way).  A truncated hash can
   only keep a node too many, never lose one.
3. Among what is left, shingles are ordered by exact frequency, rarest first.  Of n shingles at least ceil(0.75 n) are
   shared with a partner, so by the prefix lemma partners share one of the first n//4+1 and two of the first n//4+2.
   Light sets (n <= x) enumerate the 2-subsets of that prefix.  Heavy sets (n > x) are entered in inverted lists of single
   shingles; light sets of the border (n > 0.75 x) are entered in the lists that a heavy set is in.  x is where the summed cost of both is least.
4. Lists of either kind are joined to a pivot each, never to all pairs; verified links are merged into classes; then only pairs of
   different classes in one list are still open.  After PIVOT_ROUNDS such rounds the open pairs are enumerated in blocks.
   Pairs already in one class need no test, as the class is the result.

Sets are compared by 64-bit shingle hashes.  Nulls and texts without words have no shingles and no links; texts of one to
four words are one shingle.  Rows that repeat a doc_id are one document that has the links of each of its texts.  Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import join_ids, release, saved, trim

#: Shingles to a packed chunk, shingles to a bucket of the exchange (both bound a task's memory), rows to a block of open pairs.
CHUNK, BUCKET, BLOCK = 1_500_000, 2_000_000, 1024
PIVOT_ROUNDS = 3
#: Words of 64 hash cells of a set's parity bits; list keys of a document that an open pair is looked up in.
PARITY, LEAST = 16, 64
COUNTED = 0xFFFF
#: Bits of the hash by which a chunk is dealt at once: at 2^12 buckets a run has some 360 shingles.
DEAL = 12


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    release()
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b, raw, off in tb.steps(batch.column(1)):
            yield ids[a:b], tb.shingle_sets(raw, off)
    batch = raw = off = None
    trim()  # the worker may stand idle beside other stages


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and own of each row, with the size and a digest of its set."""
    release()
    for batch in batches:
        for a, b, raw, off in tb.steps(batch.column(1)):
            sets = tb.shingle_sets(raw, off)
            digest = pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), digest], ["doc_id", "own", "n_shingles", "sig"])
    batch = raw = off = sets = None
    trim()  # the worker may stand idle beside other stages


def _with_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, sets in _sets(batches):
        n = np.array([len(s) for s in sets], np.int64)
        tokens = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), tokens], ["doc_id", "n", "tokens"])


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and how many each row has."""
    sizes = np.concatenate([np.diff(c.offsets.to_numpy()) for c in column.chunks]) if column.num_chunks else np.zeros(0, np.int64)
    return pa.chunked_array([c.flatten() for c in column.chunks], pa.int64()).to_numpy().view(np.uint64), sizes


def _runs(sorted_tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a sorted array: what begins a run, and what has an equal neighbour."""
    same = sorted_tokens[1:] == sorted_tokens[:-1]
    first, shared = np.ones(len(sorted_tokens), bool), np.zeros(len(sorted_tokens), bool)
    first[1:] = ~same
    shared[1:] |= same
    shared[:-1] |= same
    return first, shared


_RUN = ["bucket", "chunk", "ids", "tokens", "refs"]
_RUN_TYPES = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())


def _run_rows(bucket: int, chunk: int, ids: np.ndarray, tokens: np.ndarray, doc: np.ndarray, top: int, bits: int, last: bool) -> list[tuple]:
    """Rows of a chunk: its distinct shingles, dealt by the ``bits`` bits after the ``top`` first, and counts of what repeats within it.

    doc: the place in ``ids`` that a shingle is of, or -1 where it is counted already.  In the last dealing 32 bits of a shingle stay.
    """
    order = np.argsort(tokens)
    tokens, doc = tokens[order], doc[order]
    first, shared = _runs(tokens)
    local = np.bincount(doc[shared & (doc >= 0)], minlength=len(ids))
    ref = np.where(shared, -1, doc)[first]
    tokens = tokens[first]
    part = (tokens >> np.uint64(64 - top - bits)).astype(np.int64) & ((1 << bits) - 1) if bits else np.zeros(len(tokens), np.int64)
    edge = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)).tolist() if len(part) else [0]
    kept = ((tokens >> np.uint64(32 - top - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32) if last else tokens
    at, rows = np.zeros(len(ids), np.int64), []
    for a, b in itertools.pairwise(edge):
        r = ref[a:b]
        used = np.unique(r[r >= 0])
        kind = np.uint16 if len(used) < COUNTED else np.uint32
        at[used] = np.arange(len(used))
        refs = np.where(r >= 0, at[np.maximum(r, 0)], np.iinfo(kind).max).astype(kind)
        rows.append((bucket << bits | int(part[a]), chunk, ids[used].tobytes(), kept[a:b].tobytes(), refs.tobytes()))
    if local.any():
        rows.append((-1 - chunk % (1 << DEAL), chunk, ids[local > 0].tobytes(), b"", local[local > 0].astype(np.uint32).tobytes()))
    return rows


def _packer(bits: int, last: bool):
    """Chunks of whole sets, dealt by the first ``bits`` bits."""

    def pack(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        doc = np.repeat(np.arange(len(ids)), [len(s) for s in sets])
        rows = _run_rows(0, ids[0], np.array(ids, np.int64), np.concatenate(sets), doc, 0, bits, last)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RUN_TYPES, strict=True)], _RUN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, total = [], [], 0
        for some, found in _sets(batches):
            for i, s in zip(some.tolist(), found, strict=True):
                if len(s):
                    ids.append(i)
                    sets.append(s)
                    total += len(s)
                    if total >= CHUNK or len(ids) >= 65_000:
                        yield pack(ids, sets)
                        ids, sets, total = [], [], 0
        if ids:
            yield pack(ids, sets)

    return run


def _refs(refs: bytes, n: int) -> np.ndarray:
    """Places of n shingles among a run's ids, -1 for those counted already."""
    kind = np.uint16 if len(refs) == 2 * n else np.uint32
    raw = np.frombuffer(refs, kind)
    return np.where(raw == np.iinfo(kind).max, -1, raw.astype(np.int64))


def _redealt(top: int, bits: int, last: bool):
    """Runs of one bucket, from many chunks, made one chunk and dealt by the next bits."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        release()
        bucket, part = key[0].as_py(), key[1].as_py()
        if bucket < 0:  # counts
            return table.select(_RUN)
        ids = [np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()]
        tokens = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
        doc = [_refs(r, len(t)) for r, t in zip(table.column("refs").to_pylist(), tokens, strict=True)]
        base = np.cumsum([0, *map(len, ids)])
        doc = np.concatenate([np.where(d >= 0, d + o, -1) for d, o in zip(doc, base, strict=False)])
        rows = _run_rows(bucket, bucket << 20 | part, np.concatenate(ids), np.concatenate(tokens), doc, top, bits, last)
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RUN_TYPES, strict=True)], _RUN)

    return run


def _dealt(heads: DataFrame, total: int) -> DataFrame:
    """Packed runs of all sets, by buckets of about BUCKET shingles."""
    bits, schema = max(0, math.ceil(math.log2(max(1, total / BUCKET)))), "bucket long, chunk long, ids binary, tokens binary, refs binary"
    top = min(bits, DEAL)
    runs = heads.mapInArrow(_packer(top, bits == top), schema)
    while top < bits:  # never more than twice: 2^24 buckets are enough for 100 TB
        more = min(bits - top, DEAL)
        parts = max(1, math.ceil(total / (1 << top) / CHUNK))
        runs = runs.withColumn("part", F.expr(f"pmod(xxhash64(chunk), {parts})")).groupBy("bucket", "part").applyInArrow(_redealt(top, more, top + more == bits), schema)
        top += more
    return runs


def _shared_counts(table: pa.Table) -> pa.Table:
    """Of one bucket: to each chunk how many of a document's shingles another chunk or document has, packed."""
    release()
    tokens = [np.frombuffer(t, np.uint32) for t in table.column("tokens").to_pylist()]
    every = np.concatenate(tokens)
    order = np.argsort(every)
    shared = np.empty(len(every), bool)
    shared[order] = _runs(every[order])[1]
    rows, a = [], 0
    for chunk, ids, toks, refs in zip(table.column("chunk").to_pylist(), table.column("ids").to_pylist(), tokens, table.column("refs").to_pylist(), strict=True):
        if not len(toks):  # counted within its chunk
            rows.append((chunk, ids, refs))
            continue
        refs = _refs(refs, len(toks))
        count = np.bincount(refs[shared[a : a + len(refs)] & (refs >= 0)], minlength=1)
        a += len(refs)
        some = np.flatnonzero(count)
        if len(some):
            rows.append((chunk, np.frombuffer(ids, np.int64)[some].tobytes(), count[some].astype(np.uint32).tobytes()))
    columns = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["chunk", "ids", "counts"])


def _per_document(table: pa.Table) -> pa.Table:
    """Of one chunk: the sums of its documents."""
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()])
    who, at = np.unique(ids, return_inverse=True)
    sums = np.bincount(at, weights=np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()])).astype(np.int64)
    return pa.table({"doc_id": pa.array(who, pa.int64()), "shared": pa.array(sums, pa.int64())})


def _chunk_counts(bits: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        release()
        tokens = np.sort(_flat(table.column("tokens"))[0])
        at = np.flatnonzero(_runs(tokens)[0])
        count, tokens = np.diff(np.append(at, len(tokens))).astype(np.uint32), tokens[at]
        edge = [0, *(np.searchsorted(tokens, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else []), len(tokens)]
        rows = [(k, key[0].as_py(), tokens[a:b].tobytes(), count[a:b].tobytes()) for k, (a, b) in enumerate(itertools.pairwise(edge)) if b > a]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "chunk", "tokens", "counts"])

    return run


def _frequencies(table: pa.Table) -> pa.Table:
    """Of one bucket: to each chunk those of its shingles that two nodes or more have, with the number of nodes."""
    release()
    tokens = [np.frombuffer(t, np.uint64) for t in table.column("tokens").to_pylist()]
    every, count = np.concatenate(tokens), np.concatenate([np.frombuffer(c, np.uint32) for c in table.column("counts").to_pylist()]).astype(np.int64)
    order = np.argsort(every)
    at = np.flatnonzero(_runs(every[order])[0])
    sums = np.add.reduceat(count[order], at)
    df = np.empty(len(every), np.int64)
    df[order] = np.repeat(sums, np.diff(np.append(at, len(every))))
    out, a = ([], []), 0
    for t in tokens:
        d = df[a : a + len(t)]
        out[0].append(t[d > 1].tobytes())
        out[1].append(d[d > 1].tobytes())
        a += len(t)
    return pa.table({"chunk": table.column("chunk"), "tokens": pa.array(out[0], pa.binary()), "dfs": pa.array(out[1], pa.binary())})


def _prefixes(left: pa.Table, right: pa.Table) -> pa.Table:
    """Per node of a chunk its shared shingles within the 2-prefix, rarest first; nodes whose 1-prefix has none go."""
    release()
    rows: list[tuple] = []
    if right.num_rows:
        if pa.types.is_binary(right.schema.field("tokens").type):
            known = np.concatenate([np.frombuffer(t, np.uint64) for t in right.column("tokens").to_pylist()])
            dfs = np.concatenate([np.frombuffer(t, np.int64) for t in right.column("dfs").to_pylist()])
        else:
            known, dfs = (_flat(right.column(c))[0] for c in ("tokens", "dfs"))
            dfs = dfs.view(np.int64)
        order = np.argsort(known)
        known, dfs = known[order], dfs[order]
        flat, sizes = _flat(left.column("tokens"))
        for doc, tokens in zip(left.column("doc_id").to_pylist(), np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
            at = np.minimum(np.searchsorted(known, tokens), max(0, len(known) - 1))
            hit = known[at] == tokens if len(known) else np.zeros(len(tokens), bool)
            n, most = len(tokens), len(tokens) // 4 + 2 - (len(tokens) - int(hit.sum()))
            if most > 1:
                some, df = tokens[hit], dfs[at[hit]]
                order = np.lexsort((some, df))[:most]
                odd = np.packbits((np.bincount((tokens & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1).astype(np.uint8))
                rows.append((doc, n, len(some), some[order].view(np.int64), df[order], odd.view(np.int64)))
    columns = zip(*rows, strict=True) if rows else ([], [], [], [], [], [])
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()))
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "n", "shared", "tokens", "dfs", "parity"])


def _entries(heavy: bool, keys_of):
    """Entries (key, doc, n, shared, heavy) of the nodes of ``prefix`` by the keys of their prefix tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 64):
                columns = (batch.column(c).slice(part, 64).to_pylist() for c in ("tokens", "doc_id", "n", "shared"))
                rows = [(keys_of(np.array(t, np.int64).view(np.uint64)).view(np.int64), *rest) for t, *rest in zip(*columns, strict=True)]
                size = [len(r[0]) for r in rows]
                flat = [np.concatenate([r[0] for r in rows]), *(np.repeat([r[k] for r in rows], size) for k in (1, 2, 3))]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in flat), pa.array(np.full(len(flat[0]), heavy))], ["key", "doc", "n", "shared", "heavy"])

    return run


def _shingle_keys(t: np.ndarray) -> np.ndarray:
    """A key for each shingle of the 1-prefix."""
    return tb.mix(t[:-1] ^ tb.LANES[2])


def _subset_keys(t: np.ndarray) -> np.ndarray:
    """A key for each 2-subset of the 2-prefix."""
    i, j = np.triu_indices(len(t), 1)
    a, b = np.minimum(t[i], t[j]), np.maximum(t[i], t[j])
    return tb.mix(a * tb.LANES[0] + tb.mix(b ^ tb.LANES[1]))


def light_and_heavy(prefix: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Entries of light sets by 2-subsets, entries of heavy sets and of the border by single shingles, and the size x between them.

    Entries of the border are not marked ``heavy``: a list that has only such entries is of no use.
    """
    x, schema = light_bound(prefix), "key long, doc long, n long, shared long, heavy boolean"
    n = F.col("n")
    light = prefix.filter(n <= x).mapInArrow(_entries(True, _subset_keys), schema)
    heavy = prefix.filter(n > x).mapInArrow(_entries(True, _shingle_keys), schema)
    border = prefix.filter((n <= x) & (n > 0.75 * x)).mapInArrow(_entries(False, _shingle_keys), schema)
    return light, heavy.unionByName(border), x


#: What two list entries must fulfil to link: sizes within the threshold, and enough shared shingles in both,
#: as an intersection of 3/7 of both sizes together is needed.
FITS = "4 * least({0}n, {1}n) >= 3 * greatest({0}n, {1}n) and 7 * least({0}shared, {1}shared) >= 3 * ({0}n + {1}n)"


def verified(pairs: DataFrame, sets: DataFrame, percent: int = 75) -> DataFrame:
    """Pairs (a, b) with the exact size of the intersection; ``linked`` where 100 |A and B| >= percent * |A or B|."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    out = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("common"))
    return out.withColumn("linked", F.expr(f"100L * common >= {percent} * (na + nb - common)"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): of each node in ``edges`` (a, b) the smallest node reachable; min labels with pointer jumping."""
    both = saved(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        near = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = near.alias("x").join(labels.select(F.col("node").alias("label"), F.col("label").alias("next")), "label").select("node", "old", F.least("label", "next").alias("label"))
        step = saved(jump, "labels")
        if step.filter("old != label").isEmpty():
            return labels
        labels = step.select("node", "label")


#: Sets that link differ in at most a seventh of both sizes together, and no fewer than the hash cells they fill an odd
#: number of times differently: the bits of ``parity`` that differ.
NEAR = "7 * (" + " + ".join(f"bit_count({{0}}parity[{i}] ^ {{1}}parity[{i}])" for i in range(PARITY)) + ") <= {0}n + {1}n"


def _open_pairs(now: DataFrame, lists: DataFrame, parities: DataFrame) -> DataFrame:
    """Pairs of different classes in one list that could link, by blocks of BLOCK members: each pair of blocks is a join key of its own.

    A pair comes from the first list that is among the LEAST first of both its documents; pairs without such come from each list they share.
    """
    least = now.groupBy("doc").agg(F.slice(F.array_sort(F.collect_list("key")), 1, LEAST).alias("least"))
    parities = parities.join(least, "doc")
    dealt = now.join(lists.select("key", F.ceil(F.col("m") / BLOCK).alias("k")), "key").join(parities, "doc").withColumn("part", F.expr("pmod(xxhash64(doc), k)"))
    one = dealt.withColumn("hi", F.explode(F.sequence("part", F.col("k") - 1))).withColumn("lo", F.col("part")).alias("x")
    two = dealt.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("part")))).withColumn("hi", F.col("part")).alias("y")
    open_ = F.expr("x.key = y.key and x.lo = y.lo and x.hi = y.hi and x.label <> y.label and (x.lo <> x.hi or x.doc < y.doc) and " + FITS.format("x.", "y.") + " and " + NEAR.format("x.", "y.") + " and coalesce(array_min(array_intersect(x.least, y.least)), x.key) = x.key")
    return one.join(two, open_).select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b"))


def classes(members: DataFrame, verify, last_links, fits: str = FITS, prune=None) -> DataFrame | None:
    """Class labels of the nodes that have a link, from inverted lists (key, doc, n, shared).

    verify: of pairs (a, b) those that are ``linked``; fits: what two linked entries fulfil.
    prune: of nodes (doc) in lists that are open after the pivot rounds those that may still link, with ``apart``, by which a last pivot is chosen: the least.
    last_links: of the entries and lists that are open in the end, and the pairs tested, the links (a, b) between different classes of a list.
    """
    spark = members.sparkSession
    links = spark.createDataFrame([], "a long, b long")
    tested, labels = links, None
    rounds = PIVOT_ROUNDS + (1 if prune else 0)
    members = members.withColumn("apart", F.lit(0).cast("long"))
    for turn in range(rounds + 1):
        now = members if labels is None else members.join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("label", F.coalesce("label", "doc"))
        now = now.withColumn("label", F.col("doc")) if labels is None else now
        if prune and turn == PIVOT_ROUNDS:
            still = now.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("key")
            now = saved(now.join(still, "key").drop("apart"), "open")
            now = saved(now.join(prune(now.select("doc").distinct()), "doc"), "may-link")
            members = now.drop("label")
        pivot = F.min(F.struct("apart", F.xxhash64(F.lit(turn), "doc"), "doc", "n", "shared", "label"))
        lists = now.groupBy("key").agg(F.count("*").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi"), pivot.alias("p")).filter("lo != hi")
        if turn == rounds:
            found = saved(last_links(now, lists, tested), "last-links")
            return labels if found.isEmpty() else components(links.union(found.select("a", "b")))
        pairs = now.join(lists, "key").filter("label != p.label and " + fits.format("", "p.")).select(F.least("doc", "p.doc").alias("a"), F.greatest("doc", "p.doc").alias("b"))
        pairs = saved(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            if lists.isEmpty():
                break
            continue
        done = saved(verify(pairs), "verified")
        tested = tested.union(pairs)
        links = links.union(done.filter("linked").select("a", "b"))
        labels = None if links.isEmpty() else components(links)
    return labels


def _shared_frequencies(dealt: DataFrame, size: int) -> DataFrame:
    """To each chunk those of its shingles that two nodes or more have (tokens), with the number of nodes (dfs)."""
    bits = max(0, math.ceil(math.log2(max(1, size / BUCKET))))
    if bits <= DEAL:
        counts = dealt.groupBy("chunk").applyInArrow(_chunk_counts(bits), "bucket long, chunk long, tokens binary, counts binary")
        return counts.groupBy("bucket").applyInArrow(_frequencies, "chunk long, tokens binary, dfs binary")
    # runs would be short: single shingles are shuffled, counted before they are
    each = dealt.select("chunk", F.explode("tokens").alias("t")).groupBy("chunk", "t").agg(F.count("*").alias("c"))
    df = each.groupBy("t").agg(F.sum("c").alias("df")).filter("df > 1")
    return each.join(df, "t").groupBy("chunk").agg(F.collect_list("t").alias("tokens"), F.collect_list("df").alias("dfs"))


def _of_one_document(info: DataFrame, nodes: DataFrame, repeated: DataFrame) -> DataFrame:
    """Edges (a, b) between the representatives of the texts of one doc_id."""
    reps = join_ids(info.filter("n_shingles > 0"), repeated, "left_semi").join(nodes, "sig").select("doc_id", "rep").distinct()
    least = reps.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return reps.join(least, "doc_id").filter("rep != a").select("a", F.col("rep").alias("b")).distinct()


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    texts = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("own"))
    info = saved(texts.mapInArrow(_described, "doc_id long, own long, n_shingles long, sig binary"), "sets")
    # Written first, so that joins on ``sig`` shuffle both sides and AQE can split the copies of one set.
    nodes = saved(info.filter("n_shingles > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n")), "nodes")
    sizes = nodes.groupBy("rep").agg(F.min("n").alias("n"))
    copies = saved(info.filter("n_shingles > 0").join(nodes, "sig").filter("doc_id != rep").select("doc_id", "own"), "copies")
    repeated = saved(info.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id"), "repeated")
    total = info.agg(F.sum("n_shingles")).first()[0] or 0
    heads = join_ids(texts, copies, "left_anti", ["doc_id", "own"])
    if again := not repeated.isEmpty():
        heads = heads.dropDuplicates(["doc_id", "own"])
    heads = heads.select("doc_id", "text")
    shared = _dealt(heads, total).groupBy("bucket").applyInArrow(_shared_counts, "chunk long, ids binary, counts binary")
    shared = shared.groupBy("chunk").applyInArrow(_per_document, "doc_id long, shared long").groupBy("doc_id").agg(F.sum("shared").alias("shared"))
    alive = saved(shared.join(sizes.withColumnRenamed("rep", "doc_id"), "doc_id").filter("4 * shared >= 3 * n"), "alive")
    labels = None
    if not alive.isEmpty():
        size = alive.agg(F.sum("n")).first()[0]
        chunks = max(1, math.ceil(size / BUCKET))
        sets = saved(join_ids(heads, alive, "left_semi").mapInArrow(_with_tokens, "doc_id long, n long, tokens array<long>").filter("n > 0"), "tokens", "none")
        dealt = sets.withColumn("chunk", F.expr(f"pmod(xxhash64(doc_id), {chunks})")).select("doc_id", "tokens", "chunk")
        counts = _shared_frequencies(dealt, size)
        prefix = saved(dealt.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(_prefixes, "doc_id long, n long, shared long, tokens array<long>, dfs array<long>, parity array<long>"), "prefix")
        light, heavy, _ = light_and_heavy(prefix)
        keys = light.unionByName(heavy)
        lists = keys.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.bool_or("heavy").alias("heavy")).filter("lo != hi and heavy").select("key")
        parities = prefix.select(F.col("doc_id").alias("doc"), "parity")

        def open_links(now: DataFrame, lists: DataFrame, tested: DataFrame) -> DataFrame:
            pairs = saved(_open_pairs(now, lists, parities).distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
            return verified(pairs, sets).filter("linked")

        labels = classes(saved(keys.drop("heavy").join(lists, "key").distinct(), "lists"), lambda pairs: verified(pairs, sets), open_links)
    return labelled(info, nodes, labels, repeated if again else None)


def labelled(info: DataFrame, nodes: DataFrame, labels: DataFrame | None, repeated: DataFrame | None) -> DataFrame:
    """doc_id, n_shingles and component_id of the rows of ``info``, by the labels of their nodes and links between the texts of ``repeated`` ids."""
    if repeated is not None:
        edges = saved(_of_one_document(info, nodes, repeated), "own-edges")
        if not edges.isEmpty():
            labels = components(edges if labels is None else edges.union(labels.select("node", "label")))
    out = info.select("doc_id", "n_shingles", "sig").join(nodes.select("sig", "rep"), "sig", "left")
    if labels is None:
        labels = info.sparkSession.createDataFrame([], "node long, label long")
    out = out.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("label", "rep")).alias("component_id"))


def light_bound(prefix: DataFrame) -> int:
    """The size up to which sets are light: where the rows that both kinds of lists cost are least together.

    A 2-subset is a row.  An entry of a list is read twice in each round (to find the list's pivot, and to join it), but for
    no more members than the list has.  An entry of the border is a row.  Sizes are
    counted in classes a tenth apart, so the histogram that reaches the driver has at most a few hundred rows.
    """
    grid = prefix.select(
        F.floor(F.log(F.col("n").cast("double")) / math.log(1.1)).alias("g"),
        (F.size("tokens") * (F.size("tokens") - 1) / 2).alias("subsets"),
        (F.size("tokens") - 1).alias("entries"),
        F.expr(f"aggregate(slice(dfs, 1, greatest(size(dfs) - 1, 0)), 0L, (s, d) -> s + least(d, {2 * (PIVOT_ROUNDS + 1)}))").alias("reads"),
    )
    sums = [F.sum(c).alias(c) for c in ("subsets", "entries", "reads")]
    rows = sorted((1.1 ** (r["g"] + 1), r["subsets"], r["entries"], r["reads"]) for r in grid.groupBy("g").agg(*sums).collect())
    best, x = None, 0.0
    for bound in [0.0, *(r[0] for r in rows)]:
        cost = sum(subsets + (entries if top > 0.75 * bound else 0) if top <= bound * 1.0001 else reads for top, subsets, entries, reads in rows)
        if best is None or cost < best:
            best, x = cost, bound
    return math.floor(x)
