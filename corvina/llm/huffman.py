"""Canonical length-limited Huffman codes (package-merge), packed and decoded with numpy in independent blocks."""

from __future__ import annotations

import numpy as np

LIMIT = 16  # bits of the longest code, so of the decoding table; enough for 65,536 symbols
STRIDE = 256  # symbols from one checkpoint to the next


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for symbols with a positive count; 0 for the others."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need codes of more than {limit} bits")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.lexsort((used, counts[used]))]
    weight = counts[order].astype(np.int64)
    # Package-merge: of each level only how many single symbols precede each item is kept.
    level, singles = weight, [np.arange(1, len(weight) + 1)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        every = np.concatenate([weight, pairs])
        rank = np.argsort(every, kind="stable")
        level = every[rank]
        singles.append(np.cumsum(rank < len(weight)))
    take, depth = 2 * len(weight) - 2, np.zeros(len(weight), np.int64)
    for count in reversed(singles):
        if not take:
            break
        own = int(count[take - 1])
        depth[:own] += 1
        take = 2 * (take - own)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then symbol; the first bit is the highest."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    step = np.left_shift(1, LIMIT - lengths[order].astype(np.int64))
    start = np.cumsum(step) - step
    codes = np.zeros(len(lengths), np.uint64)
    codes[order] = (start >> (LIMIT - lengths[order].astype(np.int64))).astype(np.uint64)
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each LIMIT-bit prefix the symbol and the length of its code."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    step = np.left_shift(1, LIMIT - lengths[order].astype(np.int64))
    symbol, size = np.zeros(1 << LIMIT, np.uint32), np.ones(1 << LIMIT, np.uint8)
    n = int(step.sum())
    symbol[:n], size[:n] = np.repeat(order, step), np.repeat(lengths[order], step)
    return symbol, size


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of ``ids`` and the bit offsets of every STRIDE-th of them."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    total = int(ends[-1]) if len(ends) else 0
    out = np.zeros(total // 64 + 2, np.uint64)
    if total:
        word, room = at >> 6, 64 - (at & 63) - size
        code = codes[ids]
        over = room < 0
        high = np.where(over, code >> np.where(over, -room, 0).astype(np.uint64), code << np.where(over, 0, room).astype(np.uint64))
        heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        out[word[heads]] = np.bitwise_or.reduceat(high, heads)
        split = np.flatnonzero(over)
        out[word[split] + 1] |= code[split] << (64 + room[split]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: (total + 7) // 8], at[::STRIDE]


def unpack(data: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The n ids of a block: all stretches between checkpoints are decoded side by side, one symbol of each at a time."""
    symbol, size = table
    raw = np.frombuffer(data + b"\0" * (-len(data) % 8 + 16), ">u8").astype(np.uint64)
    out = np.zeros((STRIDE, len(checkpoints)), np.uint32)
    at = checkpoints.astype(np.int64).copy()
    last = len(raw) - 2
    for k in range(min(STRIDE, n)):
        word, bit = np.minimum(at >> 6, last), (at & 63).astype(np.uint64)
        peek = (raw[word] << bit) | ((raw[word + 1] >> np.uint64(1)) >> (np.uint64(63) - bit))
        head = (peek >> np.uint64(64 - LIMIT)).astype(np.int64)
        out[k] = symbol[head]
        at += size[head]
    return out.T.reshape(-1)[:n]
