"""Vectorised work on the bytes of many texts at once (numpy over Arrow buffers)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step takes; a longer text is a step of its own.
STEP = 1 << 20

_rng = np.random.default_rng(20240607)
BYTE_KEY = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
LANES = _rng.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: U+0020 and U+0009 to U+000D
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def steps(texts: pa.Array | pa.ChunkedArray, limit: int = STEP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets into them) for runs of whole texts; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b, raw[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of each text, in order, and where each text's words begin."""
    b = LOWER[raw]
    solid = ~SPACE[b]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = off[:-1][off[:-1] < len(b)]
    first[heads] = solid[heads]
    starts = np.flatnonzero(first)
    bounds = np.searchsorted(starts, off)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    b, solid, rel = b[starts[0] :], solid[starts[0] :], starts - starts[0]
    at = np.arange(len(b), dtype=np.int64)
    at -= np.repeat(rel, np.diff(np.append(rel, len(b))))
    power = np.full(int(at.max()) + 1, BASE)
    power[0] = 1
    part = BYTE_KEY[b] * np.multiply.accumulate(power)[at]
    part[~solid] = 0
    return mix(np.add.reduceat(part, rel)), bounds


def shingle_sets(raw: np.ndarray, off: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Per text its sorted distinct shingle hashes; a text with fewer words is one shingle, one without words none."""
    h, bounds = word_hashes(raw, off)
    lanes = [h * LANES[j] for j in range(size)]
    full = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for j in range(size):
        full += lanes[j][j : j + len(full)]
    full = mix(full)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            s = np.sort(full[a : b - size + 1])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            short = sum((lanes[j][a + j : a + j + 1] for j in range(b - a)), np.full(1, b - a, np.uint64))
            out.append(mix(short ^ LANES[7]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
