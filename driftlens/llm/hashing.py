"""Vectorised 64-bit hashes of words and word shingles over Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_RANDOM = np.random.default_rng(20240611)
#: Random value of each byte; A-Z share those of a-z.
BYTE_VALUE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
BYTE_VALUE[65:91] = BYTE_VALUE[97:123]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes in which words that are hashed together begin.
STRETCH = 1 << 18
_SHINGLE = _RANDOM.integers(1, 1 << 63, 16, dtype=np.uint64) | U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with every output bit depending on every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int, base: np.uint64, store: dict = {}) -> np.ndarray:  # noqa: B006
    have = store.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if len(have) <= 1 << 23:
            store[int(base)] = have
    return have[:n]


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array (null: empty) and the offsets of its rows."""
    texts = pa.compute.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - (offsets[0] if len(offsets) else 0)


def pieces(batch: pa.RecordBatch, column: str, at_most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about `at_most` bytes; a longer text stands alone."""
    size = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = total = 0
    for i, n in enumerate(size):
        if total and total + n > at_most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(size):
        yield batch.slice(start)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word with A-Z lowered, in order; number of words of each row)."""
    data, offsets = raw(texts)
    n, rows = len(data), len(offsets) - 1
    if not n:
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    solid = ~IS_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:]))
    found = np.empty(len(starts), np.uint64)
    # a stretch of whole words at a time, so that 64-bit values of all bytes are never held at once
    cuts = np.searchsorted(starts, np.arange(0, n + STRETCH, STRETCH))
    for i, j in zip(cuts, cuts[1:], strict=False):
        if i == j:
            continue
        at, end = starts[i:j] - starts[i], ends[i:j] - starts[i] + 1
        size = int(end[-1])
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data[starts[i] : starts[i] + size]] * _powers(size, _BASE_INV), out=sums[1:])
        found[i:j] = (sums[end] - sums[at]) * _powers(size, _BASE)[at]
    found = mix(found + (ends - starts + 1).astype(np.uint64) * U(0xD6E8FEB86659FD93))
    return found, np.diff(np.searchsorted(starts, offsets))


def shingle_sets(texts: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each row, one row after another; their numbers).

    A row of fewer than k words has its whole sequence as its one shingle; without words it has none."""
    found, counts = word_hashes(texts)
    first = np.concatenate([[0], np.cumsum(counts)])
    rolled = np.zeros(len(found), np.uint64)
    if len(found) >= k:
        full = len(found) - k + 1
        for j in range(k):
            rolled[:full] += found[j : full + j] * _SHINGLE[j]
    rolled = mix(rolled + U(k))
    out, sizes = [], np.zeros(len(counts), np.int64)
    for i, n in enumerate(counts):
        a = first[i]
        if n >= k:
            own = np.unique(rolled[a : a + n - k + 1])
        elif n:
            own = mix(np.array([(found[a : a + n] * _SHINGLE[:n]).sum(dtype=np.uint64) + U(n)], np.uint64))
        else:
            continue
        sizes[i] = len(own)
        out.append(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes
