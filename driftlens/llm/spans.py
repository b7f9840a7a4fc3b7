"""Words of Arrow string columns as spans of their bytes, a bounded stretch of text at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from driftlens.llm.hashing import pieces, raw

#: Each byte with A-Z lowered; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(pattern_bytes: Iterator[int] | list[int], inside: bool = True) -> np.ndarray:
    """A table of 256 flags that are `inside` at the given bytes."""
    table = np.full(256, not inside)
    table[list(pattern_bytes)] = inside
    return table


@dataclass
class Stretch:
    """Bytes of rows first .. first + len(offsets) - 2, the first `overlap` words of which were seen before."""

    data: np.ndarray
    offsets: np.ndarray
    first: int
    overlap: int


def word_spans(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of solid bytes; runs never cross rows."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    inside = solid[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _cut(data: np.ndarray, at: int, solid: np.ndarray, step: int = 1 << 16) -> int:
    """The first place from `at` on that no word spans; the end if there is none."""
    while at < len(data):
        open_ = np.flatnonzero(~solid[data[at : at + step]])
        if len(open_):
            return at + int(open_[0])
        at += step
    return len(data)


def stretches(batch: pa.RecordBatch, column: str, solid: np.ndarray, keep: int, at_most: int = 4 << 20) -> Iterator[Stretch]:
    """All texts of a batch in stretches of about `at_most` bytes.

    Short texts share a stretch. A longer text is cut between words, and each of its stretches begins
    with the last `keep` words of the one before, so that runs of keep + 1 words are all seen."""
    done = 0
    for part in pieces(batch, column, at_most):
        data, offsets = raw(part.column(column))
        if part.num_rows > 1 or len(data) <= at_most:
            yield Stretch(data, offsets, done, 0)
        else:
            start = stop = overlap = 0
            while stop < len(data):
                stop = _cut(data, stop + at_most, solid)
                own = data[start:stop]
                yield Stretch(own, np.array([0, len(own)]), done, overlap)
                starts, _, _ = word_spans(own, np.array([0, len(own)]), solid)
                overlap = min(keep, len(starts))
                start = start + int(starts[len(starts) - overlap]) if overlap else stop
        done += part.num_rows
