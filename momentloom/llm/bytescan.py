"""Vectorised scans over the UTF-8 bytes of an Arrow string column.

Words and lines of a run of rows are cut at once; each is hashed by XXH3, whose collisions do not
follow the structure of a text. Runs are small, so that a worker's memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

SLICE_BYTES = 1 << 18
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` of runs of rows of about ``limit`` bytes; a longer text is a
    run of its own. Nulls read as empty."""
    texts = pa.array([], pa.large_string()) if not len(texts) else texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), len(texts))
        yield at, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of the bytes of each ``[start, end)``; ``which`` seeds independent ones."""
    raw = data.tobytes()
    found = (xxh3_64_intdigest(raw[a:b], which) for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
    return np.fromiter(found, dtype=np.uint64, count=len(starts))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without ASCII white space, and the first word of each row
    (one entry more than rows)."""
    solid = ~_SPACE[data]
    before = np.zeros(len(data), dtype=bool)
    after = np.zeros(len(data), dtype=bool)
    before[1:] = solid[:-1]
    after[:-1] = solid[1:]
    filled = offsets[:-1] < offsets[1:]
    before[offsets[:-1][filled]] = False
    after[offsets[1:][filled] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines split at newlines, and the first line of each row (one entry
    more than rows). A row without text is one empty line."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    counts = 1 + np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1])
    return starts, ends, np.concatenate([[0], np.cumsum(counts)])


def strip(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments without ASCII white space at both ends; a blank segment ends where it starts."""
    at = np.flatnonzero(~_SPACE[data])
    lo = np.searchsorted(at, starts)
    hi = np.searchsorted(at, ends) - 1
    some = lo <= hi
    new_starts, new_ends = starts.copy(), starts.copy()
    new_starts[some] = at[lo[some]]
    new_ends[some] = at[hi[some]] + 1
    return new_starts, new_ends


def code_points(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code points of each segment."""
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return first[ends] - first[starts]
