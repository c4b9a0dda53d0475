"""Sets of five-word shingles, as sorted distinct 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from momentloom.llm import bytescan

WORDS = 5
_PLACE = np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, size=64, dtype=np.uint64) | np.uint64(1)


def row_sets(texts: pa.Array, size: int = WORDS) -> Iterator[np.ndarray]:
    """The set of each row: distinct ``size``-word shingles of the text with A-Z lower-cased; with
    fewer words the whole sequence is the one shingle; without words the set is empty."""
    for _, data, offsets in bytescan.slices(texts):
        data = bytescan.lower_ascii(data)
        starts, ends, first = bytescan.words(data, offsets)
        hashes = bytescan.segment_hashes(data, starts, ends)
        n = len(hashes)
        rolled = np.zeros(max(0, n - size + 1), dtype=np.uint64)
        for j in range(size if len(rolled) else 0):
            rolled += hashes[j : n - size + 1 + j] * _PLACE[j]
        rolled = bytescan.mix64(rolled)
        for a, b in zip(first[:-1], first[1:], strict=True):
            count = b - a
            if count >= size:
                yield np.unique(rolled[a : b - size + 1])
            elif count:
                short = (hashes[a:b] * _PLACE[:count]).sum(dtype=np.uint64) + np.uint64(count)
                yield bytescan.mix64(np.array([short], dtype=np.uint64))
            else:
                yield np.zeros(0, dtype=np.uint64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if not len(a) or not len(b):
        return 0
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())
