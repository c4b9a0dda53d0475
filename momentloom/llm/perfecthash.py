"""A minimal perfect hash over 64-bit keys, with arrays of facts in its order.

Keys are thrown at a row of bits; those that land alone own their bit, the others are thrown again
at the next, smaller row. A key's index is the number of owned bits before its own. Keys still
together after the last row are kept in order, as they are.
"""

from __future__ import annotations

import io

import numpy as np

from momentloom.llm.bytescan import mix64

LEVELS = 24
SLACK = 1.5


def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix64(keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    def __init__(self, sizes: np.ndarray, owned: np.ndarray, rest: np.ndarray):
        self.sizes, self.owned, self.rest = sizes, owned, rest
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(owned)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """From distinct keys."""
        sizes, rows, left = [], [], keys
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(1, int(len(left) * SLACK))
            slot = _slot(left, level, size)
            hits = np.bincount(slot, minlength=size)
            rows.append(hits == 1)
            sizes.append(size)
            left = left[hits[slot] > 1]
        owned = np.concatenate(rows) if rows else np.zeros(0, dtype=bool)
        return cls(np.array(sizes, dtype=np.int64), owned, np.sort(left))

    def __len__(self) -> int:
        return int(self.ranks[-1]) + len(self.rest)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; an unknown key gets -1 or any other key's index."""
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            at = self.starts[level] + _slot(keys[open_], level, size)
            hit = self.owned[at]
            out[open_[hit]] = self.ranks[at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                return out
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            same = self.rest[at] == keys[open_]
            out[open_[same]] = self.ranks[-1] + at[same]
        return out

    def dump(self, **facts: np.ndarray) -> bytes:
        """The function and its arrays as one file."""
        out = io.BytesIO()
        np.savez(out, sizes=self.sizes, owned=np.packbits(self.owned), bits=np.array([len(self.owned)]), rest=self.rest, **facts)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> tuple[PerfectHash, dict[str, np.ndarray]]:
        held = dict(np.load(io.BytesIO(data)))
        owned = np.unpackbits(held.pop("owned"), count=int(held.pop("bits")[0])).astype(bool)
        return cls(held.pop("sizes"), owned, held.pop("rest")), held
