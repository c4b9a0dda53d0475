"""A trie over the bytes of word ids whose leaves are array containers that burst when they are full."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BURST = 1 << 15


class _Container:
    """Arrays of sorted phrases: a row for each word and one of counts."""

    __slots__ = ("parts", "size")

    def __init__(self, *parts: np.ndarray) -> None:
        self.parts, self.size = list(parts), sum(p.shape[1] for p in parts)

    def settle(self) -> None:
        """Add up equal phrases."""
        if len(self.parts) > 1:
            self.parts = [added(np.concatenate(self.parts, axis=1))]
            self.size = self.parts[0].shape[1]
        elif self.parts and self.parts[0].base is not None:  # a view would keep all rows it was added with
            self.parts = [self.parts[0].copy()]


class HatTrie:
    """Counts of phrases of ``depth`` word ids.

    A phrase is the string of the bytes of its ids; as ids are hashes, their bytes spread evenly.
    All phrases start in one container. A container that holds more than ``burst`` different
    phrases becomes a trie level: a table from the next byte to a container each. ``entries`` is
    the number of phrases held, those added again counted again until ``settle``.
    """

    def __init__(self, depth: int, burst: int = BURST):
        self.depth, self.burst, self.entries = depth, burst, 0
        self.root: _Container | list = _Container()

    def add(self, columns: list[np.ndarray], counts: np.ndarray) -> None:
        """Add distinct phrases in their order, one array per word."""
        if len(counts):
            self.root = self._add(self.root, np.stack([*columns, counts]).astype(np.int64, copy=False), 0)

    def _add(self, node, rows: np.ndarray, level: int):
        if isinstance(node, list):
            for byte, part in self._split(rows, level):
                node[byte] = self._add(node[byte] or _Container(), part, level + 1)
            return node
        before = node.size
        node.parts.append(rows)
        node.size += rows.shape[1]
        if node.size > self.burst:
            node.settle()
        self.entries += node.size - before
        return self._burst(node, level) if node.size > self.burst and level < 8 * self.depth else node

    def _split(self, rows: np.ndarray, level: int) -> Iterator[tuple[int, np.ndarray]]:
        """The phrases by their next byte. They have all bytes before it in common, so they stand in its order."""
        word, at = divmod(level, 8)
        bytes_ = (rows[word] >> (56 - 8 * at)) & 255
        if not at:
            bytes_ ^= 128  # negative ids come first
        edges = np.searchsorted(bytes_, np.arange(257)).tolist()
        for byte, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
            if lo < hi:
                yield byte, rows[:, lo:hi]

    def _burst(self, full: _Container, level: int) -> list:
        node: list = [None] * 256
        for byte, part in self._split(full.parts[0], level):
            child = _Container(part.copy())  # a view would keep all of the old container
            node[byte] = self._burst(child, level + 1) if child.size > self.burst and level + 1 < 8 * self.depth else child
        return node

    def settle(self) -> int:
        """Add up equal phrases everywhere; the number of phrases then."""
        for leaf in _leaves(self.root):
            leaf.settle()
        self.entries = _size(self.root)
        return self.entries

    def spill(self, leave: int) -> np.ndarray:
        """Take whole subtrees out, largest first, until at most ``leave`` phrases stay.

        Returns one sorted run: an array of ``depth`` columns of words and one of counts.
        """
        self.settle()
        if isinstance(self.root, _Container):
            out, self.root = [self.root], _Container()
            self.entries = 0
        else:
            sizes = sorted(((_size(node), byte) for byte, node in enumerate(self.root) if node), reverse=True)
            taken = []
            for size, byte in sizes:
                if self.entries <= leave:
                    break
                taken.append(byte)
                self.entries -= size
            out = [leaf for byte in sorted(taken) for leaf in _leaves(self.root[byte])]
            for byte in taken:
                self.root[byte] = None
        parts = [p for leaf in out for p in leaf.parts]
        return np.concatenate([np.empty((self.depth + 1, 0), np.int64), *parts], axis=1).T


def added(rows: np.ndarray) -> np.ndarray:
    """Phrases in order with equal ones added up: a row for each word, the last of counts."""
    rows = rows.take(np.lexsort(rows[-2::-1]), axis=1)
    if not rows.shape[1]:
        return rows
    new = np.flatnonzero(np.concatenate([[True], (rows[:-1, 1:] != rows[:-1, :-1]).any(axis=0)]))
    sums = np.add.reduceat(rows[-1], new)
    rows = rows.take(new, axis=1)
    rows[-1] = sums
    return rows


def _size(node) -> int:
    return node.size if isinstance(node, _Container) else sum(_size(child) for child in node if child)


def _leaves(node) -> Iterator[_Container]:
    """Containers in the order of their phrases."""
    if isinstance(node, _Container):
        yield node
    else:
        for child in node:
            if child:
                yield from _leaves(child)
