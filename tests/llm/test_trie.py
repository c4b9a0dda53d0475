"""The conversation trie against a walk over all prefixes."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from momentloom.llm import convtrie
from momentloom.llm.queries import _shared_turns

SCHEMA = "conv_id long, turn long, role string, text string, depth string, c string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def brute(rows, rebuilt):
    own: dict[int, list] = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            dig = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, dig, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuilt else 0
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        seqs[c] = tuple(own.get(base, [])[:h] + said[h:])
    members: dict[tuple, list] = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    out = []
    for prefix, held in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        kids = [p for p in below if len(p) == len(prefix) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in held if len(seqs[c]) == len(prefix))))
        parent = min(members[prefix[:-1]]) if prefix else None
        out.append((min(held), len(prefix), parent, len(held), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def talk(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-45, 90), n):
        rows += [(c, t, rng.choice(["user", "bot", None]), rng.choice(["hi", "a b", "", None, "c\td e"])) for t in range(rng.choice([1, 2, 3, 5, 9, 14]))]
    rows += [(200 + c, t, "user", f"same {t}") for c in range(40) for t in range(11)]
    rows += [(400 + c, t, "user", f"same {t if t < 9 else c % 3}") for c in range(15) for t in range(10)]
    return rows


@pytest.mark.parametrize("rebuilt", [False, True])
def test_trie(spark, monkeypatch, rebuilt):
    monkeypatch.setattr(convtrie, "BLOCKS_PER_CHUNK", 2)
    monkeypatch.setattr(convtrie, "PIECE_IDS", 3)
    rows = talk(3)
    # Nulls, ties, repeated rows, rows without an id, one very long text.
    rows += [(1000, None, "user", "z"), (1000, 0, None, None), (1000, 0, "b", "x"), (1000, 0, "b", "x"), (None, 1, "user", "hi"), (1001, 1, "u", "w " * 50_000)]
    got = convtrie.conversation_trie(frame(spark, rows), _shared_turns if rebuilt else None)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect())) == brute(rows, rebuilt)


def test_turnless_and_empty(spark):
    # None of these has turns left: 4, 5 and 6 have no family head, and each loses its first turns.
    some = [c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4]
    rows = [(c, 1, "user", "x") for c in some]
    got = sorted(map(tuple, convtrie.conversation_trie(frame(spark, rows), _shared_turns).collect()))
    assert got == brute(rows, True) and len(got) == 1
    assert convtrie.conversation_trie(frame(spark, []), _shared_turns).count() == 0
