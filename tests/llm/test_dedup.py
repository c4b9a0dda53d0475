"""Exact, near and line deduplication against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from momentloom.llm import minhash, shingles
from momentloom.llm.components import components
from momentloom.llm.exactdedup import build_index, directory, exact_duplicates
from momentloom.llm.linededup import deduplicate_lines
from momentloom.llm.minhash import near_duplicates
from momentloom.llm.perfecthash import PerfectHash

DOCS = "doc_id long, text string, key string, norm string, node long, row long"
WHITE = "[\x20\x09-\x0d]+"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", "n", 1, 2) for i, t in rows], DOCS)


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


EDGE = [(5, None), (3, ""), (4, " \t\n"), (7, "a  b"), (6, "a\tb"), (9, "a b"), (9, "a b"), (None, "lone"), (1, "x" * 100_000), (2, "x" * 100_000)]


def exact_brute(rows):
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault(re.sub(WHITE, " ", t or ""), []).append(i)
    out = []
    for norm, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("key", [F.xxhash64, lambda c: F.length(c).cast("long")], ids=["hash", "colliding"])
def test_exact(spark, key):
    got = rows_of(exact_duplicates(frame(spark, EDGE), key, bucket_keys=2), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == exact_brute(EDGE)


def test_exact_empty_and_plan(spark):
    out = exact_duplicates(frame(spark, []))
    assert out.count() == 0
    plan = out._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_directory_splits_only_overfull_buckets(spark):
    # Keys crowd under one prefix: that bucket splits deeper than the others.
    keys = [(i << 50,) for i in range(16)] + [(-(1 << 62) + i,) for i in range(3)]
    slots, depth = directory(spark.createDataFrame(keys, "key long"), bucket_keys=4)
    depths = {r["bucket"]: r["depth"] for r in slots.collect()}
    assert depth == max(depths.values()) and min(depths.values()) < depth
    index = build_index(frame(spark, [(i, str(i)) for i in range(50)]), bucket_keys=4)
    assert index.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 4
    assert index.count() == 50


def near_brute(rows, percent=75):
    sets = {}
    for i, t in rows:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall("[^\x20\x09-\x0d]+", t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    ids = sorted(sets)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted(((i, len(sets[i]), find(i), find(i) == i) for i in ids), key=str)


def near_rows(seed=5, n=40):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(900)]
    rows, at = [], 0
    for size in (6, 30, 90, 250):
        for _ in range(n // 8):
            base = [rng.choice(words) for _ in range(size)]
            for _ in range(rng.randrange(1, 9)):
                copy = list(base)
                for _ in range(rng.randrange(0, max(2, size // 18))):
                    copy[rng.randrange(size)] = rng.choice(words)
                rows.append((at, " ".join(copy)))
                at += 1
    rng.shuffle(rows)
    return rows + [(9000, None), (9001, ""), (9002, "One TWO three"), (9003, "one two\nthree"), (9004, "é É x y z"), (9005, "é É X y z")]


def test_near(spark):
    rows = near_rows()
    got = rows_of(near_duplicates(frame(spark, rows)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == near_brute(rows)


def test_near_with_a_hub_that_is_not_the_smallest(spark, monkeypatch):
    # Copies of one text that are near to it but not to each other; blocks of a few rows.
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(2)
    base = [f"h{i}" for i in range(160)]
    rows = [(500, " ".join(base))]
    for i in range(60):
        copy = list(base)
        for at in rng.sample(range(160), 4 + i % 9):
            copy[at] = f"n{i}x{at}"
        rows.append((i, " ".join(copy)))
    got = rows_of(near_duplicates(frame(spark, rows)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == near_brute(rows)


def test_near_repeated_and_missing_ids(spark):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, "q r s t u"), (None, "q r s t u"), (1, "z")]
    got = rows_of(near_duplicates(frame(spark, rows)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted([(3, 2, 3, True)] * 2 + [(None, 2, 3, False)] + [(None, 1, None, True)] * 2 + [(1, 1, 1, True)], key=str)
    assert near_duplicates(frame(spark, [])).count() == 0


def test_signature_is_circulant_and_estimates(spark):
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 1200, dtype=np.uint64))
    b = np.concatenate([a[:900], rng.integers(0, 2**63, 300, dtype=np.uint64)])
    same = (minhash.signature(a) == minhash.signature(np.unique(b))).mean()
    assert abs(same - 900 / 1500) < 0.12
    place = (a >> np.uint64(32)).astype(np.uint32)
    assert minhash.signature(a)[7] == minhash._order((place + np.uint32(7)).copy()).min()
    assert shingles.overlap(np.sort(a), np.unique(b)) == 900


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 120), (120, 110), (7, 7), (None, 3), (3, 2)]
    got = dict(rows_of(components(spark.createDataFrame(links, "a long, b long")), "node", "root"))
    assert got == {i: 0 for i in range(41)} | {100: 100, 110: 100, 120: 100}


def test_perfect_hash():
    keys = np.random.default_rng(3).choice(2**62, 5000, replace=False).astype(np.uint64)
    table = PerfectHash.build(keys)
    assert sorted(table.index(keys).tolist()) == list(range(5000)) and len(table) == 5000
    again, facts = PerfectHash.load(table.dump(x=np.arange(3)))
    assert (again.index(keys) == table.index(keys)).all() and facts["x"].tolist() == [0, 1, 2]
    assert len(PerfectHash.build(keys[:0])) == 0


def lines_brute(rows, least=10):
    strip = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip("\x20\t\n\x0b\x0c\r"))
    held: dict[str, set] = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(strip(line)) >= least:
                held.setdefault(strip(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(strip(x), ())) > 1 and min(held[strip(x)]) != i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_lines(spark):
    rng = random.Random(4)
    pool = [f"Shared line number {i} é" for i in range(30)] + ["short", "", "  ", "ÄÖÜ"]
    rows = []
    for i in range(60):
        lines = [rng.choice(pool) if rng.random() < 0.5 else f"own line of {i} {k}" for k in range(rng.randrange(0, 12))]
        rows.append((i, "\n".join(x if rng.random() < 0.7 else f"\t{x.upper() if x.isascii() else x} \r" for x in lines)))
    rows += [(900, None), (901, ""), (902, "\n\n"), (903, "Shared line number 1 é\nShared line number 1 é"), (904, "z" * 200_000)]
    out = deduplicate_lines(frame(spark, rows), shard_keys=4)
    want = lines_brute(rows)
    assert rows_of(out, "doc_id", "n_lines", "n_dropped", "kept_text") == want
    digests = {r["doc_id"]: r["kept_sha256"] for r in out.collect()}
    assert digests == {i: hashlib.sha256(t.encode()).hexdigest() for i, _, _, t in want}


def test_lines_without_ids_and_rows(spark):
    rows = [(None, "a line that repeats"), (None, "a line that repeats"), (8, "only here, once\nA line that repeats")]
    got = rows_of(deduplicate_lines(frame(spark, rows)), "doc_id", "n_dropped")
    assert got == [(8, 0), (None, 1), (None, 1)]
    assert deduplicate_lines(frame(spark, [])).count() == 0


def test_self_similar_texts_differ(spark):
    """Words of equal letters in Thue-Morse order, which polynomials modulo a power of two confuse."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = one.translate(str.maketrans("ab", "ba"))
    docs = frame(spark, [(1, one), (2, other), (3, f"{one} {one} {one} {one} {one}"), (4, f"{other} {other} {other} {other} {other}")])
    assert rows_of(deduplicate_lines(docs), "doc_id", "n_dropped") == [(1, 0), (2, 0), (3, 0), (4, 0)]
    assert rows_of(near_duplicates(docs), "doc_id", "component_id") == [(1, 1), (2, 2), (3, 3), (4, 4)]
