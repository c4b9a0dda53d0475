"""HAT-trie counts and collocations against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa

from momentloom.llm import collocations as co
from momentloom.llm.hattrie import HatTrie, _leaves

SCHEMA = "text string, lang string, word string, id long, n long"


def brute(rows, top, least, longest):
    f: dict[str, Counter] = {}
    for text, lang in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, longest + 1):
                f.setdefault(lang or "und", Counter()).update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for k, v in c.items() if len(k) == 1)
        cands = {k: v for k, v in c.items() if len(k) > 1 and v >= least}
        inside: dict[tuple, int] = {}
        for p, v in cands.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    inside[p[i : i + size]] = max(v, inside.get(p[i : i + size], 0))
        scored = []
        for p, a in cands.items():
            if 100 * inside.get(p, -1) >= 50 * a:
                continue
            score, _, l, r = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def test_trie_bursts_and_spills():
    rng, trie, want, got = np.random.default_rng(1), HatTrie(3, burst=20), Counter(), Counter()
    for _ in range(30):
        rows, n = np.unique(rng.integers(-5, 5, (300, 3)), axis=0, return_counts=True)
        trie.add(rows.T.tolist(), n.tolist())
        want.update({tuple(r): int(k) for r, k in zip(rows.tolist(), n)})
        if trie.entries > 400:
            run = trie.spill(200)
            assert trie.entries <= 200 and run[:, :3].tolist() == sorted(run[:, :3].tolist())
            got.update({tuple(r[:3]): r[3] for r in run.tolist()})
    run = trie.spill(0)
    assert trie.entries == 0
    for r in run.tolist():
        got[tuple(r[:3])] += r[3]
    assert got == want


def run(spark, rows, **kw):
    df = spark.createDataFrame([(t, lang, "w", 1, 2) for t, lang in rows], SCHEMA)
    got = co.collocations(df, **kw)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, got.collect()))


def test_against_counting(spark, monkeypatch):
    monkeypatch.setattr(co, "SPILL_PHRASES", 60)
    monkeypatch.setattr(co, "RUN_WORDS", 100)
    rng = random.Random(4)
    vocabulary = ["new", "York", "city", "of", "the", "é", "ß", "Über", "a", "b", "x\x0by", "$", "'"]
    rows = [(" ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", ". ", "\n", "\t"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und"])) for _ in range(120)]
    rows += [("hot pair " * 3000, "en"), (None, "en"), ("", None), ("...", "en"), ("one", "xx"), (" \t lead and trail \t ", "en")] + [("in spite of", "fr")] * 12
    for longest in (3, 4):
        assert run(spark, rows, top=40, least=10, max_words=longest) == brute(rows, 40, 10, longest)


def test_full_bitmap_changes_nothing(spark, monkeypatch):
    """Every phrase passes the bitmap, those across breaks too."""
    monkeypatch.setattr(co.Present, "__call__", lambda self, hashes: np.ones(len(hashes), dtype=bool))
    rows = [("a b. a b, c d! c d. a c", "en")] * 12
    assert run(spark, rows) == brute(rows, 2000, 10, 3)


def test_empty_and_colliding_words(spark, monkeypatch):
    assert run(spark, []) == [] and run(spark, [(None, None)]) == []
    true_id = co._word_id
    # The first seed gives all words one id.
    monkeypatch.setattr(co, "_word_id", lambda seed, lang, word: true_id(seed, lang, word) if seed else true_id(0, lang, lang))
    rows = [("red green blue", "en")] * 11
    assert run(spark, rows) == brute(rows, 2000, 10, 3)


def test_large_counts_are_exact(spark):
    row = spark.range(1).selectExpr("99999999999999 as a", "99999999999999 as l", "100000000000000 as r")
    assert row.select(co._score("a", "l", "r")).first()[0] == 1000000 * 99999999999999**2 // (99999999999999 * 100000000000000)


def test_words_are_cut_by_plain_replacements(spark):
    df = spark.createDataFrame([("A b,\tC!!  d\x0b.É\xa0x ",), (None,)], "text string").select(co.words_of().alias("w"))
    assert [r.w for r in df.collect()] == [["a", "b", ".", "c", ".", ".", "d", ".", ".", "É\xa0x"], []]
    assert "regexp" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_an_id_is_looked_up_once_in_a_run(monkeypatch):
    ids, seen = np.arange(1, 1_001) % 7, []
    factorize = pd.factorize
    monkeypatch.setattr(co.pd, "factorize", lambda x: seen.append(len(x)) or factorize(x))
    words, counts = co._phrases(ids, 3, co.Present(np.full(8, 255, np.uint8)))
    assert sum(seen) <= len(ids)
    assert {tuple(w): n for *w, n in zip(*words.tolist(), counts.tolist())} == Counter(zip(*(ids[j : 998 + j].tolist() for j in range(3))))


def test_runs_travel_in_pieces():
    """A row for each prefix partition of a run, not for each phrase; the merge finds all of them, in more pieces than planned too."""
    rng = np.random.default_rng(5)
    ids = rng.integers(-(2**63), 2**63 - 1, 2_000)[rng.zipf(1.3, 60_000) % 2_000]
    want = Counter(zip(ids[:-1].tolist(), ids[1:].tolist()))
    halves = [ids[:30_001], ids[30_000:]]  # two tasks; they share one word, no pair
    for parts in (1, 7, 1 << 17):
        runs = [b for half in halves for b in co._runs(2, SimpleNamespace(value=np.full(8, 255, np.uint8)), parts)(iter([pa.record_batch([pa.array([half])], ["ids"])]))]
        assert parts > 7 or sum(b.num_rows for b in runs) <= 2 * parts
        pieces = pa.Table.from_batches(runs).sort_by("part").combine_chunks().to_batches(max_chunksize=5)
        for least in (1, 10):
            got = [r for b in co._merge(2, least)(iter(pieces)) for r in zip(*b.to_pydict().values())]
            assert len(got) == len(set(got)) and {r[:2]: r[2] for r in got} == {k: n for k, n in want.items() if n >= least}


def test_more_phrases_of_a_partition_than_planned(spark, monkeypatch):
    monkeypatch.setattr(co, "MERGE_PHRASES", 3)
    monkeypatch.setattr(co, "RUN_WORDS", 50)
    monkeypatch.setattr(co, "SPILL_PHRASES", 20)
    rng = random.Random(6)
    rows = [(" ".join(rng.choice("abcdef") for _ in range(200)), "en") for _ in range(40)]
    assert run(spark, rows, least=2, max_words=4) == brute(rows, 2000, 2, 4)


def test_spilled_trie_keeps_no_rows_of_others():
    trie = HatTrie(2, burst=500)
    for k in range(3):
        rows = np.unique(np.random.default_rng(k).integers(-(2**63), 2**63 - 1, (2_000, 2)), axis=0)
        trie.add(list(rows.T), np.ones(len(rows), dtype=np.int64))
    trie.spill(1_000)
    kept = [p for leaf in _leaves(trie.root) for p in leaf.parts]
    assert sum(p.shape[1] for p in kept) == trie.entries <= 1_000 and all(p.base is None for p in kept)
