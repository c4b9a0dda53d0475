"""Mixing, decontamination and the pipeline."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

import corpus_pipeline
from momentloom.llm import decontam, mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, target string, _found long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "s", "t", 1) for i, t, s in rows], DOCS)


def fair_targets(sizes, weights=(3, 1, 2)):
    """Share the excess again and again until no source is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, done = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in done]
        free = total - sum(done.values())
        share = {s: free * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] >= 2 * sizes[s]]
        if not over:
            return done | share
        done |= {s: 2.0 * sizes[s] for s in over}
        if len(done) == len(order):
            return done


def mix_rows(seed):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 40, 300]))), rng.choice(["a", "b", "b", "b", "ü", None, "z"])) for i in range(150)]
    return rows + [(900, None, "a"), (901, "x " * 5000, "b"), (902, "lone words", "only")]


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    rows = mix_rows(seed)
    got = [r.asDict() for r in mixing.mix(frame(spark, rows)).collect()]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    goal = fair_targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(goal[r["source"]])
        assert r["taken"] <= 2 * r["size"] and (r["taken"] > 0) == (r["position"] is not None)
        taken[r["source"]] += r["taken"]
    assert len(got) == len(rows)
    for s, t in taken.items():
        assert abs(t - goal[s]) <= 1
    placed = [r["position"] for r in got if r["position"] is not None]
    assert placed == sorted(placed)
    again = mixing.mix(frame(spark, rows[::-1])).collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in mixing.mix(frame(spark, rows)).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_order_places_every_occurrence(spark, seed):
    rows = mix_rows(seed)
    docs = frame(spark, rows)
    got = [r.asDict() for r in corpus_pipeline.mix_sources(spark, docs, "").collect()]
    digest = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    assert {r["doc_id"] for r in got} == set(digest)
    placed = [r["position"] for r in got if r["position"] is not None]
    assert placed == sorted(placed) and all(r["position"] is None for r in got[len(placed):])
    for i, d in digest.items():
        own = [r for r in got if r["doc_id"] == i]
        assert [r["pass"] for r in own] == (list(range(d["passes"])) or [None])
        assert sum(r["words"] for r in own) == d["taken"] and own[0]["position"] == d["position"]
    assert any(r["pass"] == 1 for r in got)
    # Read in order, each source meets its schedule up to the end of its target.
    tilt = dict(zip(sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or "")), [0.5, -0.5, 0.0] * 2))
    read = Counter()
    for s in tilt:
        mine = sorted((r for r in got if r["source"] == s and r["pass"] is not None), key=lambda r: (r["position"], r["pass"]))
        for r in mine:
            u = r["position"] / 1e6
            assert ((1 - tilt[s]) * u + tilt[s] * u * u) * r["target"] == pytest.approx(read[s], abs=0.01 + 2e-6 * r["target"])
            read[s] += r["words"]
        assert read[s] == round(mine[0]["target"])


def test_mix_edges(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    row = mixing.mix(frame(spark, [(1, None, "a"), (2, "", "a")])).collect()
    assert [(r["size"], r["target"], r["taken"], r["position"]) for r in row] == [(0, 0.0, 0, None)] * 2


def test_curriculum_follows_the_schedule(spark):
    # 0.5u + 0.5u^2 = 0.28 at u = 0.4, so 28 % of the target, 42 % of the source, comes that early.
    rows = [(i, "w w w w", "a") for i in range(2000)]
    got = mixing.mix(frame(spark, rows), tilts=(0.5,)).collect()
    early = sum(r["position"] <= 400_000 for r in got if r["position"] is not None) / 2000
    assert early == pytest.approx(0.42, abs=0.01)


def items(seed=3, n=30):
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(400)] + ["the", "of", "and"] * 60
    out = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(8, 50))]
        cut = rng.randrange(3, len(w) - 3)
        tail = " ".join(w[cut:]) + "." if i % 3 else " ".join(w[cut:-1]) + ". " + w[-1] + "."  # an answer of one word
        out.append((i, " ".join(w[:cut]) + ". " + tail))
    return rng, words, out


def brute_leaks(docs, bench):
    """All items against all windows, by the same definitions."""
    toks = {i: decontam.tokens(t) for i, t in bench}
    toks = {i: w for i, w in toks.items() if w}
    df = Counter(w for t in toks.values() for w in set(t))
    mean = sum(map(len, toks.values())) / len(toks)
    half = max([decontam.MIN_HALF, *map(len, toks.values())])
    out = set()
    for d, text in docs:
        words = decontam.tokens(text)
        n = -(-len(words) // half)
        for p in range(max(1, n - 1)):
            window = words[p * half : (p + 2) * half]
            held, text = set(window), f" {' '.join(window)} "
            cut = {tuple(window[k : k + 5]) for k in range(len(window) - 4)}

            def share(part):
                own = {tuple(part[k : k + 5]) for k in range(len(part) - 4)}
                return len(own & cut) / len(own) if own else float(f" {' '.join(part)} " in text)

            for i, w in toks.items():
                tf = Counter(w)
                k = 1.2 * (0.25 + 0.75 * len(w) / mean)
                impact = {x: math.log(1 + (len(toks) - df[x] + 0.5) / (df[x] + 0.5)) * c * 2.2 / (c + k) for x, c in tf.items()}
                if sum(v for x, v in impact.items() if x in held) < 0.5 * sum(impact.values()) - 1e-9:
                    continue
                question, answer = decontam.question_answer(dict(bench)[i])
                shares = [share(x) for x in (w, question, answer)]
                if shares[0] >= 0.75 and min(shares[1:]) >= 0.5:
                    out.add((d, i))
    return out


def test_decontamination(spark):
    rng, words, bench = items()
    docs = []
    for d in range(80):
        body = [rng.choice(words) for _ in range(rng.randrange(0, 300))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            w = dict(bench)[rng.randrange(30)].split()
            if rng.random() < 0.3:
                w[rng.randrange(len(w))] = "changed"
            if rng.random() < 0.2:
                w = w[: len(w) // 2]
            at = rng.randrange(len(body) + 1)
            body[at:at] = w
        docs.append((d, " ".join(body).upper() if d % 7 == 0 else " ".join(body)))
    docs += [(900, None), (901, ""), (902, bench[0][1] * 400)]
    table = frame(spark, [(i, t, "s") for i, t in docs])
    bench_table = spark.createDataFrame([(i, t, "x") for i, t in [*bench, (99, None), (98, "..."), (None, "no id at all here")]], "item_id long, text string, doc_id string")
    want = brute_leaks(docs, [(i, t) for i, t in bench])
    # Every whole item is found, whatever its sentences are.
    squeeze = lambda t: " ".join(decontam.tokens(t))
    whole = {(d, i) for d, t in docs for i, b in bench if squeeze(b) in squeeze(t)}
    assert len(whole) > 20 and whole <= want
    for shards in (20_000, 7):
        got = decontam.contaminated(table, bench_table, shards)
        assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
    kept = decontam.clean(table, bench_table)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert kept.columns == table.columns
    assert decontam.contaminated(table, bench_table.limit(0)).count() == 0
    assert decontam.contaminated(table.limit(0), bench_table).count() == 0


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    words = [f"u{i}" for i in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, labels = [], []
    for i in range(200):
        body = text(60)
        toxic = i % 4 == 0
        rows.append((i, body + (" vile rotten " if toxic else "") + text(20), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(toxic)))
    bench = [(0, text(30) + ". " + text(9) + ".")]
    rows += [(300, rows[1][1].replace(" ", "  "), "en", "s0", 0), (301, rows[2][1] + " tail", "en", "s1", 0),
             (302, text(50) + " " + bench[0][1] + " " + text(50), "en", "s2", 0), (303, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i for i in range(200) if i % 4} | {303}
    empty = tmp_path / "empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
