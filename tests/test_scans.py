"""Chunked recurrences against plain loops, for any chunk size."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from momentloom.operators import scans, segment, tracks
from momentloom.plans import registry


def series(seed, n):
    rng, x, out = random.Random(seed), 0.0, []
    for _ in range(n):
        x += rng.choice([rng.gauss(0, 1), rng.gauss(0, 30), 0.0])
        out.append(x)
    return out


def loop_smooth(xs, a=0.16):
    f = []
    for x in xs:
        f.append(x if not f else a * x + (1 - a) * f[-1])
    b = []
    for x in reversed(f):
        b.append(x if not b else 0.6 * x + 0.4 * b[-1])
    return b[::-1]


def loop_slew(xs, step):
    out = []
    for x in xs:
        out.append(x if not out else out[-1] + max(-step, min(step, x - out[-1])))
    return out


def test_limit_maps_compose():
    rng = random.Random(2)
    for trial in range(200):
        xs, step = series(trial, rng.randint(1, 40)), rng.choice([0.0, 0.5, 3.0, 100.0])
        corners = scans.Limit.compose(xs, step)
        assert len(corners) <= 4 * len(xs)
        for before in [rng.gauss(0, 100) for _ in range(10)] + corners[: len(corners) // 2]:
            assert scans.Limit.apply(corners, before) == pytest.approx(scans.Limit.run(xs, before, step)[-1], abs=1e-9)


@pytest.mark.parametrize("size", [1, 2, 7, 64, 4096])
def test_any_chunk_size(spark, size):
    keys = {"a": series(1, 300), "b": series(2, 1), "c": series(3, 129), "d": [5.0] * 64}
    rows = [(k, i, x) for k, xs in keys.items() for i, x in enumerate(xs)]
    random.Random(0).shuffle(rows)
    chunks = scans.chunked(spark.createDataFrame(rows, "k string, i bigint, x double"), "k", "i", "x", size)
    smooth = {(r.k, r.i): r.x for r in scans.unchunked(tracks.smoothed(chunks, "k"), "i", "x", size).collect()}
    steps = chunks.selectExpr("*", "if(k = 'a', 2.5, 40.0) as step")
    slew = {(r.k, r.i): r.x for r in scans.unchunked(tracks.slew_limited(steps, "step", "k"), "i", "x", size).collect()}
    assert len(smooth) == len(slew) == len(rows)
    for k, xs in keys.items():
        for i, (a, b) in enumerate(zip(loop_smooth(xs), loop_slew(xs, 2.5 if k == "a" else 40.0))):
            assert smooth[k, i] == pytest.approx(a, abs=1e-9) and slew[k, i] == pytest.approx(b, abs=1e-9)
    if size == 4096:  # one chunk: the very same numbers
        assert [smooth["a", i] for i in range(300)] == loop_smooth(keys["a"])


def test_changed_points(spark):
    xs = [3, 3, 4, 4, 4, 4, 1, 1]
    for size in (1, 3, 8):
        chunks = [("k", c, len(xs), xs[c * size : (c + 1) * size]) for c in range(-(-len(xs) // size))]
        df = spark.createDataFrame(chunks, "k string, chunk bigint, n bigint, px array<bigint>")
        got = sorted((r.t_ms, r.x) for r in tracks.changed_points(df, "k", "n", 10, size).collect())
        assert got == [(0, 3), (20, 4), (60, 1), (70, 1)]


def test_long_track_query(spark, tmp_path):
    sf_dir = str(tmp_path)
    spark.range(10_000).selectExpr(
        "id div 7 as l_orderkey", "int(id % 7) as l_linenumber", "cast(id * 7919 % 100003 as decimal(12, 2)) as l_extendedprice",
    ).write.parquet(f"{sf_dir}/lineitem.parquet")
    got = {r.i: r.value for r in registry.slew_long_track(spark, sf_dir).collect()}
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").orderBy("l_orderkey", "l_linenumber", "l_extendedprice").select("l_extendedprice").collect()
    want = loop_slew([float(r[0]) for r in lines], 500.0)
    assert len(got) == len(want) and all(abs(got[i] - x) < 1e-6 for i, x in enumerate(want))


def test_best_runs_equal_all_starts_and_lengths():
    rng = random.Random(5)
    alphabet = list("abcdefghij")
    found = 0
    for _ in range(400):
        spoken = [rng.choices(alphabet, k=rng.choice([0, 1, 1, 1, 2])) for _ in range(rng.randrange(1, 30))]
        goals = [(rng.randrange(0, 8), set(rng.choices(alphabet, k=rng.randrange(0, 6)))) for _ in range(3)]
        want = []
        for n, goal in goals:
            best = (0.0, 0, 0, 0)
            for start in range(len(spoken)):
                for rank, span in enumerate((n, n - 1, n + 1, n - 2, n + 2)):
                    run = {t for tokens in spoken[start:start + span] for t in tokens}
                    if span > 0 and start + span <= len(spoken) and run and goal and n:
                        best = max(best, (len(run & goal) / len(run | goal), -start, -rank, span))
            want.append({"start": 1 - best[1], "span": best[3]} if best[0] >= 0.55 else {"start": 0, "span": 0})
        assert segment.best_runs(spoken, goals) == want
        found += sum(w["span"] > 0 for w in want)
    assert found > 200


def test_best_runs_are_linear_in_the_words():
    words = [[f"w{i}"] for i in range(300_000)]
    goals = [(10, {f"w{i + k}" for k in range(10)}) for i in range(0, 300_000, 10)]
    assert [r["start"] for r in segment.best_runs(words, goals)] == list(range(1, 300_001, 10))


def test_best_runs_of_a_long_line_visit_few_starts():
    rng = random.Random(3)
    words = [[w] for w in rng.choices([f"w{i}" for i in range(300)], weights=[1 / (i + 1) for i in range(300)], k=4_000)]
    goals = [(8, {words[i + k][0] for k in range(8)}) for i in range(0, 3_990, 8)]
    places = {t: [i for i, w in enumerate(words) if w[0] == t] for t in {w[0] for w in words}}
    visited = sum(hi - lo + 1 for _, goal in goals for lo, hi in segment._starts(places, goal, 10, len(words)))
    assert visited < 0.2 * len(goals) * len(words)
    for n in (8, 300):  # grown sets and sliding counts
        goal = {t for w in words[1_000 : 1_000 + n] for t in w}
        (got,) = segment.best_runs(words, [(n, goal)])
        best = max((len(run & goal) / len(run | goal), -s, -r, n + d) for s in range(len(words)) for r, d in enumerate(segment.LENGTHS)
                   if s + n + d <= len(words) for run in [{t for w in words[s : s + n + d] for t in w}])
        assert (1 - best[1], best[3]) == (got["start"], got["span"])


def test_a_worker_holds_few_chunks_at_a_time():
    flat = pa.array([float(i) for i in range(300)])
    xs = pa.ListArray.from_arrays(pa.array(range(0, 301, 3), pa.int32()), flat)
    none = pa.array([None] * 100, pa.float64())
    batch = pa.RecordBatch.from_arrays([pa.array(["k"] * 100), pa.array(range(100)), xs, none, none], names=["k", "chunk", "xs", "before", "_step"])
    for step in (scans._compose, scans._run):
        out = list(step(scans.Mean(0.16), False)(iter([batch])))
        assert max(b.num_rows for b in out) <= scans.ROWS_AT_ONCE and sum(b.num_rows for b in out) == 100


@pytest.mark.parametrize("size", [1, 3, 50, 4096])
def test_resampling_equals_a_plain_search(spark, size):
    rng = random.Random(size)
    clips = [("k", f"c{j}", lo, lo + rng.choice([50, 900, 2_500])) for j, lo in enumerate(range(0, 20_000, 700))] + [("k", "c3", 2_100, 2_100 + 900)]
    clips = [c if c[1] != "c3" else ("k", "c3", 2_100, 3_000) for c in clips] + [("z", "none", 0, 500), (None, "no track", 0, 500), ("k", None, 0, 500), ("k", "no time", None, 500)]
    obs = [("k", rng.randrange(0, 22_000), rng.choice([None, rng.random()])) for _ in range(150)]
    obs += [("k", t * 100, rng.random()) for t in range(20, 40)] + [("k", 2_500, 0.5), ("k", 2_500, 0.25), (None, 5, 1.0), ("k", None, 1.0)]
    got = sorted((r.clip_id, r.i, r.t_ms, round(r.value, 9)) for r in tracks._resampled(
        spark.createDataFrame(obs, "track_id string, t_ms bigint, cx double"),
        spark.createDataFrame(clips, "track_id string, clip_id string, start_ms bigint, end_ms bigint"), "cx", 100, "track_id", 1_000, size).collect())
    want = []
    for k, c, a, b in clips:
        if k is None or c is None or a is None:
            continue
        times = {}
        for j, t, v in obs:
            if j == k and t is not None and a <= t <= b:
                times.setdefault(t, []).append(v)
        seen = [(t, None if None in vs else min(vs)) for t, vs in sorted(times.items())]
        for i in range(max(2, max(200, b - a) // 100 + 1)):
            t = a + i * 100
            p, q = [x for x in seen if x[0] <= t][-1:], [x for x in seen if x[0] >= t][:1]
            if p and q:
                value = None if None in (p[0][1], q[0][1]) else p[0][1] + (t - p[0][0]) / max(0.001, q[0][0] - p[0][0]) * (q[0][1] - p[0][1])
            else:
                value = (p or q or [(0, None)])[0][1]
            if value is not None:
                want.append((c, i, t, round(value, 9)))
    assert got == sorted(want) and len(got) > 100


def test_grid_points_are_not_shuffled(spark):
    obs = spark.createDataFrame([("k", 5, 0.5)], "track_id string, t_ms bigint, cx double")
    clips = spark.createDataFrame([("k", "c", 0, 1_000)], "track_id string, clip_id string, start_ms bigint, end_ms bigint")
    plan = tracks.resample_chunks(obs, clips)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(CASE") < plan.index("Exchange")


def test_a_key_of_one_chunk_is_not_composed(spark):
    class Sum:
        def run(self, xs, before, step=None):
            assert before is None
            return [sum(xs[: i + 1]) for i in range(len(xs))]

        def compose(self, xs, step=None):
            raise AssertionError("composed")

    rows = spark.createDataFrame([("a", 0, [1.0, 2.0]), ("b", 0, [3.0])], "k string, chunk bigint, xs array<double>")
    assert sorted((r.k, r.xs) for r in scans.scan(rows, "k", Sum()).collect()) == [("a", [1.0, 3.0]), ("b", [3.0])]
