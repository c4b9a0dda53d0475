"""Cheaper forms of the alignment, the cues and the scores give the rows of the plain ones."""

from __future__ import annotations

import inspect

import pyarrow as pa
from pyspark.sql import functions as F

from momentloom.functions import scoring
from momentloom.operators import cues, segment, select

WORDS = "array<struct<start_ms:bigint,end_ms:bigint,text:string>>"


def test_runs_are_found_on_numbers(monkeypatch):
    spoken = [[["a"], ["b", "c"], [], ["d"]], None, [["x"]], [["a"], ["b"]], [["q"], ["r"]]]
    goals = [[{"n": 3, "goal": ["a", "b", "c"]}, {"n": 1, "goal": ["d"]}], [{"n": 1, "goal": ["a"]}], None, [], [{"n": 2, "goal": ["z"]}, {"n": 0, "goal": []}]]
    plain = [None if s is None or g is None else segment.best_runs(s, [(x["n"], set(x["goal"])) for x in g]) for s, g in zip(spoken, goals)]
    seen = []

    def spy(line, parts, found=segment.best_runs):
        seen.extend(t for tokens in line for t in tokens)
        return found(line, parts)

    monkeypatch.setattr(segment, "best_runs", spy)
    columns = (pa.array(spoken, pa.list_(pa.list_(pa.string()))),
               pa.array(goals, pa.list_(pa.struct([("n", pa.int32()), ("goal", pa.list_(pa.string()))]))))
    run = getattr(segment._best_runs, "func", segment._best_runs)
    assert run(*columns).to_pylist() == plain
    assert run(*[c.slice(2, 2) for c in columns]).to_pylist() == plain[2:4]
    assert seen and all(isinstance(t, int) for t in seen)


def test_cues_gather_places_and_equal_a_plain_loop(spark):
    def plain(line, base, limit):
        out = []
        for s, e, t in line:
            if t is None or not t.strip():
                continue
            s, e = s - base, e - base
            if not out or len(out[-1]) >= limit or s - out[-1][-1][1] > 700 or e - out[-1][0][0] > 2800 or out[-1][-1][2][-1] in ".!?":
                out.append([])
            out[-1].append((s, e, t))
        return out

    texts = ["oak", "elm.", "ash", " ", "fir!", "yew?\n", None, "bay", "box", "may."]
    clips = [(f"c{k}", 100 * k, [(i * (300 + 90 * (k % 5)) + 37 * (i % 3 == k % 3) * k, i * (300 + 90 * (k % 5)) + 250 + 40 * k, texts[(i * (k + 1)) % 10])
                                 for i in range(k * 3)]) for k in range(12)]
    df = spark.createDataFrame(clips, f"clip_id string, start_ms bigint, words {WORDS}")
    for limit in (1, 3, 7):
        got = {r.clip_id: [[(w.start_ms, w.end_ms, w.text) for w in c.words] for c in r.p]
               for r in df.select("clip_id", cues.pack_words(F.col("words"), F.col("start_ms"), limit).alias("p")).collect()}
        assert got == {i: plain(line, base, limit) for i, base, line in clips}
    assert "array<array" not in inspect.getsource(cues.pack_words)


def test_openers_and_first_phrases(spark):
    texts = ["", " ", None, ". a", "a. ", "a.b. c", "THIS ", " so x", "İt ", "these", "thesex", "because of", "those.", "\n\nThat is. x", "İİİİİİİİİİİİİit "]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    lead = F.split(F.btrim("text", F.lit(" \n")), r"\. ", 2)[0]
    assert df.where(~lead.eqNullSafe(scoring.first_phrase(F.col("text")))).count() == 0
    same = scoring.self_contained_score(F.col("text"), F.lit(3), F.lit(False), F.lit(False))
    assert [r[0] for r in df.select(same).collect()] == [70, 70, 70, 70, 80, 70, 56, 58, 70, 56, 70, 58, 80, 44, 70]


def test_rows_are_compared_by_their_intersection(spark):
    assert "jaccard" not in inspect.getsource(select._clash)
    row = lambda toks: F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"), F.array(*[F.lit(t) for t in toks]).cast("array<bigint>").alias("toks"))
    got = spark.range(1).select(*[select._clash(row(a), row(b), 0.45, 0.6).alias(str(i)) for i, (a, b) in enumerate([
        ([1, 2, 3], [1, 2, 3]), ([1, 2, 3, 4], [1, 2, 3, 5]), ([1, 2, 3, 4, 5], [1, 2, 3, 4, 6]), ([], []), ([1], [])])]).first()
    assert list(got) == [True, False, True, False, False]
