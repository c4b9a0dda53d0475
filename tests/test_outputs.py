import json
import os
import random

from pyspark.sql import functions as F

from momentloom.operators import catalog, cues, evals, incremental, tracks, transcripts
from momentloom.sources import probe, sinks
from momentloom.sources import transcripts as docs_in
from momentloom.streaming.blocks import stream_blocks_in_order, stream_pause_blocks
from momentloom.streaming.jobs import expiring_job_state, latest_job_state
from momentloom.streaming.run import closed_rows, latest_rows

WORDS = "array<struct<start_ms:bigint,end_ms:bigint,text:string>>"


def test_cues(spark):
    said = [(0, 300, "one"), (320, 600, "two"), (620, 900, "three."), (950, 1200, "four"), (2000, 2300, "five"), (2310, 2500, " ")]
    df = spark.createDataFrame([("c", 0, said)], f"clip_id string, start_ms bigint, words {WORDS}")
    made = cues.cues_from_words(df, 3)
    got = [(r.start_ms, r.end_ms, [w.text for w in r.words]) for r in made.orderBy("cue_idx").collect()]
    assert got == [(0, 930, ["one", "two", "three."]), (950, 1550, ["four"]), (2000, 2650, ["five"])]
    events = cues.active_word_events(made, F.array(F.lit("Three!"))).orderBy("start_ms").collect()
    assert [e.text for e in events if e.is_emphasis] == ["three."] and len(events) == 5
    plain = spark.createDataFrame([("c", 0, 0, 4000, 0, "one two three four five six seven eight")],
                                  "clip_id string, seg_idx int, start_ms bigint, end_ms bigint, clip_start_ms bigint, text string")
    parts = cues.cues_from_segments(plain, 3).orderBy("part").collect()
    assert [len(p.words) for p in parts] == [3, 3, 2] and parts[-1].end_ms == 4000


def test_cue_source(spark):
    line = "struct<start_ms:bigint,end_ms:bigint,text:string,words:array<struct<start_ms:bigint,end_ms:bigint,text:string,prob:double>>>"
    said = [(1000, 1300, "warm", 1.0), (1320, 1600, "bread", 1.0)]
    rows = [("two", 1000, [(1000, 2000, "warm bread", said)]), ("one", 1000, [(1000, 2000, "warm", said[:1])]),
            ("none", 0, [(0, 900, "a b c", None), (900, 1800, "d", [])]), ("empty", 0, [])]
    df = spark.createDataFrame(rows, f"clip_id string, start_ms bigint, segments array<{line}>")
    got = cues.clip_cues(df, 2).collect()
    assert {r.clip_id: r.source for r in got} == {"two": "words", "one": "segments", "none": "segments"}
    assert sorted((r.cue_idx, len(r.words)) for r in got if r.clip_id == "none") == [(0, 2), (1, 1), (2, 1)]
    assert {r.source for r in cues.clip_cues(df, 2, timed=False).collect()} == {"segments"}


def test_srt(spark):
    segs = [(10_000, 12_500, "hello world"), (12_500, 12_600, "  "), (12_500, 15_000, "second line"), (3_610_000, 3_610_010, "late")]
    df = spark.createDataFrame([("c", 10_000, segs)], f"clip_id string, start_ms bigint, segments {WORDS}")
    srt = sinks.srt_documents(df).first().srt
    assert srt.startswith("1\n00:00:00,000 --> 00:00:02,500\nhello world\n\n2\n00:00:02,500 --> 00:00:05,000\n")
    assert srt.endswith("3\n01:00:00,000 --> 01:00:00,200\nlate\n")


def test_crop_plans(spark):
    clips = spark.createDataFrame([("v", "moving", 0, 10_000), ("v", "still", 20_000, 30_000), ("w", "none", 0, 5_000)],
                                  "track_id string, clip_id string, start_ms bigint, end_ms bigint")
    size = spark.createDataFrame([("v", 1920, 1080), ("w", 1920, 1080)], "track_id string, width int, height int")
    seen = [("v", t, t / 12_000, 0.5, 0.1, 0.1) for t in range(0, 10_001, 500)] + [("v", 25_000, 0.5, 0.5, 0.1, 0.1)]
    obs = spark.createDataFrame(seen, "track_id string, t_ms bigint, cx double, cy double, w double, h double")
    got = {r.clip_id: r for r in tracks.plan_crop(size, clips, obs).collect()}
    moving = got["moving"]
    xs = [k.x for k in moving["keys"]]
    assert not moving.static and moving["keys"][0].t_ms == 0 and moving["keys"][-1].t_ms == 10_000
    assert xs == sorted(xs) and max(b - a for a, b in zip(xs, xs[1:])) <= 25
    assert got["still"].static and got["still"]["keys"][0].x == 656 and got["still"]["mode"] == "smart_auto"
    assert got["none"].static and got["none"]["mode"] == "center" and got["none"]["keys"][0].x == 656
    fit = tracks.plan_crop(size, clips, obs, mode="fit").first()
    assert (fit.crop_w, fit.crop_h, fit.static, fit["mode"]) == (1920, 1080, True, "fit")


def test_smoothing(spark):
    r = spark.range(1).select(
        tracks.ema_two_pass(F.array(*map(F.lit, (0.0, 10.0, 10.0)))).alias("e"),
        tracks.slew_limit(F.array(*map(F.lit, (0.0, 10.0, -10.0))), F.lit(3.0)).alias("s")).first()
    f = [0.0, 1.6, 0.16 * 10 + 0.84 * 1.6]
    b1 = 0.6 * f[1] + 0.4 * f[2]
    assert [round(x, 9) for x in r.e] == [round(x, 9) for x in (0.4 * b1, b1, f[2])]
    assert r.s == [0.0, 3.0, 0.0]


def parse(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, raw string")
    return [r[0] and json.loads(r[0]) for r in evals.parse_eval_responses(df).orderBy("i").select(F.to_json("parsed")).collect()]


def test_tolerant_json(spark):
    got = parse(spark, [
        '{"k": [2]}', 'As asked:\n```\n{"rank": 3}\n```\nDone', '{“mood”: “calm”, "rank": 4,}',
        'note [1] then {"clips": [{"id": 2, "rank": 5}]} end', "no braces here", "{'k': 'v'}", None,
        '{"k": 1} {"k": 22}', "[7, 8,]", "see [3, [4, 5]] or {}"])
    assert got == [{"k": [2]}, {"rank": 3}, {"mood": "calm", "rank": 4}, {"clips": [{"id": 2, "rank": 5}]},
                   None, {"k": "v"}, None, {"k": 22}, [7, 8], [3, [4, 5]]]


def test_validation(spark):
    raw = json.dumps({"score": " -7 ", "hook": ' "Hand\nmill" ', "category": "How-To", "selfContained": "no",
                      "emphasis_words": [], "emphasisWords": ["dark", 3, " ", "flour"], "alt_hook": None, "altHook": "Mill", "opening_text": ["x"]})
    df = evals.parse_eval_responses(spark.createDataFrame([(raw,), ('{"score": true}',)], "raw string")).select("parsed")
    a, b = evals.validate_evals(df).collect()
    assert (a.score, a.hook, a.category, a.self_contained, a.emphasis_words, a.alt_hook, a.opening_text) == (
        0, "Hand mill", "how-to", False, ["dark", "flour"], "Mill", "")
    assert (b.score, b.hook, b.self_contained, b.emphasis_words) == (1, "", True, [])


def test_matching(spark):
    texts = [
        '{"results": [{"index": 1, "score": 60}, {"index": "0", "score": 90}, {"index": 9, "score": 1}]}',
        '[{"score": 10}, {"score": 20}]', '[{"score": 10}]', '{"clips": [{"id": 0, "score": 5}, {"id": 0, "score": 6}]}']
    df = evals.parse_eval_responses(spark.createDataFrame(list(enumerate(texts)), "b int, raw string")).withColumn("n_expected", F.lit(2))
    got = {(r.b, r.slot): r.score for r in evals.match_evals(df).collect()}
    assert got == {(0, 0): 90, (0, 1): 60, (1, 0): 10, (1, 1): 20, (3, 0): 6}


def test_scorer_failure_keeps_the_rest(spark):
    df = spark.createDataFrame([("a", 0, "good"), ("a", 1, "bad")], "transcript_id string, batch bigint, listing string")

    def scorer(text):
        if text == "bad":
            raise RuntimeError("down")
        return "[]"

    got = {r.listing: (r.raw, r.error) for r in evals.evaluate_with(df, scorer).collect()}
    assert got == {"good": ("[]", None), "bad": (None, "RuntimeError: down")}


def test_hook_answers(spark):
    clips = spark.createDataFrame([(i, "old", "alt", "open") for i in range(4)], "id int, hook string, alt_hook string, opening_text string")
    raw = [(0, 1, '{"hook": "first"}'), (0, 2, '{"hook": "new", "altHook": "b"}'), (1, 1, '{"hook": 7, "alt_hook": "x"}'), (2, 1, "nonsense")]
    read = evals.validate_hooks(evals.parse_eval_responses(spark.createDataFrame(raw, "id int, at int, raw string")).drop("raw"))
    got = {r.id: (r.hook, r.alt_hook, r.opening_text) for r in evals.merge_hooks(clips, read, ["id"], "at").collect()}
    assert got == {0: ("new", "b", "open"), **{i: ("old", "alt", "open") for i in (1, 2, 3)}}


def test_probe(spark):
    stream = {"codec_type": "video", "codec_name": "h264", "width": 1920, "height": 1080, "avg_frame_rate": "30000/1001"}
    docs = {
        "ok": {"format": {"duration": "60.5", "size": "7", "format_name": "mov,mp4"}, "streams": [stream, {"codec_type": "audio", "channels": 2}]},
        "turned": {"format": {}, "streams": [{**stream, "duration": "3", "avg_frame_rate": "0/0", "tags": {"rotate": "90"}}]},
        "mute": {"format": {"duration": "1"}, "streams": [{"codec_type": "audio"}]},
        "empty": {"format": {"duration": "x/y"}, "streams": [stream]},
    }
    rows = [(k, json.dumps(v)) for k, v in docs.items()] + [("bad", "{not json")]
    good, bad = probe.parse_media_probe(spark.createDataFrame(rows, "path string, json string"))
    g = {r.path: r for r in good.collect()}
    assert (g["ok"].duration_ms, g["ok"].fps, g["ok"].has_audio, g["ok"].container) == (60_500, 29.97, True, "mov")
    assert (g["turned"].width, g["turned"].height, g["turned"].fps) == (1080, 1920, 30.0)
    assert {r.path for r in bad.collect()} == {"mute", "empty", "bad"}
    for df in (good, bad):  # a document is parsed once
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_transcript_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"segments": [{"start": 0.0, "end": 1.5, "text": "Hi"}, {"start": 2, "end": 2.25}]}, indent=1))
    heads, segs = docs_in.read_transcripts(spark, str(tmp_path))
    h = heads.first()
    assert (h.transcript_id, h.language, h.duration_ms, h.n_segments) == ("a", "en", 2250, 2)
    assert [(s.end_ms, s.text, s.words, s.avg_logprob) for s in segs.orderBy("seg_idx").collect()] == [(1500, "Hi", [], 0.0), (2250, "", [], 0.0)]
    texts = segs.select("transcript_id", "seg_idx", "text")
    assert transcripts.transcript_text(texts).first().text == "Hi"


def test_token_files(spark, tmp_path):
    toks = [{"text": "[_BEG_]", "offsets": {"from": 0, "to": 0}}, {"text": " Hi", "offsets": {"from": 10, "to": 400}, "p": 0.5}, {"text": " "}]
    (tmp_path / "b.json").write_text(json.dumps({"transcription": [{"offsets": {"from": 0, "to": 900}, "text": " Hi", "tokens": toks}]}))
    heads, segs = docs_in.read_token_json(spark, str(tmp_path))
    assert heads.first().language == "en" and heads.first().has_word_timestamps
    s = segs.first()
    assert (s.end_ms, s.text, [tuple(w) for w in s.words]) == (900, "Hi", [(10, 400, "Hi", 0.5)])


def test_keyed_changes(spark, tmp_path):
    base = spark.createDataFrame([("a", 1, "x", "old"), ("a", 2, "y", "old"), ("b", 3, "z", "old")], "k string, id int, v string, status string")
    delta = spark.createDataFrame([("a", 9, "n", "new")], "k string, id int, v string, status string")
    assert sorted(r.id for r in incremental.replace_by_key(base, delta, ["k"]).collect()) == [3, 9]
    assert sorted(r.id for r in incremental.upsert_by_key(base, delta, ["id"]).collect()) == [1, 2, 3, 9]
    patch = spark.createDataFrame([(1, None, None), (2, "Y", "done")], "id int, v string, status string")
    got = {r.id: (r.v, r.status) for r in incremental.patch_by_key(base, patch, ["id"]).collect()}
    assert got == {1: ("x", None), 2: ("Y", "done"), 3: ("z", "old")}
    path = str(tmp_path / "keyed")
    sinks.write_keyed(base, path, "k", 4)
    sinks.replace_keys(spark, delta, path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [3, 9]
    many = spark.createDataFrame([(9, "first", 1), (9, "last", 3), (9, "mid", 2), (2, None, 1)], "id int, v string, at int")
    flat = base.select("id", "v")
    got = {r.id: r.v for r in incremental.upsert_by_key(flat, many, ["id"], "at").collect()}
    assert got == {1: "x", 2: None, 3: "z", 9: "last"}
    twice = spark.createDataFrame([(1, "p", 2), (1, "q", 1)], "id int, v string, at int")
    assert [r.v for r in incremental.patch_by_key(flat, twice, ["id"], order="at").orderBy("id").collect()] == ["p", "y", "z"]
    done = incremental.skip_unchanged(base, base, ["id"], ["v"], force=True).where("id < 3")
    assert [r.id for r in incremental.skip_unchanged(base, done, ["id"], ["v"]).collect()] == [3]
    left = incremental.cascade_delete(base.select("k").distinct(), "k", delta, {"rows": (base, "k")})
    assert [r.k for r in left[""].collect()] == ["b"] and left["rows"].count() == 1


def test_catalog(spark):
    rows = spark.createDataFrame([(600_000, 100_000, 50_000), (600_000, 599_000, 100_000), (600_000, 600_000, 590_000)],
                                 "duration_ms bigint, decoded_ms bigint, transcript_ms bigint")
    assert [len(r.warnings) for r in catalog.coverage_warnings(rows).collect()] == [1, 1, 0]
    projects = spark.createDataFrame([("p", 1), ("q", 2)], "project_id string, created_at int")
    clips = spark.createDataFrame([("p", 2, "b"), ("p", 1, "a")], "project_id string, index int, hook string")
    none = spark.createDataFrame([], "project_id string, width int")
    listed = catalog.list_projects(projects, none, clips).orderBy("project_id").collect()
    assert [r.n_clips for r in listed] == [2, 0]
    detail = {r.project_id: r for r in catalog.project_detail(projects, none, none, clips).collect()}
    assert [c.hook for c in detail["p"].clips] == ["a", "b"] and detail["q"].clips == []


def stream_of(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def write_files(spark, path, batches, schema):
    """One file per micro-batch, in order of age."""
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_millis("t"))
        df.coalesce(1).write.parquet(f"{path}/b{n}")
        for f in os.listdir(f"{path}/b{n}"):
            os.utime(f"{path}/b{n}/{f}", (1_700_000_000 + n, 1_700_000_000 + n))
    return df.schema


def test_stream_blocks_close_and_leave_late_rows_out(spark, tmp_path):
    batches = [
        [("k", 0, 500), ("k", 1699, 100), ("k", 2999, 100)],  # the third begins exactly 1,200 ms after the second ends
        [("k", 60_000, 10)],                                    # moves the watermark to 50 s
        [("k", 60_100, 10)],                                    # and is late for the batches after this one
        [("k", 2000, 10), ("k", 60_500, 400), ("m", 100_000, 0)],   # the first one is late
    ]
    schema = write_files(spark, str(tmp_path), batches, "k string, t long, duration_ms long")
    stream = stream_of(spark, str(tmp_path), schema)
    got = closed_rows(stream_pause_blocks(stream, "k", "ts", "duration_ms")).collect()
    # The block of m is still open when the input ends.
    assert sorted((r.k, r.n_rows, r.first_start.timestamp()) for r in got) == [("k", 1, 2.999), ("k", 2, 0.0), ("k", 3, 60.0)]


def test_stream_state_is_updated_per_key(spark, tmp_path):
    batches = [[("a", 1, 1), ("b", 1, 2)], [("a", 5, 3)], [("a", 3, 4), ("c", 2, 5)]]
    schema = write_files(spark, str(tmp_path), batches, "k string, t long, id long")
    state = latest_job_state(stream_of(spark, str(tmp_path), schema), "k", "ts", ["id"], "id")
    assert {r.k: r.id for r in latest_rows(state, ["k"]).collect()} == {"a": 3, "b": 2, "c": 5}


def test_null_keys_are_replaced_and_not_added_again(spark):
    base = spark.createDataFrame([(None, 1), (None, 2), (1, 3), (2, 4)], "k int, v int")
    delta = spark.createDataFrame([(None, 9), (2, 8)], "k int, v int")
    rows = lambda df: sorted((r.k or 0, r.v) for r in df.collect())
    once = incremental.replace_by_key(base, delta, ["k"])
    assert rows(once) == [(0, 9), (1, 3), (2, 8)] == rows(incremental.replace_by_key(once, delta, ["k"]))
    assert rows(incremental.upsert_by_key(base, delta, ["k"])) == [(0, 9), (1, 3), (2, 8)]
    assert rows(incremental.patch_by_key(base, delta, ["k"])) == [(0, 9), (0, 9), (1, 3), (2, 8)]
    assert rows(incremental.replace_by_key(base, base.where("k = 2"), ["k"])) == rows(base)  # one lineage on both sides
    done = incremental.skip_unchanged(base, spark.createDataFrame([], "k int, fp string"), ["k"], ["v"])
    assert incremental.skip_unchanged(base, done, ["k"], ["v"]).count() == 0


def test_ordered_stream_blocks_equal_batch_on_shuffled_micro_batches(spark, tmp_path):
    rng = random.Random(3)
    rows, at = [], 0
    for i in range(120):
        at += rng.choice([0, 300, 900, 1500, 3000])
        rows.append(("k" if rng.random() < 0.7 else "m", at, rng.choice([0, 100, 1000, 5000]), i))
    shuffled = sorted(rows, key=lambda r: r[1] + rng.randrange(8000))  # never behind the watermark of ten seconds
    batches = [shuffled[i:i + 30] for i in range(0, 120, 30)]
    # Rows are late for the watermark of the batch before theirs.
    batches += [[("z", at + 100_000, 0, 995)], [("z", at + 150_000, 0, 998)], [("k", 5, 0, 997), ("k", at + 1, 1, 996)], [("z", at + 200_000, 0, 999)]]
    schema = write_files(spark, str(tmp_path), batches, "k string, t long, duration_ms long, id long")
    stream = stream_of(spark, str(tmp_path), schema)
    got = closed_rows(stream_blocks_in_order(stream, "k", "ts", "duration_ms", "id")).collect()
    want = []
    for key in ("k", "m"):
        ended = None
        for _, t, length, _ in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[3])):
            if ended is None or t - ended >= 1200:
                want.append([key, 0, t, t])
            want[-1][1] += 1
            want[-1][3], ended = t, t + length
    want += [["z", 1, at + 100_000, at + 100_000], ["z", 1, at + 150_000, at + 150_000]]
    assert sorted((r.k, r.n_rows, round(r.first_start.timestamp() * 1000), round(r.last_start.timestamp() * 1000)) for r in got) == sorted(map(tuple, want))


def test_finished_jobs_leave_the_state_also_after_a_restart(spark, tmp_path):
    source, kept = str(tmp_path / "in"), {}
    first = [[("a", 1_000, 1, "run"), ("b", 1_000, 2, "run"), ("c", 2_000, 3, None)], [("a", 5_000, 4, "done"), ("b", 500, 5, "done")]]
    then = [[("x", 90_000, 6, "run")], [("x", 91_000, 7, "run")], [("a", 92_000, 8, "again"), ("b", 92_000, 9, "done"), ("a", 6_000, 10, "late")]]
    more = "k string, t long, id long, state string"
    schema = write_files(spark, source, first, more)

    def run():
        rows = []
        state = expiring_job_state(stream_of(spark, source, schema), "k", "ts", ["state", "id"], "id", F.col("state") == "done", 20_000)
        query = state.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(
            lambda batch, epoch: rows.extend((epoch, *r) for r in batch.collect())).trigger(availableNow=True).start()
        query.awaitTermination()
        kept.update({r[1]: (r[3], r[4]) for r in sorted(rows, key=lambda r: r[0])})
        return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]

    assert run()[-1] == 3 and kept == {"a": ("done", 4), "b": ("run", 2), "c": (None, 3)}
    for n, rows in enumerate(then):
        write_files(spark, f"{source}/then{n}", [rows], more)
        for f in os.listdir(f"{source}/then{n}/b0"):
            os.utime(f"{source}/then{n}/b0/{f}", (1_800_000_000 + n, 1_800_000_000 + n))
    totals = run()
    assert min(totals) == 3  # b, c and x, once the watermark passed a's last event by 20 seconds
    assert kept == {"a": ("again", 8), "b": ("done", 9), "c": (None, 3), "x": ("run", 7)} and totals[-1] == 4
