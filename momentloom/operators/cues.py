"""Caption cues from timed words or from plain segments.

A clip row carries its own words, so packing runs inside the row and nothing is
shuffled. Times in cues are relative to the clip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momentloom.functions import text as tx
from momentloom.functions.timefmt import srt_time
from momentloom.plans.ordered import bind

PAUSE_MS, SPAN_MS, MIN_CUE_MS = 700, 2800, 200
WORD = "struct<start_ms:bigint,end_ms:bigint,text:string>"
CUE = f"struct<start_ms:bigint,end_ms:bigint,words:array<{WORD}>>"


def _plain(words: Column, clip_start: Column) -> Column:
    """Words re-based to the clip, blanks dropped."""
    kept = F.filter(words, lambda w: tx.strip(w["text"]) != "")
    return F.transform(kept, lambda w: F.struct(
        (w["start_ms"] - clip_start).cast("bigint").alias("start_ms"),
        (w["end_ms"] - clip_start).cast("bigint").alias("end_ms"), w["text"].alias("text"),
    ))


def pack_words(words: Column, clip_start: Column, max_words: int) -> Column:
    """Array of cues: a cue closes when full, at a pause over 0.7 s, when it would span
    over 2.8 s, or after a word that ends a sentence."""
    def step(s: Column, w: Column) -> Column:
        # Only the places where cues open are gathered, so a word copies no words.
        closed = (
            (s["n"] >= max_words) | (w["start_ms"] - s["end_ms"] > PAUSE_MS)
            | (w["end_ms"] - s["start_ms"] > SPAN_MS) | s["ends"]
        )
        opens = (s["i"] == 0) | closed
        ends = w["text"].endswith(".") | w["text"].endswith("!") | w["text"].endswith("?")
        return F.struct(
            (s["i"] + 1).alias("i"), F.when(opens, 1).otherwise(s["n"] + 1).alias("n"),
            F.when(opens, w["start_ms"]).otherwise(s["start_ms"]).alias("start_ms"), w["end_ms"].alias("end_ms"), ends.alias("ends"),
            F.when(opens, F.concat(s["places"], F.array(s["i"]))).otherwise(s["places"]).alias("places"),
        )

    none = F.lit(None).cast("bigint")
    begun = F.struct(
        F.lit(0).alias("i"), F.lit(0).alias("n"), none.alias("start_ms"), none.alias("end_ms"), F.lit(None).cast("boolean").alias("ends"),
        F.array().cast("array<int>").alias("places"))

    def cut(line: Column) -> Column:
        places = F.aggregate(line, begun, step, lambda s: s["places"])
        return bind(places, lambda at: F.transform(at, lambda first, i: F.slice(
            line, first + 1, F.coalesce(F.get(at, i + 1), F.size(line)) - first)))

    groups = bind(_plain(words, clip_start), cut)

    def cue(g: Column) -> Column:
        start = F.greatest(F.lit(0), g[0]["start_ms"])
        return F.struct(
            start.alias("start_ms"),
            F.greatest(start + MIN_CUE_MS, F.element_at(g, -1)["end_ms"]).alias("end_ms"),
            g.alias("words"),
        )

    return bind(groups, lambda g: F.transform(g, cue))


def stretch(cues: Column) -> Column:
    """Hold each cue up to 0.35 s longer, ending 0.02 s before the next one."""
    return bind(cues, _stretch)


def _stretch(cues: Column) -> Column:
    def longer(c: Column, i: Column) -> Column:
        follow = F.coalesce(F.get(cues, i + 1)["start_ms"], c["end_ms"] + 400)
        end = F.least(follow - 20, c["end_ms"] + 350)
        end = F.when(end <= c["start_ms"], c["start_ms"] + 250).otherwise(end)
        return F.struct(c["start_ms"].alias("start_ms"), end.alias("end_ms"), c["words"].alias("words"))

    return F.transform(cues, longer)


def _explode_cues(df: DataFrame, clip_id: str, cues: Column) -> DataFrame:
    return df.select(clip_id, F.posexplode_outer(cues).alias("cue_idx", "c")).where("cue_idx is not null").select(
        clip_id, "cue_idx", "c.start_ms", "c.end_ms", "c.words"
    )


def cues_from_words(
    df: DataFrame, max_words: int, clip_id: str = "clip_id", words: str = "words",
    clip_start: str = "start_ms",
) -> DataFrame:
    """Cues of clip rows that carry a ``words`` array, in time order."""
    packed = df.select(clip_id, pack_words(F.col(words), F.col(clip_start), max_words).alias("_cues"))
    return _explode_cues(packed, clip_id, stretch(F.col("_cues")))


def cues_from_segments(
    df: DataFrame, max_words: int, clip_id: str = "clip_id", clip_start: str = "clip_start_ms",
) -> DataFrame:
    """Cues of segment rows without word times: equal chunks and evenly spread words."""
    toks = F.filter(F.split(tx.strip("text"), r"(?U)\s+"), lambda t: t != "")
    start = F.greatest(F.lit(0), F.col("start_ms") - F.col(clip_start)).cast("double")
    end = F.greatest(start + 300, (F.col("end_ms") - F.col(clip_start)).cast("double"))
    rows = df.select(
        clip_id, "seg_idx", start.alias("_s"), end.alias("_e"), toks.alias("_t")
    ).where(F.size("_t") > 0)
    rows = rows.withColumn("_n", F.floor((F.size("_t") + max_words - 1) / max_words).cast("int"))
    rows = rows.withColumn("_dur", (F.col("_e") - F.col("_s")) / F.col("_n"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("part"))
    rows = rows.withColumns({
        "_cs": F.col("_s") + F.col("part") * F.col("_dur"),
        "_chunk": F.slice("_t", F.col("part") * max_words + 1, F.lit(max_words)),
    })
    rows = rows.withColumn("_ce", F.col("_cs") + F.col("_dur"))

    def words(chunk: Column) -> Column:
        def spread(each: Column) -> Column:
            def at(i: Column) -> Column:
                return F.rint(F.col("_cs") + i * each).cast("bigint")

            return F.transform(chunk, lambda t, i: F.struct(
                at(i).alias("start_ms"), at(i + 1).alias("end_ms"), t.alias("text")))

        return bind((F.col("_ce") - F.col("_cs")) / F.size(chunk), spread)

    return rows.select(
        clip_id, "seg_idx", "part", F.rint("_cs").cast("bigint").alias("start_ms"),
        F.rint("_ce").cast("bigint").alias("end_ms"), bind(F.col("_chunk"), words).alias("words"),
    )


def clip_cues(df: DataFrame, max_words: int, timed: bool = True, clip_id: str = "clip_id") -> DataFrame:
    """Cues of clip rows with ``segments``: from word times where ``timed`` is set and a clip has at
    least two timed words, else from its segments. ``source`` says which."""
    words = F.flatten(F.transform("segments", lambda s: F.coalesce(s["words"], F.slice(s["words"], 1, 0))))
    spoken = F.filter(words, lambda w: (tx.strip(w["text"]) != "") & w["start_ms"].isNotNull() & w["end_ms"].isNotNull())
    rows = df.select(clip_id, "start_ms", "segments", spoken.alias("words"))
    enough = F.lit(timed) & F.coalesce(F.size("words") >= 2, F.lit(False))
    by_word = cues_from_words(rows.where(enough), max_words, clip_id).withColumn("source", F.lit("words"))
    lines = rows.where(~enough).select(
        clip_id, F.col("start_ms").alias("clip_start_ms"), F.posexplode_outer("segments").alias("seg_idx", "s")).where("s is not null")
    lines = lines.select(clip_id, "clip_start_ms", "seg_idx", "s.start_ms", "s.end_ms", "s.text")
    plain = cues_from_segments(lines, max_words, clip_id)
    order = Window.partitionBy(clip_id).orderBy("seg_idx", "part")
    plain = plain.withColumn("cue_idx", F.row_number().over(order) - 1).withColumn("source", F.lit("segments"))
    return by_word.unionByName(plain.select(*by_word.columns))


def normalise_word(col: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(col, F.lit("")), r"(?U)[^\w']+", ""))


def active_word_events(cues: DataFrame, highlight: Column, clip_id: str = "clip_id") -> DataFrame:
    """One row per spoken word of a cue, with its on-screen time and emphasis.

    ``highlight`` is an array of words (a column of ``cues`` or a literal).
    """
    wanted = F.filter(F.transform(highlight, normalise_word), lambda w: w != "")
    rows = cues.withColumn("_wanted", wanted).select(
        clip_id, "cue_idx", F.col("start_ms").alias("_cs"), F.col("end_ms").alias("_ce"),
        F.size("words").alias("_n"), "_wanted", F.posexplode("words").alias("word_idx", "w"),
    )
    start = F.greatest(F.col("_cs"), F.col("w.start_ms"))
    own_end = F.when(F.col("word_idx") == F.col("_n") - 1, F.col("_ce")).otherwise(F.col("w.end_ms"))
    return rows.select(
        clip_id, "cue_idx", "word_idx", start.alias("start_ms"),
        F.least(F.col("_ce"), F.greatest(start + 80, own_end)).alias("end_ms"),
        F.col("w.text").alias("text"),
        F.array_contains("_wanted", normalise_word(F.col("w.text"))).alias("is_emphasis"),
    )


def srt_text(segments: Column, clip_start: Column) -> Column:
    """Subtitle file body of one clip; blank texts take no number."""
    spoken = F.filter(segments, lambda s: tx.strip(s["text"]) != "")

    def block(s: Column, i: Column) -> Column:
        start = F.greatest(F.lit(0), s["start_ms"] - clip_start)
        end = F.greatest(start + MIN_CUE_MS, s["end_ms"] - clip_start)
        return F.concat(
            (i + 1).cast("string"), F.lit("\n"), srt_time(start), F.lit(" --> "), srt_time(end),
            F.lit("\n"), tx.strip(s["text"]),
        )

    return F.concat(F.array_join(F.transform(spoken, block), "\n\n"), F.lit("\n"))
