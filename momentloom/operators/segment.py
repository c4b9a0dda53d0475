"""From segments to timed, indexed sentences grouped into pause blocks."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from momentloom.functions import text as tx
from momentloom.functions.timefmt import div
from momentloom.plans.ordered import bind, chunk_carry, sum_before
from momentloom.plans.stable import stable

BLOCK_GAP_MS = 1200
MIN_SENTENCE_MS = 200
MIN_ALIGNMENT = 0.55
EDGE_MARKS = ".,!?;:"
RUNS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("span", T.IntegerType())]))
SEGMENTS_PER_CHUNK = 256
SPAN_CHARS = 1 << 16
ROWS_PER_CHUNK = 4096
LENGTHS = (0, -1, 1, -2, 2)  # of a run beside its sentence, in order of preference
SHORT_SENTENCE = 256


def explode_sentences(
    df: DataFrame, col: str = "text", key: Sequence[str] = (), offsets: bool = False
) -> DataFrame:
    """One row per sentence: ``pos`` and ``sentence``, in text order.

    With ``offsets`` (needs ``key``, unique per text) also ``start_char`` and
    ``end_char`` within the stripped text.
    """
    if not offsets:
        return df.select(
            *[c for c in df.columns if c != col],
            F.posexplode_outer(tx.sentences(col)).alias("pos", "sentence"),
        ).where("pos is not null")
    whole = tx.strip(col)
    pieces = F.arrays_zip(
        F.split(whole, tx.SENTENCE_BREAK).alias("sentence"),
        F.regexp_extract_all(whole, F.lit(tx.SENTENCE_BREAK), F.lit(0)).alias("space"),
    )
    rows = df.select(
        *[c for c in df.columns if c != col], F.posexplode_outer(pieces).alias("pos", "_p")
    ).select("*", "_p.sentence", (F.length("_p.sentence")
             + F.coalesce(F.length("_p.space"), F.lit(0))).alias("_step"))
    rows = rows.where("sentence != ''").withColumn("_chunk", div(F.col("pos"), ROWS_PER_CHUNK))
    rows = chunk_carry(
        rows, key, "_chunk", {"_len": F.sum("_step")},
        lambda s, w: s.withColumn("_base", sum_before("_len", w)), ["_base"],
    )
    w = Window.partitionBy(*key, "_chunk").orderBy("pos")
    start = F.col("_base") + F.sum("_step").over(w) - F.col("_step")
    return rows.withColumn("start_char", start).withColumn(
        "end_char", F.col("start_char") + F.length("sentence")
    ).drop("_p", "_step", "_chunk", "_base")


def spread_sentences(df: DataFrame, col: str = "text", key: Sequence[str] = (), span: int = SPAN_CHARS) -> DataFrame:
    """``explode_sentences`` with offsets for texts of any length: same rows, but a text is cut into
    spans of ``span`` characters that go to different tasks.

    A span brings along the few characters before it that a break looks back on, so each break is
    found in one span only. Sentences inside a span are whole; only those at its borders are
    grouped and joined again. ``key`` is unique per text; a null in it is a value like others. Null
    and blank texts give no rows. A sentence is one row, however long.
    """
    if span < tx.SENTENCE_REACH:
        raise ValueError(f"span must be at least {tx.SENTENCE_REACH}")
    others = [c for c in df.columns if c != col]
    cut = bind(F.regexp_extract_all(tx.strip(col), F.lit(f"(?s).{{1,{span}}}"), F.lit(0)), lambda spans: F.transform(
        spans, lambda own, i: F.struct(
            F.coalesce(F.right(F.get(spans, i - 1), F.lit(tx.SENTENCE_REACH)), F.lit("")).alias("before"), own.alias("own"))))
    spans = df.select(*others, F.struct(*key).alias("_key"), F.posexplode_outer(cut).alias("_span", "_p"))
    # A stated number: by size alone, texts that pack well would meet in one task.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = spans.where("_span is not null").repartition(tasks, "_key", "_span")
    pieces = F.split(F.concat("_p.before", "_p.own"), tx.SENTENCE_END + r"(?=\s)")
    rows = spans.select(*others, "_key", "_span", F.length("_p.before").alias("_lead"),
                        F.posexplode_outer(pieces).alias("_nth", "_piece"))
    along = Window.partitionBy("_key", "_span").orderBy("_nth")
    rows = rows.withColumn("_at", F.sum(F.length("_piece")).over(along) - F.length("_piece"))
    rows = rows.where(F.col("_at") + F.length("_piece") > F.col("_lead"))
    hidden = F.greatest(F.col("_lead") - F.col("_at"), F.lit(0))
    rows = stable(rows.select(
        *others, "_key", "_span", "_nth", (F.col("_at") >= F.col("_lead")).alias("_new"),
        F.lead("_nth").over(along).isNull().alias("_last"), F.substring("_piece", hidden.cast("int") + 1, F.length("_piece")).alias("_part"),
        (F.col("_span").cast("long") * span + F.col("_at") + hidden - F.col("_lead")).alias("start_char")))
    fresh = F.sum(F.col("_new").cast("long"))
    rows = chunk_carry(rows, ["_key"], "_span", {"_held": fresh},
                       lambda s, w: s.withColumn("_base", sum_before("_held", w)), ["_base"])
    rows = rows.withColumn("pos", F.col("_base") + fresh.over(along) - 1)
    whole = F.col("_new") & ~F.col("_last")
    parts = F.sort_array(F.collect_list(F.struct("start_char", "_part")))
    mended = rows.where(~whole).groupBy("_key", "pos").agg(
        *[F.first(c).alias(c) for c in others], F.array_join(F.transform(parts, lambda p: p["_part"]), "").alias("_part"),
        F.min("start_char").alias("start_char"))
    columns = [*others, "pos", "_part", "start_char"]
    sentence = F.regexp_replace("_part", r"(?U)^\s+", "").alias("sentence")
    out = rows.where(whole).select(*columns).unionByName(mended.select(*columns)).select("*", sentence)
    start = F.col("start_char") + F.length("_part") - F.length("sentence")
    return out.select(*others, F.col("pos").cast("int").alias("pos"), "sentence", start.cast("long").alias("start_char"),
                      (start + F.length("sentence")).cast("long").alias("end_char"))


def align_spans(words: Column, parts: Column) -> Column:
    """For each sentence in ``parts``: the run of ``words`` that matches it best.

    Runs of n, n-1, n+1, n-2 and n+2 words are compared by token-set Jaccard; the
    earliest start wins a tie, then that order of lengths. Below 0.55 the entry is
    null; null or empty ``words`` give null. A run that reaches 0.55 shares more than
    half of the sentence's tokens, so only starts near enough places of its rarer ones are
    visited. Work is linear in the words at most.
    """
    def cut(text: Column) -> Column:
        return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")

    def goal(sentence: Column) -> Column:
        return bind(cut(F.lower(sentence)), lambda raw: F.struct(
            F.size(raw).alias("n"),
            F.array_distinct(cut(F.array_join(F.transform(raw, lambda t: F.btrim(t, F.lit(EDGE_MARKS))), " "))).alias("goal")))

    spoken = F.transform(words, lambda w: cut(F.coalesce(F.btrim(F.lower(w["text"]), F.lit(EDGE_MARKS)), F.lit(""))))
    found = _best_runs(spoken, F.transform(parts, goal))
    return F.when(F.size(words) > 0, F.transform(
        found, lambda r: F.when(r["span"] > 0, F.slice(words, r["start"], r["span"]))))


@F.arrow_udf(RUNS)
def _best_runs(spoken: pa.Array, goals: pa.Array) -> pa.Array:
    # Tokens become small numbers while they are still columns: far cheaper to turn into Python objects than strings.
    said, asked = spoken.values, goals.values
    wanted, lengths = asked.field("goal"), asked.field("n").to_numpy(zero_copy_only=False)
    ids = pa.concat_arrays([said.values, wanted.values]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    word_at, goal_at = said.offsets.to_numpy(), wanted.offsets.to_numpy()
    here = spoken.is_valid().to_numpy(zero_copy_only=False) & goals.is_valid().to_numpy(zero_copy_only=False)
    words, parts = spoken.offsets.to_numpy(), goals.offsets.to_numpy()

    def lists(at: np.ndarray, first: int, end: int, base: int = 0) -> list[list[int]]:
        cuts = at[first : end + 1]
        flat = ids[base + cuts[0] : base + cuts[-1]].tolist()
        cuts = (cuts - cuts[0]).tolist()
        return [flat[i:j] for i, j in zip(cuts, cuts[1:])]

    starts, spans, sizes = [], [], []
    for i in range(len(spoken)):
        sizes.append(0)
        if here[i] and parts[i + 1] > parts[i]:
            sought = lists(goal_at, parts[i], parts[i + 1], len(said.values))
            line = [(n, set(g)) for n, g in zip(lengths[parts[i] : parts[i + 1]].tolist(), sought, strict=True)]
            found = best_runs(lists(word_at, words[i], words[i + 1]), line)
            starts += [r["start"] for r in found]
            spans += [r["span"] for r in found]
            sizes[-1] = len(found)
    runs = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(spans, pa.int32())], ["start", "span"])
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.ListArray.from_arrays(ends, runs, mask=pa.array(~here))


def best_runs(spoken: list[list[str]], goals: list[tuple[int, set[str]]]) -> list[dict[str, int]]:
    """1-based start and length of the best run for each goal (length in words, tokens); length 0 for none."""
    places: dict[str, list[int]] = defaultdict(list)
    for i, tokens in enumerate(spoken):
        for token in dict.fromkeys(tokens):
            places[token].append(i)
    out = []
    for n, goal in goals:
        best = (0.0, 0, 0, 0)
        if n and goal:
            starts = _starts(places, goal, n + 2, len(spoken))
            if n <= SHORT_SENTENCE:
                best = _grow(spoken, goal, n, starts)
            else:
                best = max(_slide(spoken, goal, n + d, starts, rank) for rank, d in enumerate(LENGTHS))
        hit = best[0] >= MIN_ALIGNMENT
        out.append({"start": 1 - best[1] if hit else 0, "span": best[3] if hit else 0})
    return out


def _starts(places: dict[str, list[int]], goal: set[str], longest: int, n_words: int) -> list[tuple[int, int]]:
    """Ranges of the starts from which ``longest`` words can hold enough of the goal, in order.

    Of the goal's rarest tokens a good run holds all but those it may miss. As many tokens are asked
    for as are cheap: the few that one hit is needed of, and more while their places stay few.
    """
    spare = len(goal) - math.ceil(MIN_ALIGNMENT * len(goal) - 1e-9)
    by_use = sorted((places.get(t, ()) for t in goal), key=len)
    hits = [i for held in by_use[: spare + 1] for i in held]
    needed, room = 1, 4 * len(hits) + 64
    for held in by_use[spare + 1 :]:
        if len(held) > room:
            break
        hits += held
        needed, room = needed + 1, room - len(held)
    hits.sort()
    out: list[tuple[int, int]] = []
    for first, last in zip(hits, hits[needed - 1 :]):
        if last - first < longest:
            lo, hi = max(0, last - longest + 1), min(first, n_words - 1)
            if out and lo <= out[-1][1] + 1:
                out[-1] = (out[-1][0], hi)
            else:
                out.append((lo, hi))
    return out


def _grow(spoken: list[list[str]], goal: set[str], n: int, starts: list[tuple[int, int]]) -> tuple[float, int, int, int]:
    """The best run of about ``n`` words: score, -start, -rank, span. From each start the five lengths are one set that grows."""
    best, size = (0.0, 0, 0, 0), len(goal)
    ranks = {n + d: rank for rank, d in enumerate(LENGTHS) if n + d > 0}
    least = min(ranks)
    for lo, hi in starts:
        for start in range(lo, min(hi, len(spoken) - least) + 1):
            run = set().union(*spoken[start : start + least])
            shared = len(run & goal)
            for span in range(least, min(n + 2, len(spoken) - start) + 1):
                if span > least:
                    for token in spoken[start + span - 1]:
                        if token not in run:
                            run.add(token)
                            shared += token in goal
                score = shared / (len(run) + size - shared)
                if score >= best[0] and run:
                    best = max(best, (score, -start, -ranks[span], span))
            if best[0] == 1.0:  # no later start can be better
                return best
    return best


def _slide(spoken: list[list[str]], goal: set[str], span: int, starts: list[tuple[int, int]], rank: int) -> tuple[float, int, int, int]:
    """The best run of ``span`` words: score, -start, -rank, span. Counts slide along, so a long run costs no more."""
    best = (0.0, 0, 0, 0)
    counts: Counter[str] = Counter()
    shared = lo = hi = 0  # counts hold the words lo..hi-1
    for first, to in starts:
        for start in range(first, min(to, len(spoken) - span) + 1):
            if start >= hi:
                counts.clear()
                shared, lo, hi = 0, start, start
            while hi < start + span:
                for token in spoken[hi]:
                    counts[token] += 1
                    shared += counts[token] == 1 and token in goal
                hi += 1
            while lo < start:
                for token in spoken[lo]:
                    counts[token] -= 1
                    if not counts[token]:
                        del counts[token]
                        shared -= token in goal
                lo += 1
            if counts:
                best = max(best, (shared / (len(counts) + len(goal) - shared), -start, -rank, span))
    return best


def build_timed_sentences(
    segments: DataFrame,
    key: str = "transcript_id",
    block_gap_ms: int = BLOCK_GAP_MS,
    segments_per_chunk: int = SEGMENTS_PER_CHUNK,
) -> DataFrame:
    """Split segments into sentences with times, a global index and pause blocks.

    A lone sentence takes the times of its segment. Otherwise a sentence takes the
    times of the words it aligns to, or a share of the segment by text length.
    ``segments`` needs (key, seg_idx, start_ms, end_ms, text), optionally words,
    avg_logprob and no_speech_prob. ``seg_idx`` orders the segments of a key and
    should be (nearly) dense, because chunks of it bound the work of a task. A ``chunk``
    column that is already there is used as it is.
    """
    has_words = "words" in segments.columns
    extra = [c for c in ("avg_logprob", "no_speech_prob") if c in segments.columns]
    if "chunk" not in segments.columns:
        segments = segments.withColumn("chunk", div(F.col("seg_idx"), segments_per_chunk))
    # One exchange by (key, chunk) serves every window below; words are aligned before it, as Python keeps no partitioning.
    if not has_words:
        segments = segments.repartition(key, "chunk")
    parts = segments.withColumn("_parts", tx.sentences("text"))
    if has_words:
        several = F.size("_parts") > 1
        parts = parts.withColumn("_runs", align_spans(F.when(several, F.col("words")), F.when(several, F.col("_parts"))))
    rows = parts.select(
        key, "chunk", "seg_idx", *extra,
        F.col("start_ms").cast("double").alias("_lo"),
        F.col("end_ms").cast("double").alias("_hi"),
        F.greatest(F.lit(1), F.length("text")).alias("_len"),
        F.size("_parts").alias("_n"),
        *(["words", "_runs"] if has_words else []),
        F.posexplode_outer("_parts").alias("pos", "text"),
    ).where("pos is not null")
    only = F.col("_n") == 1
    if has_words:
        rows = rows.withColumn("_run", F.get("_runs", F.col("pos"))).withColumns({
            "words": F.coalesce(F.when(only, F.col("words")), F.col("_run"), F.slice("words", 1, 0)),
            "_mapped": F.col("_run").isNotNull(),
            "_run_start": F.get("_run", F.lit(0))["start_ms"].cast("double"),
            "_run_end": F.get("_run", F.size("_run") - 1)["end_ms"].cast("double"),
        }).drop("_run", "_runs").repartition(key, "chunk")
    else:
        none = F.lit(None).cast("double")
        rows = rows.withColumns({"_mapped": F.lit(False), "_run_start": none, "_run_end": none})

    # Unaligned sentences share the segment by length, counted from the end of the
    # last aligned sentence before them.
    seg = [key, "chunk", "seg_idx"]
    mapped = F.col("_mapped")
    rows = rows.withColumn(
        "_grp", F.sum(mapped.cast("int")).over(Window.partitionBy(*seg).orderBy("pos"))
    )
    w = Window.partitionBy(*seg, "_grp").orderBy("pos")
    share = F.when(mapped, F.lit(0)).otherwise(F.length("text"))
    rows = rows.withColumns({
        "_cum": F.sum(share).over(w),
        "_from": F.coalesce(F.first("_run_end").over(w), F.col("_lo")),
        "_share": share,
    })

    def reach(chars: Column) -> Column:
        length = F.greatest(F.lit(0.0), F.col("_hi") - F.col("_lo"))
        return F.least(F.col("_hi"), F.col("_from") + length * chars / F.col("_len"))

    earlier = F.col("_cum") - F.col("_share")
    start = (
        F.when(mapped, F.col("_run_start"))
        .when(earlier == 0, F.col("_from")).otherwise(reach(earlier))
    )
    end = (
        F.when(mapped, F.col("_run_end"))
        .when(F.col("pos") == F.col("_n") - 1, F.col("_hi")).otherwise(reach(F.col("_cum")))
    )
    rows = rows.withColumns({
        "start_ms": F.rint(start).cast("bigint"),
        "end_ms": F.rint(F.greatest(end, start + MIN_SENTENCE_MS)).cast("bigint"),
    })
    out = index_and_blocks(rows, key, "chunk", ["seg_idx", "pos"], "start_ms", "end_ms", block_gap_ms)
    return out.select(
        key, "chunk", "seg_idx", "pos", "idx", "start_ms", "end_ms", "text",
        *(["words"] if has_words else []), *extra, "gap_before_ms", "block",
    )


def index_and_blocks(
    df: DataFrame, key: str, chunk: str, order: Sequence[str], start: str, end: str, gap: int
) -> DataFrame:
    """Add ``idx``, ``gap_before_ms`` and ``block`` along ``order`` within ``key``.

    ``chunk`` must be monotone in ``order``. A row whose pause to the previous row is
    at least ``gap`` opens a block.
    """
    w = Window.partitionBy(key, chunk).orderBy(*order)
    place = F.struct(*order)
    df = df.withColumns({"_i": F.row_number().over(w), "_prev": F.lag(end).over(w)})
    df = df.withColumn("_cut", F.coalesce((F.col(start) - F.col("_prev") >= gap).cast("int"), F.lit(0)))
    # The summary and the rows both read this, so it is made once.
    df = stable(df.withColumn("_cuts", F.sum("_cut").over(w)))

    def along(s: DataFrame, w) -> DataFrame:
        s = s.withColumn("_prev_end", F.lag("_last_end").over(w))
        first_cut = F.coalesce((F.col("_first_start") - F.col("_prev_end") >= gap).cast("int"), F.lit(0))
        s = s.withColumn("_first_cut", first_cut)
        return s.withColumn("_idx0", sum_before("_n", w)).withColumn(
            "_block0", F.sum(F.col("_first_cut")).over(w) + sum_before("_inner", w)
        )

    df = chunk_carry(
        df, [key], chunk,
        {
            "_n": F.count(F.lit(1)), "_inner": F.sum("_cut"),
            "_first_start": F.min_by(start, place), "_last_end": F.max_by(end, place),
        },
        along, ["_prev_end", "_idx0", "_block0"],
    )
    prev = F.coalesce(F.col("_prev"), F.col("_prev_end"))
    pause = F.greatest(F.lit(0), F.coalesce(F.col(start) - prev, F.lit(0)))
    return df.withColumns({
        "idx": F.col("_idx0") + F.col("_i") - 1,
        "gap_before_ms": pause.cast("bigint"),
        "block": F.col("_block0") + F.col("_cuts"),
    }).drop("_i", "_prev", "_cut", "_cuts", "_prev_end", "_idx0", "_block0")


def assign_pause_blocks(
    df: DataFrame, key: str, start: str, end: str, position: str,
    gap_ms: int = BLOCK_GAP_MS, rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Pause blocks over any table with a dense per-key ``position``.

    Use ``with_position`` first when the table has only a time order.
    """
    chunked = df.withColumn("_chunk", div(F.col(position), rows_per_chunk))
    return index_and_blocks(chunked, key, "_chunk", [position], start, end, gap_ms).drop("idx", "_chunk")
