"""From timed segments to ranked clips, as one chain of DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentloom.functions import lexicon as lx
from momentloom.functions import text as tx
from momentloom.operators import boundaries, evals, hooks, scores, seeds, select, windows
from momentloom.operators.segment import BLOCK_GAP_MS, build_timed_sentences
from momentloom.operators.transcripts import topic_hint
from momentloom.plans.ordered import with_position
from momentloom.plans.stable import settled, stable

ORDER = ("seed_rank", "target_ord")


@dataclass(frozen=True)
class Analysis:
    sentences: DataFrame
    candidates: DataFrame
    unique: DataFrame
    clips: DataFrame
    stats: DataFrame


def find_candidates(
    sentences: DataFrame, lex: lx.Lexicon = lx.DEFAULT, key: str = "transcript_id",
    targets_ms: Sequence[int] = lx.TARGETS_MS, min_ms: int = windows.MIN_CLIP_MS,
    max_ms: int = windows.MAX_CLIP_MS, block_gap_ms: int = BLOCK_GAP_MS,
) -> DataFrame:
    """Candidate windows with text, seed reason and seed flags, and ``facts`` for ``score_candidates``.

    Transcripts without any get even chunks instead. ``facts`` of the sentences (``seeds.add_facts``
    with the same lexicon) are used as they are.
    """
    if "facts" not in sentences.columns:
        sentences = seeds.with_facts(sentences, lex)
    top = stable(seeds.rank_seeds(seeds.find_seeds(sentences, lex), key))
    grown = windows.expand_windows(sentences, top, key, targets_ms, min_ms, max_ms, block_gap_ms)
    found = stable(windows.distinct_windows(grown, key))
    added_up = sentences if tx.separable(lex) else sentences.drop("facts")
    texts = windows.attach_text(windows.seed_details(found, top, key), added_up, key)
    cols = [key, "lo", "hi", "start_ms", "end_ms", "seed_rank", "target_ord", "text", "seed_reason", *lx.FLAGS]
    if "facts" in texts.columns:
        cols.append("facts")
    texts = texts.withColumn("seed_rank", F.col("seed_rank").cast("bigint")).select(*cols)
    even = stable(windows.fallback_windows(sentences, found, key, min_ms=min_ms))
    even = windows.attach_long_text(even, sentences, key).withColumns({
        "seed_rank": F.col("lo") + 1, "target_ord": F.lit(0), "seed_reason": F.lit("even split"),
        **{n: F.lit(False) for n in lx.FLAGS},
    })
    return texts.unionByName(even.select(*[c for c in cols if c != "facts"]), allowMissingColumns=True)


def score_and_adjust(
    candidates: DataFrame, lex: lx.Lexicon = lx.DEFAULT, evaluations: DataFrame | None = None,
    on: Sequence[str] = ("transcript_id", "lo", "hi"), weight: float = 0.5,
) -> DataFrame:
    """Rule scores, then outside evaluations where there are any, then the length nudge."""
    df = scores.score_candidates(candidates, lex)
    if evaluations is not None:
        df = scores.blend_scores(evals.merge_evals(df, evaluations, list(on)), "eval_score", weight)
    return scores.length_adjust(df)


def evaluate_candidates(
    candidates: DataFrame, segments: DataFrame, scorer: Callable[[str], str], key: str = "transcript_id",
    partitions: int | None = None,
) -> DataFrame:
    """Ask ``scorer`` about every candidate, in batches, and read its answers back.

    The result has (key, lo, hi) and the evaluation fields of the candidates that got a
    valid answer. Each batch is asked once; a batch that fails leaves its candidates out.
    """
    placed = settled(candidates.sparkSession, lambda: with_position(
        candidates.select(key, "lo", "hi", "start_ms", "end_ms", "text", *ORDER), [key], ORDER, "position"))
    batches = evals.build_eval_batches(placed, "position", key, hints=topic_hint(segments, key))
    answered = evals.evaluate_with(batches, scorer, "prompt", key, partitions)
    answered = stable(answered.select(key, "batch", "n_expected", "raw"))
    matched = evals.match_evals(evals.parse_eval_responses(answered))
    at = F.col("batch") * evals.BATCH_SIZE + F.col("slot")
    matched = matched.withColumn("position", at.cast("bigint")).select(key, "position", *evals.EVAL_FIELDS)
    return placed.select(key, "position", "lo", "hi").join(matched, [key, "position"]).drop("position")


def analyze(
    segments: DataFrame, durations: DataFrame | None = None, n_clips: int = 5,
    lex: lx.Lexicon = lx.DEFAULT, evaluations: DataFrame | None = None,
    targets_ms: Sequence[int] = lx.TARGETS_MS, min_ms: int = windows.MIN_CLIP_MS,
    max_ms: int = windows.MAX_CLIP_MS, pad_ms: int = boundaries.PAD_MS, key: str = "transcript_id",
    scorer: Callable[[str], str] | None = None,
) -> Analysis:
    """Find the ``n_clips`` strongest clips of every transcript.

    ``durations`` has (key, duration_ms); without it a source ends with its last
    sentence. ``evaluations`` has (key, lo, hi) and the evaluation fields; without it,
    ``scorer`` is asked if there is one. Each stage
    that several later ones read is written once to the shared folder.
    """
    spark = segments.sparkSession
    sentences = settled(spark, lambda: seeds.add_facts(build_timed_sentences(segments, key), lex))

    def scored() -> DataFrame:
        found = find_candidates(sentences, lex, key, targets_ms, min_ms, max_ms)
        given = evaluations
        if given is None and scorer is not None:
            # Read by the scorer and by the scores, and found once for both.
            asked = found = stable(found)
            given = settled(spark, lambda: evaluate_candidates(asked, segments, scorer, key))
        return score_and_adjust(found, lex, given, (key, "lo", "hi"))

    candidates = settled(spark, scored)
    # Texts do not travel along the choice: clips get theirs from their sentences.
    slim = settled(spark, lambda: select.relaxed_dedup_any(candidates, n_clips, key, order=ORDER).drop("text"))
    chosen = select.select_top_n(slim, n_clips, key, order=("start_ms", *ORDER))
    chosen = chosen.withColumn("clip_id", F.concat_ws("-", key, "lo", "hi"))
    chosen = stable(select.rank_clips(chosen, key, order=("start_ms", *ORDER)))
    if durations is None:
        durations = sentences.groupBy(key).agg(F.max("end_ms").alias("duration_ms"))
    clips = settled(spark, lambda: boundaries.refine_boundaries(chosen, sentences, durations, key, min_ms=min_ms, pad_ms=pad_ms))
    unique = candidates.join(slim.select(key, "lo", "hi"), [key, "lo", "hi"], "left_semi").select(*candidates.columns)
    return Analysis(sentences.drop("facts"), candidates, unique, finish_clips(clips), select.analysis_stats(candidates, slim, key))


def finish_clips(clips: DataFrame) -> DataFrame:
    """Hooks, reason, names and defaults of refined clips."""
    have = set(clips.columns)
    for name, default in (("category", F.lit("insight")), ("reason", F.lit("")), ("self_contained", F.lit(True)),
                          ("emphasis_words", F.array().cast("array<string>")), ("llm_used", F.lit(False))):
        if name not in have:
            clips = clips.withColumn(name, default)
    seeded = F.concat(F.lit("Seeded by: "), F.col("seed_reason"))
    clips = clips.withColumn("reason", F.coalesce(F.nullif(F.col("reason"), F.lit("")), seeded))
    return hooks.name_clips(hooks.fallback_hook(clips))
