"""Scoring of candidate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentloom.functions import lexicon as lx
from momentloom.functions import scoring as sc
from momentloom.functions import text as tx


def score_candidates(df: DataFrame, lex: lx.Lexicon = lx.DEFAULT) -> DataFrame:
    """Add the ten ``score_*`` columns to candidates (text, start_ms, end_ms).

    Optional ``no_speech_prob`` and ``avg_logprob`` columns move the audio score;
    without them it is constant. Each level is one projection, so a regular
    expression runs once per text. ``facts`` (``text.joined_facts`` of the same lexicon)
    stand in for the patterns on whole texts, and go.
    """
    names = df.columns
    cols = [c for c in df.columns if c != "facts"]
    df = tx.annotate_text(df, "text", lex, prefix="_")
    text, words = F.col("text"), F.col("_word_count")
    duration = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))
    confidence = [
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in names else F.lit(0.0)
        for c in ("no_speech_prob", "avg_logprob")
    ]
    df = df.withColumns({
        "score_hook": sc.hook_score(text, lex),
        "score_clarity": sc.clarity_score(words, F.col("_filler_ratio"), duration, F.col("_looks_incomplete")),
        "score_self_contained": sc.self_contained_score(
            text, words, F.col("_starts_awkwardly"), F.col("_looks_incomplete")),
        "score_emotion": sc.emotion_score(text, F.col("_emotion"), F.col("_story")),
        "score_novelty": sc.novelty_score(text, F.col("_strong_claim"), F.col("_contrast"), F.col("_number")),
        "score_story": sc.story_score(text, F.col("_story")),
        "score_actionability": sc.actionability_score(F.col("_actionable"), F.col("_number")),
        "score_audio_quality": sc.audio_quality_score(*confidence),
    })
    part = {name: F.col("score_" + name) for name in sc.PARTS}
    df = df.withColumn("score_engagement", sc.weighted(sc.ENGAGEMENT, part))
    df = df.withColumn("score_overall", sc.weighted(sc.OVERALL, part))
    return df.select(*cols, *["score_" + name for name in sc.PARTS])


def blend_scores(df: DataFrame, evaluation: str = "eval_score", weight: float = 0.5) -> DataFrame:
    """Move overall and engagement towards an outside score; null leaves them alone."""
    w = max(0.0, min(1.0, weight))
    for name in ("score_overall", "score_engagement"):
        mixed = sc.score(F.lit(1 - w) * F.col(name) + F.lit(w) * F.col(evaluation))
        df = df.withColumn(name, F.when(F.col(evaluation).isNull(), F.col(name)).otherwise(mixed))
    return df


def length_adjust(df: DataFrame, overall: str = "score_overall") -> DataFrame:
    """Nudge very short and very long windows down and well-sized ones up."""
    ms = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))
    nudge = (
        F.when(ms < 14_000, -6).when(ms > 82_000, -5).when(ms.between(20_000, 62_000), 2).otherwise(0)
    )
    moved = F.greatest(F.lit(0), F.least(F.lit(100), F.col(overall) + nudge)).cast("int")
    return df.withColumn(overall, moved)
