"""Transparent 0-100 scores as column expressions.

Sums are taken in a fixed order and rounded half to even, so that results do not
depend on the plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from momentloom.functions import lexicon as lx
from momentloom.functions import text as tx

PARTS = (
    "engagement", "hook", "clarity", "self_contained", "emotion", "novelty",
    "story", "actionability", "audio_quality", "overall",
)

# Score weights, in order of summation.
ENGAGEMENT = (("hook", 0.34), ("clarity", 0.22), ("novelty", 0.16), ("emotion", 0.14), ("self_contained", 0.14))
OVERALL = (
    ("engagement", 0.30), ("hook", 0.22), ("self_contained", 0.16), ("clarity", 0.12),
    ("novelty", 0.10), ("emotion", 0.05), ("audio_quality", 0.05),
)
# End of fixed values.
OPENER_REACH = max(map(len, lx.DANGLING_OPENERS + lx.BARE_PRONOUNS)) + 1


def score(col: Column) -> Column:
    """Round half to even and clamp to 0..100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.rint(col))).cast("int")


def _points(base: float, *rules: tuple[Column, float]) -> Column:
    """``base`` plus the points of every rule that holds."""
    return reduce(
        lambda total, rule: total + F.when(rule[0], F.lit(float(rule[1]))).otherwise(F.lit(0.0)),
        rules, F.lit(float(base)),
    )


def _phrases(col: Column, phrases: tuple[str, ...], each: float) -> list[tuple[Column, float]]:
    low = F.lower(col)
    return [(low.contains(p), each) for p in phrases]


def first_phrase(text: Column) -> Column:
    """Text up to the first full stop that a blank follows."""
    return F.substring_index(tx.strip(text), ". ", 1)


def hook_score(text: Column, lex: lx.Lexicon = lx.DEFAULT) -> Column:
    lead = first_phrase(text)
    flags = tx.feature_flags(lead, lex)
    awkward, words = tx.starts_awkwardly(lead), tx.word_count(lead)
    return score(_points(
        45, (~awkward, 15), (awkward, -20), (flags["question"], 12), (flags["strong_claim"], 20),
        (flags["number"], 8), (flags["emotion"], 10), (flags["contrast"], 8),
        (words.between(4, 22), 8), (words > 34, -12),
    ))


def clarity_score(words: Column, filler: Column, duration_ms: Column, incomplete: Column) -> Column:
    pace = words / F.greatest(F.lit(1.0), duration_ms / 1000.0)
    base = F.lit(78.0) - F.lit(45.0) * filler
    return score(
        base + F.when(pace < 1.4, F.lit(-18.0)).when(pace > 3.6, F.lit(-8.0)).otherwise(F.lit(0.0))
        + F.when(incomplete, F.lit(-15.0)).otherwise(F.lit(0.0))
    )


def self_contained_score(text: Column, words: Column, awkward: Column, incomplete: Column) -> Column:
    # Openers are looked for in the first characters only; lower-casing a character gives at least one.
    low = F.lower(F.left(tx.strip(text), F.lit(OPENER_REACH)))
    opener = reduce(lambda a, b: a | b, [low.startswith(p) for p in lx.DANGLING_OPENERS])
    pronoun = low.rlike(r"(?U)\A(?:" + "|".join(lx.BARE_PRONOUNS) + r")(?:\s|\z)")
    return score(_points(
        70, (awkward, -18), (opener, -12), (pronoun, -14), (incomplete, -16),
        (F.right(tx.strip(text), F.lit(1)).isin(".", "!", "?"), 10), (words.between(90, 240), 8),
    ))


def emotion_score(text: Column, emotion: Column, story: Column) -> Column:
    return score(_points(35, (emotion, 30), (story, 18), (text.contains("!"), 6)))


def novelty_score(text: Column, claim: Column, contrast: Column, number: Column) -> Column:
    return score(_points(
        40, (claim, 25), (contrast, 15), (number, 10), *_phrases(text, lx.NOVEL_PHRASES, 8)
    ))


def story_score(text: Column, story: Column) -> Column:
    return score(_points(30, (story, 35), *_phrases(text, lx.STORY_PHRASES, 10)))


def actionability_score(actionable: Column, number: Column) -> Column:
    return score(_points(30, (actionable, 40), (number, 8)))


def audio_quality_score(no_speech_prob: Column, avg_logprob: Column) -> Column:
    base = F.lit(85.0) - F.lit(120.0) * F.greatest(F.lit(0.0), no_speech_prob - 0.2)
    return score(
        base + F.when(avg_logprob != 0, F.lit(12.0) * (avg_logprob + 0.5)).otherwise(F.lit(0.0))
    )


def weighted(parts: tuple[tuple[str, float], ...], of: dict[str, Column]) -> Column:
    terms = [F.lit(weight) * of[name] for name, weight in parts]
    return score(reduce(lambda a, b: a + b, terms))
