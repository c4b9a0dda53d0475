"""Seed sentences: cheap lexical strength, then the strongest per transcript."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momentloom.functions import lexicon as lx
from momentloom.functions import text as tx
from momentloom.plans.stable import stable

MIN_WORDS = 4
MIN_STRENGTH = 1.6
MAX_SEEDS = 40


def add_facts(df: DataFrame, lex: lx.Lexicon = lx.DEFAULT) -> DataFrame:
    """Sentences with ``facts``: what the text patterns find in them."""
    return df.withColumn("facts", tx.text_facts("text", lex))


def with_facts(df: DataFrame, lex: lx.Lexicon = lx.DEFAULT) -> DataFrame:
    """Sentences with ``facts``, written once: later steps read them in place of the patterns."""
    return stable(add_facts(df, lex))


def annotate_sentences(df: DataFrame, lex: lx.Lexicon = lx.DEFAULT) -> DataFrame:
    """Text rules plus unrounded-free ``strength`` and ``reason`` for every sentence."""
    df = tx.annotate_text(df, "text", lex)
    hit = F.lit(0.0)
    for name in lx.FLAGS:
        hit = hit + F.when(F.col(name), F.lit(lex.weights[name])).otherwise(F.lit(0.0))
    opener = ~F.col("starts_awkwardly") & (F.col("word_count") >= 8) & ~F.col("looks_incomplete")
    strength = hit + F.when(opener, F.lit(0.5)).otherwise(F.lit(0.0))
    strength = strength * (F.lit(1.0) - F.lit(0.6) * F.col("filler_ratio"))
    if "avg_logprob" in df.columns:
        doubtful = (F.col("avg_logprob") != 0) & (F.col("avg_logprob") < -1.1)
        strength = strength * F.when(doubtful, F.lit(0.7)).otherwise(F.lit(1.0))
    names = F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in lx.FLAGS]))
    reason = F.coalesce(F.nullif(F.array_join(names, ", "), F.lit("")), F.lit("strong statement"))
    return df.withColumns({"strength": strength, "reason": reason})


def find_seeds(sentences: DataFrame, lex: lx.Lexicon = lx.DEFAULT) -> DataFrame:
    """Sentences strong enough to anchor a window; no shuffle."""
    known = sentences if "facts" in sentences.columns else with_facts(sentences, lex)
    df = annotate_sentences(known, lex).drop("facts")
    df = df.where((F.col("word_count") >= MIN_WORDS) & (F.col("strength") >= MIN_STRENGTH))
    return df.withColumn("strength", F.rint(F.col("strength") * 1000) / 1000)


def rank_seeds(seeds: DataFrame, key: str = "transcript_id", k: int = MAX_SEEDS) -> DataFrame:
    """The ``k`` strongest seeds per key; sentence order breaks ties.

    The rank filter lets Spark keep only ``k`` rows per key and task before the
    shuffle, so a hot key does not reach one task whole.
    """
    w = Window.partitionBy(key).orderBy(F.desc("strength"), F.asc("idx"))
    return seeds.withColumn("seed_rank", F.row_number().over(w)).where(F.col("seed_rank") <= k)
