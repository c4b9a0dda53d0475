"""Plain text tables as transcripts.

Untimed text gets a steady reading clock, so that every timed operator also runs
on ordinary tables of documents or chat turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momentloom.functions import text as tx
from momentloom.functions.timefmt import div
from momentloom.operators.segment import SEGMENTS_PER_CHUNK
from momentloom.plans.ordered import bind, chunk_carry, sum_before
from momentloom.plans.stable import stable

MS_PER_WORD = 400
MIN_SEGMENT_MS = 200
PAUSE_MS = (300, 700, 1100, 1500)


def lines_as_segments(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """One segment per non-blank line; ``seg_idx`` is the line's original position."""
    return df.select(
        F.col(id_col).alias("transcript_id"),
        F.posexplode(F.split(text_col, "\n")).alias("seg_idx", "_line"),
    ).select(
        "transcript_id", F.col("seg_idx").cast("bigint").alias("seg_idx"),
        tx.strip("_line").alias("text"),
    ).where("text != ''")


def reading_clock(
    segments: DataFrame, key: str = "transcript_id", segments_per_chunk: int = SEGMENTS_PER_CHUNK
) -> DataFrame:
    """Give untimed segments start and end times.

    A segment lasts 400 ms per word (at least 200 ms) and is preceded by a pause that
    cycles over four lengths by ``seg_idx``; the first segment of a key starts at 0.
    The ``chunk`` column stays, so that later steps can reuse the partitioning.
    """
    pause = F.element_at(
        F.array(*[F.lit(p) for p in PAUSE_MS]), (F.col("seg_idx") % len(PAUSE_MS)).cast("int") + 1
    )
    # The summary and the rows both read this, so it is made once.
    timed = stable(segments.withColumns({
        "_dur": F.greatest(F.lit(MIN_SEGMENT_MS), tx.word_count("text") * MS_PER_WORD).cast("bigint"),
        "_pause": pause.cast("bigint"),
        "chunk": div(F.col("seg_idx"), segments_per_chunk),
    }))

    def along(s: DataFrame, w) -> DataFrame:
        return s.withColumn(
            "_t0", sum_before("_total", w) - F.first("_first_pause").over(w)
        )

    timed = chunk_carry(
        timed, [key], "chunk",
        {"_total": F.sum(F.col("_dur") + F.col("_pause")), "_first_pause": F.min_by("_pause", "seg_idx")},
        along, ["_t0"],
    )
    w = Window.partitionBy(key, "chunk").orderBy("seg_idx")
    end = F.col("_t0") + F.sum(F.col("_dur") + F.col("_pause")).over(w)
    return timed.withColumn("end_ms", end).select(
        *[c for c in segments.columns if c != "text"], "chunk",
        (F.col("end_ms") - F.col("_dur")).alias("start_ms"), "end_ms", "text",
    )


def even_words(df: DataFrame, spoken: float = 0.8) -> DataFrame:
    """Spread the words of each timed row evenly; each takes ``spoken`` of its slot."""
    parts = F.filter(F.split("text", r"(?U)\s+"), lambda t: t != "")
    start = F.col("start_ms").cast("double")

    def spread(tokens, step):
        def word(token, i):
            lo = start + step * i
            return F.struct(
                F.rint(lo).cast("bigint").alias("start_ms"),
                F.rint(lo + step * spoken).cast("bigint").alias("end_ms"),
                token.alias("text"), F.lit(1.0).alias("prob"),
            )

        return F.transform(tokens, word)

    def words(tokens):
        return bind((F.col("end_ms") - F.col("start_ms")) / F.size(tokens), lambda step: spread(tokens, step))

    return df.withColumn("words", bind(parts, words))
