"""Integer-millisecond time arithmetic and formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(col: Column, by: int) -> Column:
    """Floor division that keeps whole numbers (also below zero)."""
    return F.floor(col / F.lit(by)).cast("bigint")


def to_ms(seconds: Column) -> Column:
    return F.rint(seconds.cast("double") * 1000).cast("bigint")


def to_seconds(ms: Column) -> Column:
    return ms.cast("double") / 1000


def srt_time(ms: Column) -> Column:
    """``HH:MM:SS,mmm`` for a non-negative millisecond column."""
    t = F.greatest(ms, F.lit(0)).cast("bigint")
    return F.format_string(
        "%02d:%02d:%02d,%03d",
        div(t, 3_600_000), div(t, 60_000) % 60, div(t, 1000) % 60, t % 1000,
    )
