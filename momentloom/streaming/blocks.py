"""Pause blocks on a live stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_pause_blocks(
    stream: DataFrame, key: str, start: str, duration_ms: str, gap_ms: int = 1200,
    late: str = "10 seconds",
) -> DataFrame:
    """Sessions per key: a pause of ``gap_ms`` or more after the running end closes one.

    Sessions merge when they touch, hence the gap of ``gap_ms`` - 1. A session ends at the
    latest end so far, while the batch operator compares with the previous row's end: the
    two agree where rows do not overlap (``stream_blocks_in_order`` agrees always). Rows behind
    the watermark are dropped.
    """
    hold = F.concat((F.col(duration_ms) + (gap_ms - 1)).cast("string"), F.lit(" milliseconds"))
    return (
        stream.withWatermark(start, late)
        .groupBy(key, F.session_window(start, hold).alias("session"))
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min(start).alias("first_start"),
             F.max(start).alias("last_start"))
        .select(key, "n_rows", "first_start", "last_start")
    )


def stream_blocks_in_order(
    stream: DataFrame, key: str, start: str, duration_ms: str, tie: str, gap_ms: int = 1200,
    late: str = "10 seconds",
) -> DataFrame:
    """The pause blocks of the batch operator on a live stream, for rows that overlap too.

    A row whose start lies ``gap_ms`` or more after the end of the row before it (by whole
    milliseconds, then the whole number ``tie``) opens a block. Rows wait until the watermark has passed
    their millisecond, so micro-batches may bring them in any order; rows behind the watermark
    are dropped. A block is appended, and its state removed, once no later row can join it.
    The state of a key is its rows within ``late`` of the newest, and one open block. A null
    duration counts as 0; rows without a start never become final and are left out.
    """
    rows = stream.where(F.col(start).isNotNull()).withWatermark(start, late).select(
        start, key, F.floor(F.unix_micros(start) / 1000).cast("long").alias("_start"),
        F.coalesce(F.col(duration_ms), F.lit(0)).cast("long").alias("_length"), F.col(tie).cast("long").alias("_tie"))
    out = T.StructType([stream.schema[key], *[T.StructField(n, T.LongType()) for n in ("n_rows", "first_ms", "last_ms")]])
    blocks = rows.groupBy(key).applyInPandasWithState(
        _fold_blocks(key, gap_ms), out, "waiting array<array<bigint>>, n bigint, first bigint, last bigint, ended bigint",
        "append", GroupStateTimeout.EventTimeTimeout)
    return blocks.select(
        key, "n_rows", F.timestamp_millis("first_ms").alias("first_start"), F.timestamp_millis("last_ms").alias("last_start"))


def _fold_blocks(key: str, gap_ms: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def fold(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, n, first, last, ended = state.get if state.exists else ([], 0, 0, 0, 0)
        waiting = [tuple(w) for w in waiting]
        for f in frames:
            ties = f["_tie"].fillna(-(1 << 62)).astype("int64")
            waiting += zip(f["_start"].tolist(), ties.tolist(), f["_length"].tolist(), strict=True)
        waiting.sort()
        mark = state.getCurrentWatermarkMs()
        closed = []
        final = 0
        while final < len(waiting) and waiting[final][0] < mark:
            at, _, length = waiting[final]
            if n and at - ended >= gap_ms:
                closed.append((name[0], n, first, last))
                n = 0
            n, first, last, ended = n + 1, first if n else at, at, at + length
            final += 1
        if n and mark - ended >= gap_ms:
            closed.append((name[0], n, first, last))
            n = 0
        waiting = waiting[final:]
        if n or waiting:
            state.update(([list(w) for w in waiting], n, first, last, ended))
            wake = min([w[0] for w in waiting[:1]] + [ended + gap_ms - 1] * (n > 0))
            state.setTimeoutTimestamp(max(wake, mark, 1))
        elif state.exists:
            state.remove()
        if closed:
            yield pd.DataFrame(closed, columns=[key, "n_rows", "first_ms", "last_ms"])

    return fold
