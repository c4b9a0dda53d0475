"""Latest state per job from an event stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STAMP = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def latest_job_state(stream: DataFrame, job: str, ts: str, fields: list[str], tie: str) -> DataFrame:
    """The fields of the newest event of each job; ``tie`` orders events of one moment.

    The state keeps every job for good; ``expiring_job_state`` forgets finished ones.
    """
    newest = F.max_by(F.struct(ts, *fields), F.struct(ts, tie))
    return stream.groupBy(job).agg(newest.alias("_s")).select(job, F.col("_s")[ts].alias(ts), *[f"_s.{c}" for c in fields])


def expiring_job_state(
    stream: DataFrame, job: str, ts: str, fields: list[str], tie: str, done: Column, keep_ms: int,
    late: str = "10 seconds",
) -> DataFrame:
    """The same in update mode, where a job leaves the state ``keep_ms`` after its last event if that is ``done``.

    By then the watermark has passed that event, so whatever comes later for the job is newer
    (older rows are late and dropped) and starts it again: the newest row written per job stays right.
    ``tie`` is a whole number, null first. Rows without a time are left out.
    """
    rows = stream.where(F.col(ts).isNotNull()).withWatermark(ts, late)
    value = F.struct(*fields)
    kind = rows.select(value.alias("v")).schema["v"].dataType
    rows = rows.select(
        ts, job, F.unix_micros(ts).alias("_at"), F.coalesce(F.col(tie).cast("long"), F.lit(-(1 << 62))).alias("_tie"),
        F.coalesce(done, F.lit(False)).alias("_done"), F.to_json(value, STAMP).alias("_value"))
    out = T.StructType([stream.schema[job], T.StructField("_at", T.LongType()), T.StructField("_value", T.StringType())])

    def newest(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = tuple(state.get) if state.exists else None
        for f in frames:
            for row in zip(f["_at"].tolist(), f["_tie"].tolist(), f["_value"].tolist(), f["_done"].tolist(), strict=True):
                if best is None or row[:2] >= best[:2]:
                    best = row
        state.update(best)
        if best[3]:
            state.setTimeoutTimestamp(max(best[0] // 1000 + keep_ms, state.getCurrentWatermarkMs() + 1, 1))
        yield pd.DataFrame([(name[0], best[0], best[2])], columns=[job, "_at", "_value"])

    folded = rows.groupBy(job).applyInPandasWithState(
        newest, out, "at bigint, tie bigint, value string, done boolean", "update", GroupStateTimeout.EventTimeTimeout)
    read = F.from_json("_value", kind, STAMP)
    return folded.select(job, F.timestamp_micros("_at").alias(ts), read.alias("_v")).select(job, ts, *[F.col("_v")[c].alias(c) for c in fields])
