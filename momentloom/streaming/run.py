"""Drive a streaming aggregate over the files that are there now."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

from momentloom.operators.incremental import last_per_key
from momentloom.plans.stable import own, shared_dir


def _run(stream: DataFrame, mode: str) -> DataFrame:
    """Every micro-batch as rows of one table, each in its own folder, so that a batch that
    is run again replaces what it wrote and nothing passes through the driver."""
    spark = stream.sparkSession
    base = own(spark, f"{shared_dir(spark)}/momentloom/stream-{uuid.uuid4().hex}")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch:012d}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(keep)
        .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    spark.createDataFrame([], stream.schema).write.parquet(f"{base}/out/epoch=-1")
    return spark.read.schema(stream.schema.add("epoch", "long")).parquet(f"{base}/out")


def closed_rows(stream: DataFrame) -> DataFrame:
    """Append mode: the rows that the watermark has closed. Their state is dropped as they
    are written, and rows that come after the watermark are not counted."""
    return _run(stream, "append").drop("epoch")


def latest_rows(stream: DataFrame, key: Sequence[str]) -> DataFrame:
    """Update mode: a micro-batch writes only the keys it changed; the last version of
    each key counts."""
    return last_per_key(_run(stream, "update"), key, "epoch").drop("epoch")
