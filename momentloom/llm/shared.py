"""Helpers of the operators: the shared folder, table reading, clash-free columns."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from momentloom.plans.stable import own, shared_dir, stable

__all__ = ["fingerprint", "folder", "free_name", "is_held_out", "sample_ids", "shared_dir", "ship", "stable", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, kind: str) -> str:
    """A new folder name in the shared folder; it goes when the run ends or is released."""
    return own(spark, f"{shared_dir(spark)}/momentloom/{kind}-{uuid.uuid4().hex}") + "/rows"


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def is_held_out(doc_id: str = "doc_id") -> Column:
    """The fold that no model learns from; a null id is never in it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample_ids(rows: DataFrame, by: str, n: int, max_values: int) -> DataFrame:
    """``(by, doc_id)``: of each value of ``by``, the ``n`` ids with the smallest MD5.

    A bound on the MD5 that leaves about ``1.5 n`` rows of each value comes first and is tested
    where the rows are read, so what is shuffled and ranked does not grow with the input.
    ``by`` has at most ``max_values`` values.
    """
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    place = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(16**12)
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).limit(max_values + 1).collect()
    if len(counts) > max_values:
        raise ValueError(f"{by} has more than {max_values} values")
    if not counts:
        return rows.select(by, "doc_id").limit(0)
    limits = F.create_map(*[F.lit(x) for value, held in counts for x in (value, (1.5 * n + 100.0) / held)])
    near = rows.select(by, "doc_id").where(place <= F.element_at(limits, F.col(by)))
    order = Window.partitionBy(by).orderBy(digest, "doc_id")
    return near.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n).select(by, "doc_id")


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """Row count and an order-free sum over all rows; equal tables have equal fingerprints."""
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)"))).first()
    return row[0], int(row[1] or 0)


def ship(df: DataFrame) -> DataFrame:
    """``df``, after Spark has sent this package to the Python workers (once per application)."""
    context = df.sparkSession.sparkContext
    if getattr(context, "_momentloom_shipped", False):
        return df
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="momentloom-code-")) / "momentloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._momentloom_shipped = True
    return df
