"""Written barriers: cut lineage without losing work when executors go away."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[str] = []
_path_of: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of its own.
    """
    named = spark.conf.get(SETTING, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {SETTING} to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="momentloom-")
    spark.conf.set(SETTING, own)
    return own


def _place(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def own(spark: SparkSession, path: str) -> str:
    """Make a folder that this application owns: it goes with ``release``, or when the driver ends."""
    where, store = _place(spark, path)
    store.mkdirs(where)
    store.deleteOnExit(where)
    _written.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    where, store = _place(spark, path)
    store.delete(where, True)
    store.cancelDeleteOnExit(where)


def release(spark: SparkSession) -> None:
    """Delete all folders written so far. Tables that still read them must be finished."""
    while _written:
        _delete(spark, _written.pop())


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs here go when it ends, not when the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Readers get column pruning and filter pushdown, and never recompute the
    plan above the barrier. The folder is deleted when the run ends or is released.
    """
    spark = df.sparkSession
    path = own(spark, f"{shared_dir(spark)}/momentloom/{uuid.uuid4().hex}") + "/rows"
    with _shuffles_go(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _path_of[out] = _written[-1]
    return out


def drop(df: DataFrame) -> None:
    """Delete the folder of a table that ``stable`` returned; nothing may read it any more."""
    path = _path_of.pop(df)
    if path in _written:
        _written.remove(path)
        _delete(df.sparkSession, path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Yields ``keep``, a ``stable`` whose folders outlive the scope; all others written inside are deleted."""
    first, kept = len(_written), set()

    def keep(df: DataFrame) -> DataFrame:
        out = stable(df)
        kept.add(_written[-1])
        return out

    yield keep
    passed = [path for path in _written[first:] if path not in kept]
    _written[first:] = [path for path in _written[first:] if path in kept]
    for path in passed:
        _delete(spark, path)


def settled(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """``stable(build())``; the folders that ``build`` wrote on the way are deleted, so nothing else may read them."""
    with scope(spark) as keep:
        return keep(build())
