"""Keyed tables whose changes appear at once or not at all.

A table is a folder: ``data/<version>/key_bucket=<n>`` holds rows, and every file in
``commits`` names, for each bucket, the version that holds it. A change writes the
buckets it touches beside the old ones and then renames one small file into ``commits``.
Readers follow the newest commit, so a writer that dies at any point leaves the table as
it was; what it wrote is never read and goes with ``remove_unread``. Two writers that start from the same
commit race for one name: the second gets ``Conflict`` and may try again. The store must
rename files atomically. What the driver holds is bounded by the number of buckets.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from momentloom.operators.incremental import replace_by_key
from momentloom.plans.stable import _place, stable
from momentloom.sources.sinks import BUCKET


class Conflict(RuntimeError):
    """Another writer has changed the table since this one read it."""


def create(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """A new table of ``df`` in hash buckets of ``key``; over an existing one, its next version."""
    spark = df.sparkSession
    seen, _ = _newest(spark, path)
    version = _write(df, path, key, buckets)
    found = {b: version for b in _buckets(spark, f"{path}/data/{version}")}
    _publish(spark, path, seen + 1, {"key": key, "buckets": buckets, "schema": df.schema.jsonValue(), "folders": found})


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest commit. Later changes do not disturb a reader."""
    _, table = _opened(spark, path)
    return _rows(spark, path, table, table["folders"])


def change(
    spark: SparkSession, delta: DataFrame, path: str,
    apply: Callable[[DataFrame, DataFrame, list[str]], DataFrame] = replace_by_key,
) -> None:
    """Rewrite the buckets of the keys in ``delta`` as ``apply(rows, delta, [key])``.

    ``apply`` is any keyed change: ``replace_by_key``, ``upsert_by_key``, ``patch_by_key``,
    ``without_keys``. It sees all rows of the buckets it is given, and must not move a row to another key.
    """
    seen, table = _opened(spark, path)
    key, folders = table["key"], table["folders"]
    delta = stable(delta)
    bucket = _bucket(key, table["buckets"])
    touched = {str(r[0]) for r in delta.select(bucket).distinct().collect()}
    if not touched:
        return
    rows = _rows(spark, path, table, touched & folders.keys())
    version = _write(apply(rows, delta, [key]).select(*rows.columns), path, key, table["buckets"])
    written = {b: version for b in _buckets(spark, f"{path}/data/{version}")}
    if not written.keys() <= touched:
        raise ValueError("the change moved rows to keys that are not in delta")
    kept = {b: v for b, v in folders.items() if b not in touched}
    _publish(spark, path, seen + 1, {**table, "folders": {**kept, **written}})


def remove_unread(spark: SparkSession, path: str, older_than_ms: int, now_ms: int) -> list[str]:
    """Delete versions that the newest commit does not name and that were begun before ``now_ms`` -
    ``older_than_ms``; choose that time longer than any reader or writer lives."""
    _, table = _opened(spark, path)
    where, store = _place(spark, f"{path}/data")
    gone = [s.getPath() for s in store.listStatus(where)
            if s.getPath().getName() not in table["folders"].values() and s.getModificationTime() < now_ms - older_than_ms]
    for old in gone:
        store.delete(old, True)
    return [old.getName() for old in gone]


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias(BUCKET)


def _write(df: DataFrame, path: str, key: str, buckets: int) -> str:
    version = uuid.uuid4().hex
    df.select("*", _bucket(key, buckets)).write.partitionBy(BUCKET).parquet(f"{path}/data/{version}")
    return version


def _buckets(spark: SparkSession, folder: str) -> list[str]:
    where, store = _place(spark, folder)
    names = [s.getPath().getName() for s in store.listStatus(where) if s.isDirectory()]
    return [n.removeprefix(f"{BUCKET}=") for n in names if n.startswith(f"{BUCKET}=")]


def _rows(spark: SparkSession, path: str, table: dict, buckets: Iterable[str]) -> DataFrame:
    schema = StructType.fromJson(table["schema"])
    folders = [f"{path}/data/{table['folders'][b]}/{BUCKET}={b}" for b in sorted(buckets)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _newest(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """Number and name of the newest commit; 0 if there is none."""
    where, store = _place(spark, f"{path}/commits")
    names = [s.getPath().getName() for s in store.listStatus(where)] if store.exists(where) else []
    last = max((n for n in names if n.isdigit()), default=None)
    return int(last or 0), last


def _opened(spark: SparkSession, path: str) -> tuple[int, dict]:
    number, name = _newest(spark, path)
    if name is None:
        raise FileNotFoundError(f"no table at {path}")
    return number, json.loads(spark.read.text(f"{path}/commits/{name}", wholetext=True).first()[0])


def _publish(spark: SparkSession, path: str, number: int, table: dict) -> None:
    """Write the commit under a name that readers ignore, then rename it; a taken number is a conflict."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs
    draft, store = _place(spark, f"{path}/commits/_draft-{uuid.uuid4().hex}")
    out = store.create(draft, False)
    out.write(bytearray(json.dumps(table).encode()))
    out.close()
    final = fs.Path(f"{path}/commits/{number:012d}")
    files = fs.FileContext.getFileContext(store.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(final):
        store.delete(draft, False)
        raise Conflict(f"commit {number} of {path} is taken")
    try:
        files.rename(draft, final, spark.sparkContext._gateway.new_array(fs.Options.Rename, 0))
    except Exception as error:
        if store.exists(final):
            raise Conflict(f"commit {number} of {path} is taken") from error
        raise
