"""Keyed changes to tables, written as DataFrame-to-DataFrame joins.

A null key is a key like any other: null meets null. The joins stay equi-joins on
the key, so a change shuffles each side once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Keys = Sequence[str]


def _same(a: DataFrame, b: DataFrame, key: Keys):
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b["_k_" + k]) for k in key])


def _keys(df: DataFrame, key: Keys) -> DataFrame:
    """The key columns under names that no table has, so that joins keep the other side's columns apart."""
    return df.select(*[F.col(k).alias("_k_" + k) for k in key])


def without_keys(base: DataFrame, gone: DataFrame, key: Keys) -> DataFrame:
    """The rows of ``base`` whose key is not in ``gone``."""
    gone = _keys(gone, key)
    return base.join(gone, _same(base, gone, key), "left_anti")


def replace_by_key(base: DataFrame, delta: DataFrame, key: Keys) -> DataFrame:
    """All rows of the keys present in ``delta`` are replaced by its rows."""
    return without_keys(base, delta.select(*key).distinct(), key).unionByName(delta.select(*base.columns))


def last_per_key(df: DataFrame, key: Keys, order: str | None = None) -> DataFrame:
    """One row per key: the last one by ``order``; without it the greatest of all columns.

    Null orders come first. The winner is one aggregate with map-side combine.
    """
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.distinct()
    place = F.struct(*([F.col(order).alias("_order")] if order else []), *rest)
    top = df.groupBy(*key).agg(F.max(place).alias("_top"))
    return top.select(*key, *[F.col("_top")[c].alias(c) for c in rest]).select(*df.columns)


def upsert_by_key(base: DataFrame, delta: DataFrame, key: Keys, order: str | None = None) -> DataFrame:
    """Insert rows with a new key; overwrite whole rows on a known one.

    Of several rows of a key in ``delta``, the last by ``order`` counts.
    """
    delta = last_per_key(delta, key, order)
    return without_keys(base, delta, key).unionByName(delta.select(*base.columns))


def patch_by_key(
    base: DataFrame, delta: DataFrame, key: Keys, always: Sequence[str] = ("status",), order: str | None = None,
) -> DataFrame:
    """Overwrite columns with the non-null values of ``delta``; ``always`` also with null.

    Rows of ``base`` without a match stay; rows only in ``delta`` are ignored. Of several
    rows of a key in ``delta``, the last by ``order`` counts.
    """
    delta = last_per_key(delta, key, order)
    changed = [c for c in delta.columns if c not in key and c in base.columns]
    d = delta.select(
        *[F.col(k).alias("_k_" + k) for k in key], *[F.col(c).alias("_d_" + c) for c in changed], F.lit(True).alias("_hit"))
    joined = base.join(d, _same(base, d, key), "left")
    hit = F.col("_hit").isNotNull()

    def new(c: str):
        if c not in changed:
            return F.col(c)
        if c in always:
            return F.when(hit, F.col("_d_" + c)).otherwise(F.col(c)).alias(c)
        return F.coalesce(F.col("_d_" + c), F.col(c)).alias(c)

    return joined.select(*[new(c) for c in base.columns])


def cascade_delete(
    parents: DataFrame, parent_key: str, gone: DataFrame, children: dict[str, tuple[DataFrame, str]]
) -> dict[str, DataFrame]:
    """Remove the keys in ``gone`` from the parents and from every child table.

    ``children`` maps a name to (table, its foreign key column).
    """
    def without(df: DataFrame, fk: str) -> DataFrame:
        return df.join(gone.select(F.col(parent_key).alias(fk)), fk, "left_anti").select(*df.columns)

    return {"": without(parents, parent_key), **{n: without(df, fk) for n, (df, fk) in children.items()}}


def fingerprint(cols: Sequence[str]):
    """16 hex digits over the named columns as canonical JSON."""
    return F.substring(F.sha1(F.to_json(F.struct(*sorted(cols)))), 1, 16)


def skip_unchanged(
    df: DataFrame, done: DataFrame, key: Keys, cols: Sequence[str], force: bool = False
) -> DataFrame:
    """Rows whose fingerprint over ``cols`` is not in ``done`` (key, fp); adds ``fp``."""
    marked = df.withColumn("fp", fingerprint(cols))
    return marked if force else without_keys(marked, done, [*key, "fp"])


def apply_clip_edits(clips: DataFrame, edits: DataFrame, clip_id: str = "clip_id") -> DataFrame:
    """Apply editor overrides: of each field, the latest value that is given.

    Starts are cut at 0, hooks at 120 characters, openings at 80 and emphasis at 8
    words; the duration always follows the new times.
    """
    fields = ("start_ms", "end_ms", "hook", "opening_text", "emphasis_words")

    def latest(c: str):
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("edit_ts"))).alias("_e_" + c)

    last = edits.groupBy(clip_id).agg(*[latest(c) for c in fields])
    df = clips.join(last, clip_id, "left").withColumns({
        "start_ms": F.when(F.col("_e_start_ms").isNull(), F.col("start_ms"))
        .otherwise(F.greatest(F.lit(0), F.col("_e_start_ms"))).cast("bigint"),
        "end_ms": F.coalesce("_e_end_ms", "end_ms"),
        "hook": F.coalesce(F.substring("_e_hook", 1, 120), F.col("hook")),
        "opening_text": F.coalesce(F.substring("_e_opening_text", 1, 80), F.col("opening_text")),
        "emphasis_words": F.coalesce(F.slice("_e_emphasis_words", 1, 8), F.col("emphasis_words")),
    })
    return df.withColumn("duration_ms", F.col("end_ms") - F.col("start_ms")).drop(*["_e_" + c for c in fields])
