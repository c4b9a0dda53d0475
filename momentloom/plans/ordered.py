"""Ordered computations that do not put one key into one task.

A window over ``partitionBy(key)`` sends all rows of a key to a single task. The
helpers here cut each key into *chunks* that follow the order, work inside
(key, chunk), and carry a small per-chunk summary across the borders. Only the
summary (one row per chunk) is ever ordered per key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from momentloom.plans.stable import stable

Keys = Sequence[str]


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Inside lambdas and filters the optimizer inlines expressions, which would compute a
    costly one again for every element or use. For the same reason costly arrays are
    exploded with the ``_outer`` functions: the others add a filter on the array's size.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before(w: WindowSpec) -> WindowSpec:
    """All earlier rows of the window, without the current one."""
    return w.rowsBetween(Window.unboundedPreceding, -1)


def after(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(1, Window.unboundedFollowing)


def sum_before(col: str, w: WindowSpec) -> Column:
    return F.coalesce(F.sum(col).over(before(w)), F.lit(0))


def chunk_carry(
    df: DataFrame,
    key: Keys,
    chunk: str,
    totals: dict[str, Column],
    carry: Callable[[DataFrame, WindowSpec], DataFrame],
    keep: Sequence[str],
) -> DataFrame:
    """Summarise each (key, chunk), let ``carry`` look along the chunks, join back.

    ``totals`` are aggregates with map-side combine. ``carry`` gets the summary and
    a window over it in chunk order; only the columns in ``keep`` come back.
    """
    by = [*key, chunk]
    summary = df.groupBy(*by).agg(*[c.alias(n) for n, c in totals.items()])
    summary = carry(summary, Window.partitionBy(*key).orderBy(chunk))
    return df.join(summary.select(*by, *keep), by)


def with_position(
    df: DataFrame, key: Keys, order: Sequence[str], out: str = "pos"
) -> DataFrame:
    """Dense 0-based position of each row within its key, safe for hot keys.

    The rows are range-partitioned by (key, order), so a key with a third of all
    rows spreads over a third of the partitions. ``order`` must be unique within a key.
    """
    ranged = df.repartitionByRange(*key, *order).withColumn("_range", F.spark_partition_id())
    pinned = stable(ranged)
    counted = chunk_carry(
        pinned, key, "_range", {"_n": F.count(F.lit(1))},
        lambda s, w: s.withColumn("_base", sum_before("_n", w)), ["_base"],
    )
    local = F.row_number().over(Window.partitionBy(*key, "_range").orderBy(*order))
    return counted.withColumn(out, F.col("_base") + local - 1).drop("_base", "_range")
