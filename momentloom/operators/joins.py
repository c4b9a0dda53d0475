"""Interval, covering and nearest joins on bucketed equi-keys.

Spark has no range-join strategy, so spans meet on (key, level, bucket). Buckets of one level are
twice as wide as those of the level below, and a span lives on the lowest level whose buckets are
at least as long as it is: there it touches one or two. To meet longer spans it also visits the
levels above that the other side lives on, again one or two buckets each. So a span of a year beside
millions of short ones costs a few copies, not one per short bucket. A pair is made on the level of
its longer span only, in the first bucket both touch, which needs no de-duplication. Hot buckets are
left to adaptive skew-join splitting: no side is ever grouped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momentloom.functions.timefmt import div
from momentloom.plans.ordered import before
from momentloom.plans.stable import stable


GROUP = 4096


def span_level(start: Column, end: Column, width: int) -> Column:
    """The lowest level whose buckets, ``width`` times a power of two, are as long as the span."""
    length = F.greatest(F.lit(0), end - start).cast("double")
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length, F.lit(1.0)) / width))).cast("int")
    return F.when(F.pow(F.lit(2.0), level) * width < length, level + 1).otherwise(level)


def levels_of(df: DataFrame, span: tuple[str, str], width: int) -> list[int]:
    """The levels that spans live on: at most about 60, whatever the table."""
    rows = df.select(span_level(F.col(span[0]), F.col(span[1]), width).alias("l")).distinct().collect()
    return sorted(r["l"] for r in rows if r["l"] is not None)


def in_buckets(df: DataFrame, start: Column, end: Column, width: int, levels: Sequence[int], first: str, own: bool, above: bool) -> DataFrame:
    """Copies of each row in the buckets it touches: on its own level, and on those of ``levels`` above it."""
    mine = span_level(start, end, width)
    df = df.withColumn("_mine", mine)
    on = F.filter(F.array(*[F.lit(n) for n in levels]), lambda n: n > F.col("_mine")) if above and levels else None
    if own:
        on = F.array("_mine") if on is None else F.concat(F.array("_mine"), on)
    if on is None:
        on = F.array().cast("array<int>")
    df = df.withColumn("_level", F.explode(on))
    size = F.pow(F.lit(2.0), F.col("_level")) * width
    lo = F.floor(start / size).cast("bigint")
    hi = F.floor(F.greatest(start, end) / size).cast("bigint")
    return df.withColumn(first, lo).withColumn("_bucket", F.explode(F.sequence(lo, hi)))


def overlap_join(
    left: DataFrame, right: DataFrame, key: str, width: int,
    l_span: tuple[str, str], r_span: tuple[str, str],
) -> DataFrame:
    """Rows of the same ``key`` whose spans touch; column names must not collide.

    ``width`` is the bucket of the lowest level and should be close to the usual length of a span.
    Spans with a null end meet nothing.
    """
    on_left, on_right = levels_of(left, l_span, width), levels_of(right, r_span, width)
    touch = (
        (F.col("_bucket") == F.greatest("_fa", "_fb"))
        & (F.col(l_span[0]) <= F.col(r_span[1])) & (F.col(r_span[0]) <= F.col(l_span[1]))
    )

    def side(df: DataFrame, span: tuple[str, str], levels: list[int], first: str, own: bool, above: bool) -> DataFrame:
        return in_buckets(df, F.col(span[0]), F.col(span[1]), width, levels, first, own, above).drop("_mine")

    columns = [key, *[c for c in left.columns if c != key], *[c for c in right.columns if c != key]]
    by = [key, "_level", "_bucket"]
    # Nothing is met on a level where no left span lives, so no copy goes there.
    visits = side(right, r_span, on_left, "_fb", True, True).where(F.col("_level").isin(on_left))
    longer_left = side(left, l_span, [], "_fa", True, False).join(visits, by)
    out = longer_left.where(touch).select(*columns)
    if on_left and on_right and on_right[-1] > on_left[0]:
        longer_right = side(left, l_span, on_right, "_fa", False, True).join(side(right, r_span, [], "_fb", True, False), by)
        out = out.unionByName(longer_right.where(touch).select(*columns))
    return out


def overlap_ratio(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Intersection over the shorter span (at least one microsecond)."""
    shared = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))
    shorter = F.greatest(F.lit(0.001), F.least(F.greatest(F.lit(0), e1 - s1), F.greatest(F.lit(0), e2 - s2)))
    return shared / shorter


def interval_overlap_pairs(
    df: DataFrame, key: str, id_col: str, start: str, end: str, width: int,
    min_ratio: float = 0.0, top: int | None = None,
) -> DataFrame:
    """Pairs (id_a < id_b) of one key that share time, with their overlap ratio.

    The output is as large as the number of overlapping pairs, unless ``min_ratio`` leaves weaker
    ones out or ``top`` keeps each row's strongest partners only (ties: smaller id). ``width``
    should be close to the usual length of a span. Rows with a null start, end or id are in no pair.
    """
    spans = df.select(key, F.col(id_col).alias("id"), F.col(start).alias("s"), F.col(end).alias("e"))
    levels = levels_of(spans, ("s", "e"), width)
    names = [key, "_level", "_bucket", "_mine", "_f", "id", "s", "e"]

    def side(tag: str, above: bool) -> DataFrame:
        rows = in_buckets(spans, F.col("s"), F.col("e"), width, levels if above else [], "_f", True, above)
        return rows.select(*[F.col(n) if n in names[:3] else F.col(n).alias(f"{n}_{tag}") for n in names])

    met = side("x", False).join(side("y", True), names[:3]).where(
        (F.col("_bucket") == F.greatest("_f_x", "_f_y")) & (F.col("s_x") < F.col("e_y")) & (F.col("s_y") < F.col("e_x"))
        & ((F.col("_mine_y") < F.col("_mine_x")) | (F.col("id_x") < F.col("id_y"))) & (F.col("id_x") != F.col("id_y"))
    )
    ratio = overlap_ratio(*[F.col(c) for c in ("s_x", "e_x", "s_y", "e_y")])
    pairs = met.select(key, F.least("id_x", "id_y").alias("id_a"), F.greatest("id_x", "id_y").alias("id_b"), ratio.alias("overlap"))
    if min_ratio > 0:
        pairs = pairs.where(F.col("overlap") >= min_ratio)
    if top is None:
        return pairs
    both = pairs.select("*", F.explode(F.array(
        F.struct(F.col("id_a").alias("me"), F.col("id_b").alias("other")), F.struct(F.col("id_b").alias("me"), F.col("id_a").alias("other")))).alias("p"))
    w = Window.partitionBy(key, "p.me").orderBy(F.desc("overlap"), "p.other")
    return both.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top).select(key, "id_a", "id_b", "overlap").distinct()


def around(
    points: DataFrame, values: DataFrame, key: str, t: str, at: str, carry: Column, width: int
) -> DataFrame:
    """Add ``prev`` and ``next``: the values at or before, and at or after, each point.

    Both tables meet on one timeline that is scanned per (key, time bucket) and carried
    over bucket borders, so no pair is formed. Equal times are merged first on both
    sides, so a bucket holds no more rows than it has distinct times. ``carry`` is a
    struct built from columns of ``values``; of several values at one time the smallest
    is taken.
    """
    facts = values.groupBy(key, F.col(at).alias("_t")).agg(F.min(carry).alias("v"))
    asked = points.select(key, F.col(t).alias("_t"), F.lit(True).alias("_ask")).distinct()
    line = asked.withColumn("_v", F.lit(None)).unionByName(facts.select(
        key, "_t", F.lit(False).alias("_ask"), F.struct(F.col("_t").alias("t"), "v").alias("_v")
    )).withColumn("_bucket", div(F.col("_t"), width))
    # The summary and the scan both read the line, so it is made once.
    line = stable(line)
    line = line.join(_beyond(line, key), [key, "_bucket"])
    w = Window.partitionBy(key, "_bucket")
    past = w.orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    future = w.orderBy(F.desc("_t")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    line = line.select(
        key, F.col("_t").alias(t), "_ask",
        F.coalesce(F.last("_v", ignorenulls=True).over(past), F.col("_before")).alias("prev"),
        F.coalesce(F.last("_v", ignorenulls=True).over(future), F.col("_after")).alias("next"),
    ).where("_ask").drop("_ask")
    return points.join(line, [key, t])


def _beyond(line: DataFrame, key: str) -> DataFrame:
    """The last value before and the first value after each (key, bucket) of a timeline.

    Carried in two levels: buckets inside a group of ``GROUP`` buckets, and groups along the
    key, so that one task sees at most ``GROUP`` buckets or one row per group. Frames only
    grow: looking ahead is looking back in the opposite order.
    """
    known = F.when(F.col("_v").isNotNull(), F.col("_t"))
    buckets = stable(line.groupBy(key, "_bucket").agg(
        F.max_by("_v", known).alias("_last"), F.min_by("_v", known).alias("_first")
    ).withColumn("_group", div(F.col("_bucket"), GROUP)))
    filled = F.when(F.col("_last").isNotNull(), F.col("_bucket"))
    groups = buckets.groupBy(key, "_group").agg(
        F.max_by("_last", filled).alias("_last"), F.min_by("_first", filled).alias("_first"))

    def sides(df: DataFrame, by: list[str], order: str, back: str, ahead: str) -> DataFrame:
        w = Window.partitionBy(*by)
        return df.withColumns({
            back: F.last("_last", ignorenulls=True).over(before(w.orderBy(order))),
            ahead: F.last("_first", ignorenulls=True).over(before(w.orderBy(F.desc(order)))),
        })

    groups = sides(groups, [key], "_group", "_gb", "_ga").select(key, "_group", "_gb", "_ga")
    inner = sides(buckets, [key, "_group"], "_bucket", "_ib", "_ia").join(groups, [key, "_group"])
    return inner.select(key, "_bucket", F.coalesce("_ib", "_gb").alias("_before"), F.coalesce("_ia", "_ga").alias("_after"))


def nearest(
    points: DataFrame, values: DataFrame, key: str, t: str, at: str, carry: Column, width: int,
    out: str = "nearest", within: int | None = None,
) -> DataFrame:
    """The closest value to each point; the earlier one wins a tie."""
    df = around(points, values, key, t, at, carry, width)
    back, ahead = F.col(t) - F.col("prev.t"), F.col("next.t") - F.col(t)
    take_prev = ahead.isNull() | (back <= ahead)
    pick = F.when(take_prev, F.col("prev")).otherwise(F.col("next"))
    if within is not None:
        pick = F.when(F.abs(F.col(t) - pick["t"]) <= within, pick)
    return df.withColumn(out, pick).drop("prev", "next")
