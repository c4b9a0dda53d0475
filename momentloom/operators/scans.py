"""Recurrences along a key of any length, as scans over chunks.

A recurrence ``y = f(x, y before)`` seems to need all rows of a key in one place. But the rows of a
chunk together are one map from the value before the chunk to its last value, and such maps compose:

* a mean ``y = a x + b y'`` gives an affine map, so two numbers per chunk;
* a limited step gives a monotone map of slopes 0 and 1, so the corners of its flat parts.

Chunks are composed side by side, the maps are applied along the key (one row per chunk), and the
chunks are run side by side from the values before them. Work is linear in the rows. Within a chunk
values are computed in order, so a key of one chunk gives the very numbers of a plain loop; with
more chunks the values before them are exact to rounding.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from momentloom.functions.timefmt import div
from momentloom.plans.stable import stable

CHUNK = 4096
ROWS_AT_ONCE = 16  # chunks that are Python objects at one time
Series = Sequence[float]


class Mean:
    """``y = a x + (1 - a) y'``; the first value is its own mean."""

    def __init__(self, a: float):
        self.a, self.b = a, 1 - a

    def run(self, xs: Series, before: float | None, step: float | None = None) -> list[float]:
        a, b, out = self.a, self.b, []
        for x in xs:
            before = x if before is None else a * x + b * before
            out.append(before)
        return out

    def compose(self, xs: Series, step: float | None = None) -> list[float]:
        return [self.b ** len(xs), self.run(xs, 0.0)[-1]]

    @staticmethod
    def apply(corners: Series, before: float) -> float:
        return corners[0] * before + corners[1]


class Lag(Mean):
    """``y = 0.6 x + 0.4 y'`` with both weights given."""

    def __init__(self, a: float, b: float):
        self.a, self.b = a, b


class Limit:
    """Each value follows its input, but by at most ``step`` from the value before."""

    @staticmethod
    def run(xs: Series, before: float | None, step: float) -> list[float]:
        out = []
        for x in xs:
            before = x if before is None else before + max(-step, min(step, x - before))
            out.append(before)
        return out

    @staticmethod
    def compose(xs: Series, step: float) -> list[float]:
        """Corners ``p1 .. pn, y1 .. yn`` of the map from the value before to the last value.

        Between corners the slope is 0 or 1, outside them 1. One more input cuts the map at the levels
        ``x - step`` and ``x + step``: what lies between becomes flat at ``x``, the rest moves by ``step``.
        """
        ps, ys = [xs[0] - step, xs[0] + step], [xs[0], xs[0]]
        for x in xs[1:]:
            low, high = x - step, x + step
            left, right = bisect_left(ys, low), bisect_right(ys, high)
            at_low, at_high = _input(ps, ys, low, left), _input(ps, ys, high, right)
            ps = ps[:left] + [at_low, at_high] + ps[right:]
            ys = [y + step for y in ys[:left]] + [x, x] + [y - step for y in ys[right:]]
        return ps + ys

    @staticmethod
    def apply(corners: Series, before: float) -> float:
        n = len(corners) // 2
        ps, ys = corners[:n], corners[n:]
        at = bisect_right(ps, before)
        if at == 0:
            return ys[0] - (ps[0] - before)
        if at == n:
            return ys[-1] + (before - ps[-1])
        return min(ys[at], ys[at - 1] + (before - ps[at - 1]))


def _input(ps: list[float], ys: list[float], level: float, at: int) -> float:
    """Where a map with slopes 0 and 1 reaches ``level``; ``at`` corners lie below it."""
    if at == 0:
        return ps[0] - (ys[0] - level)
    if at == len(ys):
        return ps[-1] + (level - ys[-1])
    return min(ps[at], ps[at - 1] + (level - ys[at - 1]))


def chunked(rows: DataFrame, key: str, order: str, value: str, size: int = CHUNK) -> DataFrame:
    """``(key, chunk, xs)``: the values of each run of ``size`` places. ``order`` counts from 0.

    A ``chunk`` column that is already there is used as it is, so that its partitioning serves.
    """
    if "chunk" not in rows.columns:
        rows = rows.withColumn("chunk", div(F.col(order), size))
    line = F.sort_array(F.collect_list(F.struct(F.col(order).alias("i"), F.col(value).cast("double").alias("x"))))
    return rows.groupBy(key, "chunk").agg(F.transform(line, lambda p: p["x"]).alias("xs"))


def unchunked(chunks: DataFrame, order: str, value: str, size: int = CHUNK) -> DataFrame:
    rows = chunks.select(*[c for c in chunks.columns if c != "xs"], F.posexplode_outer("xs").alias("_p", value))
    return rows.withColumn(order, (F.col("chunk") * size + F.col("_p")).cast("bigint")).drop("_p", "chunk")


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that a worker's memory does not follow the size of a batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def _compose(kind, back: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            xs, steps = batch.column("xs").to_pylist(), batch.column("_step").to_pylist()
            xs = [x[::-1] if back else x for x in xs]
            maps = [kind.compose(x, s) for x, s in zip(xs, steps, strict=True)]
            lasts = [kind.run(x, None, s)[-1] for x, s in zip(xs, steps, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lasts, pa.float64()), pa.array(maps, pa.list_(pa.float64()))],
                names=[*batch.schema.names[:2], "last", "corners"])

    return run


def _along(kind) -> Callable:
    """Rows come sorted by key and along it; each gets the value before it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, value = object(), None
        for batch in _few(batches):
            out = []
            for k, last, corners in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if k != key:
                    key, value = k, None
                out.append(value)
                value = last if value is None else kind.apply(corners, value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=[*batch.schema.names[:2], "before"])

    return run


def _run(kind, back: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            names = batch.schema.names
            at, out = names.index("xs"), []
            for xs, before, step in zip(*(batch.column(c).to_pylist() for c in ("xs", "before", "_step")), strict=True):
                ys = kind.run(xs[::-1] if back else xs, before, step)
                out.append(ys[::-1] if back else ys)
            arrays = [pa.array(out, pa.list_(pa.float64())) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=names).drop_columns(["before", "_step"])

    return run


def scan(chunks: DataFrame, key: str, kind, back: bool = False, step: str | None = None) -> DataFrame:
    """``chunks(key, chunk, xs, ...)`` with the recurrence ``kind`` run along each key, or ``back``.

    ``step`` names a column with the limit of ``Limit``, one value per key. Keys must not be null;
    values must not be. A key of one chunk has no value before it and is run where it is; only
    chunks of longer keys are composed and joined.
    """
    chunks = stable(chunks.where(F.col(key).isNotNull()))
    with_step = chunks.withColumn("_step", F.col(step).cast("double") if step else F.lit(None).cast("double"))
    # Written, so that few such keys are known to be few and are sent to the chunks.
    long = stable(chunks.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key))
    alone = with_step.join(long, key, "left_anti").withColumn("before", F.lit(None).cast("double"))
    linked = with_step.join(long, key, "left_semi")
    key_type = chunks.schema[key].dataType
    place = [T.StructField(key, key_type), T.StructField("chunk", chunks.schema["chunk"].dataType)]
    maps = linked.select(key, "chunk", "xs", "_step").mapInArrow(_compose(kind, back), T.StructType(
        [*place, T.StructField("last", T.DoubleType()), T.StructField("corners", T.ArrayType(T.DoubleType()))]))
    order = F.desc("chunk") if back else F.asc("chunk")
    before = maps.repartition(key).sortWithinPartitions(key, order).mapInArrow(
        _along(kind), T.StructType([*place, T.StructField("before", T.DoubleType())]))
    columns = [*chunks.columns, "before", "_step"]
    met = alone.select(*columns).unionByName(linked.join(before, [key, "chunk"]).select(*columns))
    return met.mapInArrow(_run(kind, back), chunks.schema)
