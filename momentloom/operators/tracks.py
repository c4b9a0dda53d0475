"""Conditioning of tracked positions into smooth crop plans.

Grids stay rows, or chunks of at most ``scans.CHUNK`` values, so a clip may be of any length. The
array functions are for grids that are short by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momentloom.functions.timefmt import div
from momentloom.operators import scans
from momentloom.operators.joins import overlap_join
from momentloom.plans.ordered import before, bind
from momentloom.plans.stable import stable

STEP_MS = 100
STATIC_SPREAD = 0.06
ALPHA = 0.16


def largest_per_frame(obs: DataFrame, track: str = "track_id", t: str = "t_ms") -> DataFrame:
    """Keep the largest observation of each frame (map-side combined)."""
    rest = [c for c in obs.columns if c not in (track, t)]
    best = F.max_by(F.struct(*rest), F.struct((F.col("w") * F.col("h")).alias("a"), (-F.col("cx")).alias("b"), (-F.col("cy")).alias("c")))
    return obs.groupBy(track, t).agg(best.alias("_o")).select(track, t, *[f"_o.{c}" for c in rest])


def clip_grid(clips: DataFrame, step_ms: int = STEP_MS) -> DataFrame:
    """Regular time points of each clip: at least two, from its start on."""
    length = F.greatest(F.lit(200), F.col("end_ms") - F.col("start_ms"))
    n = F.greatest(F.lit(2), F.floor(length / step_ms) + 1)
    return clips.select(
        "clip_id", F.col("start_ms").alias("_c0"), F.explode(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).alias("i")
    ).select("clip_id", "i", (F.col("_c0") + F.col("i") * step_ms).cast("bigint").alias("t_ms"))


def resample_linear(
    obs: DataFrame, clips: DataFrame, value: str = "cx", step_ms: int = STEP_MS,
    track: str = "track_id", bucket_ms: int = 60_000,
) -> DataFrame:
    """``value`` at every grid point of each clip: linear between observations inside
    the clip, held before the first and after the last. Clips without observations
    give no rows. A ``clip_id`` names one span."""
    return _resampled(obs, clips, value, step_ms, track, bucket_ms, scans.CHUNK).drop("chunk")


def resample_chunks(
    obs: DataFrame, clips: DataFrame, value: str = "cx", step_ms: int = STEP_MS,
    track: str = "track_id", bucket_ms: int = 60_000,
) -> DataFrame:
    """``resample_linear`` as ``scans.chunked`` values, without an exchange of grid points."""
    return scans.chunked(_resampled(obs, clips, value, step_ms, track, bucket_ms, scans.CHUNK), "clip_id", "i", "value")


def _resampled(
    obs: DataFrame, clips: DataFrame, value: str, step_ms: int, track: str, bucket_ms: int, size: int
) -> DataFrame:
    """``(clip_id, chunk, i, t_ms, value)``; the points of a chunk of ``size`` stand in one partition.

    Only observations are shuffled. Those between two grid points are a cell, of which the first and the
    last count. A cell makes the points since the cell before it, and the end of a chunk those after the last.
    What lies beyond a chunk comes from one row per chunk, and is asked for in clips of several chunks only.
    """
    start = F.col("_a").cast("bigint")
    length = F.greatest(F.lit(200), F.col("_b") - F.col("_a"))
    n = F.greatest(F.lit(2), F.floor(length / step_ms) + 1).cast("bigint")
    spans = clips.select(track, "clip_id", F.col("start_ms").alias("_a"), F.col("end_ms").alias("_b"))
    spans = spans.where(F.col("clip_id").isNotNull() & F.col(track).isNotNull() & n.isNotNull())
    seen = obs.select(track, F.col("t_ms").alias("_t"), F.col(value).alias("v")).withColumn("_t2", F.col("_t"))
    clip = ["clip_id", track, "_a", "_b"]
    inside = overlap_join(spans, seen, track, bucket_ms, ("_a", "_b"), ("_t", "_t2"))
    inside = inside.select(*clip, div(F.col("_t") - start, step_ms).alias("cell"), "_t", "v", F.lit(0).alias("_ends"))
    ends = spans.select(*clip, F.explode(F.sequence(F.lit(0).cast("bigint"), div(n - 1, size))).alias("chunk")).select(
        *clip, "chunk", F.least((F.col("chunk") + 1) * size, n).alias("cell"), F.lit(None).cast(inside.schema["_t"].dataType).alias("_t"),
        F.lit(None).cast(inside.schema["v"].dataType).alias("v"), F.lit(1).alias("_ends"))
    rows = inside.withColumn("chunk", div(F.col("cell"), size)).unionByName(ends)

    def cells(rows: DataFrame) -> DataFrame:
        at = [*clip, "chunk", "cell"]
        times = rows.repartition("clip_id", "chunk").groupBy(*at, "_t").agg(F.min(F.struct("v")).alias("_v"), F.sum("_ends").alias("_ends"))
        seen = F.struct(F.col("_t").alias("t"), F.col("_v.v").alias("v"))
        return times.groupBy(*at).agg(
            F.min_by(seen, "_t").alias("_first"), F.max_by(seen, "_t").alias("_last"), F.sum("_ends").alias("_ends"))

    # Along clips of several chunks: frames only grow, as looking ahead is looking back in the opposite order.
    along = Window.partitionBy(*clip)
    beyond = cells(rows.where(n > size)).groupBy(*clip, "chunk").agg(
        F.min_by("_first", F.when(F.col("_first").isNotNull(), F.col("cell"))).alias("_first"),
        F.max_by("_last", F.when(F.col("_last").isNotNull(), F.col("cell"))).alias("_last"))
    beyond = beyond.select(
        F.col("clip_id"), F.col("chunk"), F.struct(track, "_a", "_b").alias("_of"),
        F.last("_last", ignorenulls=True).over(before(along.orderBy("chunk"))).alias("_before"),
        F.last("_first", ignorenulls=True).over(before(along.orderBy(F.desc("chunk")))).alias("_after"))
    chunk = Window.partitionBy(*clip, "chunk")
    line = cells(rows).withColumns({
        "_since": F.lag("cell").over(chunk.orderBy("cell")), "_prev": F.lag("_last").over(chunk.orderBy("cell")),
        "_copies": F.max("_ends").over(chunk)})
    # Joined by what the cells are partitioned by; the span is compared besides.
    line = line.alias("l").join(stable(beyond).alias("r"), (F.col("l.clip_id") == F.col("r.clip_id")) & (F.col("l.chunk") == F.col("r.chunk")) & (
        F.struct(F.col(f"l.{track}"), F.col("l._a"), F.col("l._b")) <= F.col("r._of")) & (
        F.struct(F.col(f"l.{track}"), F.col("l._a"), F.col("l._b")) >= F.col("r._of")), "left").select("l.*", "_before", "_after")
    end = F.col("_ends") > 0
    lo = F.coalesce(F.col("_since") + 1, F.col("chunk") * size)
    hi = F.when(end, F.col("cell") - 1).otherwise(F.col("cell"))
    points = F.when(lo <= hi, F.flatten(F.array_repeat(F.sequence(lo, hi), F.col("_copies").cast("int"))))
    line = line.select(
        "clip_id", "chunk", "cell", start.alias("_c0"), F.col("_first").alias("_own"), F.coalesce("_prev", "_before").alias("_prev"),
        F.when(end, F.col("_after")).otherwise(F.col("_first")).alias("_next"), F.explode_outer(points).alias("i"))
    line = line.where("i is not null").withColumn("t_ms", F.col("_c0") + F.col("i") * step_ms)
    t, b = F.col("t_ms"), F.col("_next")
    line = line.withColumn("_prev", F.when((F.col("i") == F.col("cell")) & (F.col("_own.t") == t), F.col("_own")).otherwise(F.col("_prev")))
    a = F.col("_prev")
    part = (t - a["t"]) / F.greatest(F.lit(0.001), b["t"] - a["t"])
    lerp = a["v"] + part * (b["v"] - a["v"])
    return line.select(
        "clip_id", "chunk", "i", "t_ms",
        F.when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(lerp).alias("value"),
    ).where("value is not null")


def collect_grid(chunks: DataFrame) -> DataFrame:
    """One row per clip with its grid values in time order, for short clips."""
    line = F.sort_array(F.collect_list(F.struct("chunk", "xs")))
    return chunks.groupBy("clip_id").agg(F.flatten(F.transform(line, lambda p: p["xs"])).alias("xs"))


def smoothed(chunks: DataFrame, key: str = "clip_id", alpha: float = ALPHA) -> DataFrame:
    """``ema_two_pass`` along keys of any length, on chunks of their values."""
    return scans.scan(scans.scan(chunks, key, scans.Mean(alpha)), key, scans.Lag(0.6, 0.4), back=True)


def slew_limited(chunks: DataFrame, max_step: str, key: str = "clip_id") -> DataFrame:
    """``slew_limit`` along keys of any length; ``max_step`` is a column of ``chunks``."""
    return scans.scan(chunks, key, scans.Limit, step=max_step)


def changed_points(points: DataFrame, key: str, n: str, step_ms: int, size: int = scans.CHUNK) -> DataFrame:
    """``(key, t_ms, x)`` of the first, the last and every changed point of chunks of whole pixels ``px``.

    Neighbours across a border come from one row per chunk. ``n`` is a column with a key's points.
    """
    ends = points.select(key, (F.col("chunk") + 1).alias("chunk"), F.element_at("px", -1).alias("_last"))
    # Written, so that few such borders are known to be few and are sent to the chunks.
    borders = stable(ends.join(points.where("chunk > 0").select(key, "chunk"), [key, "chunk"], "left_semi"))
    line = points.join(borders, [key, "chunk"], "left")
    rows = line.select(key, n, F.col("chunk") * size, "_last", "px", F.posexplode_outer("px").alias("_p", "x")).toDF(
        key, n, "_first", "_last", "px", "_p", "x")
    i = F.col("_first") + F.col("_p")
    earlier = F.when(F.col("_p") > 0, F.get("px", F.col("_p") - 1)).otherwise(F.col("_last"))
    rows = rows.where((i == 0) | (i == F.col(n) - 1) | (F.col("x") != earlier))
    return rows.select(key, (i * step_ms).cast("bigint").alias("t_ms"), "x")


def ema_two_pass(xs: Column, alpha: float = ALPHA) -> Column:
    """Forward exponential mean, then a backward pass that removes the lag, on a short array."""
    empty = F.array().cast("array<double>")

    def forward(acc: Column, x: Column) -> Column:
        nxt = F.lit(alpha) * x + F.lit(1 - alpha) * F.element_at(acc, -1)
        return F.when(F.size(acc) == 0, F.array(x)).otherwise(F.concat(acc, F.array(nxt)))

    def backward(acc: Column, x: Column) -> Column:
        nxt = F.lit(0.6) * x + F.lit(0.4) * F.element_at(acc, -1)
        return F.when(F.size(acc) == 0, F.array(x)).otherwise(F.concat(acc, F.array(nxt)))

    return F.reverse(F.aggregate(F.reverse(F.aggregate(xs, empty, forward)), empty, backward))


def slew_limit(xs: Column, max_step: Column) -> Column:
    """Limit the change between neighbours of a short array to ``max_step`` either way."""
    def step(acc: Column, x: Column) -> Column:
        prev = F.element_at(acc, -1)
        move = F.greatest(-max_step, F.least(max_step, x - prev))
        return F.when(F.size(acc) == 0, F.array(x)).otherwise(F.concat(acc, F.array(prev + move)))

    return F.aggregate(xs, F.array().cast("array<double>"), step)


def lock_if_static(xs: Column, width: Column, limit: float = STATIC_SPREAD) -> Column:
    """Mean of the values when they spread over less than ``limit`` of the width, else null."""
    spread = (F.array_max(xs) - F.array_min(xs)) / F.greatest(F.lit(1.0), width)
    total = F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(spread < limit, total / F.size(xs))


def decimate_changes(xs: Column, step_ms: int, length_ms: Column) -> Column:
    """(t_ms, x) where whole-pixel x changes, plus the first and last point."""
    return bind(F.transform(xs, lambda x: F.rint(x).cast("bigint")), lambda px: _changes(px, step_ms, length_ms))


def _changes(px: Column, step_ms: int, length_ms: Column) -> Column:
    points = F.transform(px, lambda x, i: F.struct((i * step_ms).cast("bigint").alias("t_ms"), x.alias("x"), i.alias("i")))
    kept = F.filter(points, lambda p: (p["i"] == 0) | (p["i"] == F.size(px) - 1) | (p["x"] != F.get(px, p["i"] - 1)))
    keys = F.transform(kept, lambda p: F.struct(p["t_ms"].alias("t_ms"), p["x"].alias("x")))
    pad = F.struct(length_ms.cast("bigint").alias("t_ms"), F.element_at(keys, -1)["x"].alias("x"))
    return F.when(F.size(keys) < 2, F.concat(keys, F.array(pad))).otherwise(keys)


def crop_geometry(df: DataFrame, mode: str, out_w: int = 1080, out_h: int = 1920) -> DataFrame:
    """Crop size and offsets of each (width, height) row before any tracking.

    ``case`` is fit, portrait, centre or track; ``x`` is the fixed left edge, null where
    a track decides it.
    """
    target = out_w / out_h
    w, h = F.col("width"), F.col("height")
    portrait = F.when(h != 0, w / h).otherwise(F.lit(target)) <= F.lit(target + 1e-3)
    case = (
        F.lit("fit") if mode == "fit"
        else F.when(portrait, "portrait").otherwise(F.lit("centre" if mode == "center" else "track"))
    )
    df = df.withColumn("case", case)
    is_fit, is_portrait = F.col("case") == "fit", F.col("case") == "portrait"
    tall = F.least(h, F.rint(w / F.lit(target)).cast("int"))
    df = df.withColumn("crop_w", F.when(is_fit | is_portrait, w).otherwise(F.least(w, F.rint(h * F.lit(target)).cast("int"))))
    df = df.withColumn("crop_h", F.when(is_portrait, tall).otherwise(h))
    free = F.col("width") - F.col("crop_w")
    return df.withColumns({
        "y_top": F.when(is_portrait, F.greatest(F.lit(0), F.floor((h - F.col("crop_h")) / 2))).otherwise(0).cast("int"),
        "x": F.when(is_fit | is_portrait, F.lit(0)).when(F.col("case") == "centre", F.rint(free / 2)).cast("int"),
    })


def plan_crop(
    videos: DataFrame, clips: DataFrame, obs: DataFrame, mode: str = "smart_auto",
    out_w: int = 1080, out_h: int = 1920, step_ms: int = STEP_MS, track: str = "track_id",
    bucket_ms: int = 60_000,
) -> DataFrame:
    """One crop plan per clip: size, whether it stands still, and its (t_ms, x) keys.

    ``videos`` has (track, width, height); ``obs`` has normalised ``cx`` per frame. The plan row
    gathers the changed points only.
    """
    base = crop_geometry(clips.join(videos, track), mode, out_w, out_h)
    grid = stable(resample_chunks(obs, clips, "cx", step_ms, track, bucket_ms))
    width, half = F.col("width").cast("double"), F.col("crop_w") / 2.0
    free = (F.col("width") - F.col("crop_w")).cast("double")

    def clamp(x: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(free, x))

    total = F.aggregate("xs", F.lit(0.0), lambda acc, x: acc + x)
    stats = grid.groupBy("clip_id").agg(
        F.sum(F.size("xs")).alias("_n"), F.min(F.array_min("xs")).alias("_min"), F.max(F.array_max("xs")).alias("_max"),
        (F.sum(total) / F.sum(F.size("xs"))).alias("_avg"))
    df = base.join(stats, "clip_id", "left")
    tracked = (F.col("case") == "track") & F.col("_n").isNotNull()
    spread = (F.col("_max") * width - F.col("_min") * width) / F.greatest(F.lit(1.0), width)
    lock = F.when(spread < STATIC_SPREAD, F.col("_avg") * width) if mode == "smart_auto" else F.lit(None).cast("double")
    pan = F.greatest(F.lit(2.0), F.lit(0.18) * F.greatest(F.lit(1.0), free) * F.lit(step_ms / 1000))
    df = df.withColumns({"tracked": tracked, "_lock": F.when(tracked, lock), "_pan": pan})
    df = stable(df.withColumn("_moves", F.col("tracked") & F.col("_lock").isNull()))
    facts = df.where("_moves").select("clip_id", "width", "crop_w", "_pan", "_n")
    moving = grid.join(facts, "clip_id")
    left = moving.withColumn("xs", F.transform("xs", lambda v: clamp(v * width - half)))
    left = slew_limited(smoothed(left), "_pan")
    pixels = stable(left.select("clip_id", "chunk", "_n", F.transform("xs", lambda x: F.rint(clamp(x)).cast("bigint")).alias("px")))
    points = changed_points(pixels, "clip_id", "_n", step_ms)
    keys = points.groupBy("clip_id").agg(F.sort_array(F.collect_list(F.struct("t_ms", "x"))).alias("_keys"))
    df = df.join(keys, "clip_id", "left")
    length = F.greatest(F.lit(200), F.col("end_ms") - F.col("start_ms")).cast("bigint")
    pad = F.struct(length.alias("t_ms"), F.element_at("_keys", -1)["x"].alias("x"))
    moved = F.when(F.size("_keys") < 2, F.concat("_keys", F.array(pad))).otherwise(F.col("_keys"))
    fixed = F.coalesce(
        F.col("x").cast("double"),
        F.when(F.col("_lock").isNotNull(), F.rint(clamp(F.col("_lock") - half))), F.rint(free / 2),
    ).cast("bigint")
    still = F.array(F.struct(F.lit(0).cast("bigint").alias("t_ms"), fixed.alias("x")))
    static = ~F.coalesce("_moves", F.lit(False))
    shown = F.when(F.col("case") == "fit", "fit").when(
        F.col("case").isin("portrait", "centre") | ~F.col("tracked"), "center").otherwise(F.lit(mode))
    return df.select(
        "clip_id", "crop_w", "crop_h", "y_top", static.alias("static"), shown.alias("mode"),
        F.when(static, still).otherwise(moved).alias("keys"),
    )
