"""Media probe JSON to typed video rows, with rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_FPS = 30.0
PROBE = """struct<
    format:struct<duration:string, size:string, format_name:string>,
    streams:array<struct<
        codec_type:string, codec_name:string, width:string, height:string, duration:string,
        avg_frame_rate:string, r_frame_rate:string, channels:string, sample_rate:string,
        tags:struct<rotate:string>, side_data_list:array<struct<rotation:string>>
    >>
>"""
REASONS = ("unreadable", "no video stream", "missing duration or dimensions")


def fraction(text: Column) -> Column:
    """``a/b`` or a plain number as double; 0 when it cannot be read."""
    top = F.substring_index(text, "/", 1).try_cast("double")
    below = F.regexp_extract(text, "^[^/]*/(.*)$", 1).try_cast("double")
    ratio = F.try_divide(top, below)
    return F.coalesce(F.when(text.contains("/"), ratio).otherwise(text.try_cast("double")), F.lit(0.0))


def _whole(text: Column) -> Column:
    return F.coalesce(text.try_cast("double").cast("bigint"), F.lit(0))


def _once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` with ``value``, computed once per row: columns and filters above cannot inline it."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def parse_media_probe(df: DataFrame, json_col: str = "json") -> tuple[DataFrame, DataFrame]:
    """(videos, rejects) of a column of probe JSON; other columns are kept."""
    rest = [c for c in df.columns if c != json_col]
    read = _once(df, F.from_json(json_col, PROBE), "_p")

    def first(kind: str) -> Column:
        return F.get(F.filter("_p.streams", lambda s: s["codec_type"] == kind), F.lit(0))

    read = _once(read, F.struct(first("video").alias("v"), first("audio").alias("a")), "_s")
    read = read.withColumns({"_v": F.col("_s.v"), "_a": F.col("_s.a"), "_f": F.col("_p.format")})
    turned = F.filter("_v.side_data_list", lambda s: s["rotation"].isNotNull())
    side = F.coalesce(F.element_at(turned, -1)["rotation"].try_cast("double").cast("int"), F.lit(0))
    side = F.when(F.size(turned) > 0, side).otherwise(F.lit(0))
    rotation = F.coalesce(F.col("_v.tags.rotate").try_cast("int"), side)
    swap = rotation.isin(90, -90, 270, -270)

    def nonzero(*values: Column) -> Column:
        return F.coalesce(*[F.nullif(v, F.lit(0.0)) for v in values])

    w, h = _whole(F.col("_v.width")), _whole(F.col("_v.height"))
    duration = F.coalesce(nonzero(fraction(F.col("_f.duration")), fraction(F.col("_v.duration"))), F.lit(0.0))
    fps = nonzero(fraction(F.col("_v.avg_frame_rate")), fraction(F.col("_v.r_frame_rate")))
    typed = {
        "duration_ms": F.rint(duration * 1000).cast("bigint"),
        "width": F.when(swap, h).otherwise(w).cast("int"),
        "height": F.when(swap, w).otherwise(h).cast("int"),
        "fps": F.coalesce(F.rint(fps * 1000) / 1000, F.lit(DEFAULT_FPS)),
        "has_audio": F.col("_a").isNotNull(),
        "video_codec": F.coalesce("_v.codec_name", F.lit("")),
        "audio_codec": F.coalesce("_a.codec_name", F.lit("")),
        "audio_channels": _whole(F.col("_a.channels")).cast("int"),
        "audio_sample_rate": _whole(F.col("_a.sample_rate")).cast("int"),
        "size_bytes": _whole(F.col("_f.size")),
        "container": F.coalesce(F.substring_index("_f.format_name", ",", 1), F.lit("")),
        "reject_reason": F.when(F.col("_p").isNull() | F.col("_p.streams").isNull() & F.col("_f").isNull(), REASONS[0])
        .when(F.col("_v").isNull(), REASONS[1])
        .when((duration <= 0) | (w <= 0) | (h <= 0), REASONS[2]),
    }
    kept = [c for c in df.columns if c not in typed]
    typed = _once(read, F.struct(*[value.alias(name) for name, value in typed.items()]), "_t").select(*kept, "_t.*")
    videos = typed.where("reject_reason is null").drop("reject_reason", json_col)
    rejects = typed.where("reject_reason is not null").select(*rest, json_col, "reject_reason")
    return videos, rejects
