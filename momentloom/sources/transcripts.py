"""Readers for transcript documents and word-level recogniser output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentloom.functions import text as tx
from momentloom.functions.timefmt import to_ms

WORDS = "array<struct<start_ms:bigint,end_ms:bigint,text:string,prob:double>>"
TRANSCRIPT = """
    language string, backend string, model string, has_word_timestamps boolean,
    segments array<struct<
        start:double, `end`:double, text:string, avg_logprob:double, no_speech_prob:double,
        words:array<struct<start:double, `end`:double, text:string, prob:double, emphasis:boolean>>
    >>
"""
TOKENS = """
    result struct<language:string>,
    transcription array<struct<
        offsets:struct<`from`:bigint, `to`:bigint>, text:string,
        tokens:array<struct<text:string, offsets:struct<`from`:bigint, `to`:bigint>, p:double>>
    >>
"""


def _documents(spark: SparkSession, path: str, schema: str, multi_line: bool, id_field: str | None) -> DataFrame:
    docs = spark.read.schema(schema).json(path, multiLine=multi_line)
    name = F.regexp_replace("_metadata.file_name", r"\.json$", "")
    return docs.withColumn("transcript_id", F.col(id_field) if id_field else name)


def read_transcripts(
    spark: SparkSession, path: str, multi_line: bool = True, id_field: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """``transcripts`` and ``segments`` of a folder with one JSON document per file.

    The file name is the id. With ``multi_line=False`` files hold one document per line
    and ``id_field`` names the field that identifies it. Missing values get defaults.
    """
    docs = _documents(spark, path, TRANSCRIPT, multi_line, id_field)
    transcripts = docs.select(
        "transcript_id",
        F.coalesce("language", F.lit("en")).alias("language"),
        F.coalesce("backend", F.lit("")).alias("backend"),
        F.coalesce("model", F.lit("")).alias("model"),
        F.coalesce("has_word_timestamps", F.lit(False)).alias("has_word_timestamps"),
        F.coalesce(F.size("segments"), F.lit(0)).alias("n_segments"),
        F.coalesce(to_ms(F.element_at("segments", -1)["end"]), F.lit(0)).cast("bigint").alias("duration_ms"),
    )
    words = F.transform(F.coalesce("s.words", F.array().cast(
        "array<struct<start:double,end:double,text:string,prob:double,emphasis:boolean>>")), lambda w: F.struct(
        to_ms(w["start"]).alias("start_ms"), to_ms(w["end"]).alias("end_ms"), w["text"].alias("text"),
        F.coalesce(w["prob"], F.lit(1.0)).alias("prob")))
    language = F.coalesce("language", F.lit("en")).alias("language")
    segments = docs.select("transcript_id", language, F.posexplode("segments").alias("seg_idx", "s")).select(
        "transcript_id", "language", F.col("seg_idx").cast("bigint").alias("seg_idx"),
        to_ms(F.col("s.start")).alias("start_ms"), to_ms(F.col("s.end")).alias("end_ms"),
        F.coalesce("s.text", F.lit("")).alias("text"), words.alias("words"),
        F.coalesce("s.avg_logprob", F.lit(0.0)).alias("avg_logprob"),
        F.coalesce("s.no_speech_prob", F.lit(0.0)).alias("no_speech_prob"),
    )
    return transcripts, segments


def spoken_words(tokens):
    """Recogniser tokens as words: blank and ``[_...`` tokens go, a missing or zero
    probability counts as 1."""
    named = F.transform(tokens, lambda t: F.struct(
        F.coalesce(t["offsets"]["from"], F.lit(0)).cast("bigint").alias("start_ms"),
        F.coalesce(t["offsets"]["to"], F.lit(0)).cast("bigint").alias("end_ms"),
        tx.strip(F.coalesce(t["text"], F.lit(""))).alias("text"),
        F.coalesce(F.nullif(t["p"], F.lit(0.0)), F.lit(1.0)).alias("prob"),
    ))
    kept = F.filter(named, lambda w: (w["text"] != "") & ~w["text"].startswith("[_"))
    return F.coalesce(kept, F.array().cast(WORDS))


def token_segments(docs: DataFrame) -> DataFrame:
    """Segments of rows with (transcript_id, transcription)."""
    return docs.select("transcript_id", F.posexplode("transcription").alias("seg_idx", "s")).select(
        "transcript_id", F.col("seg_idx").cast("bigint").alias("seg_idx"),
        F.coalesce("s.offsets.from", F.lit(0)).cast("bigint").alias("start_ms"),
        F.coalesce("s.offsets.to", F.lit(0)).cast("bigint").alias("end_ms"),
        tx.strip(F.coalesce("s.text", F.lit(""))).alias("text"),
        spoken_words(F.col("s.tokens")).alias("words"),
    )


def read_token_json(
    spark: SparkSession, path: str, multi_line: bool = True, id_field: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """``transcripts`` and ``segments`` of recogniser token JSON (offsets in ms)."""
    docs = _documents(spark, path, TOKENS, multi_line, id_field)
    language = F.coalesce(F.nullif(F.col("result.language"), F.lit("")), F.lit("en"))
    spoken = F.exists("transcription", lambda s: F.size(spoken_words(s["tokens"])) > 0)
    transcripts = docs.select(
        "transcript_id", language.alias("language"),
        F.coalesce(spoken, F.lit(False)).alias("has_word_timestamps"),
        F.coalesce(F.size("transcription"), F.lit(0)).alias("n_segments"),
    )
    return transcripts, token_segments(docs)
