"""Batches for an outside scorer, and tolerant reading of its answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentloom.functions import text as tx
from momentloom.functions.timefmt import div
from momentloom.operators.incremental import last_per_key
from momentloom.plans.ordered import bind

BATCH_SIZE = 6

# Answer categories and field lengths.
CATEGORIES = (
    "story", "lesson", "insight", "surprising insight", "advice", "opinion",
    "question", "statistic", "emotional", "contrarian", "how-to", "definition",
)
FIELD_CHARS = {"hook": 90, "alt_hook": 90, "opening_text": 60, "reason": 240, "category": 40}
EMPHASIS_WORDS, EMPHASIS_CHARS = 8, 32
# End of fixed values.

EVAL_FIELDS = (
    "score", "hook", "alt_hook", "opening_text", "category", "reason", "self_contained", "emphasis_words",
)


# ------------------------------------------------------------------ asking

def build_eval_batches(
    candidates: DataFrame, position: str, key: str = "transcript_id", size: int = BATCH_SIZE,
    hints: DataFrame | None = None,
) -> DataFrame:
    """Consecutive groups of ``size`` candidates with a numbered listing of their texts.

    ``position`` is dense from 0 within the key (see ``with_position``). ``hints`` has
    (key, topic_hint); with it, ``prompt`` is the hint, a blank line and the listing.
    """
    slot = (F.col(position) % size).cast("int")
    seconds = F.rint((F.col("end_ms") - F.col("start_ms")) / 1000.0).cast("bigint").cast("string")
    entry = F.concat(F.lit("["), slot.cast("string"), F.lit("] ("), seconds, F.lit("s) "), F.col("text"))
    lines = F.sort_array(F.collect_list(F.struct(slot.alias("i"), entry.alias("t"))))
    batches = candidates.groupBy(key, div(F.col(position), size).alias("batch")).agg(
        F.count(F.lit(1)).cast("int").alias("n_expected"),
        F.array_join(F.transform(lines, lambda x: x["t"]), "\n\n").alias("listing"),
    )
    if hints is None:
        return batches
    batches = batches.join(hints.select(key, "topic_hint"), key, "left")
    about = F.coalesce("topic_hint", F.lit(""))
    return batches.withColumn("prompt", F.concat(about, F.lit("\n\n"), F.col("listing")))


def evaluate_with(
    batches: DataFrame, fn: Callable[[str], str], prompt: str = "listing",
    key: str = "transcript_id", partitions: int | None = None,
) -> DataFrame:
    """Add ``raw``, what ``fn`` answers to each prompt, and ``error``: where it fails,
    ``raw`` is null and ``error`` says why.

    ``partitions`` sets how many callers run at once; batches of one key are spread.
    """
    spread = batches.repartition(partitions, key, "batch") if partitions else batches.repartition(key, "batch")

    def ask(text: str) -> tuple[str | None, str | None]:
        try:
            return fn(text), None
        except Exception as e:  # noqa: BLE001 - a failed call leaves a null answer
            return None, f"{type(e).__name__}: {e}"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            answers = [ask(text) for text in part[prompt]]
            part["raw"] = [raw for raw, _ in answers]
            part["error"] = [error for _, error in answers]
            yield part

    schema = ", ".join(f"`{n}` {t}" for n, t in [*spread.dtypes, ("raw", "string"), ("error", "string")])
    return spread.mapInPandas(run, schema)


# ----------------------------------------------------------------- parsing

def _parse(text: Column) -> Column:
    """Variant of a text that is one whole JSON value, else null.

    The wrapping makes the parser refuse anything after the value.
    """
    inside = F.try_variant_get(
        F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>"
    )
    return F.when(F.size(inside) == 1, F.get(inside, F.lit(0)))


def _repair(text: Column) -> Column:
    t = F.btrim(tx.strip(text), F.lit("`"))
    t = F.regexp_replace(t, r",\s*([}\]])", "$1")
    t = F.translate(t, "“”’", "\"\"'")
    only_single = ~t.contains('"') & t.contains("'")
    return F.when(only_single, F.replace(t, F.lit("'"), F.lit('"'))).otherwise(t)


def _fenced(text: Column) -> Column:
    body = F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)```", 1)
    return F.when(text.rlike(r"(?is)```(?:json)?\s*(.*?)```"), tx.strip(body))


def largest_balanced(text: Column) -> Column:
    """Longest balanced {...} or [...] block; braces are tried first."""
    def longest(opener: str, closer: str) -> Column:
        zero = F.struct(*[F.lit(v).alias(n) for n, v in (("i", 0), ("depth", 0), ("start", 0), ("best", 0), ("len", 0))])

        def step(s: Column, ch: Column) -> Column:
            i = s["i"] + 1
            depth = s["depth"] + F.when(ch == opener, 1).when((ch == closer) & (s["depth"] > 0), -1).otherwise(0)
            start = F.when((ch == opener) & (s["depth"] == 0), i).otherwise(s["start"])
            found = (ch == closer) & (s["depth"] == 1) & (i - start + 1 > s["len"])
            return F.struct(
                i.alias("i"), depth.alias("depth"), start.alias("start"),
                F.when(found, start).otherwise(s["best"]).alias("best"),
                F.when(found, i - start + 1).otherwise(s["len"]).alias("len"),
            )

        return F.aggregate(F.split(text, ""), zero, step)

    def cut(pick: Column) -> Column:
        return F.when(pick["len"] > 0, F.substring(text, pick["best"], pick["len"]))

    # Each scan runs once: the results are bound before they are compared and used.
    both = F.struct(longest("{", "}").alias("braces"), longest("[", "]").alias("brackets"))
    return bind(both, lambda x: bind(
        F.when(x["brackets"]["len"] > x["braces"]["len"], x["brackets"]).otherwise(x["braces"]), cut))


def parse_eval_responses(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``parsed`` (variant): the answer as it is, then its fenced block, then its
    largest balanced block; each also after light repairs. Null marks a reject."""
    text = tx.strip(F.coalesce(F.col(raw), F.lit("")))
    df = df.withColumn("_text", text)
    whole, fence = F.col("_text"), _fenced(F.col("_text"))
    df = df.withColumn("parsed", F.coalesce(
        _parse(whole), _parse(_repair(whole)), _parse(fence), _parse(_repair(fence))
    ))
    # The scan by character runs only where the cheaper attempts failed.
    df = df.withColumn("_blob", F.when(F.col("parsed").isNull(), largest_balanced(whole)))
    return df.withColumn(
        "parsed", F.coalesce("parsed", _parse(F.col("_blob")), _parse(_repair(F.col("_blob"))))
    ).drop("_text", "_blob")


# -------------------------------------------------------------- validating

def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _field(obj: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(obj, "$." + name, kind)


def _clean(text: Column, chars: int) -> Column:
    return F.substring(F.replace(F.btrim(tx.strip(text), F.lit('"')), F.lit("\n"), F.lit(" ")), 1, chars)


def _string(obj: Column, name: str, alias: str | None = None) -> Column:
    def raw(n: str) -> Column:
        return F.when(_kind(_field(obj, n)) == "STRING", _field(obj, n, "string"))

    text = raw(name)
    if alias:
        missing = _kind(_field(obj, name)).isin("VOID") | (F.coalesce(text, F.lit("x")) == "")
        text = F.when(missing, raw(alias)).otherwise(text)
    return F.coalesce(_clean(text, FIELD_CHARS[name]), F.lit(""))


def _truth(obj: Column, name: str, alias: str) -> Column:
    def one(n: str) -> Column:
        v, text = _field(obj, n), F.lower(F.trim(_field(obj, n, "string")))
        return (
            F.when(v.isNull(), F.lit(None).cast("boolean"))
            .when(_kind(v) == "VOID", F.lit(False))
            .when(text.isin("true", "yes", "1"), F.lit(True))
            .when(text.isin("false", "no", "0", ""), F.lit(False))
            .otherwise(F.lit(True))
        )

    return F.coalesce(one(name), one(alias), F.lit(True))


def validated(obj: Column) -> Column:
    """Safe, typed struct of one evaluation object: wrong types give defaults."""
    v = _field(obj, "score")
    number = F.when(_kind(v) == "BOOLEAN", _field(obj, "score", "boolean").cast("double")).otherwise(
        tx.strip(_field(obj, "score", "string")).try_cast("double")
    )
    # greatest and least pass over nulls, so the default comes first
    number = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(number, F.lit(50.0))))
    category = F.lower(_string(obj, "category"))
    first = _field(obj, "emphasis_words", "array<variant>")
    listed = F.coalesce(F.when(F.size(first) > 0, first), _field(obj, "emphasisWords", "array<variant>"))
    words = F.transform(
        F.filter(listed, lambda w: _kind(w) == "STRING"),
        lambda w: _clean(F.try_variant_get(w, "$", "string"), EMPHASIS_CHARS),
    )
    words = F.slice(F.filter(words, lambda w: w != ""), 1, EMPHASIS_WORDS)
    return F.struct(
        number.cast("int").alias("score"),
        _string(obj, "hook").alias("hook"),
        _string(obj, "alt_hook", "altHook").alias("alt_hook"),
        _string(obj, "opening_text", "openingText").alias("opening_text"),
        F.when(category.isin(*CATEGORIES), category).otherwise(F.lit("insight")).alias("category"),
        _string(obj, "reason").alias("reason"),
        _truth(obj, "self_contained", "selfContained").alias("self_contained"),
        F.coalesce(words, F.array().cast("array<string>")).alias("emphasis_words"),
    )


def validate_evals(df: DataFrame, obj: str = "parsed") -> DataFrame:
    """Replace a variant column of evaluation objects by typed columns."""
    return df.withColumn("_e", validated(F.col(obj))).select(
        *[c for c in df.columns if c != obj], *[F.col("_e")[f].alias(f) for f in EVAL_FIELDS]
    )


def match_evals(df: DataFrame, parsed: str = "parsed", n_expected: str = "n_expected") -> DataFrame:
    """One row per (batch, slot) with a valid evaluation.

    Entries match by ``index`` (or ``id``), the last one wins, and slots out of range
    are dropped. When nothing matches and the counts agree, order decides. ``df`` has
    one row per batch; a batch is matched inside its row.
    """
    top = F.col(parsed)

    def listing(name: str) -> Column:
        found = _field(top, name, "array<variant>")
        return F.when(F.size(found) > 0, found)

    rows = F.coalesce(
        F.try_variant_get(top, "$", "array<variant>"),
        listing("results"), listing("candidates"), listing("clips"),
    )

    def slot(row: Column) -> Column:
        named = F.coalesce(_field(row, "index"), _field(row, "id"))
        text = F.try_variant_get(named, "$", "string")
        whole = F.when(_kind(named) == "STRING", tx.strip(text).try_cast("int")).otherwise(
            F.try_variant_get(named, "$", "double").try_cast("int"))
        return F.coalesce(whole, F.lit(-1))

    entry = F.transform(rows, lambda row, pos: F.struct(
        pos.alias("pos"), slot(row).alias("slot"), row.alias("obj"),
        _kind(row).startswith("OBJECT").alias("is_obj"),
    ))
    df = df.withColumn("_rows", entry)
    in_range = lambda r: r["is_obj"] & (r["slot"] >= 0) & (r["slot"] < F.col(n_expected))
    df = df.withColumn("_named", F.filter("_rows", in_range))
    by_order = (F.size("_named") == 0) & (F.size("_rows") == F.col(n_expected))
    ordered = F.transform(F.filter("_rows", lambda r: r["is_obj"]), lambda r: F.struct(
        r["pos"].alias("pos"), r["pos"].alias("slot"), r["obj"].alias("obj"), r["is_obj"].alias("is_obj")))
    df = df.withColumn("_use", F.when(by_order, ordered).otherwise(F.col("_named")))
    # The last entry of a slot wins.
    last = F.filter("_use", lambda r: ~F.exists(
        F.col("_use"), lambda q: (q["slot"] == r["slot"]) & (q["pos"] > r["pos"])))
    rest = [c for c in df.columns if not c.startswith("_") and c != parsed]
    out = df.select(*rest, F.explode_outer(last).alias("_r")).where("_r is not null").select(
        *rest, F.col("_r.slot").alias("slot"), F.col("_r.obj").alias("_obj"))
    return validate_evals(out, "_obj")


def merge_evals(candidates: DataFrame, evals: DataFrame, on: list[str], order: str | None = None) -> DataFrame:
    """Let evaluations override candidate fields; empty values keep the old ones.

    ``evals`` has the columns ``on`` and the evaluation fields; of several rows of a
    candidate, the last by ``order`` counts. Adds ``eval_score`` (null without evaluation) and ``llm_used``.
    """
    evals = last_per_key(evals.select(*on, *EVAL_FIELDS, *([order] if order else [])), on, order)
    e = evals.select(*on, *[F.col(f).alias("_e_" + f) for f in EVAL_FIELDS], F.lit(True).alias("_hit"))
    df = candidates.join(e, on, "left")
    have = set(candidates.columns)

    def old(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in have else default

    hit = F.col("_hit").isNotNull()
    text = {
        n: F.coalesce(F.nullif(F.col("_e_" + n), F.lit("")), old(n, F.lit(d)))
        for n, d in (("hook", ""), ("alt_hook", ""), ("opening_text", ""), ("category", "insight"), ("reason", ""))
    }
    none = F.array().cast("array<string>")
    return df.withColumns({
        **text,
        "self_contained": F.coalesce(F.col("_e_self_contained"), old("self_contained", F.lit(True))),
        "emphasis_words": F.when(F.size("_e_emphasis_words") > 0, F.col("_e_emphasis_words")).otherwise(
            old("emphasis_words", none)),
        "eval_score": F.col("_e_score"),
        "llm_used": hit,
    }).drop("_hit", *["_e_" + f for f in EVAL_FIELDS])


HOOK_FIELDS = ("hook", "alt_hook", "opening_text")


def validate_hooks(df: DataFrame, obj: str = "parsed") -> DataFrame:
    """Replace a variant column of hook answers by typed ``hook``, ``alt_hook`` and ``opening_text``;
    wrong types give empty texts."""
    v = F.col(obj)
    return df.select(
        *[c for c in df.columns if c != obj], _string(v, "hook").alias("hook"),
        _string(v, "alt_hook", "altHook").alias("alt_hook"), _string(v, "opening_text", "openingText").alias("opening_text"))


def merge_hooks(clips: DataFrame, answers: DataFrame, on: list[str], order: str | None = None) -> DataFrame:
    """Let hook answers override the texts of clips.

    An answer without a hook changes nothing; an empty alternative or opening keeps the
    old one. Of several answers to a clip, the last by ``order`` counts.
    """
    given = last_per_key(answers.select(*on, *HOOK_FIELDS, *([order] if order else [])), on, order).where("hook != ''")
    new = given.select(*on, *[F.col(f).alias("_h_" + f) for f in HOOK_FIELDS])
    df = clips.join(new, on, "left")
    old = {f: F.col(f) if f in clips.columns else F.lit("") for f in HOOK_FIELDS}
    return df.withColumns({
        f: F.coalesce(F.nullif(F.col("_h_" + f), F.lit("")), old[f], F.lit("")) for f in HOOK_FIELDS
    }).drop(*["_h_" + f for f in HOOK_FIELDS])
