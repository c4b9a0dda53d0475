"""Choosing among overlapping, near-duplicate candidates."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from momentloom.functions import text as tx
from momentloom.functions.timefmt import div
from momentloom.operators.joins import overlap_ratio
from momentloom.plans.ordered import bind
from momentloom.plans.stable import drop, scope, settled, stable

MAX_OVERLAP, MAX_TEXT = 0.45, 0.6
RELAXED = ((0.55, 0.7), (0.65, 0.78), (0.75, 0.85))
FOLD_LIMIT = 1024
UNIT_ROWS = 50_000


def _token_ids(text: str) -> Column:
    """Distinct tokens as 64-bit hashes: cheaper to ship and compare than strings."""
    return F.array_distinct(F.transform(tx.tokens(text), lambda t: F.xxhash64(t)))


def _clash(a: Column, b: Column, max_overlap: float, max_text: float) -> Column:
    """Too much shared time, or too similar in words. Set sizes bound the similarity, and tell the size of the union."""
    n, m = F.size(a["toks"]), F.size(b["toks"])
    shared_time = overlap_ratio(a["s"], a["e"], b["s"], b["e"]) > max_overlap
    could = F.least(n, m) > F.greatest(n, m) * F.lit(max_text)
    similar = bind(F.size(F.array_intersect(a["toks"], b["toks"])), lambda both: both / (n + m - both))
    return F.when(shared_time, True).when(could, similar > max_text).otherwise(False)


def _fold(line: Column, max_overlap: float, max_text: float, empty: Column) -> Column:
    """Visit rows best first; keep a row that clashes with nothing kept so far."""
    return F.aggregate(
        line, empty,
        lambda kept, c: F.when(
            F.exists(kept, lambda k: _clash(c, k, max_overlap, max_text)), kept
        ).otherwise(F.concat(kept, F.array(c))),
    )


def _ranked(df: DataFrame, key: str, by: str, order: Sequence[str]) -> DataFrame:
    """Narrow rows for comparison; the struct order is best first, ties by ``order``."""
    place = F.struct((-F.col(by)).alias("neg"), *order)
    return df.select(
        key, place.alias("place"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e"),
        _token_ids("text").alias("toks"),
    )


def _kept_by_fold(narrow: DataFrame, key: str, levels, n: int | None) -> DataFrame:
    row = F.struct("place", "s", "e", "toks")
    lines = narrow.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("line"))
    empty = F.slice("line", 1, 0)
    lines = lines.withColumn("kept", _fold(F.col("line"), *levels[0], empty))
    for level in levels[1:]:
        # Only keys that are still short run the fold again.
        more = F.when(F.size("kept") < n, _fold(F.col("line"), *level, empty))
        lines = lines.withColumn("_more", more).withColumn(
            "kept", F.when(F.size("_more") > F.size("kept"), F.col("_more")).otherwise(F.col("kept"))
        )
    return lines.select(key, F.explode_outer("kept").alias("k")).select(key, "k.place")


def greedy_dedup(
    df: DataFrame, key: str = "transcript_id", by: str = "score_overall",
    order: Sequence[str] = ("start_ms", "end_ms"),
    max_overlap: float = MAX_OVERLAP, max_text: float = MAX_TEXT, fold_limit: int = FOLD_LIMIT,
) -> DataFrame:
    """Drop candidates that overlap or repeat a better one of the same key.

    Keys of up to ``fold_limit`` candidates (40 seeds x 5 lengths give 200 here) fold one array
    each; larger ones go through ``greedy_dedup_any``, with the same result. ``order`` breaks
    ties of ``by`` and must make rows unique.
    """
    large = stable(df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > fold_limit))
    if large.isEmpty():
        return _fold_dedup(df, key, by, order, max_overlap, max_text)
    small = _fold_dedup(df.join(large, key, "left_anti"), key, by, order, max_overlap, max_text)
    return small.unionByName(greedy_dedup_any(df.join(large, key, "left_semi"), key, by, order, max_overlap, max_text))


def _fold_dedup(df: DataFrame, key: str, by: str, order: Sequence[str], max_overlap: float, max_text: float) -> DataFrame:
    kept = _kept_by_fold(_ranked(df, key, by, order), key, [(max_overlap, max_text)], None)
    return _semi(df, kept, key, by, order)


def relaxed_dedup(
    df: DataFrame, n: int, key: str = "transcript_id", by: str = "score_overall",
    order: Sequence[str] = ("start_ms", "end_ms"),
) -> DataFrame:
    """``greedy_dedup`` of small keys; keys left with fewer than ``n`` rows retry with laxer limits.

    A laxer result is taken only when it is larger, and the retries stop at ``n``.
    """
    kept = _kept_by_fold(_ranked(df, key, by, order), key, [(MAX_OVERLAP, MAX_TEXT), *RELAXED], n)
    return _semi(df, kept, key, by, order)


def relaxed_dedup_any(
    df: DataFrame, n: int, key: str = "transcript_id", by: str = "score_overall",
    order: Sequence[str] = ("start_ms", "end_ms"), fold_limit: int = FOLD_LIMIT,
) -> DataFrame:
    """``relaxed_dedup`` without a bound on the candidates of a key.

    Keys of up to ``fold_limit`` rows fold; larger ones go through ``greedy_dedup_any``.
    Both give the same rows.
    """
    large = stable(df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > fold_limit))
    if large.isEmpty():
        return relaxed_dedup(df, n, key, by, order)
    rest = df.join(large, key, "left_semi")
    out = relaxed_dedup(df.join(large, key, "left_anti"), n, key, by, order)
    best = stable(greedy_dedup_any(rest, key, by, order))
    for overlap, text in RELAXED:
        short = stable(
            large.join(best.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), key)
            .where(F.col("_n") < n).select(key, "_n")
        )
        if short.isEmpty():
            break
        more = stable(greedy_dedup_any(rest.join(short, key, "left_semi"), key, by, order, overlap, text))
        better = (
            more.groupBy(key).agg(F.count(F.lit(1)).alias("_m")).join(short, key)
            .where(F.col("_m") > F.col("_n")).select(key)
        )
        best = stable(best.join(better, key, "left_anti").unionByName(more.join(better, key, "left_semi")))
    return out.unionByName(best)


def _semi(df: DataFrame, kept: DataFrame, key: str, by: str, order: Sequence[str]) -> DataFrame:
    kept = kept.select(key, (-F.col("place.neg")).alias(by), *[F.col(f"place.{c}").alias(c) for c in order])
    return df.join(kept, [key, by, *order], "left_semi")


def greedy_dedup_any(
    df: DataFrame, key: str = "transcript_id", by: str = "score_overall",
    order: Sequence[str] = ("start_ms", "end_ms"),
    max_overlap: float = MAX_OVERLAP, max_text: float = MAX_TEXT, width_ms: int = 10_000,
    unit_rows: int = UNIT_ROWS,
) -> DataFrame:
    """The result of ``greedy_dedup`` for keys with any number of candidates.

    Each row belongs to blocks: the time buckets it touches and the tokens of its
    similarity prefix (rarest first). Rows that clash share a block, so rows that no chain of
    blocks connects never decide about each other. A key of at most ``unit_rows`` open rows, or
    such a component of a larger one, is finished in one pass of one task: best rows first, each
    compared only with the rows kept so far in its blocks. Components above that go through
    rounds: the best open row of all its blocks is kept, rows that clash with the kept row
    of a block are dropped, and what stays open falls into smaller components. A round compares
    a block's rows with one pivot, so copies cost linear work.
    """
    limits = (max_overlap, max_text)

    def choose() -> DataFrame:
        ranked = stable(_ranked(df, key, by, order).withColumn("unit", F.lit(0).cast("long")))
        large = stable(_above(ranked.groupBy(key, "unit"), unit_rows))
        if large.isEmpty():
            return _kept_in_order(ranked, key, limits, width_ms)
        kept = _kept_in_order(ranked.join(large, [key, "unit"], "left_anti"), key, limits, width_ms)
        open_rows = settled(spark, lambda: _with_blocks(ranked.join(large, [key, "unit"], "left_semi"), key, max_text, width_ms))
        while True:
            large = stable(_above(open_rows.groupBy(key, "unit"), unit_rows))
            with scope(spark) as keep:
                last = large.isEmpty()
                small = open_rows if last else open_rows.join(large, [key, "unit"], "left_anti")
                kept = kept.unionByName(keep(_kept_in_order(small, key, limits, width_ms)))
                if last:
                    return kept
                won, left = _round(open_rows.join(large, [key, "unit"], "left_semi"), key, limits)
                kept, done = kept.unionByName(keep(won)), open_rows
                open_rows = keep(_components(left, key))
            drop(done)

    spark = df.sparkSession
    return _semi(df, settled(spark, choose), key, by, order)


def _above(groups, rows: int) -> DataFrame:
    """The groups of more than ``rows`` rows."""
    return groups.agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > rows).drop("_rows")


def _clashes(a: tuple, b: tuple, max_overlap: float, max_text: float) -> bool:
    """``_clash`` on two rows ``(start, end, tokens)``."""
    shared = max(0, min(a[1], b[1]) - max(a[0], b[0]))
    if shared / max(0.001, min(max(0, a[1] - a[0]), max(0, b[1] - b[0]))) > max_overlap:
        return True
    n, m = len(a[2]), len(b[2])
    if min(n, m) <= max(n, m) * max_text:
        return False
    both = len(a[2] & b[2])
    return both / (n + m - both) > max_text


def _visit(limits: tuple[float, float], width_ms: int) -> Callable:
    """Rows come sorted by unit and place; a row stays if it clashes with no kept row of its blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows, places = None, [], []

        def stays() -> list[pa.RecordBatch]:
            mask = pa.array(_stays(rows, limits, width_ms), pa.bool_())
            return pa.Table.from_batches(places).combine_chunks().filter(mask).to_batches()

        for batch in batches:
            names = batch.schema.names
            columns = [batch.column(names.index(c)).to_pylist() for c in (names[0], "unit", "s", "e")]
            tokens = batch.column(names.index("toks"))
            flat, offsets = tokens.values.to_numpy(zero_copy_only=False), tokens.offsets.to_numpy()
            narrow, begun = batch.select(names[:2]), 0
            for i, (k, u, start, end) in enumerate(zip(*columns, strict=True)):
                if unit != (k, u):
                    places.append(narrow.slice(begun, i - begun))
                    if rows:
                        yield from stays()
                    unit, rows, places, begun = (k, u), [], [], i
                rows.append((start, end, flat[offsets[i] : offsets[i + 1]]))
            places.append(narrow.slice(begun))
        if rows:
            yield from stays()

    return run


def _stays(rows: list[tuple], limits: tuple[float, float], width_ms: int) -> list[bool]:
    """Which rows ``(start, end, tokens)`` of one unit, best first, are kept.

    Blocks are those of ``_with_blocks``, with tokens counted in the unit.
    """
    sizes = [len(r[2]) for r in rows]
    seen, at, uses = np.unique(np.concatenate([r[2] for r in rows]), return_inverse=True, return_counts=True)
    rank = np.empty(len(seen), np.int64)
    rank[np.argsort(uses, kind="stable")] = np.arange(len(seen))
    ranked = rank[at]
    times: dict[int, list[tuple]] = {}
    words: dict[int, list[tuple]] = {}
    out, begun = [], 0
    for (start, end, _), size in zip(rows, sizes, strict=True):
        toks = np.sort(ranked[begun : begun + size]).tolist()
        begun += size
        if start is None or end is None:
            out.append(True)
            continue
        me = (start, end, frozenset(toks))
        first = start // width_ms
        spans = range(first, max(first, end // width_ms) + 1)
        rare = toks[: max(0, size - math.ceil(size * limits[1]) + 1)]
        rivals = {id(r): r for b in spans for r in times.get(b, ())}
        rivals |= {id(r): r for b in rare for r in words.get(b, ())}
        stay = not any(_clashes(me, r, *limits) for r in rivals.values())
        out.append(stay)
        if stay:
            for b in spans:
                times.setdefault(b, []).append(me)
            for b in rare:
                words.setdefault(b, []).append(me)
    return out


def _kept_in_order(rows: DataFrame, key: str, limits: tuple[float, float], width_ms: int) -> DataFrame:
    narrow = rows.select(key, "place", "unit", "s", "e", F.coalesce("toks", F.array().cast("array<bigint>")).alias("toks"))
    line = narrow.repartition(key, "unit").sortWithinPartitions(key, "unit", "place")
    return line.mapInArrow(_visit(limits, width_ms), T.StructType([narrow.schema[key], narrow.schema["place"]]))


def _round(open_rows: DataFrame, key: str, limits: tuple[float, float]) -> tuple[DataFrame, DataFrame]:
    """The rows that lead all of their blocks, and the rows that stay open."""
    # Tokens do not travel with every block: only a row and a winner that meet are compared.
    open_rows = stable(open_rows)
    member = open_rows.select(key, "place", F.explode("blocks").alias("block"))
    best = member.groupBy(key, "block").agg(F.min("place").alias("top"))
    state = stable(member.join(best, [key, "block"]).groupBy(key, "place").agg(
        F.every(F.col("place") == F.col("top")).alias("leads"), F.collect_set("top").alias("tops")))
    won = state.where("leads").select(key, "place")
    met = (
        state.where("not leads").select(key, "place", F.explode("tops").alias("foe"))
        .join(won.withColumnRenamed("place", "foe"), [key, "foe"], "left_semi")
    )
    me = F.struct("s", "e", "toks")
    rivals = open_rows.join(won, [key, "place"], "left_semi").groupBy(key, F.col("place").alias("foe")).agg(F.min(me).alias("rival"))
    lost = (
        met.join(open_rows.select(key, "place", "s", "e", "toks"), [key, "place"]).join(rivals, [key, "foe"])
        .where(_clash(me, F.col("rival"), *limits)).select(key, "place")
    )
    return won, stable(open_rows.join(won.unionByName(lost), [key, "place"], "left_anti"))


def _components(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``unit``, the smallest row of the component that blocks connect.

    Smallest labels spread over blocks, and every label is replaced by its own label, so long chains
    take a number of rounds like the logarithm of their length.
    """
    rows = rows.withColumn("_id", F.xxhash64(key, "place"))
    # Equal hashes would only join two components.
    member = stable(rows.select("_id", key, F.explode("blocks").alias("b")).select("_id", F.xxhash64(key, "b").alias("block")))
    labels = stable(member.select("_id", F.col("_id").alias("label")).distinct())
    while True:
        least = member.join(labels, "_id").groupBy("block").agg(F.min("label").alias("l"))
        spread = stable(member.join(least, "block").groupBy("_id").agg(F.min("l").alias("l")))
        via = spread.select(F.col("_id").alias("l"), F.col("l").alias("l2"))
        new = stable(spread.join(via, "l").join(labels, "_id").select("_id", F.least("l", "l2").alias("new"), "label"))
        labels = new.select("_id", F.col("new").alias("label"))
        if new.where("new != label").isEmpty():
            return stable(rows.drop("unit").join(labels.withColumnRenamed("label", "unit"), "_id").drop("_id"))


def _with_blocks(narrow: DataFrame, key: str, max_text: float, width_ms: int) -> DataFrame:
    """Blocks of each row. Sets with Jaccard above t share one of the first
    |x| - ceil(t|x|) + 1 tokens of each set, in any common order of the tokens."""
    token = narrow.select(key, "place", F.explode("toks").alias("tok"))
    seen = token.groupBy(key, "tok").agg(F.count(F.lit(1)).alias("df"))
    ordered = token.join(seen, [key, "tok"]).groupBy(key, "place").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("df", "tok"))), lambda x: x["tok"]).alias("rare_first")
    )
    size = F.size("rare_first")
    prefix = F.greatest(F.lit(0), size - F.ceil(size * F.lit(max_text)) + 1).cast("int")
    first = div(F.col("s"), width_ms)
    times = F.transform(
        F.sequence(first, F.greatest(first, div(F.col("e"), width_ms))),
        lambda b: F.struct(F.lit(0).alias("kind"), b.alias("v")),
    )
    words = F.transform(
        F.slice("rare_first", 1, prefix), lambda t: F.struct(F.lit(1).alias("kind"), t.alias("v"))
    )
    blocks = F.concat(times, F.coalesce(words, F.slice(times, 1, 0)))
    return narrow.join(ordered, [key, "place"], "left").withColumn("blocks", blocks).drop("rare_first")


def select_top_n(df: DataFrame, n: int, key: str = "transcript_id", by: str = "score_overall",
                 order: Sequence[str] = ("start_ms", "end_ms")) -> DataFrame:
    """The ``n`` best rows per key (at least one); ties go to the earlier row."""
    w = Window.partitionBy(key).orderBy(F.desc(by), *order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max(1, n)).drop("_n")


def rank_clips(df: DataFrame, key: str = "transcript_id", by: str = "score_overall",
               order: Sequence[str] = ("start_ms", "end_ms")) -> DataFrame:
    """Display ``index`` from 1 by score, ties in time order (for the chosen few)."""
    w = Window.partitionBy(key).orderBy(F.desc(by), *order)
    return df.withColumn("index", F.row_number().over(w))


def analysis_stats(candidates: DataFrame, unique: DataFrame, key: str = "transcript_id") -> DataFrame:
    """Candidates, distinct candidates and whether an outside score was used, per key."""
    used = F.bool_or("llm_used") if "llm_used" in candidates.columns else F.lit(False)
    a = candidates.groupBy(key).agg(F.count(F.lit(1)).alias("n_candidates"), used.alias("llm_used"))
    b = unique.groupBy(key).agg(F.count(F.lit(1)).alias("n_unique"))
    return a.join(b, key, "left").select(
        key, "n_candidates", F.coalesce("n_unique", F.lit(0)).cast("bigint").alias("n_unique"), "llm_used"
    )
