"""Context windows around seeds.

The greedy growth of a window visits a fixed path of (lo, hi) states that does not
depend on the target length, so the path is laid out once per seed and each target
picks the first state that is long enough. A path has at most 200 steps each way;
therefore a window only ever sees sentences near its anchor, and work is done per
*tile* of consecutive sentence indexes plus a margin, never per transcript.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momentloom.functions import text as tx
from momentloom.functions.lexicon import FLAGS, TARGETS_MS
from momentloom.functions.timefmt import div
from momentloom.operators.joins import around
from momentloom.operators.segment import BLOCK_GAP_MS
from momentloom.plans.ordered import before, bind, chunk_carry
from momentloom.plans.stable import stable

MIN_CLIP_MS = 12_000
MAX_CLIP_MS = 95_000
LEAD_IN_GAP_MS = 900
GROWTH_GAP_MS = 1600
MAX_STEPS = 200
EVEN_TARGET_MS = 35_000
FOLD_LIMIT = 4096
TILE = 512
MARGIN = MAX_STEPS + 2


def spread_to_tiles(df: DataFrame, idx: str, back: int, ahead: int) -> DataFrame:
    """Copy each row to every tile whose range, widened by a margin, contains it.

    A tile looks ``back`` rows before its first index and ``ahead`` after its last.
    """
    first, last = div(F.col(idx) - ahead, TILE), div(F.col(idx) + back, TILE)
    tiles = F.sequence(F.greatest(F.lit(0), first), last)
    return df.withColumn("tile", F.explode(tiles))


def expand_windows(
    sentences: DataFrame, seeds: DataFrame, key: str = "transcript_id",
    targets_ms: Sequence[int] = TARGETS_MS, min_ms: int = MIN_CLIP_MS, max_ms: int = MAX_CLIP_MS,
    block_gap_ms: int = BLOCK_GAP_MS,
) -> DataFrame:
    """One row per (seed, target) that yields a window: lo, hi, start_ms, end_ms.

    ``sentences`` needs idx (dense), start_ms, end_ms, gap_before_ms, block and text;
    ``seeds`` comes from ``rank_seeds``. A single forced length is ``targets_ms=[n]``.
    """
    if block_gap_ms > GROWTH_GAP_MS:
        raise ValueError("blocks must break at pauses of 1.6 s or less")
    anchors = (
        seeds.withColumn("tile", div(F.col("idx"), TILE)).groupBy(key, "tile")
        .agg(F.collect_list(F.struct("idx", "seed_rank")).alias("anchors"))
    )
    known = "facts" in sentences.columns
    facts = sentences.select(
        key, "idx", "start_ms", "end_ms", "gap_before_ms", "block",
        (F.col("facts.starts_awkwardly") if known else tx.starts_awkwardly("text")).alias("awk"),
        (F.col("facts.looks_incomplete") if known else tx.looks_incomplete("text")).alias("inc"),
    )
    near = spread_to_tiles(facts, "idx", MARGIN, MARGIN).join(
        anchors.select(key, "tile"), [key, "tile"], "left_semi"
    )
    line = F.struct("idx", "start_ms", "end_ms", "gap_before_ms", "block", "awk", "inc")
    tiles = near.groupBy(key, "tile").agg(F.sort_array(F.collect_list(line)).alias("line"))
    one = tiles.join(anchors, [key, "tile"]).select(key, "line", F.explode("anchors").alias("s"))
    one = one.select(key, F.col("s.idx").alias("anchor"), F.col("s.seed_rank").alias("seed_rank"), "line")
    goals = [(i, int(t)) for i, t in enumerate(targets_ms)]
    found = bind(_reach(F.col("line"), F.col("anchor")), lambda near: _windows_of(
        near, F.col("anchor"), goals, min_ms, max_ms))
    return one.select(key, "seed_rank", "anchor", F.explode_outer(found).alias("w")).select(
        key, "seed_rank", "anchor", "w.*"
    ).where("lo is not null")


def _reach(line: Column, anchor: Column) -> Column:
    """The sentences of the anchor's block that a window can reach, in order."""
    offset = (anchor - line[0]["idx"]).cast("int")
    part = F.slice(line, F.greatest(F.lit(1), offset + 1 - MARGIN), F.lit(2 * MARGIN + 1))
    return bind(F.get(line, offset)["block"], lambda own: F.filter(part, lambda x: x["block"] == own))


def _windows_of(
    near: Column, anchor: Column, goals: list[tuple[int, int]], min_ms: int, max_ms: int
) -> Column:
    """Array with one window per goal; ``lo`` is null where there is none."""
    none = F.lit(None).cast("bigint")

    def ms(lo: Column, hi: Column) -> Column:
        return F.get(near, hi)["end_ms"] - F.get(near, lo)["start_ms"]

    def path(at: Column) -> Column:
        # State 0, then each step extends forward (odd) and backward (even).
        top = F.size(near) - 1
        lead = (at > 0) & (F.get(near, at)["gap_before_ms"] < LEAD_IN_GAP_MS)

        def states(lo0: Column) -> Column:
            def state(k: Column) -> Column:
                j = F.shiftright(k + 1, 1)
                lo, hi = F.greatest(lo0 - F.shiftright(k, 1), F.lit(0)), F.least(at + j, top)
                return F.struct(lo.alias("lo"), hi.alias("hi"), ms(lo, hi).alias("ms"))

            steps = F.least(F.lit(MAX_STEPS), F.greatest(lo0, top - at))
            return F.transform(F.sequence(F.lit(0), steps * 2), state)

        return bind(F.when(lead, at - 1).otherwise(at), states)

    def cut(at: Column, pick: Column, goal: Column) -> Column:
        shrink = (pick["ms"] > max_ms) & (pick["hi"] > at)
        hi = F.when(shrink, pick["hi"] - 1).otherwise(pick["hi"])
        # Drop an awkward head and an unfinished tail, never past the anchor.
        head = F.filter(F.sequence(pick["lo"], at), lambda i: (i == at) | ~F.get(near, i)["awk"])
        tail = F.filter(F.sequence(at, hi), lambda i: (i == at) | ~F.get(near, i)["inc"])
        ends = F.when(ms(pick["lo"], hi).between(min_ms, max_ms), F.struct(
            F.array_min(head).alias("l"), F.array_max(tail).alias("h")))

        def row(e: Column) -> Column:
            keep = e.isNotNull() & (ms(e["l"], e["h"]) >= min_ms)
            return F.struct(
                goal["target_ord"].alias("target_ord"), goal["target_ms"].alias("target_ms"),
                F.when(keep, F.get(near, e["l"])["idx"]).otherwise(none).alias("lo"),
                F.get(near, e["h"])["idx"].alias("hi"),
                F.get(near, e["l"])["start_ms"].alias("start_ms"),
                F.get(near, e["h"])["end_ms"].alias("end_ms"),
            )

        return bind(ends, row)

    def per_goal(at: Column, states: Column) -> Column:
        options = F.array(*[
            F.struct(F.lit(i).alias("target_ord"), F.lit(t).alias("target_ms")) for i, t in goals])

        def one(goal: Column) -> Column:
            first = F.get(F.filter(states, lambda p: p["ms"] >= goal["target_ms"]), F.lit(0))
            return bind(F.coalesce(first, F.element_at(states, -1)), lambda pick: cut(at, pick, goal))

        return F.transform(options, one)

    # "at" is the anchor's place in its block, from 0.
    return bind(
        (anchor - near[0]["idx"]).cast("int"),
        lambda at: bind(path(at), lambda states: per_goal(at, states)),
    )


def distinct_windows(windows: DataFrame, key: str = "transcript_id") -> DataFrame:
    """Keep one window per (lo, hi): the first by seed rank, then target."""
    w = Window.partitionBy(key, "lo", "hi").orderBy("seed_rank", "target_ord")
    return windows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def attach_text(windows: DataFrame, sentences: DataFrame, key: str = "transcript_id") -> DataFrame:
    """Add the joined sentence text of [lo, hi], and its ``facts`` where sentences have them.

    Each tile ships its sentences once, however many windows it serves.
    """
    cols = ["idx", "text", *[c for c in sentences.columns if c == "facts"]]
    placed = windows.withColumn("tile", div(F.col("lo"), TILE))
    wanted = placed.select(key, "tile").distinct()
    widest = 2 * MARGIN
    texts = (
        spread_to_tiles(sentences.select(key, *cols), "idx", 0, widest)
        .join(wanted, [key, "tile"], "left_semi")
        .groupBy(key, "tile")
        .agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("line"))
    )
    base = F.col("line")[0]["idx"]
    part = F.slice("line", (F.col("lo") - base + 1).cast("int"), (F.col("hi") - F.col("lo") + 1).cast("int"))
    found = bind(part, lambda p: F.struct(
        tx.strip(F.array_join(F.transform(p, lambda x: x["text"]), " ")).alias("text"),
        *([tx.joined_facts(F.transform(p, lambda x: x["facts"])).alias("facts")] if "facts" in cols else [])))
    out = placed.join(texts, [key, "tile"]).withColumn("_found", found)
    return out.select(*windows.columns, *[F.col("_found")[c].alias(c) for c in cols[1:]])


def seed_details(windows: DataFrame, seeds: DataFrame, key: str = "transcript_id") -> DataFrame:
    """Carry the reason and the flags of the seed that anchors each window."""
    carried = seeds.select(key, F.col("idx").alias("anchor"), F.col("reason").alias("seed_reason"), *FLAGS)
    return windows.join(carried, [key, "anchor"])


def fallback_windows(
    sentences: DataFrame, windows: DataFrame, key: str = "transcript_id",
    target_ms: int = EVEN_TARGET_MS, min_ms: int = MIN_CLIP_MS, fold_limit: int = FOLD_LIMIT,
) -> DataFrame:
    """Even chunks (lo, hi, start_ms, end_ms) for the keys that have no window.

    A chunk closes at the first sentence that makes it ``target_ms`` long; chunks under
    ``min_ms`` are left out. Keys of up to ``fold_limit`` sentences fold one array each;
    longer ones follow jump pointers in parallel.
    """
    facts = sentences.select(key, "idx", "start_ms", "end_ms").join(
        windows.select(key).distinct(), key, "left_anti"
    )
    sizes = facts.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    large = stable(sizes.where(F.col("_n") > fold_limit))
    if large.isEmpty():
        found = _chunks_by_fold(facts, key, target_ms)
    else:
        found = _chunks_by_fold(facts.join(large, key, "left_anti"), key, target_ms).unionByName(
            _chunks_by_jumps(stable(facts.join(large, key, "left_semi")), large, key, target_ms)
        )
    return found.where(F.col("end_ms") - F.col("start_ms") >= min_ms)


def _chunks_by_fold(facts: DataFrame, key: str, target_ms: int) -> DataFrame:
    line = F.sort_array(F.collect_list(F.struct("idx", "start_ms", "end_ms")))
    chunk = "struct<lo:bigint,hi:bigint,start_ms:bigint,end_ms:bigint>"
    lines = facts.groupBy(key).agg(line.alias("line"))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        fresh = F.struct(
            x["idx"].alias("lo"), x["idx"].alias("hi"), x["start_ms"], x["end_ms"]
        ).cast(chunk)
        longer = F.struct(
            last["lo"].alias("lo"), x["idx"].alias("hi"), last["start_ms"].alias("start_ms"), x["end_ms"]
        ).cast(chunk)
        full = last["end_ms"] - last["start_ms"] >= target_ms
        return F.when((F.size(acc) == 0) | full, F.concat(acc, F.array(fresh))).otherwise(
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))
        )

    empty = F.array().cast(f"array<{chunk}>")
    return lines.select(key, F.explode_outer(F.aggregate("line", empty, step)).alias("c")).select(key, "c.*")


def _chunks_by_jumps(facts: DataFrame, sizes: DataFrame, key: str, target_ms: int) -> DataFrame:
    """The chunk that starts at i ends at the first later sentence whose end reaches
    start(i) + target. Find that end for all i at once, then keep the starts that are
    reachable from the first sentence by pointer doubling."""
    # First index at which the running maximum of the ends reaches a time.
    tiled = facts.withColumn("_tile", div(F.col("idx"), TILE))
    tiled = chunk_carry(
        tiled, [key], "_tile", {"_top": F.max("end_ms")},
        lambda s, w: s.withColumn("_top0", F.max("_top").over(before(w))), ["_top0"],
    )
    earlier = Window.partitionBy(key, "_tile").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    tallest = F.greatest(F.max("end_ms").over(earlier), F.col("_top0"))
    records = tiled.withColumn("_tallest", tallest).where(
        F.col("_tallest").isNull() | (F.col("end_ms") > F.col("_tallest"))
    ).select(key, "idx", F.col("end_ms").alias("_at"))
    asks = facts.withColumn("_goal", F.col("start_ms") + target_ms)
    met = around(asks, records, key, "_goal", "_at", F.struct("idx"), target_ms)
    last = sizes.select(key, (F.col("_n") - 1).alias("_last"))
    hop = met.join(last, key).select(
        key, F.col("idx").alias("i"), "_goal", "_last", F.col("next.v.idx").alias("_hit")
    )
    hop = stable(hop.withColumn("hi", F.coalesce("_hit", "_last")))
    # Overlapping rows: the hit may lie before i; then look forward tile by tile.
    stuck = stable(hop.where("hi < i").select(key, "i", "_goal", "_last", div(F.col("i"), TILE).alias("_tile")))
    solved = hop.where("hi >= i").select(key, "i", "hi")
    ends = facts.select(key, F.col("idx").alias("_k"), "end_ms", div(F.col("idx"), TILE).alias("_tile"))
    while not stuck.isEmpty():
        seen = stuck.join(ends, [key, "_tile"], "left").groupBy(key, "i", "_goal", "_last", "_tile").agg(
            F.min(F.when((F.col("_k") >= F.col("i")) & (F.col("end_ms") >= F.col("_goal")), F.col("_k"))).alias("_hit")
        )
        seen = stable(seen.withColumn(
            "hi", F.when(F.col("_hit").isNotNull(), F.col("_hit"))
            .when((F.col("_tile") + 1) * TILE > F.col("_last"), F.col("_last"))
        ))
        solved = solved.unionByName(seen.where("hi is not null").select(key, "i", "hi"))
        stuck = stable(seen.where("hi is null").select(
            key, "i", "_goal", "_last", (F.col("_tile") + 1).alias("_tile")))
    jump = stable(solved.select(key, "i", (F.col("hi") + 1).alias("j")))
    ends_of = jump
    reached = stable(sizes.select(key, F.lit(0).cast("bigint").alias("i")))
    fresh = reached
    while not fresh.isEmpty():
        # reached covers 2^k starts after k rounds
        step = reached.join(jump, [key, "i"]).select(key, F.col("j").alias("i"))
        fresh = stable(step.join(reached, [key, "i"], "left_anti").distinct())
        reached = stable(reached.unionByName(fresh))
        ahead = jump.select(key, F.col("i").alias("j"), F.col("j").alias("j2"))
        jump = stable(jump.join(ahead, [key, "j"]).select(key, "i", F.col("j2").alias("j")))
    starts = reached.join(ends_of, [key, "i"]).select(
        key, F.col("i").alias("lo"), (F.col("j") - 1).alias("hi")
    )
    first = facts.select(key, F.col("idx").alias("lo"), "start_ms")
    final = facts.select(key, F.col("idx").alias("hi"), "end_ms")
    return starts.join(first, [key, "lo"]).join(final, [key, "hi"]).select(key, "lo", "hi", "start_ms", "end_ms")


def attach_long_text(windows: DataFrame, sentences: DataFrame, key: str = "transcript_id") -> DataFrame:
    """``attach_text`` for windows of any number of sentences."""
    placed = windows.withColumn("tile", F.explode(F.sequence(div(F.col("lo"), TILE), div(F.col("hi"), TILE))))
    text = sentences.select(key, "idx", "text", div(F.col("idx"), TILE).alias("tile"))
    joined = (
        placed.select(key, "tile", "lo", "hi").join(text, [key, "tile"])
        .where(F.col("idx").between(F.col("lo"), F.col("hi")))
        .groupBy(key, "lo", "hi").agg(F.sort_array(F.collect_list(F.struct("idx", "text"))).alias("_line"))
    )
    whole = F.array_join(F.transform("_line", lambda x: x["text"]), " ")
    return windows.join(joined.select(key, "lo", "hi", whole.alias("text")), [key, "lo", "hi"])
