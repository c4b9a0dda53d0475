"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight and a *tilt*: its weight at training time ``u`` (0 to 1) is
``weight * (1 + tilt * (2u - 1))``, so a tilt of 0.5 rises from half to one and a half times the
weight, and the mean over the run is the weight itself. Integrating the schedule gives the source's
share of the run; shares above ``cap`` times the source's words stop there and the excess goes to the
others by weight.

Inside a source, documents stand in the order of the MD5 of their id, and the source is read round
and round: whole passes, then one that ends, inside a document if need be, where the target is
reached. The word at which an occurrence of a document starts, counted over all passes and divided by
the target, is the demand met so far; inverting the integrated schedule gives its training time, and
occurrences are range-sorted by it.

Cases: a null text has no words, is taken 0 words and has no position. A document that is not taken
has one row in the order, the last, without a pass. A null source is a source,
the last in order. Rows with the same id are one after the other and each counts. Sources without
words have the target 0. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momentloom.llm.shared import stable

WEIGHTS = (3.0, 1.0, 2.0)
TILTS = (0.5, -0.5, 0.0)
SHARE, CAP = 1.5, 2.0
TICKS = 1_000_000


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _cycle(values: Sequence[float], rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.pmod(rank, F.lit(len(values))).cast("int") + 1)


def targets(sources: DataFrame, weights: Sequence[float], tilts: Sequence[float],
            share: float, cap: float) -> DataFrame:
    """``(source, source_size, target, tilt)`` from ``(source, source_size)``, one row per source.

    Sources in the order of ``cap * size / weight`` stop one after the other; the rest share what is
    left by weight. That is where sharing the excess again and again ends.
    """
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumns({"weight": _cycle(weights, F.col("rank")), "tilt": _cycle(tilts, F.col("rank")),
                                 "limit": cap * F.col("source_size")})
    w = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    before, whole = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = share * F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    rest = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # The level if this source and all later ones share; the first source below its limit sets it.
    level = ranked.withColumn("level", left / rest)
    open_ = F.when(F.col("level") * F.col("weight") < F.col("limit"), F.col("level"))
    final = F.first(open_, ignorenulls=True).over(whole)
    level = level.withColumn("final", final)
    share_of = F.when(F.col("final").isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("final") * F.col("weight")))
    return level.select("source", "source_size", share_of.alias("target"), "tilt")


def training_time(demand: Column, tilt: Column) -> Column:
    """The time at which the integrated schedule ``(1 - tilt) u + tilt u^2`` reaches ``demand``."""
    flat = F.lit(1.0) - tilt
    return F.when(tilt == 0, demand).otherwise((F.sqrt(flat * flat + 4.0 * tilt * demand) - flat) / (2.0 * tilt))


def _occurrences(docs: DataFrame, weights: Sequence[float], tilts: Sequence[float], share: float, cap: float) -> DataFrame:
    """Every occurrence of every document in the mix, in no order; ``pass`` counts from 0."""
    sized = stable(docs.select(F.col("doc_id").cast("long"), "source", word_count(F.col("text")).alias("size"))
                   .withColumn("hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))))
    slot = F.substring("hash", 1, 4)
    # A source is cut into 65,536 slots of its order, so no source is one task's work.
    slots = sized.groupBy("source", slot.alias("slot")).agg(F.sum("size").alias("slot_size"))
    along = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("slot_start", F.coalesce(F.sum("slot_size").over(along), F.lit(0)))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(sources, weights, tilts, share, cap)
    plan = stable(slots.alias("s").join(goals.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source")))
                  .select("s.source", "slot", "slot_start", "source_size", "target", "tilt"))
    docs_ = sized.withColumn("slot", slot)
    same = docs_["source"].eqNullSafe(plan["source"]) & (docs_["slot"] == plan["slot"])
    inside = Window.partitionBy("source", "slot").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs_.join(plan, same).select(
        "doc_id", docs_["source"], "size", "hash", docs_["slot"], "slot_start", "source_size", "target", "tilt")
    placed = placed.withColumn("start", F.col("slot_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    words = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(F.try_divide(words, F.col("source_size")))).otherwise(0).cast("long")
    rest = words - whole * F.col("source_size")
    part = F.least(F.greatest(rest - F.col("start"), F.lit(0)), F.col("size"))
    taken = whole * F.col("size") + part
    passes = F.when(F.col("size") > 0, whole + F.when(part > 0, 1).otherwise(0)).otherwise(0).cast("long")
    told = placed.select("doc_id", "source", "size", "source_size", "target", "tilt", "start", taken.alias("taken"),
                         passes.alias("passes"), whole.alias("whole"), part.cast("long").alias("part"))
    turns = F.when(F.col("passes") > 0, F.sequence(F.lit(0).cast("long"), F.col("passes") - 1))
    each = told.select("*", F.explode_outer(turns).alias("pass"))
    demand = F.try_divide((F.col("start") + F.col("pass") * F.col("source_size")).cast("double"), F.col("target"))
    position = F.when(F.col("taken") > 0, F.floor(training_time(demand, F.col("tilt")) * TICKS).cast("long"))
    words_ = F.when(F.col("pass").isNull(), 0).when(F.col("pass") < F.col("whole"), F.col("size")).otherwise(F.col("part")).cast("long")
    return each.select("doc_id", "source", "size", "source_size", "target", "taken", "passes", "pass",
                       words_.alias("words"), position.alias("position"))


def order(docs: DataFrame, weights: Sequence[float] = WEIGHTS, tilts: Sequence[float] = TILTS,
          share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The training order: one row per occurrence of a document of ``docs(doc_id, text, source)`` with
    ``doc_id, source, size, source_size, target, taken, passes, pass, words, position``.

    ``words`` is how many of its words this pass takes, from the first on, ``position`` the training
    time at which it starts, in millionths of the run. ``taken`` and ``passes`` count all occurrences
    of the document. The rows are range-sorted by position.
    """
    keys = F.col("position").asc_nulls_last(), F.col("doc_id"), F.col("pass")
    return _occurrences(docs, weights, tilts, share, cap).repartitionByRange(*keys).sortWithinPartitions(*keys)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, tilts: Sequence[float] = TILTS,
        share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The digest of ``order``, one row per document: ``doc_id, source, size, source_size, target, taken,
    passes, position``, with the position of the first occurrence. The rows are range-sorted by it.
    """
    first = _occurrences(docs, weights, tilts, share, cap).where(F.coalesce("pass", F.lit(0)) == 0).drop("pass", "words")
    keys = F.col("position").asc_nulls_last(), F.col("doc_id")
    return first.repartitionByRange(*keys).sortWithinPartitions(*keys)
