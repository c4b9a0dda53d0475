"""Exact top-k search by inner product with MaxScore over sharded postings.

A component is a term and its integer value the impact. Vectors are numbered and cut into shards of
``SHARD_ROWS``; a shard's file holds for every term the impacts of all rows, their bounds, and
the heads of the list in impact order from both ends. Queries are cut into blocks. A tile is one block against
``TILE_SHARDS`` shards, one after the other, so that thresholds grow along the tile; its best rows are
merged over all tiles by a ranking that Spark limits before it shuffles.

Per query and shard: the rows at the head of its strongest term give a first threshold. Terms whose
upper bounds together stay below it are not essential. The essential postings are traversed for the
whole block at once, as one matrix product in which the other terms weigh nothing. Rows that can
still compete are probed in the other terms, strongest first, and dropped as soon as what they have
and the bounds of what is left fall below the threshold. A row at the threshold is never dropped, so
ties are complete and the result is exact.

Cases: vectors that are null or hold a null or non-finite component take no part. A shorter vector
has zeros at its end. Rows without an id are candidates after all others of the same score; rows with the same id are
different rows, and only the query's own row is left out. An empty table gives no rows. Other
columns are ignored. A score must fit 64 bits, else the search ends with an error.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momentloom.llm import files
from momentloom.llm.shared import folder, ship, stable
from momentloom.plans.ordered import chunk_carry, sum_before

K = 20
SCALE = 64.0
SHARD_ROWS = 16_384
BLOCK_ROWS = 256
TILE_SHARDS = 8
HEAD = 64
PROBES = 4


def quantised(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """``(vec_id, q)``: whole-number components of the vectors that take part."""
    usable = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("_v"))
    return rows.where(F.col("_v").isNotNull() & usable).select(
        "vec_id", F.transform("_v", lambda x: F.floor(F.lit(scale) * x)).alias("q"))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with a dense ``number`` from 0; one summary row per partition is ordered."""
    pinned = stable(rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    counted = chunk_carry(
        pinned, [], "_part", {"_n": F.count(F.lit(1)), "_low": F.min("_at")},
        lambda s, w: s.withColumn("_base", sum_before("_n", w)), ["_base", "_low"])
    return counted.withColumn("number", F.col("_base") + F.col("_at") - F.col("_low")).drop("_part", "_at", "_base", "_low")


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of equal width, shorter ones filled with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), int(lengths.max(initial=0))), dtype=np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _packed(values: np.ndarray) -> np.ndarray:
    """In the smallest type that holds them."""
    low, high = int(values.min(initial=0)), int(values.max(initial=0))
    return values.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _write(path: str, kind: str):
    """One file per group of rows that comes sorted by (group, number)."""
    def write(group: int, rows: pa.Table) -> dict:
        values = _matrix(rows["q"])
        ids = rows["vec_id"]
        facts = {"ids": ids.fill_null(0).to_numpy(), "known": ids.is_valid().to_numpy(), "number": rows["number"].to_numpy()}
        by_term = np.ascontiguousarray(_packed(values).T)
        if kind == "shard":
            order = np.argsort(by_term, axis=1, kind="stable")
            facts |= {"low": order[:, :HEAD], "high": order[:, ::-1][:, :HEAD]}
        out = io.BytesIO()
        np.savez(out, terms=by_term, **facts)
        files.write_bytes(path, f"{kind}-{group}.npz", out.getvalue())
        return {"grp": group, "n": len(rows)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, done = [], None, []
        for batch in batches:
            groups = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1), len(groups)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi == lo:
                    continue
                if held and groups[lo] != group:
                    done.append(write(group, pa.Table.from_batches(held)))
                    held = []
                group = int(groups[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            done.append(write(group, pa.Table.from_batches(held)))
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("grp", pa.int64()), ("n", pa.int64())]))

    return run


def _store(rows: DataFrame, path: str, kind: str, size: int) -> int:
    """Write the groups of ``size`` rows; how many there are."""
    rows = numbered(rows) if "number" not in rows.columns else rows
    place = F.floor(F.col("place" if "place" in rows.columns else "number") / size)
    dealt = rows.select(place.cast("long").alias("grp"), "number", "vec_id", "q").repartition("grp").sortWithinPartitions("grp", "number")
    made = stable(dealt.mapInArrow(_write(path, kind), "grp long, n long"))
    return made.count()


class _Best:
    """The ``k`` best rows of one query so far."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.known, self.ids = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def threshold(self) -> float:
        return float(self.score[-1]) if len(self.score) == self.k else -np.inf

    def add(self, score: np.ndarray, known: np.ndarray, ids: np.ndarray) -> None:
        if len(score) > self.k:  # ties with the k-th stay until they are ordered
            at = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, known, ids = score[at], known[at], ids[at]
        score, known, ids = (np.concatenate(x) for x in ((self.score, score), (self.known, known), (self.ids, ids)))
        order = np.lexsort((ids, ~known, -score))[: self.k]
        self.score, self.known, self.ids = score[order], known[order], ids[order]


def _exact_type(a: np.ndarray, b: np.ndarray) -> type:
    """A type in which all partial sums of inner products are exact."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[0])
    if most < 1 << 24:
        return np.float32
    if most < 1 << 53:
        return np.float64
    if most < 1 << 62:
        return np.int64
    raise ValueError("an inner product does not fit 64 bits")


def search(queries: dict, shard: dict, best: list[_Best]) -> int:
    """Add to each query's ``best`` what the shard holds; returns how many rows were probed."""
    width = max(len(queries["terms"]), len(shard["terms"]))
    grown = [np.pad(x["terms"].astype(np.int64), ((0, width - len(x["terms"])), (0, 0))) for x in (queries, shard)]
    kind = _exact_type(*grown)
    weight, impact = grown[0].T.astype(kind), grown[1].astype(kind)
    top, bottom = impact.max(axis=1, initial=0), impact.min(axis=1, initial=0)
    bound = np.where(weight > 0, weight * top, weight * bottom)
    n, probed = impact.shape[1], 0
    own = queries["number"] - shard["number"][0]
    floor = np.array([b.threshold() for b in best])
    # A first threshold from the head of the strongest term, where no shard gave one.
    for i in np.flatnonzero(floor == -np.inf) if n and len(shard["terms"]) else ():
        term = int(np.argmax(bound[i, : len(shard["terms"])]))
        head = shard["high" if weight[i, term] > 0 else "low"][term]
        head = head[head != own[i]]
        if len(head) >= best[i].k:
            floor[i] = np.partition(weight[i] @ impact[:, head], len(head) - best[i].k)[len(head) - best[i].k]
    order = np.argsort(bound, axis=1, kind="stable")
    sums = np.cumsum(np.take_along_axis(bound, order, axis=1), axis=1)
    n_rest = (sums < floor[:, None]).sum(axis=1)
    essential = np.ones(weight.shape, dtype=bool)
    for i, m in enumerate(n_rest):
        essential[i, order[i, :m]] = False
    partial = np.where(essential, weight, kind(0)) @ impact
    for i, keep in enumerate(best):
        rest = sums[i, n_rest[i] - 1] if n_rest[i] else kind(0)
        at = np.flatnonzero(partial[i] >= floor[i] - rest)
        at = at[at != own[i]]
        score = partial[i, at]
        probed += len(at)
        left = order[i, : n_rest[i]][::-1]
        for p in range(0, len(left), PROBES):
            terms = left[p : p + PROBES]
            score = score + weight[i, terms] @ impact[np.ix_(terms, at)]
            rest = rest - bound[i, terms].sum()
            live = score >= floor[i] - rest
            at, score = at[live], score[live]
        keep.add(score.astype(np.int64), shard["known"][at], shard["ids"][at])
    return probed


def _tiles(path: str, n_shards: int, n_groups: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def load(name: str) -> dict:
            with np.load(io.BytesIO(files.read_bytes(path, name))) as held:
                return dict(held)

        for batch in batches:
            for tile in batch.column(0).to_pylist():
                block, group = divmod(tile, n_groups)
                queries = load(f"block-{block}.npz")
                best = [_Best(k) for _ in queries["ids"]]
                for s in range(group * TILE_SHARDS, min(n_shards, (group + 1) * TILE_SHARDS)):
                    search(queries, load(f"shard-{s}.npz"), best)
                sizes = [len(b.score) for b in best]
                known = np.concatenate([b.known for b in best])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(queries["number"], sizes)), pa.array(np.repeat(queries["ids"], sizes)),
                     pa.array(np.concatenate([b.ids for b in best]), mask=~known), pa.array(np.concatenate([b.score for b in best]))],
                    names=["number", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: float = SCALE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of ``vectors(vec_id, embedding)`` with the
    highest inner products for every row that ``is_query``, a condition on ``vec_id``."""
    spark = ship(vectors).sparkSession
    path = folder(spark, "maxscore")
    rows = stable(numbered(quantised(vectors, scale)))
    asked = rows.where(F.col("vec_id").isNotNull() & is_query)
    places = numbered(asked.select(F.col("number").alias("row"))).withColumnRenamed("number", "place")
    asked = asked.join(places.withColumnRenamed("row", "number"), "number")
    n_shards = _store(rows, path, "shard", SHARD_ROWS)
    n_blocks = _store(asked, path, "block", BLOCK_ROWS)
    n_groups = -(-n_shards // TILE_SHARDS)
    tiles = spark.range(0, n_blocks * n_groups, 1, max(1, min(n_blocks * n_groups, 100_000)))
    found = tiles.mapInArrow(_tiles(path, n_shards, n_groups, k), "number long, query_id long, vec_id long, score long")
    w = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
