"""Line deduplication with a sharded minimal perfect hash.

Lines are hashed twice to 64 bits. A key that occurs in at least two documents is *repeated*; its
document count and its smallest document come from one aggregation that combines in each task.
Repeated keys are cut into shards by their first hash. One task per shard builds a minimal perfect
hash over its keys and writes it with arrays of fingerprints (the second hash), counts and first
documents to the shared folder. Documents are then scanned once more and probe the arrays: per batch
a task visits each shard once, and keeps no more than ``CACHE_BYTES`` of shards in memory. No line
is joined and no text is shuffled.

Both hashes together are 128 bits, which stand for the line.

Cases: a null or empty text is one empty line. Rows without an id are together one document that
comes after all others. Rows with the same id are one document. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentloom.llm import bytescan, files
from momentloom.llm.perfecthash import PerfectHash
from momentloom.llm.shared import folder, ship, stable

MIN_POINTS = 10
SHARD_KEYS = 1 << 17
CACHE_BYTES = 128 << 20
NO_ID = (1 << 63) - 1


class _Lines:
    """The lines of a run of rows: their bytes, keys and rows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, min_points: int):
        self.data = data
        self.starts, self.ends, self.first = bytescan.lines(data, offsets)
        starts, ends = bytescan.strip(data, self.starts, self.ends)
        self.long = np.flatnonzero(bytescan.code_points(data, starts, ends) >= min_points)
        lower = bytescan.lower_ascii(data)
        self.h1 = bytescan.segment_hashes(lower, starts[self.long], ends[self.long], 0)
        self.h2 = bytescan.segment_hashes(lower, starts[self.long], ends[self.long], 1)
        counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(counts)), counts)


def _keys(min_points: int):
    """One row per distinct long key and document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for at, data, offsets in bytescan.slices(batch.column(1)):
                found = _Lines(data, offsets, min_points)
                row = found.row[found.long]
                order = np.lexsort((found.h2, found.h1, row))
                rec = np.stack([row[order].astype(np.uint64), found.h1[order], found.h2[order]])
                new = np.ones(rec.shape[1], dtype=bool)
                new[1:] = (rec[:, 1:] != rec[:, :-1]).any(axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rec[1, new].view(np.int64)), pa.array(rec[2, new].view(np.int64)),
                     pa.array(ids[at + rec[0, new].astype(np.int64)])], names=["h1", "h2", "doc"])

    return run


def repeated_keys(docs: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """``(h1, h2, n_docs, first_doc)`` of the long keys that at least two documents hold."""
    held = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_keys(min_points), "h1 long, h2 long, doc long")
    counted = held.groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("n_docs"), F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"))
    return counted.where("first_doc < last_doc").drop("last_doc")


def _shard(h1: np.ndarray, bits: int) -> np.ndarray:
    return (h1 >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h1), dtype=np.int64)


def _build(path: str):
    """Writes the shards whose rows come sorted by shard; a shard is bounded by its size."""
    def write(shard: int, rows: pa.Table) -> dict:
        h1 = rows["h1"].to_numpy().view(np.uint64)
        h2 = rows["h2"].to_numpy().view(np.uint64)
        # Different keys may share the first hash: they are one key here, and a list beside it.
        unique, at, times = np.unique(h1, return_index=True, return_counts=True)
        single = at[times == 1]
        table = PerfectHash.build(unique[times == 1])
        place = table.index(h1[single])
        facts = {n: np.zeros(len(single), dtype=t) for n, t in (("mark", np.uint64), ("docs", np.uint32), ("first", np.int64))}
        facts["mark"][place] = h2[single]
        facts["docs"][place] = np.minimum(rows["n_docs"].to_numpy()[single], 0xFFFFFFFF)
        facts["first"][place] = rows["first_doc"].to_numpy()[single]
        chained = np.isin(h1, unique[times > 1])
        facts |= {"more1": h1[chained], "more2": h2[chained], "more_first": rows["first_doc"].to_numpy()[chained]}
        name = f"shard-{shard:08d}.npz"
        data = table.dump(**facts)
        files.write_bytes(path, name, data)
        return {"shard": shard, "file": name, "n_keys": len(h1), "n_bytes": len(data)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        shard, done = None, []
        for batch in batches:
            ids = batch.column(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1, [len(ids)]]) if len(ids) else [0]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and ids[lo] != shard:
                    done.append(write(shard, pa.Table.from_batches(held)))
                    held = []
                shard = int(ids[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            done.append(write(shard, pa.Table.from_batches(held)))
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema(
                [("shard", pa.int64()), ("file", pa.string()), ("n_keys", pa.int64()), ("n_bytes", pa.int64())]))

    return run


class LineIndex:
    """Shards in the shared folder; ``bits`` of the first hash name the shard."""

    def __init__(self, path: str, bits: int, present: frozenset[int], min_points: int):
        self.path, self.bits, self.present, self.min_points = path, bits, present, min_points

    def __reduce__(self):
        return LineIndex, (self.path, self.bits, self.present, self.min_points)

    def _load(self, shard: int, cache: OrderedDict) -> tuple[PerfectHash, dict[str, np.ndarray]]:
        if shard in cache:
            cache.move_to_end(shard)
            return cache[shard][1]
        data = files.read_bytes(self.path, f"shard-{shard:08d}.npz")
        loaded = PerfectHash.load(data)
        cache[shard] = (3 * len(data), loaded)
        while len(cache) > 1 and sum(size for size, _ in cache.values()) > CACHE_BYTES:
            cache.popitem(last=False)
        return loaded

    def first_docs(self, h1: np.ndarray, h2: np.ndarray, cache: OrderedDict) -> np.ndarray:
        """The first document of each key, or -1 and False for a key that is not repeated."""
        first = np.zeros(len(h1), dtype=np.int64)
        known = np.zeros(len(h1), dtype=bool)
        shards = _shard(h1, self.bits)
        order = np.argsort(shards, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(shards[order])) + 1, [len(order)]]) if len(order) else [0]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            at = order[lo:hi]
            shard = int(shards[at[0]])
            if shard not in self.present:
                continue
            table, facts = self._load(shard, cache)
            if len(table):
                place = table.index(h1[at])
                hit = (place >= 0) & (facts["mark"][place] == h2[at])
                first[at[hit]] = facts["first"][place[hit]]
                known[at[hit]] = True
            for m1, m2, doc in zip(facts["more1"], facts["more2"], facts["more_first"], strict=True):
                hit = (h1[at] == m1) & (h2[at] == m2)
                first[at[hit]], known[at[hit]] = doc, True
        return np.where(known, first, np.int64(-1)), known


def build_index(docs: DataFrame, min_points: int = MIN_POINTS, shard_keys: int = SHARD_KEYS) -> LineIndex:
    """Aggregate the repeated keys and write their shards."""
    spark = docs.sparkSession
    keys = stable(repeated_keys(ship(docs), min_points))
    bits = max(0, (keys.count() // shard_keys).bit_length())
    path = folder(spark, "line-index")
    shard = F.shiftrightunsigned("h1", 64 - bits) if bits else F.lit(0).cast("long")
    rows = keys.select(shard.alias("shard"), "h1", "h2", "n_docs", "first_doc")
    dealt = rows.repartition("shard").sortWithinPartitions("shard", "h1", "h2")
    manifest = stable(dealt.mapInArrow(_build(path), "shard long, file string, n_keys long, n_bytes long"))
    present = frozenset(r[0] for r in manifest.select("shard").collect())  # at most 2 ** bits numbers
    return LineIndex(path, bits, present, min_points)


OUT = "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept_text string"


def _probe(index: LineIndex, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: OrderedDict = OrderedDict()
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for at, data, offsets in bytescan.slices(batch.column(1)):
                found = _Lines(data, offsets, index.min_points)
                first, known = index.first_docs(found.h1, found.h2, cache)
                own = ids[at + found.row[found.long]]
                gone = np.zeros(len(found.starts), dtype=bool)
                gone[found.long] = known & (first != own)
                rows = len(offsets) - 1
                dropped = np.bincount(found.row, weights=gone, minlength=rows).astype(np.int64)
                raw, digests, kept = data.tobytes(), [], []
                for r in range(rows):
                    body = raw[offsets[r] : offsets[r + 1]]
                    if dropped[r]:
                        mine = range(found.first[r], found.first[r + 1])
                        body = b"\n".join(raw[found.starts[k] : found.ends[k]] for k in mine if not gone[k])
                    digests.append(hashlib.sha256(body).hexdigest())
                    kept.append(body.decode() if with_text else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, rows), pa.array(np.diff(found.first), pa.int64()), pa.array(dropped),
                     pa.array(digests, pa.string()), pa.array(kept, pa.string())], names=[c.split()[0] for c in OUT.split(", ")])

    return run


def deduplicate_lines(docs: DataFrame, min_points: int = MIN_POINTS, shard_keys: int = SHARD_KEYS,
                      with_text: bool = True) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_sha256, kept_text)`` for every row of ``docs(doc_id, text)``.

    A line's key is the line without white space at both ends and with A-Z lower-cased. Keys of at
    least ``min_points`` code points that several documents hold stay only in the smallest document.
    """
    index = build_index(docs, min_points, shard_keys)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_probe(index, with_text), OUT)
