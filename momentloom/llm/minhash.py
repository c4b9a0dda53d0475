"""Near-duplicate documents by circulant MinHash.

One permutation scatters a shingle over a circle of 2**32 places; a second one orders the circle.
Coordinate ``k`` of the signature uses the second permutation shifted by ``k`` places, so two
permutations give all coordinates. Four coordinates make a band. Documents that share a band are
candidates, and every link is confirmed on the full shingle sets.

Equal sets are one class from the start. In each bucket of a band all members are compared with one
*hub*: the member whose bands lie in the largest buckets, which is what the other members were
derived from if there is such a document. Only members of a bucket that are then still in different
components are compared with each other, on 256-byte sketches in blocks, and pairs whose sketches
come near the threshold are confirmed on full sets. So a group of copies costs one comparison per
copy, and nothing is left out: with 32 bands of 4, a pair at the threshold of 0.75 shares no band
with probability 5e-6, and its sketches fall below 0.67 with probability 0.002.

Cases: a null or blank text has an empty set and is linked with nothing. Rows with the same id are
one document. A row without an id takes part like others but its id is never chosen if the group
has another. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentloom.llm import shingles
from momentloom.llm.bytescan import mix64
from momentloom.llm.components import components
from momentloom.llm.shared import ship, stable

BANDS, ROWS, COORDINATES = 32, 4, 256
BLOCK = 256
SKETCH_FLOOR = 0.67
NO_ID = (1 << 63) - 1  # rows without an id get numbers just below
NO_ID_SPAN = 1 << 48
_M1, _M2 = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
_SHIFT = np.arange(COORDINATES, dtype=np.uint32)
_BAND = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
_CHUNK = 2048


def _order(x: np.ndarray) -> np.ndarray:
    """The second permutation: a bijection on 32 bits, in place."""
    x ^= x >> np.uint32(16)
    x *= _M1
    x ^= x >> np.uint32(13)
    x *= _M2
    x ^= x >> np.uint32(16)
    return x


def signature(hashes: np.ndarray) -> np.ndarray:
    """All coordinates of a non-empty set of 64-bit hashes."""
    place = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(COORDINATES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(place), _CHUNK):
        np.minimum(best, _order(place[at : at + _CHUNK, None] + _SHIFT).min(axis=0), out=best)
    return best


def bands(sign: np.ndarray) -> np.ndarray:
    """One 64-bit bucket number per band; the band's number is part of it."""
    rows = sign[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    key = _BAND.copy()
    for j in range(ROWS):
        key = mix64(key ^ rows[:, j])
    return key.view(np.int64)


def set_key(hashes: np.ndarray) -> bytes:
    """128 bits that stand for the whole set."""
    a = mix64(hashes).sum(dtype=np.uint64)
    b = mix64(hashes ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return np.array([a, b], dtype=np.uint64).tobytes()


def _node(doc_id: int | None, key: bytes) -> int:
    if doc_id is not None:
        return doc_id
    return NO_ID - int.from_bytes(key[:6], "little") % NO_ID_SPAN


SIGNED = "doc_id long, node long, n_shingles long, set_key binary, bands array<long>, sketch binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        out: dict[str, list] = {n: [] for n in ("node", "n", "key", "bands", "sketch")}
        for doc_id, hashes in zip(ids, shingles.row_sets(batch.column(1)), strict=True):
            key = set_key(hashes) if len(hashes) else b""
            sign = signature(hashes) if len(hashes) else None
            out["node"].append(_node(doc_id, key))
            out["n"].append(len(hashes))
            out["key"].append(key or None)
            out["bands"].append(None if sign is None else bands(sign))
            out["sketch"].append(None if sign is None else sign.astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(out["node"], pa.int64()), pa.array(out["n"], pa.int64()),
             pa.array(out["key"], pa.binary()), pa.array(out["bands"], pa.list_(pa.int64())),
             pa.array(out["sketch"], pa.binary())],
            names=["doc_id", "node", "n_shingles", "set_key", "bands", "sketch"])


def signatures(docs: DataFrame) -> DataFrame:
    """Set size, set key, band buckets and sketch of every document."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_sign, SIGNED)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, nodes, sets = batch.column(0).to_pylist(), [], []
        for doc_id, hashes in zip(ids, shingles.row_sets(batch.column(1)), strict=True):
            nodes.append(_node(doc_id, set_key(hashes)))
            sets.append(hashes.tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "hashes"])


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, hashes)``: the full shingle sets of some nodes."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    wanted = nodes.select(F.col("node").alias("doc_id"))
    found = rows.join(wanted, "doc_id", "left_semi").unionByName(rows.where("doc_id is null"))
    return found.mapInArrow(_sets, "node long, hashes binary").dropDuplicates(["node"])


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, sa, sb = (batch.column(i).to_pylist() for i in range(4))
            keep = []
            for x, y in zip(sa, sb, strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = shingles.overlap(x, y)
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets reach the similarity."""
    side = lambda k: sets.select(F.col("node").alias(k), F.col("hashes").alias(f"s_{k}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "s_a", "s_b")
    return met.mapInArrow(_linked(percent), "a long, b long")


def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _hub_pairs(members: DataFrame, percent: int) -> DataFrame:
    score = members.groupBy("node").agg(F.sum("size").alias("score"))
    hubs = members.join(score, "node").groupBy("bucket").agg(
        F.max(F.struct("score", (-F.col("node")).alias("minus"), "n")).alias("hub"))
    met = members.join(hubs, "bucket").select("node", "n", (-F.col("hub.minus")).alias("hub"), F.col("hub.n").alias("hub_n"))
    met = met.where((F.col("node") != F.col("hub")) & (100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")))
    return met.select(*_ordered(F.col("node"), F.col("hub"))).distinct()


def _near_sketches(percent: int):
    """Pairs of different components inside one block pair whose sketches come near the threshold."""
    def pairs(part: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        left = np.flatnonzero(part["side"] != 2)   # 0: both sides (a block with itself), 1: first, 2: second
        right = np.flatnonzero(part["side"] != 1)
        own = part["side"][0] == 0
        a_out, b_out = [], []
        for i in left:
            other = right[right > i] if own else right
            other = other[part["root"][other] != part["root"][i]]
            n, m = part["n"][other], part["n"][i]
            other = other[100 * np.minimum(n, m) >= percent * np.maximum(n, m)]
            if len(other):
                same = (part["sketch"][other] == part["sketch"][i]).mean(axis=1)
                other = other[(same - 1 / 256) / (255 / 256) >= SKETCH_FLOOR]
                # A pair that meets in several buckets is reported in the first one only.
                shared = part["bands"][i][(part["bands"][other] == part["bands"][i]).argmax(axis=1)]
                other = other[shared == part["bucket"][i]]
                a_out.append(np.full(len(other), part["node"][i]))
                b_out.append(part["node"][other])
        if not a_out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(a_out), np.concatenate(b_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for table, last in _whole_groups(batches):
            rest = table if rest is None else pa.concat_tables([rest, table])
            keys = np.stack([rest[c].to_numpy() for c in ("bucket", "i", "j")])
            cut = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            edges = np.concatenate([[0], cut, [len(rest)] if last and len(rest) else []]).astype(int)
            columns = {c: rest[c].to_numpy() for c in ("bucket", "node", "root", "n", "side")}
            columns["bands"] = rest["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
            sketch = np.frombuffer(b"".join(rest["sketch"].to_pylist()), dtype=np.uint8).reshape(-1, COORDINATES)
            found_a, found_b = [], []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                part = {c: v[lo:hi] for c, v in columns.items()} | {"sketch": sketch[lo:hi]}
                a, b = pairs(part)
                found_a.append(np.minimum(a, b))
                found_b.append(np.maximum(a, b))
            rest = rest.slice(int(edges[-1]))
            if found_a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(found_a), pa.int64()), pa.array(np.concatenate(found_b), pa.int64())], names=["a", "b"])

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bool]]:
    """Batches as tables, each with whether it is the last."""
    held = None
    for batch in batches:
        if batch.num_rows:
            if held is not None:
                yield held, False
            held = pa.Table.from_batches([batch])
    if held is not None:
        yield held, True


def _open_pairs(members: DataFrame, sketches: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs in buckets whose members are still in different components."""
    placed = members.join(roots, "node", "left").select(
        "bucket", "node", "n", "size", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi")
    rows = placed.join(mixed.select("bucket"), "bucket").join(sketches, "node")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    rows = rows.select("*", other.alias("other")).select(
        "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
        "node", "root", "n", "sketch", "bands")
    dealt = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side", "node")
    return dealt.mapInArrow(_near_sketches(percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs(doc_id, text)``.

    Sets of distinct five-word shingles are linked when ``100 * |A & B| >= percent * |A | B|``;
    ``component_id`` is the smallest id that links reach.
    """
    signed = stable(signatures(ship(docs)))
    # One row per distinct set, with the smallest id; equal sets have equal signatures.
    classes = stable(signed.where("n_shingles > 0").groupBy("set_key").agg(
        F.min("node").alias("node"), F.first("n_shingles").alias("n"),
        F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    entries = classes.select("node", "n", F.explode("bands").alias("bucket"))
    sizes = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stable(entries.join(sizes, "bucket"))
    sets = stable(full_sets(docs, members.select("node").distinct()))
    links = stable(confirm(_hub_pairs(members, percent), sets, percent))
    roots = stable(components(links))
    more = confirm(stable(_open_pairs(members, classes.select("node", "sketch", "bands"), roots, percent)), sets, percent)
    final = stable(components(links.unionByName(more)))
    named = classes.select("set_key", "node").join(final, "node", "left").select(
        "set_key", F.coalesce("root", "node").alias("root"))
    rows = signed.select("doc_id", "node", "n_shingles", "set_key").join(named, "set_key", "left")
    root = F.coalesce("root", "node")
    component = F.when(root <= NO_ID - NO_ID_SPAN, root)
    return rows.select("doc_id", "n_shingles", component.alias("component_id"),
                       F.col("doc_id").eqNullSafe(component).alias("kept"))
