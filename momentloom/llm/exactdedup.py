"""Exact deduplication over an extendible-hash index on shared files, in DataFrame operations only.

1. *Insert.* Documents are keyed by a 64-bit hash of their normalised text. Grouping by key and
   whole text compares bytes; copies collapse in each task before anything is shuffled, so a text
   that a third of all rows share is one row per task. Entries keep no text.
2. *Directory.* Buckets are prefixes of the key. A bucket with more keys than it may hold splits:
   the directory doubles, and only overfull buckets move to the next bit. Counts per prefix are all
   that is looked at. Equal keys never split; they chain.
3. *Owners.* Each bucket is a range of keys, owned by one task, which orders its entries, numbers
   the links of each chain and writes the bucket's files.
4. *Probe.* Every document finds its bucket entry by key. Where a chain has several links, the bytes
   of the text are compared with those of the document that each link stands for.

Cases: a null text counts as empty, and all empty texts are equal. Rows with the same id are one
document. The row that stays is the one with the smallest id; a row without an id stays only in a
group without ids. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momentloom.llm.shared import folder, stable

BUCKET_KEYS = 1 << 16
KEY_BITS = 64
# Runs that change when each becomes one space: a lone space stays as it is.
_RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUN, " ")


def _prefix(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, KEY_BITS - bits) if bits else F.lit(0).cast("long")


def directory(entries: DataFrame, bucket_keys: int = BUCKET_KEYS) -> tuple[DataFrame, int]:
    """``(slot, depth, bucket)`` for every slot of the directory that has keys, and the global depth.

    ``bucket`` is the slot's prefix at its local depth, written as text so that buckets of different
    depths cannot meet.
    """
    keys = entries.select("key").distinct()
    total = keys.count()
    # No bucket can be overfull once there are this many bits, unless keys are uneven.
    depth = max(0, (2 * total // bucket_keys).bit_length())
    while True:
        counts = stable(keys.groupBy(_prefix(F.col("key"), depth).alias("slot")).agg(F.count(F.lit(1)).alias("n")))
        if depth >= 40 or counts.where(F.col("n") > bucket_keys).isEmpty():
            break
        depth += 1
    # Local depth: the first doubling at which the slot's bucket is no longer overfull.
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth")
    seen = counts.select("slot", "n", levels)
    seen = seen.withColumn("at", F.expr(f"shiftrightunsigned(slot, {depth} - depth)"))
    sizes = seen.groupBy("depth", "at").agg(F.sum("n").alias("held"))
    fits = seen.join(sizes, ["depth", "at"]).where((F.col("held") <= bucket_keys) | (F.col("depth") == depth))
    local = fits.groupBy("slot").agg(F.min("depth").alias("depth"))
    at = F.expr(f"shiftrightunsigned(slot, {depth} - depth)")
    return local.select("slot", "depth", F.format_string("%02d-%x", "depth", at).alias("bucket")), depth


def build_index(docs: DataFrame, key: Callable[[Column], Column] = F.xxhash64, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """The index of ``docs(doc_id, text)`` as shared files, one folder per bucket:
    ``(bucket, key, link, links, keep_id, group_size, text_sha256)``."""
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long"), normalised(F.col("text")).alias("norm"))
    entries = stable(
        text.groupBy(key(F.col("norm")).alias("key"), "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("key", "keep_id", "group_size", F.sha2("norm", 256).alias("text_sha256"))
    )
    slots, depth = directory(entries, bucket_keys)
    placed = entries.withColumn("slot", _prefix(F.col("key"), depth)).join(slots.select("slot", "bucket"), "slot").drop("slot")
    chain = Window.partitionBy("bucket", "key")
    owned = placed.repartition("bucket").select(
        "bucket", "key", F.row_number().over(chain.orderBy("keep_id", "text_sha256")).cast("long").alias("link"),
        F.count(F.lit(1)).over(chain).alias("links"), "keep_id", "group_size", "text_sha256")
    path = folder(spark, "exact-index")
    owned.sortWithinPartitions("bucket", "key", "link").write.partitionBy("bucket").parquet(path)
    schema = "key long, link long, links long, keep_id long, group_size long, text_sha256 string, bucket string"
    return spark.read.schema(schema).parquet(path)


def probe(docs: DataFrame, index: DataFrame, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for every row of ``docs``."""
    text = docs.select(F.col("doc_id").cast("long"), normalised(F.col("text")).alias("norm"))
    out = [F.col("doc_id"), F.col("keep_id"), F.col("group_size"),
           F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("text_sha256")]
    keys = text.select("doc_id", key(F.col("norm")).alias("key"))
    alone = keys.join(index.where("links = 1").select("key", "keep_id", "group_size", "text_sha256"), "key").select(*out)
    chains = index.where("links > 1").select("key", "keep_id", "group_size", "text_sha256")
    if chains.isEmpty():
        return alone
    # Different texts under one key: compare the bytes with the text that each link stands for.
    hashed = text.withColumn("key", key(F.col("norm"))).join(chains.select("key").distinct(), "key", "left_semi")
    stands = hashed.select("key", F.col("doc_id").alias("keep_id"), F.col("norm").alias("link_norm"),
                           F.sha2("norm", 256).alias("text_sha256"))
    stands = stands.dropDuplicates(["key", "keep_id", "text_sha256"])
    same_id = (F.col("c.keep_id").eqNullSafe(F.col("s.keep_id")) & (F.col("c.key") == F.col("s.key"))
               & (F.col("c.text_sha256") == F.col("s.text_sha256")))
    links = chains.alias("c").join(stands.alias("s"), same_id).select("c.*", "link_norm")
    met = hashed.join(links, (hashed["key"] == links["key"]) & (hashed["norm"] == links["link_norm"]))
    return alone.unionByName(met.select(*out))


def exact_duplicates(docs: DataFrame, key: Callable[[Column], Column] = F.xxhash64,
                     bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """The keeper of every row of ``docs(doc_id, text)``; see the module."""
    return probe(docs, build_index(docs, key, bucket_keys), key)
