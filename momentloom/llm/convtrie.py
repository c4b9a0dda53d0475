"""Conversation prefix trie by fixed-length block hashing.

The turns of each conversation are cut into blocks of ``BLOCK`` turns. Conversations are grouped by
their successive block digests first: one aggregation over (conversation, block) rows, whose key is
the digest of everything up to the block's end. A group whose block has no sibling (no other block
follows the same prefix) has the same members at all of its turns. Only blocks where siblings
diverge are refined: the *distinct* blocks, not the conversations, are cut into their turns and
grouped again by turn prefix.

A prefix digest is the exclusive or of one 128-bit SHA-256 part per finished block, and of one for
the turns of the block in hand; each part covers its depth. So prefixes are running aggregates,
which are carried over chunks of blocks, and a conversation of any length needs no loop and no
array but the turns of one block.

Sums over subtrees need no walk down the tree. A node belongs to its smallest member, which then is
the smallest of every deeper node on its own path. With ``K(c)`` the words in those turns of ``c``
whose nodes belong to others, the words saved below node v of depth d with n members are
``sum of K over the members - K(smallest) - (n - 1) * words in the first d - 1 turns``. The childless
nodes of a subtree are the members that are the smallest of the childless node they end in.

The ids that end in a node are range-sorted by (node, id), joined to pieces of text where they lie,
and the pieces of a node are hashed in order, so a node where a third of all conversations end moves
a few long pieces.

Cases: turns of equal number go by the SHA-256 of role and text. A null turn is the first. A null role
or text is empty. Rows without a conversation id take no part. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momentloom.llm.shared import stable
from momentloom.plans.ordered import bind, chunk_carry, sum_before, with_position

BLOCK = 4
BLOCKS_PER_CHUNK = 4096
PIECE_IDS = 8192
WORD = r"[^\x20\x09-\x0D]+"


def _long(digest: Column, at: int) -> Column:
    """Sixteen hexadecimal digits as a signed 64-bit number."""
    return F.conv(F.substring(digest, at, 16), 16, -10).cast("long")


def _part(depth: Column, digest: Column, at: int) -> Column:
    return _long(F.sha2(F.concat_ws(":", depth.cast("string"), digest).cast("binary"), 256), at)


def turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, pos, dig, words)``: the turns in order, from 1, without their texts."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn").isNotNull().alias("_said"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("_turn"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256).alias("dig"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    placed = with_position(rows, ["conv_id"], ["_said", "_turn", "dig", "words"])
    return placed.select("conv_id", (F.col("pos") + 1).alias("pos"), "dig", "words")


def rebuild(rows: DataFrame, shared: Callable[[Column], Column], family: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Every conversation with its first turns replaced by those of its family's first one.

    ``shared(conv_id)`` says how many turns (``most`` at most) are replaced. Returns all ids, and the
    new turns. At most ``2 * family - 1`` conversations take the same turns.
    """
    rows = stable(rows)
    sizes = rows.groupBy("conv_id").agg(F.max("pos").alias("n"))
    convs = stable(sizes.select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), shared(F.col("conv_id")).alias("h"), "n"))
    held = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(held, "base", "left").withColumn("took", F.least("h", F.coalesce("base_n", F.lit(0))))
    own = rows.join(convs.select("conv_id", "h", "took"), "conv_id").where("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("took")).alias("d"), "dig", "words")
    heads = rows.where(F.col("pos") <= most).select(F.col("conv_id").alias("base"), F.col("pos").alias("d"), "dig", "words")
    lent = convs.where("took > 0").select("conv_id", "base", "took").join(heads, "base").where("d <= took")
    return convs.select("conv_id"), own.unionByName(lent.select("conv_id", "d", "dig", "words"))


def _blocks(rows: DataFrame) -> DataFrame:
    """One row per conversation and block: its turns, the digests before and after it, the words before it."""
    line = F.array_sort(F.collect_list(F.struct("d", "dig", "words")))
    blocks = rows.groupBy("conv_id", F.floor((F.col("d") - 1) / BLOCK).cast("long").alias("block")).agg(line.alias("turns"))
    digest = F.array_join(F.transform("turns", lambda t: t["dig"]), "")
    last = F.element_at("turns", -1)["d"]
    blocks = stable(blocks.withColumns({
        "part1": _part(last, digest, 1), "part2": _part(last, digest, 17),
        "own_words": F.aggregate("turns", F.lit(0).cast("long"), lambda acc, t: acc + t["words"]),
        "chunk": F.floor(F.col("block") / BLOCKS_PER_CHUNK),
    }))

    def along(s: DataFrame, w) -> DataFrame:
        back = w.rowsBetween(Window.unboundedPreceding, -1)
        return s.withColumns({
            "c1": F.coalesce(F.bit_xor("x1").over(back), F.lit(0)), "c2": F.coalesce(F.bit_xor("x2").over(back), F.lit(0)),
            "cw": sum_before("sw", w)})

    carried = chunk_carry(
        blocks, ["conv_id"], "chunk",
        {"x1": F.bit_xor("part1"), "x2": F.bit_xor("part2"), "sw": F.sum("own_words")}, along, ["c1", "c2", "cw"])
    w = Window.partitionBy("conv_id", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = {f"g{k}": F.col(f"c{k}").bitwiseXOR(F.bit_xor(f"part{k}").over(w)) for k in (1, 2)}
    done = carried.withColumns(whole | {"words_before": F.col("cw") + F.sum("own_words").over(w) - F.col("own_words")})
    return done.select(
        "conv_id", "block", "turns", "own_words", "words_before", "g1", "g2",
        F.col("g1").bitwiseXOR(F.col("part1")).alias("b1"), F.col("g2").bitwiseXOR(F.col("part2")).alias("b2"))


def _paths(groups: DataFrame) -> DataFrame:
    """The nodes inside each distinct block, as one row per (block group, turn)."""
    def node(t: Column, i: Column) -> Column:
        digest = F.array_join(F.transform(F.slice("turns", 1, i + 1), lambda x: x["dig"]), "")
        before = F.aggregate(F.slice("turns", 1, i), F.lit(0).cast("long"), lambda acc, x: acc + x["words"])
        full = F.sha2(F.concat_ws(":", t["d"].cast("string"), digest).cast("binary"), 256)
        return bind(full, lambda f: F.struct(
            t["d"].alias("depth"), F.col("b1").bitwiseXOR(_long(f, 1)).alias("k1"), F.col("b2").bitwiseXOR(_long(f, 17)).alias("k2"),
            t["words"].alias("words"), (F.col("words_before") + before).alias("words_before")))

    inner = F.transform("turns", node)
    out = groups.withColumn("path", inner).select(
        "g1", "g2", "block", "b1", "b2", "alone", "n", "c", F.posexplode_outer("path").alias("i", "node"),
        "path").select(
        "g1", "g2", "block", "alone", "n", "c", "node.*",
        F.when(F.col("i") == 0, F.col("b1")).otherwise(F.get("path", F.col("i") - 1)["k1"]).alias("p1"),
        F.when(F.col("i") == 0, F.col("b2")).otherwise(F.get("path", F.col("i") - 1)["k2"]).alias("p2"))
    return out


def _grouped(paths: DataFrame, **aggregates: Column) -> DataFrame:
    """Rows of ``paths`` brought together by node; nodes of a block without siblings are together already."""
    key = ["depth", "k1", "k2"]
    lone = paths.where("alone").select(*key, *aggregates)
    return lone.unionByName(paths.where("not alone").groupBy(*key).agg(*[a.alias(n) for n, a in aggregates.items()]).select(*key, *aggregates))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (node, id) to rows with up to ``PIECE_IDS`` joined ids of one node."""
    names = ["depth", "k1", "k2", "first", "ids"]
    node, first, held = None, 0, []
    for batch in batches:
        out: list[tuple] = []
        depth, k1, k2, conv = (c.to_pylist() for c in batch.columns)
        for at, c in zip(zip(depth, k1, k2, strict=True), conv, strict=True):
            if held and (at != node or len(held) == PIECE_IDS):
                out.append((*node, first, ",".join(held)))
                held = []
            if not held:
                node, first = at, c
            held.append(str(c))
        yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=PIECE)
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(names, (*node, first, ",".join(held)), strict=True))], schema=PIECE)


PIECE = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
ENDED = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (node, first id) to one SHA-256 per node, fed piece by piece."""
    node, state = None, None
    for batch in batches:
        out: list[tuple] = []
        depth, k1, k2, _, ids = (c.to_pylist() for c in batch.columns)
        for at, text in zip(zip(depth, k1, k2, strict=True), ids, strict=True):
            if at == node:
                state.update(b"," + text.encode())
                continue
            if node is not None:
                out.append((*node, state.hexdigest()))
            node, state = at, hashlib.sha256(text.encode())
        yield pa.RecordBatch.from_pylist([dict(zip(ENDED.names, x, strict=True)) for x in out], schema=ENDED)
    if node is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(ENDED.names, (*node, state.hexdigest()), strict=True))], schema=ENDED)


def _end_hashes(ends: DataFrame) -> DataFrame:
    key = ["depth", "k1", "k2"]
    ranged = ends.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id").select(*key, "conv_id")
    pieces = ranged.mapInArrow(_pieces, "depth long, k1 long, k2 long, first long, ids string")
    together = pieces.repartition(*key).sortWithinPartitions(*key, "first")
    return together.mapInArrow(_digests, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """All nodes of the trie over ``rows(conv_id, d, dig, words)``, the turns of every id of ``convs``.

    ``d`` counts from 1 without gaps. Returns ``conv_id`` (the smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.
    """
    node_key, group_key = ["depth", "k1", "k2"], ["block", "g1", "g2"]
    convs = stable(convs)
    blocks = stable(_blocks(rows))
    # Conversations by successive block digests.
    groups = blocks.groupBy(*group_key, "b1", "b2").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("c"), F.max("words_before").alias("words_before"))
    siblings = groups.groupBy("block", "b1", "b2").agg((F.count(F.lit(1)) == 1).alias("alone"))
    one = blocks.select(F.col("conv_id").alias("c"), "block", "turns")
    groups = groups.join(siblings, ["block", "b1", "b2"]).join(one, ["c", "block"])
    paths = stable(_paths(groups))
    # Turn boundaries, refined where siblings diverge.
    nodes = _grouped(
        paths, n=F.sum("n"), c=F.min("c"), words_before=F.max("words_before"), p1=F.max("p1"), p2=F.max("p2"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("c")).where("n > 0").select(
        zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "n", "c", zero.alias("words_before"),
        F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"))
    nodes = stable(nodes.unionByName(root))
    parents = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    children = parents.groupBy(*node_key).agg(F.count(F.lit(1)).alias("n_children"))
    # Where conversations end, and which of them stand for a childless node.
    last = blocks.groupBy("conv_id").agg(F.max_by(
        F.struct(F.element_at("turns", -1)["d"].alias("depth"), F.col("g1").alias("k1"), F.col("g2").alias("k2")), "block").alias("end"))
    ends = stable(convs.join(last, "conv_id", "left").select(
        "conv_id", *[F.coalesce(f"end.{k}", zero).alias(k) for k in node_key]))
    childless = nodes.join(children, node_key, "left_anti").select(F.col("c").alias("conv_id"), F.lit(1).alias("leaf"))
    # Words of each conversation in turns whose nodes belong to others.
    split = paths.where("not alone").join(nodes.select(*node_key, F.col("c").alias("owner")), node_key)
    foreign = split.groupBy(*group_key).agg(F.sum(F.when(F.col("owner") != F.col("c"), F.col("words")).otherwise(0)).alias("not_owned"))
    owners = paths.select(*group_key, "c").distinct().join(foreign, group_key, "left")
    per_block = blocks.select("conv_id", *group_key, "own_words").join(owners, group_key)
    given = F.when(F.col("c") != F.col("conv_id"), F.col("own_words")).otherwise(F.coalesce("not_owned", zero))
    facts = per_block.groupBy("conv_id").agg(F.sum(given).alias("k"))
    facts = stable(convs.join(facts, "conv_id", "left").join(childless, "conv_id", "left").select(
        "conv_id", F.coalesce("k", zero).alias("k"), F.coalesce("leaf", F.lit(0)).cast("long").alias("leaf")))
    # Their sums over the members, again by block and then by turn.
    sums = blocks.select("conv_id", *group_key).join(facts, "conv_id").groupBy(*group_key).agg(
        F.sum("k").alias("sum_k"), F.sum("leaf").alias("leaves"))
    below = _grouped(paths.join(sums, group_key), sum_k=F.sum("sum_k"), leaves=F.sum("leaves"))
    top = facts.agg(F.sum("k").alias("sum_k"), F.sum("leaf").alias("leaves")).where("leaves is not null").select(
        zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "sum_k", "leaves")
    below = below.unionByName(top)
    # All facts of a node.
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("c").alias("parent_conv_id"))
    out = nodes.join(up, ["depth", "p1", "p2"], "left").join(children, node_key, "left").join(below, node_key)
    out = out.join(_end_hashes(ends), node_key, "left").join(facts.select(F.col("conv_id").alias("c"), F.col("k").alias("own_k")), "c")
    return out.select(
        F.col("c").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"),
        F.coalesce("n_children", zero).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("sum_k") - F.col("own_k") - (F.col("n") - 1) * F.col("words_before")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, shared: Callable[[Column], Column] | None = None) -> DataFrame:
    """The prefix trie of ``conversations(conv_id, turn, role, text)``; with ``shared`` of the rebuilt ones."""
    rows = turns(conversations)
    if shared is None:
        rows = stable(rows)
        return prefix_trie(rows.select("conv_id").distinct(), rows.withColumnRenamed("pos", "d"))
    return prefix_trie(*rebuild(rows, shared))
