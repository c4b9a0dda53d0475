"""Phrase collocations, counted in HAT-tries.

Words are counted first; a word's id is a 64-bit hash of language and word, and the seed is changed
until no two words share one, so ids are exact. Phrases are then counted length by length. Every task
counts its phrases in a HAT-trie over word ids: array containers under a shallow trie that burst when
they are full. A trie that holds ``SPILL_PHRASES`` gives up whole subtrees, largest first, as sorted
runs. Runs go to prefix partitions: the first two words name one, cut into ``SPREAD`` by the last
word, so that a very frequent prefix is no hot task. A run is cut at the partitions and each piece
travels as one row of bytes. There are so many partitions that one gets about ``MERGE_PHRASES``
phrases, however large the input. All pieces of one are merged at once: phrases are first added up
by a hash, and only those whose hash reaches ``min_count`` are sorted and added up themselves.

A phrase that occurs ``min_count`` times has only parts that do. A bitmap over the hashes of the
shorter phrases that reached the count therefore leaves out most phrases before they are counted; it
lets some more through, never fewer. It takes 32 bits per phrase, up to ``MAX_BITS``; beyond that
it leaves out less and the counts stay exact.

Cases: a null text is empty; a null language is ``und``. Phrases never cross a piece, a row or a
language. Repeated rows count as often as they are there. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momentloom.llm.hattrie import HatTrie, added
from momentloom.llm.shared import ship, stable

MIN_COUNT = 10
MAX_WORDS = 3
TOP = 2000
SPILL_PHRASES = 1_000_000
RUN_WORDS = 1 << 20
MERGE_PHRASES = 1 << 19
SPREAD = 64
MAX_BITS = 1 << 29
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARKS = ".,;:!?\n\x0b\x0c\r"  # split pieces
BREAK = "."  # a mark, so it is no word


def words_of(text: str = "text") -> Column:
    """The words of a text in order, with one or more ``BREAK`` between pieces. Plain replacements, as patterns cost more."""
    plain = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER + MARKS + "\t", LOWER + BREAK * len(MARKS) + " ")
    return F.array_remove(F.split(F.replace(plain, F.lit(BREAK), F.lit(f" {BREAK} ")), " "), "")


def _lang() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit("und"))


def _word_id(seed: int, lang: Column, word: Column) -> Column:
    return F.xxhash64(F.lit(seed), lang, word)


def word_counts(docs: DataFrame) -> DataFrame:
    """``(lang, word, n)``: occurrences of every word."""
    rows = docs.select(_lang().alias("lang"), F.explode(words_of()).alias("word"))
    return rows.where(~F.col("word").isin("", BREAK)).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


def _with_ids(words: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The words and the breaks of each language with ids that are all different, and the seed."""
    seed = 0
    marks = stable(words.select("lang").distinct().select("lang", F.explode(F.array(F.lit(BREAK), F.lit(""))).alias("word")))
    while True:
        word_id = _word_id(seed, F.col("lang"), F.col("word")).alias("id")
        named, breaks = words.select("*", word_id), marks.select(word_id)
        shared = named.select("id").unionByName(breaks).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if shared.isEmpty():
            return named, breaks, seed
        seed += 1


class Present:
    """A bitmap over phrase hashes: False means that the phrase is not in the table."""

    def __init__(self, data: np.ndarray):
        self.data = data

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & (len(self.data) * 8 - 1)
        return (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _hash(columns):
    """Of word ids, which are spread over 64 bits already; the same on columns and arrays."""
    out = columns[0]
    for c in columns[1:]:
        if isinstance(c, Column):
            out = out.bitwiseXOR(F.shiftleft(out, 23)).bitwiseXOR(F.shiftrightunsigned(c, 17)).bitwiseXOR(F.shiftleft(c, 47))
        else:
            turned = (c.view(np.uint64) >> np.uint64(17)) ^ (c.view(np.uint64) << np.uint64(47))
            out = out ^ (out << 23) ^ turned.view(np.int64)
    return out


def _bitmap(phrases: DataFrame, names: list[str], held: int) -> Present:
    """Collects at most ``MAX_BITS`` bits, however many phrases are ``held``."""
    bits = 1 << 16
    while bits < min(32 * held, MAX_BITS):
        bits *= 2
    place = _hash([F.col(n) for n in names]).bitwiseAND(F.lit(bits - 1)) + 1
    chunks = phrases.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()
    data = np.zeros(bits // 8, dtype=np.uint8)
    for row in chunks:
        at = (row["b"] - 1) * 4096
        data[at : at + 4096] = np.frombuffer(row["m"], dtype=np.uint8)
    return Present(data)


def _coded(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ids in the sorted table of those that occur, and the table."""
    code, table = pd.factorize(ids)
    order = np.argsort(table)
    place = np.empty(len(table), dtype=np.int64)
    place[order] = np.arange(len(table))
    return place[code], table[order]


def _phrases(ids: np.ndarray, n: int, present: Present) -> tuple[np.ndarray, np.ndarray]:
    """Distinct phrases of ``n`` words of a run of ids, in order, and their counts."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.zeros((n, 0), np.int64), np.zeros(0, np.int64)
    # Both parts of n - 1 words must be in the table.
    good = present(_hash([ids[j : j + m + 1] for j in range(n - 1)]))
    starts = np.flatnonzero(good[:-1] & good[1:])
    if n * len(starts) > len(ids):  # each id is looked up once, not in every place of a phrase
        whole, table = _coded(ids)
        code = np.stack([whole[starts + j] for j in range(n)])
    else:
        code, table = _coded(np.concatenate([ids[starts + j] for j in range(n)]))
        code = code.reshape(n, -1)
    if len(table) ** n >= 1 << 63:  # never for three words, as a run has about 2**20
        code, counts = np.unique(code, axis=1, return_counts=True)
        return table[code], counts
    key = code[0]
    for j in range(1, n):
        key = key * len(table) + code[j]
    key, counts = np.unique(key, return_counts=True)
    out = np.empty((n, len(key)), dtype=np.int64)
    for j in range(n - 1, -1, -1):
        key, at = np.divmod(key, max(1, len(table)))
        out[j] = table[at]
    return out, counts


def _pieces(run: np.ndarray, parts: int) -> pa.RecordBatch:
    """A sorted run cut at the prefix partitions: ``(part, w1 .. wn, n)``, columns of 64-bit numbers as bytes, still sorted."""
    words = run.T[:-1]
    part = (_hash([*words[:2], words[-1] % SPREAD]).view(np.uint64) >> np.uint64(33)) % np.uint64(parts)
    order = np.argsort(part.astype(np.uint16 if parts <= 1 << 16 else np.int32), kind="stable")
    part = part[order].astype(np.int32)
    edges = np.concatenate([np.flatnonzero(np.diff(part, prepend=-1)), [len(part)]])
    ends = pa.py_buffer((8 * edges).astype(np.int32))
    columns = [pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, ends, pa.py_buffer(np.ascontiguousarray(c[order]))]) for c in run.T]
    return pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]]), *columns], names=["part", *(f"w{i + 1}" for i in range(len(words))), "n"])


def _runs(n: int, shared, parts: int):
    """Sorted runs of phrases and counts from one trie per task, in pieces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, trie = Present(shared.value), HatTrie(n)
        for rows in batches:
            lists = rows.column(0)
            ids = lists.flatten().to_numpy()
            for at in range(0, len(ids), RUN_WORDS):
                words, counts = _phrases(ids[at : at + RUN_WORDS + n - 1], n, present)
                for lo in range(0, len(counts), SPILL_PHRASES):
                    part = slice(lo, lo + SPILL_PHRASES)
                    trie.add([w[part] for w in words], counts[part])
                    if trie.entries > SPILL_PHRASES and trie.settle() > SPILL_PHRASES:
                        yield _pieces(trie.spill(SPILL_PHRASES // 2), parts)
        if trie.entries:
            yield _pieces(trie.spill(0), parts)

    return run


def _reaching(rows: np.ndarray, least: int) -> np.ndarray:
    """Phrases and counts, equal ones added up, of those that reach the count."""
    # The phrases of one place in a table together occur at least as often as each of them.
    size = 1 << max(10, rows.shape[1].bit_length())
    place = _hash(list(rows[:-1])) & (size - 1)
    rows = added(rows[:, np.bincount(place, weights=rows[-1], minlength=size)[place] >= least])
    return rows[:, rows[-1] >= least]


def _merge(n: int, least: int):
    """Adds up equal phrases of sorted runs; keeps phrases that reach the count. Rows of one partition stand together."""
    names = [f"w{i + 1}" for i in range(n)] + ["n"]

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in _reaching(np.concatenate(held, axis=1), least)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last, size, limit = None, 0, 4 * MERGE_PHRASES
        for b in batches:
            part = b.column(0).to_numpy()
            edges = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if part[lo] != last and held:
                    yield out(held)
                    held, size, limit = [], 0, 4 * MERGE_PHRASES
                last = part[lo]
                held.append(np.stack([_numbers(c.slice(lo, hi - lo)) for c in b.columns[1:]]))
                size += held[-1].shape[1]
                if size > limit:  # more pieces of one partition than planned
                    held = [added(np.concatenate(held, axis=1))]
                    size = held[0].shape[1]
                    limit = max(limit, 2 * size)
        if held:
            yield out(held)

    return run


def _numbers(column: pa.Array) -> np.ndarray:
    """The 64-bit numbers of all rows of a column of bytes, one after the other."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.int64, (int(ends[-1]) - int(ends[0])) // 8, int(ends[0]))


def phrase_counts(ids: DataFrame, n: int, shorter: DataFrame, breaks: DataFrame, least: int) -> DataFrame:
    """``(w1 .. wn, n)``: phrases of ``n`` words that occur at least ``least`` times.

    ``ids`` has one column of ids of words and ``breaks``, ``shorter`` the phrases of one word less that
    reach the count. Across a break nothing counts; what the bitmap lets through there is left out again.
    """
    names = [f"w{i + 1}" for i in range(n)]
    facts = shorter.agg(F.count(F.lit(1)), F.sum("n")).first()
    bitmap = ids.sparkSession.sparkContext.broadcast(_bitmap(shorter, names[:-1], facts[0]).data)
    # About as many phrases as shorter ones that reach the count pass the bitmap.
    parts = min(1 + (facts[1] or 0) // MERGE_PHRASES, 1 << 30)
    columns = [*names, "n"]
    runs = ids.mapInArrow(_runs(n, bitmap, parts), "part int, " + ", ".join(f"{c} binary" for c in columns))
    merged = runs.repartition("part").sortWithinPartitions("part").mapInArrow(_merge(n, least), ", ".join(f"{c} long" for c in columns))
    for name in names:
        merged = merged.join(breaks.withColumnRenamed("id", name), name, "left_anti")
    return stable(merged)


def _score(a: str, left: str, right: str) -> Column:
    """``floor(1000000 a a / (l r))`` in 38 digits; the quotient is at most a million."""
    wide = [f"cast({c} as decimal(15,0))" for c in (a, a, left, right)]
    return F.expr(f"cast(({wide[0]} * {wide[1]} * 1000000) div ({wide[2]} * {wide[3]}) as bigint)")


def _scored(phrases: dict[int, DataFrame], words: DataFrame, m: int) -> DataFrame:
    """Candidates of ``m`` words with their texts and lowest-scoring cut."""
    names = [f"w{i + 1}" for i in range(m)]
    df = phrases[m].withColumnRenamed("n", "a")
    for i, name in enumerate(names):
        facts = [F.col("id").alias(name), F.col("word").alias(f"t{i}"), F.col("n").alias(f"f{i}_1")]
        df = df.join(words.select(*facts, *(["lang"] if i == 0 else [])), name)
    for size in range(2, m):
        for at in sorted({0, m - size}):
            part = names[at : at + size]
            found = phrases[size].select(*[F.col(f"w{j + 1}").alias(p) for j, p in enumerate(part)], F.col("n").alias(f"f{at}_{size}"))
            df = df.join(found, part)
    cuts = [F.struct(_score("a", f"f0_{k}", f"f{k}_{m - k}").alias("score"), F.lit(k).alias("k"),
                     F.col(f"f0_{k}").alias("l"), F.col(f"f{k}_{m - k}").alias("r")) for k in range(1, m)]
    best = F.array_min(F.array(*cuts))
    text = F.concat_ws(" ", *[f"t{i}" for i in range(m)])
    return df.select(*names, "lang", text.alias("phrase"), "a", best.alias("best")).select(
        *names, "lang", "phrase", "a", "best.l", "best.r", "best.score")


def _standing(scored: DataFrame, longer: list[tuple[int, DataFrame]], m: int, share: int) -> DataFrame:
    """Without the phrases of which a longer candidate holds ``share`` percent of the occurrences."""
    names = [f"w{i + 1}" for i in range(m)]
    if not longer:
        return scored
    inside = None
    for size, phrases in longer:
        parts = F.array(*[F.struct(*[F.col(f"w{at + j + 1}").alias(names[j]) for j in range(m)]) for at in range(size - m + 1)])
        rows = phrases.select(F.explode(parts).alias("p"), "n").select("p.*", "n")
        inside = rows if inside is None else inside.unionByName(rows)
    most = inside.groupBy(*names).agg(F.max("n").alias("most"))
    return scored.join(most, names, "left").where(f"most is null or 100 * most < {share} * a").drop("most")


def collocations(docs: DataFrame, top: int = TOP, least: int = MIN_COUNT, max_words: int = MAX_WORDS, share: int = 50) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top`` phrases of two to ``max_words``
    words of ``docs(text, lang)`` by how much more often their parts meet than apart."""
    docs = ship(docs.select("text", "lang"))
    counted = stable(word_counts(docs))
    named, breaks, seed = _with_ids(counted)
    words = stable(named.where(F.col("n") >= least))
    lang = _lang()
    # Written, so that the texts are not cut again for every length.
    ids = stable(docs.select(F.transform(F.concat(words_of(), F.array(F.lit(BREAK))), lambda w: _word_id(seed, lang, w)).alias("ids")))
    phrases = {1: words.select(F.col("id").alias("w1"), "n")}
    for m in range(2, max_words + 1):
        phrases[m] = phrase_counts(ids, m, phrases[m - 1], breaks, least)
    out = None
    for m in range(2, max_words + 1):
        longer = [(size, phrases[size]) for size in range(m + 1, max_words + 1)]
        rows = _standing(_scored(phrases, words, m), longer, m, share).select("lang", "phrase", "a", "l", "r", "score")
        out = rows if out is None else out.unionByName(rows)
    # Each of the parts of a language ranks its own first, so one task sees SPREAD * top rows at most.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))).orderBy(*order)
    near = out.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
