"""Benchmark decontamination with a BM25 index of the test items.

The inverted index covers the *items*; every passage of every document is a query. Items stand in
the order of the score that each gets from its own text, in blocks; a term knows its largest impact
per block. A block is opened for a passage only if the block maxima of the passage's terms can reach
the lowest threshold in it (the pivot test of block-max WAND, for all passages of a document at
once). Terms that are common among the items are left out of that test and enter as one bound.
In opened blocks all items are scored exactly, and those that reach ``RETRIEVE`` of their own score
are retrieved. Retrieved items are confirmed on five-word shingles: at least ``OVERLAP`` of the item,
and at least ``PART`` of its question and of its answer, must stand in the passage. The answer is
the item's last sentence, with the sentences before it until it has five words, or the second half if
nothing else is left. What has fewer than five words must stand in the passage word for word.

Passages are windows of two halves that advance by a half; a half is as long as the longest item, so
an item always lies in one passage.

The index is broadcast in shards of at most ``SHARD_ITEMS`` items; a larger benchmark takes more
scans. Every document is read whole.

Cases: a null or empty text has no passages. Items without words are never found. Items that are
equal are found together. Rows with the same id are one document. Empty tables give no rows. Other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from momentloom.llm.shared import free_name, ship

K1, B = 1.2, 0.75
RETRIEVE, OVERLAP, PART = 0.5, 0.75, 0.5
SHARD_ITEMS, BLOCK_ITEMS, MIN_HALF = 20_000, 4, 32
SHINGLE = 5
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def shingles(words: Sequence[str]) -> set[str]:
    return {" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


class Passage:
    """The words of a window, its shingles, and its text for short phrases."""

    def __init__(self, words: Sequence[str]):
        self.text, self.cut = f" {' '.join(words)} ", shingles(words)

    def share(self, part: Sequence[str]) -> float:
        """How much of ``part`` stands here: its shingles, or all of a short one; 1 for no words."""
        if len(part) >= SHINGLE:
            own = shingles(part)
            return len(own & self.cut) / len(own)
        return float(f" {' '.join(part)} " in self.text) if part else 1.0


def question_answer(text: str) -> tuple[list[str], list[str]]:
    sentences = [w for w in map(tokens, _SENTENCE.split(text)) if w]
    answer: list[str] = []
    while sentences and len(answer) < SHINGLE:
        answer = sentences.pop() + answer
    question = [w for s in sentences for w in s]
    if not question:
        half = (len(answer) + 1) // 2
        return answer[:half], answer[half:]
    return question, answer


@dataclass
class Item:
    item_id: int
    words: list[str]
    question: list[str]
    answer: list[str]
    impact: dict[str, float] = field(default_factory=dict)
    own: float = 0.0


class ItemIndex:
    """Postings with block maxima, for items in the order of their own score."""

    def __init__(self, rows: Sequence[tuple[int, str]], df: dict[str, int], n_items: int, mean_words: float):
        items = [Item(i, w, *question_answer(t)) for i, t in rows if (w := tokens(t))]
        for item in items:
            norm = K1 * (1 - B + B * len(item.words) / mean_words)
            for word, tf in Counter(item.words).items():
                idf = math.log(1 + (n_items - df[word] + 0.5) / (df[word] + 0.5))
                item.impact[word] = idf * tf * (K1 + 1) / (tf + norm)
            item.own = sum(item.impact.values())
        self.items = sorted(items, key=lambda x: (x.own, x.item_id))
        self.half = max([MIN_HALF, *(len(x.words) for x in items)])
        self.threshold = np.array([RETRIEVE * x.own for x in self.items])
        n_blocks = -(-len(self.items) // BLOCK_ITEMS)
        self.lowest = self.threshold[::BLOCK_ITEMS] if len(self.items) else np.zeros(0)
        maxima: dict[str, dict[int, float]] = {}
        for at, item in enumerate(self.items):
            for word, value in item.impact.items():
                held = maxima.setdefault(word, {})
                held[at // BLOCK_ITEMS] = max(value, held.get(at // BLOCK_ITEMS, 0.0))
        # Terms in many blocks are the cheap ones: together they may reach half of no threshold.
        common = np.zeros(len(self.items))
        holders: dict[str, list[int]] = {}
        for at, item in enumerate(self.items):
            for word in item.impact:
                holders.setdefault(word, []).append(at)
        self.essential: dict[str, int] = {}
        for word in sorted(maxima, key=lambda w: (-len(maxima[w]), w)):
            at = holders[word]
            add = np.array([self.items[i].impact[word] for i in at])
            if (common[at] + add < 0.5 * self.threshold[at]).all():
                common[at] += add
            else:
                self.essential[word] = len(self.essential)
        self.rest = np.array([common[b * BLOCK_ITEMS : (b + 1) * BLOCK_ITEMS].max() for b in range(n_blocks)])
        self.starts = np.zeros(len(self.essential) + 1, dtype=np.int64)
        blocks, values = [], []
        for word, k in self.essential.items():
            self.starts[k + 1] = len(maxima[word])
            blocks += maxima[word]
            values += maxima[word].values()
        self.starts = np.cumsum(self.starts)
        self.blocks, self.values = np.array(blocks, dtype=np.int64), np.array(values)

    def open_blocks(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(passage, block)`` pairs whose upper bound reaches the block's lowest threshold."""
        term = np.fromiter((self.essential.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        at = np.flatnonzero(term >= 0)
        n_halves, n_blocks = -(-len(words) // self.half), len(self.lowest)
        # A term counts once per half.
        pair = np.unique(at // self.half * len(self.essential) + term[at])
        half, term = pair // max(1, len(self.essential)), pair % max(1, len(self.essential))
        width = self.starts[term + 1] - self.starts[term]
        first = np.repeat(self.starts[term] - np.concatenate([[0], np.cumsum(width)[:-1]]) if len(width) else width, width)
        place = first + np.arange(len(first))
        cell = np.repeat(half, width) * n_blocks + self.blocks[place]
        sums = np.bincount(cell, weights=self.values[place], minlength=n_halves * n_blocks).reshape(n_halves, n_blocks)
        if n_halves > 1:
            sums = sums[:-1] + sums[1:]
        return np.nonzero(sums + self.rest >= self.lowest - 1e-9)

    def find(self, words: list[str]) -> dict[int, tuple[float, float, float, int]]:
        """Confirmed items: their best score share, question and answer overlap, and the word at
        which the passage begins."""
        out: dict[int, tuple[float, float, float, int]] = {}
        if not words or not self.items:
            return out
        passages, blocks = self.open_blocks(words)
        seen, held, here = -1, set(), None
        for passage, block in zip(passages.tolist(), blocks.tolist(), strict=True):
            if passage != seen:
                window = words[passage * self.half : (passage + 2) * self.half]
                seen, held, here = passage, set(window), None
            for at in range(block * BLOCK_ITEMS, min((block + 1) * BLOCK_ITEMS, len(self.items))):
                item = self.items[at]
                score = sum(v for w, v in item.impact.items() if w in held)
                if score < self.threshold[at] - 1e-9:
                    continue
                here = here or Passage(window)
                whole, question, answer = map(here.share, (item.words, item.question, item.answer))
                if whole >= OVERLAP and question >= PART and answer >= PART:
                    share = min(1.0, score / item.own)
                    if share > out.get(at, (-1.0,))[0]:
                        out[at] = (share, question, answer, passage * self.half)
        return out


def build_indexes(benchmark: DataFrame, shard_items: int = SHARD_ITEMS) -> Iterator[ItemIndex]:
    """The shards of the index, one after the other; document frequencies are those of all items."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null")
    split = ship(items).mapInArrow(_item_words, "item_id long, text string, words array<string>, n_words long").where("n_words > 0")
    n_items, mean_words = split.agg(F.count(F.lit(1)), F.avg("n_words")).first()
    if not n_items:
        return
    df = split.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    n_shards = -(-n_items // shard_items)
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_shards))
    for k in range(n_shards):
        mine = split.where(shard == k)
        rows = [(r[0], r[1]) for r in mine.select("item_id", "text").collect()]  # about shard_items rows
        words = mine.select(F.explode("words").alias("word")).distinct()
        counts = {r[0]: r[1] for r in df.join(words, "word").collect()}
        yield ItemIndex(rows, counts, n_items, mean_words)


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [tokens(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string())), pa.array([len(w) for w in found], pa.int64())],
            names=["item_id", "text", "words", "n_words"])


FOUND = "array<struct<item_id:long,score:double,question_overlap:double,answer_overlap:double,word:long>>"
_FOUND = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()),
                             ("answer_overlap", pa.float64()), ("word", pa.int64())]))


def _search(shared, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            found = []
            for text in batch.column(at):
                hits = index.find(tokens(text.as_py()))
                found.append([{"item_id": index.items[k].item_id, "score": s, "question_overlap": q, "answer_overlap": a, "word": w}
                              for k, (s, q, a, w) in sorted(hits.items())])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _FOUND)], names=[*batch.schema.names, out])

    return run


def search(docs: DataFrame, index: ItemIndex, out: str) -> DataFrame:
    """``docs`` with the column ``out``: the items confirmed in ``text``; all other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.StructType.fromDDL(f"f {FOUND}")["f"].dataType)])
    return ship(docs).mapInArrow(_search(shared, out), schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``(doc_id, item_id, score, question_overlap, answer_overlap)``: every item confirmed in a
    document of ``docs(doc_id, text)``. ``score`` is the share of the item's own BM25 score."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    out = None
    for index in build_indexes(benchmark, shard_items):
        hits = search(rows, index, "found").select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*").drop("word")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("m")).select(
        "doc_id", "item_id", "m.*")


def clean(docs: DataFrame, benchmark: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``docs`` without the rows in whose ``text`` an item is confirmed. All columns stay."""
    kept, found = docs, free_name(docs, "found")
    for index in build_indexes(benchmark, shard_items):
        kept = search(kept, index, found).where(F.size(found) == 0).drop(found)
    return kept
