"""Personal data: exact patterns, and terms that give protected entities away.

The patterns find e-mail addresses, IP addresses, payment cards and phone numbers; each value found is
a *protected entity*. Every word of a document with an entity may disclose it. The corpus says how
much: with document counts over all documents,

    PMI(term; entity) = log2(n * n(term, entity) / ((n(term) + SMOOTH) * n(entity)))

is the information that the term gives, and the entity holds log2(n / n(entity)) bits, so their
quotient is the disclosed share: near 1 if the term occurs with that entity only. ``SMOOTH`` takes
most from rare terms, so one seen once is generalised rather than removed in a small corpus; no
number of documents is required. In the documents of the entity, every place of a term that reaches
``GENERALISE`` is generalised, of one that reaches ``REMOVE`` removed.

Counts of terms are taken over all documents, with the words inside the patterns' matches. So that
only terms that matter are shuffled, tasks test words against a Bloom filter of the candidate terms,
whose size is fixed.

The cost grows with (distinct words x distinct entities) of a document.

Cases: a null text is empty. Equal rows count as documents of their own. Spans never overlap spans of
the patterns. A corpus of one document discloses nothing. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentloom.llm import bytescan
from momentloom.llm.shared import ship, stable

KINDS = ("email", "ip", "card", "phone", "term")
GENERALISE, REMOVE = 0.8, 0.95
SMOOTH = 0.5
BLOOM_BITS = 1 << 23
BLOOM_HASHES = 4
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The contract's patterns; what they match starts and ends whole runs of digits, so no run is read twice.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, looked for only around each ``@``."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m and m.end() > at:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of all pattern matches that hold, in order."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def key(value: str) -> int:
    """A 64-bit number for a term or an entity's value."""
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


def _words(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """``(term, start, end)`` of every word; one that lies in a span, even in part, has the start -1."""
    covered: list[list[int]] = []
    for s, _, e in spans:
        if covered and s <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([s, e])
    k = 0
    for m in _WORD.finditer(text):
        s, e = m.span()
        while k < len(covered) and covered[k][1] <= s:
            k += 1
        yield m[0].lower(), -1 if k < len(covered) and covered[k][0] < e else s, e


FOUND = ("row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
         "base array<struct<start:int,kind:int,end:int>>, entities array<long>, "
         "words array<struct<term:long,start:int,end:int>>")
_BASE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict[str, int] = {}
    for batch in batches:
        counts: list[list[int]] = [[], [], [], []]
        digests, base, entities = [], [], []
        terms, starts, ends, upto = array("q"), array("i"), array("i"), array("i", [0])
        for text in batch.column(2):
            text = text.as_py() or ""
            spans = base_spans(text)
            for k, held in enumerate(counts):
                held.append(sum(kind == k for _, kind, _ in spans))
            digests.append(hashlib.sha256(written(spans).encode()).hexdigest())
            base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
            entities.append(sorted({key(text[s:e]) for s, _, e in spans}))
            for term, s, e in _words(text, spans) if spans else ():
                if term not in memo:
                    if len(memo) > 500_000:
                        memo.clear()
                    memo[term] = key(term)
                terms.append(memo[term])
                starts.append(s)
                ends.append(e)
            upto.append(len(terms))
        words = pa.StructArray.from_arrays(
            [pa.array(np.frombuffer(terms, np.int64)), pa.array(np.frombuffer(starts, np.int32)), pa.array(np.frombuffer(ends, np.int32))],
            names=["term", "start", "end"])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()),
             pa.array(base, _BASE), pa.array(entities, pa.list_(pa.int64())),
             pa.ListArray.from_arrays(pa.array(np.frombuffer(upto, np.int32)), words)],
            names=["row", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "entities", "words"])


class Bloom:
    """A filter of fixed size; without false negatives."""

    def __init__(self, bits: np.ndarray | None = None):
        self.bits = np.zeros(BLOOM_BITS // 8, dtype=np.uint8) if bits is None else bits

    @staticmethod
    def _places(keys: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(BLOOM_HASHES):
            yield (bytescan.mix64(keys.view(np.uint64) + np.uint64(k + 1)) % np.uint64(BLOOM_BITS)).astype(np.int64)

    def add(self, keys: np.ndarray) -> None:
        for at in self._places(keys):
            np.bitwise_or.at(self.bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), dtype=bool)
        for at in self._places(keys):
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bloom, some = Bloom(), False
    for batch in batches:
        some = True
        bloom.add(batch.column(0).to_numpy())
    if some:
        yield pa.RecordBatch.from_arrays([pa.array([bloom.bits.tobytes()], pa.binary())], names=["bits"])


def candidate_filter(terms: DataFrame) -> Bloom:
    """One filter of ``BLOOM_BITS`` over ``terms(term)``; parts of that size are merged one by one."""
    bloom = Bloom()
    for row in terms.coalesce(64).mapInArrow(_filters, "bits binary").toLocalIterator():
        bloom.bits |= np.frombuffer(row[0], dtype=np.uint8)
    return bloom


def _term_counts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = Bloom(np.frombuffer(shared.value, dtype=np.uint8))
        memo: dict[str, int | None] = {}
        for batch in batches:
            counts: dict[int, int] = {}
            for text in batch.column(0):
                words = {w.lower() for w in set(_WORD.findall(text.as_py() or ""))}
                fresh = [w for w in words if w not in memo]
                if fresh:
                    if len(memo) > 500_000:
                        memo.clear()
                        fresh = list(words)
                    keys = np.array([key(w) for w in fresh], dtype=np.int64)
                    memo.update(zip(fresh, (int(k) if hit else None for k, hit in zip(keys, bloom.has(keys), strict=True)), strict=True))
                for w in words:
                    k = memo[w]
                    if k is not None:
                        counts[k] = counts.get(k, 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())], names=["term", "n"])

    return run


def _pairs(found: DataFrame) -> DataFrame:
    """``(row, entity, term)``: every entity of a row with every term of the row, once."""
    rows = found.select("row", "entities", F.array_distinct("words.term").alias("terms"))
    return rows.select("row", F.explode("entities").alias("entity"), "terms").select("row", "entity", F.explode("terms").alias("term"))


def disclosures(found: DataFrame, docs: DataFrame) -> DataFrame:
    """``(entity, term, share)``: how much of each entity's information a term of its documents gives away."""
    pairs = _pairs(found).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"))
    entities = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    bloom = candidate_filter(found.select(F.explode(F.array_distinct("words.term")).alias("term")))
    shared = docs.sparkSession.sparkContext.broadcast(bloom.bits.tobytes())
    counts = docs.select("text").mapInArrow(_term_counts(shared), "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    n = docs.count()
    share = F.try_divide(F.log2(F.lit(float(n)) * F.col("n_both") / ((F.col("n_term") + SMOOTH) * F.col("n_entity"))),
                         F.log2(F.lit(float(n)) / F.col("n_entity")))
    met = pairs.join(entities, "entity").join(counts, "term").where(F.col("n_entity") < n)
    return met.select("entity", "term", share.alias("share")).where(F.col("share") >= GENERALISE)


def _all_spans() -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort("all"), one), ",")


def find(docs: DataFrame) -> DataFrame:
    """``(row, doc_id, n_email, n_ip, n_card, n_phone, base_sha256, base, terms, spans)``; ``row`` numbers the rows.
    ``terms`` are the disclosing terms as ``(start, kind, end, removed)``."""
    return _found(_numbered(docs), docs)


def _numbered(docs: DataFrame) -> DataFrame:
    return ship(docs).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")


def _found(rows: DataFrame, docs: DataFrame) -> DataFrame:
    found = stable(rows.mapInArrow(_find, FOUND))
    open_ = found.where(F.size("entities") > 0)
    told = stable(disclosures(open_, docs))
    judged = _pairs(open_).join(told, ["entity", "term"]).groupBy("row", "term").agg(F.max("share").alias("share"))
    places = open_.select("row", F.explode("words").alias("w")).select("row", "w.*").where("start >= 0")
    spans = places.join(judged, ["row", "term"]).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "end", (F.col("share") >= REMOVE).alias("removed")))).alias("terms"))
    met = found.drop("entities", "words").join(spans, "row", "left")
    extra = F.transform(F.coalesce("terms", F.array()), lambda t: F.struct(t["start"], t["kind"], t["end"]))
    return met.withColumn("all", F.concat("base", extra)).withColumn("spans", _all_spans()).drop("all")


def generalised(word: str) -> str:
    if word.isdigit():
        return "[NUMBER]"
    return "[NAME]" if word[:1].isupper() else "[TERM]"


def redact(text: str, base: list, terms: list) -> str:
    """``text`` with each pattern match as its kind, and disclosing terms generalised or removed."""
    cuts = [(s["start"], s["end"], f"[{KINDS[s['kind']].upper()}]") for s in base]
    for t in terms or []:
        cuts.append((t["start"], t["end"], "" if t["removed"] else generalised(text[t["start"] : t["end"]])))
    out, at = [], 0
    for s, e, new in sorted(cuts):
        if s >= at:  # of matches of two kinds that overlap, the first names the stretch
            out += [text[at:s], new]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [redact(t or "", b or [], x) for t, b, x in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def sanitised(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of every row with its personal data replaced, rows without id and of one id too.
    The numbered rows are written first, so that spans and texts meet on the same numbers."""
    rows = stable(_numbered(docs))
    met = rows.join(_found(rows, rows).select("row", "base", "terms"), "row")
    return met.select("doc_id", "text", "base", "terms").mapInArrow(_redact, "doc_id long, text string")


def sanitise(docs: DataFrame) -> DataFrame:
    """The digest of what was found in every row of ``docs(doc_id, text)``."""
    return find(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans",
                             F.size(F.coalesce("terms", F.array())).cast("long").alias("n_terms"))
