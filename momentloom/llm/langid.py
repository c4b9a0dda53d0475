"""Language identification by compression.

Each language gets a raw-content zstandard dictionary from a bounded sample of its documents. A text
is cut into blocks, each block is compressed with every dictionary, and the language with the
smallest total wins. Blocks keep the dictionaries ahead of what a long text teaches about itself.
When the runner-up is close, the decision is *rejected*: the prediction stays the best guess and
the flag and the score say how close it was.

Model bounds: at most ``SAMPLE_DOCS`` documents per language, those with the smallest MD5 of their
id (one row of each), of which up to ``PIECE`` characters go into a dictionary of at most ``DICT_BYTES``; at most
``MAX_LANGS`` languages. Every text is classified whole.

Cases: a null text, or one without any letter, is ``und`` with score 0 and rejected. Without any
labelled document every text is ``und``. A text that is short for a block compares what there is;
ties go to the first language in order. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentloom.llm.shared import is_held_out, sample_ids, ship

SAMPLE_DOCS, PIECE, DICT_BYTES, MAX_LANGS = 150, 1500, 96 << 10, 256
LEVEL, BLOCK = 12, 4 << 10
MIN_MARGIN = 0.01
NARROW_BYTES = 4.0
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Lower-case letters, each other run as one space; empty without any letter.

    Signs such as ½, ² and Ⅳ stay beside letters, but are none themselves.
    """
    body = _OTHER.sub(" ", text.lower()).strip() if text else ""
    return body if any(map(str.isalpha, body)) else ""


def train(docs: DataFrame) -> dict[str, bytes]:
    """A dictionary per language from the rows of ``docs(doc_id, text, lang)`` outside the held-out fold."""
    rows = docs.select("doc_id", "text", "lang").where(~is_held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = sample_ids(rows, "lang", SAMPLE_DOCS, MAX_LANGS)
    ids = chosen.collect()  # at most MAX_LANGS * SAMPLE_DOCS pairs
    wanted = docs.sparkSession.createDataFrame([tuple(r) for r in ids], "lang string, doc_id long").dropna()
    piece = F.min(F.substring("text", 1, 4 * PIECE)).alias("text")  # one row of an id, however often it is there
    sample = rows.join(F.broadcast(wanted), ["lang", "doc_id"], "left_semi").groupBy("lang", "doc_id").agg(piece)
    parts: dict[str, list[tuple[int, str]]] = {}
    for lang, doc_id, text in sample.collect():  # at most SAMPLE_DOCS pieces per language
        parts.setdefault(lang, []).append((doc_id, letters(text)[:PIECE]))
    out = {}
    for lang in sorted(parts):
        texts = list(dict.fromkeys(t for _, t in sorted(parts[lang])))
        out[lang] = " ".join(texts).encode()[-DICT_BYTES:]
    return {k: v for k, v in out.items() if len(v) >= 8}


def _compressors(model: dict[str, bytes]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang, data in model.items():
        held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=LEVEL)
        out.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=False,
                                                   write_content_size=False, write_dict_id=False)))
    return out


def classify(text: str | None, tools: list[tuple[str, zstandard.ZstdCompressor]]) -> tuple[str, float, bool]:
    """Language, score between 0 and 1, and whether the decision is rejected."""
    body = letters(text).encode()
    if not body or not tools:
        return "und", 0.0, True
    blocks = [body[i : i + BLOCK] for i in range(0, len(body), BLOCK)]
    sizes = [(sum(len(tool.compress(b)) for b in blocks), lang) for lang, tool in tools]
    best, lang = min(sizes)
    score = 1.0 / sum(2.0 ** (-min(200.0, (size - best) / NARROW_BYTES)) for size, _ in sizes)
    others = sorted(size for size, name in sizes if name != lang)
    margin = (others[0] - best) / others[0] if others else 1.0
    return lang, score, margin < MIN_MARGIN


OUT = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


def _predict(model: dict[str, bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _compressors(model)
        for batch in batches:
            got = [classify(text.as_py(), tools) for text in batch.column(2)]
            lang, score, rejected = (list(x) for x in zip(*got, strict=True)) if got else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                 pa.array(rejected, pa.bool_())], names=[c.split()[0] for c in OUT.split(", ")])

    return run


def predict(docs: DataFrame, model: dict[str, bytes]) -> DataFrame:
    rows = ship(docs).select(F.col("doc_id").cast("long"), is_held_out().alias("held_out"), "text")
    return rows.mapInArrow(_predict(model), OUT)


def identify(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, rejected)`` for every row of ``docs(doc_id, text, lang)``."""
    return predict(docs, train(docs))
