"""WARC archives from a deterministic sharded writer, and their reader.

Pages are cut into shards by ranges of ``page_id`` that hold about ``SHARD_BYTES`` of payload; the cuts
come from exact sums per range, so they are the same in every run. A task writes a shard's records in
order, each as a gzip member without a time stamp, and begins a new file when the compressed size
passes ``ROLL_BYTES``. Headers are made from the page alone and digests from the payload. A file is
written under a temporary name and renamed when it is complete; the manifest, written by Spark, lists
the files that belong to the archive with sizes, record counts and SHA-256. A task that runs again
writes the same bytes under the same names.

Of records with equal payloads, the one with the largest ``page_id`` is the response and the others
are revisits that refer to it.

Cases: a null page is an empty payload. A null url is written as ``urn:page:<id>``. Rows without an
id come first and are read back without one; rows with the same id are records of their own. An empty table gives an empty manifest. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from momentloom.llm import files
from momentloom.llm.shared import folder, ship, stable

DATE = "2024-01-01T00:00:00Z"
SHARD_BYTES, ROLL_BYTES = 32 << 20, 32 << 20
RANGES = 1 << 14
READ_BYTES = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: name space of URLs
NO_ID = -(1 << 63)  # stands for a missing id inside the archives


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE_ID, f'page:{page_id}:{payload_digest}')}>"


def record(page_id: int, url: str | None, payload: bytes, payload_digest: str, response: int) -> bytes:
    """One record; ``response`` is the page that holds the payload."""
    target = url or f"urn:page:{page_id}"
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in target)
    headers = [
        ("WARC-Type", "response" if response == page_id else "revisit"),
        ("WARC-Record-ID", record_id(page_id, payload_digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{payload_digest}"),
        ("X-Page-ID", str(page_id)),
        ("X-Payload-Length", str(len(payload))),
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if response == page_id:
        block = http + payload
    else:
        block = http
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(response, payload_digest)), ("X-Refers-To-Page", str(response))]
    headers += [
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member that depends on ``data`` alone."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Roller:
    """Writes the files of a task, one after the other."""

    def __init__(self, path: str, roll_bytes: int):
        self.store, self.root = files.open_store(path)
        self.store.create_dir(self.root, recursive=True)
        self.roll_bytes, self.done, self.out = roll_bytes, [], None

    def write(self, shard: int, page_id: int, data: bytes) -> None:
        if self.out is not None and (shard != self.shard or self.size >= self.roll_bytes):
            self.close()
        if self.out is None:
            self.number = self.number + 1 if getattr(self, "shard", None) == shard else 0
            self.shard, self.size, self.records, self.first, self.hash = shard, 0, 0, page_id, hashlib.sha256()
            self.name = f"pages-{shard:08d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.root}/.{self.name}.{uuid.uuid4().hex}"
            self.out = self.store.open_output_stream(self.temporary, compression=None)
        self.out.write(data)
        self.hash.update(data)
        self.size, self.records, self.last = self.size + len(data), self.records + 1, page_id

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None
            files.commit(self.store, self.temporary, f"{self.root}/{self.name}")
            self.done.append({"file": self.name, "records": self.records, "bytes": self.size, "sha256": self.hash.hexdigest(),
                              "first_page": self.first, "last_page": self.last})


MANIFEST = "file string, records long, bytes long, sha256 string, first_page long, last_page long"
_MANIFEST = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()),
                       ("first_page", pa.int64()), ("last_page", pa.int64())])


def _write(path: str, roll_bytes: int):
    """Writes pages that come in order, each after the note that says which page is its response."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, note = _Roller(path, roll_bytes), None
        for batch in batches:
            for row in range(batch.num_rows):
                shard, page_id, sha, response, url, html = (batch.column(i)[row].as_py() for i in range(6))
                if html is None:
                    note = (page_id, sha, response)
                    continue
                if note is None or note[:2] != (page_id, sha):
                    raise ValueError(f"page {page_id} came without its note")
                payload = html.encode()
                roller.write(shard, page_id, member(record(page_id, url, payload, digest(payload), note[2])))
        roller.close()
        if roller.done:
            yield pa.RecordBatch.from_pylist(roller.done, schema=_MANIFEST)

    return run


def _cuts(keys: DataFrame, shard_bytes: int) -> tuple[DataFrame, Column]:
    """``(at, shard)`` for at most ``RANGES`` ranges of ids, and the range of a page."""
    low, high = keys.where(F.col("page_id") != NO_ID).agg(F.min("page_id"), F.max("page_id")).first()
    low, high = (0, 0) if low is None else (low, high)
    width = max(1, -(-(high - low + 1) // RANGES))
    at = F.when(F.col("page_id") == NO_ID, 0).otherwise(F.floor((F.col("page_id") - F.lit(low)) / F.lit(width))).cast("long")
    sums = keys.groupBy(at.alias("at")).agg(F.sum("bytes").alias("held"))
    before = F.sum("held").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("held")
    return stable(sums.select("at", F.floor(before / F.lit(shard_bytes)).cast("long").alias("shard"))), at


def write_archives(pages: DataFrame, path: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write ``pages(page_id, url, html)`` to the folder ``path`` and return the manifest.

    Which page holds a payload is found on digests. That note and the page itself meet in the
    writer, in one sort, so pages are shuffled once.
    """
    html = F.coalesce("html", F.lit(""))
    rows = ship(pages).select(F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("page_id"), "url", html.alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    keys = stable(rows.select("page_id", "sha", F.octet_length("html").cast("long").alias("bytes")))
    holders = keys.groupBy("sha", "bytes").agg(F.max("page_id").alias("response"))
    cuts, at = _cuts(keys, shard_bytes)
    n_shards = (cuts.agg(F.max("shard")).first()[0] or 0) + 1
    notes = keys.join(holders, ["sha", "bytes"]).select("page_id", "sha", "response").distinct()
    columns = ["page_id", "sha", "response", "url", "html"]
    both = rows.withColumn("response", F.lit(None).cast("long")).select(columns).unionByName(
        notes.withColumns({"url": F.lit(None).cast("string"), "html": F.lit(None).cast("string")}).select(columns))
    dealt = both.withColumn("at", at).join(F.broadcast(cuts), "at").select("shard", *columns)
    order = ["shard", "page_id", "sha", F.col("html").isNotNull(), "url"]
    dealt = dealt.repartitionByRange(n_shards, "shard").sortWithinPartitions(*order)
    manifest = dealt.mapInArrow(_write(path, roll_bytes), MANIFEST)
    manifest.write.parquet(f"{path}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{path}/manifest")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of a gzip stream, member by member."""
    pending = b""
    while True:
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            data = pending or stream.read(READ_BYTES)
            pending = b""
            if not data:
                if parts:
                    raise EOFError("an archive ends inside a record")
                return
            parts.append(unpacker.decompress(data))
        pending = unpacker.unused_data
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        first, *fields = head.decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(f.split(": ", 1) for f in fields)
        yield headers, rest[: int(headers["Content-Length"])]


def _known(number: str | None) -> int | None:
    return None if number is None or int(number) == NO_ID else int(number)


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"


def _read(path: str, with_html: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = files.open_store(path)
        names = [c.split()[0] for c in READ.split(", ")]
        schema = pa.schema([(n, t) for n, t in zip(names, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for headers, block in records(stream):
                        payload = block.partition(b"\r\n\r\n")[2]
                        kind, told = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and digest(payload) != told:
                            raise ValueError(f"{name}: payload and digest differ for page {headers['X-Page-ID']}")
                        refers = headers.get("X-Refers-To-Page")
                        rows.append({
                            "page_id": _known(headers["X-Page-ID"]), "url": headers["WARC-Target-URI"],
                            "payload_bytes": len(payload) if kind == "response" else int(headers["X-Payload-Length"]),
                            "payload_digest": told, "record_type": kind, "refers_to": _known(refers),
                            "html": payload.decode() if with_html and kind == "response" else None})
                        held += len(payload) if with_html else 200
                        if held >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def read_archives(spark: SparkSession, path: str, with_html: bool = True) -> DataFrame:
    """The records of all files that the manifest lists, one task per file and no more in memory than
    a record and a batch."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    n = max(1, min(manifest.count(), 10_000))
    listed = ship(manifest).select("file").repartition(n, "file")
    return listed.mapInArrow(_read(path, with_html), READ)


def archive(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to new archives in the shared folder and read them back: ``(page_id,
    payload_bytes, payload_digest, record_type, refers_to)`` for every row."""
    path = folder(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path, with_html=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
