"""WARC archives: a writer with revisit records and a reader that splits files anywhere.

Every record is a gzip member of its own. A reading task gets a byte range of a file, looks
for the gzip magic, accepts a candidate only if it decodes to a WARC header, and owns the
records that start inside its range, to their end wherever that lies.

Defined results
* null html: an empty payload; null url: no target URI; null page_id: an empty record id,
  read back as null, last among equal payloads.
* Of equal payloads of at least `least` bytes, all rows with the smallest page_id are
  responses (so repeated rows are all kept as such), the others revisit that page.
* Empty table: no file, no row. Extra columns are ignored.
* Bytes between members, truncated members and members that aren't WARC are skipped. A
  complete WARC member stored verbatim inside another's payload counts as a record only if a
  range starts between the outer member's start and the inner one.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.common import attach, new_folder, written

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 8 << 20
LEAST_REVISIT = 100
BUFFER = 1 << 20
STEP = 1 << 15
MANIFEST = "path string, bytes long, records long"
RECORD = (
    "path string, offset long, page_id long, url string, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, payload binary"
)
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to (null for responses)."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        "page_id",
        "url",
        html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"),
        F.sha2(html.cast("binary"), 256).alias("payload_digest"),
    )
    copies = (
        rows.filter(F.col("payload_bytes") >= least)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("response_id"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
    )
    keyed = rows.withColumn("digest_key", F.when(F.col("payload_bytes") >= least, F.col("payload_digest")))
    copies = copies.withColumnRenamed("payload_digest", "digest_key")
    joined = attach(keyed, copies, "digest_key", "copies", ["page_id"])
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("response_id")), F.col("response_id"))
    return joined.withColumn("refers_to", refers).drop("digest_key", "response_id")


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One uncompressed WARC record; a revisit carries the digest and length, not the payload."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head.append(f"WARC-Refers-To: {name(refers_to)}")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    block = HTTP + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(rows: DataFrame, folder: str) -> DataFrame:
    """Write the rows of with_revisits(), one file a task; returns the table of files.

    Each attempt of a task writes a file of its own name, and only the files of attempts
    that succeeded are in the returned (written) table, so lost or repeated tasks do no harm.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name, size, count, out = f"{uuid.uuid4().hex}.warc.gz", 0, 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                page_id, url, html, digest, refers_to = row
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(record(page_id, url, html.encode(), digest, refers_to)) + packer.flush()
                if out is None:
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                out.write(member)
                size, count = size + len(member), count + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": [size], "records": [count]})

    narrow = rows.select("page_id", "url", "html", "payload_digest", "refers_to")
    return written(narrow.mapInArrow(write, MANIFEST), "warc-files")


class Bytes:
    """A file with random access through one buffer."""

    def __init__(self, file) -> None:
        self.file, self.start, self.held = file, 0, b""

    def read(self, at: int, n: int) -> bytes:
        if not self.start <= at <= at + n <= self.start + len(self.held):
            self.file.seek(at)
            self.start, self.held = at, self.file.read(max(n, BUFFER))
        return self.held[at - self.start : at - self.start + n]


def find_magic(data: Bytes, at: int, end: int) -> int | None:
    """The first place in [at, end) where a gzip header begins."""
    while at < end:
        piece = data.read(at, min(STEP, end - at) + len(MAGIC) - 1)
        if (found := piece.find(MAGIC)) >= 0:
            return at + found
        at += STEP
    return None


def decode(data: Bytes, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """Headers, block and end of the WARC member at `at`; None if there is none."""
    unpack, text, here = zlib.decompressobj(31), bytearray(), at
    while not unpack.eof:
        piece = data.read(here, STEP)
        if not piece:
            return None
        try:
            text += unpack.decompress(piece)
        except zlib.error:
            return None
        here += len(piece)
        if not b"WARC/1.".startswith(text[:7]):
            return None
    split = text.find(b"\r\n\r\n")
    if split < 0:
        return None
    lines = text[:split].decode("utf-8", "replace").split("\r\n")[1:]
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    length = headers.get("content-length", "")
    if "warc-type" not in headers or not length.isdigit() or split + 4 + int(length) > len(text):
        return None
    return headers, bytes(text[split + 4 : split + 4 + int(length)]), here - len(unpack.unused_data)


def members(data: Bytes, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """The records that start in [start, end)."""
    at: int | None = start
    while at is not None and at < end:
        at = find_magic(data, at, end)
        if at is not None:
            got = decode(data, at)
            if got is None:
                at += 1
            else:
                yield at, got[0], got[1]
                at = got[2]


def parsed(headers: dict[str, str], block: bytes, keep: bool) -> tuple:
    """The values of a record; a response's payload is checked against its digest."""
    number = lambda v: int(v[10:-1]) if v.startswith("<urn:page:") and v[10:-1].lstrip("-").isdigit() else None
    payload = block.partition(b"\r\n\r\n")[2]
    named = headers.get("warc-payload-digest", "").removeprefix("sha256:")
    size = int(headers.get("warc-payload-length") or len(payload))
    digest = named
    if headers["warc-type"] == "response":
        digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
        if named and named != digest:
            raise ValueError(f"payload of {headers.get('warc-record-id')} doesn't match its digest")
    return (
        number(headers.get("warc-record-id", "")),
        headers.get("warc-target-uri"),
        headers["warc-type"],
        number(headers.get("warc-refers-to", "")),
        size,
        digest,
        payload if keep and headers["warc-type"] == "response" else None,
    )


def read_warc(files: DataFrame, split_bytes: int = SPLIT_BYTES, keep_payload: bool = True) -> DataFrame:
    """All records of the files (path, bytes), read in ranges of `split_bytes`."""
    spark = files.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in schema]
        held: list[tuple] = []
        weight = 0
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_file(place) as file:
                    for offset, headers, block in members(Bytes(file), start, end):
                        held.append((path, offset, *parsed(headers, block, keep_payload)))
                        weight += len(block) * keep_payload + 200
                        if weight > 4 << 20:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(c, f.type) for c, f in zip(zip(*held), schema)], names=names
                            )
                            held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], names=names)

    schema = pa.schema(
        [
            ("path", pa.string()),
            ("offset", pa.int64()),
            ("page_id", pa.int64()),
            ("url", pa.string()),
            ("record_type", pa.string()),
            ("refers_to", pa.int64()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            ("payload", pa.binary()),
        ]
    )
    width = F.lit(split_bytes).cast("long")
    splits = files.filter("bytes > 0").select(
        "path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, width)).alias("start")
    )
    splits = splits.select("path", "start", F.least(F.col("start") + width, "bytes").alias("end"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return splits.repartition(tasks, "path", "start").mapInArrow(read, RECORD)


def archive(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages as archives in the shared folder and return the table of files."""
    return write_warc(with_revisits(pages), new_folder(spark, "warc"))
