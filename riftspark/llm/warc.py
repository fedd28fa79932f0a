"""Operator 8: WARC archives, index first.

Writing: each task writes its rows as records of compressed WARC files in a shared folder and gives a row for each record,
with file, offset, length, URL and digest; these rows are the index, kept as a table. Records whose payload an
earlier record has (the smallest id of that digest) are revisits without payload.

Reading: the wanted rows of the index are sorted by file and offset, neighbours that lie close are coalesced into
one read, and the records are parsed out of what was read; payloads are checked against their digests.

A file gets its final name when it is complete, and only files that the index names count. A task that is run again writes
under a new name. Files are opened with pyarrow.fs by the folder's URI (file, hdfs, s3, gs).

Edge cases: a null payload is empty; a null or unprintable URL is percent-encoded in the record and whole in the index;
payloads below ``least`` bytes are always responses; rows of the smallest id are all responses, even if that id is
repeated; a null id never owns a payload, unless all ids of the payload are null, which are responses then; an empty
table gives an empty index. The result has only its own columns, whatever the input's are.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DATE = "2024-01-01T00:00:00Z"
#: Bytes after which a task begins its next file.
FILE_BYTES = 1 << 30
#: Reads closer than GAP are one, up to READ bytes (a longer record is read whole).
GAP, READ = 64 << 10, 8 << 20
#: Tasks that read; at 100 TB, each has 1 GB of archives, read in parts of READ bytes.
MOST_TASKS = 100_000
#: Digests with copies up to which they are broadcast, at about 100 bytes each.
BROADCAST_DIGESTS = 300_000

INDEX = "file string, offset long, length long, page_id long, url string, digest string, payload_bytes long, record_type string, refers_to long"


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _id(page_id: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}:{digest}'.encode()).digest())}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, kind: str, refers_to: int | None) -> bytes:
    """A record: WARC header, then HTTP header and, for responses, the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_id(page_id, digest)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="%/:?#[]@!$&'()*+,;=~-._"))
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], int, bytes]:
    """The WARC header's fields, the HTTP header's Content-Length, and the payload that the record holds."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:40]!r}")
    found = dict(x.split(": ", 1) for x in lines)
    n = int(found["Content-Length"])
    block, end = rest[:n], rest[n:]
    if len(block) != n or end != b"\r\n\r\n":
        raise ValueError("the record's length doesn't fit its header")
    http, _, payload = block.partition(b"\r\n\r\n")
    return found, int(re.search(rb"Content-Length: (\d+)", http)[1]), payload


def plan(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 100) -> DataFrame:
    """Each page with its digest, its size, the record's type and what it refers to. Payloads aren't shuffled while the
    digests that have copies are few enough to broadcast."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), common.text_of(html).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    own = rows.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared = common.keep(own.where("n > 1 and first is not null").select("digest", "first"), "shared")
    found = rows.join(common.maybe_broadcast(shared, BROADCAST_DIGESTS), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return found.select("page_id", "url", "payload", "payload_bytes", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def write(planned: DataFrame, folder: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the records of plan() and return their index, kept."""
    common.bounded_batches(planned.sparkSession)
    folder = folder or f"{common.scratch_dir(planned.sparkSession)}/warc-{uuid.uuid4().hex[:12]}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = opened(folder)
        fs.create_dir(at, recursive=True)
        out, name, offset = None, "", 0

        def close() -> None:
            out.close()
            fs.move(f"{at}/.{name}", f"{at}/{name}")

        try:
            for batch in batches:
                rows: list[tuple] = []
                columns = [batch.column(c) for c in ("page_id", "url", "payload", "payload_bytes", "digest", "record_type", "refers_to")]
                for row in zip(*columns, strict=True):
                    page_id, url, payload, size, digest, kind, refers = (x.as_py() for x in row)
                    if out is None:
                        name, offset = f"part-{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{at}/.{name}", compression=None)
                    member = gzip.compress(record(page_id, url, payload, digest, size, kind, refers), 3, mtime=0)
                    out.write(member)
                    rows.append((name, offset, len(member), page_id, url, digest, size, kind, refers))
                    offset += len(member)
                    if offset >= file_bytes:
                        close()
                        out = None
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                close()

    index = common.keep(planned.mapInArrow(run, INDEX), "warc-index")
    index.archives = folder
    return index


def read(wanted: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records of the wanted rows (file, offset, length) of an index, read by coalesced sorted ranges.

    Rows go to tasks by file and a stretch of READ bytes, so that one large file is read by many tasks. The number of tasks
    follows from the bytes to read, not from the size of the index's rows.
    """
    stretch = F.floor(F.col("offset") / READ)
    total = wanted.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(wanted.sparkSession.sparkContext.defaultParallelism, -(-2 * total // READ))
    rows = wanted.select("file", "offset", "length").repartition(min(tasks, MOST_TASKS), "file", stretch).sortWithinPartitions("file", "offset")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if payloads else "")

    def records(stream, reads: list[tuple[int, int]]) -> Iterator[tuple]:
        first, (at, n) = reads[0][0], reads[-1]
        stream.seek(first)
        whole = stream.read(at + n - first)
        for at, n in reads:
            found, size, payload = parse(zlib.decompress(whole[at - first : at - first + n], 31))
            digest, kind = found["WARC-Payload-Digest"].removeprefix("sha256:"), found["WARC-Type"]
            if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                raise ValueError(f"the payload at {at} doesn't have its digest")
            page, refers = found.get("X-Page-ID"), found.get("X-Refers-To-Page-ID")
            yield (int(page) if page else None, found.get("WARC-Target-URI"), size, digest, kind, int(refers) if refers else None, *([payload if kind == "response" else None] if payloads else []))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = opened(folder)
        name, stream, reads, out = None, None, [], []
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads

        def flush() -> pa.RecordBatch | None:
            if not out:
                return None
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])
            out.clear()
            return batch

        for batch in batches:
            for file, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                new = file != name
                if reads and (new or offset - sum(reads[-1]) > GAP or offset + length - reads[0][0] > READ):
                    out.extend(records(stream, reads))
                    reads = []
                    if got := flush():
                        yield got
                if new:
                    if stream:
                        stream.close()
                    name, stream = file, fs.open_input_file(f"{at}/{file}")
                reads.append((offset, length))
        if reads:
            out.extend(records(stream, reads))
            stream.close()
            yield flush()

    return rows.mapInArrow(run, schema)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    """Write every page to archives and read all records back through the index."""
    index = write(plan(common.read_table(spark, sf_dir, "pages")))
    return read(index, index.archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, p.payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
