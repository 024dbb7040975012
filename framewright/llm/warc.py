"""WARC archives with an index written first, read back by coalesced byte ranges.

Each task writes files of its own, a gzip member per record, and returns an index
row per record: file, offset, length, URL and payload digest. The index is what
names a file, so what a lost or repeated attempt leaves behind is never read.
Selected records are sorted by file and offset; ranges that lie close together
are read at once.
"""

from __future__ import annotations

import base64
import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm import files
from framewright.llm.storage import new_path, stage
from framewright.llm.text_expr import whole

MIN_REVISIT_BYTES = 0  # records with smaller payloads are all written in full
MAX_FILE_BYTES = 1 << 29  # a task starts a new file beyond this
MAX_GAP = 1 << 16  # bytes between two records that are read over rather than sought
MAX_READ = 8 << 20  # bytes of one coalesced read, if it holds more than one record
READ_ROWS = 1024  # neighbouring records that one task reads
SALTS = 16  # tasks over which the records of one payload are dealt
DATE = "1970-01-01T00:00:00Z"  # the tables have no time of capture
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 1

_INDEX = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
                    ("payload_digest", pa.string()), ("record_type", pa.string()), ("place", pa.int64())])
INDEX_DDL = "page_id BIGINT, url STRING, file STRING, offset BIGINT, length BIGINT, payload_digest STRING, record_type STRING, place BIGINT"


def _uri(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record, not compressed; a revisit carries the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(page_id)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_uri(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields and payload of a record; the digest of a payload that is there is computed again."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit:
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != digest or len(payload) != int(told["Content-Length"]):
            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    def page(x):
        return int(x[10:-1]) if x and x[10:-1] else None
    return {"page_id": page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
            "payload_bytes": int(told["Content-Length"]), "payload_digest": digest, "refers_to": page(fields.get("WARC-Refers-To")),
            "payload": None if revisit else payload}


def _with_originals(pages: DataFrame, least: int) -> DataFrame:
    """``pages(page_id, url, html)`` with digest (hex) and refers_to, by the smallest page_id of each payload."""
    pages = pages.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    several = pages.where((F.octet_length("html") >= least) & F.col("page_id").isNotNull()).groupBy("digest") \
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # The pages of one payload are dealt to several tasks; the right side has a row per payload.
    several = several.select(F.col("digest").alias("d"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")).alias("salt"))
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS))
    out = pages.withColumn("s", salt).join(several, (F.col("digest") == F.col("d")) & (F.col("s") == F.col("salt")), "left")
    revisit = F.col("first").isNotNull() & (F.col("page_id") != F.col("first"))
    return out.select("page_id", "url", "html", "digest", F.when(revisit, F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
               min_revisit_bytes: int = MIN_REVISIT_BYTES, max_file_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Write a record per row and return the index: page_id, url, file, offset, length, payload_digest,
    record_type and place (order of the records that one task wrote).

    Null html is an empty payload. Of rows with equal payloads of ``min_revisit_bytes`` at least the one
    with the smallest page_id is a response, others revisit it; rows that repeat that page_id, and rows
    with a null one, are responses too. A null URL is left out of the record. An empty table writes nothing.
    """
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), whole(F.col(f"`{html}`")).alias("html"))

    def write(batches):
        out, place = None, 0
        for batch in batches:
            found = []
            for i, u, text, digest, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))):
                if out is None:
                    name = files.unique_name(folder, "warc.gz")
                    out = files.Writer(name)
                b32 = base64.b32encode(bytes.fromhex(digest)).decode()
                at, n = out.write(gzip.compress(record(i, u, text.encode(), b32, first), LEVEL, mtime=0))
                found.append((i, u, name, at, n, b32, "response" if first is None else "revisit", place))
                place += 1
                if out.at >= max_file_bytes:
                    out.close()
                    out = None
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _INDEX.types)], schema=_INDEX)
        if out is not None:
            out.close()

    return stage(_with_originals(rows, min_revisit_bytes).mapInArrow(write, INDEX_DDL), "warc-index")


def coalesced(spans: list[tuple[int, int]], gap: int = MAX_GAP, most: int = MAX_READ) -> list[tuple[int, int, int]]:
    """Reads ``(start, end, spans in it)`` for sorted ``(offset, length)`` spans."""
    reads: list[tuple[int, int, int]] = []
    for at, n in spans:
        if reads and at - reads[-1][1] <= gap and max(at + n, reads[-1][1]) - reads[-1][0] <= most:
            start, end, count = reads.pop()
            reads.append((start, max(end, at + n), count + 1))
        else:
            reads.append((at, at + n, 1))
    return reads


def read_warc(index: DataFrame, payload: bool = True) -> DataFrame:
    """The records that the rows of an index select: page_id, url, record_type, payload_bytes,
    payload_digest, refers_to and, if asked for, payload (null for a revisit)."""
    types = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
             ("payload_digest", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payload
    schema = pa.schema(types)

    def read(batches):
        at, file = None, None
        for batch in batches:
            names, offsets, lengths = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
            row = 0
            while row < len(names):
                upto = row
                while upto < len(names) and names[upto] == names[row]:
                    upto += 1
                if names[row] != at:
                    if file:
                        file.close()
                    at, file = names[row], files.Reader(names[row])
                for start, end, count in coalesced(list(zip(offsets[row:upto], lengths[row:upto]))):
                    data = file.read(start, end - start)
                    found = [parse(gzip.decompress(data[offsets[k] - start:offsets[k] - start + lengths[k]])) for k in range(row, row + count)]
                    yield pa.RecordBatch.from_pydict({f.name: pa.array([x[f.name] for x in found], f.type) for f in schema}, schema=schema)
                    row += count
        if file:
            file.close()

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = index.select("file", "offset", "length", "place").repartition(parts, "file", F.floor(F.col("place") / READ_ROWS)).sortWithinPartitions("file", "offset")
    ddl = "page_id BIGINT, url STRING, record_type STRING, payload_bytes BIGINT, payload_digest STRING, refers_to BIGINT" + ", payload BINARY" * payload
    return near.select("file", "offset", "length").mapInArrow(read, ddl)


def select_records(index: DataFrame, condition: Column) -> DataFrame:
    """The index rows to read, by URL, digest or any other column of the index."""
    return index.where(condition)


def op6_warc(pages: DataFrame) -> DataFrame:
    """The records of all pages, as read back from the archives. Edge cases as in ``write_warc``; an empty
    table gives no row."""
    index = write_warc(pages, new_path(pages.sparkSession, "warc"))
    return read_warc(index, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
