"""WARC archives with an index of their records.

Writing: each task fills archive files in the shared folder, every record a gzip member of its own, and
emits an index row (file, offset, length, url, digest) per record. The index is cut from its lineage at
once, so no file is written twice; a task that is run again writes files of new names, and only those of
the attempt that succeeded are in the index.

Reading: the index rows of the wanted records are sorted by file and offset, neighbouring ranges are read
as one, and records are cut out of them.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edittide.llm.common import cut, removed, shared_dir

#: Bytes of an archive before the next one starts; gap that is read over; most bytes read at once.
ARCHIVE, GAP, READ = 256 << 20, 64 << 10, 8 << 20
EPOCH = "1970-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of bytes: 160 bits in four runs of 40."""
    digits = F.sha1(payload)
    part = lambda i: F.lpad(F.translate(F.conv(F.substring(digits, i * 10 + 1, 10), 16, 32), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), 8, "A")
    return F.concat(*[part(i) for i in range(4)])


def _record_id(page: int | None, digest: str) -> str:
    """The same for rows with the same page_id and payload only."""
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}:{digest}').urn}>"


def _clean(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _record(kind: str, page: int | None, url: str, digest: str, refers: int | None, target: str | None, payload: bytes) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page, digest)}", f"X-Page: {page}", f"WARC-Target-URI: {_clean(url)}", f"WARC-Date: {EPOCH}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers, digest)}", f"X-Refers-To-Page: {refers}"]
        head += [f"WARC-Refers-To-Target-URI: {_clean(target)}"] if target else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


_INDEX = "page_id long, url string, digest string, kind string, refers_to long, file string, offset long, length long"
_INDEX_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("kind", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _writer(folder: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, out, at = None, None, 0
        try:
            for b in batches:
                rows = []
                for page, url, html, digest, kind, refers, target in zip(*(c.to_pylist() for c in b.columns)):
                    data = _record(kind, page, url or "", digest, refers, target, (html or "").encode())
                    if out is None or at + len(data) > limit and at:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(data)
                    rows.append((page, url, digest, kind, refers, name, at, len(data)))
                    at += len(data)
                yield pa.RecordBatch.from_pylist([dict(zip(_INDEX_ARROW.names, r)) for r in rows], schema=_INDEX_ARROW)
        finally:
            if out is not None:
                out.close()

    return run


def write(pages: DataFrame, folder: str, least: int = 0, limit: int = ARCHIVE) -> DataFrame:
    """Writes a record per row of `pages` (page_id, url, html) below `folder`, a URI, and returns the index.

    Payload: the html in UTF-8, a null as empty. Of rows with equal payloads of at least `least` bytes the smallest
    page_id is a response and the others are revisits of it; smaller payloads are all responses. Rows that repeat the response's
    page_id and payload are responses too. A row without page_id is a response only if no row with one has its payload.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"digest": base32_sha1(F.encode("html", "utf-8")), "bytes": F.octet_length("html")})
    firsts = rows.groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("target"))
    who = rows.select("page_id", "digest", "bytes").distinct().join(firsts, ["digest", "bytes"])
    again = (F.col("bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("first"))
    who = who.select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("refers_to"), F.when(again, F.col("target")).alias("target"))
    told = rows.join(who, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("digest") == F.col("_d")))
    told = told.select("page_id", "url", F.when(F.col("kind") == "response", F.col("html")).alias("html"), "digest", "kind", "refers_to", "target")
    return cut(told.mapInArrow(_writer(folder, limit), _INDEX))


def _parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


_READ = "page_id long, url string, kind string, refers_to long, digest string, payload binary"
_READ_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("kind", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload", pa.binary())])


def ranges(rows: list[tuple[str, int, int]], gap: int = GAP, most: int = READ) -> Iterator[tuple[str, int, int, int, int]]:
    """Runs (file, start, end, first row, end row) of rows (file, offset, length) sorted by file and offset."""
    i = 0
    while i < len(rows):
        name, start, length = rows[i]
        end, j = start + length, i + 1
        while j < len(rows) and rows[j][0] == name and rows[j][1] <= end + gap and max(end, rows[j][1] + rows[j][2]) - start <= most:
            end = max(end, rows[j][1] + rows[j][2])
            j += 1
        yield name, start, end, i, j
        i = j


def _reader(folder: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        number = lambda x: None if x == "None" else int(x)
        held: tuple[str, object] | None = None
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns)))
            for name, start, end, i, j in ranges([r[:3] for r in rows]):
                if held is None or held[0] != name:
                    if held is not None:
                        held[1].close()
                    held = (name, store.open_input_file(f"{root}/{name}"))
                data, out = held[1].read_at(end - start, start), []
                for _, offset, length, url in rows[i:j]:
                    raw = zlib.decompress(data[offset - start : offset - start + length], 31)
                    fields, payload = _parse(raw)
                    kind = fields["WARC-Type"]
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{name} at {offset}: the payload does not have its digest")
                    out.append((number(fields["X-Page"]), url, kind, number(fields.get("X-Refers-To-Page", "None")), digest, payload if payloads else len(payload).to_bytes(8, "big")))
                yield pa.RecordBatch.from_pylist([dict(zip(_READ_ARROW.names, r)) for r in out], schema=_READ_ARROW)
        if held is not None:
            held[1].close()

    return run


def read(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """(page_id, url, kind, refers_to, digest, payload) of the index rows; a response whose payload does not have its digest raises.

    Without `payloads` the column holds the payload's length in eight bytes.
    """
    rows = index.select("file", "offset", "length", "url").repartition("file").sortWithinPartitions("file", "offset")
    return rows.mapInArrow(_reader(folder, payloads), _READ)


def round_trip(pages: DataFrame, keep: bool = False) -> DataFrame:
    """Writes all pages, reads them back, and removes the archives unless they are to be kept: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    folder = f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    index = write(pages, folder)
    got = cut(read(index, folder, payloads=False).withColumn("n", F.conv(F.hex("payload"), 16, 10).cast("long")).drop("payload"))
    if not keep:
        removed(pages.sparkSession, folder)
    sizes = got.filter("kind = 'response'").select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), F.col("n").alias("_n")).distinct()
    full = got.join(sizes, F.col("refers_to").eqNullSafe(F.col("_p")) & (F.col("digest") == F.col("_d")) & (F.col("kind") == "revisit"), "left")
    return full.select("page_id", F.coalesce("_n", "n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to", "url")
