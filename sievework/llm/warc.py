"""WARC archives with a two-level capture index.

Each page becomes one gzip member of an archive: a response, or a revisit where a page of a smaller id has the same
payload.  The index has two levels: capture lines sorted by the reversed-host key of their URL in compressed blocks,
and a sparse directory with the first key of each block.  A look-up binary-searches the directory, range-reads the
blocks that can hold the key, then range-reads the records those lines name.

Archives and index blocks are files in a folder that all executors share, written through pyarrow's file systems (any
URI those open).  A task that runs again writes new files; the capture table names the files of the run that counted.
Null html is the empty payload; empty payloads are equal like any others.  A null URL has the key ``)/`` and no target
header.  Repeated rows are written as often as they occur; those with the smallest page_id are all responses.  An empty
table gives empty tables.  Only the key, url and html columns are read.
"""
from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks_for, long_key, materialise, scratch_dir

ARCHIVE_BYTES = 64 << 20
BLOCK_LINES = 3000
#: Directory entries (one for 3000 captures) that are broadcast; of a larger directory the files are, one for FILE_BLOCKS
#: entries at least and never more than this, and the entries of a file are joined by its name.
MAX_DIRECTORY = 200_000
FILE_BLOCKS = 20
DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """Reversed host, then the path and query: http://a.b.org/x?y becomes org,b,a)/x?y.  No scheme, port or fragment."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?|#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/:?]*)", 1))
    rest = F.regexp_replace(bare, r"^[^/?]*", "")
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def _record(page_id: int, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{i} {digest}')}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-Id: {page_id}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if first is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {name(first)}", f"X-Refers-To-Page: {first}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """The headers and the block of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    size = int(headers["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("record is cut short")
    return headers, rest[:size]


def described(record: bytes) -> tuple[int, int, str, str, int | None]:
    """page_id, payload bytes, digest, type and the page referred to; a response's payload is held against its digest."""
    headers, block = parse(record)
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != digest or len(payload) != size:
            raise ValueError(f"payload of page {headers['X-Page-Id']} does not match its digest")
    first = headers.get("X-Refers-To-Page")
    return int(headers["X-Page-Id"]), size, digest, headers["WARC-Type"], None if first is None else int(first)


def _files(folder: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    return store, path


def write(pages: DataFrame, folder: str, min_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the archives; the capture table (url_key, page_id, file, start, length) comes back, materialised.

    Payloads of fewer than ``min_bytes`` bytes never become revisits.
    """
    own = pages.select(long_key(pages, key).alias("page_id"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("sha1", F.sha1("payload"))
    ids = own.filter(F.octet_length("payload") >= min_bytes).select("page_id", "sha1")
    first = ids.groupBy("sha1").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("first < last").drop("last")
    later = ids.join(first, "sha1").filter("page_id > first").distinct()
    dealt = own.join(later, ["page_id", "sha1"], "left").select("page_id", "url", url_key(F.col("url")).alias("url_key"), "payload", "first")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _files(folder)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for page_id, target, k, payload, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                data = _gzip(_record(page_id, target, payload, digest, before))
                out.write(data)
                rows.append((k, page_id, name, at, len(data)))
                at += len(data)
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["url_key", "page_id", "file", "start", "length"])
        if out is not None:
            out.close()

    store, path = _files(folder)
    store.create_dir(path, recursive=True)
    return materialise(dealt.mapInArrow(archive, "url_key string, page_id long, file string, start long, length long"))


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write the sorted capture lines in compressed blocks; the directory (first_key, last_key, file, start, length) comes
    back, materialised.  A key's captures go on by page_id, so a key of very many captures fills several blocks."""
    total = captures.count()
    parts = blocks_for(total, max(FILE_BLOCKS, blocks_for(total, MAX_DIRECTORY * block_lines)) * block_lines)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _files(folder)
        name, out, at, lines, keys = f"{uuid.uuid4().hex}.idx.gz", None, 0, [], []

        def flush():
            nonlocal out, at, lines, keys
            if out is None:
                out = store.open_output_stream(f"{path}/{name}", compression=None)
            data = _gzip("\n".join(lines).encode())
            out.write(data)
            row = pa.record_batch([pa.array([keys[0]]), pa.array([keys[-1]]), pa.array([name]), pa.array([at], pa.int64()), pa.array([len(data)], pa.int64())], names=["first_key", "last_key", "file", "start", "length"])
            at, lines, keys = at + len(data), [], []
            return row

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys.append(row[0])
                lines.append("\t".join([row[0].replace("\t", "%09").replace("\n", "%0A"), *map(str, row[1:])]))
                if len(lines) == block_lines:
                    yield flush()
        if lines:
            yield flush()
        if out is not None:
            out.close()

    ranged = captures.select("url_key", "page_id", "file", "start", "length").repartitionByRange(parts, "url_key", "page_id").sortWithinPartitions("url_key", "page_id")
    return materialise(ranged.mapInArrow(blocks, "first_key string, last_key string, file string, start long, length long"))


def _covering(wanted: DataFrame, entries: list[tuple], schema: str) -> DataFrame:
    """url_key and what follows the keys of each entry (first, last, ...) that can hold it, by binary search; the entries, sorted,
    overlap at their ends only."""
    shared = wanted.sparkSession.sparkContext.broadcast(sorted(entries))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = shared.value
        lasts, firsts = [x[1] for x in listed], [x[0] for x in listed]
        for batch in batches:
            rows = [(k, *listed[i][2:]) for k in batch.column(0).to_pylist() for i in range(bisect_left(lasts, k), bisect_right(firsts, k))]
            if rows:
                kinds = [pa.string(), *(pa.int64() if isinstance(v, int) else pa.string() for v in rows[0][1:])]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split(" ")[0] for x in schema.split(", ")])

    return wanted.mapInArrow(search, schema)


def look_up(keys: DataFrame, directory: DataFrame, folder: str, max_directory: int | None = None) -> DataFrame:
    """keys: url_key.  One row per capture of the keys: url_key, page_id, payload_bytes, payload_digest, record_type, refers_to.

    Each key leads to the blocks that can hold it; each of those is read once, by one task, with the keys wanted from it.
    """
    wanted = keys.select("url_key").distinct()
    blocks = directory.count()
    if blocks <= (MAX_DIRECTORY if max_directory is None else max_directory):
        hits = _covering(wanted, [(r.first_key, r.last_key, r.file, r.start, r.length) for r in directory.collect()], "url_key string, file string, start long, length long")
    else:  # a third level: the files' ranges are searched, then the few entries of the file
        files = directory.groupBy("file").agg(F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key")).collect()
        near = _covering(wanted, [(r.first_key, r.last_key, r.file) for r in files], "url_key string, file string")
        hits = near.join(directory, "file").filter("url_key between first_key and last_key").select("url_key", "file", "start", "length")
    # few bytes name many records to read, so the number of tasks follows the blocks, not the bytes
    by_block = hits.repartition(blocks_for(blocks, 4), "file", "start", "length").groupBy("file", "start", "length").agg(F.collect_set("url_key").alias("keys"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _files(folder)
        held: dict = {}

        def span(name: str, start: int, length: int) -> bytes:
            if name not in held:
                if len(held) >= 64:
                    held.pop(next(iter(held))).close()
                held[name] = store.open_input_file(f"{path}/{name}")
            return held[name].read_at(length, start)

        for batch in batches:
            for name, start, length, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                asked, rows = {k.replace("\t", "%09").replace("\n", "%0A"): k for k in keys}, []
                for line in zlib.decompress(span(name, start, length), 31).decode().split("\n"):
                    k, _, file, at, size = line.split("\t")
                    if k in asked:
                        rows.append((asked[k], *described(zlib.decompress(span(file, int(at), int(size)), 31))))
                if rows:
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["url_key", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        for f in held.values():
            f.close()

    return by_block.mapInArrow(read, "url_key string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def new_folder(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/sievework-warc-{uuid.uuid4().hex}"
