"""Web archives and a two-level capture index.

Pages become WARC records, each a gzip member of its own; one of each group of equal payloads is kept as a response,
the others refer to it. The index sorts captures by reversed-host URL keys into compressed blocks. Every part of it
ends with a sparse directory of its blocks; a master list, one row for each part, is small. A look-up searches the
master list and a directory by bisection, reads one block by its range, and then one record by its range. All records
are read back in this way, responses and revisits; `captures` reads archives that have no index from front to back.

Files lie in the cluster's shared folder and are opened through pyarrow's file systems. Every attempt of a task
writes a file of a new name, and only rows of finished attempts name files, so a lost executor leaves no wrong rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import Workspace, input_partitions, skew_join

BLOCK_LINES = 1000
#: Parts of an index at most; the master list has one row for each.
MAX_PARTS = 1024
CHUNK = 1 << 20
#: Bytes of payloads in a batch of looked-up records, but for the last.
BATCH_BYTES = 8 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or a plain path."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class Ranges:
    """Reads files by ranges; those last used stay open."""

    KEPT = 32

    def __init__(self) -> None:
        self.open: OrderedDict[str, pa.NativeFile] = OrderedDict()

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path not in self.open:
            fs, p = opened(path)
            self.open[path] = fs.open_input_file(p)
            if len(self.open) > self.KEPT:
                self.open.popitem(last=False)[1].close()
        self.open.move_to_end(path)
        return self.open[path].read_at(length, offset)

    def close(self) -> None:
        while self.open:
            self.open.popitem()[1].close()


def read_range(path: str, offset: int, length: int) -> bytes:
    ranges = Ranges()
    try:
        return ranges.read(path, offset, length)
    finally:
        ranges.close()


def surt(url: str | None) -> str:
    """Key of a URL: host parts reversed, lower-cased and without www, then the path and query; no fragment.

    What has no host is its own key; null counts as empty."""
    text = (url or "").strip()
    try:
        x = urlsplit(text)
        host, port = (x.hostname or "").lower(), x.port
    except ValueError:
        return text
    if not host:
        return text
    host = re.sub(r"^www\d*\.", "", host)
    port = "" if port in (None, 80, 443) else f":{port}"
    return ",".join(reversed(host.split("."))) + port + ")" + (x.path or "/") + (f"?{x.query}" if x.query else "")


def capture_key(url: str | None, page_id: int | None) -> bytes:
    """Sort key of a capture: the URL's key, then the page's id in order."""
    clean = "".join(c if c > " " and c != "\x7f" else quote(c) for c in surt(url))
    number = "~" if page_id is None else f"{page_id + (1 << 63):020d}"
    return f"{clean} {number}".encode("utf-8", "surrogatepass")


def base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else quote(c) for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: tuple[int | None, str | None] | None) -> bytes:
    """One WARC record as a gzip member. With refers_to, (page id, URL), it is a revisit without payload."""
    named = lambda i: f"<urn:page:{'' if i is None else i}>"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {named(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{base32(payload)}")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {named(refers_to[0])}"]
        if refers_to[1] is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_header(refers_to[1])}")
        block = http
    else:
        block = http + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + _END + block + _END) + z.flush()


class Record:
    """A parsed record: its headers and, for a response, its payload."""

    def __init__(self, data: bytes):
        head, _, rest = data.partition(_END)
        first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        self.headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        block = rest[: int(self.headers["content-length"])]
        if len(block) != int(self.headers["content-length"]):
            raise ValueError("a WARC record ends early")
        self.type = self.headers["warc-type"]
        self.payload = block.partition(_END)[2] if self.type == "response" else None
        self.page_id = self._id("warc-record-id")
        self.refers_to = self._id("warc-refers-to")
        self.url = self.headers.get("warc-target-uri")
        self.refers_url = self.headers.get("warc-refers-to-target-uri")
        self.digest = self.headers["warc-payload-digest"].removeprefix("sha1:")

    def _id(self, name: str) -> int | None:
        number = self.headers.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(number) if number else None


def read_record(path: str, offset: int, length: int) -> Record:
    return Record(gzip.decompress(read_range(path, offset, length)))


def read_archive(path: str) -> Iterator[tuple[int, int, Record]]:
    """(offset, length, record) of each record of an archive, read in chunks; one record is in memory at a time."""
    fs, p = opened(path)
    with fs.open_input_stream(p, compression=None) as f:
        at, data = 0, b""
        while data or (data := f.read(CHUNK)):
            z, out, used = zlib.decompressobj(31), [], 0
            while True:
                out.append(z.decompress(data))
                if z.eof:
                    used += len(data) - len(z.unused_data)
                    data = z.unused_data
                    break
                used += len(data)
                data = f.read(CHUNK)
                if not data:
                    raise ValueError("an archive ends early")
            yield at, used, Record(b"".join(out))
            at += used


CAPTURE = "page_id long, url string, key binary, file string, offset long, length long, record_type string, digest string, payload_bytes long, refers_to long, refers_url string"


_CAPTURED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("key", pa.binary()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("refers_url", pa.string())])
#: Captures in a batch of rows.
ROWS = 1000


def _captured(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_CAPTURED)], schema=_CAPTURED)


def steady(ws: Workspace, df: DataFrame) -> DataFrame:
    """`df` if it is read straight from files or the driver, so that its rows have the same places each time; else a
    written copy."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    kinds = {re.sub(r"^[\s:+\-]*", "", line).split(" ")[0].split("[")[0] for line in plan.splitlines() if line.strip()}
    return df if kinds <= {"Project", "Filter", "Relation", "LocalRelation", "LogicalRDD"} else ws.table(df, "pages")


def write_archives(ws: Workspace, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """A row of CAPTURE for each record written: archives hold a record for each row of `pages` (page_id, url, html), one
    archive for each task.

    Of rows with equal payloads of at least `min_bytes` bytes, that with the smallest page_id (of repeated rows one)
    is a response and the others are revisits of it; a null page_id comes after all others.
    """
    pages = steady(ws, pages.select("page_id", "url", "html"))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"),
        F.monotonically_increasing_id().alias("row")).withColumn("digest", F.sha1("payload"))
    first = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row", "url")
    groups = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    joined = skew_join(rows, groups.select("digest", "first"), ["digest"], "left")
    revisit = F.col("first").isNotNull() & (F.col("first.row") != F.col("row")) & (F.octet_length("payload") >= min_bytes)
    ready = joined.select("page_id", "url", "payload", F.coalesce(revisit, F.lit(False)).alias("revisit"), F.col("first.page_id").alias("to_id"), F.col("first.url").alias("to_url"))
    folder = ws.path("archives")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, path, at = None, "", 0
        out: list[tuple] = []
        for b in batches:
            for i in range(b.num_rows):
                page_id, url, payload, again, to_id, to_url = (b.column(c)[i].as_py() for c in range(6))
                if stream is None:
                    fs, base = opened(folder)
                    fs.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, stream = f"{folder}/{name}", fs.open_output_stream(f"{base}/{name}", compression=None)
                data = record(page_id, url, payload, (to_id, to_url) if again else None)
                stream.write(data)
                shown = _header(url) if url is not None else None
                to = (to_id, _header(to_url) if to_url is not None else None) if again else (None, None)
                out.append((page_id, shown, capture_key(shown, page_id), path, at, len(data), "revisit" if again else "response", base32(payload), None if again else len(payload), *to))
                at += len(data)
                if len(out) == ROWS:
                    yield _captured(out)
                    out = []
        if stream is not None:
            stream.close()
        if out:
            yield _captured(out)

    return ws.table(ready.mapInArrow(run, CAPTURE), "written")


def captures(files: DataFrame) -> DataFrame:
    """A row of CAPTURE for each record of the archives that `files` (file) names, read from front to back. The digest and
    size of a response are those of the payload read; a revisit has its header's digest and no size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                out: list[tuple] = []
                for at, length, r in read_archive(path):
                    full = r.payload is not None
                    digest = base32(r.payload) if full else r.digest
                    if full and digest != r.digest:
                        raise ValueError(f"a payload of {path} does not match its digest")
                    out.append((r.page_id, r.url, capture_key(r.url, r.page_id), path, at, length, r.type, digest, len(r.payload) if full else None, r.refers_to, r.refers_url))
                    if len(out) == ROWS:
                        yield _captured(out)
                        out = []
                if out:
                    yield _captured(out)

    return files.select("file").distinct().mapInArrow(run, CAPTURE)


def write_index(ws: Workspace, found: DataFrame, name: str = "index", block_lines: int = BLOCK_LINES) -> list[tuple[bytes, bytes, str, int, int]]:
    """Write the index of captures; its master list: (first key, last key, file, directory offset and length)."""
    folder = ws.path(name)
    lines = found.select("key", "page_id", "file", "offset", "length", "record_type", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[bytes] = []
        directory: list[tuple[str, int, int, int]] = []
        stream, path, at, last = None, "", 0, b""

        def flush() -> None:
            nonlocal at
            data = gzip.compress(b"\n".join(block), 6, mtime=0)
            stream.write(data)
            directory.append((block[0].partition(b"\t")[0].decode("latin-1"), at, len(data), len(block)))
            at += len(data)
            block.clear()

        for b in batches:
            for i in range(b.num_rows):
                key, page_id, file, offset, length, kind, digest = (b.column(c)[i].as_py() for c in range(7))
                if stream is None:
                    fs, base = opened(folder)
                    fs.create_dir(base, recursive=True)
                    part = f"{uuid.uuid4().hex}.cdx.gz"
                    path, stream = f"{folder}/{part}", fs.open_output_stream(f"{base}/{part}", compression=None)
                block.append(key + b"\t" + json.dumps([page_id, file, offset, length, kind, digest]).encode())
                last = key
                if len(block) == block_lines:
                    flush()
        if stream is not None:
            if block:
                flush()
            data = gzip.compress(json.dumps(directory).encode(), 6, mtime=0)
            stream.write(data + struct.pack("<QQ", at, len(data)))
            stream.close()
            yield pa.RecordBatch.from_pylist([{"first": directory[0][0].encode("latin-1"), "last": last, "file": path, "at": at, "size": len(data)}], pa.schema([("first", pa.binary()), ("last", pa.binary()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64())]))

    parts = min(MAX_PARTS, input_partitions(found))
    laid = lines.repartitionByRange(parts, "key").sortWithinPartitions("key")
    master = ws.table(laid.mapInArrow(run, "first binary, last binary, file string, at long, size long"), f"{name}-master")
    return sorted((bytes(r["first"]), bytes(r["last"]), r["file"], r["at"], r["size"]) for r in master.collect())  # MAX_PARTS rows at most, unless more are asked for


class CaptureIndex:
    """Looks captures up by key. Directories and blocks last used are kept."""

    KEPT = 64

    def __init__(self, master: list[tuple[bytes, bytes, str, int, int]]):
        self.master = master
        self.ranges = Ranges()
        self.lasts = [m[1] for m in master]
        self.directories: OrderedDict[str, list] = OrderedDict()
        self.blocks: OrderedDict[tuple[str, int], list[bytes]] = OrderedDict()

    def _kept(self, cache: OrderedDict, key, make):
        if key not in cache:
            cache[key] = make()
            if len(cache) > self.KEPT:
                cache.popitem(last=False)
        cache.move_to_end(key)
        return cache[key]

    def _directory(self, part: tuple) -> list:
        _, _, file, at, size = part
        return self._kept(self.directories, file, lambda: [(f.encode("latin-1"), *x) for f, *x in json.loads(gzip.decompress(self.ranges.read(file, at, size)))])

    def _block(self, file: str, at: int, size: int) -> list[bytes]:
        return self._kept(self.blocks, (file, at), lambda: gzip.decompress(self.ranges.read(file, at, size)).split(b"\n"))

    def scan(self, low: bytes) -> Iterator[tuple[bytes, list]]:
        """(key, [page_id, file, offset, length, type, digest]) in order of keys, from the first key not below `low`."""
        for part in self.master[bisect_left(self.lasts, low) :]:
            directory = self._directory(part)
            firsts = [d[0] for d in directory]
            for _, at, size, _ in directory[max(0, bisect_left(firsts, low) - 1) :]:
                lines = self._block(part[2], at, size)
                for line in lines[bisect_left(lines, low) :]:
                    key, _, rest = line.partition(b"\t")
                    yield key, json.loads(rest)

    def record(self, value: list) -> Record:
        """The record of a capture, read by its range."""
        return Record(gzip.decompress(self.ranges.read(*value[1:4])))

    def captures(self, url: str | None) -> Iterator[list]:
        """All captures of a URL, in order of page ids, one after the other."""
        prefix = capture_key(url, None)[:-1]
        for key, value in self.scan(prefix):
            if not key.startswith(prefix):
                return
            yield value

    def capture(self, url: str | None, page_id: int | None, kind: str | None = None, digest: str | None = None) -> list | None:
        """The first capture of a URL with a page id (of a type and of a payload, if given)."""
        want = capture_key(url, page_id)
        for key, value in self.scan(want):
            if key != want:
                return None
            if kind in (None, value[4]) and digest in (None, value[5]):
                return value
        return None


def look_up(urls: DataFrame, master: list[tuple[bytes, bytes, str, int, int]], url: str = "url") -> DataFrame:
    """(url, page_id, record_type, payload binary) of every capture of every distinct URL in `urls`; a revisit has
    no payload of its own. URLs are sorted by key first, so a task reads few blocks; one record is in memory at a time
    but for those of a batch, which BATCH_BYTES bound."""
    schema = pa.schema([("url", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CaptureIndex(master)
        out: list[tuple] = []
        held = 0
        for b in batches:
            for u in sorted(b.column(0).to_pylist(), key=lambda x: capture_key(x, None)):
                for value in index.captures(u):
                    payload = index.record(value).payload
                    out.append((u, value[0], value[4], payload))
                    held += len(payload or b"")
                    if len(out) == ROWS or held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
        index.ranges.close()

    return urls.select(F.col(url).alias("url")).distinct().mapInArrow(run, "url string, page_id long, record_type string, payload binary")


def read_back(found: DataFrame, master: list[tuple[bytes, bytes, str, int, int]]) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every capture in `found` (CAPTURE), from its
    record, which is found in the index by URL, id, type and digest and read by its range. Size and digest are those of
    the full payload: a revisit's are those of the response that it refers to, found and read in the same way, once for
    many revisits in a row. A record that is not there, or has another payload, is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = CaptureIndex(master), OrderedDict()

        def response(url: str | None, page_id: int | None, digest: str) -> tuple[int, Record]:
            at = index.capture(url, page_id, "response", digest)
            if at is None:
                raise ValueError(f"the response {url} of {page_id} is not in the index")
            r = index.record(at)
            if base32(r.payload) != digest or r.digest != digest:
                raise ValueError(f"the response {url} of {page_id} has another payload")
            known[url, page_id, digest] = len(r.payload)
            if len(known) > 10_000:
                known.popitem(last=False)
            return len(r.payload), r

        for b in batches:
            out: list[tuple] = []
            for page_id, url, kind, digest in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                if kind == "response":
                    size, r = response(url, page_id, digest)
                else:
                    at = index.capture(url, page_id, kind, digest)
                    if at is None:
                        raise ValueError(f"the revisit {url} of {page_id} is not in the index")
                    r = index.record(at)
                    target = (r.refers_url, r.refers_to, r.digest)
                    size = known[target] if target in known else response(*target)[0]
                out.append((r.page_id, size, r.digest, r.type, r.refers_to))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        index.ranges.close()

    # In the order of the index, so a task reads each block once.
    laid = found.repartitionByRange(input_partitions(found), "key", "file", "offset").sortWithinPartitions("key")
    return laid.select("page_id", "url", "record_type", "digest").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write `pages` (page_id, url, html) as archives, index them and read every record back through the index.

    Per page: page_id, payload_bytes, payload_digest (base32 SHA-1), record_type and refers_to. Null html counts as
    an empty payload, very long ones are written whole, null URLs have an empty key; a row with a null page_id is a
    response only if its whole group has none, and its revisits then refer to null; repeated rows revisit the first of
    them; other columns are ignored; an empty table gives an empty one.
    """
    ws = Workspace(pages.sparkSession, "warc")
    written = write_archives(ws, pages, min_bytes)
    return read_back(written, write_index(ws, written))


#: `round_trip` of pages with ids, in DuckDB; base32 takes five bits at a time from two hexadecimal digits.
ORACLE = """
WITH paid AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
marked AS (SELECT page_id, payload, min(page_id) OVER (PARTITION BY payload) AS first FROM paid),
hashed AS (SELECT *, upper(sha1(payload)) || '0' AS hx FROM marked)
SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    ((strpos('0123456789ABCDEF', substr(hx, i * 5 // 4 + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(hx, i * 5 // 4 + 2, 1)) - 1) // [8, 4, 2, 1][i * 5 % 4 + 1] % 32 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM hashed
"""

__all__ = ["ORACLE", "CaptureIndex", "Record", "captures", "look_up", "read_archive", "read_back", "record", "round_trip", "surt", "write_archives", "write_index"]
