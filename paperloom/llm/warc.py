"""ZIP-packaged web archives (operator 1).

A package is a ZIP file with stored (uncompressed) members: ``archive/data.warc`` with WARC 1.1 records,
``indexes/index.cdxj`` with the place of every record, and ``datapackage.json``. The reader works on any
``read(offset, length)``: it finds the end record, follows the ZIP64 locator where there is one, parses the
central directory (with ZIP64 extra fields), resolves a member's data through its local header and reads
single records by range, without extracting the members. Packages without an index are scanned record by
record. Members ``.warc.gz`` hold one gzip member per record, which is read by its range and expanded alone. An archive member of another
kind, or a compressed one, is an error.

``read_files`` reads package files in place: Spark lists them without their content, tasks read directories and indexes by seek and cut every
package into slices of about ``SLICE_BYTES``, and slices are dealt out and read by seek; so a package may have any size. ``write`` makes packages as rows, since a
task can write files only where a file system is mounted, and Spark's own writer has no ZIP format; ``round_trip`` keeps these rows in the
shared folder and reads records from them by range.

Records of equal payloads (of at least ``min_bytes``) are written once: the row with the largest page_id is the
response, the others are revisits that carry the payload's digest and HTTP length and refer to it; smaller
payloads are all responses. A null html is an empty payload; null and odd URLs are percent-encoded; rows
repeated with the largest page_id are all responses. An empty table gives no package and an empty
result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, ready, shuffle_parts, stored, tidy

#: Payload bytes after which a package is closed, record bytes that one slice of a package file has.
PACKAGE_BYTES, SLICE_BYTES = 4 << 20, 64 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- records ------------------------------------------------------------------------------


def _record(page_id: int | None, url: str | None, payload_size: int, digest: str, payload: bytes | None, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if payload is not None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {quote(url or '', safe=_URL_SAFE)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if payload is None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_URL_SAFE = "!#$%&'()*+,/:;=?@[]~-._"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of one record."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


_OWN_ID = re.compile(r"<urn:page:(-?[0-9]{1,19})>")


def _page(uri: str | None) -> int | None:
    """The page of an id that ``write`` gave; null for ids of other archives."""
    found = _OWN_ID.fullmatch(uri or "")
    return int(found[1]) if found else None


def _same_digest(stated: str, payload: bytes) -> bool:
    """Whether a digest header (algorithm:value, base32 or hexadecimal) is that of a payload; true for algorithms that aren't known here."""
    algorithm, _, value = stated.rpartition(":")
    name = algorithm.lower().replace("-", "") or "sha1"
    if name not in ("sha1", "sha256", "sha512", "md5"):
        return True
    raw = hashlib.new(name, payload).digest()
    return value.rstrip("=").lower() in (raw.hex(), base64.b32encode(raw).decode().rstrip("=").lower())


# ---- packages -----------------------------------------------------------------------------


class PackageWriter:
    """Collects records and makes one package of them."""

    def __init__(self):
        self.warc, self.index = io.BytesIO(), []

    def add(self, page_id: int | None, url: str | None, payload_size: int, digest: str, payload: bytes | None, refers_to: int | None) -> None:
        raw = _record(page_id, url, payload_size, digest, payload, refers_to)
        where = {"offset": self.warc.tell(), "length": len(raw), "digest": digest}
        self.index.append(f"{quote(url or '', safe=_URL_SAFE)} 19700101000000 {json.dumps(where)}")
        self.warc.write(raw)

    def close(self) -> bytes:
        out = io.BytesIO()
        members = {
            "archive/data.warc": self.warc.getvalue(),
            "indexes/index.cdxj": "\n".join(self.index).encode(),
            "datapackage.json": json.dumps({"profile": "data-package", "records": len(self.index)}).encode(),
        }
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, data in members.items():
                with z.open(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), "w", force_zip64=True) as member:
                    member.write(data)
        return out.getvalue()


class PackageReader:
    """Random access to a package through ``read(offset, length)`` and its size in bytes."""

    def __init__(self, read: Callable[[int, int], bytes], size: int | None = None):
        """Without a size the directory is not read; records can be read by known ranges then."""
        self.read, self.size = read, size
        self.members = dict(self._directory()) if size is not None else {}

    @classmethod
    def of(cls, content: bytes | memoryview) -> PackageReader:
        return cls(lambda at, n: bytes(content[at : at + n]), len(content))

    def _end(self) -> tuple[int, int, int]:
        """(entries, directory size, directory offset), by ZIP64 where any of them overflows."""
        tail_at = max(0, self.size - 65_557)
        tail = self.read(tail_at, self.size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0:
            if len(tail) - at >= 22 and struct.unpack_from("<H", tail, at + 20)[0] <= len(tail) - at - 22:
                break
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no end of central directory: not a ZIP package")
        entries, size, offset = struct.unpack_from("<HII", tail, at + 10)
        locator_at = tail_at + at - 20
        if locator_at >= 0 and (locator := self.read(locator_at, 20))[:4] == b"PK\x06\x07":
            end64 = self.read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if end64[:4] != b"PK\x06\x06":
                raise ValueError("the ZIP64 locator points nowhere")
            entries, size, offset = struct.unpack_from("<QQQ", end64, 32)
        return entries, size, offset

    def _directory(self) -> Iterator[tuple[str, dict]]:
        entries, size, offset = self._end()
        raw, at = self.read(offset, size), 0
        for _ in range(entries):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError("the central directory is damaged")
            flags, method = struct.unpack_from("<HH", raw, at + 8)
            crc, packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIIHHH", raw, at + 16)
            local = struct.unpack_from("<I", raw, at + 42)[0]
            name = raw[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
            plain, packed, local = self._wide(extra, plain, packed, local)
            yield name, {"method": method, "crc": crc, "packed": packed, "size": plain, "local": local}
            at += 46 + n_name + n_extra + n_comment

    @staticmethod
    def _wide(extra: bytes, *values: int) -> list[int]:
        """Fields at their 32-bit maximum come from the ZIP64 extra field, in order."""
        at, wide = 0, b""
        while at + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                wide = extra[at + 4 : at + 4 + n]
            at += 4 + n
        out, used = [], 0
        for v in values:
            if v == 0xFFFFFFFF and used + 8 <= len(wide):
                v = struct.unpack_from("<Q", wide, used)[0]
                used += 8
            out.append(v)
        return out

    def data_at(self, name: str) -> int:
        """Offset of a stored member's first byte."""
        m = self.members[name]
        if m["method"]:
            raise ValueError(f"{name} is compressed; only stored members are read by range")
        local = self.read(m["local"], 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("a local header is damaged")
        return m["local"] + 30 + sum(struct.unpack_from("<HH", local, 26))

    def member(self, name: str) -> bytes:
        """A whole member, checked against its CRC (meant for indexes)."""
        m = self.members[name]
        data = self.read(m["local"] + 30 + sum(struct.unpack_from("<HH", self.read(m["local"], 30), 26)), m["packed"])
        if m["method"] == zipfile.ZIP_DEFLATED:
            data = zlib.decompress(data, -15)
        if zlib.crc32(data) != m["crc"]:
            raise ValueError(f"{name}: wrong CRC")
        return data

    def ranges(self) -> Iterator[tuple[int, int, bool]]:
        """(offset in the package, length, whether gzipped) of every record, by the indexes, else by scanning the archives."""
        archives = [n for n in self.members if n.startswith("archive/") and not n.endswith("/")]
        odd = [n for n in archives if not n.endswith((".warc", ".warc.gz"))]
        if odd:
            raise ValueError(f"{odd[0]} is no WARC member")
        starts = {n: self.data_at(n) for n in archives}
        indexes = [n for n in self.members if n.startswith("indexes/") and n.endswith((".cdxj", ".cdx", ".cdxj.gz", ".cdx.gz"))]
        if not indexes:
            for name, at in starts.items():
                yield from self._scanned(at, at + self.members[name]["size"], name.endswith(".gz"))
            return
        for index in indexes:
            data = self.member(index)
            for line in (gzip.decompress(data) if index.endswith(".gz") else data).decode().splitlines():
                if "{" not in line:
                    continue  # a heading
                where = json.loads(line[line.index("{") :])
                name = f"archive/{where['filename']}" if "filename" in where else archives[0]
                if "filename" not in where and len(archives) > 1:
                    raise ValueError(f"{index} doesn't say which archive it means")
                yield starts[name] + int(where["offset"]), int(where["length"]), name.endswith(".gz")

    def _scanned(self, at: int, end: int, packed: bool) -> Iterator[tuple[int, int, bool]]:
        while at < end:
            if packed:
                press, length = zlib.decompressobj(31), 0
                while not press.eof:
                    part = self.read(at + length, min(1 << 16, end - at - length))
                    if not part:
                        raise ValueError("a gzip member has no end")
                    press.decompress(part)
                    length += len(part) - len(press.unused_data)
            else:
                head, step = b"", 4096
                while b"\r\n\r\n" not in head and len(head) < end - at:
                    head = self.read(at, min(step, end - at))
                    step *= 4
                cut = head.index(b"\r\n\r\n") + 4
                length = cut + next(int(x.partition(b":")[2]) for x in head[:cut].split(b"\r\n") if x.lower().startswith(b"content-length:")) + 4
            yield at, length, packed
            at += length

    def record(self, at: int, length: int, packed: bool) -> tuple[dict[str, str], bytes]:
        raw = self.read(at, length)
        return parse_record(gzip.decompress(raw) if packed else raw)

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        """Every record, read by its range."""
        for where in self.ranges():
            yield self.record(*where)


# ---- Spark --------------------------------------------------------------------------------


def with_roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is null for a response. html is null in revisits."""
    html = F.coalesce("html", F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.unhex(F.sha1(html.cast("binary"))).alias("digest"))
    first = base.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("winner"))
    joined = base.join(first, "digest", "left")
    revisit = F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner"))
    return joined.select("page_id", "url", F.octet_length("html").cast("long").alias("size"), "digest", F.when(~revisit, F.col("html")).alias("html"), F.when(revisit, F.col("winner")).alias("refers_to"))


def write(pages: DataFrame, min_bytes: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """(path, content): packages of about ``package_bytes``, a WARC record for every row of ``pages``."""
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def run(batches):
        writer, size = PackageWriter(), 0

        def close():
            return batch(schema, [f"{uuid.uuid4().hex}.wacz"], [writer.close()])

        for b in batches:
            for page_id, url, n, digest, html, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                payload = None if refers_to is not None else (html or "").encode()
                writer.add(page_id, url, n, base64.b32encode(digest).decode(), payload, refers_to)
                size += 600 + len(payload or b"")
                if size >= package_bytes:
                    yield close()
                    writer, size = PackageWriter(), 0
        if writer.index:
            yield close()

    return ready(with_roles(pages, min_bytes)).mapInArrow(tidy(run), "path string, content binary")


_READ = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64())]
    + [("payload_digest", pa.string()), ("payload", pa.binary()), ("record_id", pa.string()), ("refers_to_id", pa.string())]
)
_READ_DDL = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, record_id string, refers_to_id string"


def _row(headers: dict[str, str], block: bytes) -> tuple:
    """One record as a row of ``read``."""
    kind, own = headers.get("warc-type"), headers.get("warc-record-id")
    # a block without a type that is a response or a revisit is an HTTP message too
    is_http = headers.get("content-type", "application/http" if kind in ("response", "revisit") else "").startswith("application/http")
    http, _, payload = block.partition(b"\r\n\r\n") if is_http else (b"", b"", block)
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:])}
    stated, length = headers.get("warc-payload-digest"), fields.get(b"content-length", b"")
    if kind == "revisit":
        size, payload = int(length) if length.isdigit() else None, None
    else:
        # a digest of a chunked body may be that of the body put together again
        if stated and b"chunked" not in fields.get(b"transfer-encoding", b"").lower() and "warc-truncated" not in headers and not _same_digest(stated, payload):
            raise ValueError(f"{own}: the payload doesn't match its digest")
        size = len(payload)
    bare = stated if stated and not stated.lower().startswith("sha1:") else stated and stated[5:]
    refers = headers.get("warc-refers-to")
    return _page(own), headers.get("warc-target-uri"), kind, _page(refers), size, bare, payload, own, refers


def _rows(records: Iterator[tuple[dict[str, str], bytes]]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for headers, block in records:
        rows.append(_row(headers, block))
        size += len(block)
        if size > 1 << 24:
            yield batch(_READ, *zip(*rows, strict=True))
            rows, size = [], 0
    if rows:
        yield batch(_READ, *zip(*rows, strict=True))


def read(packages: DataFrame) -> DataFrame:
    """One row per record of (path, content) packages, whatever its type and whoever wrote it: page_id, url, record_type, refers_to,
    payload_bytes and payload_digest of the full payload, the payload itself (null in revisits), record_id and refers_to_id. page_id and refers_to are null
    where ids are not those of ``write``; payload_digest is bare where it is a SHA-1, else with its algorithm; headers that a record lacks are null. The payload of a record that is no HTTP
    message is its block. A payload that doesn't match the digest of its record raises an error."""

    def run(batches):
        for b in batches:
            for content in b.column(0):
                yield from _rows(PackageReader.of(memoryview(content.as_buffer())).records())

    return ready(packages).select("content").mapInArrow(tidy(run), _READ_DDL)


def opened(path: str):
    """A package file for reading by seek, from any file system that Arrow knows."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(quote(path, safe=_URL_SAFE)) if ":" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def slices(files: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(path, offsets, lengths, packed): record ranges of package files (path, length), packed in slices; reads directories and indexes only."""
    schema = pa.schema([("path", pa.string()), ("offsets", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("packed", pa.list_(pa.bool_()))])

    def run(batches):
        for b in batches:
            for path, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with opened(path) as f:
                    found, size = [], 0
                    for where in PackageReader(lambda at, n, f=f: f.read_at(n, at), length).ranges():
                        found.append(where)
                        size += where[1]
                        if size >= slice_bytes:
                            yield batch(schema, [path], *([list(x)] for x in zip(*found, strict=True)))
                            found, size = [], 0
                    if found:
                        yield batch(schema, [path], *([list(x)] for x in zip(*found, strict=True)))

    return ready(files).select("path", "length").mapInArrow(tidy(run), "path string, offsets array<long>, lengths array<long>, packed array<boolean>")


def read_files(spark: SparkSession, path: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Records of the packages under a path, each read by its range."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.wacz").option("recursiveFileLookup", "true").load(path)
    dealt = slices(found.select("path", "length"), slice_bytes).repartition(shuffle_parts(spark), "path", F.col("offsets")[0])

    def run(batches):
        for b in batches:
            for name, *where in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with opened(name) as f:
                    reader = PackageReader(lambda at, n, f=f: f.read_at(n, at))
                    yield from _rows(reader.record(*w) for w in zip(*where, strict=True))

    return dealt.mapInArrow(tidy(run), _READ_DDL)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, then read the archives back: (page_id, payload_bytes, payload_digest,
    record_type, refers_to)."""
    return read(stored(write(pages), "packages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
