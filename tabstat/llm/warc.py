"""WARC records in ZIP packages: a writer, and a reader that extracts nothing.

A package is a ZIP archive whose members are stored as they are: gzipped WARC files
and a CDXJ index. The reader takes any ``read_at(offset, length)``. It finds the end
records, follows ZIP64, lists the central directory, and then reads single records
of stored members by range.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstat.llm import spread as S

#: Payloads of at least so many bytes are kept once.
MIN_SHARED = 1000
#: Payload bytes after which a task starts the next package.
PACKAGE_BYTES = 4 << 20
#: Most shared digests that are broadcast (some 50 bytes each).
BROADCAST_DIGESTS = 200_000
_DATE = "2024-01-01T00:00:00Z"
_MAX32, _MAX16 = 0xFFFFFFFF, 0xFFFF


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    stored: int
    header: int


class PackageReader:
    """Members of a ZIP package, by range reads."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int):
        self.read_at, self.size = read_at, size
        self.members = {m.name: m for m in self._directory()}
        self._start: dict[str, int] = {}

    def _directory(self) -> Iterator[Member]:
        tail_at = max(0, self.size - 22 - _MAX16)
        tail = self.read_at(tail_at, self.size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        while end >= 0 and (len(tail) < end + 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
            end = tail.rfind(b"PK\x05\x06", 0, end)
        if end < 0:
            raise ValueError("no end of central directory")
        count, length, offset = struct.unpack_from("<HII", tail, end + 10)
        locator = self.read_at(tail_at + end - 20, 20) if tail_at + end >= 20 else b""
        if locator[:4] == b"PK\x06\x07":
            at = struct.unpack_from("<Q", locator, 8)[0]
            record = self.read_at(at, 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("bad ZIP64 end record")
            count, length, offset = struct.unpack_from("<QQQ", record, 32)
        directory, at = self.read_at(offset, length), 0
        for _ in range(count):
            if directory[at : at + 4] != b"PK\x01\x02":
                raise ValueError("bad central directory")
            flags, method = struct.unpack_from("<HH", directory, at + 8)
            stored, size, n, extra, comment = struct.unpack_from("<IIHHH", directory, at + 20)
            header = struct.unpack_from("<I", directory, at + 42)[0]
            name = directory[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            fields = directory[at + 46 + n : at + 46 + n + extra]
            while len(fields) >= 4:
                kind, width = struct.unpack_from("<HH", fields)
                if kind == 1:
                    wide, i = fields[4 : 4 + width], 0
                    values = []
                    for value in (size, stored, header):
                        if value == _MAX32:
                            value, i = struct.unpack_from("<Q", wide, i)[0], i + 8
                        values.append(value)
                    size, stored, header = values
                fields = fields[4 + width :]
            yield Member(name, method, size, stored, header)
            at += 46 + n + extra + comment

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        """A range of a stored member."""
        member = self.members[name]
        if member.method != 0:
            raise ValueError(f"{name} is compressed in the package; only stored members can be read by range")
        if name not in self._start:
            local = self.read_at(member.header, 30)
            if local[:4] != b"PK\x03\x04":
                raise ValueError("bad local header")
            n, extra = struct.unpack_from("<HH", local, 26)
            self._start[name] = member.header + 30 + n + extra
        length = member.size - offset if length is None else min(length, member.size - offset)
        return self.read_at(self._start[name] + offset, length)

    def index(self) -> Iterator[dict]:
        """Lines of all CDXJ indexes, gzipped or not."""
        for name in sorted(self.members):
            if name.endswith((".cdxj", ".cdx", ".cdxj.gz", ".cdx.gz")):
                text = self.read(name)
                for line in (gzip.decompress(text) if name.endswith(".gz") else text).decode().splitlines():
                    if "{" in line:
                        yield json.loads(line[line.index("{") :])

    def record(self, line: dict) -> tuple[dict[str, str], bytes]:
        """Headers and block of the record that an index line names."""
        archive = line["filename"] if line["filename"] in self.members else f"archive/{line['filename']}"
        return parse_record(zlib.decompress(self.read(archive, int(line["offset"]), int(line["length"])), 31))

    def scan(self) -> Iterator[tuple[dict[str, str], bytes]]:
        """All records of all WARC members, for packages without an index."""
        for name in sorted(self.members):
            if name.endswith((".warc.gz", ".warc")):
                data = self.read(name)
                while data:
                    unzip = zlib.decompressobj(31)
                    yield parse_record(unzip.decompress(data))
                    data = unzip.unused_data


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def build_record(name: str, url: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """A gzipped response, or a revisit, which has the HTTP header but no payload."""
    digest = hashlib.sha1(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    headers = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {' '.join(url.split())}"]
    if refers_to is not None:
        headers += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    headers += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def build_package(members: list[tuple[str, bytes]], *, zip64: bool = False) -> bytes:
    """A ZIP of stored members. ZIP64 where sizes or offsets need it, or if asked for."""
    out, central, at = [], [], 0
    for name, data in members:
        raw, crc = name.encode(), zlib.crc32(data)
        wide = zip64 or len(data) >= _MAX32 or at >= _MAX32
        size = _MAX32 if wide else len(data)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if wide else b""
        out += [struct.pack("<IHHHHHIIIHH", 0x04034B50, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra)), raw, extra, data]
        more = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if wide else b""
        central.append(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(more), 0, 0, 0, 0, _MAX32 if wide else at) + raw + more)
        at += 30 + len(raw) + len(extra) + len(data)
    directory = b"".join(central)
    wide = zip64 or len(members) >= _MAX16 or at >= _MAX32
    end = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, len(members), len(members), len(directory), at) + struct.pack("<IIQI", 0x07064B50, 0, at + len(directory), 1) if wide else b""
    few = min(len(members), _MAX16) if not wide else _MAX16
    end += struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, few, few, _MAX32 if wide else len(directory), _MAX32 if wide else at, 0)
    return b"".join([*out, directory, end])


class _Package:
    """A package in the making: one WARC member and its index."""

    def __init__(self):
        self.records, self.lines, self.at, self.size = [], [], 0, 0

    def add(self, key: str, url: str, payload: bytes, refers_to: str | None) -> None:
        record = build_record(key, url, payload, refers_to)
        line = {"url": url, "filename": "data.warc.gz", "offset": str(self.at), "length": str(len(record)), "id": key}
        self.lines.append(f"{' '.join(url.split()) or '-'} 20240101000000 {json.dumps(line)}\n")
        self.records.append(record)
        self.at += len(record)
        self.size += len(payload)

    def close(self) -> bytes:
        return build_package([("archive/data.warc.gz", b"".join(self.records)), ("indexes/index.cdxj", "".join(sorted(self.lines)).encode()), ("datapackage.json", b'{"profile": "data-package", "wacz_version": "1.1.1"}')], zip64=True)


def write_packages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, min_shared: int = MIN_SHARED) -> DataFrame:
    """Packages of all pages, a few MB each, as rows of a table: ``content`` binary.

    Of pages with equal payloads of at least min_shared bytes, the one with the
    largest id is a response and the others revisit it. Null html is an empty
    payload. A null id is written as an empty name and is never the response that
    others refer to. Rows that repeat the response's id are responses too.
    """
    S.tune(pages.sparkSession)
    rows = pages.select(pages[id_col].cast("bigint").alias("id"), F.coalesce(pages[url_col].cast("string"), F.lit("")).alias("url"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.when((F.octet_length("html") >= min_shared) & F.col("id").isNotNull(), F.sha1(F.col("html").cast("binary"))))
    first = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.max("id").alias("keeper"), F.count("*").alias("c")).where("c > 1").select("digest", "keeper")
    first = S.write_table(first)
    # Digests that several pages share: broadcast while they are few, joined with their pages beyond that.
    if first.count() <= BROADCAST_DIGESTS:
        rows = rows.join(F.broadcast(first), "digest", "left")
    else:
        # Pages without a digest have nothing to look up: joined, they would all meet at null.
        rows = rows.where("digest IS NOT NULL").join(first, "digest", "left").unionByName(rows.where("digest IS NULL").withColumn("keeper", F.lit(None).cast("bigint")))
    rows = rows.select("id", "url", "html", F.when(F.col("keeper") != F.col("id"), F.col("keeper")).alias("refers_to"))

    def write(batches):
        package = _Package()
        for batch in batches:
            for i in range(batch.num_rows):
                key, url, text, other = (batch.column(c)[i].as_py() for c in range(4))
                package.add("" if key is None else str(key), url, text.encode("utf-8", "surrogatepass"), None if other is None else str(other))
                if package.size >= PACKAGE_BYTES:
                    yield pa.RecordBatch.from_pydict({"content": pa.array([package.close()], pa.binary())})
                    package = _Package()
        if package.lines:
            yield pa.RecordBatch.from_pydict({"content": pa.array([package.close()], pa.binary())})

    return rows.mapInArrow(S.lean(write), "content binary")


def hex_digest(declared: str) -> str:
    """The SHA-1 of a WARC-Payload-Digest header in lower-case hex; archives write it in base32 or hex."""
    plain = declared.partition(":")[2] or declared
    return base64.b32decode(plain.upper()).hex() if len(plain) == 32 else plain.lower()


def _page_id(name: str) -> int | None:
    """The id in <urn:page:...>; null in archives of other writers."""
    m = re.fullmatch(r"<urn:page:(-?\d+)>", name.strip())
    return int(m[1]) if m else None


_RECORDS = "id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"


def _records(package: PackageReader) -> Iterator[pa.RecordBatch]:
    """The records that the package's index lists (all that its archives hold, if it has none), some MB at a time."""
    names = [x.split()[0] for x in _RECORDS.split(", ")]
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    indexed = any(name.endswith((".cdxj", ".cdx", ".cdxj.gz", ".cdx.gz")) for name in package.members)
    found = (package.record(line) for line in package.index()) if indexed else package.scan()
    out, size = [], 0
    close = lambda: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
    for headers, block in found:
        kind = headers["warc-type"]
        if kind not in ("response", "revisit"):
            continue
        http, _, payload = block.partition(b"\r\n\r\n")
        declared = next((int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
        digest = hex_digest(headers["warc-payload-digest"]) if "warc-payload-digest" in headers else None
        if kind == "response":
            own = hashlib.sha1(payload).hexdigest()
            if declared not in (None, len(payload)) or digest not in (None, own):
                raise ValueError(f"damaged record {headers.get('warc-record-id')}")
            digest, declared = own, len(payload)
        out.append((_page_id(headers.get("warc-record-id", "")), headers.get("warc-target-uri"), kind, declared, digest, _page_id(headers.get("warc-refers-to", "")), payload if kind == "response" else None))
        size += len(payload)
        if size >= PACKAGE_BYTES:
            yield close()
            out, size = [], 0
    if out:
        yield close()


def read_packages(packages: DataFrame, content_col: str = "content") -> DataFrame:
    """Records of every package: ``id``, ``url``, ``record_type``, ``payload_bytes``, ``payload_digest``, ``refers_to``, ``payload`` (null in revisits).

    Each record is found by its index line and read by range. The digest of a
    response is worked out from its payload and must be the one that it declares;
    a revisit has what its headers say, or null. Ids are null in archives of other
    writers. Null and empty packages have no records.
    """

    def read(batches):
        for batch in batches:
            for content in batch.column(0):
                data = content.as_buffer()
                view = memoryview(data) if data is not None else memoryview(b"")
                if len(view):
                    yield from _records(PackageReader(lambda at, n, view=view: bytes(view[at : at + n]), len(view)))

    return packages.select(content_col).mapInArrow(S.lean(read), _RECORDS)


def read_stored(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """Records (as of read_packages) of packages in storage, with their ``path``: only ranges of a file are read.

    A path is a URI of a store that pyarrow reads (file, s3, gs, hdfs, ...), or an
    absolute path on a disk that all executors share. Null paths give nothing.
    """

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                if path is None:
                    continue
                store, inside = pafs.FileSystem.from_uri(path)
                with store.open_input_file(inside) as f:
                    for part in _records(PackageReader(lambda at, n, f=f: f.read_at(n, at), f.size())):
                        yield pa.RecordBatch.from_arrays([pa.array([path] * part.num_rows, pa.string()), *part.columns], ["path", *part.schema.names])

    return paths.select(path_col).mapInArrow(S.lean(read), f"path string, {_RECORDS}")
