"""Web archives: WARC records in ZIP packages (WACZ), read by range.

Writing: each partition makes packages of at most ``per_package`` records, ZIP
files whose members are stored without compression: ``archive/data.warc.gz``
(each record a gzip member of its own), ``indexes/index.cdxj`` (a sorted line a
record: key, time, JSON with offset, length and file name) and a manifest. They
are written in one go, sizes after the data, so any file system will do and
nothing is kept on a local disk. Packages past 4 GiB, or with more members than
the short fields hold, get ZIP64 fields. Equal payloads of at least
``least_bytes`` bytes are written once: the record of the smallest page id is the
response, others revisit it.

Reading, also of packages that others have made: the end record and, where it
says so, the ZIP64 end record give the central directory; its entries (with their
ZIP64 extras) locate the stored members. Every index (CDXJ, plain or gzipped) is
read as a stream, and each record by its file name, offset and length; nothing is
extracted. A package without an index has its archives read from end to end. A
compressed member is refused when it is asked for, and so are broken records,
entries past their member's end and payloads that are not what their record says.

Files are named by partition and number and written under a temporary name first.
A partition's records are in the order of page id and digest, so a repeated or
speculative task writes the same packages again.

Defined results: null html is an empty payload; equal rows are each a response
when they share the smallest id; a null page id comes before all others; pages of
any length are one record each; an empty table makes no package; other columns
are not read.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO, NamedTuple
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, small_batches, stored
from .kept import held

DATA, INDEX, MANIFEST = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
#: Fixed values of the ZIP format: signatures, and the largest value of a short field; and of gzip.
LOCAL, CENTRAL, END, END64, LOCATOR64, AFTER = b"PK\3\4", b"PK\1\2", b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\7\x08"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
GZIP = b"\x1f\x8b"


class Member(NamedTuple):
    offset: int  # of its data
    size: int
    stored: bool


class ZipWriter:
    """Stored members one after another; nothing is written twice, so the file need not be seekable."""

    def __init__(self, out: BinaryIO, force64: bool = False):
        self.out, self.entries, self.force64, self.place = out, [], force64, 0

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.place += len(data)

    def begin(self, name: str) -> None:
        self.name, self.at, self.crc, self.size = name.encode(), self.place, 0, 0
        # Flags: the sizes follow the data (in 64 bits, as the extra field is there); names are UTF-8.
        self._put(LOCAL + struct.pack("<5H3I2H", 45, 0x808, 0, 0, 33, 0, FULL32, FULL32, len(self.name), 20) + self.name + struct.pack("<2H2Q", 1, 16, 0, 0))

    def write(self, data: bytes) -> int:
        """Its offset within the member."""
        at = self.size
        self._put(data)
        self.crc, self.size = zlib.crc32(data, self.crc), self.size + len(data)
        return at

    def finish(self) -> None:
        self._put(AFTER + struct.pack("<I2Q", self.crc, self.size, self.size))
        self.entries.append((self.name, self.at, self.crc, self.size))

    def close(self) -> None:
        start = self.place
        for name, at, crc, size in self.entries:
            large = self.force64 or max(size, at) >= FULL32
            extra = struct.pack("<2H3Q", 1, 24, size, size, at) if large else b""
            size, at = (FULL32, FULL32) if large else (size, at)
            self._put(CENTRAL + struct.pack("<6H3I5H2I", 45, 45, 0x808, 0, 0, 33, crc, size, size, len(name), len(extra), 0, 0, 0, 0, at) + name + extra)
        length, count = self.place - start, len(self.entries)
        if self.force64 or count >= FULL16 or max(length, start) >= FULL32:
            at = self.place
            self._put(END64 + struct.pack("<Q2H2I4Q", 44, 45, 45, 0, 0, count, count, length, start))
            self._put(LOCATOR64 + struct.pack("<IQI", 0, at, 1))
            count, length, start = FULL16, FULL32, FULL32
        self._put(END + struct.pack("<4H2IH", 0, 0, count, count, length, start, 0))


def directory(f: BinaryIO) -> dict[str, Member]:
    """The members by name, from the central directory."""
    size = f.seek(0, os.SEEK_END)
    tail = min(size, 22 + FULL16)
    f.seek(size - tail)
    block = f.read(tail)
    at = block.rfind(END)
    if at < 0:
        raise ValueError("no end of a central directory")
    count, length, start = struct.unpack_from("<H2I", block, at + 10)
    if FULL16 == count or FULL32 in (length, start):
        locator = size - tail + at - 20
        f.seek(locator)
        if (found := f.read(20))[:4] == LOCATOR64:
            f.seek(struct.unpack_from("<Q", found, 8)[0])
            if (record := f.read(56))[:4] != END64:
                raise ValueError("no ZIP64 end record where its locator points")
            count, length, start = struct.unpack_from("<3Q", record, 32)
    f.seek(start)
    block, at, members = f.read(length), 0, {}
    for _ in range(count):
        if block[at : at + 4] != CENTRAL:
            raise ValueError("a broken central directory")
        method = struct.unpack_from("<H", block, at + 10)[0]
        packed, plain, n, m, k = struct.unpack_from("<2I3H", block, at + 20)
        offset = struct.unpack_from("<I", block, at + 42)[0]
        name, extra = block[at + 46 : at + 46 + n].decode(), block[at + 46 + n : at + 46 + n + m]
        wide = _wide(extra)
        plain, packed, offset = (next(wide) if x == FULL32 else x for x in (plain, packed, offset))
        f.seek(offset)
        head = f.read(30)
        if head[:4] != LOCAL:
            raise ValueError(f"no member where {name} should be")
        members[name] = Member(offset + 30 + sum(struct.unpack_from("<2H", head, 26)), packed, method == 0 and packed == plain)
        at += 46 + n + m + k
    return members


def _wide(extra: bytes) -> Iterator[int]:
    """The 64-bit values of a ZIP64 extra field."""
    at = 0
    while at + 4 <= len(extra):
        tag, n = struct.unpack_from("<2H", extra, at)
        if tag == 1:
            yield from struct.unpack_from(f"<{n // 8}Q", extra, at + 4)
        at += 4 + n


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, size: int, digest: str, refers_to, is_revisit: bool) -> bytes:
    """A response, or a revisit whose block is the HTTP head alone; the head tells the payload's whole size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_plain(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if is_revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _plain(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def _fields(lines: Iterable[str]) -> dict[str, str]:
    """Header fields, names in lower case."""
    return {name.strip().lower(): value.strip() for name, sign, value in (x.partition(":") for x in lines) if sign}


class Record(NamedTuple):
    fields: dict[str, str]
    http: dict[str, str] | None
    payload: bytes


def parse(raw: bytes) -> Record:
    """Fields, HTTP fields (of HTTP messages) and payload of one record; lengths are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    fields = _fields(lines)
    size = int(fields.get("content-length", -1))
    if not version.startswith("WARC/") or size < 0 or len(rest) < size or rest[size:].strip(b"\r\n"):
        raise ValueError("a broken record")
    block = rest[:size]
    if not fields.get("content-type", "").startswith("application/http"):
        return Record(fields, None, block)
    http, _, payload = block.partition(b"\r\n\r\n")
    return Record(fields, _fields(http.decode("utf-8", "replace").split("\r\n")[1:]), payload)


def key_of(url: str | None) -> str:
    """An address in sort-friendly form: the host's labels turned round, then the rest."""
    parts = urlsplit(url or "") if url and "[" not in url else None
    if not parts or not parts.hostname:
        return _plain(url or "-").replace(" ", "%20")
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{','.join(reversed(parts.hostname.split('.')))}){_plain(rest).replace(' ', '%20').lower()}"


def write_package(out: BinaryIO, records: Iterable[tuple[dict, bytes]], force64: bool = False) -> int:
    """records: (index fields, among them url, and the record). Returns how many."""
    package, index = ZipWriter(out, force64), []
    package.begin(DATA)
    for fields, raw in records:
        squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
        data = squeeze.compress(raw) + squeeze.flush()
        told = fields | {"offset": str(package.write(data)), "length": str(len(data)), "filename": DATA.partition("/")[2]}
        index.append(f"{key_of(fields.get('url'))} 19700101000000 {json.dumps(told)}\n")
    package.finish()
    package.begin(INDEX)
    for line in sorted(index):
        package.write(line.encode())
    package.finish()
    package.begin(MANIFEST)
    package.write(json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": DATA}, {"path": INDEX}]}).encode())
    package.finish()
    package.close()
    return len(index)


def _blocks(f: BinaryIO, member: Member, block: int = 1 << 18) -> Iterator[bytes]:
    """A member's bytes, without gzip where it has that."""
    at, end, squeezed, first = member.offset, member.offset + member.size, None, True
    while at < end:
        f.seek(at)
        found = f.read(min(block, end - at))
        if not found:
            raise ValueError("the file ends within a member")
        at += len(found)
        if first and found[:2] == GZIP:
            squeezed = zlib.decompressobj(31)
        first = False
        if squeezed is None:
            yield found
        while squeezed is not None and found:
            yield squeezed.decompress(found)
            found = squeezed.unused_data
            if squeezed.eof:
                squeezed = zlib.decompressobj(31)


def _lines(f: BinaryIO, member: Member) -> Iterator[bytes]:
    rest = b""
    for found in _blocks(f, member):
        *whole, rest = (rest + found).split(b"\n")
        yield from whole
    if rest:
        yield rest


def _entries(f: BinaryIO, member: Member) -> Iterator[dict]:
    """The JSON of each line of an index, after its key and time; header lines start with a blank or an exclamation mark."""
    for line in _lines(f, member):
        if line.strip() and line[:1] not in b" !":
            start = line.find(b"{")
            if start < 0:
                raise ValueError("an index line without JSON: only CDXJ is read")
            yield json.loads(line[start:])


def _walked(f: BinaryIO, member: Member) -> Iterator[bytes]:
    """The records of an archive without an index; one record is held."""
    held_back = b""
    for found in _blocks(f, member):
        held_back += found
        while (end := held_back.find(b"\r\n\r\n")) >= 0:
            size = int(_fields(held_back[:end].decode("utf-8", "replace").split("\r\n")).get("content-length", -1))
            if size < 0:
                raise ValueError("a record without a length")
            whole = end + 4 + size + 4
            if len(held_back) < whole:
                break
            yield held_back[:whole]
            held_back = held_back[whole:]
    if held_back.strip():
        raise ValueError("an archive ends within a record")


def read_package(f: BinaryIO, at_once: int = 4096) -> Iterator[tuple[dict, bytes]]:
    """(index fields, record) of all indexes, by place within each portion of ``at_once`` lines; or of all archives."""
    members = directory(f)
    archives = {n: m for n, m in members.items() if n.startswith("archive/") and n.endswith((".warc", ".warc.gz"))}
    indexes = [m for n, m in sorted(members.items()) if n.startswith("indexes/") and n.endswith((".cdxj", ".cdx", ".cdxj.gz", ".cdx.gz"))]
    if not all(m.stored for m in [*archives.values(), *indexes]):
        raise ValueError("a compressed member: archives and indexes must be stored")
    by_name = {n.removeprefix("archive/"): m for n, m in archives.items()}

    def place(fields: dict) -> tuple[int, int]:
        name = str(fields.get("filename", "")).removeprefix("archive/")
        member = by_name.get(name) or (next(iter(archives.values())) if len(archives) == 1 and not name else None)
        if member is None:
            raise ValueError(f"no archive {name!r}")
        at, length = int(fields["offset"]), int(fields["length"])
        if at < 0 or at + length > member.size:
            raise ValueError("an index entry past its member's end")
        return member.offset + at, length

    for index in indexes:
        entries = _entries(f, index)
        while some := list(itertools.islice(entries, at_once)):
            for (at, length), _, fields in sorted((place(x), i, x) for i, x in enumerate(some)):
                f.seek(at)
                raw = f.read(length)
                yield fields, zlib.decompress(raw, 31) if raw[:2] == GZIP else raw
    if not indexes:
        for _, member in sorted(archives.items()):
            for raw in _walked(f, member):
                yield {}, raw


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it: executors and the driver open packages alike."""
    if uri.startswith(("file:", "/")):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def with_references(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, url, payload, size, sha1, refers_to, is_revisit). The other side of the join is stored, a row a payload, so that a very common payload can be split."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), payload.alias("payload")).withColumn("size", F.length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    # Pages of a payload that several ids have, but for the smallest id: the only ones that refer to another.
    groups = rows.where(F.col("size") >= least_bytes).groupBy("sha1").agg(F.min(F.struct("page_id")).alias("lo"), F.max(F.struct("page_id")).alias("hi")).where("lo < hi")
    groups = stored(groups.select(F.col("sha1").alias("shared"), F.col("lo.page_id").alias("first_id")), "payloads")
    joined = rows.join(groups, F.col("sha1") == F.col("shared"), "left")
    revisit = F.col("shared").isNotNull() & (F.col("size") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "payload", "size", "sha1", revisit.alias("is_revisit"), F.when(revisit, F.col("first_id")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, *, least_bytes: int = 0, per_package: int = 100_000) -> DataFrame:
    """Writes the packages; (path, records) of each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("warc", dict)
        system, path = opened(folder)
        system.create_dir(path, recursive=True)

        def records() -> Iterator[tuple[dict, bytes]]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {n: batch.column(n)[i].as_py() for n in ("page_id", "url", "payload", "size", "is_revisit", "refers_to")}
                    row["digest"] = base32_sha1(row["payload"])
                    told = {"url": row["url"], "mime": "warc/revisit" if row["is_revisit"] else "text/html", "status": "200", "digest": f"sha1:{row['digest']}"}
                    yield told, record(**row)

        waiting, number = records(), 0
        while first := list(itertools.islice(waiting, 1)):
            name = f"part-{TaskContext.get().partitionId():06d}-{number:04d}.wacz"
            spool = f"{path}/.{name}-{uuid.uuid4().hex}"
            with system.open_output_stream(spool) as out:
                n = write_package(out, itertools.chain(first, itertools.islice(waiting, per_package - 1)))
            system.move(spool, f"{path}/{name}")
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], names=["path", "records"])

    return with_references(small_batches(pages), least_bytes).sortWithinPartitions("page_id", "sha1").mapInArrow(run, "path string, records long")


RECORDS = "record_id string, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to string, payload binary"


def read_archives(paths: DataFrame) -> DataFrame:
    """RECORDS of all packages; of revisits the size is the one their HTTP head tells, and there is no payload."""
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("warc", dict)
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, path = opened(uri)
                rows, size = [], 0
                with system.open_input_file(path) as f:
                    for _, raw in read_package(f):
                        rows.append(_told(parse(raw)))
                        size += len(raw)
                        if size > 1 << 22 or len(rows) >= 2000:
                            yield told(rows)
                            rows, size = [], 0
                if rows:
                    yield told(rows)

    return paths.select("path").mapInArrow(run, RECORDS)


def _told(found: Record) -> tuple:
    fields, http = found.fields, found.http or {}
    digest, kind = fields.get("warc-payload-digest", ""), fields.get("warc-type")
    bare = digest.removeprefix("sha1:")
    size = len(found.payload)
    if kind == "revisit":
        size = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
    elif digest.startswith("sha1:") and len(bare) == 32 and base32_sha1(found.payload) != bare:
        raise ValueError(f"{fields.get('warc-record-id')}: the payload is not what its record says")
    return fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), size, bare, fields.get("warc-refers-to"), None if kind == "revisit" else found.payload


def round_trip(pages: DataFrame, *, least_bytes: int = 0, per_package: int = 100_000) -> DataFrame:
    """Writes all pages to packages in the shared folder and reads them back, with their page ids."""
    folder = scratch(pages.sparkSession, "archives")
    paths = stored(write_archives(pages, folder, least_bytes=least_bytes, per_package=per_package), "archive-list")
    page = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1), F.lit("")).cast("long")
    return read_archives(paths.repartition(max(1, paths.count()))).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "payload")
