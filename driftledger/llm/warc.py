"""WARC records in ZIP-packaged archives: a writer, and a reader that fetches ranges.

An archive is a ZIP file whose members are stored, not deflated: data members of WARC records, each record a gzip member of
its own, and for each of them an index with a line for every record. The reader takes an archive's end, its central
directory (ZIP64 too) and its indexes, and then only the ranges of data members that hold the records it is asked for.

Archives are written by Spark's own text writer, through its commit protocol and to any file system that Spark writes to: a
row is a stretch of bytes. The line feed that the writer puts after each row is a gap between members, which the directory's
offsets step over; the last one is the archive's comment, one byte long.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stored

#: Payloads from so many bytes on are written once; equal ones become revisits.
REVISIT_BYTES = 1000
#: Digests of repeated payloads are broadcast up to so many; beyond, a shuffle joins them.
BROADCAST_DIGESTS = 1_000_000
MEMBER_BYTES = 8 << 20
_DATE = "2024-01-01T00:00:00Z"
_MAX16, _MAX32 = 0xFFFF, 0xFFFFFFFF


class ZipRows:
    """The rows of one archive: each is to be followed by a line feed."""

    def __init__(self, zip64: bool = False):
        self.at, self.entries, self.force = 0, [], zip64

    def member(self, name: str, data: bytes) -> bytes:
        """The row that stores a member of less than 4 GiB."""
        raw, crc = name.encode(), zlib.crc32(data)
        head = struct.pack("<4s5H3I2H", b"PK\x03\x04", 20, 0x800, 0, 0, 0x21, crc, len(data), len(data), len(raw), 0)
        self.entries.append((raw, crc, len(data), self.at))
        self.at += len(head) + len(raw) + len(data) + 1
        return head + raw + data

    def end(self) -> bytes:
        """The row with the central directory, ZIP64 where offsets or numbers need it, and the archive's end."""
        out, big = [], self.force or self.at > _MAX32 or len(self.entries) >= _MAX16
        for raw, crc, size, at in self.entries:
            extra = struct.pack("<2H3Q", 1, 24, size, size, at) if big else b""
            sizes = (_MAX32, _MAX32) if big else (size, size)
            out.append(struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 45 if big else 20, 45 if big else 20, 0x800, 0, 0, 0x21, crc, *sizes, len(raw), len(extra), 0, 0, 0, 0, _MAX32 if big else at))
            out += [raw, extra]
        directory, n = b"".join(out), len(self.entries)
        tail = b""
        if big:
            tail = struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, len(directory), self.at)
            tail += struct.pack("<4sIQI", b"PK\x06\x07", 0, self.at + len(directory), 1)
        numbers = (_MAX16, _MAX16, _MAX32, _MAX32) if big else (n, n, len(directory), self.at)
        return directory + tail + struct.pack("<4s2H2H2IH", b"PK\x05\x06", 0, 0, *numbers, 1)


def central_directory(file: BinaryIO, length: int) -> dict[str, tuple[int, int, int]]:
    """name -> (offset of the data, size, CRC) of an archive's stored members; reads its end and its directory only.

    ValueError where that isn't a ZIP file, is cut short, or a member is compressed or encrypted.
    """

    def take(at: int, n: int) -> bytes:
        file.seek(at)
        got = file.read(n)
        if at < 0 or len(got) != n:
            raise ValueError("the archive is cut short")
        return bytes(got)

    start = max(0, length - 22 - _MAX16)
    tail = take(start, length - start)
    found = tail.rfind(b"PK\x05\x06")
    while found >= 0 and (found + 22 > len(tail) or found + 22 + struct.unpack_from("<H", tail, found + 20)[0] != len(tail)):
        found = tail.rfind(b"PK\x05\x06", 0, found)
    if found < 0:
        raise ValueError("no end of a ZIP archive")
    n, size, at = struct.unpack_from("<HII", tail, found + 10)
    if n == _MAX16 or size == _MAX32 or at == _MAX32:
        place = start + found - 20
        if place >= 0 and (locator := take(place, 20))[:4] == b"PK\x06\x07":
            record = take(struct.unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record where its locator points")
            n, size, at = struct.unpack_from("<QQQ", record, 32)
    directory, members, p = take(at, size), {}, 0
    for _ in range(n):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        flags, method = struct.unpack_from("<2H", directory, p + 8)
        crc, packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<3I3H", directory, p + 16)
        offset = struct.unpack_from("<I", directory, p + 42)[0]
        name = directory[p + 46 : p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, q = directory[p + 46 + n_name : p + 46 + n_name + n_extra], 0
        while q + 4 <= len(extra):
            kind, n_field = struct.unpack_from("<2H", extra, q)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{n_field // 8}Q", extra, q + 4))
                plain = next(wide) if plain == _MAX32 else plain
                packed = next(wide) if packed == _MAX32 else packed
                offset = next(wide) if offset == _MAX32 else offset
            q += 4 + n_field
        if method or flags & 1:
            raise ValueError(f"{name} is compressed or encrypted")
        members[name] = (offset, packed, crc)
        p += 46 + n_name + n_extra + n_comment
    for name, (offset, packed, crc) in members.items():
        local = take(offset, 30)
        members[name] = (offset + 30 + sum(struct.unpack_from("<2H", local, 26)), packed, crc)
    return members


def _header(value: str) -> str:
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(page: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One gzip member with a response, or, where refers_to is given, a revisit without the payload.

    digest: the payload's hex SHA-1. Either kind's block has the HTTP header with the full payload's length.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def parse_record(packed: bytes) -> tuple[dict[str, str], bytes, dict[str, str], bytes]:
    """(WARC header, block, HTTP header, payload) of one gzip member; names in lower case."""
    raw = zlib.decompress(packed, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = lambda b: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in b.decode("utf-8", "replace").split("\r\n")[1:])}
    warc = fields(head)
    block = rest[: int(warc.get("content-length", len(rest)))]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, block, fields(http), payload


def _archive_rows(batches: Iterator[pa.RecordBatch], zip64: bool, member_bytes: int) -> Iterator[pa.RecordBatch]:
    """The rows of the archive that holds all of one task's records."""
    out, held, index, n, size = ZipRows(zip64), [], [], 0, 0

    def flush() -> list[bytes]:
        nonlocal held, index, n, size
        name = f"archive/data-{n:05d}.warc.gz"
        lines = "".join(f"{u} {_DATE} {json.dumps(x | {'filename': name})}\n" for u, x in sorted(index, key=lambda i: i[1]["offset"]))
        rows = [out.member(name, b"".join(held)), out.member(f"indexes/index-{n:05d}.cdxj", lines.encode())]
        held, index, n, size = [], [], n + 1, 0
        return rows

    for batch in batches:
        for page, url, payload, length, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            packed = record(page, url, payload, length, digest, refers_to)
            index.append((_header(url or "-"), {"url": url, "page": page, "digest": f"sha1:{digest}", "offset": size, "length": len(packed)}))
            held.append(packed)
            size += len(packed)
            if size >= member_bytes:
                yield pa.RecordBatch.from_arrays([pa.array(flush(), pa.binary())], names=["value"])
    if held or n:
        last = flush() if held else []
        yield pa.RecordBatch.from_arrays([pa.array([*last, out.end()], pa.binary())], names=["value"])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = REVISIT_BYTES, zip64: bool = False, member_bytes: int = MEMBER_BYTES) -> None:
    """Write a record for each row into archives below path, one archive for each task that has rows.

    A string payload is written in UTF-8, null as no bytes. Of rows with equal payloads of revisit_bytes or more the one
    with the largest id is a response (each row with that id) and the others are revisits of it; smaller payloads and rows
    that share a payload with none are responses. An empty table leaves a folder without archives.
    """
    spark = pages.sparkSession
    small_batches(spark, 500)
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("page", "url", "payload", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("digest"))
    shared = rows.where(F.col("size") >= revisit_bytes).groupBy("digest").agg(F.max("page").alias("first"), F.count("*").alias("n"))
    shared = stored(shared.where("n > 1 and first is not null").select("digest", "first"), "warc-repeated")
    if shared.count() <= BROADCAST_DIGESTS:
        shared = F.broadcast(shared)
    refers_to = F.when((F.col("size") >= revisit_bytes) & ~F.col("page").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.join(shared, "digest", "left").select("page", "url", F.when(refers_to.isNull(), F.col("payload")).alias("payload"), "size", "digest", refers_to.alias("refers_to"))
    archive = rows.mapInArrow(lambda b: _archive_rows(b, zip64, member_bytes), "value binary")
    archive.select(F.col("value").cast("string").alias("value")).write.text(path)


def _opened(path: str) -> BinaryIO:
    """A seekable file at a path of any store that Arrow opens."""
    uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path
    files, where = pyarrow.fs.FileSystem.from_uri(uri)
    return files.open_input_file(where)


_SEGMENT = "path string, offsets array<long>, lengths array<long>"


def _segments(frames: Iterator[pd.DataFrame], segment_bytes: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, length in frame[["path", "length"]].itertuples(index=False):
            out: list[tuple[str, list[int], list[int]]] = []
            with _opened(path) as file:
                members = central_directory(file, length)
                for name, (at, size, crc) in members.items():
                    if not (name.startswith("indexes/") and name.endswith(".cdxj")):
                        continue
                    file.seek(at)
                    lines = bytes(file.read(size))
                    if zlib.crc32(lines) != crc:
                        raise ValueError(f"{path}: {name} is damaged")
                    held = segment_bytes
                    for line in lines.decode().splitlines():
                        entry = json.loads(line.split(" ", 2)[2])
                        if held >= segment_bytes:
                            out.append((path, [], []))
                            held = 0
                        out[-1][1].append(members[entry["filename"]][0] + entry["offset"])
                        out[-1][2].append(entry["length"])
                        held += entry["length"]
            yield pd.DataFrame(out, columns=["path", "offsets", "lengths"])


_RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, path string, offset long"


def _records(frames: Iterator[pd.DataFrame], with_payload: bool) -> Iterator[pd.DataFrame]:
    page_of = lambda v: int(v[10:-1]) if v and v[10:-1] else None
    names = [c.split()[0] for c in _RECORD.split(", ")] + ["payload"] * with_payload
    for frame in frames:
        for path, offsets, lengths in frame[["path", "offsets", "lengths"]].itertuples(index=False):
            with _opened(path) as file:
                file.seek(int(offsets[0]))
                base, data = int(offsets[0]), bytes(file.read(int(offsets[-1]) + int(lengths[-1]) - int(offsets[0])))
            rows = []
            for at, n in zip(map(int, offsets), map(int, lengths), strict=True):
                warc, _, http, payload = parse_record(data[at - base : at - base + n])
                said = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
                refers_to = page_of(warc.get("warc-refers-to"))
                if warc["warc-type"] == "response":
                    size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    if digest != said:
                        raise ValueError(f"{path}: the record at {at} doesn't have the digest that it states")
                else:
                    size, digest, payload = int(http["content-length"]), said, None
                rows.append((page_of(warc["warc-record-id"]), warc.get("warc-target-uri"), warc["warc-type"], size, digest, refers_to, path, at, *([payload] * with_payload)))
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"page_id": "Int64", "refers_to": "Int64"})


def read_archives(spark: SparkSession, path: str, with_payload: bool = False, segment_bytes: int = 4 << 20) -> DataFrame:
    """A row for each WARC record in the archives below path, read by ranges.

    page_id, url, record_type, payload_bytes, payload_digest (of the full payload; a response's is computed from what was
    read and held against what the record states), refers_to, and where it lies. An archive that is damaged or has
    compressed members fails the read. Arrow must be able to open the paths' store; no file is read whole.
    """
    listed = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    n, size = listed.agg(F.count("*"), F.sum("length")).first()
    if not n:
        return spark.createDataFrame([], _RECORD + ", payload binary" * with_payload)
    cores = spark.sparkContext.defaultParallelism
    found = listed.repartition(min(n, 4096)).mapInPandas(lambda f: _segments(f, segment_bytes), _SEGMENT)
    parts = min(65_536, max(2 * cores, -(-size // (64 << 20))))
    return found.repartition(parts).mapInPandas(lambda f: _records(f, with_payload), _RECORD + ", payload binary" * with_payload)


def in_memory(data: bytes) -> tuple[BinaryIO, int]:
    """A file over these bytes, and its length, as central_directory takes them."""
    return io.BytesIO(data), len(data)
