"""Web archives in ZIP packages: writing, and reading without extraction.

Each writing task packs its pages into ZIP files with two stored members: ``archive/data.warc.gz``, one gzip member per
record, and ``indexes/index.cdx``, one line per record with its place. A reader needs three small range reads to find
its way: the end of the file gives the central directory (through the ZIP64 end record and extra fields where the plain
fields are full), the directory gives the members, the index member gives every record's place. Records are then read by
range and decompressed one at a time; no member is ever unpacked to disk. Places are dealt out in runs, so a large
package is many tasks' work.

Files go to the shared folder under names of their own for each attempt; only what a finished task reports is read, so a
lost executor's half-written package is never seen.

Nulls and odd input: a null html is an empty payload; a null page_id is written as empty and read back as null, and is
never chosen as response while another page has the same payload. Rows equal in id and payload are each written; the
first of them is the response. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import struct
import uuid
import zipfile
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inferlytics.llm.common import settle, shared_folder, table

LEAST = 100  # payloads below this size are always stored
PACKAGE_BYTES = 256 << 20
RUN_BYTES = 4 << 20  # consecutive records that one range read covers
TASK_BYTES = 32 << 20  # of ranges read by one task
WARC_MEMBER = "archive/data.warc.gz"
INDEX_MEMBER = "indexes/index.cdx"
STORED = 0
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


# ---- records


def record_bytes(page_id: int | None, url: str, html: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit carries the length and digest of the payload that it leaves out."""
    name = "" if page_id is None else str(page_id)
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{name}>",
        "WARC-Date": "2000-01-01T00:00:00Z",
        "WARC-Target-URI": "".join(url.split()),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "X-Payload-Length": str(size),
        "Content-Type": "application/http; msgtype=response",
    }
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is None:
        block += html
    else:
        head["WARC-Refers-To"] = f"<urn:page:{refers_to}>"
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    head["Content-Length"] = str(len(block))
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return gzip.compress(lines.encode() + block + b"\r\n\r\n", 4, mtime=0)


def parse_record(data: bytes) -> tuple[int | None, int, str, str, int | None, str, bytes | None]:
    """page_id, payload bytes, digest, type, refers_to, url, payload of an uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a web archive record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(fields["Content-Length"])]
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")

    def page(name: str) -> int | None:
        text = fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    size = int(fields["X-Payload-Length"])
    if payload is not None and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return page("WARC-Record-ID"), size, digest, kind, page("WARC-Refers-To"), fields["WARC-Target-URI"], payload


# ---- packages


class _Package:
    """A package while it is written. The archive member is streamed; the index follows when it is complete."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        files, place = pafs.FileSystem.from_uri(self.path)
        self.sink = files.open_output_stream(place)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(WARC_MEMBER, "w", force_zip64=True)
        self.index = io.StringIO()
        self.at = 0

    def add(self, record: bytes, page_id: int | None) -> None:
        self.member.write(record)
        self.index.write(f"{'' if page_id is None else page_id} {self.at} {len(record)}\n")
        self.at += len(record)

    def close(self) -> None:
        self.member.close()
        self.zip.writestr(INDEX_MEMBER, self.index.getvalue())
        self.zip.close()
        self.sink.close()


def _write(folder: str, package_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package = None
        done: list[str] = []
        for batch in batches:
            for page_id, url, html, size, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if package is not None and package.at >= package_bytes:
                    package.close()
                    done.append(package.path)
                    package = None
                package = package or _Package(folder)
                package.add(record_bytes(page_id, url, html, size, digest, refers_to), page_id)
        if package is not None:
            package.close()
            done.append(package.path)
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["path"])

    return run


def write_archives(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write the pages as packages below ``folder``; the finished packages' paths as a written table."""
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html")
    ).withColumns({"size": F.octet_length("html").cast("long"), "digest": F.sha2("html", 256)})
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    # rows are told apart by (page_id, row): among equal payloads the first is the response
    order = F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "row")
    light = rows.where(F.col("size") >= LEAST).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    firsts = light.where("n > 1").select("digest", F.col("first.page_id").alias("first_id"), F.col("first.row").alias("first_row"))
    found = rows.join(firsts, "digest", "left")
    again = F.col("first_id").isNotNull() & (F.col("row") != F.col("first_row"))
    found = found.select(
        "page_id",
        "url",
        F.when(again, F.lit(b"")).otherwise(F.col("html")).alias("html"),
        "size",
        "digest",
        F.when(again, F.col("first_id")).alias("refers_to"),
    )
    return settle(found.mapInArrow(_write(folder, package_bytes), "path string"), "packages")


# ---- reading


class Member(NamedTuple):
    name: str
    method: int
    size: int
    header: int  # place of the local header


def _range(file: BinaryIO, at: int, size: int) -> bytes:
    file.seek(at)
    data = file.read(size)
    if len(data) != size:
        raise ValueError("package is cut short")
    return data


def members(file: BinaryIO, length: int) -> list[Member]:
    """The central directory of a package, read by range."""
    tail_at = max(0, length - 22 - 65_535)
    tail = _range(file, tail_at, length - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    entries, size, start = struct.unpack_from("<HII", tail, end + 10)
    if entries == 0xFFFF or size == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = _range(file, tail_at + end - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        record = _range(file, struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        entries, size, start = struct.unpack_from("<QQQ", record, 32)
    directory = _range(file, start, size)
    out, at = [], 0
    for _ in range(entries):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory entry")
        method = struct.unpack_from("<H", directory, at + 10)[0]
        packed, plain = struct.unpack_from("<II", directory, at + 20)
        n_name, n_extra, n_comment = struct.unpack_from("<HHH", directory, at + 28)
        header = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        wide = _zip64_values(extra)
        # the extra field holds only the values whose plain field is full, in this order
        plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
        packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
        header = wide.pop(0) if header == 0xFFFFFFFF else header
        out.append(Member(name, method, packed, header))
        at += 46 + n_name + n_extra + n_comment
    return out


def _zip64_values(extra: bytes) -> list[int]:
    at = 0
    while at + 4 <= len(extra):
        tag, size = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            return list(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
        at += 4 + size
    return []


def member_start(file: BinaryIO, member: Member) -> int:
    """Where a stored member's bytes begin; the local header's name and extra field may differ in length."""
    if member.method != STORED:
        raise ValueError(f"{member.name} is compressed: only stored members can be read by range")
    header = _range(file, member.header, 30)
    if header[:4] != b"PK\x03\x04":
        raise ValueError("bad local header")
    n_name, n_extra = struct.unpack_from("<HH", header, 26)
    return member.header + 30 + n_name + n_extra


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of records: path, place, length and the lengths of the records in it."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            files, place = pafs.FileSystem.from_uri(path)
            with files.open_input_file(place) as file:
                by_name = {m.name: m for m in members(file, file.size())}
                base = member_start(file, by_name[WARC_MEMBER])
                index = by_name[INDEX_MEMBER]
                lines = _range(file, member_start(file, index), index.size).decode().splitlines()
            runs: list[tuple[int, list[int]]] = []
            total = RUN_BYTES
            for line in lines:
                _, at, size = line.split(" ")
                if total >= RUN_BYTES:
                    runs.append((base + int(at), []))
                    total = 0
                runs[-1][1].append(int(size))
                total += int(size)
            columns = [
                pa.array([path] * len(runs), pa.string()),
                pa.array([at for at, _ in runs], pa.int64()),
                pa.array([sizes for _, sizes in runs], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["path", "at", "sizes"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in RECORDS.split(", ")]
    for batch in batches:
        for path, at, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            files, place = pafs.FileSystem.from_uri(path)
            with files.open_input_file(place) as file:
                data = _range(file, at, sum(sizes))
            rows, begin = [], 0
            for size in sizes:
                rows.append(parse_record(gzip.decompress(data[begin : begin + size])))
                begin += size
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)


def read_archives(packages: DataFrame) -> DataFrame:
    """Records of the packages named in ``path``: page_id, payload_bytes, payload_digest, record_type, refers_to, url,
    payload (null for revisits)."""
    runs = settle(packages.select("path").mapInArrow(_locate, "path string, at long, sizes array<long>"), "ranges")
    # the ranges are a few bytes each but stand for much to read, so tasks are counted by what they read
    total = F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))
    size, n = runs.agg(total, F.count("*")).first()
    tasks = max(1, min(n, -(-(size or 0) // TASK_BYTES)))
    return runs.repartition(tasks, F.xxhash64("path", "at")).mapInArrow(_read, RECORDS)


def query(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    files, place = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    files.create_dir(place)
    packages = write_archives(table(spark, sf_dir, "pages"), folder if "://" in folder else f"file://{folder}")
    return read_archives(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM f
"""
