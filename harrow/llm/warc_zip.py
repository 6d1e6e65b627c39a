"""WARC records in ZIP packages: writing, and reading without extraction.

A package is a ZIP file with stored (uncompressed) members archive/data.warc.gz (a gzip member a record) and
indexes/index.cdx (a line a record: url, time, and JSON with offset, length and the archive's file name). The reader looks for the
end-of-central-directory record at the package's end, follows ZIP64 where sizes or offsets need it, finds the stored members
through the central directory and their local headers, and range-reads records through all indexes (*.cdx, *.cdxj, also
gzipped) of any archives in the package. Records without this writer's own header fields have a null page_id, and their sizes
and digests are taken from the payload.

Defined results: a null html is an empty payload; a null page_id is written as "null" and read back as null (it is a
revisit if its payload has a smallest page_id, else a response); rows that repeat the smallest page_id with its payload are
all responses; null urls are written as urn:page:<page_id>, and line ends in urls as %0D and %0A; extra columns are ignored; an empty table gives no package.
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
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, table
from .files import locate, read_range, write_once

#: Bytes of records after which a task starts another package.
PACKAGE_BYTES = 128 << 20
U32, U16 = 0xFFFFFFFF, 0xFFFF


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# -- ZIP packages --------------------------------------------------------------------------------------------------


def write_zip(out, members: list[tuple[str, list[bytes]]], zip64: bool = False) -> None:
    """Store members (name, chunks) in a ZIP file; with zip64 (or sizes that need it) in ZIP64 form."""
    at, central = 0, []
    for name, chunks in members:
        raw, size, crc = name.encode(), sum(map(len, chunks)), 0
        for c in chunks:
            crc = zlib.crc32(c, crc)
        big = zip64 or size >= U32 or at >= U32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if big else b""
        short = U32 if big else size
        head = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45 if big else 20, 0x800, 0, 0, 0x21, crc, short, short, len(raw), len(extra)) + raw + extra
        out.write(head)
        for c in chunks:
            out.write(c)
        extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if big else b""
        central.append(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45 if big else 20, 45 if big else 20, 0x800, 0, 0, 0x21, crc, short, short, len(raw), len(extra), 0, 0, 0, 0, U32 if big else at) + raw + extra)
        at += len(head) + size
    listing = b"".join(central)
    out.write(listing)
    n, big = len(members), zip64 or at >= U32 or len(members) >= U16
    if big:
        out.write(struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, len(listing), at))
        out.write(struct.pack("<4sIQI", b"PK\6\7", 0, at + len(listing), 1))
    out.write(struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, U16 if big else n, U16 if big else n, U32 if big else len(listing), U32 if big else at, 0))


def zip_members(source, size: int) -> dict[str, tuple[int, int]]:
    """Stored members of the ZIP file: name to (offset of its data, length). Other members raise ValueError."""
    tail = min(size, 22 + 65_535)
    end = read_range(source, size - tail, tail)
    at = end.rfind(b"PK\5\6")
    while at >= 0 and at + 22 + struct.unpack_from("<H", end, at + 20)[0] != len(end):
        at = end.rfind(b"PK\5\6", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack_from("<HII", end, at + 10)
    if U16 == n or U32 in (length, start):
        here = size - tail + at - 20
        mark, _, where, _ = struct.unpack("<4sIQI", read_range(source, here, 20)) if here >= 0 else (b"", 0, 0, 0)
        if mark == b"PK\6\7":
            mark, *_, n, length, start = struct.unpack("<4sQHHIIQQQQ", read_range(source, where, 56))
            if mark != b"PK\6\6":
                raise ValueError("no ZIP64 end of central directory")
    listing, out, i = read_range(source, start, length), {}, 0
    for _ in range(n):
        if listing[i : i + 4] != b"PK\1\2":
            raise ValueError("broken central directory")
        method, packed, plain, name_n, extra_n, note_n, local = struct.unpack_from("<10xH8xIIHHH8xI", listing, i)
        name = listing[i + 46 : i + 46 + name_n].decode()
        extra, j = listing[i + 46 + name_n : i + 46 + name_n + extra_n], 0
        while j + 4 <= len(extra):
            tag, k = struct.unpack_from("<HH", extra, j)
            if tag == 1:  # holds those of the three that don't fit, in this order
                values = iter(struct.unpack_from(f"<{k // 8}Q", extra, j + 4))
                plain = next(values) if plain == U32 else plain
                packed = next(values) if packed == U32 else packed
                local = next(values) if local == U32 else local
            j += 4 + k
        if not name.endswith("/"):
            if method:
                raise ValueError(f"{name} is not stored")
            head = read_range(source, local, 30)
            if head[:4] != b"PK\3\4":
                raise ValueError("broken local header")
            out[name] = (local + 30 + sum(struct.unpack_from("<HH", head, 26)), packed)
        i += 46 + name_n + extra_n + note_n
    return out


# -- WARC records --------------------------------------------------------------------------------------------------


def record_id(page_id: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'urn:page:' + page_id)}>"


def warc_record(kind: str, page_id: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {in_header(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {page_id}",
        f"X-Payload-Bytes: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(http)}",
    ]
    if refers_to is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http + b"\r\n\r\n") + pack.flush()


def in_header(url: str) -> str:
    """The url without line ends, which a header can't hold."""
    return url.replace("\r", "%0D").replace("\n", "%0A")


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and the payload behind the HTTP head."""
    head, _, rest = zlib.decompress(raw, 31).partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


# -- Jobs ----------------------------------------------------------------------------------------------------------


def write_packages(pages: DataFrame, out: str, least_bytes: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) to packages under out; returns the written manifest: path, records.

    Of equal payloads of at least least_bytes, that with the smallest page_id is a response and the others revisit it.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), payload.alias("payload")).withColumn("own", F.struct(F.unhex(F.sha1("payload")).alias("d"), F.length("payload").alias("n")))
    first = table(rows.filter(F.length("payload") >= least_bytes).groupBy("own").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1").select(F.col("own").alias("same"), "first"), "first")
    # A plain join on the payload's digest: Spark can split a digest that a third of the rows share.
    joined = rows.join(first, F.col("own") == F.col("same"), "left").select("page_id", "url", "payload", F.when(F.col("page_id") == F.col("first"), None).otherwise(F.col("first")).alias("refers_to"))

    def write(batches):
        chunks, index, at = [], [], 0

        def package():
            path = f"{out}/{uuid.uuid4().hex}.zip"
            with write_once(path) as f:
                write_zip(f, [("archive/data.warc.gz", chunks), ("indexes/index.cdx", ["".join(index).encode()])])
            return pa.RecordBatch.from_pydict({"path": [path], "records": [len(index)]})

        for batch in batches:
            n = max(1, int(batch.num_rows * (8 << 20) / max(batch.nbytes, 1)))
            for start in range(0, batch.num_rows, n):
                for page_id, url, body, refers_to in zip(*(c.to_pylist() for c in batch.slice(start, n).columns)):
                    name = "null" if page_id is None else str(page_id)
                    raw = warc_record("response" if refers_to is None else "revisit", name, f"urn:page:{name}" if url is None else url, body, sha1_base32(body), None if refers_to is None else str(refers_to))
                    chunks.append(raw)
                    entry = {"url": url, "offset": str(at), "length": str(len(raw)), "filename": "data.warc.gz"}
                    index.append(f"{quote(url or name)} 20240101000000 {json.dumps(entry)}\n")
                    at += len(raw)
                    if at >= package_bytes:
                        yield package()
                        chunks, index, at = [], [], 0
        if index:
            yield package()

    return table(joined.mapInArrow(write, "path string, records long"), "packages")


def _entries(source, members: dict[str, tuple[int, int]]) -> dict[str, list[tuple[int, int]]]:
    """For each archive member, (offset in the package, length) of its records by the package's indexes."""
    out: dict[str, list[tuple[int, int]]] = {}
    for name, (at, n) in members.items():
        if name.startswith("indexes/") and re.search(r"\.cdxj?(\.gz)?$", name):
            raw = read_range(source, at, n)
            for line in (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).splitlines():
                if (start := line.find(b"{")) >= 0:
                    entry = json.loads(line[start:])
                    archive = "archive/" + entry["filename"].rsplit("/", 1)[-1]
                    out.setdefault(archive, []).append((members[archive][0] + int(entry["offset"]), int(entry["length"])))
    return {k: sorted(v) for k, v in out.items()}


def read_packages(spark: SparkSession, manifest: DataFrame, range_bytes: int = 4 << 20) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to of every record.

    A range holds neighbouring records of about range_bytes (or one record).
    """
    # a number of its own, as ranges are short rows that stand for much: by their bytes all of them would go to one task
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def ranges(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, where = locate(path)
                with system.open_input_file(where) as f:
                    entries = _entries(f, zip_members(f, f.size()))
                out: list[tuple[int, list[int]]] = []
                for records in entries.values():
                    end, size = -1, 0
                    for at, n in records:
                        if at != end or size + n > range_bytes:
                            out.append((at, []))
                            size = 0
                        out[-1][1].append(n)
                        end, size = at + n, size + n
                yield pa.RecordBatch.from_pydict({"path": [path] * len(out), "start": pa.array([x[0] for x in out], pa.int64()), "lengths": pa.array([x[1] for x in out], pa.list_(pa.int64()))})

    def records(batches):
        for batch in batches:
            for r in batch.to_pylist():
                system, where = locate(r["path"])
                with system.open_input_file(where) as f:
                    raw = io.BytesIO(read_range(f, r["start"], sum(r["lengths"])))
                out = {k: [] for k in ("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to")}
                for n in r["lengths"]:
                    fields, body = parse_record(raw.read(n))
                    own, kind = fields.get("x-page-id", "null"), fields["warc-type"]
                    digest = fields.get("warc-payload-digest") or "sha1:" + sha1_base32(body)
                    if kind == "response" and digest.startswith("sha1:") and "sha1:" + sha1_base32(body) != digest:
                        raise ValueError(f"record {fields.get('warc-record-id')}: the payload doesn't have its digest")
                    out["page_id"].append(None if own == "null" else int(own))
                    out["url"].append(None if fields.get("warc-target-uri") == f"urn:page:{own}" else fields.get("warc-target-uri"))
                    out["payload"].append(body if kind == "response" else None)
                    out["payload_bytes"].append(int(fields.get("x-payload-bytes", len(body))))
                    out["payload_digest"].append(digest.removeprefix("sha1:"))
                    out["record_type"].append(kind)
                    out["refers_to"].append(int(fields["x-refers-to-page-id"]) if "x-refers-to-page-id" in fields else None)
                yield pa.RecordBatch.from_pydict(out, pa.schema({"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}))

    located = manifest.select("path").mapInArrow(ranges, "path string, start long, lengths array<long>").repartition(tasks, "path", "start")
    return located.mapInArrow(records, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written to packages in the shared folder and read back."""
    spark = pages.sparkSession
    return read_packages(spark, write_packages(pages, new_path(spark, "packages")))


