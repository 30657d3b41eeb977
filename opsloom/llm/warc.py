"""WARC records in ZIP-packaged archives: writer, directory parser and range reader."""
from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, in_arrow, shared_folder, slices, stored

END, END64, LOCATOR, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2000-01-01T00:00:00Z"  # the given tables have no capture time


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- directories


class Member:
    """Where a stored member of an archive lies."""

    def __init__(self, name: str, method: int, size: int, packed: int, header: int) -> None:
        self.name, self.method, self.size, self.packed, self.header = name, method, size, packed, header


def read_at(file, offset: int, size: int) -> bytes:
    file.seek(offset)
    out = file.read(size)
    if len(out) != size:
        raise ValueError(f"archive ends before {offset + size}")
    return out


def directory(file, size: int) -> dict[str, Member]:
    """Members of a ZIP archive by name, from its central directory alone.

    The end record is looked for from the end, behind a comment of up to 64 KB. Where it has the marker
    values, the ZIP64 locator before it leads to the ZIP64 end record; marker values of an entry are taken
    from its ZIP64 extra field.
    """
    tail = read_at(file, start := max(0, size - 22 - 65535), size - start)
    at = tail.rfind(END)
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, offset):
        locator = read_at(file, start + at - 20, 20)
        if locator[:4] != LOCATOR:
            raise ValueError("no ZIP64 locator")
        end64 = read_at(file, struct.unpack_from("<Q", locator, 8)[0], 56)
        if end64[:4] != END64:
            raise ValueError("no ZIP64 end record")
        count, length, offset = struct.unpack_from("<QQQ", end64, 32)
    central, out, at = read_at(file, offset, length), {}, 0
    for _ in range(count):
        if central[at:at + 4] != ENTRY:
            raise ValueError("damaged central directory")
        flags, method = struct.unpack_from("<HH", central, at + 8)
        packed, full, names, extras, comments = struct.unpack_from("<IIHHH", central, at + 20)
        header = struct.unpack_from("<I", central, at + 42)[0]
        name = central[at + 46:at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
        extra, end = at + 46 + names, at + 46 + names + extras
        while extra + 4 <= end:
            kind, n = struct.unpack_from("<HH", central, extra)
            if kind == 1:
                wide, values = extra + 4, []
                for value, marker in ((full, 0xFFFFFFFF), (packed, 0xFFFFFFFF), (header, 0xFFFFFFFF)):
                    if value == marker:
                        value = struct.unpack_from("<Q", central, wide)[0]
                        wide += 8
                    values.append(value)
                full, packed, header = values
            extra += 4 + n
        out[name] = Member(name, method, full, packed, header)
        at = end + comments
    return out


def data_at(file, member: Member) -> int:
    """Offset of a stored member's bytes; its local header is read for the lengths of its name and extra field."""
    if member.method != 0 or member.size != member.packed:
        raise ValueError(f"{member.name} is compressed, ranges of it cannot be read")
    local = read_at(file, member.header, 30)
    if local[:4] != LOCAL:
        raise ValueError(f"no local header for {member.name}")
    return member.header + 30 + sum(struct.unpack_from("<HH", local, 26))


# ---- records


def exact(uri: str | None) -> str:
    """A url in a header field: JSON without a blank, so that null, blanks and line breaks come back as they were."""
    return json.dumps(uri).replace(" ", "\\u0020")


def record(kind: str, uri: str | None, payload: bytes, digest: str, fields: Iterable[tuple[str, str]]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri or ""), ("X-Url", exact(uri)),
            ("WARC-Payload-Digest", f"sha1:{digest}"), *fields, ("Content-Type", "text/html"), ("Content-Length", str(len(payload)))]
    lines = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-cased names) and the block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record of another length than it says")
    return fields, rest[:n]


class ArchiveWriter:
    """One ZIP archive with two stored members: the gzip records one after the other, and their index."""

    def __init__(self, path: str, zip64: bool) -> None:
        self.path, self.index, self.size = path, [], 0
        system, inner = fs.FileSystem.from_uri(path)
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(inner)
        self.zip = zipfile.ZipFile(Unseekable(self.out), "w", zipfile.ZIP_STORED)
        self.zip64 = zip64
        self.member = self.zip.open(zipfile.ZipInfo(RECORDS), "w", force_zip64=True)

    def add(self, uri: str, raw: bytes, entry: dict) -> None:
        packed = gzip.compress(raw, 1, mtime=0)
        self.member.write(packed)
        self.index.append(json.dumps(entry | {"url": uri, "offset": self.size, "length": len(packed)}))
        self.size += len(packed)

    def close(self) -> None:
        self.member.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=self.zip64) as index:
            index.write("".join(f"{x}\n" for x in self.index).encode())
        self.zip.close()
        self.out.close()


class Unseekable(io.RawIOBase):
    """Write-only view of a stream: shared stores take no second write to the start of a file."""

    def __init__(self, out) -> None:
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytes(data))
        return len(data)


# ---- tables


def revisits(pages: DataFrame, page: str, digest: Column, size: Column, least_bytes: int) -> DataFrame:
    """``id, digest, refers_to`` of the rows that revisit: same payload as a row with a larger id, and not too small."""
    small = pages.select(F.col(page).cast("long").alias("id"), digest.alias("digest"), size.alias("n")).filter(F.col("n") >= least_bytes).drop("n")
    top = small.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return small.join(top, "digest").filter("id <> refers_to").select("id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, page: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0,
                   archive_bytes: int = 64 << 20, zip64: bool = False) -> DataFrame:
    """A WARC record for every row, in ZIP archives below ``folder``; returns ``path, size, records`` of each.

    The payload is the text in UTF-8 (null: empty). Of records with equal payloads of at least ``least_bytes``
    bytes the one with the largest id is the response; the others are revisits, which refer to it and have no payload.
    Smaller payloads are all responses, and so are rows without an id. Rows that repeat the id and the payload of a response are
    responses too; an id with several payloads is decided for each of them.

    Payloads are not shuffled by their digest alone: only (id, digest) is, and the resulting revisits, stored, meet
    the rows by both. ``folder`` must be a URI that the executors can write (``file:``, ``hdfs:``, ``s3:``); each attempt of a
    task writes archives of its own, of about ``archive_bytes``, and only those of the attempt that succeeded
    are in the returned, stored table.
    """
    text = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    known = stored(revisits(pages, page, F.sha1(text), F.length(text), least_bytes), "revisits")
    known = known.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), "refers_to")
    rows = pages.select(F.col(page).cast("long").alias("id"), F.col(url).alias("url"), F.col(payload).alias("payload"), F.sha1(text).alias("digest")).join(
        known, (F.col("id") == F.col("__id")) & (F.col("digest") == F.col("__digest")), "left").select("id", "url", "payload", "refers_to")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, made = None, []

        def close() -> None:
            writer.close()
            system, inner = fs.FileSystem.from_uri(writer.path)
            made.append((writer.path, system.get_file_info(inner).size, len(writer.index)))

        for batch in slices(batches, "payload"):
            columns = (batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), batch.column(3).to_pylist())
            for name, uri, body, refers in zip(*columns, strict=True):
                writer = writer or ArchiveWriter(f"{folder}/{uuid.uuid4().hex}.zip", zip64)
                body = body or b""
                kind, digest = "response" if refers is None else "revisit", digest_of(body)
                fields = [("X-Page-ID", "" if name is None else str(name)), ("X-Payload-Length", str(len(body)))]
                if refers is not None:
                    fields += [("WARC-Refers-To", f"page:{refers}"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                writer.add(uri or "", record(kind, uri, body if refers is None else b"", digest, fields), {"type": kind, "digest": digest})
                if writer.size >= archive_bytes:
                    close()
                    writer = None
        if writer:
            close()
        paths, sizes, records = zip(*made, strict=True) if made else ((), (), ())
        yield pa.record_batch([pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(records, pa.int64())], ["path", "size", "records"])

    return stored(in_arrow(rows, run, "path string, size long, records long"), "manifest")


def index_of(archives: DataFrame) -> DataFrame:
    """``path, start, length`` of every record (offsets in the archive file), read from each archive's directory and index."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, inner = fs.FileSystem.from_uri(path)
                with system.open_input_file(inner) as file:
                    members = directory(file, size)
                    base, index = data_at(file, members[RECORDS]), members[INDEX]
                    entries = [json.loads(x) for x in read_at(file, data_at(file, index), index.size).splitlines()]
                yield pa.record_batch([pa.array([path] * len(entries), pa.string()), pa.array([base + e["offset"] for e in entries], pa.int64()),
                                       pa.array([e["length"] for e in entries], pa.int64())], ["path", "start", "length"])

    return in_arrow(archives.select("path", "size"), run, "path string, start long, length long")


RECORD = T.StructType([T.StructField(n, t) for n, t in (("page_id", T.LongType()), ("url", T.StringType()), ("record_type", T.StringType()), ("payload_bytes", T.LongType()),
                                                       ("payload_digest", T.StringType()), ("refers_to", T.LongType()), ("payload", T.BinaryType()))])


def read_archives(archives: DataFrame, parts: int | None = None, with_payload: bool = True) -> DataFrame:
    """The records of ZIP archives (``path, size``), read by ranges without extracting anything.

    Directories and indexes are read first; the ranges of all records are then dealt out over ``parts`` tasks, so a large archive is
    read by many. Digests of responses are computed from the payload that was read and must equal the record's.
    """
    spark = archives.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Neighbouring ranges of an archive stay together, up to 8 MB.
    ranges = index_of(archives.repartition(parts, "path")).withColumn("chunk", F.floor(F.col("start") / (8 << 20)))
    dealt = ranges.repartition(parts, "path", "chunk").sortWithinPartitions("path", "start")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, file = None, None
        for batch in batches:
            rows: list[dict] = []
            held = 0
            for path, start, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if path != at:
                    system, inner = fs.FileSystem.from_uri(path)
                    at, file = path, system.open_input_file(inner)
                fields, body = parse(zlib.decompress(read_at(file, start, length), 31))
                name, digest, refers = fields["x-page-id"], fields["warc-payload-digest"].removeprefix("sha1:"), fields.get("warc-refers-to")
                if fields["warc-type"] == "response" and digest_of(body) != digest:
                    raise ValueError(f"damaged payload at {start} in {path}")
                rows.append({"page_id": int(name) if name else None, "url": json.loads(fields["x-url"]) if "x-url" in fields else fields["warc-target-uri"], "record_type": fields["warc-type"],
                             "payload_bytes": int(fields["x-payload-length"]), "payload_digest": digest,
                             "refers_to": int(refers.removeprefix("page:")) if refers else None, "payload": body if with_payload else None})
                held += len(body) * with_payload
                if held > 16 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
            yield _batch(rows)

    return in_arrow(dealt.select("path", "start", "length"), run, RECORD)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    return pa.record_batch([pa.array([r[f.name] for r in rows], k) for f, k in zip(RECORD.fields, kinds, strict=True)], RECORD.fieldNames())


def archive_pages(pages: DataFrame, **options) -> DataFrame:
    """Write every page to archives in the shared folder and read them back."""
    return read_archives(write_archives(pages, shared_folder(pages.sparkSession, "archives"), **options), with_payload=False)
