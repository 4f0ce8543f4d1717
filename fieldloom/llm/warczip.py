"""Web archives: WARC records in ZIP packages, written by tasks and range-read without extraction.

An archive is a ZIP file of stored members: `archive/*.warc.gz` (one gzip member a record), `indexes/index.cdxj` (a
line for each record with file, offset and length) and `datapackage.json`. Equal payloads of at least MIN_REVISIT
bytes are written once, by the record of the largest page_id; the others are revisit records that refer to it.

Writing: digests and roles are decided on narrow rows; payloads are shuffled once, by page. Each task writes
archives of bounded size to the shared folder under names of its own attempt; only names that a finished task has
returned count. Reading: a task opens an archive, parses its central (or ZIP64) directory, reads the index
member and then each record by its range, and takes all values from the record itself.

Archives are written through Arrow's file systems, which open the shared folder's URI (file, hdfs, s3, gs).

Defined results: a null html is an empty payload; a null url is written as a URN; rows that repeat the response's page_id
and payload are responses too; payloads that only differ below the limit are all responses; a null page_id is
written as "null", read back as null, and never revisits nor is referred to; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import columns, fresh_path, materialised, small_batches, utf8
from fieldloom.llm.ziparchive import ZipReader, ZipWriter

MIN_REVISIT, MEMBER_BYTES, ARCHIVE_BYTES = 1000, 8 << 20, 64 << 20
INDEX = "indexes/index.cdxj"
# Profile and media types of the record format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def record_id(page_id: object) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    value = record.strip("<>").rpartition(":")[2]
    return None if value == "null" else int(value)


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object) -> bytes:
    """One WARC record, packed as a gzip member. A revisit keeps the HTTP head and leaves the payload out."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    target = (url or f"urn:x-page-url:{page_id}").replace("\r", "%0D").replace("\n", "%0A")
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": target,
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "WARC-Block-Digest": "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(),
    }
    if revisit:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to)}
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(text.encode() + block + b"\r\n\r\n") + pack.flush()


def parsed(packed: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC fields, HTTP head and payload of one packed record; its block digest has to hold."""
    raw = gzip.decompress(packed)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"not a WARC record: {lines[0][:20]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if fields["warc-block-digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ValueError(f"block digest of {fields['warc-record-id']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


class ArchiveWriter:
    """Fills one archive: records gather in a member until it is large enough."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        system, place = fs.FileSystem.from_uri(self.path)
        system.create_dir(place.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(place)
        self.zip = ZipWriter(self.out.write)
        self.lines: list[tuple[str, str]] = []
        self.member: list[bytes] = []
        self.size = self.n = 0

    def add(self, page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object) -> None:
        packed = record(page_id, url, payload, digest, refers_to)
        name = f"archive/{self.n:05d}.warc.gz"
        entry = {"url": url, "digest": f"sha1:{digest}", "filename": name, "offset": self.size, "length": len(packed), "recordId": record_id(page_id)}
        self.lines.append((url or "", f"{quote(url or '', safe='/:?&=#%+,;@~')} {DATE} {json.dumps(entry)}"))
        self.member.append(packed)
        self.size += len(packed)
        if self.size >= MEMBER_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.member:
            self.zip.add(f"archive/{self.n:05d}.warc.gz", b"".join(self.member))
            self.member, self.size, self.n = [], 0, self.n + 1

    def full(self) -> bool:
        return self.zip.at >= ARCHIVE_BYTES

    def close(self) -> tuple[str, int, int]:
        self._flush()
        self.zip.add(INDEX, "\n".join(line for _, line in sorted(self.lines)).encode())
        self.zip.add("datapackage.json", json.dumps({"profile": "data-package", "resources": [{"name": m.name, "bytes": m.size, "crc32": m.crc} for m in self.zip.members]}).encode())
        self.zip.close()
        self.out.close()
        return self.path, len(self.lines), self.zip.at


def with_roles(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html, payload_digest and refers_to (null for responses)."""
    digest = F.sha1(F.encode(F.coalesce("html", F.lit("")), "utf-8"))
    narrow = pages.select("page_id", digest.alias("payload_digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n"))
    narrow = materialised(narrow.filter((F.col("n") >= min_revisit) & F.col("page_id").isNotNull()).drop("n"))
    holders = narrow.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).filter("least < refers_to").drop("least")
    revisits = narrow.distinct().join(holders, "payload_digest").filter("page_id <> refers_to")
    full = pages.select("page_id", "url", "html", digest.alias("payload_digest"))
    return full.join(revisits, ["page_id", "payload_digest"], "left").select("page_id", "url", "html", "payload_digest", "refers_to")


def write_archives(pages: DataFrame, folder: str | None = None, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Writes all pages and returns path, n_records and n_bytes of every archive."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or fresh_path(spark, "archives")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, archive = [], None
        for ids, urls, texts, digests, refers in columns(batches, "page_id", "url", "html", "payload_digest", "refers_to"):
            for page_id, url, html, digest, refers_to in zip(ids.to_pylist(), urls.to_pylist(), utf8(texts), digests.to_pylist(), refers.to_pylist(), strict=True):
                archive = archive or ArchiveWriter(folder)
                archive.add(page_id, url, html or b"", digest, refers_to)
                if archive.full():
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "n_records", "n_bytes"])

    return materialised(with_roles(pages, min_revisit).mapInArrow(write, "path string, n_records long, n_bytes long"))


def entries(reader: ZipReader) -> Iterator[dict]:
    """The lines of the archive's index member."""
    for line in reader.whole(INDEX).decode().split("\n"):
        if line:
            yield json.loads(line[line.index("{") :])


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record of the archives in `path`: page_id, url, payload (null for revisits), payload_bytes,
    payload_digest, record_type, refers_to."""
    small_batches(archives.sparkSession)
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (paths,) in columns(batches, "path"):
            for path in paths.to_pylist():
                system, place = fs.FileSystem.from_uri(path)
                with system.open_input_file(place) as f:
                    reader, rows = ZipReader(lambda at, n, f=f: f.read_at(n, at), f.size()), []
                    for entry in entries(reader):
                        fields, http, payload = parsed(reader.range(entry["filename"], entry["offset"], entry["length"]))
                        kind = fields["warc-type"]
                        stated = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
                        if kind == "response":
                            digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
                            if digest != stated:
                                raise ValueError(f"payload digest of {fields['warc-record-id']}")
                        else:
                            size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                            digest, payload = stated, None
                        refers = fields.get("warc-refers-to")
                        rows.append((page_of(fields["warc-record-id"]), entry["url"], payload, size, digest, kind, page_of(refers) if refers else None))
                        if len(rows) >= 200:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    return archives.select("path").mapInArrow(read, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")
