"""WARC archives: write records, index them first, read selected ones by coalesced byte ranges.

Each task writes one gzip-per-record archive of its own into the shared folder and returns an index row
(file, offset, length, url, digest) per record; the index is a written table, so only archives of committed
task attempts are ever referred to.  Reading sorts the selected index rows by file and offset, deals them in
windows of a file, and fetches neighbouring records with one read.

Archives are opened with pyarrow's filesystems, so the shared folder can be a local or mounted path, HDFS
or an object store that they know.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach_min, bound_batches, bounded, stage, work_path

REVISIT_FROM = 100
GAP, SPAN, WINDOW = 64 * 1024, 8 * 1024 * 1024, 16 * 1024 * 1024
_DATE = "2024-01-01T00:00:00Z"
INDEX = "page_id long, file string, offset long, length long, url string, digest string, record_type string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _line(text: str) -> str:
    """A header value: control characters are percent-encoded, so none can end the line."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in text)


def encode_record(name: str, url: str | None, digest: str, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member.  A revisit has no payload; its digest and length are those of the full one."""
    http = b"" if refers_to is not None else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (b"" if refers_to is not None else payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(4, wbits=31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def decode_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of a gzip member."""
    raw = zlib.decompress(member, wbits=31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2] if fields["warc-type"] == "response" else b""


def find_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to): of pages with equal payloads of at least 100 bytes, those that are not
    the one with the smallest id, and that one."""
    long = stage(pages.where(F.octet_length("html") >= REVISIT_FROM).select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest")), "digests")
    first = attach_min(long, ["digest"], "page_id", "refers_to")
    return stage(first.where("refers_to is not null and (page_id is null or page_id > refers_to)").distinct(), "revisits")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) under ``folder``; returns the index.

    A null html is an empty payload, a null url leaves the target header out.  Equal payloads under 100
    bytes, and rows that repeat the smallest page_id of their payload, are all responses; rows with a
    null page_id revisit the smallest id if there is one.  Other columns are not read.
    """
    bound_batches(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    revisits = find_revisits(pages)
    rows = revisits.count()
    side = bounded(revisits.withColumnRenamed("page_id", "_id").withColumnRenamed("digest", "_digest"), rows, 160)
    hashed = pages.withColumn("digest", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256))
    full = hashed.join(side, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left").select("page_id", "url", "html", "digest", "refers_to")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_folder(folder)
        fs.create_dir(base, recursive=True)
        out, offset, at = None, 0, TaskContext.get()
        file = f"part-{at.partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            rows = []
            for page, url, html, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = fs.open_output_stream(f"{base}/{file}", compression=None)
                member = encode_record(str(uuid.uuid4()), url, digest, (html or "").encode(), refers)
                out.write(member)
                rows.append((page, file, offset, len(member), url, digest, "response" if refers is None else "revisit"))
                offset += len(member)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])
        if out is not None:
            out.close()

    return stage(full.mapInArrow(write, INDEX), "warc-index")


def ranges(rows: Iterable[tuple], gap: int = GAP, span: int = SPAN) -> Iterator[tuple[str, int, int, list[tuple]]]:
    """Coalesce (file, offset, length, ...) rows, sorted, into (file, begin, end, rows) reads: neighbours at
    most ``gap`` bytes apart share a read of at most ``span`` bytes (or of one longer record)."""
    file, begin, end, held = None, 0, 0, []
    for row in rows:
        if held and (row[0] != file or row[1] > end + gap or row[1] + row[2] - begin > span):
            yield file, begin, end, held
            held = []
        if not held:
            file, begin, end = row[0], row[1], row[1]
        held.append(row)
        end = max(end, row[1] + row[2])
    if held:
        yield file, begin, end, held


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` (any selection of an index's rows) points to, payload checked against
    its digest; a revisit has a null payload and the digest and length of the one it refers to."""
    bound_batches(index.sparkSession)
    placed = index.select("file", "offset", "length", "page_id").withColumn("_w", F.floor(F.col("offset") / WINDOW))
    # as many tasks as the payloads need: the index itself is small, and would be read by one
    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // WINDOW))
    dealt = placed.repartition(int(tasks), "file", "_w").sortWithinPartitions("file", "offset").drop("_w")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_folder(folder)
        names = [x.split()[0] for x in RECORD.split(", ")]
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
        open_name, source = None, None
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for file, begin, end, held in ranges(rows):
            if file != open_name:
                open_name, source = file, fs.open_input_file(f"{base}/{file}")
            data = source.read_at(end - begin, begin)
            out = []
            for _, offset, length, page in held:
                fields, payload = decode_record(data[offset - begin : offset - begin + length])
                digest = fields["warc-payload-digest"].removeprefix("sha256:")
                refers = fields.get("x-refers-to-page")
                if refers is None and hashlib.sha256(payload).hexdigest() != digest:
                    raise OSError(f"digest mismatch in {file} at {offset}")
                out.append((page, int(fields["x-payload-length"]), digest, fields["warc-type"], None if refers is None else int(refers), fields.get("warc-target-uri"), payload if refers is None else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return dealt.mapInArrow(read, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` in the shared folder and read every record back."""
    folder = work_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder)
