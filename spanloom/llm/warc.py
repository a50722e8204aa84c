"""Deterministic sharded WARC archives (op6).

Records are range-sorted by page_id; each partition writes gzip members into
files that roll at a compressed size.  Headers, record ids and digests are
made from the record alone, gzip times are zero, the date is a parameter: the
same table gives the same bytes.  A file is written under a name of its task
attempt and renamed when complete to one that holds its digest, so a second
attempt at a task finds the same file in place or adds one of its own, and none is
ever replaced; the manifest, a table of the files of every partition, is
committed last by Spark and is all that readers look at, so what a lost task
left behind is never read.  Files are read back a file a task.

Of equal payloads of at least ``LEAST`` bytes one row is the response and the
others revisit it.  The owner of each digest is a partial maximum over a written
table of page ids and digests; owners of very many pages are broadcast to them, so
no digest's pages meet in one task.  Revisits travel as small rows that sort just
before their page, so pages are shuffled once and never meet by digest.

Edge cases: a null payload is empty and its record a response; line breaks in
urls are dropped and a null url is left out; rows that repeat a page_id and
payload revisit the first of them; a row without page_id revisits the owner of
its payload, or the first such row, and refers to no page_id then; an empty
table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import release, scratch, spread, table, written

LEAST = 1000
ROLL_BYTES = 32 << 20
DATE = "2020-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "file string, records long, bytes long, sha256 string"


def record_id(page_id: int | None, digest: bytes, nth: int = 0) -> str:
    """A version 8 UUID that holds page_id, or version 5 without one."""
    tail = (int.from_bytes(digest[:8], "big") ^ nth) & (1 << 58) - 1
    page = (page_id or 0) & (1 << 64) - 1
    number = (page >> 16) << 80 | (5 if page_id is None else 8) << 76 | (page >> 4 & 0xFFF) << 64 | 2 << 62 | (page & 15) << 58 | tail
    return f"<urn:uuid:{uuid.UUID(int=number)}>"


def page_of(record: str) -> int | None:
    number = uuid.UUID(record.strip("<>")[9:]).int
    if number >> 76 & 15 == 5:
        return None
    page = (number >> 80) << 16 | (number >> 64 & 0xFFF) << 4 | number >> 58 & 15
    return page - (1 << 64) if page >> 63 else page


def member(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers: int | None, revisit: bool, nth: int, date: str) -> bytes:
    """One record as a gzip member; a revisit keeps the HTTP head, with the full payload's length, and no body."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest, nth)}",
        f"WARC-Date: {date}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "").replace("\n", ""))
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(refers, digest)}", f"WARC-Profile: {_PROFILE}"]
    lines += [
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


class _Roller:
    """Files of one partition, complete ones under their final names."""

    def __init__(self, folder: str, partition: int, attempt: str, roll: int):
        self.fs, self.root = fs.FileSystem.from_uri(folder)
        self.partition, self.attempt, self.roll, self.done = partition, attempt, roll, []
        self.out = None

    def add(self, blob: bytes) -> None:
        if self.out is None:
            self.temporary = f"{self.root}/_temporary-{self.partition:05d}-{self.attempt}-{len(self.done):04d}"
            self.out, self.records, self.size, self.sha = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
        self.out.write(blob)
        self.sha.update(blob)
        self.records, self.size = self.records + 1, self.size + len(blob)
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        name = f"part-{self.partition:05d}-{len(self.done):04d}-{self.sha.hexdigest()[:16]}.warc.gz"
        if self.fs.get_file_info(f"{self.root}/{name}").type == fs.FileType.NotFound:
            self.fs.move(self.temporary, f"{self.root}/{name}")
        else:  # another attempt has written the same bytes
            self.fs.delete_file(self.temporary)
        self.done.append((name, self.records, self.size, self.sha.hexdigest()))
        self.out = None


def write(pages: DataFrame, folder: str, roll: int = ROLL_BYTES, date: str = DATE, least: int = LEAST) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) into ``folder``; the manifest table."""
    spark = pages.sparkSession
    body = F.coalesce("html", F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), F.sha1(body).alias("digest"))
    keys = written(pages.where(F.octet_length("html") >= least).select("page_id", "digest"), "digests")
    owners = written(keys.groupBy("digest").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1"), "owners")
    revisits = spread(keys, owners, ["digest"], "n").drop("n").where("page_id is null or page_id <> owner").distinct()
    none = F.lit(None)
    rows = revisits.select("page_id", "digest", F.lit(0).alias("what"), none.cast("string").alias("url"), none.cast("string").alias("html"), "owner").unionByName(
        pages.select("page_id", "digest", F.lit(1).alias("what"), "url", "html", none.cast("long").alias("owner"))
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "page_id", "digest").sortWithinPartitions("page_id", "digest", "what", "url")
    fs_, root = fs.FileSystem.from_uri(folder)
    fs_.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        roller = _Roller(folder, context.partitionId(), str(context.taskAttemptId()), roll)
        last, owner, known, nth = None, None, False, 0
        for batch in batches:
            for page, digest, what, url, html, who in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (page, digest) != last:
                    last, owner, known, nth = (page, digest), None, False, 0
                if what == 0:
                    owner, known = who, who is not None
                    continue
                payload = html.encode()
                again = nth > 0 and len(payload) >= least
                refers = owner if known else page
                roller.add(member(page, url, payload, bytes.fromhex(digest), refers, known or again, nth, date))
                nth += 1
        roller.close()
        names = ["file", "records", "bytes", "sha256"]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[i] for f in roller.done], pa.string() if i in (0, 3) else pa.int64()) for i in range(4)], names
        )

    rows.mapInArrow(run, _MANIFEST).write.parquet(f"{folder}/manifest")
    release(keys, owners)
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, one gzip member at a time."""
    unpack, out, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(1 << 20)
        if not data:
            if out:
                raise ValueError("the archive ends within a record")
            return
        out.append(unpack.decompress(data))
        rest = unpack.unused_data
        if unpack.eof:
            raw = b"".join(out)
            head, _, body = raw.partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines)
            size = int(fields["Content-Length"])
            if not version.startswith("WARC/") or body[size:] != b"\r\n\r\n":
                raise ValueError("not a WARC record")
            yield fields, body[:size]
            unpack, out = zlib.decompressobj(31), []


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the files that the manifest names, digests verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file in batch.column("file").to_pylist():
                rows = []
                with store.open_input_stream(f"{root}/{file}", compression=None) as stream:
                    for fields, block in records(stream):
                        rows.append(_row(fields, block))
                        if len(rows) == 64:
                            yield _batch(rows)
                            rows = []
                yield _batch(rows)

    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").select("file")
    manifest = manifest.repartition(max(1, manifest.count()))  # dealt in turn: a file or two a task
    schema = "page_id long, url string, html string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return manifest.mapInArrow(run, schema)


def _digest(field: str) -> bytes:
    return base64.b32decode(field.removeprefix("sha1:"))


def _row(fields: dict[str, str], block: bytes) -> tuple:
    if hashlib.sha1(block).digest() != _digest(fields["WARC-Block-Digest"]):
        raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
    head, _, body = block.partition(b"\r\n\r\n")
    size = int(head.rpartition(b"Content-Length: ")[2])
    digest, revisit = _digest(fields["WARC-Payload-Digest"]), fields["WARC-Type"] == "revisit"
    if not revisit and (len(body) != size or hashlib.sha1(body).digest() != digest):
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
    return (
        page_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), None if revisit else body.decode(), size, digest.hex(),
        fields["WARC-Type"], page_of(fields["WARC-Refers-To"]) if revisit else None,
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = os.path.join(scratch(spark), "spanloom", f"warc-{uuid.uuid4().hex}")
    write(table(spark, sf_dir, "pages"), folder)
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The rows that a round trip must give back.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS digest FROM p),
o AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS owner FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 1000 AND owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND owner <> page_id THEN owner END AS refers_to
FROM o
"""
