"""Deterministic sharded WARC writer and its reader.

Pages are range-sorted by page_id: shards are ranges of ids cut by payload size, and a shard is
sorted by id.  A shard writes gzip members one record each and starts a new file when the
compressed size reaches ``roll_bytes``.  Headers and digests are made anew from the payload, with
a fixed date, so a rerun or a retried task writes the same bytes.

A file is written under a temporary name and renamed when complete; the table of files is
written last, under a temporary name too, and renamed: that is the commit.  A folder is committed
once.  Readers open the archives that the manifest names, no others, and hold each against its
size, digest and number of records there.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, range_shards

#: Payloads below this many bytes are never revisits.
LEAST_BYTES = 100
#: Payload bytes of a shard; compressed bytes at which a file is full.
SHARD_BYTES, ROLL_BYTES = 16 << 20, 8 << 20
DATE = "2024-01-01T00:00:00Z"
#: The table of a folder's archives; its presence is the commit.
MANIFEST = "_manifest"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{page_id} {digest}'.encode()).hexdigest()[:32])}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers: bool) -> bytes:
    """One WARC record: the response, or a revisit that names it and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {_urn(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~.-_')}")
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    head.append(f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}")
    if refers:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to, digest)}"]
        if refers_to is not None:
            head.append(f"Refers-To-Page-ID: {refers_to}")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without name or time."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of a gzip archive."""
    with gzip.open(io.BytesIO(archive)) as g:
        while line := g.readline():
            if not line.startswith(b"WARC/"):
                continue
            head: dict[str, str] = {}
            while (line := g.readline().rstrip(b"\r\n")):
                name, _, value = line.decode().partition(":")
                head[name.lower()] = value.strip()
            yield head, g.read(int(head["content-length"]))


class _Shard:
    """Writer of one shard's files."""

    def __init__(self, root: str, shard: int, roll: int):
        from pyarrow.fs import FileSystem

        self.fs, self.root = FileSystem.from_uri(root)
        self.shard, self.roll, self.seq, self.rows = shard, roll, 0, []
        self.out = None

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.seq:05d}.warc.gz"
            self.temporary = f"{self.root}/_writing-{uuid.uuid4().hex}-{self.name}.tmp"
            self.out, self.size, self.n, self.digest = self.fs.open_output_stream(self.temporary), 0, 0, hashlib.sha256()
        packed = member(data)
        self.out.write(packed)
        self.digest.update(packed)
        self.size, self.n = self.size + len(packed), self.n + 1
        if self.size >= self.roll:
            self.close()

    def _rename(self, target: str) -> None:
        """Give the complete file its name.  Where a former attempt at this task did so, its file
        has the same bytes and stays."""
        from pyarrow.fs import FileType

        there = lambda: self.fs.get_file_info(target).type == FileType.File
        if not there():
            try:
                return self.fs.move(self.temporary, target)
            except OSError:
                if not there():
                    raise
        self.fs.delete_file(self.temporary)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self._rename(f"{self.root}/{self.name}")
            self.rows.append((self.shard, self.name, self.n, self.size, self.digest.hexdigest()))
            self.out, self.seq = None, self.seq + 1


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, digest and first (the page it revisits) of each page that is a revisit.

    Of equal payloads of ``LEAST_BYTES`` or more, rows with the smallest page_id are responses
    (several, if rows share that id) and the others revisit it; a null id is no smallest."""
    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    large = pages.where(F.octet_length(payload) >= LEAST_BYTES).select(F.col("page_id").cast("long"), F.sha2(payload, 256).alias("digest"))
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    return large.join(first.drop("n"), "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).distinct()


def _write_shard(root: str, roll_bytes: int):
    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        first = dict(zip(zip(known["page_id"].to_pylist(), known["digest"].to_pylist(), strict=True), known["first"].to_pylist(), strict=True))
        pages = [(r["page_id"] is not None, r["page_id"] or 0, hashlib.sha256(r["payload"]).hexdigest(), r["url"] or "", r) for r in rows.to_pylist()]
        pages.sort(key=lambda p: p[:4])
        writer = _Shard(root, rows["shard"][0].as_py() if len(rows) else -1, roll_bytes)
        for _, _, digest, _, r in pages:
            key = (r["page_id"], digest)
            writer.add(record(r["page_id"], r["url"], r["payload"], digest, first.get(key), key in first))
        writer.close()
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.table([pa.array([r[i] for r in writer.rows], k) for i, k in enumerate(kinds)], ["shard", "file", "n_records", "n_bytes", "sha256"])

    return run


def write_archives(pages: DataFrame, root: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write ``pages`` under the shared folder ``root`` and give its manifest: shard, file, n_records,
    n_bytes, sha256 of each archive.

    Shards are ranges of page_id; rows without one come first, dealt by their payload.  Repeated
    rows are records of their own; extra columns stay behind.  An empty table writes an empty
    manifest.  A committed folder is refused; what an unfinished write left there does no harm."""
    spark = pages.sparkSession
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    disk = fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    manifest = fs.Path(f"{root}/{MANIFEST}")
    if disk.exists(manifest):
        raise FileExistsError(f"{root} holds committed archives")
    disk.mkdirs(fs.Path(root))

    html = F.col("html").cast("string")
    sized = pages.select(F.col("page_id").cast("long"), (F.coalesce(F.octet_length(html), F.lit(0)) + 512).alias("size"))
    place, _ = range_shards(sized, "page_id", "size", shard_bytes)
    without = int(sized.where("page_id IS NULL").agg(F.sum("size")).first()[0] or 0)
    n = -(-without // shard_bytes)

    def dealt(rows: DataFrame, digest: Column):
        by_payload = F.pmod(F.xxhash64(digest), F.lit(max(1, n))).cast("int")
        return rows.withColumn("shard", F.when(F.col("page_id").isNull(), by_payload).otherwise(place(F.col("page_id")) + n)).groupBy("shard")

    full = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(html.cast("binary"), F.lit(b"")).alias("payload"))
    done = (
        dealt(full, F.sha2("payload", 256))
        .cogroup(dealt(revisits(pages), F.col("digest")))
        .applyInArrow(_write_shard(root, roll_bytes), "shard int, file string, n_records long, n_bytes long, sha256 string")
    )
    held = fs.Path(f"{root}/{MANIFEST}-{uuid.uuid4().hex}.tmp")
    done.write.parquet(held.toString())
    if disk.exists(manifest) or not disk.rename(held, manifest):
        raise FileExistsError(f"{root} was committed meanwhile")
    return spark.read.parquet(manifest.toString())


def read_archives(spark: SparkSession, root: str) -> DataFrame:
    """Per record of a committed folder: page_id, url, payload (null for a revisit), payload_bytes,
    payload_digest, record_type, refers_to.

    Only files that the manifest names are opened; a missing or different one fails the job, and so
    does a payload that does not match its digest.  A folder without a manifest cannot be read."""
    manifest = spark.read.parquet(f"{root}/{MANIFEST}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        disk, home = FileSystem.from_uri(root)
        for file in (r for batch in batches for r in batch.to_pylist()):
            with disk.open_input_stream(f"{home}/{file['file']}", compression=None) as opened:
                data = opened.read()
            if len(data) != file["n_bytes"] or hashlib.sha256(data).hexdigest() != file["sha256"]:
                raise ValueError(f"{file['file']} is not the file of the manifest")
            rows = []
            for head, block in records(data):
                http, _, payload = block.partition(b"\r\n\r\n")
                said = head["warc-payload-digest"].removeprefix("sha256:")
                revisit = head["warc-type"] == "revisit"
                size = int(http.rpartition(b"Content-Length: ")[2]) if revisit else len(payload)
                digest = said if revisit else hashlib.sha256(payload).hexdigest()
                if digest != said:
                    raise ValueError(f"payload of page {head.get('page-id')} does not match its digest")
                ids = [int(head[k]) if k in head else None for k in ("page-id", "refers-to-page-id")]
                rows.append((ids[0], head.get("warc-target-uri"), None if revisit else payload, size, digest, head["warc-type"], ids[1]))
            if len(rows) != file["n_records"]:
                raise ValueError(f"{file['file']} has {len(rows)} records, not {file['n_records']}")
            kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            for at in range(0, len(rows), 1024):
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[at : at + 1024]], k) for i, k in enumerate(kinds)], names)

    tasks = max(1, min(manifest.count(), 100_000))
    return (
        manifest.select("file", "n_records", "n_bytes", "sha256")
        .repartition(tasks, "file")
        .mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")
    )


def archived(pages: DataFrame, root: str | None = None) -> DataFrame:
    """Write ``pages`` and read them back: a row per page as ``read_archives`` gives it."""
    spark = pages.sparkSession
    root = root or fresh_path(spark, "warc")
    write_archives(pages, root)
    return read_archives(spark, root)
