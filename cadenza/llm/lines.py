"""Line dedup with levelled sorted runs of line hashes.

Documents come in batches of rising doc_id.  A shard of a batch (see ``common``) gives one row for
each line key it holds: the key's 128-bit hash and the smallest doc_id.  A batch keeps the
smallest doc_id of each key (partial sums first, so a frequent line costs a row per shard), merge-anti-joins
the runs of earlier batches, and adds what is new as a run of its own, hash-bucketed and sorted.
``FAN_IN`` runs of a level are merged into one of the next.  All runs together then name each
key's owner, and every shard learns for its own keys who that is.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, drop_path, fresh_path, kept, shard_count, shard_of, shared_dir, text_bytes

#: Keys shorter than this many code points stay.
LEAST_CHARS = 10
#: Batches of a bulk load, and runs of a level that are merged.
BATCHES, FAN_IN = 4, 2
#: Buckets of a run at most; Spark refuses more than 100,000.
MOST_BUCKETS = 16_384
#: Stands for a null doc_id: after all others.
LAST_ID = (1 << 63) - 1
_KEY = ["hi", "lo"]


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z lower-cased; empty if too short to count."""
    key = line.strip().translate(LOWER)
    size = len(key)
    if size < LEAST_CHARS or (size < 4 * LEAST_CHARS and len(key.decode("utf-8", "replace")) < LEAST_CHARS):
        return b""
    return key


class Runs:
    """Disjoint sorted runs of (hi, lo, owner) on levels, as bucketed tables in the shared folder."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.levels = spark, buckets, [[]]
        shared_dir(spark)

    def _write(self, rows: DataFrame) -> tuple[str, str]:
        name, path = f"line_run_{uuid.uuid4().hex}", fresh_path(self.spark, "line-run")
        (
            rows.repartition(self.buckets, *_KEY)
            .write.bucketBy(self.buckets, *_KEY)
            .sortBy(*_KEY)
            .option("path", path)
            .option("compression", "zstd")
            .saveAsTable(name)
        )
        return name, path

    def rows(self) -> DataFrame:
        """All runs: every key once with its owner."""
        found = [self.spark.table(name) for level in self.levels for name, _ in level]
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    def forget(self) -> None:
        """Take the runs' names out of the catalog; their files stay for plans that read them."""
        for level in self.levels:
            for name, _ in level:
                self.spark.sql(f"DROP TABLE {name}")

    def add(self, batch: DataFrame) -> None:
        """Add the keys of ``batch`` (hi, lo, owner; each key once) that no run has."""
        for level in self.levels:
            for name, _ in level:
                batch = batch.join(self.spark.table(name).select(*_KEY).hint("merge"), _KEY, "left_anti")
        self.levels[0].append(self._write(batch))
        for at, level in enumerate(self.levels):
            if len(level) >= FAN_IN:
                self._compact(at)

    def _compact(self, at: int) -> None:
        old = self.levels[at]
        rows = self.spark.table(old[0][0])
        for name, _ in old[1:]:
            rows = rows.unionByName(self.spark.table(name))
        if at + 1 == len(self.levels):
            self.levels.append([])
        self.levels[at + 1].append(self._write(rows))
        self.levels[at] = []
        for name, path in old:
            self.spark.sql(f"DROP TABLE {name}")
            drop_path(self.spark, path)


def _shard_keys(table: pa.Table) -> pa.Table:
    """The keys of one shard: batch, shard, hi, lo, smallest doc_id, whether several ids hold it."""
    first: dict[bytes, int] = {}
    several: set[bytes] = set()
    digest = xxhash.xxh3_128_digest
    for doc, text in zip(table["id"].to_pylist(), table["text"].to_pylist(), strict=True):
        for key in {k for line in (text or b"").split(b"\n") if (k := line_key(line))}:
            at = digest(key)
            owner = first.setdefault(at, doc)
            if owner != doc:
                several.add(at)
                if doc < owner:
                    first[at] = doc
    n = len(first)
    halves = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), n, [None, pa.py_buffer(b"".join(first))])
    longs = pa.Array.from_buffers(pa.int64(), 2 * n, [None, halves.buffers()[1]])
    every = pa.array(range(n), pa.int64())
    two = pa.compute.multiply(every, 2)
    return pa.table(
        {
            "batch": pa.repeat(pa.scalar(table["batch"][0].as_py(), pa.int32()), n),
            "shard": pa.repeat(pa.scalar(table["shard"][0].as_py(), pa.int32()), n),
            "hi": longs.take(two),
            "lo": longs.take(pa.compute.add(two, 1)),
            "doc": pa.array(list(first.values()), pa.int64()),
            "several": pa.array([k in several for k in first], pa.bool_()),
        }
    )


def _drop_lines(docs: pa.Table, owners: pa.Table) -> pa.Table:
    """One shard's documents without the lines that other documents own."""
    owner = dict(zip(zip(owners["hi"].to_pylist(), owners["lo"].to_pylist(), strict=True), owners["doc"].to_pylist(), strict=True))
    texts, n_lines, n_dropped = [], [], []
    for doc, text in zip(docs["id"].to_pylist(), docs["text"].to_pylist(), strict=True):
        lines = (text or b"").split(b"\n")
        stay = []
        for line in lines:
            if key := line_key(line):
                at = xxhash.xxh3_128_digest(key)
                if owner.get((int.from_bytes(at[:8], "little", signed=True), int.from_bytes(at[8:], "little", signed=True)), doc) != doc:
                    continue
            stay.append(line)
        n_lines.append(len(lines))
        n_dropped.append(len(lines) - len(stay))
        texts.append(b"\n".join(stay))
    return pa.table(
        {
            "row": docs["row"],
            "n_lines": pa.array(n_lines, pa.int64()),
            "n_dropped": pa.array(n_dropped, pa.int64()),
            "kept_text": pa.array(texts, pa.binary()),
        }
    )


def dedup_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``row`` (a struct of all other columns of ``docs``), n_lines, n_dropped and kept_text.

    A key of ``LEAST_CHARS`` code points or more that at least two doc_ids hold loses its lines in
    all documents but those with the smallest of the ids.  A null or empty text is one empty line.
    Rows that share a doc_id count as one document and keep their lines alike; a null doc_id comes
    after all others.  An empty table gives no rows."""
    spark = docs.sparkSession
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    n = shard_count(text_bytes(docs), 8 << 20)
    shares = [k / batches for k in range(1, batches)]
    found = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), shares, 1000)).first()[0] if shares else None
    cuts = sorted(set(found or ()))
    per = shard_count(n, max(1, len(cuts) + 1))
    batch = F.lit(0)
    for cut in cuts:
        batch = batch + (F.col("id") >= F.lit(int(cut))).cast("int")
    rest = [c for c in docs.columns if c != "text"]
    base = docs.select(ids.alias("id"), F.col("text").cast("string").cast("binary").alias("text"), F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"))
    base = base.withColumn("batch", batch.cast("int")).withColumn("shard", F.col("batch") * per + shard_of(per, "id", "text"))
    keys = kept(
        base.select("id", "text", "batch", "shard")
        .groupBy("shard")
        .applyInArrow(_shard_keys, "batch int, shard int, hi long, lo long, doc long, several boolean"),
        "line-keys",
    )
    runs = Runs(spark, min(max(8, n), MOST_BUCKETS))
    for b in range(len(cuts) + 1):
        own = keys.where(F.col("batch") == b)
        runs.add(own.groupBy(*_KEY).agg(F.min("doc").alias("owner")))
    owners = runs.rows()
    runs.forget()
    told = keys.join(owners.hint("merge"), _KEY).where(F.col("several") | (F.col("owner") < F.col("doc"))).select("shard", "hi", "lo", F.col("owner").alias("doc"))
    row = base.schema["row"].dataType.simpleString()
    return (
        base.select("id", "text", "row", "shard")
        .groupBy("shard")
        .cogroup(told.groupBy("shard"))
        .applyInArrow(_drop_lines, f"row {row}, n_lines long, n_dropped long, kept_text binary")
        .withColumn("kept_text", F.col("kept_text").cast("string"))
    )
