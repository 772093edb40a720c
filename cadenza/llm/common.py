"""Helpers shared by the training-data operators.

Documents meet the other side of a job in *shards*: groups of whole documents dealt by a hash of
``doc_id``.  A shard first summarises its documents (so a line, token or passage that a third of
the corpus holds becomes one row per shard), the summaries meet by key, and the answers return to
the shard.  Shards hold about ``SHARD_BYTES`` of text, so their number follows the input.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from inspect import signature

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text in one shard, on average.  A single longer document makes a longer shard.
SHARD_BYTES = 12 << 20

#: The characters that the contracts count as white space.
SPACE = " \t\n\x0b\x0c\r"

#: ASCII-only lower-casing for bytes.translate.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Without that setting a local session gets a temporary folder, as in tests; a cluster is refused,
    since its executors could not read one of this machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not found:
        found = sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import atexit
        import shutil
        import tempfile

        made = tempfile.mkdtemp(prefix="cadenza-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        found = f"file://{made}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: short lineage, and any
    executor can read it after another was lost."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def give_back() -> None:
    """Return freed memory to the system, where the C library can: Python workers live on between
    stages, and what one stage has freed is then the next one's to take."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes in a text column; one pass that the driver sees as one number."""
    return int(docs.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def shard_count(n_bytes: int, target: int = SHARD_BYTES) -> int:
    return max(1, -(-n_bytes // target))


def shard_of(n: int, *columns: str) -> Column:
    """A row's shard of ``n`` by a hash of ``columns``.  With the text among them, rows of one id, or
    without any, are spread."""
    return F.pmod(F.xxhash64(F.lit(7), *columns), F.lit(n)).cast("int")


def bound_broadcast(df: DataFrame, most_rows: int, most_bytes: int = 32 << 20) -> DataFrame:
    """``df`` hinted for broadcast if counting shows at most ``most_rows`` rows with at most
    ``most_bytes`` in strings, else unhinted, so that Spark shuffles and splits skewed partitions."""
    strings = [F.octet_length(name) for name, kind in df.dtypes if kind in ("string", "binary")]
    held = F.sum(sum((F.coalesce(s, F.lit(0)) for s in strings), F.lit(0)))
    n, size = df.limit(most_rows + 1).agg(F.count("*"), held).first()
    return F.broadcast(df) if n <= most_rows and (size or 0) <= most_bytes else df


#: Bits of a bitmap for each key that it is made of, and bounds of its size (16 MB at most reach a task).
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 1 << 16, 1 << 27


def shared_bitmap(keys: DataFrame) -> Broadcast:
    """A broadcast bitmap with two bits for each key (a hash ``h``); see ``holds``.  A row for each used
    word of 64 bits reaches the driver."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << max(1, keys.count() * BITS_EACH - 1).bit_length()))
    at = F.explode(F.array(F.col("h").bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(size - 1))))
    cells = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    table = cells.toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[table["cell"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(bits)


def holds(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether a bitmap may have been made of each hash: always true for its own, rarely for others."""
    h, mask = h.view(np.uint64), np.uint64(len(bits) * 64 - 1)
    out = np.ones(len(h), bool)
    for at in (h & mask, (h >> np.uint64(32)) & mask):
        out &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0
    return out


#: Ranges at most (16 bytes each reach every task), and the share of a range that one sampled id
#: stands for: ranges differ in weight by about the root of it.
MOST_RANGES, SAMPLES = 1 << 20, 64


def range_shards(rows: DataFrame, key: str, weight: str, target: int) -> tuple[Callable[[Column], Column], int]:
    """Deterministic ranges of a long key that weigh ``target`` on average, for keys of any
    distribution: gives an expression of a key's range number (null for null), and the number.

    Ids enter a sample by a hash of the id, with a chance in proportion to their weight, and bounds
    lie where the sample's running weight passes the next share.  The sample only places the bounds:
    all rows get their range by binary search.  Equal keys share a range; the order of rows and partitions has
    no influence."""
    spark = rows.sparkSession
    total = int(rows.where(F.col(key).isNotNull()).agg(F.sum(weight)).first()[0] or 0)
    n = min(MOST_RANGES, max(1, -(-total // target)))
    bounds = np.empty(0, np.int64)
    if n > 1:
        each = total / (n * SAMPLES)
        chance = (F.shiftrightunsigned(F.xxhash64(F.lit(11), key), 11) / F.lit(float(1 << 53))).cast("double")
        taken = rows.where(F.col(key).isNotNull() & (chance < F.col(weight) / F.lit(each))).select(key, F.greatest(F.col(weight).cast("double"), F.lit(each)))
        found = np.array([tuple(r) for r in taken.toLocalIterator()], [("id", np.int64), ("w", np.float64)])  # some n * SAMPLES rows
        found = np.sort(found)
        ids, first = np.unique(found["id"], return_index=True)
        before = (np.cumsum(found["w"]) - found["w"])[first]
        at = (before * n / max(total, 1)).astype(np.int64)
        bounds = ids[1:][at[1:] != at[:-1]]
    sent = spark.sparkContext.broadcast(bounds)

    @F.arrow_udf("int")
    def place(ids: pa.Array) -> pa.Array:
        found = np.searchsorted(sent.value, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right")
        return pa.array(found.astype(np.int32), pa.int32(), mask=ids.is_null().to_numpy(zero_copy_only=False))

    return place, len(bounds) + 1


#: Rows that a shard sends to buckets, or a bucket to shards, at most.  More buckets, or shards, are
#: reached in two hops.
FAN = 1024


def _nested(flat: pa.Table, key: np.ndarray, name: str, **more: np.ndarray) -> pa.Table:
    """Rows of ``flat`` with equal ``key`` as one row: ``name``, ``more`` (of each key's first row)
    and ``parts``, a list of structs."""
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), np.diff(key[order]) != 0)))
    rows = flat.take(pa.array(order)).combine_chunks()
    parts = pa.StructArray.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rows.columns], rows.column_names)
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), parts)
    heads = {c: pa.array(v[order][first], pa.int32()) for c, v in {name: key, **more}.items()}
    return pa.table({**heads, "parts": lists})


def flattened(table: pa.Table) -> pa.Table:
    """Rows of ``through_buckets`` as its functions know them, however they travelled."""
    if "parts" not in table.column_names:
        return table
    parts = table["parts"].combine_chunks().flatten()
    return pa.table(dict(zip([f.name for f in parts.type], parts.flatten(), strict=True)))


def through_buckets(asking: Callable, ask: Callable, answer: Callable, kinds: str, buckets: int) -> DataFrame:
    """Replies to shards by way of buckets.

    ``ask`` gives a shard's rows (bucket, shard, more columns as in ``kinds``), ``answer`` those of a
    bucket, with the shards they are for; ``asking(function, kinds)`` applies a function to all
    shards.  Up to ``FAN`` buckets a shard sends a row to each.  Beyond, rows would grow with the
    square of the input: then a shard sends one row to each group of buckets, ``FAN`` shards' rows
    meet there and go on as one to each bucket, and replies return the same way; a consumer unpacks
    them by ``flattened``."""
    if buckets <= FAN:
        return asking(ask, kinds).groupBy("bucket").applyInArrow(answer, kinds)
    per = -(-buckets // FAN)
    struct = "array<struct<" + ", ".join(f"{n}:{k}" for n, k in (x.split() for x in kinds.split(", "))) + ">>"
    number = lambda t, c: t[c].to_numpy().astype(np.int64)

    def grouped(flat: pa.Table) -> pa.Table:
        return _nested(flat, number(flat, "bucket") // per, "top", shard=number(flat, "shard"))

    def ask_one(rows: pa.Table) -> pa.Table:
        return grouped(ask(rows))

    def ask_both(rows: pa.Table, told: pa.Table) -> pa.Table:
        return grouped(ask(rows, told))

    ask_groups = ask_one if len(signature(ask).parameters) == 1 else ask_both

    def answer_teams(table: pa.Table) -> pa.Table:
        flat = answer(flattened(table))
        bucket = number(flat, "bucket")
        return _nested(flat, number(flat, "shard") // FAN, "team", top=bucket // per)

    def regrouped(rows: DataFrame, by: str) -> DataFrame:
        # grouping by more than what rows are dealt by needs no further exchange
        each = rows.repartition("top", "team").select("top", "team", F.explode("parts").alias("p"))
        return each.groupBy("top", "team", F.col(f"p.{by}").alias(by)).agg(F.collect_list("p").alias("parts"))

    asked = asking(ask_groups, f"top int, shard int, parts {struct}").withColumn("team", F.floor(F.col("shard") / FAN).cast("int"))
    replies = regrouped(asked, "bucket").groupBy("bucket").applyInArrow(answer_teams, f"team int, top int, parts {struct}")
    return regrouped(replies, "shard").select("shard", "parts")
