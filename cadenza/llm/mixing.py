"""Mixing sources to target weights with hash-threshold histograms.

Each document has a fixed 60-bit hash of its doc_id.  Words are summed by source and hash bucket;
the running sum shows in which bucket a source's budget runs out, and only that bucket is cut
finer, five times by 12 bits, until a single hash value is left.  A document is then taken when
its hash lies below its source's threshold: a filter, no sort.  Thresholds are nested: a larger
budget takes the same documents and more.  A source whose target exceeds its size is taken whole
as often as it fits, and the threshold deals out the rest.

Only tables with a row per source and bucket are ordered; they are 4,096 rows a source at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_broadcast, kept

HASH_BITS, LEVEL_BITS = 60, 12
#: A target stops at so many times its source's size.
MOST_REPEATS = 3
#: Sources up to which the per-source table is broadcast (some 100 bytes a row).
BROADCAST_SOURCES = 20_000


def doc_hash(doc_id: Column) -> Column:
    """60 bits of the MD5 of the id's decimal text; a null id hashes to 0."""
    return F.coalesce(F.conv(F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long"), F.lit(0))


def word_counts(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns and ``size``, the number of words in ``text`` (null: 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(t.split()) if t else 0 for t in batch.column(len(columns)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], [*columns, "size"])

    part = docs.select(*columns, F.col("text").cast("string").cast("binary").alias("text"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema.fields[:-1])
    return part.mapInArrow(run, f"{types}, size long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source: source, source_size, target.

    ``sizes`` has source and size.  Sources by code point, null last, weigh 1, 2, 3, repeating.
    They share the total; a target stops at ``MOST_REPEATS`` times its source's size and the excess
    goes to the others by weight.  That fixed point is ``min(cap, weight * level)`` for one level,
    found by ordering the sources by ``cap / weight``."""
    every = Window.orderBy(F.col("source").isNull(), "source")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.select(
        "source",
        "source_size",
        ((F.row_number().over(every) - 1) % 3 + 1).alias("weight"),
        (F.col("source_size") * MOST_REPEATS).alias("cap"),
    )
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = ranked.withColumn(
        "level",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(after),
    )
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    return level.withColumn("level", F.max(fits).over(whole)).select(
        "source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target")
    )


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with repeats (times a source is taken whole), edge (hash up to which its documents
    are taken once more) and edge_in (whether documents with that very hash are).

    ``sizes`` has source, size and hash.  What is taken once more is the longest run of hashes
    whose words fit what is left of the target, and the next hash if that comes closer."""
    s, t = F.col("source_size"), F.col("target")
    repeats = F.when(s > 0, F.floor(t / s)).otherwise(F.lit(0)).cast("long")
    plan = kept(targets.withColumn("repeats", repeats).withColumn("rest", t - F.col("repeats") * s), "mix-plan")
    small = bound_broadcast(plan.select(F.col("source").alias("of"), "rest"), BROADCAST_SOURCES)
    rows = sizes.join(small, F.col("source").eqNullSafe(F.col("of"))).select("source", "rest", "size", "hash")
    state = None
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        bucket = F.shiftright("hash", shift).alias("bucket")
        if state is None:
            part = rows.select("source", "rest", "size", bucket, F.lit(0).cast("long").alias("base"))
        else:
            inside = F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("hash", shift + LEVEL_BITS) == F.col("edge"))
            part = rows.join(state.select(F.col("source").alias("of"), "edge", "base"), inside).select("source", "rest", "size", bucket, "base")
        running = Window.partitionBy("source").orderBy("bucket")
        state = (
            part.groupBy("source", "rest", "base", "bucket")
            .agg(F.sum("size").alias("n"))
            .withColumn("upto", F.col("base") + F.sum("n").over(running))
            .where(F.col("upto") > F.col("rest"))
            .groupBy("source")
            .agg(F.min(F.struct("bucket", "n", "upto", "rest")).alias("first"))
            .select("source", F.col("first.bucket").alias("edge"), (F.col("first.upto") - F.col("first.n")).alias("base"), "first.n", "first.rest")
        )
    nearer = (F.col("base") + F.col("n") - F.col("rest")) < (F.col("rest") - F.col("base"))
    edges = state.select(F.col("source").alias("of"), "edge", nearer.alias("edge_in"))
    return plan.join(edges, F.col("source").eqNullSafe(F.col("of")), "left").select(
        "source", "source_size", "target", "repeats", "edge", F.coalesce("edge_in", F.lit(False)).alias("edge_in")
    )


def copies(hash_: Column) -> Column:
    """How often a document is taken, from the columns of ``thresholds``."""
    more = (hash_ < F.col("edge")) | ((hash_ == F.col("edge")) & F.col("edge_in"))
    return F.col("repeats") + F.coalesce(more, F.lit(False)).cast("long")


def mix_sizes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, hash) of all documents, written once, and their ``thresholds``."""
    sizes = word_counts(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text"), "doc_id", "source")
    sizes = kept(sizes.withColumn("hash", doc_hash(F.col("doc_id"))), "mix-sizes")
    return sizes, kept(thresholds(sizes, source_targets(sizes)), "mix-edges")


def mixed(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken.

    Null texts have size 0, a null source is a source of its own, rows that repeat a doc_id are
    taken or left together, an empty table gives no rows."""
    sizes, edges = mix_sizes(docs)
    small = bound_broadcast(edges.withColumnRenamed("source", "of"), BROADCAST_SOURCES)
    return sizes.join(small, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "source", "size", "source_size", "target", (copies(F.col("hash")) * F.col("size")).alias("taken")
    )


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of ``docs`` in all their columns, each as often as it is taken.

    The texts stay where they are read: only the per-source table is joined to them."""
    _, edges = mix_sizes(docs)
    packed = docs.select(F.struct("*").alias("__row"))
    small = bound_broadcast(edges.withColumnRenamed("source", "of"), BROADCAST_SOURCES)
    times = copies(doc_hash(F.col("__row.doc_id"))).cast("int")
    return (
        packed.join(small, F.col("__row.source").cast("string").eqNullSafe(F.col("of")))
        .select("__row", F.explode(F.array_repeat(F.lit(1), times)).alias("__n"))
        .select("__row.*")
    )
