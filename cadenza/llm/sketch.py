"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch holds the ``K`` smallest distinct 64-bit hashes of a text's five-word shingles.  Sketches
of parts merge into the sketch of the whole, and two sketches estimate how many shingles their
texts share (resemblance, containment) and how many distinct ones there are.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, SHARD_BYTES, bound_broadcast, range_shards
from .simhash import word_hashes

K, SHINGLE, SEED = 128, 5, 7


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct hashes, rising."""
    return np.unique(hashes)[:k]


def sketch(text: bytes, k: int = K) -> np.ndarray:
    """Sketch of a UTF-8 text; a text of fewer words than a shingle has one shingle, none: none."""
    return bottom(word_hashes(text.translate(LOWER).split(), SHINGLE, SEED), k)


def merge(sketches: Iterable[np.ndarray], k: int = K) -> np.ndarray:
    """Sketch of all shingles of all parts."""
    parts = list(sketches)
    return np.unique(np.concatenate(parts))[:k] if parts else np.empty(0, np.uint64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity of the shingle sets; two empty ones are alike."""
    both = np.union1d(a, b)[:k]
    if not len(both):
        return 1.0
    return float((np.isin(both, a, assume_unique=True) & np.isin(both, b, assume_unique=True)).sum() / len(both))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / float(a[-1])


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too; an empty a is contained."""
    if not len(a):
        return 1.0
    j = resemblance(a, b, k)
    return min(1.0, j * (distinct(a, k) + distinct(b, k)) / (1 + j) / distinct(a, k))


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), ">u8").astype(np.uint64)


def sketches(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, sketch (array<long>), n_distinct (estimate) of every row's whole text (null: empty).
    Repeated rows stay; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sketch(t or b"", k) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s.view(np.int64) for s in own], pa.list_(pa.int64())), pa.array([distinct(s, k) for s in own], pa.float64())],
                ["doc_id", "sketch", "n_distinct"],
            )

    part = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    return part.mapInArrow(run, f"doc_id {part.schema['doc_id'].dataType.simpleString()}, sketch array<long>, n_distinct double")


def merged(parts: DataFrame, by: str, k: int = K, fan: int = 64) -> DataFrame:
    """(by, sketch) over all parts with a ``sketch`` column.  Parts merge in ``fan`` salted groups
    first, so a key that holds most of the parts never meets in one task.  Null sketches are empty,
    repeated parts change nothing, a null key is a key of its own; no parts give no rows."""

    def join(table: pa.Table) -> pa.Table:
        s = merge((np.array(x or [], np.int64).view(np.uint64) for x in table["sketch"].to_pylist()), k)
        return pa.table({**{c: table[c][:1] for c in table.column_names if c != "sketch"}, "sketch": pa.array([s.view(np.int64)], pa.list_(pa.int64()))})

    kind = parts.schema[by].dataType.simpleString()
    salted = parts.select(by, F.pmod(F.monotonically_increasing_id(), F.lit(fan)).cast("int").alias("salt"), "sketch")
    once = salted.groupBy(by, "salt").applyInArrow(join, f"`{by}` {kind}, salt int, sketch array<long>")
    return once.select(by, "sketch").groupBy(by).applyInArrow(join, f"`{by}` {kind}, sketch array<long>")


def _edited(table: pa.Table) -> pa.Table:
    """One range of documents, with the document that follows its last."""
    ids, texts, halo, at = (table[c].to_pylist() for c in ("id", "text", "halo", "at"))
    texts = [t or "" for t in texts]
    order = sorted(range(len(ids)), key=lambda i: (halo[i], ids[i] is None, -at[i], texts[i]))
    own = [i for i in order if not halo[i]]
    row = own + [i for i in order if halo[i]][:1]
    words = {i: texts[i].encode("utf-8", "surrogatepass").translate(LOWER).split() for i in row}
    hashes = {i: word_hashes(words[i], SHINGLE, SEED) for i in row}
    marks = {i: bottom(h) for i, h in hashes.items()}
    out: dict[str, list] = {c: [] for c in ("id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
    for at, i in enumerate(own):
        after = row[at + 1] if at + 1 < len(row) else row[0]
        cut = len(texts[i]) // 3
        stays = texts[i][: len(texts[i]) - cut]
        edited = (stays + texts[after][:cut]).encode("utf-8", "surrogatepass")
        # shingles that end before the last word that stays are those of the text itself
        same = max(0, len(stays.encode("utf-8", "surrogatepass").split()) - 1 - (SHINGLE - 1))
        rest = word_hashes(edited.translate(LOWER).split()[same:], SHINGLE, SEED)
        mark = bottom(np.concatenate([hashes[i][:same], rest]) if same else rest)
        out["id"].append(ids[i])
        out["n_chars"].append(len(texts[i]))
        out["edited_sha256"].append(hashlib.sha256(edited).hexdigest())
        out["fingerprint"].append(to_text(marks[i]))
        out["edited_fingerprint"].append(to_text(mark))
        out["near_edited"].append(resemblance(marks[i], mark))
        out["near_next"].append(resemblance(marks[i], marks[after]))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.table({c: pa.array(v, kind) for (c, v), kind in zip(out.items(), kinds, strict=True)})


def edited_neighbours(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, as the last third of each text gives way to the start of the next document by
    descending doc_id (after the last: the first).

    Ranges of doc_id are cut by size; each also gets the first row of the range below, so the
    texts move once.  Null texts are empty, null ids come last, by a hash of their texts; rows with
    equal ids follow each other by text.  A single row is its own next; an empty table gives no
    rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("text"))
    sized = rows.select("id", (F.octet_length("text") + 64).alias("size"))
    place, n = range_shards(sized, "id", "size", shard_bytes)
    without = int(sized.where("id IS NULL").agg(F.sum("size")).first()[0] or 0)
    n_without = max(1, -(-without // shard_bytes))
    # rows run by shard, then by ``at``, both falling; rows without id have the shards below 0
    hashed = F.xxhash64("text")
    share = F.floor((hashed / 2.0**64 + 0.5) * n_without)
    rows = rows.withColumn("shard", F.when(F.col("id").isNull(), -1 - F.least(share, F.lit(n_without - 1))).otherwise(place(F.col("id"))).cast("int"))
    rows = rows.withColumn("at", F.when(F.col("id").isNull(), F.bitwise_not(hashed)).otherwise(F.col("id")))
    heads = rows.groupBy("shard").agg(F.max("at").alias("at"))
    down = Window.orderBy(F.col("shard").desc())  # a row for each shard
    every = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    below = [F.coalesce(F.lead(c).over(down), F.first(c).over(every)).alias(c) for c in ("shard", "at")]
    after = heads.select(*below, F.col("shard").alias("of"))
    halo = rows.join(bound_broadcast(after, 100_000), ["shard", "at"]).select("id", "text", F.col("of").alias("shard"), "at", F.lit(True).alias("halo"))
    both = rows.select("id", "text", "shard", "at", F.lit(False).alias("halo")).unionByName(halo)
    kinds = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    done = both.groupBy("shard").applyInArrow(_edited, kinds)
    return done.withColumnRenamed("id", "doc_id")
