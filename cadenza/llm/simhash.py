"""SimHash near-dedup with deletion-variant signatures.

A fingerprint of ``bits`` bits is cut into ``segments``.  Two fingerprints that differ in at most
``2 * segments - 1`` bits have a segment where they differ in at most one, so they share a variant
of that segment with one bit deleted.  Each distinct fingerprint is indexed once for every bit
deleted from its segment (``bits`` rows whatever the cut), rows are brought together by an
equality on the variant, and the full fingerprints are compared.

Groups of equal variants are compared inside the task in blocks; a group leaves a spanning forest
of its links, never its pairs.  A group above ``BLOCK`` members is first cut by the bytes of the
rest of the fingerprint: two fingerprints within ``distance`` bits agree in one of
``distance + 1`` parts, so equal parts are compared instead of the whole group; nothing is lost.

``near_duplicates`` links by the similarity of shingle sets, which a fingerprint's distance bounds
too loosely, and finds its candidates by bands of least hashes with a stated recall; with
``by_fingerprint`` (as in the pipeline) all links of ``near_components`` count as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, holds, kept, shared_bitmap
from .components import components

SEED = 42
#: Members up to which a group is compared as a whole.
BLOCK = 4096
#: Links between distinct fingerprints of the documents query.
BITS, SEGMENTS, DISTANCE = 64, 2, 3


def shingle_hashes(text: bytes, size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each ``size``-word shingle, repeats included, A-Z lower-cased, one space between
    words.  Fewer words: the whole sequence; no word: nothing."""
    return word_hashes(text.translate(LOWER).split(), size, seed)


def word_hashes(words: list[bytes], size: int, seed: int = SEED) -> np.ndarray:
    """The same for a list of words."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    digest = xxhash.xxh64_digest
    if n <= size:
        return np.frombuffer(digest(line, seed), ">u8").astype(np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: n - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.frombuffer(b"".join([digest(line[a:b], seed) for a, b in spans]), ">u8").astype(np.uint64)


def _ones(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each run of hashes, how many have each of the 64 bits set (highest first)."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int32)


def fingerprints(texts: list[bytes | None], size: int = 3) -> np.ndarray:
    """64-bit SimHash of each text: a bit is 1 if it is set in over half of the shingle hashes."""
    out = np.zeros(len(texts), np.uint64)
    at = 0
    while at < len(texts):
        parts, rows, total = [], [], 0
        while at < len(texts) and total < 1 << 18:
            h = shingle_hashes(texts[at] or b"", size)
            if len(h):
                parts.append(h)
                rows.append(at)
                total += len(h)
            at += 1
        if parts:
            lengths = np.array([len(h) for h in parts])
            ones = _ones(np.concatenate(parts), np.concatenate(([0], np.cumsum(lengths)[:-1])))
            set_ = (ones * 2 > lengths[:, None]).astype(np.uint8)
            out[rows] = np.packbits(set_, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def with_fingerprint(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a long) of each row; null texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints(batch.column(1).to_pylist(), size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    part = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    return part.mapInArrow(run, "doc_id long, fp long")


def cuts_of(bits: int, segments: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment, lowest bits first."""
    edges = [bits * k // segments for k in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def variants(fps: DataFrame, names: list[str], segments: int) -> DataFrame:
    """A row for each fingerprint and deleted bit: key, and the fingerprint's words.

    ``names`` are long columns that hold 64 bits of the fingerprint each, lowest first.  The key
    mixes the segment's number, the deleted bit and the bits left, one to one for 64-bit
    fingerprints; a clash of mixed keys only costs a comparison."""
    cuts = cuts_of(64 * len(names), segments)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                words = [part.column(i).to_numpy().view(np.uint64) for i in range(len(names))]
                keys = []
                for s, (shift, width) in enumerate(cuts):
                    w, low = divmod(shift, 64)
                    value = words[w] >> np.uint64(low)
                    if low + width > 64:
                        value = value | words[w + 1] << np.uint64(64 - low)
                    value = value & np.uint64((1 << width) - 1)
                    for b in range(width):
                        rest = (value >> np.uint64(b + 1) << np.uint64(b)) | (value & np.uint64((1 << b) - 1))
                        keys.append(rest | np.uint64((s * 64 + b) << 48) if width <= 49 else rest * np.uint64(0x9E3779B97F4A7C15) + np.uint64(s * 64 + b))
                many = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), *(pa.array(np.tile(w.view(np.int64), many)) for w in words)], ["key", *names]
                )

    return fps.select(*names).mapInArrow(run, "key long, " + ", ".join(f"{n} long" for n in names))


def _forest(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Spanning forest (pairs of row numbers) of the links within one group of (n, words) rows."""
    n = len(fp)
    links: list[tuple[int, int]] = []

    def compare(rows: np.ndarray) -> None:
        """Prim's walk: always the nearest fingerprint next, so close pairs become links first."""
        part = fp[rows]
        near = np.full(len(rows), 1 << 14, np.int16)
        source = np.zeros(len(rows), np.int64)
        out = np.ones(len(rows), bool)
        at = 0
        for _ in range(len(rows)):
            out[at] = False
            near[at] = 1 << 14
            apart = np.bitwise_count(part ^ part[at]).sum(axis=1, dtype=np.int16)
            closer = out & (apart < near)
            near[closer], source[closer] = apart[closer], at
            at = int(near.argmin())
            if near[at] <= distance:
                links.append((int(rows[source[at]]), int(rows[at])))
            elif near[at] == 1 << 14:
                break

    if n <= BLOCK:
        compare(np.arange(n))
        return links
    flat = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(n, -1), axis=1)
    for part in np.array_split(np.arange(flat.shape[1]), distance + 1):
        packed = np.packbits(flat[:, part], axis=1)
        code = packed.astype(np.uint64) @ (np.uint64(1) << (np.uint64(8) * np.arange(packed.shape[1], dtype=np.uint64))) if packed.shape[1] <= 8 else np.unique(packed, axis=0, return_inverse=True)[1].ravel()
        order = np.argsort(code, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
            if len(rows) > 1:
                compare(rows)
    return links


def links(fps: DataFrame, names: list[str], segments: int, distance: int) -> DataFrame:
    """Links between distinct fingerprints that differ in at most ``distance`` bits, as
    (a_0.., b_0..): a spanning forest of each group of equal variants, so all links' components."""
    k = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(f"{side}{i}", pa.int64()) for side in "ab" for i in range(k)])
        held: list[np.ndarray] = []

        def solve(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            cut = np.flatnonzero(np.diff(rows[:, 0])) + 1
            edge = np.concatenate(([0], cut, [len(rows)]))
            found: list[np.ndarray] = []
            sizes = np.diff(edge)
            two = edge[:-1][sizes == 2]
            if len(two):  # most groups are pairs
                a, b = rows[two, 1:], rows[two + 1, 1:]
                near = np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=1) <= distance
                found.append(np.hstack([a[near], b[near]]))
            for g in np.flatnonzero(sizes > 2):
                members = rows[edge[g] : edge[g + 1], 1:]
                pairs = np.array(_forest(members.view(np.uint64), distance), np.int64).reshape(-1, 2)
                found.append(np.hstack([members[pairs[:, 0]], members[pairs[:, 1]]]))
            if found and len(both := np.unique(np.vstack(found), axis=0)):
                yield pa.RecordBatch.from_arrays([pa.array(both[:, i]) for i in range(2 * k)], schema=schema)

        for batch in batches:
            rows = np.column_stack([batch.column(i).to_numpy() for i in range(k + 1)])
            if not len(rows):
                continue
            last = rows[-1, 0]
            tail = rows[:, 0] == last
            if held and held[0][0, 0] == last:  # rows come sorted: the whole batch is of this group
                held.append(rows)
                continue
            done = np.vstack([*held, rows[~tail]]) if held else rows[~tail]
            held = [rows[tail]]
            if len(done):
                yield from solve(done)
        if held:
            yield from solve(np.vstack(held))

    rows = variants(fps, names, segments)
    n = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = rows.repartition(int(n), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, ", ".join(f"{side}{i} long" for side in "ab" for i in range(k)))


#: The near-duplicate filter: shingles and similarity that decide.
VERIFY_WORDS, VERIFY_SIMILARITY = 5, 0.8
#: Candidates: texts whose least shingle hashes agree in all ``BAND_ROWS`` of one of ``BANDS``
#: bands.  A pair of similarity s is missed with (1 - s ** BAND_ROWS) ** BANDS, 1.8e-5 at 0.8 ...
BANDS, BAND_ROWS = 36, 6
#: ... or if its sketches, a bit of each of 192 least hashes, differ in more bits (they differ in
#: (1 - s) / 2 of them on average; the chance at 0.8 is under 1e-6).
SKETCH_WORDS, SKETCH_DISTANCE = 3, 42
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Candidate groups up to this size give all their pairs; of larger ones each member is paired with
#: the first, and what that leaves apart is compared in blocks of some so many texts, or shingles,
#: or by rare shingles.
SMALL_GROUP, BLOCK_TEXTS, BLOCK_SHINGLES = 6, 512, 1 << 20
#: Texts of a group that tell usual shingles from rare ones.
SAMPLE_TEXTS = 256
LAST_ID = (1 << 63) - 1


def least_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """The least of each set's hashes under each of the ``_FACTORS``: (factors, sets); 0 if empty."""
    out = np.zeros((len(_FACTORS), len(sets)), np.uint64)
    rows = [i for i, x in enumerate(sets) if len(x)]
    while rows:
        part, total = [], 0
        while len(part) < len(rows) and total < 1 << 15:
            total += len(sets[rows[len(part)]])
            part.append(rows[len(part)])
        rows = rows[len(part) :]
        flat = np.concatenate([sets[i] for i in part])
        flat = flat ^ flat >> np.uint64(29)
        starts = np.cumsum([0, *(len(sets[i]) for i in part[:-1])])
        for k, factor in enumerate(_FACTORS):
            out[k, part] = np.minimum.reduceat(flat * factor, starts)
    return out


def bands(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of each band (sets, BANDS) and sketch (sets, SKETCH_WORDS) of least hashes."""
    n = least.shape[1]
    keys = np.repeat(np.arange(BANDS, dtype=np.uint64)[:, None], n, axis=1)
    for value in least.reshape(BANDS, BAND_ROWS, n).swapaxes(0, 1):
        keys = (keys ^ value) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(31)
    bit = (least[: 64 * SKETCH_WORDS] >> np.uint64(20) & np.uint64(1)).astype(np.uint8)
    sketch = np.packbits(np.ascontiguousarray(bit.T), axis=1).view(np.uint64)
    return np.ascontiguousarray(keys.T), sketch


_MARKS = [f"s{k}" for k in range(SKETCH_WORDS)]


def _near(a: Column, b: Column) -> Column:
    """Whether two sketches (structs of ``_MARKS``) are near enough."""
    return sum((F.bit_count(a[m].bitwiseXOR(b[m])) for m in _MARKS[1:]), F.bit_count(a[_MARKS[0]].bitwiseXOR(b[_MARKS[0]]))) <= SKETCH_DISTANCE


def candidates(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From rows (key, node, s0..): pairs (u, v) to verify, and stars (u, v), which join all members
    of each larger group to its first, near or not.

    A key's first member and size come from partial sums, so that a key of very many rows costs a
    row a task; no group is ever held."""
    own = F.struct("node", *_MARKS)
    each = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(own).alias("first")).where("n > 1")
    found = kept(keyed.join(each, "key").select("key", own.alias("own"), "n", "first"), "near-found")
    large = found.where((F.col("n") > SMALL_GROUP) & (F.col("own.node") != F.col("first.node")))
    ends = [F.col("own.node").alias("u"), F.col("first.node").alias("v")]
    small = found.where(F.col("n") <= SMALL_GROUP).groupBy("key").agg(F.sort_array(F.collect_list("own")).alias("g"))
    both = F.expr("explode(flatten(transform(g, (a, i) -> transform(slice(g, i + 2, size(g)), b -> struct(a AS a, b AS b)))))")
    small = small.select(both.alias("p")).where(_near(F.col("p.a"), F.col("p.b"))).select(F.col("p.a.node").alias("u"), F.col("p.b.node").alias("v"))
    stars = large.where(_near(F.col("own"), F.col("first"))).select(*ends)
    return stars.unionByName(small).distinct(), large.select(*ends).distinct()


def divided(rows: DataFrame, *more: Column) -> tuple[DataFrame, DataFrame]:
    """Groups (home) of rows (home, node, root, n_shingles) with several components, as rows with their
    group's columns, and as one row a group: its largest component ``major``, which needs no
    comparison within, texts ``n`` and ``few_n`` beside the largest, blocks ``b`` and ``few``; ``more`` are
    further sums of a group."""
    parts = rows.groupBy("home", "root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"), *more)
    names = parts.columns[4:]
    top = parts.groupBy("home").agg(
        F.max(F.struct("n", "root", "w")).alias("top"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("*").alias("k"), *(F.first(c).alias(c) for c in names)
    )
    few_n, few_w = F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w")
    blocks = lambda n, w: F.ceil(F.greatest(n / BLOCK_TEXTS, w / BLOCK_SHINGLES)).cast("int")
    few, rest = F.greatest(F.lit(1), blocks(few_n, few_w)), F.greatest(F.lit(1), blocks(F.col("top.n"), F.col("top.w")))
    groups = top.where("k > 1").select("home", F.col("top.root").alias("major"), "n", few_n.alias("few_n"), few.alias("few"), (few + rest).alias("b"), *names)
    return rows.join(groups, "home"), groups


def cells(rows: DataFrame) -> DataFrame:
    """Cells (home, cell) of ``divided`` rows: the texts beside the largest component are cut in
    blocks, each compared with every block (``low`` tells the two apart), so that every pair of different roots
    meets in a cell."""
    rows = rows.withColumn("minor", F.col("root") != F.col("major"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("minor"), F.col("few")).otherwise(F.col("b") - F.col("few"))).cast("int")
    rows = rows.withColumn("own", own + F.when(F.col("minor"), 0).otherwise(F.col("few")))
    # minor blocks 0 .. few - 1 meet all blocks, the others meet the minor ones
    others = F.sequence(F.lit(0), F.when(F.col("minor"), F.col("b")).otherwise(F.col("few")) - 1)
    met = rows.select("home", "node", "root", "own", F.explode(others).alias("other"))
    cell = F.concat_ws("-", F.least("own", "other"), F.greatest("own", "other"))
    return met.select("home", cell.alias("cell"), "node", "root", (F.col("own") <= F.col("other")).alias("low"), (F.col("own") == F.col("other")).alias("same"))


def _rarest(texts: pa.Table, usual: pa.Table) -> pa.Table:
    """Of each text of a block the shingles that come first in its group's order, rare ones before
    ``usual`` ones (each with a count): as many as a text of ``VERIFY_SIMILARITY`` cannot avoid."""
    lists = texts["set"].combine_chunks()
    size = lists.value_lengths().to_numpy().astype(np.int64)
    flat = lists.flatten().to_numpy()
    count = np.zeros(len(flat), np.int64)
    if usual.num_rows:
        names, sums = (usual[c].combine_chunks().flatten().to_numpy() for c in "uc")
        order = np.argsort(names)
        names, sums = names[order], sums[order]
        at = np.minimum(np.searchsorted(names, flat), len(names) - 1)
        count = np.where(names[at] == flat, sums[at], 0)
    of = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((flat, count, of))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    chosen = order[place < (size - np.ceil(VERIFY_SIMILARITY * size - 1e-9).astype(np.int64) + 1)[of]]
    rows = texts.select(["home", "node", "root", "n_shingles"]).take(pa.array(of[chosen]))
    return rows.append_column("shingle", pa.array(flat[chosen], pa.int64()))


def rarest(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(home, node, root, n_shingles, shingle): the rarest shingles of each text of large groups.

    Two texts of similarity s share s of the longer one's shingles, so whatever the order of shingles (the
    same for a group), the first n - ceil(s n) + 1 of both have one in common.  The order sets those last that
    several of some ``SAMPLE_TEXTS`` texts of the group hold: the sample decides how many candidates there
    are, never whether a pair is one.  Texts are ordered in blocks; each block has its group's usual
    shingles beside it, which are at most a third of a block."""
    share = F.greatest(F.lit(1), F.least(F.col("n"), F.greatest(F.ceil(F.col("n") / SAMPLE_TEXTS), F.col("b"))))
    sampled = rows.where(F.pmod(F.xxhash64(F.lit(3), "node"), share) == 0).select("home", "node")
    seen = sampled.join(sets, "node").select("home", F.explode("set").alias("shingle")).groupBy("home", "shingle").agg(F.count("*").alias("c")).where("c > 2")
    lists = seen.groupBy("home").agg(F.collect_list(F.struct("shingle", "c")).alias("l")).select("home", F.col("l.shingle").alias("u"), F.col("l.c").alias("c"))
    blocks = rows.select("home", "b").distinct().select("home", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("block"))
    usual = blocks.join(lists, "home").select(F.col("home").alias("of"), "block", "u", "c")
    dealt = rows.join(sets, "node").select("home", F.pmod(F.xxhash64("node"), F.col("b")).cast("int").alias("block"), "node", "root", "n_shingles", "set")
    kinds = "home long, node long, root long, n_shingles int, shingle long"
    return dealt.groupBy("home", "block").cogroup(usual.groupBy("of", "block")).applyInArrow(_rarest, kinds)


def left_apart(stars: DataFrame, roots: DataFrame, sizes: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """What is still to be compared of members (node, root) of larger groups that the first links left
    in several components: cells, and pairs (u, v).

    Members that stars join have one ``home``.  If the texts beside its largest component fill one block,
    they meet all others there.  Else only texts that share one of their rarest shingles meet, in groups
    of their own: few of them pairs, larger ones cells.  Where that would compare more texts than the home's
    own blocks (near-copies without anything rare) the blocks stay."""
    home = components(stars).select("node", F.col("root").alias("home"))
    rows = home.join(roots, "node", "left").join(sizes, "node").select("home", "node", F.coalesce("root", "node").alias("root"), "n_shingles")
    rows, groups = divided(kept(rows, "near-homes"))
    groups = groups.where("few > 1")
    if not groups.limit(1).count():
        return kept(cells(rows), "near-cells"), None
    large = kept(rows.where("few > 1"), "near-large")
    first = kept(rarest(large, sets_of(large)), "near-rarest")
    alone = F.xxhash64("home", "shingle")
    shared = first.groupBy("home", "shingle").agg(F.min("root").alias("a"), F.max("root").alias("z")).where("a < z").select("home", "shingle")
    first = first.join(shared, ["home", "shingle"]).select(alone.alias("home"), F.col("home").alias("within"), "node", "root", "n_shingles")
    first, parts = divided(kept(first, "near-shared"), F.min("within").alias("of"))
    work = parts.groupBy(F.col("of").alias("home")).agg(F.sum(F.col("few_n") * F.col("n")).alias("work"))
    plan = groups.join(work, "home", "left").select("home", (F.coalesce("work", F.lit(0)) <= F.col("few_n") * F.col("n")).alias("split"))
    plan = kept(plan, "near-plan")
    split, whole = plan.where("split").select(F.col("home").alias("within")), plan.where("NOT split").select("home")
    first = kept(first.join(split, "within", "left_semi"), "near-split")
    few = first.where(F.col("n") <= SMALL_GROUP).groupBy("home").agg(F.sort_array(F.collect_set(F.struct("node", "root"))).alias("g"))
    both = F.expr("explode(flatten(transform(g, (a, i) -> transform(slice(g, i + 2, size(g)), b -> struct(a AS a, b AS b)))))")
    pairs = few.select(both.alias("p")).where("p.a.root <> p.b.root").select(F.col("p.a.node").alias("u"), F.col("p.b.node").alias("v")).distinct()
    same = ["home", "node", "root", "major", "few", "b"]
    todo = rows.where("few = 1").select(*same).unionByName(large.join(whole, "home", "left_semi").select(*same))
    todo = todo.unionByName(first.where(F.col("n") > SMALL_GROUP).select(*same))
    return kept(cells(todo), "near-cells"), kept(pairs, "near-more")


def _compared(t: pa.Table) -> pa.Table:
    """Links of one cell: a forest of the similar pairs of different roots, found by exact shingle
    sets; a text is compared with all texts of the other side at once."""
    node, root = t["node"].to_numpy(), t["root"].to_numpy()
    low = np.array(t["low"].to_pylist(), bool)
    lists = t["set"].combine_chunks()
    size = lists.value_lengths().to_numpy().astype(np.int64)
    codes = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1].ravel()
    edge = np.concatenate(([0], np.cumsum(size)))
    same = bool(t["same"][0].as_py())
    left = np.flatnonzero(low)
    right = left if same else np.flatnonzero(~low)
    flat = np.concatenate([codes[edge[i] : edge[i + 1]] for i in right] or [codes[:0]])
    start = np.concatenate(([0], np.cumsum(size[right])[:-1])).astype(np.int64)
    full = size[right] > 0
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    mark = np.zeros(len(codes) + 1, np.int32)
    u, v = [], []
    for i in left.tolist():
        if not len(right) or not size[i]:
            continue
        own = codes[edge[i] : edge[i + 1]]
        mark[own] = 1
        shared = np.zeros(len(right), np.int64)
        shared[full] = np.add.reduceat(mark[flat], start[full]) if full.any() else 0
        mark[own] = 0
        alike = (shared >= VERIFY_SIMILARITY * (size[i] + size[right] - shared)) & (root[right] != root[i])
        for k in right[alike].tolist():
            a, b = find(int(root[i])), find(int(root[k]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                u.append(node[i])
                v.append(node[k])
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Links (u, v) of nodes whose texts' fingerprints differ in at most ``DISTANCE`` bits, from rows
    (node, fp): each node to the least one of its fingerprint, and these to one another."""
    least = kept(prints.groupBy("fp").agg(F.min("node").alias("least")), "near-fingerprints")
    same = prints.join(least, "fp").where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    near = links(least, ["fp"], SEGMENTS, DISTANCE).distinct()
    end = lambda side, name: least.select(F.col("fp").alias(side), F.col("least").alias(name))
    return same.unionByName(near.join(end("a0", "u"), "a0").join(end("b0", "v"), "b0").select("u", "v")).distinct()


def near_duplicates(docs: DataFrame, by_fingerprint: bool = False) -> DataFrame:
    """Rows of ``docs``, all columns, without near-duplicates: of each group linked by a word-shingle
    similarity of ``VERIFY_SIMILARITY`` the smallest doc_id stays.  With ``by_fingerprint`` texts whose
    fingerprints are within ``DISTANCE`` bits (see ``near_components``) are linked too.

    Texts with the same set of shingles are one node and need no verification (null texts and those
    without a word have the empty set).  Candidates share a band of least hashes, see ``BANDS``, and
    are verified on whole texts: every pair of a band's group is either verified or lies in one
    component by links that were; pairs of a large group are compared inside tasks, never listed.  A doc_id may stand for several texts, each judged as its own; of
    rows with equal doc_id and text one stays; a null doc_id comes after all others."""
    content = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    keys = [number.alias("id"), F.xxhash64(content).alias("t"), content.alias("text")]

    def sets_of(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [np.unique(shingle_hashes(t, VERIFY_WORDS)) for t in batch.column(2).to_pylist()]

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = sets_of(batch)
            fp = fingerprints(batch.column(2).to_pylist()) if by_fingerprint else np.zeros(len(sets), np.uint64)
            node = np.fromiter((xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets), np.uint64, len(sets))
            key, sketch = bands(least_hashes(sets))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(key.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
            marks = [pa.array(np.ascontiguousarray(x)) for x in sketch.view(np.int64).T]
            counts = pa.array([len(x) for x in sets], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(node.view(np.int64)), pa.array(fp.view(np.int64)), *marks, lists, counts], ["id", "t", "node", "fp", *_MARKS, "bands", "n_shingles"]
            )

    def shingles(wanted: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(pa.array(holds(wanted.value, batch.column(3).to_numpy())))
                sets = [x.view(np.int64) for x in sets_of(batch)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int64()))], ["id", "t", "set"])

        return run

    kinds = "id long, t long, node long, fp long, " + ", ".join(f"{m} long" for m in _MARKS) + ", bands array<long>, n_shingles int"
    rows = docs.select(*keys).mapInArrow(prints, kinds)
    # texts of one set of shingles may differ in fingerprint, as that counts repeats
    marked = [*_MARKS, "bands", "n_shingles"]
    printed = rows.groupBy("node", "fp").agg(F.min(F.struct("id", "t")).alias("of"), *(F.first(c).alias(c) for c in marked))
    printed = kept(printed, "near-nodes")
    nodes = printed.groupBy("node").agg(F.min("of").alias("of"), *(F.first(c).alias(c) for c in marked)) if by_fingerprint else printed
    keyed = nodes.select("node", *_MARKS, F.explode("bands").alias("key"))

    def sets_of_nodes(wanted: DataFrame) -> DataFrame:
        # a bitmap of the wanted texts spares most others the way; what passes by chance is left by the join
        chosen = kept(wanted.select("node").distinct().join(nodes, "node").select("of.*", "node"), "near-chosen")
        found = docs.select(*keys).withColumn("h", F.xxhash64("id", "t"))
        passed = shared_bitmap(chosen.select(F.xxhash64("id", "t").alias("h")))
        sets = found.mapInArrow(shingles(passed), "id long, t long, set array<long>")
        return kept(sets.join(chosen, ["id", "t"]).dropDuplicates(["id", "t"]).select("node", "set"), "near-sets")

    def verified(pairs: DataFrame) -> DataFrame:
        sets = sets_of_nodes(pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))))
        both = pairs.join(sets.select(F.col("node").alias("u"), F.col("set").alias("x")), "u").join(sets.select(F.col("node").alias("v"), F.col("set").alias("y")), "v")
        shared = F.size(F.array_intersect("x", "y"))
        alike = shared >= VERIFY_SIMILARITY * (F.size("x") + F.size("y") - shared)
        return kept(both.where(alike).select("u", "v"), "near-links")

    pairs, stars = candidates(keyed)
    pairs, stars = kept(pairs, "near-pairs"), kept(stars, "near-stars")
    links_ = verified(pairs)
    if by_fingerprint:
        links_ = links_.unionByName(kept(fingerprint_links(printed.select("node", "fp")), "near-links"))
    roots = components(links_)
    if stars.limit(1).count():
        todo, pairs = left_apart(stars, roots, nodes.select("node", "n_shingles"), sets_of_nodes)
        links_ = links_.unionByName(todo.join(sets_of_nodes(todo), "node").groupBy("home", "cell").applyInArrow(_compared, "u long, v long"))
        if pairs is not None:
            links_ = links_.unionByName(verified(pairs))
        roots = components(kept(links_, "near-links"))
    rooted = nodes.join(roots, "node", "left").select("of", F.coalesce("root", "node").alias("root"))
    stay = kept(rooted.groupBy("root").agg(F.min("of").alias("of")).select(F.col("of.id").alias("__id"), F.col("of.t").alias("__t")), "near-stay")
    packed = docs.select(F.struct("*").alias("__row"), number.alias("__id"), F.xxhash64(content).alias("__t"))
    out = packed.join(stay, ["__id", "__t"], "left_semi")
    if docs.select(*keys[:2]).join(stay, (F.col("id") == F.col("__id")) & (F.col("t") == F.col("__t"))).count() != stay.count():  # rows repeat
        out = out.groupBy("__id", "__t").agg(F.first("__row").alias("__row"))
    return out.select("__row.*")


def near_components(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, fp (long) and component_id.

    Equal fingerprints are one node, so exact copies and a hot fingerprint cost one row; nodes
    within ``DISTANCE`` bits are linked and component_id is the smallest doc_id that links reach.
    Null and empty texts share fingerprint 0 and link like any other; a null doc_id is never the
    smallest unless there is no other; repeated rows stay; an empty table gives no rows."""
    rows = kept(with_fingerprint(docs), "simhash")
    nodes = kept(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    edges = links(nodes, ["fp"], SEGMENTS, DISTANCE).select(F.col("a0").alias("u"), F.col("b0").alias("v")).distinct()
    roots = components(edges)
    member = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = member.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")
