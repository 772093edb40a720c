"""Phrase collocations by Toivonen's sampling miner.

A phrase occurs at least as often as any longer phrase around it, so only phrases whose parts are
frequent can be.  A sample of the documents, mined level by level with a lowered threshold, proposes
words and pairs.  One pass over all documents then counts exactly the proposals and their *negative
border*: every word, every pair of proposed words, every triple of proposed pairs.  A word or pair
that turns out frequent though it was not proposed is a border failure: it is added, and a further
pass counts what its addition brings into the border, until a pass fails nowhere.  Every frequent
phrase has then been counted exactly, whatever the sample held.

Proposals reach the tasks as a bitmap of their hashes with a bounded size.  A phrase that passes it
by chance is counted too, which costs time and changes no result; a bitmap that fills up counts more.
Tasks count some megabytes of text at a time with numpy over word numbers of their own, so that a
word of a third of the corpus is one row for each of those, and phrases are compared as strings.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, give_back, kept

LEAST, TOP, UNKNOWN = 10, 2000, "und"
#: A candidate goes if a longer one around it has at least this per cent of its occurrences.
CONTAINED_PER_CENT = 50
#: One document in ``SAMPLE_OF`` proposes; a phrase needs this many occurrences there.  Both only move
#: work between the passes.
SAMPLE_OF, SAMPLE_LEAST = 10, 2
#: Bits of a bitmap: some for each proposal, within bounds (16 MB at most reach every task).
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 1 << 16, 1 << 27
#: Text that a task counts at a time.
BATCH_BYTES = 4 << 20
#: Rows that a task hands over at once: the JVM holds a batch outside its heap, twice while it reads it.
BATCH_ROWS = 16_384
#: Parts of a language that are ranked apart before its first rows meet.
PARTS = 64

_COUNTS = "lang string, n_words int, phrase string, f long"
_NAMES = ["lang", "n_words", "phrase", "f"]
_SPACES, _BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(_SPACES)], _CLASS[list(_BREAKS)] = 1, 2
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Border(NamedTuple):
    """Bitmaps of proposed words and pairs (None: nothing is proposed)."""

    words: np.ndarray | None
    pairs: np.ndarray | None


def _holds(bits: np.ndarray | None, h: np.ndarray) -> np.ndarray:
    if bits is None:
        return np.zeros(len(h), bool)
    mask = np.uint64(len(bits) * 64 - 1)
    out = np.ones(len(h), bool)
    for at in (h & mask, (h >> np.uint64(32)) & mask):
        out &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0
    return out


def _mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    h = (x * _MIX) ^ (y + (x >> np.uint64(29)))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode())


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[bytes, str]]]:
    """(text, language) of some ``BATCH_BYTES`` at a time.  Longer texts are cut after a break, so that
    no piece is parted, however long it is."""
    held, size = [], 0
    for batch in batches:
        for text, lang in zip(batch.column("t"), batch.column("lang"), strict=True):
            text, lang = text.as_buffer().to_pybytes(), lang.as_py()
            while text:
                end = len(text)
                if size + end > BATCH_BYTES and end > BATCH_BYTES:
                    for at in range(BATCH_BYTES, len(text), 1 << 12):  # the first break from here on
                        cut = np.flatnonzero(_CLASS[np.frombuffer(text[at : at + (1 << 12)], np.uint8)] == 2)
                        if len(cut):
                            end = at + int(cut[0]) + 1
                            break
                held.append((text[:end], lang))
                size += end
                text = text[end:]
                if size >= BATCH_BYTES:
                    yield held
                    held, size = [], 0
    if held:
        yield held


class _Words:
    """The words of some texts as numbers: ``at`` (one for each occurrence, by language and word),
    ``joined`` (the next occurrence follows in the same piece), and by number language, word and
    hash."""

    def __init__(self, texts: list[tuple[bytes, str]]):
        data = np.frombuffer(b"\n".join(t for t, _ in texts).translate(LOWER), np.uint8)
        kind = _CLASS[data]
        inside = kind == 0
        edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        piece = np.cumsum(kind == 2, dtype=np.int32)
        self.joined = (piece[start[1:]] == piece[start[:-1]]) if len(start) else np.zeros(0, bool)
        offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
        coded = words.dictionary_encode()
        langs, of = np.unique([lang for _, lang in texts], return_inverse=True)
        first = np.cumsum([0] + [len(t) + 1 for t, _ in texts[:-1]])
        lang = of[np.searchsorted(first, start, side="right") - 1]
        word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        numbers, self.at = np.unique(lang * (len(coded.dictionary) + 1) + word, return_inverse=True)
        self.lang = pa.array([str(x) for x in langs]).take(pa.array(numbers // (len(coded.dictionary) + 1)))
        self.word = coded.dictionary.take(pa.array(numbers % (len(coded.dictionary) + 1)))
        seeds = [_seed(str(x)) for x in langs]
        each = zip(self.word.to_pylist(), numbers // (len(coded.dictionary) + 1), strict=True)
        self.h = np.array([xxhash.xxh64_intdigest(w, seeds[k]) for w, k in each], np.uint64)
        self.tokens = np.bincount(lang, minlength=len(langs))
        self.langs = [str(x) for x in langs]


def _rows(w: _Words, numbers: list[np.ndarray], f: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counted phrases, given by the numbers of their words, made and handed over bit by bit."""
    for at in range(0, len(f), BATCH_ROWS):
        some = [pa.array(x[at : at + BATCH_ROWS]) for x in numbers]
        parts = [w.word.take(x).cast(pa.string()) for x in some]
        phrase = parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, " ")
        kinds = pa.array(np.full(len(phrase), len(parts)), pa.int32())
        yield pa.RecordBatch.from_arrays([w.lang.take(some[0]), kinds, phrase, pa.array(f[at : at + BATCH_ROWS])], _NAMES)


def _counter(before, now, longest: int, fresh: bool):
    """Counts what ``now`` puts into the border and ``before`` did not (two broadcast Borders), up to
    ``longest`` words; if ``fresh`` also all words, and the number of words as an empty phrase."""

    def portion(texts: list[tuple[bytes, str]], old: Border, new: Border) -> Iterator[pa.RecordBatch]:
        w = _Words(texts)
        n = len(w.word)
        if n == 0:
            return
        one, was = _holds(new.words, w.h), _holds(old.words, w.h)
        if fresh:
            yield from _rows(w, [np.arange(n)], np.bincount(w.at, minlength=n))
            zeros = np.zeros(len(w.langs), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(w.langs), pa.array(zeros, pa.int32()), pa.array([""] * len(w.langs)), pa.array(w.tokens.astype(np.int64))], _NAMES)
        if longest < 2:
            return
        i = np.flatnonzero(w.joined)
        a, b = w.at[i], w.at[i + 1]
        if longest > 2:
            h = _mixed(w.h[a], w.h[b])
            two, had = _holds(new.pairs, h), _holds(old.pairs, h)
            # a pair beside the one that starts at its second word
            k = np.flatnonzero((i[1:] == i[:-1] + 1) & two[1:] & two[:-1] & ~(had[1:] & had[:-1]))
            pair, at = np.unique(a[k] * n + b[k], return_inverse=True)
            key, f = np.unique(at * n + b[k + 1], return_counts=True)
            if len(f):
                ab, c = pair[key // n], key % n
                yield from _rows(w, [ab // n, ab % n, c], f)
        keep = one[a] & one[b] & ~(was[a] & was[b])
        key, f = np.unique(a[keep] * n + b[keep], return_counts=True)
        if len(f):
            yield from _rows(w, [key // n, key % n], f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, new = before.value, now.value
        for texts in _portions(batches):
            yield from portion(texts, old, new)
            give_back()  # before the next portion is read

    return run


def _counts(texts: DataFrame, before: Border, now: Border, least: int, longest: int, fresh: bool, name: str) -> DataFrame:
    """Phrases that a pass counted at least ``least`` times, and the words of each language, written
    out."""
    share = texts.sparkSession.sparkContext.broadcast
    rows = texts.mapInArrow(_counter(share(before), share(now), longest, fresh), _COUNTS)
    whole = rows.groupBy("lang", "n_words", "phrase").agg(F.sum("f").alias("f"))
    return kept(whole.where((F.col("f") >= least) | (F.col("n_words") == 0)), name)


def _unproposed(found: DataFrame, now: Border) -> DataFrame:
    """(n_words, h) of the words and pairs of ``found`` that ``now`` does not hold."""
    shared = found.sparkSession.sparkContext.broadcast(now)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds: dict[str, int] = {}
        for batch in batches:
            langs, phrases = batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()
            seeds.update({x: _seed(x) for x in set(langs) - set(seeds)})
            n = batch.column("n_words").to_numpy()
            words = [p.encode().split(b" ") for p in phrases]
            h, last = (np.array([xxhash.xxh64_intdigest(w[k], seeds[x]) for w, x in zip(words, langs, strict=True)], np.uint64) for k in (0, -1))
            h = np.where(n == 1, h, _mixed(h, last))
            new = ~np.where(n == 1, _holds(shared.value.words, h), _holds(shared.value.pairs, h))
            yield pa.RecordBatch.from_arrays([pa.array(n[new], pa.int32()), pa.array(h[new].view(np.int64))], ["n_words", "h"])

    return found.where("n_words IN (1, 2)").mapInArrow(run, "n_words int, h long")


def _bits(found: DataFrame, size: int) -> np.ndarray:
    """Bitmap of ``size`` bits with two for each h of ``found``; a row for each used word of 64 bits
    reaches the driver."""
    at = F.explode(F.array(F.col("h").bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(size - 1))))
    cells = found.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    table = cells.toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[table["cell"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return out


def _size(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << int(max(1, n * BITS_EACH) - 1).bit_length()))


def frequent(docs: DataFrame, least: int = LEAST, sample_of: int = SAMPLE_OF, sample_least: int = SAMPLE_LEAST) -> tuple[DataFrame, int]:
    """(lang, n_words, phrase, f) of every phrase of one to three words that occurs ``least`` times in
    its language, with the words of the language under an empty phrase of no words; and the number of
    passes over all documents."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = docs.select(text.alias("t"), F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.xxhash64("doc_id", text).alias("d"))
    sample, every = row.where(F.pmod("d", F.lit(sample_of)) == 0).select("t", "lang"), row.select("t", "lang")
    nothing = Border(None, None)
    words = kept(_unproposed(_counts(sample, nothing, nothing, sample_least, 1, True, "phrases-words"), nothing), "phrases-sample")
    proposed = Border(_bits(words, _size(words.count())), None)
    pairs = kept(_unproposed(_counts(sample, nothing, proposed, sample_least, 2, False, "phrases-pairs"), nothing), "phrases-sample")
    proposed = Border(proposed.words, _bits(pairs, _size(pairs.count())))
    before, found, passes = nothing, [], 0
    while True:
        counted = _counts(every, before, proposed, least, 3, passes == 0, "phrases")
        found.append(counted)
        passes += 1
        failed = kept(_unproposed(counted, proposed), "phrases-failed")
        failures = {r["n_words"] for r in failed.select("n_words").distinct().collect()}
        if not failures:
            break
        more = [bits | _bits(failed.where(F.col("n_words") == k), len(bits) * 64) if k in failures else bits for k, bits in ((1, proposed.words), (2, proposed.pairs))]
        before, proposed = proposed, Border(*more)
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole.select("lang", "n_words", "phrase", "f"), passes


def _words_of(first: int, last: int) -> Column:
    """Words ``first`` to ``last`` of a phrase, from 1."""
    return F.array_join(F.slice(F.split("phrase", " "), first, last - first + 1), " ")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of two or three words of each language: lang, rank, phrase, a, l, r, n,
    score, and cut (words before the lowest-scoring cut).

    A null lang is ``und``, a null text empty; repeated rows count each; an empty table gives no
    rows; other columns stay behind.  Scores are exact up to 10**16 occurrences."""
    counts, _ = frequent(docs, least)
    candidates = counts.where("n_words >= 2").select("lang", "n_words", "phrase", F.col("f").alias("a"))
    pairs = F.struct(F.lit(1).alias("k"), _words_of(1, 1).alias("left"), F.when(F.col("n_words") == 2, _words_of(2, 2)).otherwise(_words_of(2, 3)).alias("right"))
    triples = F.struct(F.lit(2).alias("k"), _words_of(1, 2).alias("left"), _words_of(3, 3).alias("right"))
    cuts = candidates.select("*", F.explode(F.when(F.col("n_words") == 2, F.array(pairs)).otherwise(F.array(pairs, triples))).alias("cut"))
    cuts = cuts.select("lang", "n_words", "phrase", "a", "cut.*")
    side = lambda name, f: counts.where("n_words IN (1, 2)").select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    both = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    whole = {c: f"CAST({c} AS DECIMAL(19,0))" for c in "alr"}
    score = F.expr(f"(CAST(1000000 AS DECIMAL(7,0)) * ({whole['a']} * {whole['a']})) div ({whole['l']} * {whole['r']})")
    lowest = both.withColumn("score", score).groupBy("lang", "n_words", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    around = candidates.where("n_words = 3").select("lang", F.explode(F.array(_words_of(1, 2), _words_of(2, 3))).alias("phrase"), F.col("a").alias("longer"))
    around = around.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = lowest.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < CONTAINED_PER_CENT * F.col("a")))
    row = left.select("lang", "phrase", "a", "m.l", "m.r", "m.score", F.col("m.k").alias("cut"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    first = row.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = counts.where("n_words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")
