"""Language-model scoring by online logistic context mixing.

Texts are read as bytes with A-Z lower-cased.  Bytes are coded as binary decisions along a prefix
code made from the training texts' byte counts, and an end mark (byte 0) closes each text.  For each
decision several predictors look up, by a hash of the last two to five bytes, or of the word so far,
and the place in the code, how often either bit followed in the training texts.  Their log-odds are
summed with weights; the weight set is chosen by a gate (how long a context is known, how well, and
how well the word is), and the weights are learned online, decision by decision, by the gradient of
the coding cost.  An adaptive table, learned along, refines the mixed probability.

One more binary decision stands before a *stretch*, some eight words cut where a word's hash says:
whether it is the stretch that always followed the one before it.  Its probability is kept by how
often that was seen, learned from all training texts; if it says yes, the stretch costs no more.

Scores are total log probabilities of whole texts.  A training text is scored as the other training
texts teach: its own occurrence is taken out of every count, in learning the mixer as in scoring, so
that scores of training and held-out texts compare.  No held-out text teaches anything.

Counts come from all training texts; tables grow with their bytes up to ``MOST_BITS`` and hold two
bytes a slot that keep the ratio of any two 64-bit sums, so they may be broadcast.  The mixer's
weights are learned from all training texts where they lie: each task learns a mixer over its texts,
and the tasks' mixers are averaged by how many decisions each gate had there.  What words and
stretches are followed by is looked up exactly: their hashes travel as blobs between shards (see
``common``) and are never cut.
"""

from __future__ import annotations

import heapq
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, flattened, give_back, kept, shard_count, shard_of, text_bytes, through_buckets
from .suffix import words_at

#: Context lengths in bytes, up to the longest one by one; the last predictor looks at the word so far.
ORDERS = (2, 3, 4, 5)
PREDICTORS = len(ORDERS) + 1
#: Slots of each predictor, as powers of two: of the training bytes, but within these bounds.
LEAST_BITS, MOST_BITS = 16, (19, 21, 21, 22, 22)
#: Bytes of text whose symbols are made, or scored, at once; distinct symbols of several such chunks
#: that are counted, or learned from, together.
CHUNK, SCORE_CHUNK, HELD_SYMBOLS = 1 << 19, 1 << 20, 1_600_000
#: Symbols whose decisions are made at once, so few that their arrays stay in a core's cache.
BLOCK = 1 << 13
#: Text in one shard, on average.
SHARD_BYTES = 8 << 20
#: Entries of the scorer's cache, as a power of two.
CACHE_BITS = 21
#: What a task's 32-bit sums may come to before they are given on.
FULL = (1 << 32) - 1
#: Ranges into which a table is cut to be summed; salts of the first summing step.
RANGES, SALTS = 24, 16
#: Step of the weights, and the batches into which distinct symbols are dealt.
MIX_STEP, MIX_BATCHES = 0.5, 128
#: Decisions that a refinement bucket remembers, at first and at most.
MIX_FIRST, MIX_MEMORY = 50, 1_000_000
HELD_MODULUS, HELD_REMAINDER = 7, 2
#: Text whose hashes of words and stretches meet in one bucket.
BUCKET_BYTES = 64 << 20
#: Buckets of the refinement over the mixed log-odds, in steps of half.
APM = 33
#: Words of a stretch on average; how often a stretch was seen: once, twice, up to four times, more.
STRETCH_WORDS, SEEN_LEVELS = 8, 4
_BACK = max(ORDERS)
_MIX, _ROLL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_UNROLL = np.uint64(pow(int(_ROLL), -1, 1 << 64))
_LOW32 = np.uint64(0xFFFFFFFF)
#: Marks the keys of training texts in the scorer's cache.
_OWN = np.uint64(0x5851F42D4C957F2D)
#: How texts are read: A-Z lower-cased, and NUL, which stands for the end of a text, as a byte that
#: UTF-8 never has.
READ = bytes([255]) + LOWER[1:]
_IS_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
#: The counts that a byte stands for: exact to 16, then in steps of 6 % up to 18 million.
_LEVELS = np.concatenate((np.arange(17.0), 16 * 1.06 ** np.arange(1, 240)))


def trains(doc_id: Column) -> Column:
    """Whether a document is among the training texts; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(HELD_MODULUS)) != HELD_REMAINDER


@dataclass
class Code:
    """Prefix code of the 256 bytes: for each depth, a byte's inner node (-1: none) and bit; and the
    slot bits of each predictor."""

    node: np.ndarray
    bit: np.ndarray
    slot_bits: tuple[int, ...]

    @classmethod
    def of(cls, counts: np.ndarray) -> Code:
        heap = [(int(c) + 1, i, i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        children: list[tuple] = []
        while len(heap) > 1:
            (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            children.append((x, y))
            heapq.heappush(heap, (a + b, 256 + len(children), 255 + len(children)))
        paths: list[list[tuple[int, int]]] = [[] for _ in range(256)]
        stack = [(255 + len(children), [])]
        while stack:
            at, path = stack.pop()
            if at < 256:
                paths[at] = path
            else:
                for bit, child in enumerate(children[at - 256]):
                    stack.append((child, [*path, (at - 256, bit)]))
        depth = max(map(len, paths))
        node, bit = np.full((depth, 256), -1, np.int16), np.zeros((depth, 256), np.uint8)
        for symbol, path in enumerate(paths):
            for k, (n, b) in enumerate(path):
                node[k, symbol], bit[k, symbol] = n, b
        fit = max(LEAST_BITS, int(counts.sum()).bit_length())
        return cls(node, bit, tuple(min(fit, most) for most in MOST_BITS))

    @property
    def edges(self) -> np.ndarray:
        """Where each predictor's slots begin in the joint table, and its length."""
        return np.concatenate(([0], np.cumsum([1 << b for b in self.slot_bits])))

    @cached_property
    def depth(self) -> np.ndarray:
        """How many decisions each byte takes."""
        return (self.node >= 0).sum(axis=0)

    @cached_property
    def first(self) -> np.ndarray:
        """Where each byte's decisions begin in ``place`` and ``bits``."""
        return np.cumsum(self.depth) - self.depth

    @cached_property
    def place(self) -> np.ndarray:
        """A number for the node of every decision, byte by byte."""
        return (self.node.T[self.node.T >= 0].astype(np.uint64) + np.uint64(1)) * _ROLL

    @cached_property
    def bits(self) -> np.ndarray:
        """The bit of every decision, byte by byte."""
        return self.bit.T[self.node.T >= 0]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    x ^= x >> np.uint64(32)
    return x


_POWERS = [np.ones(1, np.uint64)] * 2


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``_ROLL`` and of its inverse; the longest are kept."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_ROLL, _UNROLL)):
            _POWERS[k] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))))
    return _POWERS[0][:n], _POWERS[1][:n]


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where in it each kind begins.

    One sort of numbers that hold the place of a key below as many bits of its hash as fit (41 for
    eight million keys, of which some hundred thousandth part may meet another kind)."""
    if not len(key):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    bits = np.uint64(max(1, (len(key) - 1).bit_length()))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    held = _mixed(key)
    held &= ~mask
    held |= np.arange(len(key), dtype=np.uint64)
    held.sort()
    order = (held & mask).view(np.int64)
    held >>= bits
    return order, np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1])))


@dataclass
class Symbols:
    """Each byte of some texts and their end marks, in order.

    ``gram``: the byte with the five before it, as 48 bits.  ``word``: a hash of the word so far,
    0 at its start.  ``start``: where each text begins.  ``cut`` and ``stretch``: where each stretch
    begins, and its hash."""

    gram: np.ndarray
    word: np.ndarray
    start: np.ndarray
    cut: np.ndarray | None = None
    stretch: np.ndarray | None = None

    def key(self) -> np.ndarray:
        """One number for each byte with all that its predictors look at."""
        key = self.gram * _MIX
        key ^= self.word * _ROLL
        return key

    def distinct(self, n: np.ndarray | None = None) -> tuple[Symbols, np.ndarray]:
        """One of each kind of byte and context, and how often it occurs (the sum of ``n``)."""
        order, first = _grouped(self.key())
        n = np.diff(np.append(first, len(order))) if n is None else np.add.reduceat(n[order], first)
        return self.take(order[first]), n

    def take(self, at: np.ndarray | slice) -> Symbols:
        return Symbols(self.gram[at], self.word[at], self.start[:0])

    def clustered(self) -> np.ndarray:
        """An order in which bytes follow each other that have the four before them in common, and
        of these such that have the five; what has not comes by a hash."""
        most, orders = 1 << 24, []
        for a in range(0, len(self.gram), most):
            gram = self.gram[a : a + most]
            number = _mixed(gram & np.uint64((1 << 40) - 1))
            number &= ~np.uint64((1 << 32) - 1)
            number |= gram >> np.uint64(40) << np.uint64(24)
            number |= np.arange(len(gram), dtype=np.uint64)
            number.sort()
            number &= np.uint64(most - 1)
            orders.append(number.view(np.int64) + a)
        return np.concatenate(orders) if orders else np.empty(0, np.int64)

    def begins(self, k: int) -> np.ndarray:
        """Whether each byte, or one of the ``k`` before it, is another than with the byte in front."""
        gram = self.gram & np.uint64((1 << 8 * (k + 1)) - 1)
        return np.concatenate((np.ones(min(1, len(gram)), bool), gram[1:] != gram[:-1]))


class Words:
    """Where the words of whole texts end: each place is a white space, or the end mark that closes
    a text, and stands for the word, or nothing, between it and the place before.

    ``start``: the first place of each text.  ``word``: a hash of each word, 0 for none.  ``cut``:
    the first place of each stretch, ``stretch``: its hash."""

    def __init__(self, texts: list[bytes]):
        # five zeros stand before the first text
        self.flat = np.frombuffer(b"\0" * _BACK + b"\0".join(texts) + b"\0", np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.lengths, ends = lengths, np.cumsum(lengths) + (_BACK - 1)
        self.up, down = _powers(len(self.flat))
        # sums from which the rolling hash of any run of bytes follows
        self.total = self.flat.astype(np.uint64)
        self.total += np.uint64(1)
        self.total *= down
        np.cumsum(self.total, out=self.total)
        space = _IS_SPACE[self.flat]
        space[:_BACK] = True
        space[ends] = True  # a zero inside a text is no space
        self.places = np.flatnonzero(space)[_BACK - 1 :]
        self.before, self.last = self.places[:-1], self.places[1:]
        self.start = np.concatenate(([0], np.searchsorted(self.last, ends)[:-1] + 1))
        self.word = self._hash(self.before, self.last - 1)
        is_cut = np.zeros(len(self.last) + 1, bool)
        at = np.flatnonzero(self.word)
        is_cut[at[_mixed(self.word[at] ^ _OWN) % np.uint64(STRETCH_WORDS) == 0] + 1] = True
        is_cut[self.start] = True
        self.cut = np.flatnonzero(is_cut[:-1])
        self.stretch = self._hash(self.before[self.cut], self.last[np.append(self.cut[1:], len(self.last)) - 1])

    def _hash(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A hash of the bytes behind ``before`` to ``last``."""
        return _mixed((self.total[last] - self.total[before]) * self.up[last])

    def symbols(self) -> Symbols:
        """The bytes of the texts, each closed by its end mark."""
        n = len(self.flat) - _BACK
        start = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        gram = words_at(self.flat)[:n]
        gram >>= np.uint64(64 - 8 * (_BACK + 1))
        for k in range(_BACK):  # of each text's first bytes those before are none of its own
            at = start + k
            gram[at[at < n]] &= np.uint64((1 << 8 * (k + 1)) - 1)
        word = self.total[_BACK - 1 : -1] - np.repeat(self.total[self.before], np.diff(self.places))
        word *= self.up[_BACK - 1 : -1]
        return Symbols(gram, _mixed(word), start, self.before[self.cut] - (_BACK - 1), self.stretch)


def symbols(texts: list[bytes], stretches: bool = False) -> Symbols:
    """The bytes of ``texts``, each closed by its end mark; with ``stretches``, also these."""
    out = Words(texts).symbols()
    return out if stretches else Symbols(out.gram, out.word, out.start)


def slots_of(i: int, part: Symbols, row: np.ndarray, place: np.ndarray, code: Code) -> np.ndarray:
    """Slot of predictor ``i`` in the joint table, for decisions at ``place`` about ``row`` of ``part``."""
    if i < len(ORDERS):
        context = _mixed((part.gram >> np.uint64(8)) & np.uint64((1 << 8 * ORDERS[i]) - 1))
    else:
        context = part.word
    slot = context.take(row)
    slot += place
    slot *= _MIX
    slot >>= np.uint64(64 - code.slot_bits[i])
    slot = slot.view(np.int64)
    slot += code.edges[i]
    return slot


def decisions(gram: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``gram``, place among the code's decisions) of every binary decision, and where each
    row's decisions begin."""
    symbol = (gram & np.uint64(255)).astype(np.int64)
    size = code.depth.take(symbol)
    ends = np.cumsum(size)
    begin = ends - size
    row = np.repeat(np.arange(len(gram)), size)
    return row, np.arange(len(row)) + (code.first.take(symbol) - begin).take(row), begin


def merged(texts: Iterable[bytes], depth: int = 512) -> Iterator[tuple[Symbols, np.ndarray]]:
    """Distinct symbols of many texts and how often each occurs, by some ``HELD_SYMBOLS`` and no more
    than a 32-bit sum can take of one slot, to which a symbol adds at most its ``depth`` in the code.
    What turns out to be few when it is brought together waits for more.  They come clustered."""
    held: list[tuple[Symbols, np.ndarray]] = []

    def together() -> tuple[Symbols, np.ndarray]:
        parts = Symbols(np.concatenate([p.gram for p, _ in held]), np.concatenate([p.word for p, _ in held]), np.empty(0, np.int64))
        n = np.concatenate([n for _, n in held])
        held.clear()
        return parts.distinct(n)

    def given() -> tuple[Symbols, np.ndarray]:
        part, n = held.pop()
        order = part.clustered()
        return part.take(order), n[order]

    for chunk in _chunks(texts, CHUNK):
        held.append(symbols(chunk).distinct())
        full = sum(int(n.sum()) for _, n in held) > FULL // depth - CHUNK
        if full or sum(len(n) for _, n in held) > HELD_SYMBOLS:
            held.append(together())
            if full or len(held[0][1]) > 3 * HELD_SYMBOLS // 4:
                yield given()
    if held:
        held.append(together())
        yield given()


def count(table: np.ndarray, texts: list[bytes], code: Code) -> None:
    """Add the decisions of ``texts`` to ``table``, one column for each bit."""
    for part, n in merged(texts, len(code.node)):
        count_distinct(table, part, n, code)


def count_distinct(table: np.ndarray, part: Symbols, n: np.ndarray, code: Code) -> None:
    """The same for distinct symbols and how often each occurs.  What is the same to predictors of
    up to four bytes, or of five, is added once."""
    flat = table.reshape(-1)
    for predictors, k in ((range(_BACK - 2), _BACK - 1), ((_BACK - 2,), _BACK), ((_BACK - 1,), 0)):
        first = np.flatnonzero(part.begins(k)) if k else slice(None)
        some, times = part.take(first), (np.add.reduceat(n, first) if k else n).astype(np.uint32)
        for a in range(0, len(times), BLOCK):
            few = some.take(slice(a, a + BLOCK))
            row, at, _ = decisions(few.gram, code)
            place, bit, weight = code.place.take(at), code.bits.take(at), times[a : a + BLOCK].take(row)
            for i in predictors:
                slot = slots_of(i, few, row, place, code)
                slot <<= 1
                slot += bit
                np.add.at(flat, slot, weight)


def packed(n: np.ndarray) -> np.ndarray:
    """Pairs of counts (rows, 2) as two bytes in one number.  A pair beyond the largest level is
    scaled down as a whole, so that its ratio stays."""
    n = n.astype(np.float64)
    most = np.maximum(n[:, 0], n[:, 1])
    large = np.flatnonzero(most > _LEVELS[-1])
    n[large] *= _LEVELS[-1] / most[large, None]
    level = np.ceil(np.minimum(n, 16)).astype(np.uint16)
    large = n > 16
    level[large] = 16 + np.round(np.log(n[large] / 16) / np.log(1.06))
    return level[:, 0] | level[:, 1] << np.uint16(8)


def _known(zero: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of a one after these counts, and how well the context is known (0 to 4)."""
    total = zero + one
    level = (total > 0.5).astype(np.uint8) + (total > 1.5) + (total > 3.5) + (total > 15.5)
    return np.log((one + 0.3) / (zero + 0.3)).astype(np.float32), level.astype(np.uint8)


_ZERO, _ONE = np.tile(_LEVELS, 256), np.repeat(_LEVELS, 256)
#: The same for every pair of bytes; then without one zero, and without one one.
_ODDS, _KNOWN = (
    np.concatenate(x) for x in zip(_known(_ZERO, _ONE), _known(np.maximum(0, _ZERO - 1), _ONE), _known(_ZERO, np.maximum(0, _ONE - 1)), strict=True)
)
_GATES = (len(ORDERS) + 1) * 5 * 5
#: What each predictor says about the gate: the longest context that is known, and how well.
_GATE = [np.where(_KNOWN > 0, (i + 1) * 25 + _KNOWN * 5, 0).astype(np.uint8) for i in range(len(ORDERS))]


@dataclass
class Mixer:
    """Weights by gate, and the refinement table by gate and mixed log-odds."""

    weights: np.ndarray
    refine: np.ndarray

    @classmethod
    def new(cls) -> Mixer:
        middle = 1 / (1 + np.exp(-(np.arange(APM) - APM // 2) / 2))
        return cls(np.full((_GATES, PREDICTORS + 1), 0.35, np.float64), np.tile(middle, (_GATES, 1)))


def inputs(table: np.ndarray, part: Symbols, row: np.ndarray, at: np.ndarray, begin: np.ndarray, trained: bool, code: Code) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of each predictor (and a constant), and the gate, of ``decisions`` about ``part``.
    If ``trained``, each decision's own occurrence is taken out of the counts first."""
    place = code.place.take(at)
    shift = (code.bits.take(at).astype(np.int64) + 1) << 16 if trained else np.zeros(len(at), np.int64)

    def pairs(i: int, row: np.ndarray, place: np.ndarray, shift: np.ndarray) -> np.ndarray:
        at = slots_of(i, part, row, place, code)
        return np.add(table.take(at, mode="clip"), shift, out=at)

    def once(k: int) -> tuple[np.ndarray, np.ndarray]:
        """Decisions about bytes that are not alike, with the ``k`` before them, to the one in
        front, and for every decision its place among these."""
        fresh = part.begins(k)
        some = np.flatnonzero(fresh.take(row))
        size = np.where(fresh, np.diff(np.append(begin, len(row))), 0)
        first = (np.cumsum(size) - size)[np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))]
        return some, np.arange(len(row)) + (first - begin).take(row)

    # what is alike to a predictor is asked once: few neighbours differ in five bytes, fewer in four
    longest = len(ORDERS) - 1
    some, to = once(_BACK)
    least, to_least = once(_BACK - 1)
    short = np.empty((longest, len(least)), np.float32)
    gate = np.zeros(len(least), np.uint8)
    asked = row[least], place[least], shift[least]
    for i in range(longest):
        pair = pairs(i, *asked)
        _ODDS.take(pair, out=short[i], mode="clip")
        np.maximum(gate, _GATE[i].take(pair), out=gate)
    odds = np.empty((PREDICTORS + 1, len(row)), np.float32)
    odds[-1] = 0.3
    for i in range(longest):
        short[i].take(to_least, out=odds[i], mode="clip")
    pair = pairs(longest, row[some], place[some], shift[some])
    _ODDS.take(pair).take(to, out=odds[longest], mode="clip")
    gate = np.maximum(gate.take(to_least), _GATE[longest].take(pair).take(to))
    pair = pairs(longest + 1, row, place, shift)
    _ODDS.take(pair, out=odds[longest + 1], mode="clip")
    gate += _KNOWN.take(pair)
    return odds, gate.astype(np.int64)


def _bucket(gate: np.ndarray, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower refinement bucket and the share of the upper one."""
    at = np.clip(mixed * 2 + APM // 2, 0, APM - 1.001)
    low = at.astype(np.int64)
    return gate * APM + low, at - low


def _mixture(odds: np.ndarray, weights: np.ndarray, gate: np.ndarray) -> np.ndarray:
    out = np.zeros(len(gate), np.float32)
    for x, weight in zip(odds, np.ascontiguousarray(weights.T, np.float32), strict=True):
        out += x * weight.take(gate)
    return np.clip(out, -12, 12, out=out)


def _refined(mixer: Mixer, gate: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    """Final probability of a one."""
    base, high = _bucket(gate, mixed)
    table = mixer.refine.reshape(-1)
    p = (table[base] * (1 - high) + table[base + 1] * high + 1 / (1 + np.exp(-mixed))) / 2
    return np.clip(p, 1e-6, 1 - 1e-6)


def gradient(mixer: Mixer, odds: np.ndarray, gate: np.ndarray, bit: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What decisions that occur ``n`` times say about the mixer that predicts them, as sums that may
    be added: of each gate the decisions and the gradient of the cost by each weight, of each bucket
    the decisions and the ones."""
    sets = len(mixer.weights)
    mixed = _mixture(odds, mixer.weights, gate)
    base, high = _bucket(gate, mixed)
    error = n * (bit - 1 / (1 + np.exp(-mixed)))
    near = base + (high > 0.5)
    sums = [np.bincount(gate, n, sets), *(np.bincount(gate, error * x, sets) for x in odds)]
    return np.concatenate(sums + [np.bincount(near, w, mixer.refine.size) for w in (n, n * bit)])


def learn(mixer: Mixer, seen: np.ndarray, sums: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One batch of decisions (see ``gradient``): move each gate's weights along the mean gradient of
    the cost and the refinement towards the bits.  A gate with less than its ``least`` occurrences
    moves in proportion; ``seen`` counts what each bucket remembers.  Gives how many decisions each
    gate and each bucket had."""
    had, *slopes = np.split(sums[: -2 * seen.size], PREDICTORS + 2)
    count, ones = np.split(sums[-2 * seen.size :], 2)
    total = np.maximum(np.maximum(had, least), 1)
    for i, slope in enumerate(slopes):
        mixer.weights[:, i] += MIX_STEP * slope / total
    table, kept_ = mixer.refine.reshape(-1), seen.reshape(-1)
    table += (ones - count * table) / (kept_ + count)
    np.clip(mixer.refine, 1e-4, 1 - 1e-4, out=mixer.refine)
    np.minimum(kept_ + count, MIX_MEMORY, out=kept_)
    return had, count.reshape(seen.shape)


def train_mixer(table: np.ndarray, texts: list[bytes], code: Code) -> Mixer:
    """Mixer learned over ``texts``, which ``table`` (see ``packed``) counts."""
    return learned(table, texts, code)[0]


def learned(table: np.ndarray, texts: Iterable[bytes], code: Code) -> tuple[Mixer, np.ndarray, np.ndarray]:
    """A mixer learned over texts, and how many decisions each gate and each refinement bucket had.
    Equal bytes with equal contexts are one, with their number (see ``merged``)."""
    mixer = Mixer.new()
    seen = np.full(mixer.refine.shape, float(MIX_FIRST))
    gates, buckets = np.zeros(len(mixer.weights)), np.zeros(mixer.refine.shape)
    for part, n in merged(texts, len(code.node)):
        # they come by a hash of five bytes, so that a run of every so many is a fair sample of them
        n, least, done = n.astype(np.float64), np.zeros(len(gates)), 0
        for rows in np.array_split(np.arange(len(n)), min(MIX_BATCHES, -(-len(n) // 64))):
            sums = 0
            for a in range(rows[0], rows[-1] + 1, BLOCK):
                block = slice(a, min(a + BLOCK, rows[-1] + 1))
                few = part.take(block)
                row, at, begin = decisions(few.gram, code)
                odds, gate = inputs(table, few, row, at, begin, True, code)
                sums = sums + gradient(mixer, odds, gate, code.bits.take(at).astype(np.float32), n[block].take(row))
            had, count = learn(mixer, seen, sums, least / max(1, done))
            least, done, gates, buckets = least + had, done + 1, gates + had, buckets + count
    return mixer, gates, buckets


def trained_mixer(training: DataFrame, model: Broadcast) -> Mixer:
    """The mixer over all rows of ``training`` (text): every task learns one over its texts; they are
    summed in salted groups, weighted by their decisions, and these few sums once more."""
    start = Mixer.new()
    sets, shape = len(start.weights), start.refine.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, code = model.value
        mixer, gates, buckets = learned(table, _lowered(batches), code)
        data = np.concatenate([x.ravel() for x in (mixer.weights * gates[:, None], gates, mixer.refine * buckets, buckets)]).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([zlib.crc32(data) % SALTS], pa.int32()), pa.array([data])], ["salt", "data"])

    def total(t: pa.Table) -> pa.Table:
        data = np.sum([np.frombuffer(d, np.float64) for d in sorted(t["data"].to_pylist())], axis=0)
        return pa.table({"salt": t["salt"][:1], "data": pa.array([data.tobytes()])})

    parts = training.select("text").mapInArrow(run, "salt int, data binary")
    rows = parts.groupBy("salt").applyInArrow(total, "salt int, data binary").collect()  # at most SALTS rows
    if not rows:
        return start
    data = np.sum([np.frombuffer(r["data"], np.float64) for r in sorted(rows)], axis=0)
    weights, gates, refine, buckets = np.split(data, np.cumsum([start.weights.size, sets, start.refine.size]))
    weights, gates, refine, buckets = weights.reshape(start.weights.shape), gates[:, None], refine.reshape(shape), buckets.reshape(shape)
    return Mixer(np.where(gates > 0, weights / np.maximum(gates, 1), start.weights), np.where(buckets > 0, refine / np.maximum(buckets, 1), start.refine))


class Scorer:
    """Log10 probabilities of bytes under a trained model.

    The model stands still, so a byte's cost depends on it and its context alone: costs are kept in
    a direct-mapped table of ``2 ** CACHE_BITS`` entries, and only what is not there is worked out."""

    def __init__(self, table: np.ndarray, mixer: Mixer, code: Code):
        self.table, self.mixer, self.code = table, mixer, code
        self.key = np.full(1 << CACHE_BITS, np.iinfo(np.uint64).max, np.uint64)
        self.cost = np.zeros(1 << CACHE_BITS, np.float64)

    @staticmethod
    def _slots(key: np.ndarray) -> np.ndarray:
        return ((key * _MIX) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)

    def costs(self, part: Symbols, trained: bool = False) -> np.ndarray:
        """log10 probability of each byte of ``part`` after its context; if ``trained``, with its own
        occurrence taken out of the counts."""
        cost = np.zeros(len(part.gram))
        order = part.clustered()
        for a in range(0, len(cost), BLOCK):
            few = part.take(order[a : a + BLOCK])
            row, at, begin = decisions(few.gram, self.code)
            odds, gate = inputs(self.table, few, row, at, begin, trained, self.code)
            p = _refined(self.mixer, gate, _mixture(odds, self.mixer.weights, gate))
            cost[order[a : a + BLOCK]] = np.add.reduceat(np.log(np.where(self.code.bits.take(at), p, 1 - p)), begin)
        cost /= np.log(10)
        return cost

    def each(self, part: Symbols, trained: bool = False) -> np.ndarray:
        """The same for all bytes of texts, by way of the cache."""
        key = part.key() ^ (_OWN if trained else np.uint64(0))
        slot = self._slots(key)
        cost = self.cost[slot]
        miss = np.flatnonzero(self.key[slot] != key)
        if len(miss):
            order, first = _grouped(key[miss])
            chosen = miss[order[first]]
            new = self.costs(part.take(chosen), trained)
            cost[miss[order]] = np.repeat(new, np.diff(np.append(first, len(order))))
            distinct = key[chosen]
            at = self._slots(distinct)
            self.key[at] = distinct
            held = self.key[at] == distinct  # of several that share an entry one stays
            self.cost[at[held]] = new[held]
        return cost

    def score(self, texts: list[bytes], trained: bool = False) -> np.ndarray:
        """Each text with its end mark, by its bytes alone."""
        part = symbols(texts)
        return np.add.reduceat(self.each(part, trained), part.start)


_SCORERS: dict[str, Scorer] = {}


def _scorer(name: str, model: Broadcast, mixer: Mixer) -> Scorer:
    """The scorer of a model; a Python worker keeps the last one and what it has worked out."""
    if name not in _SCORERS:
        _SCORERS.clear()
        table, code = model.value
        _SCORERS[name] = Scorer(table, mixer, code)
    return _SCORERS[name]


def _lowered(batches: Iterable[pa.RecordBatch]) -> Iterator[bytes]:
    """The texts (first column) of Arrow batches, A-Z lower-cased."""
    for batch in batches:
        for text in batch.column(0):
            yield text.as_py().translate(READ)


def _chunks(texts: Iterable[bytes], most: int) -> Iterator[list[bytes]]:
    """Runs of texts of some ``most`` bytes."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def byte_counts(docs: DataFrame) -> np.ndarray:
    """How often each byte occurs in all texts as they are read (256 numbers; the first counts end
    marks, one for each row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            for t in batch.column(0):
                total += np.bincount(np.frombuffer(t.as_py().translate(READ), np.uint8), minlength=256)
            total[0] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(total)], ["b", "n"])

    rows = docs.select("text").mapInArrow(run, "b int, n long").groupBy("b").agg(F.sum("n")).collect()
    out = np.zeros(256, np.int64)
    for b, n in rows:
        out[b] = n
    return out


def count_tables(docs: DataFrame, code: Code) -> np.ndarray:
    """The joint table of counts (see ``packed``) over all rows of ``docs`` (text).

    A task sums its texts and gives its table in ``RANGES`` compressed parts, and begins anew before
    a 32-bit sum could be full; parts of a range are summed to 64 bits in salted groups and then
    once more."""
    size = int(code.edges[-1])
    bounds = np.linspace(0, size, RANGES + 1).astype(np.int64)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _SCORERS.clear()  # of an earlier model
        give_back()
        table = np.zeros((size, 2), np.uint32)
        pack = zstandard.ZstdCompressor(1).compress

        def summed() -> pa.RecordBatch:
            blobs = [pack(table[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            salt = zlib.crc32(blobs[0]) % SALTS
            return pa.RecordBatch.from_arrays([pa.array(range(RANGES), pa.int32()), pa.array([salt] * RANGES, pa.int32()), pa.array(blobs)], ["range", "salt", "data"])

        since = 0
        for symbols_, n in merged(_lowered(batches), len(code.node)):
            most = int(n.sum()) * len(code.node)  # a symbol adds at most its depth to one slot
            if since + most > FULL:
                since = int(table.max())
                if since + most > FULL:
                    yield summed()
                    since, table[:] = 0, 0
            since += most
            count_distinct(table, symbols_, n, code)
        yield summed()
        del table
        give_back()

    def total(blobs: pa.ChunkedArray, kind: type) -> np.ndarray:
        out = None
        for blob in blobs:
            more = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob.as_py()), kind)
            out = more.astype(np.uint64) if out is None else np.add(out, more, out=out)
        return out

    def once(t: pa.Table) -> pa.Table:
        data = zstandard.ZstdCompressor(1).compress(total(t["data"], np.uint32).tobytes())
        return pa.table({"range": t["range"][:1], "data": pa.array([data])})

    def last(t: pa.Table) -> pa.Table:
        return pa.table({"range": t["range"][:1], "data": pa.array([packed(total(t["data"], np.uint64).reshape(-1, 2)).tobytes()])})

    parts = docs.select("text").mapInArrow(part, "range int, salt int, data binary")
    summed = parts.groupBy("range", "salt").applyInArrow(once, "range int, data binary").groupBy("range").applyInArrow(last, "range int, data binary")
    out = np.zeros(size, np.uint16)
    for r in summed.toLocalIterator():  # two bytes a slot, 26 MB at most, whatever the corpus
        out[bounds[r["range"]] : bounds[r["range"] + 1]] = np.frombuffer(r["data"], np.uint16)
    return out


def _level(n: np.ndarray) -> np.ndarray:
    """Which of ``SEEN_LEVELS`` stands for having been seen ``n`` times (1 or more)."""
    return (n > 1).astype(np.int64) + (n > 2) + (n > 4)


def followers(part: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the stretch before, short hash of its own) of each stretch; before a text's first
    stands 0."""
    before = np.concatenate(([np.uint64(0)], part.stretch[:-1]))
    before[np.searchsorted(part.cut, part.start)] = 0
    return before, part.stretch & _LOW32


def _held(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes of the distinct words, how often each occurs, distinct (stretch before, stretch) with
    counts) of texts; a text's first stretch is left out."""
    words, befores, owns = ([np.empty(0, np.uint64)] for _ in range(3))
    for chunk in _chunks(texts, SCORE_CHUNK):
        part = Words(chunk)
        before, own = followers(part)
        words.append(part.word[part.word != 0])
        befores.append(before[before != 0])
        owns.append(own[before != 0])
    every = np.sort(np.concatenate(words))
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(every)), bool), every[1:] != every[:-1])))
    return every[first], np.diff(np.append(first, len(every))), _summed(np.concatenate(befores), np.concatenate(owns), None)


def _summed(key: np.ndarray, own: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((own, key))
    key, own = key[order], own[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), (key[1:] != key[:-1]) | (own[1:] != own[:-1]))))
    if n is None:
        n = np.diff(np.append(first, len(key)))
    else:
        n = np.add.reduceat(n[order], first) if len(first) else n
    return key[first], own[first], n


def judged_followers(key: np.ndarray, own: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What the training texts say about each distinct ``key``, from distinct (key, own) with
    counts: (key, always, but, guess) and the table (``SEEN_LEVELS``, 2) of misses and hits.

    ``guess`` followed the key ``always`` times (0: not always).  Where it always did but once,
    ``but`` says how often, so that the one exception can be told that it was expected elsewhere.
    The table counts, for each training occurrence, what the others foretold."""
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    kinds = np.diff(np.append(first, len(key)))
    total = np.add.reduceat(n, first) if len(first) else n
    least = np.minimum.reduceat(n, first) if len(first) else n
    guess = own[first]
    # of two followers the more frequent
    two = np.flatnonzero(kinds == 2)
    second = two[n[first[two] + 1] > n[first[two]]]
    guess[second] = own[first[second] + 1]
    always = np.where(kinds == 1, total, 0)
    but = np.where((kinds == 2) & (least == 1), total - 1, 0)
    table = np.zeros((SEEN_LEVELS, 2), np.int64)
    again = always[always > 1]
    table[:, 1] += np.bincount(_level(again - 1), again, SEEN_LEVELS).astype(np.int64)
    odd = but[but > 0]
    table[:, 0] += np.bincount(_level(odd), np.where(odd == 1, 2, 1), SEEN_LEVELS).astype(np.int64)
    return key[first], always, but, guess, table


def foretold(own: np.ndarray, always: np.ndarray, but: np.ndarray, guess: np.ndarray, trained: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each stretch, how often what stood before it was seen with one follower (0: no flag is
    coded), and whether it is that follower.  A training text's own occurrence does not count."""
    if not trained:
        return always, own == guess
    exception = (but == 1) | ((but > 1) & (own != guess))
    return np.where(always > 0, always - 1, np.where(exception, but, 0)), always > 0


_SHARED = "bucket int, shard int, keys binary, counts binary, befores binary, always binary, but binary, guesses binary"


def word_table(base: DataFrame, buckets: int) -> DataFrame:
    """What all training texts say about the words and stretches of each shard, by (shard, bucket),
    as parallel blobs: ``keys`` and ``counts`` of words; ``befores``, ``always``, ``but`` and
    ``guesses`` of stretches (see ``judged_followers``).  Rows of shard -1 hold a bucket's sums:
    n_tokens, n_distinct and the table of misses and hits."""
    cuts = np.array([b * (2**64 // buckets) for b in range(1, buckets)], np.uint64)

    def ask(t: pa.Table) -> pa.Table:
        train = np.array(t["train"].to_pylist(), bool)
        texts = lambda of: (t["text"][i].as_py().translate(READ) for i in np.flatnonzero(train == of).tolist())
        keys, counts, (asked, own, n) = _held(texts(True))
        # held-out texts ask about words and stretches, but teach nothing
        more, _, (other, _, _) = _held(texts(False))
        more, other = np.setdiff1d(more, keys), np.setdiff1d(other, asked)
        place = np.searchsorted(keys, more)
        keys, counts = np.insert(keys, place, more), np.insert(counts, place, 0)
        place = np.searchsorted(asked, other)
        asked, own, n = np.insert(asked, place, other), np.insert(own, place, np.uint64(0)), np.insert(n, place, 0)
        at = np.searchsorted(keys, cuts)
        far = np.searchsorted(asked, cuts)
        cut = lambda x, kind, at: [p.astype(kind).tobytes() for p in np.split(x, at)]
        return pa.table(
            {
                "bucket": pa.array(range(buckets), pa.int32()),
                "shard": pa.repeat(pa.scalar(t["shard"][0].as_py(), pa.int32()), buckets),
                "keys": cut(keys, np.uint64, at),
                "counts": cut(counts, np.uint64, at),
                "befores": cut(asked, np.uint64, far),
                "always": cut(n, np.uint32, far),
                "but": pa.array([b""] * buckets, pa.binary()),
                "guesses": cut(own, np.uint32, far),
            }
        )

    def answer(t: pa.Table) -> pa.Table:
        read = lambda c, kind: [np.frombuffer(x.as_py(), kind) for x in t[c]]
        keys = read("keys", np.uint64)
        every, back = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(every), np.uint64)
        np.add.at(total, back, np.concatenate(read("counts", np.uint64)))
        replies = [total[np.searchsorted(every, k)].tobytes() for k in keys]
        del back
        asked, own, n = read("befores", np.uint64), read("guesses", np.uint32), read("always", np.uint32)
        flat = [np.concatenate(x) for x in (asked, own, n)]
        real = flat[2] > 0
        known, *told, table = judged_followers(*_summed(flat[0][real], flat[1][real], flat[2][real].astype(np.int64)))
        del flat, real
        kinds = [np.uint16, np.uint16, np.uint32]
        most = [np.iinfo(k).max for k in kinds]
        wanted = [np.unique(a) for a in asked]
        at = [np.searchsorted(known, w) for w in wanted]
        hit = [np.append(known, np.uint64(0))[a] == w for a, w in zip(at, wanted, strict=True)]
        wanted, at = [w[h] for w, h in zip(wanted, hit, strict=True)], [a[h] for a, h in zip(at, hit, strict=True)]
        # neither always nor but: nothing to tell
        useful = [(told[0][a] > 0) | (told[1][a] > 0) for a in at]
        sums = np.concatenate(([total.sum(), (total > 0).sum()], table.ravel())).astype(np.uint64).tobytes()
        out = [[np.minimum(x[a[u]], m).astype(k).tobytes() for a, u in zip(at, useful, strict=True)] for x, k, m in zip(told, kinds, most, strict=True)]
        none = pa.array([b""], pa.binary()).to_pylist()
        return pa.table(
            {
                "bucket": pa.repeat(t["bucket"][0], len(keys) + 1),
                "shard": pa.array([*t["shard"].to_pylist(), -1], pa.int32()),
                "keys": pa.array([*t["keys"].to_pylist(), b""], pa.binary()),
                "counts": pa.array([*replies, sums]),
                "befores": pa.array([w[u].tobytes() for w, u in zip(wanted, useful, strict=True)] + none),
                **{c: pa.array(x + none) for c, x in zip(("always", "but", "guesses"), out, strict=True)},
            }
        )

    return through_buckets(base.groupBy("shard").applyInArrow, ask, answer, _SHARED, buckets)


def scored(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Both scores are of the text with A-Z lower-cased.  A null text is empty: one end token.  Without
    training texts every count is 0.  Rows that repeat a doc_id are rows of their own; an empty
    table gives no rows."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    base = docs.select(F.col("doc_id").cast("long"), text.alias("text"), trains(F.col("doc_id")).alias("train"))
    training = base.where("train")
    histogram = byte_counts(training)
    n_bytes, ends = text_bytes(base), int(histogram[0])
    code = Code.of(histogram)
    model = spark.sparkContext.broadcast((count_tables(training, code), code))  # 26 MB at most
    mixer = trained_mixer(training, model)
    base = base.withColumn("shard", shard_of(shard_count(n_bytes, SHARD_BYTES), "doc_id", "text"))
    words = kept(word_table(base, shard_count(n_bytes, BUCKET_BYTES)), "lm-words")
    sums = words.where("shard = -1")
    sums = (sums.select(F.explode("parts.counts")) if "parts" in words.columns else sums.select("counts")).toLocalIterator()  # ten numbers a bucket
    sums = sum((np.frombuffer(r[0], np.uint64) for r in sums), np.zeros(2 + 2 * SEEN_LEVELS, np.uint64))
    n_tokens, n_distinct = int(sums[0]) + ends, int(sums[1]) + (ends > 0)
    table = sums[2:].reshape(SEEN_LEVELS, 2).astype(np.float64) + 1
    flag = np.log10(table / table.sum(axis=1, keepdims=True))
    name = uuid.uuid4().hex
    below = np.log10(n_tokens + n_distinct + 1)

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        texts = [t.as_py().translate(READ) for t in rows["text"]]
        told = flattened(told)
        order = np.argsort(told["bucket"].to_numpy(), kind="stable")
        joined = lambda c, kind: np.frombuffer(b"".join(told[c][i].as_py() for i in order.tolist()), kind)
        keys, counts = joined("keys", np.uint64), joined("counts", np.uint64)
        befores = np.append(joined("befores", np.uint64), np.uint64(0))
        told = [np.append(joined(c, k), k(0)) for c, k in (("always", np.uint16), ("but", np.uint16), ("guesses", np.uint32))]
        logs, keys = np.append(np.log10(counts + 1.0), 0.0), np.append(keys, np.iinfo(np.uint64).max)
        size, known, base_score, score = (np.zeros(len(texts), k) for k in (np.int64, np.int64, np.float64, np.float64))
        scorer = _scorer(name, model, mixer)
        train = np.array(rows["train"].to_pylist(), bool)
        for trained in (False, True):
            chosen, done = np.flatnonzero(train == trained), 0
            for chunk in _chunks((texts[i] for i in chosen.tolist()), SCORE_CHUNK):
                part = Words(chunk)
                bytes_ = part.symbols()
                mine, done = chosen[done : done + len(chunk)], done + len(chunk)
                own, end = np.zeros(len(part.word)), part.word != 0
                own[end] = logs[np.searchsorted(keys, part.word[end])]
                for out, value in ((size, end.astype(np.int64)), (known, (own > 0).astype(np.int64)), (base_score, own)):
                    out[mine] = np.add.reduceat(value, part.start)
                cost = np.add.reduceat(scorer.each(bytes_, trained), bytes_.cut)
                before, own = followers(part)
                at = np.searchsorted(befores[:-1], before)
                at = np.where(befores[at] == before, at, len(befores) - 1)
                seen, hit = foretold(own, *(x[at].astype(np.int64) for x in told[:2]), told[2][at], trained)
                seen = np.where(before == 0, 0, seen)
                level = _level(seen)
                cost = np.where(seen > 0, np.where(hit, flag[level, 1], flag[level, 0] + cost), cost)
                score[mine] = np.add.reduceat(cost, np.searchsorted(part.cut, part.start))
        known += ends > 0
        base_score += np.log10(ends + 1.0) - (size + 1) * below
        give_back()
        return pa.table(
            {
                "doc_id": rows["doc_id"],
                "held_out": pa.array(~train, pa.bool_()),
                "n_tokens": pa.array(size + 1, pa.int64()),
                "n_known": pa.array(known, pa.int64()),
                "train_tokens": pa.repeat(pa.scalar(n_tokens, pa.int64()), len(texts)),
                "base_score": pa.array(base_score, pa.float64()),
                "score": pa.array(score, pa.float64()),
            }
        )

    replies = words.where("shard >= 0")
    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return base.groupBy("shard").cogroup(replies.groupBy("shard")).applyInArrow(run, kinds)
