"""Byte-level BPE encoding and decoding with numpy matrices.

Texts are cut by the tokenizer's pattern; the distinct pieces of an Arrow batch are encoded once.
Pieces of similar length share a padded matrix of token ids.  In each round every row merges its
leftmost pair of minimum rank: pair ranks come from an open-addressing hash table in numpy, the
merged row is compacted to the left, and rows without a mergeable pair leave the matrix.

Nulls encode as empty texts.  Texts of any length are handled whole: a piece longer than
``LONG_PIECE`` gets a heap over its links instead of matrix rounds, which would cost a pass over
the piece per merge; both give the leftmost minimum-rank order.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes from which a piece is merged with a heap.
LONG_PIECE = 256
#: Texts that are encoded together, and their bytes.
BATCH_ROWS, BATCH_BYTES = 4096, 24 << 20
#: Cells of one padded matrix.
MATRIX_CELLS = 1 << 20

_NONE = np.int32(1 << 30)


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes -> rank from the text of a rank file (base64 token, blank, rank)."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Bpe:
    """Encoder and decoder for one vocabulary.

    ``ranks`` must hold the 256 single bytes.  ``pattern`` is a ``regex`` pattern whose matches are
    encoded one by one; ``None`` takes a text as one piece.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str | None):
        import regex

        self.ranks = ranks
        self.cut = regex.compile(pattern).findall if pattern else (lambda t: [t] if t else [])
        size = max(ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.strings = [str(i) for i in range(size)]
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self._size = np.uint64(size)
        self._pairs()

    def _pairs(self) -> None:
        """Hash table from (left id, right id) to the id of the joined token.

        Every split of a token into two tokens is a pair that a merge may meet."""
        left, right, out = [], [], []
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    out.append(rank)
        keys = np.array(left, np.uint64) * self._size + np.array(right, np.uint64)
        values = np.array(out, np.int32)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self._shift, self._mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.table_key = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.table_value = np.full(1 << bits, _NONE, np.int32)
        slot = self._slot(keys)
        self.probes = 0
        left_over = np.arange(len(keys))
        while len(left_over):
            self.probes += 1
            at = slot[left_over]
            free = self.table_key[at] == np.iinfo(np.uint64).max
            _, first = np.unique(at, return_index=True)
            won = first[free[first]]
            self.table_key[at[won]] = keys[left_over[won]]
            self.table_value[at[won]] = values[left_over[won]]
            left_over = np.delete(left_over, won)
            slot[left_over] = (slot[left_over] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each joined pair, ``_NONE`` where the pair is no token."""
        keys = left.astype(np.uint64) * self._size + right.astype(np.uint64)
        out = np.full(len(keys), _NONE, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        for _ in range(self.probes):
            found = self.table_key[slot]
            hit = found == keys
            out[todo[hit]] = self.table_value[slot[hit]]
            on = ~hit & (found != np.iinfo(np.uint64).max)
            if not on.any():
                break
            todo, keys, slot = todo[on], keys[on], (slot[on] + 1) & self._mask
        return out

    def _matrix(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pieces of similar length, by rounds over one padded matrix."""
        lengths = np.array([len(p) for p in pieces])
        width = int(lengths.max())
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[np.arange(width) < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        out: list[list[int]] = [[]] * len(pieces)
        rows = np.arange(len(pieces))
        rank = np.full((len(pieces), max(1, width - 1)), _NONE, np.int32)
        if width > 1:
            both = ids[:, 1:] >= 0
            rank[both] = self.pair_ranks(ids[:, :-1][both], ids[:, 1:][both])
        while True:
            best = rank.argmin(axis=1)
            value = rank[np.arange(len(rows)), best]
            done = value == _NONE
            if done.any():
                ended, flat = lengths[done], ids[done]
                flat, at = flat[np.arange(width) < ended[:, None]].tolist(), 0
                for r, size in zip(rows[done].tolist(), ended.tolist(), strict=True):
                    out[r] = flat[at : at + size]
                    at += size
                go = ~done
                rows, ids, rank, lengths, best, value = rows[go], ids[go], rank[go], lengths[go], best[go], value[go]
                if not len(rows):
                    return out
                width = int(lengths.max())
                ids, rank = ids[:, :width], rank[:, : width - 1]
            at = np.arange(len(rows))
            # compaction: what stands right of the merged pair moves one place to the left
            columns = np.arange(width)
            source = np.minimum(columns + (columns > best[:, None]), width - 1)
            ids = np.take_along_axis(ids, source, axis=1)
            ids[at, best] = value
            lengths = lengths - 1
            ids[columns >= lengths[:, None]] = -1
            columns = np.arange(width - 1)
            rank = np.take_along_axis(rank, np.minimum(columns + (columns >= best[:, None]), width - 2), axis=1)
            rank[columns >= lengths[:, None] - 1] = _NONE
            has = best + 1 < lengths
            rank[at[has], best[has]] = self.pair_ranks(ids[at[has], best[has]], ids[at[has], best[has] + 1])
            has = best > 0
            rank[at[has], best[has] - 1] = self.pair_ranks(ids[at[has], best[has] - 1], ids[at[has], best[has]])

    def _long(self, piece: bytes) -> list[int]:
        """Ids of one long piece: a heap of (rank, place) over a linked list."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pair_ranks(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != _NONE]
        heapq.heapify(heap)
        tokens, ranks = self.tokens, self.ranks
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := ranks.get(tokens[ids[x]] + tokens[ids[y]])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def encode_pieces(self, pieces: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Ids of each distinct piece."""
        out: dict[bytes, list[int]] = {}
        todo = []
        for p in pieces:
            rank = self.ranks.get(p)
            if rank is not None:
                out[p] = [rank]
            elif len(p) > LONG_PIECE:
                out[p] = self._long(p)
            elif p:
                todo.append(p)
            else:
                out[p] = []
        todo.sort(key=len)
        at = 0
        while at < len(todo):
            end = at + 1
            widest = len(todo[at]) * 5 // 4 + 1
            while end < len(todo) and len(todo[end]) <= widest and (end - at) * widest < MATRIX_CELLS:
                end += 1
            for p, ids in zip(todo[at:end], self._matrix(todo[at:end]), strict=True):
                out[p] = ids
            at = end
        return out

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts.

        The cyclic garbage collector rests meanwhile: the many small lists hold no cycles."""
        on = gc.isenabled()
        gc.disable()
        try:
            cuts = [self.cut(t) for t in texts]
            distinct = list(set(chain.from_iterable(cuts)))
            raw = [p.encode("utf-8", "surrogatepass") for p in distinct]
            ids = self.encode_pieces(raw)
            by_piece = dict(zip(distinct, map(ids.__getitem__, raw), strict=True))
            return [list(chain.from_iterable(map(by_piece.__getitem__, c))) for c in cuts]
        finally:
            if on:
                gc.enable()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_CACHE: dict[tuple[str, str | None], Bpe] = {}


def _loaded(name: str, pattern: str | None) -> Bpe:
    """The coder of a rank file that the driver sent along; a worker builds it once."""
    if (name, pattern) not in _CACHE:
        with open(SparkFiles.get(name), "rb") as f:
            _CACHE[name, pattern] = Bpe(read_ranks(f.read()), pattern)
    return _CACHE[name, pattern]


def _batched(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Batches of some ``BATCH_ROWS`` rows, so that pieces in common are encoded once, or less where
    their texts (column ``text``) come to ``BATCH_BYTES``."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            held.append(part)
            rows, size = rows + part.num_rows, size + (pc.sum(pc.binary_length(part.column(text))).as_py() or 0)
            if rows >= BATCH_ROWS or size >= BATCH_BYTES:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows, size = [], 0, 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def send_ranks(spark: SparkSession, path: str) -> str:
    """Hand the rank file (some 1 MB, fixed) to all executors; gives its name there."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode(docs: DataFrame, ranks_path: str, pattern: str | None, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with an array<int> column of token ids.  A null text has no ids; other columns,
    whatever their names, stay (a column named ``out`` is replaced), as do repeated rows; an empty
    table gives no rows."""
    name = send_ranks(docs.sparkSession, ranks_path)

    @F.arrow_udf("array<int>")
    def ids(column: pa.Array) -> pa.Array:
        coder = _loaded(name, pattern)
        return pa.array(coder.encode_batch([t or "" for t in column.to_pylist()]), pa.list_(pa.int32()))

    return docs.withColumn(out, ids(F.col(text)))


def decode(docs: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that an array<int> column stands for; null ids give no bytes."""
    name = send_ranks(docs.sparkSession, ranks_path)

    @F.arrow_udf("binary")
    def raw(column: pa.Array) -> pa.Array:
        coder = _loaded(name, None)
        return pa.array([coder.decode(x or ()) for x in column.to_pylist()], pa.binary())

    return docs.withColumn(out, raw(F.col(ids)))


def tokens(docs: DataFrame, ranks_path: str, pattern: str | None) -> DataFrame:
    """Per row: doc_id, lang, source, n_tokens, ids (array<int>) and decoded_chars, the code points
    of the text that the ids decode to; an id sequence that does not decode to its text fails the
    job.  A null text counts as empty, repeated rows stay, an empty table gives no rows."""
    name = send_ranks(docs.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _loaded(name, pattern)
        for part in _batched(batches, 3):
            texts = [t or "" for t in part.column(3).to_pylist()]
            ids = coder.encode_batch(texts)
            back = [coder.decode(x).decode("utf-8", "surrogatepass") for x in ids]
            if back != texts:
                raise ValueError("token ids do not decode to their text")
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(map(len, back), pa.int64())],
                ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_chars"],
            )

    part = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    return part.mapInArrow(run, "doc_id long, lang string, source string, n_tokens long, ids array<int>, decoded_chars long")


def token_digests(docs: DataFrame, ranks_path: str, pattern: str | None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Encodes each whole text, decodes the ids again, and digests both inside one Arrow pass, so
    neither ids nor bytes travel back to the JVM.  A null text counts as empty; a repeated doc_id
    keeps its rows; an empty table gives no rows."""
    name = send_ranks(docs.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _loaded(name, pattern)
        for part in _batched(batches, 1):
            n, ids_sha, text_sha = [], [], []
            for ids in coder.encode_batch([t or "" for t in part.column(1).to_pylist()]):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(coder.strings.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
