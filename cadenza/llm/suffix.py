"""Suffix-array dedup of repeated byte strings across documents.

A byte goes when a ``LEAST``-byte string that covers it also starts in a document with a smaller
doc_id.  The work is done in shards of whole documents:

1. Every ``LEAST``-byte window has a *mark*, the smallest hash among its 24-byte pieces.  Equal
   windows have equal marks, so a window whose mark no other document has is no repeat.  Shards
   send their distinct marks to buckets and learn which are shared.
2. A shard builds a suffix array over the text under shared marks (Larsson-Sadakane refinement:
   sort by eight bytes, then refine only unsorted groups by the rank twice as far on), and Kasai's
   common prefixes cut it into classes of equal windows.  Windows of a class outside its smallest
   document are repeats; one owner's windows remain for the other shards.
3. Buckets merge the shards: the remaining windows travel as runs of text under one mark, are
   looked up by binary search among the bucket's distinct runs, whose own suffix array names the
   smallest document of every window.
4. Shards gather what was found for their documents and cut it out.

The documents are dealt once; the three steps that read them share that exchange.  A passage in a
third of all documents is one run per shard.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flattened, shard_count, shard_of, text_bytes, through_buckets

#: Length of a string whose repeats go; bytes of the hashed pieces of a mark.
LEAST, PIECE = 50, 24
SHARD_BYTES = 4 << 20
#: Shards whose marks, and whose runs of text, one bucket gathers on average.
MARKS_OF, RUNS_OF = 8, 2
#: Positions of one suffix array.
ARRAY_CELLS = 4 << 20
#: Stands for a null doc_id: after all others.
LAST_ID = (1 << 63) - 1
_KINDS = "bucket int, shard int, kind int, a binary, b binary, c binary, d binary, e binary"


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a big-endian number; zeros follow the end."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(16, np.uint8)))
    out = np.empty((n + 7) // 8 * 8, np.uint64)
    for r in range(8):
        out[r::8] = padded[r : r + len(out[r::8]) * 8].view(">u8")
    return out[:n]


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, eight-byte words) of ``text``; suffixes that agree in ``depth`` bytes or more
    may stand in any order, which no common prefix up to ``depth`` notices."""
    n = len(text)
    word = words_at(text)
    order = np.argsort(word).astype(np.int32)
    ordered = word[order]
    head = np.empty(n, bool)
    head[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=head[1:])
    del ordered
    start = np.flatnonzero(head)
    rank = np.empty(n + 1, np.int32)
    rank[order] = np.repeat(start, np.diff(np.append(start, n)))
    rank[n] = -1
    far = 8
    while far < depth:
        # positions of the array in groups of two or more
        alone = head & np.append(head[1:], True)
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        suffix = order[open_]
        key = rank[suffix].astype(np.int64) * (n + 2) + rank[np.minimum(suffix + far, n)] + 1
        by = np.argsort(key)
        order[open_] = suffix = suffix[by]
        key = key[by]
        new = np.empty(len(key), bool)
        new[:1] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        head[open_] = new
        at = np.flatnonzero(new)
        rank[suffix] = np.repeat(open_[at], np.diff(np.append(at, len(new))))
        far *= 2
    return order, word


def common_prefixes(order: np.ndarray, word: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the array, up to ``most`` (0 for the
    first).  Kasai's walk along the text, in which a prefix shrinks by one at most from one
    position to the next, taken by many lanes of neighbouring positions at once."""
    n = len(order)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    lanes = max(1, min(n, 1 << 14))
    step = -(-n // lanes)
    out = np.zeros(n, np.uint8)
    held = np.zeros(lanes, np.int64)
    base = np.arange(lanes, dtype=np.int64) * step
    limits = np.uint64(1) << np.arange(8, 64, 8, dtype=np.uint64)
    for k in range(step):
        at = base + k
        inside = at < n
        at = at[inside]
        other = before[at].astype(np.int64)
        # beyond the array's depth the order is any order, so after a full prefix the walk restarts
        h = np.where((other >= 0) & (held[inside] < most), np.maximum(held[inside] - 1, 0), 0)
        go = np.flatnonzero(other >= 0)
        while len(go):
            x, y = at[go] + h[go], other[go] + h[go]
            ok = np.maximum(x, y) < n
            go, x, y = go[ok], x[ok], y[ok]
            differ = word[x] ^ word[y]
            same = np.where(differ == 0, 8, 7 - np.searchsorted(limits, differ, side="right"))
            h[go] += same
            go = go[(same == 8) & (h[go] < most)]
        h = np.minimum(h, np.minimum(most, n - np.maximum(at, other)))
        out[at] = h
        held[inside] = h
    return out[order]


def classes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, class of each of its entries): entries of a class agree in ``LEAST`` bytes."""
    order, word = suffix_array(text, LEAST)
    return order, np.cumsum(common_prefixes(order, word, LEAST) < LEAST)


def least_by_window(text: np.ndarray, valid: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each position of ``text`` that is a window (``valid``), the smallest ``doc`` of equal
    windows; elsewhere the position's own."""
    order, group = classes(text)
    real = valid[order]
    order, group = order[real], group[real]
    out = doc.copy()
    if len(order):
        at = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        out[order] = np.repeat(np.minimum.reduceat(doc[order], at), np.diff(np.append(at, len(order))))
    return out


def marks(text: np.ndarray) -> np.ndarray:
    """The mark of the window from each position (the last ``LEAST - 1`` have none)."""
    word = words_at(text)
    n = len(text)
    if n < LEAST:
        return np.empty(0, np.uint64)
    h = word[: n - PIECE + 1] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += word[8 : n - PIECE + 9] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xA24BAED4963EE407)
    h += word[16 : n - PIECE + 17] * np.uint64(0x9FB21C651E98DF25)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    wide = 1
    span = LEAST - PIECE + 1
    while wide * 2 <= span:
        h = np.minimum(h[:-wide], h[wide:])
        wide *= 2
    if wide < span:
        h = np.minimum(h[: wide - span], h[span - wide :])
    return h


class Shard:
    """The distinct texts of a shard, joined, with the marks of their windows."""

    def __init__(self, rows: pa.Table):
        ids, texts = rows["id"].to_pylist(), rows["text"].to_pylist()
        owner: dict[bytes, int] = {}
        for i, t in zip(ids, texts, strict=True):
            owner[t] = min(i, owner.get(t, i))
        self.ids, self.texts = ids, texts
        self.distinct = sorted(owner, key=lambda t: (owner[t], t))
        self.number = {t: k for k, t in enumerate(self.distinct)}
        self.owner = np.array([owner[t] for t in self.distinct], np.int64)
        lengths = np.fromiter(map(len, self.distinct), np.int64, len(self.distinct))
        self.start = np.concatenate(([0], np.cumsum(lengths)))
        self.text = np.frombuffer(b"".join(self.distinct), np.uint8)
        self.repeated = {t for i, t in zip(ids, texts, strict=True) if i != owner[t]}

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, number of its text, mark) of every window inside one text."""
        mark = marks(self.text)
        part = np.repeat(np.arange(len(self.distinct)), np.diff(self.start))[: len(mark)]
        inside = np.flatnonzero(np.arange(len(mark)) + LEAST <= self.start[part + 1])
        return inside, part[inside], mark[inside]


def _short(marks_: np.ndarray) -> bytes:
    """The low 40 bits of marks: different marks that agree in them are merely looked at closer."""
    return np.ascontiguousarray(marks_.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).ravel()


def _bucket_cuts(n: int) -> np.ndarray:
    # marks are minima of 35 hashes, so most are small: cut where equal shares of them lie
    share = np.arange(1, n) / n
    return ((1 - (1 - share) ** (1 / (LEAST - PIECE + 1))) * 2.0**64).astype(np.uint64)


def _rows(bucket, shard, kind, *columns) -> pa.Table:
    n = len(bucket)
    out = {"bucket": pa.array(bucket, pa.int32()), "shard": pa.array(shard, pa.int32()), "kind": pa.array(kind, pa.int32())}
    for name, values in zip("abcde", [*columns, *[[None] * n] * (5 - len(columns))], strict=True):
        out[name] = pa.array(values, pa.binary())
    return pa.table(out)


def _send_marks(n_buckets: int):
    def run(rows: pa.Table) -> pa.Table:
        shard = Shard(rows)
        _, part, mark = shard.windows()
        keys, n = np.empty(0, np.uint64), np.empty(0, bool)
        if len(mark):
            turn = np.flatnonzero(np.concatenate(([True], (mark[1:] != mark[:-1]) | (part[1:] != part[:-1]))))
            by = np.argsort(mark[turn])
            key, of = mark[turn][by], part[turn][by]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            keys, n = key[first], np.minimum.reduceat(of, first) != np.maximum.reduceat(of, first)
        at = np.searchsorted(keys, _bucket_cuts(n_buckets))
        number = rows["shard"][0].as_py()
        return _rows(
            range(n_buckets), [number] * n_buckets, [0] * n_buckets,
            [_short(k) for k in np.split(keys, at)], [np.packbits(x).tobytes() for x in np.split(n, at)],
        )

    return run


def _answer_marks(rows: pa.Table) -> pa.Table:
    """For each shard's marks, in order: which of them several documents have, and which several
    shards."""
    keys = [_long(k.as_py()) for k in rows["a"]]
    flat = np.concatenate(keys)
    flat.sort()
    twice = np.unique(flat[1:][flat[1:] == flat[:-1]])
    several, wide = [], []
    for key, own in zip(keys, rows["b"], strict=True):
        at = np.searchsorted(twice, key)
        cross = np.zeros(len(key), bool)
        ok = at < len(twice)
        cross[ok] = twice[at[ok]] == key[ok]
        wide.append(np.packbits(cross).tobytes())
        several.append(np.packbits(cross | np.unpackbits(np.frombuffer(own.as_py(), np.uint8), count=len(key)).astype(bool)).tobytes())
    return _rows(rows["bucket"].to_pylist(), rows["shard"].to_pylist(), [0] * len(keys), [len(k).to_bytes(4, "little") for k in keys], several, wide)


def _spans(part: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rising window positions joined to (text, first byte, end) of the bytes they cover."""
    if not len(at):
        return part, at, at
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(part) != 0)) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(at)])) - 1
    return part[first], at[first], at[last] + LEAST


def _find_within(n_buckets: int):
    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        shard = Shard(rows)
        number = rows["shard"][0].as_py()
        at, part, mark = shard.windows()
        told = flattened(told)
        replies = sorted(zip(told["bucket"].to_pylist(), *(told[c].to_pylist() for c in "abc"), strict=True))
        shared, cross = (
            np.concatenate([np.unpackbits(np.frombuffer(r[k], np.uint8), count=int.from_bytes(r[1], "little")).astype(bool) for r in replies] or [np.empty(0, bool)])
            for k in (2, 3)
        )
        several = np.empty(0, bool)
        if len(mark):
            # windows under one mark without a break are a run; a mark of one run has no repeat here
            turn = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (mark[1:] != mark[:-1]) | (np.diff(part) != 0))))
            _, place = np.unique(mark[turn], return_inverse=True)
            place = np.repeat(place, np.diff(np.append(turn, len(mark))))
            many = np.bincount(place[turn]) > 1
            use = shared[place]
            at, part, mark, place = at[use], part[use], mark[use], place[use]
            cross, several = cross[place], many[place]
        every = (at, part)
        at, part = at[several], part[several]
        found = np.zeros(len(at), bool)
        # stretches of text under shared marks, in arrays of at most ARRAY_CELLS or one stretch
        cut = np.flatnonzero((np.diff(at) > LEAST) | (np.diff(part) != 0)) + 1
        edge = np.concatenate(([0], cut, [len(at)])) if len(at) else np.array([0])
        a, arrays = 0, 0
        while a < len(edge) - 1:
            z, size = a, 0
            while z < len(edge) - 1 and (z == a or size < ARRAY_CELLS):
                size += int(at[edge[z + 1] - 1] - at[edge[z]]) + LEAST + 1
                z += 1
            first, last = edge[a:z], edge[a + 1 : z + 1] - 1
            length = at[last] + LEAST - at[first] + 1
            offset = np.concatenate(([0], np.cumsum(length)))
            piece = np.zeros(int(offset[-1]), np.uint8)
            doc = np.full(len(piece), LAST_ID, np.int64)
            for o, n, s, f in zip(offset.tolist(), (length - 1).tolist(), at[first].tolist(), first.tolist()):
                piece[o : o + n] = shard.text[s : s + n]
                doc[o : o + n] = shard.owner[part[f]]
            inside = slice(int(edge[a]), int(edge[z]))
            here = at[inside] + np.repeat(offset[:-1] - at[first], np.diff(edge[a : z + 1]))
            valid = np.zeros(len(piece), bool)
            valid[here] = True
            least = least_by_window(piece, valid, doc)
            found[inside] = least[here] < doc[here]
            a, arrays = z, arrays + 1
        repeat = np.zeros(len(every[0]), bool)
        repeat[np.flatnonzero(several)[found]] = True
        (at, part), found = every, repeat
        out_part, first, end = _spans(part[found], at[found])
        base = shard.start[out_part] if len(out_part) else out_part
        tables = [_rows([number % n_buckets], [number], [1], [out_part.astype(np.int64).tobytes()], [(first - base).astype(np.int64).tobytes()], [(end - base).astype(np.int64).tobytes()])]
        left = ~found & (cross | (arrays > 1))
        at, part, mark = at[left], part[left], mark[left]
        if len(at):
            cut = np.flatnonzero((np.diff(at) != 1) | (mark[1:] != mark[:-1]) | (np.diff(part) != 0)) + 1
            first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(at)])) - 1
            by = np.argsort(mark[first], kind="stable")
            first, last = first[by], last[by]
            data = shard.text.tobytes()
            ends = np.searchsorted(mark[first], _bucket_cuts(n_buckets))
            edges = np.concatenate(([0], ends, [len(first)]))
            for b in range(n_buckets):
                f, z = first[edges[b] : edges[b + 1]], last[edges[b] : edges[b + 1]]
                if len(f):
                    text = b"".join([data[s:e] for s, e in zip(at[f].tolist(), (at[z] + LEAST).tolist(), strict=True)])
                    columns = (part[f].astype(np.int64), (at[f] - shard.start[part[f]]).astype(np.int64), (at[z] - at[f] + LEAST).astype(np.int64), shard.owner[part[f]])
                    tables.append(_rows([b], [number], [2], *([x.tobytes()] for x in columns), [text]))
        return pa.concat_tables(tables)

    return run


def _merge(rows: pa.Table) -> pa.Table:
    """Spans (kind 1) as they are; for runs of windows (kind 2), the spans that a smaller document
    of any shard has too."""
    kinds = np.array(rows["kind"].to_pylist())
    out = [rows.filter(pa.array(kinds == 1))]
    runs = rows.filter(pa.array(kinds == 2)).to_pylist()
    if not runs:
        return out[0]
    ints = lambda r, c: np.frombuffer(r[c], np.int64)
    lengths = [ints(r, "c") for r in runs]
    texts: list[bytes] = []
    for r, n in zip(runs, lengths, strict=True):
        end = np.cumsum(n).tolist()
        texts += [r["e"][a:b] for a, b in zip([0, *end[:-1]], end, strict=True)]
    digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, texts)), [("hi", ">u8"), ("lo", ">u8")])
    docs = np.concatenate([ints(r, "d") for r in runs])
    every, first = np.unique(digest, return_index=True)
    where = np.searchsorted(every, digest)  # each run's text among the distinct ones
    owner = np.full(len(every), LAST_ID, np.int64)
    np.minimum.at(owner, where, docs)
    pieces = [texts[i] for i in first.tolist()]
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    start = np.concatenate(([0], np.cumsum(size + 1)))
    least = np.empty(int(start[-1]), np.int64)
    heads = np.frombuffer(b"".join(p[:LEAST] for p in pieces), np.uint8)
    mark = marks(heads)[::LEAST]
    order = np.argsort(mark, kind="stable")
    mark = mark[order]
    cuts = np.append(np.flatnonzero(np.concatenate(([True], mark[1:] != mark[:-1]))), len(order))
    sizes = np.diff(cuts)
    alone = order[cuts[:-1][sizes == 1]]  # the only run under its mark: its owner is the smallest
    for i in alone.tolist():
        least[start[i] : start[i] + size[i]] = owner[i]
    pairs = np.flatnonzero(sizes > 1)
    group = 0
    while group < len(pairs):  # whole groups of one mark, in arrays of some ARRAY_CELLS
        until, cells, chosen_groups = group, 0, []
        while until < len(pairs) and (until == group or cells < ARRAY_CELLS):
            members = order[cuts[pairs[until]] : cuts[pairs[until] + 1]]
            chosen_groups.append(members)
            cells += int(size[members].sum()) + len(members)
            until += 1
        chosen = np.concatenate(chosen_groups)
        text = np.frombuffer(b"".join(pieces[i] + b"\0" for i in chosen.tolist()), np.uint8)
        doc = np.repeat(owner[chosen], size[chosen] + 1)
        edge = np.concatenate(([0], np.cumsum(size[chosen] + 1)))
        valid = np.arange(len(text)) + LEAST < np.repeat(edge[1:], size[chosen] + 1)
        smallest = least_by_window(text, valid, doc)
        for i, s, n in zip(chosen.tolist(), edge[:-1].tolist(), size[chosen].tolist()):
            least[start[i] : start[i] + n] = smallest[s : s + n]
        group = until
    a = 0
    for r, n in zip(runs, lengths, strict=True):
        which = where[a : a + len(n)]
        a += len(n)
        windows = n - LEAST + 1
        offset = np.concatenate(([0], np.cumsum(windows)))
        step = np.arange(int(offset[-1])) - np.repeat(offset[:-1], windows)
        found = least[np.repeat(start[which], windows) + step] < np.repeat(ints(r, "d"), windows)
        part, at = np.repeat(ints(r, "a"), windows)[found], (np.repeat(ints(r, "b"), windows) + step)[found]
        by = np.lexsort((at, part))
        part, begin, end = _spans(part[by], at[by])
        out.append(_rows([r["bucket"]], [r["shard"]], [1], [part.tobytes()], [begin.tobytes()], [end.tobytes()]))
    return pa.concat_tables(out)


def _cut_out(rows: pa.Table, told: pa.Table) -> pa.Table:
    """Each row with what is left of its text."""
    told = flattened(told)
    shard = Shard(rows)
    part, begin, end = (np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in told[c]] or [np.empty(0, np.int64)]) for c in "abc")
    by = np.lexsort((begin, part))
    begin, end, part = begin[by], end[by], part[by]
    first = np.searchsorted(part, np.arange(len(shard.distinct) + 1))
    left: list[tuple[int, int, bytes]] = []
    for k, text in enumerate(shard.distinct):
        pieces, done, gone, spans = [], 0, 0, 0
        last = -1
        for b, e in zip(begin[first[k] : first[k + 1]].tolist(), end[first[k] : first[k + 1]].tolist()):
            if b > last:
                pieces.append(text[done:b])
                spans += 1
                gone += e - b
                done = last = e
            elif e > last:
                gone += e - last
                done = last = e
        pieces.append(text[done:])
        left.append((gone, spans, b"".join(pieces)))
    out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept")}
    for i, text in zip(shard.ids, shard.texts, strict=True):
        k = shard.number[text]
        gone, spans, kept = left[k]
        if i != shard.owner[k] and len(text) >= LEAST:  # all of it starts in a smaller document
            gone, spans, kept = len(text), 1, b""
        for c, v in zip(out, (len(text), gone, spans, kept), strict=True):
            out[c].append(v)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.table({"row": rows["row"], **{c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds, strict=True)}, "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in out["kept"]])})


def dedup_strings(docs: DataFrame, keep_bytes: bool = True) -> DataFrame:
    """``row`` (a struct of all columns but text), n_bytes, n_removed, n_spans, kept (bytes; only
    with ``keep_bytes``) and kept_sha256 per row.

    Texts are UTF-8 bytes, a null text is empty; strings are judged on the input, so overlapping
    repeats all go.  Rows with one doc_id do not remove from each other; a null doc_id comes after
    all others.  An empty table gives no rows."""
    n = shard_count(text_bytes(docs), SHARD_BYTES)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    base = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
        F.struct(*rest).alias("row"),
    ).withColumn("shard", shard_of(n, "id", "text"))
    by_shard = base.groupBy("shard")
    buckets = shard_count(n, MARKS_OF), shard_count(n, RUNS_OF)
    answers = through_buckets(by_shard.applyInArrow, _send_marks(buckets[0]), _answer_marks, _KINDS, buckets[0])
    within = by_shard.cogroup(answers.groupBy("shard"))
    spans = through_buckets(within.applyInArrow, _find_within(buckets[1]), _merge, _KINDS, buckets[1])
    row = base.schema["row"].dataType.simpleString()
    kinds = f"row {row}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"

    def last(rows: pa.Table, told: pa.Table) -> pa.Table:
        done = _cut_out(rows, told)
        return done if keep_bytes else done.set_column(4, "kept", pa.nulls(len(done), pa.binary()))

    return by_shard.cogroup(spans.groupBy("shard")).applyInArrow(last, kinds)
