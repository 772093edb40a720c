"""Centroid clustering of integer vectors by Shallot search.

Every vector remembers its centroid, the second-nearest one, an upper bound of the distance to the
first and a lower bound of the distance to all others.  Centroids move, the bounds follow, and most
vectors stay where they are without a distance.  Others measure the two centroids they remember,
start at the closer one and walk along its neighbours, nearest first, while a neighbour can still
lie within the ball that holds every centroid as close as the second best so far; each better second
best shrinks the ball.  Bounds are floating point and rounded outwards; centroids that survive them
are compared by squared distance in integers, so results are exact.

A round reads the vectors with their bounds, writes them anew in the shared folder, and sums each
task's clusters before anything is shuffled: what meets is a row for each task and centroid.  No
vector is shuffled, so copies of one vector cost nothing extra.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, fresh_path

CENTROIDS, ROUNDS, DIMENSIONS, SCALE, SEED = 40, 5, 64, 256, "2:"
#: Components up to this size have squared distances that fit 64 bits; larger ones are compared as
#: integers without a limit, which is slow.
FIT = 1 << 27
#: Relative slack by which bounds are rounded outwards.
_SLACK = 1e-9
_STATE = "vec_id long, v binary, a int, b int, u double, l double"
_KINDS = {"h": np.dtype("<i2"), "i": np.dtype("<i4"), "d": np.dtype("<f8")}
_VALUE = pa.decimal128(38, 0)


def _integers(x: np.ndarray, kind: str) -> np.ndarray:
    """floor(SCALE * x) for 64-bit floats; Python's integers where they may pass 64 bits."""
    if kind != "d":
        return np.floor(SCALE * x).astype(np.int64)
    return np.array([[int(v) * SCALE if abs(v) >= 2.0**53 else int(np.floor(SCALE * v)) for v in row] for row in x], object).reshape(x.shape)


def _squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = v - c
    return np.einsum("ij,ij->i", d, d) if d.dtype != object else (d * d).sum(axis=1)


def _root(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64))


class Centroids:
    """Centroids, each with its neighbours by rising distance."""

    def __init__(self, rows: np.ndarray, before: Centroids | None = None):
        self.rows, k = rows, len(rows)
        gaps = np.array([_root(_squared(rows, r)) for r in rows]).reshape(k, k)
        np.fill_diagonal(gaps, -1.0)
        self.order = np.argsort(gaps, axis=1, kind="stable")[:, 1:]
        self.gap = np.take_along_axis(gaps, self.order, axis=1) * (1 - _SLACK)
        self.half = self.gap[:, 0] / 2 if k > 1 else np.full(k, np.inf)
        moved = np.zeros(k) if before is None else _root(_squared(rows, before.rows)) * (1 + _SLACK)
        self.moved = moved
        # the farthest that any other centroid has moved
        self.others = np.array([np.delete(moved, c).max(initial=0.0) for c in range(k)])

    def assign(self, v: np.ndarray, a: np.ndarray, b: np.ndarray, u: np.ndarray, low: np.ndarray) -> None:
        """Bring assignment, second-nearest and bounds of ``v`` up to date, in place."""
        if len(self.rows) == 1:
            return
        u += self.moved[a]
        low -= self.others[a]
        todo = np.flatnonzero(~(u < np.maximum(low, self.half[a])))
        if len(todo) == 0:
            return
        first = _squared(v[todo], self.rows[a[todo]])
        u[todo] = _root(first) * (1 + _SLACK)
        open_ = ~(u[todo] < np.maximum(low[todo], self.half[a[todo]]))
        todo, first = todo[open_], first[open_]
        if len(todo) == 0:
            return
        x = v[todo]
        second = _squared(x, self.rows[b[todo]])
        swap = (second < first) | ((second == first) & (b[todo] < a[todo]))
        best, rest = np.where(swap, b[todo], a[todo]), np.where(swap, a[todo], b[todo])
        d_best, d_rest = np.where(swap, second, first), np.where(swap, first, second)
        start, known, reach = best.copy(), rest.copy(), _root(d_best) * (1 + _SLACK)
        live = np.arange(len(todo))
        for step in range(self.order.shape[1]):
            at = start[live]
            live = live[self.gap[at, step] <= reach[live] + _root(d_rest[live]) * (1 + _SLACK)]
            if len(live) == 0:
                break
            found = self.order[start[live], step]
            new = found != known[live]
            rows, found = live[new], found[new]
            d = _squared(x[rows], self.rows[found])
            better = (d < d_best[rows]) | ((d == d_best[rows]) & (found < best[rows]))
            to = rows[better]
            rest[to], d_rest[to] = best[to], d_best[to]
            best[to], d_best[to] = found[better], d[better]
            nearer = ~better & ((d < d_rest[rows]) | ((d == d_rest[rows]) & (found < rest[rows])))
            to = rows[nearer]
            rest[to], d_rest[to] = found[nearer], d[nearer]
        a[todo], b[todo] = best, rest
        u[todo], low[todo] = _root(d_best) * (1 + _SLACK), _root(d_rest) * (1 - _SLACK)


def _rows_of(batch: pa.RecordBatch, kind: str) -> np.ndarray:
    flat = np.frombuffer(b"".join(batch.column("v").to_pylist()), _KINDS[kind]).reshape(batch.num_rows, -1)
    return flat.astype(np.int64) if kind != "d" else _integers(flat, kind)


def _packed(ids: pa.Array, v: list[bytes] | pa.Array, a: np.ndarray, b: np.ndarray, u: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
    cells = v if isinstance(v, pa.Array) else pa.array(v, pa.binary())
    return pa.RecordBatch.from_arrays([ids, cells, pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(u), pa.array(low)], ["vec_id", "v", "a", "b", "u", "l"])


def _first_round(now: Centroids, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            raw = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            v = _integers(raw, kind)
            a, b = np.zeros(n, np.int64), np.full(n, min(1, len(now.rows) - 1))
            u, low = np.full(n, np.inf), np.zeros(n)
            now.assign(v, a, b, u, low)
            cells = [r.tobytes() for r in (raw if kind == "d" else v).astype(_KINDS[kind])]
            yield _packed(batch.column("vec_id"), cells, a, b, u, low)

    return run


def _next_round(now: Centroids, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _rows_of(batch, kind)
            a, b = (batch.column(c).to_numpy().astype(np.int64) for c in "ab")
            u, low = (batch.column(c).to_numpy().copy() for c in "ul")
            now.assign(v, a, b, u, low)
            yield _packed(batch.column("vec_id"), batch.column("v"), a, b, u, low)

    return run


def _sums(k: int, dims: int, kind: str):
    """(cluster, n, s) of each task: how many vectors a cluster has and the sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(k, np.int64), np.zeros((k, dims), object)
        for batch in batches:
            v, a = _rows_of(batch, kind), batch.column("a").to_numpy()
            order = np.argsort(a, kind="stable")
            found, at = np.unique(a[order], return_index=True)
            if len(found):
                s[found] += np.add.reduceat(v[order], at, axis=0).astype(object)
                n += np.bincount(a, minlength=k)
        held = np.flatnonzero(n)
        cells = pa.array([[Decimal(int(x)) for x in s[c]] for c in held], pa.list_(_VALUE))
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(n[held]), cells], ["cluster", "n", "s"])

    return run


def _distances(now: Centroids, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _squared(_rows_of(batch, kind), now.rows[batch.column("a").to_numpy()])
            cells = pa.array(d) if kind != "d" else pa.array([int(x) if x < 1 << 63 else None for x in d], pa.int64())
            second = pa.nulls(batch.num_rows, pa.int32()) if len(now.rows) == 1 else batch.column("b")
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("a"), cells, second], ["vec_id", "cluster", "distance", "second"])

    return run


def vectors(rows: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, x) of the rows whose ``embedding`` has ``dimensions`` components, none null or
    non-finite."""
    x = F.col("embedding").cast("array<double>")
    sound = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where((F.size("x") == dimensions) & F.coalesce(sound, F.lit(False)))


def clustered(rows: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> DataFrame:
    """A row for each vector of ``vectors(rows)``: vec_id, cluster, distance (squared), second (the
    second-nearest centroid that the search remembers), cluster_inertia, inertia, centroid_sha256.

    Centroids start as the ``k`` vectors with the smallest SHA-256 of ``2:<vec_id>``; vectors that
    share an id follow each other by components, those without one come last.  With fewer than ``k``
    vectors all are centroids; a table without any gives no rows.  Repeated rows count each.  Other
    columns stay behind.  Components above ``FIT`` are compared without a limit; a distance or sum
    that 64 bits cannot hold is then null, and sums of over 38 digits are refused."""
    spark = rows.sparkSession
    base = vectors(rows, dimensions)
    seed = F.sha2(F.concat(F.lit(SEED), F.col("vec_id").cast("string")), 256)
    first = base.select(seed.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    if not first:
        empty = "vec_id long, cluster int, distance long, second int, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], empty)
    largest = base.agg(F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x"))))).first()[0] * SCALE
    kind = "h" if largest < (1 << 15) - 1 else "i" if largest < FIT else "d"
    now = Centroids(_integers(np.array([r["x"] for r in first], np.float64), kind))
    path, n_centroids = None, len(now.rows)
    for step in range(rounds + 1):
        source = base if path is None else spark.read.schema(_STATE).parquet(path)
        made = fresh_path(spark, "cluster-round")
        source.mapInArrow((_first_round if path is None else _next_round)(now, kind), _STATE).write.option("compression", "zstd").parquet(made)
        if path is not None:
            drop_path(spark, path)
        path = made
        if step == rounds:
            break
        state = spark.read.schema(_STATE).parquet(path)
        parts = state.mapInArrow(_sums(n_centroids, dimensions, kind), "cluster int, n long, s array<decimal(38,0)>")
        totals = parts.select("cluster", "n", F.posexplode("s").alias("pos", "s")).groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        moved = now.rows.copy()
        for r in totals.toLocalIterator():  # k times dimensions numbers
            moved[r["cluster"], r["pos"]] = int(r["s"]) // r["n"]
        now = Centroids(moved, now)
    state = spark.read.schema(_STATE).parquet(path)
    final = state.mapInArrow(_distances(now, kind), "vec_id long, cluster int, distance long, second int")
    done = fresh_path(spark, "clusters")
    final.write.option("compression", "zstd").parquet(done)
    drop_path(spark, path)
    out = spark.read.schema(final.schema).parquet(done)
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    each = out.groupBy("cluster").agg(F.when(F.count("distance") == F.count("*"), total).alias("s")).collect()  # k rows
    inertia = None if any(r["s"] is None for r in each) else _fits(sum(r["s"] for r in each))
    sha = [",".join(str(int(x)) for x in row) for row in now.rows]
    about = spark.createDataFrame([(r["cluster"], _fits(r["s"]), inertia, sha[r["cluster"]]) for r in each], "cluster int, cluster_inertia long, inertia long, c string")
    about = about.select("cluster", "cluster_inertia", "inertia", F.sha2(F.col("c"), 256).alias("centroid_sha256"))
    return out.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "second", "cluster_inertia", "inertia", "centroid_sha256")


def _fits(total) -> int | None:
    return None if total is None or int(total) >= 1 << 63 else int(total)
