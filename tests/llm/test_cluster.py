"""Centroid clustering against brute force in whole numbers."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL, same_rows

from cadenza.llm import cluster
from cadenza.llm.queries import ORACLE_SQL, QUERIES

KINDS = "vec_id long, embedding array<float>, cluster string, label int"


def brute(rows, k, rounds, dims):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid digest) by the definition."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return Counter()
    digest = lambda i: ("~" if i is None else hashlib.sha256(f"2:{i}".encode()).hexdigest())
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    square = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    nearest = lambda v: min((square(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [nearest(v) for _, v in kept]
    sums = Counter()
    for d, j in found:
        sums[j] += d
    fit = lambda x: x if x < 1 << 63 else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    inertia = sum(sums.values())
    return Counter((i, j, fit(d), fit(sums[j]), fit(inertia), sha[j]) for (i, _), (d, j) in zip(kept, found, strict=True))


def got(df):
    return Counter((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


def made(n, dims, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(7, dims)) * spread
    rows = [(int(i), [float(np.float32(x)) for x in middle[i % 7] + rng.normal(size=dims) * 0.3 * spread]) for i in range(n)]
    rows += [(int(n + i), list(rows[3][1])) for i in range(n // 3)]  # a third of the rows are one vector
    rows += [(5, list(rows[5][1])), (None, list(rows[6][1])), (n * 2, None), (n * 2 + 1, []), (n * 2 + 2, [0.0] * (dims - 1)), (n * 2 + 3, [None] + [0.0] * (dims - 1))]
    rows += [(n * 2 + 4, [float("nan")] + [0.0] * (dims - 1)), (n * 2 + 5, [float("inf")] + [0.0] * (dims - 1)), (n * 2 + 6, [0.0] * dims), (n * 2 + 7, [-0.001] * dims)]
    return rows


@pytest.mark.parametrize(("k", "rounds", "dims", "spread"), [(9, 5, 8, 1.0), (1, 2, 4, 1.0), (2, 3, 4, 1.0), (500, 2, 4, 1.0), (6, 3, 8, 900.0), (6, 2, 4, 1e9), (5, 0, 4, 1.0)])
def test_equals_brute_force(spark, k, rounds, dims, spread):
    rows = made(60, dims, k, spread)
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], KINDS).repartition(3)
    found = cluster.clustered(df, k, rounds, dims)
    assert found.columns == ["vec_id", "cluster", "distance", "second", "cluster_inertia", "inertia", "centroid_sha256"]
    assert got(found) == brute(rows, k, rounds, dims)


def test_ties_go_to_the_smaller_centroid(spark):
    # whole numbers on a small grid: very many equal distances
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) / 256 for x in rng.integers(-2, 3, 3)]) for i in range(300)]
    df = spark.createDataFrame([(i, v, None, None) for i, v in rows], KINDS).repartition(4)
    assert got(cluster.clustered(df, 25, 4, 3)) == brute(rows, 25, 4, 3)


def test_bounds_skip_most_distances(monkeypatch):
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(30, 16)) * 400
    v = (middle[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 16)) * 40).astype(np.int64)
    a, b, u, low = np.zeros(3000, np.int64), np.ones(3000, np.int64), np.full(3000, np.inf), np.zeros(3000)
    now, counted = cluster.Centroids(middle.astype(np.int64)), []
    real = cluster._squared
    monkeypatch.setattr(cluster, "_squared", lambda x, c: (counted.append(len(x)), real(x, c))[1])
    now.assign(v, a, b, u, low)
    first = sum(counted)
    assert first <= 3000 * 31  # nothing is known yet
    moved = cluster.Centroids(now.rows + rng.integers(-2, 3, now.rows.shape), now)
    counted.clear()
    moved.assign(v, a, b, u, low)
    assert sum(counted) < 0.1 * first
    want = ((v[:, None, :] - moved.rows[None]) ** 2).sum(-1)
    assert (want.argmin(1) == a).all()
    assert (np.sqrt(want.min(1)) <= u).all()
    others = want.copy()
    others[np.arange(3000), a] = np.iinfo(np.int64).max
    assert (low <= np.sqrt(others.min(1))).all()


def test_empty_table(spark):
    assert cluster.clustered(spark.createDataFrame([], KINDS)).count() == 0
    assert cluster.clustered(spark.createDataFrame([(1, [1.0], "a", 1)], KINDS)).count() == 0


def test_query_equals_its_sql(spark):
    same_rows(QUERIES["op12_clusters"](spark, SMALL), ORACLE_SQL["op12_clusters"], SMALL)
