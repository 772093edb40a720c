"""Train, validation and test splits of exact sizes."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _sizes(n: int, train: float, val: float, test: float) -> tuple[int, int]:
    if abs(train + val + test - 1.0) > 1e-6:
        raise ValueError(f"shares must sum to 1, got {train + val + test}")
    return int(n * train), int(n * val)


#: Rows that ``exact_split`` takes at most.
MOST_ROWS = 5_000_000


def exact_split(rows: DataFrame, order: str, train: float = 0.8, val: float = 0.1, test: float = 0.1, seed: int = 42) -> DataFrame:
    """``rows`` with ``split``, by a Mersenne shuffle of their positions under ``order``.  The
    permutation is made on the driver, so tables above ``MOST_ROWS`` are refused; ``hashed_split``
    takes those."""
    n = rows.count()
    if n > MOST_ROWS:
        raise ValueError(f"{n} rows are too many for an exact split, use hashed_split")
    a, b = _sizes(n, train, val, test)
    places = list(range(n))
    random.Random(seed).shuffle(places)
    side = ["train" if k < a else "val" if k < a + b else "test" for k in range(n)]
    table = rows.sparkSession.createDataFrame(list(zip(places, side, strict=True)), "__place long, split string")
    numbered = rows.withColumn("__place", (F.row_number().over(Window.orderBy(order)) - 1).cast("long"))
    return numbered.join(table, "__place").drop("__place")


def hashed_split(rows: DataFrame, key: str, train: float = 0.8, val: float = 0.1, test: float = 0.1, seed: int = 42) -> DataFrame:
    """``rows`` with ``split`` of the same exact sizes, by the rank of a seeded hash of ``key``.

    Keys are counted by the first 16 bits of their hash.  Whole buckets lie on one side; only the rows
    of the two buckets through which a bound runs are ranked, so no more than these are shuffled.
    ``rows`` is read several times: write it first if it is dear."""
    hashed = rows.withColumn("__h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))))
    hashed = hashed.withColumn("__b", F.substring("__h", 1, 4))
    sizes = dict(hashed.groupBy("__b").count().collect())  # 65,536 rows at most, and one for null
    n = sum(sizes.values())
    a, b = _sizes(n, train, val, test)
    side = lambda rank: F.when(rank < a, "train").when(rank < a + b, "val").otherwise("test")
    bucket, cut, first, before = F.coalesce("__b", F.lit("")), {}, {}, 0
    for name in sorted(sizes, key=lambda x: x or ""):
        if any(before < bound < before + sizes[name] for bound in (a, a + b)):
            cut[name or ""] = before
        for part, bound in (("val", a), ("test", a + b)):
            if before >= bound:
                first.setdefault(part, name or "")
        before += sizes[name]
    whole = F.lit("train")
    for part in ("val", "test"):
        if part in first:
            whole = F.when(bucket >= first[part], part).otherwise(whole)
    if not cut:
        return hashed.withColumn("split", whole).drop("__h", "__b")
    within = Window.partitionBy("__b").orderBy("__h", key)
    offset = F.try_element_at(F.create_map(*[F.lit(x) for item in cut.items() for x in item]), bucket)
    ranked = hashed.where(bucket.isin(list(cut))).withColumn("split", side(offset + F.row_number().over(within) - 1))
    return hashed.where(~bucket.isin(list(cut))).withColumn("split", whole).unionByName(ranked).drop("__h", "__b")
