"""Connected components of an edge table, without collecting links to the driver.

Alternating large-star and small-star rounds: every node first links its larger neighbours, then
its smaller ones, to the smallest it knows, until each component is a star around its smallest
node.  Neighbourhoods are only ever reduced to a minimum (partial sums first) and joined back, so
a node with very many links costs no more memory than another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, fresh_path


def _written(df: DataFrame, old: str | None) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = fresh_path(spark, "edges")
    df.write.option("compression", "zstd").parquet(path)
    if old:
        drop_path(spark, old)
    return spark.read.schema(df.schema).parquet(path), path


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (u, v) with u > v."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        pairs = edges.join(least, "u")
        moved = pairs.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (long columns u and v): root is the smallest node
    of its component.  Links to itself and repeated links do no harm; no edges give no rows."""
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    now, path = _written(ordered, None)
    was = None
    while True:
        now, path = _written(_star(_star(now, True), False), path)
        # a fixed point: the table's size and an order-free digest stay
        mark = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if mark == was:
            break
        was = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
