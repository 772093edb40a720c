"""Statistics of word spans over measured frames, without a row for each frame of each span.

Frames (path, frame, f0, db) stand ``STEP_MS`` apart; every frame of a sound has a row, with null where
nothing was measured.  They are held in blocks of ``BLOCK``.  A span's sums and counts are the
difference of two running sums, each found in the block at one end of the span; its extremes come from
these two blocks and from two overlapping ranges of a sparse table over the blocks between.  Peaks, whose
threshold depends on the span's mean, are counted in the blocks that the span touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup as M

STEP_MS, BLOCK = 10, 64
#: A span shorter than this, or with fewer values, has no rate; a peak is at most this
#: far below the mean.
LEAST_MS, LEAST_VALUES, BELOW_MEAN_DB = 50, 3, 5.0
_MEASURES = ["f0", "db"]


def _sum(xs: Column, f: str) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + F.coalesce(x[f], F.lit(0.0)))


def _count(xs: Column, f: str) -> Column:
    return F.size(F.filter(xs, lambda x: x[f].isNotNull()))


def _low(xs: Column, f: str) -> Column:
    return F.array_min(F.transform(xs, lambda x: x[f]))


def _high(xs: Column, f: str) -> Column:
    return F.array_max(F.transform(xs, lambda x: x[f]))


def blocks(frames: DataFrame) -> DataFrame:
    """(path, block, xs, sums and counts before the block, its extremes, peaks): xs are its frames in
    order, peaks those whose db passes both neighbours that have one, with the neighbours' frames."""
    each = frames.select("path", F.col("frame").cast("int").alias("frame"), *(M.finite(F.col(f).cast("double")).alias(f) for f in _MEASURES))
    xs = each.groupBy("path", F.floor(F.col("frame") / BLOCK).cast("int").alias("block")).agg(F.array_sort(F.collect_list(F.struct("frame", "f0", "db"))).alias("xs"))
    order = Window.partitionBy("path").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    loud = F.filter("xs", lambda x: x["db"].isNotNull())
    out = xs.withColumn("loud", F.transform(loud, lambda x: F.struct(x["frame"], x["db"])))
    out = out.withColumn("head", F.get("loud", F.lit(0))).withColumn("tail", F.element_at(F.when(F.size("loud") > 0, F.col("loud")), -1))
    for f in _MEASURES:
        out = out.withColumn(f"{f}_low", _low(F.col("xs"), f)).withColumn(f"{f}_high", _high(F.col("xs"), f))
        out = out.withColumn(f"{f}_sum", F.coalesce(F.sum(_sum(F.col("xs"), f)).over(before), F.lit(0.0))).withColumn(f"{f}_n", F.coalesce(F.sum(_count(F.col("xs"), f)).over(before), F.lit(0)))
    out = out.withColumn("left", F.last("tail", ignorenulls=True).over(before)).withColumn("right", F.expr("lead(head) IGNORE NULLS OVER (PARTITION BY path ORDER BY block)"))
    around = F.array_compact(F.concat(F.array("left"), "loud", F.array("right")))
    peak = lambda x, i: F.struct(
        x["frame"].alias("frame"), x["db"].alias("db"), F.get(F.col("around"), i - 1)["frame"].alias("prev"), F.get(F.col("around"), i + 1)["frame"].alias("next"),
        ((x["db"] > F.get(F.col("around"), i - 1)["db"]) & (x["db"] > F.get(F.col("around"), i + 1)["db"])).alias("top"),
    )
    inside = lambda x: F.coalesce(x["top"], F.lit(False)) & (F.floor(x["frame"] / BLOCK) == F.col("block"))
    out = out.withColumn("around", around).withColumn("peaks", F.filter(F.transform("around", peak), inside))
    return out.drop("loud", "head", "tail", "left", "right", "around")


def _sparse(held: DataFrame, longest: int) -> DataFrame:
    """(path, level, block, extremes) of the 2**level blocks from ``block`` on, up to ``longest``."""
    order = Window.partitionBy("path").orderBy("block")
    names = [f"{f}_{side}" for f in _MEASURES for side in ("low", "high")]
    level = held.select("path", "block", *names, F.lit(True).alias("whole"))
    parts, k = [level.withColumn("level", F.lit(0))], 0
    while 2 << k <= longest:
        ahead = lambda c: F.lead(c, 1 << k).over(order)  # noqa: B023, E731
        wider = [(F.least if c.endswith("low") else F.greatest)(F.col(c), ahead(c)).alias(c) for c in names]
        level = level.select("path", "block", *wider, (F.col("whole") & F.coalesce(ahead("whole"), F.lit(False))).alias("whole"))
        k += 1
        parts.append(level.withColumn("level", F.lit(k)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("whole").drop("whole")


def span_statistics(spans: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """(path, keys, f0_mean, f0_low, f0_high, intensity_mean, intensity_range, speech_rate) of spans
    (path, keys, start_ms, end_ms): over the frames from start to before end, cut to the sound.

    Null, NaN and infinite values count as not measured; a span without frames, or of an unknown path, has nulls only.  Rates
    are peaks a second, null below ``LEAST_MS`` or ``LEAST_VALUES`` values.  ``keys`` tell a path's
    spans apart."""
    id_ = ["path", *keys]
    held = blocks(frames)
    sizes = frames.groupBy("path").agg((F.max("frame") + 1).cast("int").alias("n_frames"))
    cut = spans.select(*id_, "start_ms", "end_ms").join(sizes, "path", "left")
    first, last = F.ceil(F.greatest("start_ms", F.lit(0)) / STEP_MS), F.least(F.ceil(F.col("end_ms") / STEP_MS), F.col("n_frames")) - 1
    cut = cut.select(*id_, "start_ms", "end_ms", "n_frames", first.cast("int").alias("a"), last.cast("int").alias("z"))
    some = cut.where("a <= z").select("*", F.floor(F.col("a") / BLOCK).cast("int").alias("ba"), F.floor(F.col("z") / BLOCK).cast("int").alias("bz"))
    ends = held.select("path", F.col("block"), "xs", *(f"{f}_{s}" for f in _MEASURES for s in ("sum", "n")))
    side = lambda name, at: ends.select("path", F.col("block").alias(at), F.struct(*ends.columns[2:]).alias(name))
    both = some.join(side("from", "ba"), ["path", "ba"]).join(side("to", "bz"), ["path", "bz"])
    r, s = F.col("a") - F.col("ba") * BLOCK, F.col("z") - F.col("bz") * BLOCK
    both = both.withColumn("skipped", F.slice("from.xs", F.lit(1), r)).withColumn("reached", F.slice("to.xs", F.lit(1), s + 1))
    head = F.when(F.col("ba") == F.col("bz"), F.slice("from.xs", r + 1, F.col("z") - F.col("a") + 1)).otherwise(F.slice("from.xs", r + 1, F.lit(BLOCK)))
    both = both.withColumn("head", head).withColumn("rear", F.when(F.col("ba") == F.col("bz"), F.slice("from.xs", r + 1, F.col("z") - F.col("a") + 1)).otherwise(F.col("reached")))
    numbers = []
    for f in _MEASURES:
        numbers.append((F.col(f"to.{f}_n") + _count(F.col("reached"), f) - F.col(f"from.{f}_n") - _count(F.col("skipped"), f)).alias(f"{f}_n"))
        numbers.append((F.col(f"to.{f}_sum") + _sum(F.col("reached"), f) - F.col(f"from.{f}_sum") - _sum(F.col("skipped"), f)).alias(f"{f}_sum"))
        numbers.append(F.least(_low(F.col("head"), f), _low(F.col("rear"), f)).alias(f"{f}_low"))
        numbers.append(F.greatest(_high(F.col("head"), f), _high(F.col("rear"), f)).alias(f"{f}_high"))
    near = both.select(*id_, "a", "z", "ba", "bz", "start_ms", "end_ms", "n_frames", *numbers)
    between = F.col("bz") - F.col("ba") - 1
    near = near.withColumn("level", F.when(between > 0, F.floor(F.log2(between)).cast("int")))
    longest = near.agg(F.max(between)).first()[0] or 0
    if longest > 0:
        table = _sparse(held, longest)
        names = [f"{f}_{x}" for f in _MEASURES for x in ("low", "high")]
        range_ = lambda name: table.select("path", "level", F.col("block").alias(name), F.struct(*names).alias(f"in_{name}"))
        near = near.withColumn("one", F.col("ba") + 1).withColumn("two", F.col("bz") - F.expr("shiftleft(1, level)"))
        near = near.join(range_("one"), ["path", "level", "one"], "left").join(range_("two"), ["path", "level", "two"], "left")
        near = near.withColumns({c: (F.least if c.endswith("low") else F.greatest)(F.col(c), F.col(f"in_one.{c}"), F.col(f"in_two.{c}")) for c in names}).drop("one", "two", "in_one", "in_two")
    mean = lambda f: F.when(F.col(f"{f}_n") > 0, F.col(f"{f}_sum") / F.col(f"{f}_n"))
    near = near.withColumn("f0_mean", mean("f0")).withColumn("intensity_mean", mean("db"))
    length = F.least(F.col("end_ms"), F.col("n_frames") * STEP_MS) - F.greatest("start_ms", F.lit(0))
    near = near.withColumn("length", length)
    rated = near.where((F.col("length") >= LEAST_MS) & (F.col("db_n") >= LEAST_VALUES))
    touched = rated.select(*id_, "a", "z", "intensity_mean", "length", F.explode(F.sequence("ba", "bz")).alias("block")).join(held.select("path", "block", "peaks"), ["path", "block"])
    counted = lambda p: (p["frame"] > F.col("a")) & (p["prev"] >= F.col("a")) & (p["next"] <= F.col("z")) & (p["db"] > F.col("intensity_mean") - BELOW_MEAN_DB)
    rates = touched.groupBy(*id_, "length").agg(F.sum(F.size(F.filter("peaks", counted))).alias("n")).select(*id_, (F.col("n") * 1000 / F.col("length")).alias("speech_rate"))
    done = near.join(rates, id_, "left").select(
        *id_, "f0_mean", "f0_low", "f0_high", "intensity_mean", (F.col("db_high") - F.col("db_low")).alias("intensity_range"), "speech_rate"
    )
    return spans.select(*id_).join(done, id_, "left")
