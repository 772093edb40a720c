"""Evaluation: accuracy, per-class scores, calibration, pause matching, regression checks."""

from __future__ import annotations

import bisect
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper edges of the ten calibration bins as doubles on an even grid.
EDGES = [k * 0.1 for k in range(11)]
TOLERANCE_MS = 200
#: Metrics where more is better, and the one where less is.
HIGHER = ["emotion_accuracy", "pitch_accuracy", "pause_f1", "validity_rate"]
LOWER = ["confidence_ece"]
REGRESSION_TOLERANCE = 0.01


def confusion(predictions: DataFrame) -> DataFrame:
    """(truth, predicted, n) over rows with those two columns."""
    return predictions.groupBy("truth", "predicted").agg(F.count("*").alias("n"))


def labels(predictions: DataFrame) -> DataFrame:
    """All labels of either side."""
    both = predictions.select(F.col("truth").alias("label")).unionByName(predictions.select(F.col("predicted").alias("label")))
    return both.distinct()


def class_report(predictions: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(label, precision, recall, f1, support) from one confusion table; labels of ``wanted`` that do
    not occur get zeros."""
    table = confusion(predictions)
    sides = table.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit(True).alias("real")), F.struct(F.col("predicted").alias("label"), F.lit(False).alias("real")))).alias("s"), "truth", "predicted", "n")
    counted = sides.groupBy("s.label").agg(
        F.sum(F.when(F.col("s.real") & (F.col("truth") == F.col("predicted")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("s.real"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(~F.col("s.real"), F.col("n")).otherwise(0)).alias("claimed"),
    )
    if wanted is not None:
        counted = wanted.select("label").join(counted, "label", "left").na.fill(0)
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    out = counted.withColumn("precision", share(F.col("tp"), F.col("claimed"))).withColumn("recall", share(F.col("tp"), F.col("support")))
    return out.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("label", "precision", "recall", "f1", "support")


def macro(report: DataFrame) -> DataFrame:
    """One row: the means over classes."""
    return report.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(f"macro_{c}") for c in ("precision", "recall", "f1")))


def accuracy(correct: Column) -> Column:
    """Share of true values, 0 without rows."""
    return F.coalesce(F.avg(correct.cast("double")), F.lit(0.0))


def calibration(predictions: DataFrame) -> DataFrame:
    """(bin, n, mean_confidence, accuracy) over rows (confidence, correct); bins are half open, the
    last closed; what lies outside has a null bin."""
    c = F.col("confidence")
    bin_ = F.coalesce(*(F.when((c >= EDGES[k]) & ((c < EDGES[k + 1]) if k < 9 else (c <= EDGES[k + 1])) & ~F.isnan(c), k) for k in range(10)))
    return predictions.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def calibration_error(predictions: DataFrame) -> DataFrame:
    """One row: ece, bins weighted by their share of all rows; 0 without rows."""
    bins = calibration(predictions)
    inside = F.col("bin").isNotNull()
    gap = F.sum(F.when(inside, F.abs(F.col("accuracy") - F.col("mean_confidence")) * F.col("n")))
    return bins.agg(F.coalesce(F.try_divide(gap, F.sum("n")), F.lit(0.0)).alias("ece"))


def contour_pairs(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Labels of both sides (entry_id, pos, label) by rank of pos; the longer side is cut."""
    from pyspark.sql import Window

    order = Window.partitionBy("entry_id").orderBy("pos")
    side = lambda df, name: df.select("entry_id", F.row_number().over(order).alias("k"), F.col("label").alias(name))
    return side(truth, "truth").join(side(predicted, "predicted"), ["entry_id", "k"])


def matched(predicted: list[int], truth: list[int], tolerance: int = TOLERANCE_MS) -> int:
    """How many predicted pauses, in order, find an unmatched true one within ``tolerance``; each
    takes the nearest, the earlier of equals.  Free truths wait by length, each length's in order, and
    lengths that have none left are leapt over, so a step costs a binary search, neither a walk over
    all nor a move of those behind."""
    free: dict[int, deque[int]] = {}
    for k, t in enumerate(truth):
        free.setdefault(t, deque()).append(k)
    lengths = sorted(free)
    waiting = [free[t] for t in lengths]
    # where the next length with free truths may lie, up and down; both ends stand for none
    up, down = list(range(len(lengths) + 1)), list(range(len(lengths) + 1))
    found = 0
    for p in predicted:
        at = bisect.bisect_left(lengths, p)
        high, low = _leapt(up, at), _leapt(down, at) - 1
        best = high if high < len(lengths) else None
        if low >= 0 and (best is None or (p - lengths[low], waiting[low][0]) < (lengths[high] - p, waiting[high][0])):
            best = low
        if best is not None and abs(lengths[best] - p) <= tolerance:
            waiting[best].popleft()
            found += 1
            if not waiting[best]:
                up[best], down[best + 1] = best + 1, best
    return found


def _leapt(to: list[int], at: int) -> int:
    """Where the links from ``at`` end; those on the way are shortened."""
    while to[at] != at:
        to[at] = to[to[at]]
        at = to[at]
    return at


def pause_scores(pauses: DataFrame, key: str) -> DataFrame:
    """(key, tp, n_predicted, n_truth, f1) of rows (key, side 'p' or 't', ord, ms).

    The match is greedy in order, so the pauses of one key meet in one row; keys should be entries or
    sessions, whose pauses are few.  Python matches many keys a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [batch.column(k).to_pylist() for k in (1, 2)]
            tp = [matched(p, t) for p, t in zip(*both, strict=True)]
            sizes = [pa.array(map(len, x), pa.int64()) for x in both]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tp, pa.int64()), *sizes], [key, "tp", "n_predicted", "n_truth"])

    kind = pauses.schema[key].dataType.simpleString()
    row = F.struct(F.col("ord").cast("long").alias("ord"), F.col("ms").cast("long").alias("ms"))
    side = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, row))), lambda x: x["ms"]).alias(s)
    lists = pauses.groupBy(key).agg(side("p"), side("t"))
    counted = lists.mapInArrow(run, f"{key} {kind}, tp long, n_predicted long, n_truth long")
    return counted.withColumn("f1", f1_of(F.col("tp"), F.col("n_predicted"), F.col("n_truth")))


def f1_of(tp: Column, n_predicted: Column, n_truth: Column) -> Column:
    """F1 of matched counts: 1 if both sides are empty, 0 if one is."""
    return F.when((n_predicted == 0) & (n_truth == 0), 1.0).otherwise(F.coalesce(F.try_divide(2.0 * tp, n_predicted + n_truth), F.lit(0.0)))


def regressions(current: DataFrame, baseline: DataFrame | None = None, thresholds: dict[str, float] | None = None) -> DataFrame:
    """(metric, message) for each metric of the one-row report ``current`` below its threshold or
    more than ``REGRESSION_TOLERANCE`` worse than in ``baseline``; unknown thresholds are ignored."""
    names = [*HIGHER, *LOWER]
    rows = lambda df, as_: df.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(as_), F.lit(m in HIGHER).alias("higher")) for m in names))).alias("x")).select("x.*")
    now = rows(current, "value")
    four = lambda c: F.format_string("%.4f", c)
    sign = F.when(F.col("higher"), " < ").otherwise(" > ")
    out = None
    if thresholds:
        table = F.create_map(*[F.lit(x) for item in thresholds.items() for x in (item[0], float(item[1]))])
        limited = now.withColumn("limit", F.try_element_at(table, F.col("metric")))
        bad = limited.where((F.col("higher") & (F.col("value") < F.col("limit"))) | (~F.col("higher") & (F.col("value") > F.col("limit"))))
        out = bad.select("metric", F.concat("metric", F.lit(" = "), four(F.col("value")), sign, F.lit("threshold "), four(F.col("limit"))).alias("message"))
    if baseline is not None:
        both = now.join(rows(baseline, "was").drop("higher"), "metric")
        bad = both.where((F.col("higher") & (F.col("value") < F.col("was") - REGRESSION_TOLERANCE)) | (~F.col("higher") & (F.col("value") > F.col("was") + REGRESSION_TOLERANCE)))
        worse = bad.select("metric", F.concat("metric", F.lit(" regressed: "), four(F.col("value")), sign, F.lit("baseline "), four(F.col("was"))).alias("message"))
        out = worse if out is None else out.unionByName(worse)
    return out if out is not None else now.select("metric", F.lit("").alias("message")).where(F.lit(False))

