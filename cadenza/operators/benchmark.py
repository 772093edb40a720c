"""One report of a converter's output against labelled entries."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markup as M
from ..sources import shred, tables
from . import metrics, nodes, validate

#: What an utterance without emotion or confidence stands for.
DEFAULT_EMOTION, DEFAULT_CONFIDENCE = "neutral", 0.5


def first_entries(entries: DataFrame, max_samples: int | None) -> DataFrame:
    """The first ``max_samples`` entries by file name, or all."""
    return entries if max_samples is None else entries.orderBy("file_name", "entry_id").limit(max_samples)


def predicted_utterances(entries: DataFrame, predicted: DataFrame) -> DataFrame:
    """(entry_id, truth, predicted, confidence, correct) of every predicted utterance (``predicted``:
    shredded nodes by doc_id); an entry's one label is the truth of all of them."""
    attr = lambda name: F.try_element_at("attrs", F.lit(name))
    whole = (F.col("kind") == "utterance") & F.col("inside") & ((F.col("depth") == 0) | ((F.col("depth") == 1) & (F.col("parent_tag") == "iml")))
    said = predicted.where(whole).select(
        F.col("doc_id").alias("entry_id"),
        F.when(attr("emotion") != "", attr("emotion")).otherwise(DEFAULT_EMOTION).alias("predicted"),
        F.coalesce(M.float_or_null(attr("confidence")), F.lit(DEFAULT_CONFIDENCE)).alias("confidence"),
    )
    both = said.join(entries.select("entry_id", F.col("emotion_label").alias("truth")), "entry_id")
    return both.withColumn("correct", F.col("truth") == F.col("predicted"))


def whole_pause_f1(pauses: DataFrame) -> DataFrame:
    """One row (tp, n_predicted, n_truth, f1) over all entries' pauses (side 'p' or 't', file_name,
    entry_id, pre, ms), joined into two lists in the order of the files.

    The match runs through the lists in order, so they meet in one task, as two numbers a pause;
    this is for the pauses of a labelled benchmark.  ``metrics.pause_scores`` scores entry by entry
    in parallel."""

    def run(table: pa.Table) -> pa.Table:
        ordered = table["ms"].take(pc.sort_indices(table, [(c, "ascending") for c in ("side", "file_name", "entry_id", "pre", "ms")]))
        n = pc.sum(pc.equal(table["side"], "p")).as_py() or 0
        p, t = ordered[:n].to_pylist(), ordered[n:].to_pylist()
        return pa.table({"tp": pa.array([metrics.matched(p, t)], pa.int64()), "n_predicted": pa.array([len(p)], pa.int64()), "n_truth": pa.array([len(t)], pa.int64())})

    whole = pauses.select(F.lit(0).alias("all"), *pauses.columns)
    counted = whole.groupBy("all").applyInArrow(run, "tp long, n_predicted long, n_truth long")
    summed = counted.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counted.columns))
    return summed.withColumn("f1", metrics.f1_of(F.col("tp"), F.col("n_predicted"), F.col("n_truth")))


def run(entries: DataFrame, predictions: DataFrame, max_samples: int | None = None) -> DataFrame:
    """One row: emotion_accuracy, emotion_f1 (by label), confidence_ece, pitch_accuracy, pause_f1,
    validity_rate, num_samples, num_failures.

    ``entries``: entry_id (long), file_name, markup and emotion_label; ``predictions``: entry_id and
    markup.  An entry without predicted markup is a failure and counts nowhere else.  Markup that
    does not parse is invalid and has no utterances; neither its pauses nor its entry's are scored.
    What several scores read, predictions and nodes, is written once to the shared folder."""
    chosen = first_entries(entries, max_samples)
    both = tables.written(chosen.join(predictions.select("entry_id", F.col("markup").alias("said")), "entry_id", "left"), "benchmark")
    labelled = both.select("entry_id", "file_name", "emotion_label")
    counts = both.agg(F.count("said").alias("num_samples"), F.count_if(F.col("said").isNull()).alias("num_failures"))
    done = both.where("said IS NOT NULL")
    said = tables.written(shred.shredded(done.select("entry_id", "said"), "entry_id", "said"), "benchmark-nodes")
    parsed = said.where("kind <> 'error' AND depth = 0").select(F.col("doc_id").alias("entry_id")).distinct()
    real = tables.written(shred.shredded(done.join(parsed, "entry_id", "left_semi").select("entry_id", "markup"), "entry_id").where("kind IN ('prosody', 'pause')"), "benchmark-truth")

    utterances = predicted_utterances(labelled, said)
    emotion = utterances.agg(metrics.accuracy(F.col("correct")).alias("emotion_accuracy"))
    report = metrics.class_report(utterances).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "f1")))).alias("emotion_f1"))
    ece = metrics.calibration_error(utterances).select(F.col("ece").alias("confidence_ece"))
    labels = lambda x: nodes.contours(x).select(F.col("doc_id").alias("entry_id"), F.col("pre").alias("pos"), "label")
    pitch = metrics.contour_pairs(labels(real), labels(said)).agg(metrics.accuracy(F.col("truth") == F.col("predicted")).alias("pitch_accuracy"))
    still = lambda x, side: nodes.pauses(x).select(F.lit(side).alias("side"), F.col("doc_id").alias("entry_id"), "pre", "ms")
    pauses = still(said, "p").unionByName(still(real, "t")).join(labelled.select("entry_id", "file_name"), "entry_id")
    pause = whole_pause_f1(pauses).select(F.col("f1").alias("pause_f1"))
    valid = validate.markup_valid(said).agg(metrics.accuracy(F.col("valid")).alias("validity_rate"))
    out = emotion
    for one in (report, ece, pitch, pause, valid, counts):
        out = out.join(F.broadcast(one))  # one row each
    return out


def of(converter: Callable[[DataFrame], DataFrame], entries: DataFrame, max_samples: int | None = None) -> DataFrame:
    """``run`` for a converter, any function from entries to (entry_id, markup)."""
    chosen = first_entries(entries, max_samples)
    return run(chosen, converter(chosen))


def guarded(convert: Callable[[str], str | None], entries: DataFrame, column: str = "transcript") -> DataFrame:
    """(entry_id, markup, error) of a converter that takes one document at a time: a document on which
    it raises has a null markup and says why, and the others go on.

    A null document is not converted and says so; a converter that gives None has failed without a
    reason of its own."""

    @F.arrow_udf("markup string, error string")
    def converted(documents: pa.Array) -> pa.Array:
        markup, error = [], []
        for document in documents.to_pylist():
            made = why = None
            if document is None:
                why = "no document"
            else:
                try:
                    made = convert(document)
                    why = "nothing converted" if made is None else None
                except Exception as problem:  # noqa: BLE001  whatever a converter raises is that document's failure
                    why = f"{type(problem).__name__}: {problem}"
            markup.append(made)
            error.append(why)
        return pa.StructArray.from_arrays([pa.array(markup, pa.string()), pa.array(error, pa.string())], ["markup", "error"])

    return entries.select("entry_id", converted(column).alias("c")).select("entry_id", "c.markup", "c.error")


def of_each(convert: Callable[[str], str | None], entries: DataFrame, column: str = "transcript", max_samples: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``run`` for a converter of single documents, and its failures (entry_id, error): they count in
    num_failures and nowhere else.  What it made is written once, so that it runs once."""
    chosen = tables.written(first_entries(entries, max_samples), "benchmark-chosen")
    made = tables.written(guarded(convert, chosen, column), "benchmark-converted")
    return run(chosen, made.where("markup IS NOT NULL").select("entry_id", "markup")), made.where("error IS NOT NULL").select("entry_id", "error")
