"""Node tables: plain text, serialising, SSML, pauses, contours and rendered length.

All work on the output of ``sources.shred``; a document's nodes meet once, by doc_id."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup as M

#: Attributes in the order of the format, and which are numbers.
PROSODY = [
    "pitch", "pitch_contour", "volume", "rate", "quality", "f0_mean", "f0_range", "f0_contour", "intensity_mean", "intensity_range",
    "speech_rate", "duration_ms", "jitter", "shimmer", "hnr",
]
NUMBERS = {"f0_mean", "intensity_mean", "intensity_range", "speech_rate", "jitter", "shimmer", "hnr", "confidence"}
#: Sampling and rhythm of the renderer.
SAMPLE_RATE, WORD_SAMPLES, GAP_SAMPLES, UTTERANCE_SAMPLES, EMPTY_SAMPLES = 22_050, 5512, 1102, 6615, 2205
SPEAK = '<speak version="1.0" xmlns="http://www.w3.org/2001/10/synthesis"'


def _attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def pause_ms() -> Column:
    """Length of a pause node; 0 where it is no number."""
    return F.coalesce(M.int_or_null(_attr("duration")), F.lit(0))


def _written(*names: str) -> Column:
    """Attributes as the serialiser writes them, in this order: numbers anew, unreadable ones not at
    all.  One lambda over the names keeps the generated code small."""

    def one(name: Column) -> Column:
        raw = F.try_element_at("attrs", name)
        value = F.when(name.isin(*NUMBERS), M.number_text(M.float_or_null(raw))).when(name == "duration_ms", M.int_or_null(raw).cast("string")).otherwise(raw)
        return F.coalesce(F.concat(F.lit(" "), name, F.lit('="'), M.escape(value), F.lit('"')), F.lit(""))

    return F.array_join(F.transform(F.array(*map(F.lit, names)), one), "")


def _content(comments: str) -> Column:
    """Whether a node belongs to an utterance; text under unknown elements counts as their parent's."""
    kinds = ["utterance", "prosody", "emphasis", "segment", "pause", "text"] + (["comment"] if comments == "text" else [])
    return F.col("inside") & F.col("kind").isin(kinds)


def _documents(nodes: DataFrame, opening: Column, closing: Column, leaf: Column, told: Column) -> DataFrame:
    """(doc_id, kind, attrs, body, n): each document's root, its parts in order and the number of its
    utterances, of documents that parse.  Of each node that ``told`` holds for, its opening stands
    at pre and its closing after its last descendant.  A document's nodes meet once."""
    parts = F.array(
        F.struct(F.col("utt_idx").alias("utt"), F.col("pre").alias("at"), F.lit(1).alias("side"), F.lit(0).alias("order"), F.coalesce(opening, leaf, F.lit("")).alias("text")),
        F.struct(F.col("utt_idx").alias("utt"), F.col("post").alias("at"), F.lit(2).alias("side"), (-F.col("pre")).alias("order"), F.coalesce(closing, F.lit("")).alias("text")),
    )
    root = F.when((F.col("depth") == 0) & F.col("kind").isin("iml", "utterance"), F.struct("kind", "attrs"))
    first = (F.col("kind") == "utterance") & F.col("inside") & ~F.col("hidden") & told
    return (
        nodes.groupBy("doc_id")
        .agg(F.max_by(root, root.isNotNull().cast("int")).alias("root"), F.flatten(F.collect_list(F.when(told, parts))).alias("ts"), F.count_distinct(F.when(first, F.col("utt_idx"))).alias("n"))
        .where("root IS NOT NULL")
        .select("doc_id", "root.*", F.array_join(F.transform(F.array_sort("ts"), lambda t: t["text"]), "").alias("body"), "n")
    )


def settled(nodes: DataFrame, result: DataFrame, failures: str = "null") -> DataFrame:
    """``result`` of a conversion with the documents that do not parse: as rows of nulls (``null``),
    not at all (``drop``), or as an error of the job (``fail``)."""
    if failures == "drop":
        return result
    if failures not in ("null", "fail"):
        raise ValueError(f"failures must be null, drop or fail, not {failures!r}")
    docs = nodes.groupBy("doc_id").agg(F.max("error").alias("error"))
    if failures == "fail":
        said = F.concat(F.lit("document "), F.col("doc_id").cast("string"), F.lit(": "), "error")
        docs = docs.where(F.when(F.col("error").isNotNull(), F.raise_error(said).cast("boolean")).otherwise(True))
    return docs.select("doc_id").join(result, "doc_id", "left")


def plain_text(nodes: DataFrame, comments: str = "drop") -> DataFrame:
    """(doc_id, plain): all text of the utterances in order, a blank for each pause."""
    kind = F.col("kind")
    own = F.when(kind == "text", F.col("text")).when((kind == "pause") & ~F.col("hidden"), " ")
    if comments == "text":
        own = F.coalesce(own, F.when(kind == "comment", F.col("text")))
    none = F.lit(None).cast("string")
    return _documents(nodes, none, none, own, F.col("inside") & own.isNotNull()).select("doc_id", F.col("body").alias("plain"))


def serialised(nodes: DataFrame, comments: str = "drop") -> DataFrame:
    """(doc_id, markup) in the one form of the format: attributes in order, unknown elements and what
    cannot be read left out; a single utterance without version and language stands alone."""
    kind = F.col("kind")
    told = _content(comments) & (~F.col("hidden") | kind.isin("text", "comment"))
    attrs = (
        F.when(kind == "prosody", _written(*PROSODY))
        .when(kind == "emphasis", M.attribute("level", F.coalesce(_attr("level"), F.lit(""))))
        .when(kind == "segment", _written("tempo", "rhythm"))
        .when(kind == "utterance", _written("emotion", "confidence", "speaker_id"))
    )
    opening = F.concat(F.lit("<"), kind, attrs, F.lit(">"))
    closing = F.when(attrs.isNotNull(), F.concat(F.lit("</"), kind, F.lit(">")))
    leaf = F.when(kind == "pause", F.concat(F.lit('<pause duration="'), pause_ms().cast("string"), F.lit('"/>'))).otherwise(M.escape(F.col("text")))
    docs = _documents(nodes, opening, closing, leaf, told)
    bare = (F.col("n") == 1) & ((F.col("kind") == "utterance") | (_attr("version").isNull() & _attr("language").isNull()))
    head = F.concat(*(M.attribute(a, _attr(a)) for a in ("version", "language", "consent", "processing")))
    return docs.select("doc_id", F.when(bare, F.col("body")).otherwise(F.concat(F.lit("<iml"), head, F.lit(">"), "body", F.lit("</iml>"))).alias("markup"))


def to_ssml(nodes: DataFrame, vendor: str | None = None) -> DataFrame:
    """(doc_id, ssml): utterances as <s>, pauses as breaks, prosody with pitch, volume and rate only
    (left out without them), segments left out.  ``vendor`` is reserved: it gives a warning and plain
    SSML."""
    if vendor is not None:
        warnings.warn(f"no adaptation for {vendor!r}: plain SSML is made", UserWarning, stacklevel=2)
    kind = F.col("kind")
    told = _content("drop") & (~F.col("hidden") | (kind == "text"))
    kept = F.concat(M.attribute("pitch", _attr("pitch")), M.attribute("volume", M.volume_to_ssml(_attr("volume"))), M.attribute("rate", _attr("rate")))
    tagged = (kind == "prosody") & (kept != "")
    level = F.when(_attr("level") != "", M.attribute("level", _attr("level"))).otherwise("")
    opening = (
        F.when(kind == "utterance", "<s>").when(tagged, F.concat(F.lit("<prosody"), kept, F.lit(">"))).when(kind == "emphasis", F.concat(F.lit("<emphasis"), level, F.lit(">"))).when(kind.isin("prosody", "segment"), "")
    )
    closing = F.when(kind == "utterance", "</s>").when(tagged, "</prosody>").when(kind == "emphasis", "</emphasis>")
    leaf = F.when(kind == "pause", F.concat(F.lit('<break time="'), pause_ms().cast("string"), F.lit('ms"/>'))).otherwise(M.escape(F.col("text")))
    docs = _documents(nodes, opening, closing, leaf, told)
    language = F.when((F.col("kind") == "iml") & (_attr("language") != ""), M.attribute("xml:lang", _attr("language"))).otherwise("")
    return docs.select("doc_id", F.concat(F.lit(SPEAK), language, F.lit(">"), "body", F.lit("</speak>")).alias("ssml"))


def pauses(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, ms) of every pause in utterances."""
    return nodes.where("inside AND kind = 'pause' AND NOT hidden").select("doc_id", "pre", pause_ms().alias("ms"))


def contours(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, label) of every pitch contour that is not empty."""
    rows = nodes.where("inside AND kind = 'prosody' AND NOT hidden")
    return rows.select("doc_id", "pre", _attr("pitch_contour").alias("label")).where("label <> ''")


def cues(nodes: DataFrame) -> DataFrame:
    """(doc_id, n_pauses, pause_ms, n_rises) of documents with ``pauses`` or ``contours``, null where
    there are none, in one pass over the nodes."""
    still = F.col("kind") == "pause"
    told = nodes.where(F.col("inside") & ~F.col("hidden") & (still | ((F.col("kind") == "prosody") & (_attr("pitch_contour") != ""))))
    none_as_null = lambda c: F.nullif(F.count_if(c), F.lit(0))
    return told.groupBy("doc_id").agg(none_as_null(still).alias("n_pauses"), F.sum(F.when(still, pause_ms())).alias("pause_ms"), none_as_null(~still).alias("n_rises"))


def voices(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, utt_idx, text, frequency, amplitude) of every text: pitch, volume and emphasis
    of its ancestors applied from the outside in."""
    voiced = nodes.where("inside AND kind = 'text'").withColumn("v", voice())
    return voiced.select("doc_id", "pre", "utt_idx", "text", F.col("v.f").alias("frequency"), F.col("v.a").alias("amplitude"))


def voice() -> Column:
    """Frequency and amplitude (f, a) of a text node."""

    def step(v: Column, s: Column) -> Column:
        up = F.when(s["level"] == "strong", 1.15).when(s["level"] == "reduced", 1.05).otherwise(1.10)
        gain = F.when(s["level"] == "strong", F.least(F.lit(1.0), v["a"] * 1.5)).when(s["level"] == "reduced", v["a"] * 1.1).otherwise(F.least(F.lit(1.0), v["a"] * 1.3))
        spoken = s["kind"] == "prosody"
        return F.struct(
            F.when(spoken, M.pitch_to_hz(s["pitch"], v["f"])).otherwise(v["f"] * up).alias("f"),
            F.when(spoken, M.volume_to_amplitude(s["volume"], v["a"])).otherwise(gain).alias("a"),
        )

    start = F.struct(F.lit(M.BASE_FREQUENCY).alias("f"), F.lit(M.BASE_AMPLITUDE).alias("a"))
    return F.aggregate("styles", start, step)


def rendered_samples(nodes: DataFrame) -> DataFrame:
    """(doc_id, n_samples) of the rendered document: a tone for each word with gaps between, pauses,
    gaps between utterances; an empty document has a short silence."""
    kind = F.col("kind")
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    spoken = F.when((kind == "pause") & ~F.col("hidden"), F.floor(SAMPLE_RATE * (pause_ms() / 1000.0))).when(
        kind == "text", words * WORD_SAMPLES + F.greatest(words - 1, F.lit(0)) * GAP_SAMPLES
    )
    many = (kind == "utterance") & F.col("inside") & ((F.col("parent_pre") == -1) | ((F.col("parent_tag") == "iml") & (F.col("depth") == 1)))
    docs = nodes.groupBy("doc_id").agg(
        F.bool_or((F.col("depth") == 0) & kind.isin("iml", "utterance")).alias("parses"),
        F.coalesce(F.sum(F.when(F.col("inside"), spoken).cast("long")), F.lit(0)).alias("own"),
        F.count_if(many).alias("n"),
    )
    total = F.col("own") + F.greatest(F.col("n") - 1, F.lit(0)) * UTTERANCE_SAMPLES
    # a document none of whose parts sounds, pauses between utterances included, is a short silence
    return docs.where("parses").select("doc_id", F.when(total == 0, EMPTY_SAMPLES).otherwise(total).cast("long").alias("n_samples"))
