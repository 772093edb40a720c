"""Validation rules of markup and dataset entries as declarative predicates over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import markup as M

#: Vocabularies of the format.
EMOTIONS = """neutral sincere sarcastic frustrated joyful uncertain angry sad fearful surprised disgusted calm empathetic""".split()
LEVELS = ["strong", "moderate", "reduced"]
CONSENT, PROCESSING = ["explicit", "implicit"], ["local", "remote"]
SOURCES, ANNOTATORS = ["mavis", "recorded", "synthetic"], ["human", "model", "hybrid"]
PITCH = r"^[+\-]\d+(\.\d+)?(%|st)$|^\d+(\.\d+)?Hz$"
VOLUME = r"^[+\-]\d+(\.\d+)?dB$"
ISO_8601 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"
BCP_47 = r"^[a-zA-Z]{2,3}(-[a-zA-Z0-9]+)*$"
REQUIRED = ["id", "timestamp", "source", "language", "audio_file", "transcript", "iml", "emotion_label", "annotator"]


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _issue(rule: str, severity: str, bad: Column, *message: str | Column) -> Column:
    found = F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), _text(*message).alias("message"))
    return F.when(F.coalesce(bad, F.lit(False)), found)


def _rules() -> list[Column]:
    """What a node breaks, rule by rule (null: nothing)."""
    a = lambda name: F.try_element_at("attrs", F.lit(name))
    kind = F.col("kind")
    of = lambda *tags: F.col("live") & kind.isin(*tags)
    confidence, duration = M.float_or_null(a("confidence")), M.int_or_null(a("duration"))
    given = a("confidence").isNotNull()
    tag = F.coalesce(F.col("tag"), F.lit(""))
    root = F.col("depth") == 0
    return [
        _issue("V1", "error", kind == "error", "malformed markup: ", F.coalesce("error", F.lit(""))),
        _issue("V2", "error", root & kind.isin("prosody", "emphasis", "segment", "pause", "unknown"), "unexpected root element <", tag, ">"),
        _issue("V17", "warning", root & (kind == "iml") & ~a("consent").isin(CONSENT), 'consent="', a("consent"), '" is not a recognized value'),
        _issue("V18", "warning", root & (kind == "iml") & ~a("processing").isin(PROCESSING), 'processing="', a("processing"), '" is not a recognized value'),
        _issue("V2", "error", root & (kind == "iml") & (F.col("n_utterances") == 0), "<iml> contains no <utterance> elements"),
        _issue("V3", "error", of("utterance") & a("emotion").isNotNull() & ~given, "<utterance> has an emotion but no confidence"),
        _issue("V4", "error", of("utterance") & given & confidence.isNull(), 'confidence="', a("confidence"), '" is not a valid float'),
        _issue("V4", "error", of("utterance") & ~F.isnan(confidence) & ((confidence < 0) | (confidence > 1)), "confidence=", a("confidence"), " is outside [0.0, 1.0]"),
        _issue("V15", "info", of("utterance") & ~a("emotion").isin(EMOTIONS), 'emotion="', a("emotion"), '" is not in the core vocabulary'),
        _issue("V13", "warning", of("prosody") & ~a("pitch").rlike(PITCH), 'pitch="', a("pitch"), '" does not match a valid format'),
        _issue("V14", "warning", of("prosody") & ~a("volume").rlike(VOLUME), 'volume="', a("volume"), '" does not match a valid format'),
        _issue("V8", "error", of("emphasis") & a("level").isNull(), "<emphasis> is missing its level"),
        _issue("V9", "warning", of("emphasis") & ~a("level").isin(LEVELS), '<emphasis> level="', a("level"), '" is not strong, moderate or reduced'),
        _issue("V12", "warning", of("prosody", "emphasis") & (F.col("fmt_depth") > 2), "<", tag, "> is nested ", F.col("fmt_depth").cast("string"), " deep; 2 are recommended"),
        _issue("V5", "error", of("pause") & a("duration").isNull(), "<pause> is missing its duration"),
        _issue("V6", "error", of("pause") & a("duration").isNotNull() & (duration.isNull() | (duration <= 0)), '<pause> duration="', a("duration"), '" is no positive integer'),
        _issue("V7", "error", of("pause") & F.col("pause_text"), "<pause> has text content"),
        _issue("V7", "error", of("pause") & F.col("pause_nodes"), "<pause> has child elements"),
        _issue("V10", "error", of("segment") & (F.col("parent_tag") != "utterance"), "<segment> must be a direct child of <utterance>, not of <", F.col("parent_tag"), ">"),
        _issue("V11", "error", of("segment") & F.col("in_segment"), "<segment> inside another <segment>"),
        _issue("V16", "info", F.col("live") & (kind == "unknown") & ~root, "unknown element <", tag, ">"),
    ]


def markup_issues(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, seq, rule, severity, message, line) of every broken rule, over shredded nodes.

    Markup that does not parse breaks V1 and nothing else.  Only nodes that a walk from the root
    reaches count: neither what lies under unknown elements and pauses, nor what stands directly in
    the document beside its utterances."""
    found = nodes.select("doc_id", "pre", "line", F.posexplode(F.array(*_rules())).alias("seq", "i")).where("i IS NOT NULL")
    return found.select("doc_id", "pre", "seq", "i.*", "line")


def markup_valid(nodes: DataFrame) -> DataFrame:
    """(doc_id, valid): no rule of severity error is broken."""
    broken = F.exists(F.array(*_rules()), lambda i: i["severity"] == "error")
    return nodes.groupBy("doc_id").agg((~F.bool_or(F.coalesce(broken, F.lit(False)))).alias("valid"))


def located(message: Column, path: Column, line: Column) -> Column:
    """A message with where it arose, as far as that is known: message (file, line n)."""
    place = F.array_compact(F.array(path, F.concat(F.lit("line "), line.cast("string"))))
    return F.concat(message, F.when(F.size(place) > 0, F.concat(F.lit(" ("), F.array_join(place, ", "), F.lit(")"))).otherwise(""))


def low_confidence(utterances: DataFrame, below: float = 0.5) -> DataFrame:
    """Utterances whose confidence is given and too low to act on."""
    return utterances.where(F.col("confidence") < below)


ENTRY = T.StructType([T.StructField(c, T.StringType()) for c in [*REQUIRED, "speaker_id"]] + [T.StructField("consent", T.BooleanType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])


def entry_issues(entries: DataFrame, keys: list[str], issues: DataFrame | None = None, audio: DataFrame | None = None) -> DataFrame:
    """(keys, rule, severity, message) of dataset entries: required fields, consent, vocabularies and
    formats; with ``issues`` (keys, severity, message of their markup) D7, with ``audio`` (the paths
    that exist) D8."""
    c = F.col
    said = lambda name: F.coalesce(c(name), F.lit("")) != ""
    rules = [
        *(_issue("D1", "error", F.btrim(F.coalesce(c(f), F.lit(""))) == "", f"{f} is missing or blank") for f in REQUIRED),
        _issue("D2", "error", ~c("consent").eqNullSafe(F.lit(True)), "consent was not given"),
        _issue("D3", "error", said("source") & ~c("source").isin(SOURCES), "unknown source: ", c("source")),
        _issue("D4", "error", said("annotator") & ~c("annotator").isin(ANNOTATORS), "unknown annotator: ", c("annotator")),
        _issue("D5", "warning", said("timestamp") & ~c("timestamp").rlike(ISO_8601), "timestamp is not in ISO 8601 form: ", c("timestamp")),
        _issue("D6", "warning", said("language") & ~c("language").rlike(BCP_47), "language is no BCP 47 tag: ", c("language")),
    ]
    out = entries.select(*keys, F.explode(F.array_compact(F.array(*rules))).alias("i")).select(*keys, "i.*")
    if issues is not None:
        bad = issues.where("severity = 'error'").select(*keys, F.lit("D7").alias("rule"), F.lit("error").alias("severity"), F.concat(F.lit("markup: "), "message").alias("message"))
        out = out.unionByName(bad)
    if audio is not None:
        gone = entries.where(said("audio_file")).join(audio, "audio_file", "left_anti")
        out = out.unionByName(gone.select(*keys, F.lit("D8").alias("rule"), F.lit("error").alias("severity"), F.concat(F.lit("no such sound: "), "audio_file").alias("message")))
    return out


def read_entries(spark: SparkSession, path: str, strict: bool = True, lines: bool = False) -> DataFrame:
    """Entries of a dataset folder (entries/*.json, one a file or with ``lines`` one a line) with
    their file names, by which they are ordered on demand; a file of another shape fails the read.  ``strict`` also fails on entries without id, audio_file, transcript, iml or
    emotion_label; otherwise those stay for ``entry_issues``."""
    rows = spark.read.schema(ENTRY).option("multiLine", not lines).option("mode", "FAILFAST").json(f"{path}/entries").select("*", F.col("_metadata.file_name").alias("file_name"))
    filled = rows.select("file_name", *(F.coalesce(f, F.lit("")).alias(f) for f in REQUIRED), "speaker_id", F.coalesce("consent", F.lit(False)).alias("consent"), "metadata")
    if not strict:
        return filled
    for f in ("id", "audio_file", "transcript", "iml", "emotion_label"):
        filled = filled.withColumn(f, F.when(F.col(f) != "", F.col(f)).otherwise(F.raise_error(F.concat(F.lit(f"entry without {f}: "), "file_name")).cast("string")))
    return filled


def entry_stream(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a dataset folder as a stream: each file that appears is read once.  Fields are filled
    and files named as by ``read_entries`` without ``strict``; ``entries.stream_into`` also keeps what
    cannot be read."""
    rows = spark.readStream.schema(ENTRY).option("multiLine", True).option("mode", "FAILFAST").json(f"{path}/entries").select("*", F.col("_metadata.file_name").alias("file_name"))
    return rows.select("file_name", *(F.coalesce(f, F.lit("")).alias(f) for f in REQUIRED), "speaker_id", F.coalesce("consent", F.lit(False)).alias("consent"), "metadata")
