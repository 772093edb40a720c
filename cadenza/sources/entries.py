"""Dataset entries with open metadata, and what cannot be read set apart.

Entry files hold one JSON object each (or one a line).  A file is read as text and parsed to a VARIANT, so
that a value keeps the type that it has in the file: a number where text belongs is no text, and nested
metadata stays as it is.  A row that cannot be an entry is not lost and fails nobody else: it goes
to the rejects with its file, the reason and its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: An entry has no use without these; texts that may be missing.
NEEDED = ["id", "audio_file", "transcript", "iml", "emotion_label"]
OPTIONAL = ["timestamp", "source", "language", "annotator"]


def _kind(value: Column) -> Column:
    """Type of a VARIANT (null if there is no value)."""
    return F.schema_of_variant(value)


def _field(name: str) -> Column:
    return F.try_variant_get(F.col("v"), f"$.{name}", "variant")


def _text(name: str) -> Column:
    return F.try_variant_get(F.col("v"), f"$.{name}", "string")


def _empty(name: str) -> Column:
    """No value, or one that counts as none: null, false, zero, empty text, list or object."""
    kind, text = F.coalesce(_kind(_field(name)), F.lit("VOID")), _text(name)
    nothing = (kind == "VOID") | ((kind == "STRING") & (text == "")) | ((kind == "BOOLEAN") & (text == "false"))
    number = F.try_variant_get(F.col("v"), f"$.{name}", "double")
    return nothing | (~kind.isin("STRING", "BOOLEAN") & F.coalesce(number == 0, F.lit(False))) | F.coalesce(F.to_json(_field(name)).isin("[]", "{}"), F.lit(False))


def judged(rows: DataFrame) -> DataFrame:
    """``rows`` (file_name, raw) with ``v`` and ``reason``: null for an entry, else why it is none.  A
    null or blank text is not JSON."""
    parsed = rows.withColumn("v", F.try_parse_json("raw"))
    gaps = F.array_join(F.array_compact(F.array(*(F.when(_empty(f), f) for f in NEEDED))), ", ")
    reason = F.when(F.col("v").isNull(), "not JSON").when(~_kind(F.col("v")).startswith("OBJECT"), "not an object").when(gaps != "", F.concat(F.lit("missing: "), gaps))
    return parsed.withColumn("reason", reason)


def entries(good: DataFrame) -> DataFrame:
    """Entries of judged rows: text fields (those that are missing as ''), ``consent`` (whether it is
    true itself), ``speaker_id`` (null unless it is text) and ``metadata``, a VARIANT ({} unless it is an
    object)."""
    whole = _field("metadata")
    return good.select(
        "file_name", *(F.coalesce(_text(f), F.lit("")).alias(f) for f in NEEDED + OPTIONAL),
        F.coalesce((_kind(_field("consent")) == "BOOLEAN") & (_text("consent") == "true"), F.lit(False)).alias("consent"),
        F.when(_kind(_field("speaker_id")) == "STRING", _text("speaker_id")).alias("speaker_id"),
        F.when(_kind(whole).startswith("OBJECT"), whole).otherwise(F.parse_json(F.lit("{}"))).alias("metadata"),
    )


def rejects(rows: DataFrame) -> DataFrame:
    """(file_name, reason, raw) of judged rows that are no entries."""
    return rows.where("reason IS NOT NULL").select("file_name", "reason", "raw")


def read(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Entries and rejects of a dataset folder; each row of its files is in one of the two.  A file
    without a byte has no row: Spark's readers pass it over."""
    text = spark.read.text(f"{path}/entries", wholetext=not lines).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("raw"))
    rows = judged(text)
    return entries(rows.where("reason IS NULL")), rejects(rows)


def stream_into(spark: SparkSession, path: str, out: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """The same for a folder that grows: files that have appeared since the last call are read, each
    once, and all entries and rejects so far are given.

    A batch goes to both sinks under its number in ``out``, which executors share, so a batch that is
    repeated after a failure replaces its own files and adds nothing."""

    def keep(rows: DataFrame, batch: int) -> None:
        seen = judged(rows).persist()
        entries(seen.where("reason IS NULL")).write.mode("overwrite").parquet(f"{out}/entries/batch={batch}")
        rejects(seen).write.mode("overwrite").parquet(f"{out}/rejects/batch={batch}")
        seen.unpersist()

    text = spark.readStream.text(f"{path}/entries", wholetext=not lines).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("raw"))
    query = text.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    none = judged(spark.createDataFrame([], "file_name string, raw string"))
    kinds = entries(none).schema, rejects(none).schema
    home = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/entries")
    if not home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(home):
        return spark.createDataFrame([], kinds[0]), spark.createDataFrame([], kinds[1])
    return tuple(spark.read.schema(k).parquet(f"{out}/{part}").drop("batch") for k, part in zip(kinds, ("entries", "rejects"), strict=True))
