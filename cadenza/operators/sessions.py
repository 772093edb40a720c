"""Phoneme-event sessions: feature vectors, emotion, confidence and session markup.

Events are rows (session_id, seq, start_ms, duration_ms, volume, pitch_hz, vibrato, breathiness)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup as M


def _in_order(events: DataFrame) -> DataFrame:
    """``events`` brought together by session in the order of seq, so that doubles are added in that
    order however the input is split; a stream, or rows without seq, as they come."""
    if "seq" not in events.columns or events.isStreaming:
        return events
    return events.repartition("session_id").sortWithinPartitions("session_id", "seq")


def features(events: DataFrame, *keys: str) -> DataFrame:
    """Seven training features by session (or by ``keys``): mean_pitch, pitch_range, mean_volume,
    volume_range, mean_breathiness, speech_rate (events per second of sound) and vibrato_ratio."""
    rows = events if keys else _in_order(events)
    return rows.groupBy(*(keys or ("session_id",))).agg(
        F.avg("pitch_hz").alias("mean_pitch"),
        (F.max("pitch_hz") - F.min("pitch_hz")).alias("pitch_range"),
        F.avg("volume").alias("mean_volume"),
        (F.max("volume") - F.min("volume")).alias("volume_range"),
        F.avg("breathiness").alias("mean_breathiness"),
        (F.count("*") / F.greatest(F.sum("duration_ms") / 1000.0, F.lit(0.001))).alias("speech_rate"),
        (F.count_if("vibrato") / F.count("*")).alias("vibrato_ratio"),
        F.count("*").alias("n_events"),
    )


def emotion() -> Column:
    """Emotion of a row of ``features``."""
    return (
        F.when(F.col("mean_volume") > 0.8, F.when(F.col("mean_pitch") > 300, "angry").otherwise("joyful"))
        .when(F.col("mean_breathiness") > 0.5, "sad")
        .when(F.col("mean_volume") < 0.3, "calm")
        .otherwise("neutral")
    )


def confidence() -> Column:
    """Confidence of a row of ``features``: livelier sessions are surer."""
    lively = F.least(F.col("volume_range") * 0.3 + F.col("pitch_range") / 500, F.lit(0.4))
    return F.when(F.col("n_events") < 2, 0.5).otherwise(F.least(0.5 + lively, F.lit(0.95)))


def word_prosody(events: DataFrame, words: DataFrame) -> DataFrame:
    """Rows of ``words`` (session_id, word_idx, word, n_words) with pitch and volume of their events
    relative to the session, null where they hardly differ.  Each word gets an equal run of events;
    events left over belong to no word, words beyond the events get none."""
    session = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = (
        events.withColumn("n_events", F.count("*").over(session))
        .withColumn("mean_pitch", F.avg("pitch_hz").over(session))
        .withColumn("mean_volume", F.avg("volume").over(session))
    )
    sized = whole.join(words.select("session_id", "n_words").distinct(), "session_id")
    per = F.greatest(F.lit(1), F.floor(F.col("n_events") / F.greatest(F.col("n_words"), F.lit(1))))
    runs = (
        sized.withColumn("word_idx", F.floor(F.col("seq") / per).cast("int"))
        .groupBy("session_id", "word_idx")
        .agg(F.avg("pitch_hz").alias("wp"), F.avg("volume").alias("wv"), F.first("mean_pitch").alias("mp"), F.first("mean_volume").alias("mv"))
    )
    out = words.join(runs, ["session_id", "word_idx"], "left")
    out = out.withColumn("pitch_dev", (F.col("wp") - F.col("mp")) / F.greatest(F.col("mp"), F.lit(1.0)) * 100)
    out = out.withColumn("vol_ratio", F.col("wv") / F.greatest(F.col("mv"), F.lit(0.001)))
    tagged = (F.abs("pitch_dev") > 10) | (F.abs(F.col("vol_ratio") - 1.0) > 0.3)
    decibels = 20.0 * F.log10(F.greatest(F.col("vol_ratio"), F.lit(0.001)))
    out = out.withColumn("pitch", F.when(tagged, M.relative(F.col("pitch_dev"), "%", plus_at_zero=False)))
    return out.withColumn("volume", F.when(tagged, M.relative(decibels, "dB"))).drop("wp", "wv", "mp", "mv")


def session_markup(events: DataFrame, transcripts: DataFrame, compat: bool = False) -> DataFrame:
    """(session_id, emotion, markup) of sessions with a transcript (session_id, transcript).  Where
    transcripts have an emotion_label, it stands for the inferred emotion.  ``compat`` leaves words
    unescaped."""
    tokens = transcripts.select("session_id", F.filter(F.split("transcript", r"\s+"), lambda w: w != "").alias("ws"))
    words = tokens.select("session_id", F.size("ws").alias("n_words"), F.posexplode("ws").alias("word_idx", "word"))
    text = F.col("word") if compat else M.escape(F.col("word"))
    piece = F.when(F.col("pitch").isNull(), text).otherwise(
        F.concat(F.lit('<prosody pitch="'), "pitch", F.lit('" volume="'), "volume", F.lit('">'), text, F.lit("</prosody>"))
    )
    rows = word_prosody(events, words).withColumn("piece", piece)
    inner = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("word_idx", "piece"))).alias("p"))
    given = F.col("emotion_label") if "emotion_label" in transcripts.columns else F.lit(None).cast("string")
    # hundredths are rounded as binary numbers: format_string alone rounds the shortest decimal form
    marked = features(events).withColumn("inferred", emotion()).withColumn("confidence", F.format_string("%.2f", F.round(confidence() * 100) / 100))
    both = marked.join(transcripts.select("session_id", given.alias("given")), "session_id").join(inner, "session_id", "left")
    both = both.withColumn("emotion", F.coalesce("given", "inferred"))
    body = F.coalesce(F.array_join(F.transform("p", lambda x: x["piece"]), " "), F.lit(""))
    return both.select(
        "session_id", "emotion", F.concat(F.lit('<utterance emotion="'), "emotion", F.lit('" confidence="'), "confidence", F.lit('">'), body, F.lit("</utterance>")).alias("markup")
    )


def entries(events: DataFrame, transcripts: DataFrame, language: str = "en-US", compat: bool = False) -> DataFrame:
    """Dataset entries of sessions with events and a transcript (session_id, transcript, and if there
    are such columns emotion_label and speaker_id): id and audio_file from the session's name, the
    time of the run, markup, the given or inferred label, and the number of events as metadata."""
    speaker = F.col("speaker_id") if "speaker_id" in transcripts.columns else F.lit(None).cast("string")
    rows = session_markup(events, transcripts, compat).join(transcripts.select("session_id", "transcript", speaker.alias("speaker_id")), "session_id")
    rows = rows.join(events.groupBy("session_id").agg(F.count("*").cast("string").alias("n_events")), "session_id")
    return rows.select(
        F.concat(F.lit("mavis_"), "session_id").alias("id"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"),
        F.lit("mavis").alias("source"),
        F.lit(language).alias("language"),
        F.concat(F.lit("audio/"), "session_id", F.lit(".wav")).alias("audio_file"),
        "transcript",
        F.col("markup").alias("iml"),
        F.col("emotion").alias("emotion_label"),
        F.lit("model").alias("annotator"),
        F.lit(True).alias("consent"),
        "speaker_id",
        F.create_map(F.lit("mavis_events"), "n_events").alias("metadata"),
    )
