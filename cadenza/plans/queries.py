"""Registered queries of the reference's operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup as M
from ..operators import audio, benchmark, intervals, learning, metrics, nodes, profiles, sessions, speech, split, text, validate
from ..sources import entries as open_entries
from ..sources import folders, shred, tables
from ..streaming import assembly
from ..streaming import sessions as streaming
from . import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.view(spark, A.WORD_SPAN, sf_dir, "lineitem")


def _phonemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.view(spark, A.PHONEMES, sf_dir, "events")


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.view(spark, A.PREDICTION, sf_dir, "labels")
    return rows.withColumn("confidence", F.col("confidence").cast("double")).withColumn("correct", F.col("truth") == F.col("predicted"))


def _cued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.view(spark, A.CUED_TEXT, sf_dir, "documents")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred.shredded(A.view(spark, A.MARKUP, sf_dir, "orders"))


def _six(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


_GROUPED = f"""
w AS ({A.duck(A.WORD_SPAN)}),
u AS (
  SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY word_idx) AS utt_idx
  FROM (SELECT *, CASE WHEN coalesce(regexp_matches(rtrim(lag(word) OVER o), '[.!?]$') OR start_ms - lag(end_ms) OVER o >= 1000, false) THEN 1 ELSE 0 END AS cut
        FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY word_idx)))"""

_SCORED = f"""{_GROUPED},
a AS (
  SELECT doc_id, utt_idx, count(*) AS n_words, avg(f0_mean) AS p, avg(f0_span) AS s, avg(intensity_mean) AS i, avg(speech_rate) AS r,
         avg(jitter) AS j, avg(shimmer) AS sh, avg(hnr) AS h
  FROM u GROUP BY doc_id, utt_idx),
sc AS (
  SELECT *, [
    0.0::DOUBLE + CASE WHEN p > 180*1.3::DOUBLE THEN 0.3 ELSE 0 END::DOUBLE + CASE WHEN i > 71 THEN 0.3 ELSE 0 END::DOUBLE + CASE WHEN r > 4*1.3::DOUBLE THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN j > 0.015::DOUBLE THEN 0.1 ELSE 0 END::DOUBLE,
    0.0::DOUBLE + CASE WHEN p > 180*1.1::DOUBLE THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN i > 68 THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN j > 0.01::DOUBLE THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN sh > 0.06::DOUBLE THEN 0.1 ELSE 0 END::DOUBLE,
    0.0::DOUBLE + CASE WHEN p > 180*1.2::DOUBLE THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN s > 80 THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN i > 67 THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN r > 4*1.1::DOUBLE THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN h > 15 THEN 0.1 ELSE 0 END::DOUBLE,
    0.0::DOUBLE + CASE WHEN p < 180*0.85::DOUBLE THEN 0.3 ELSE 0 END::DOUBLE + CASE WHEN s < 30 THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN i < 62 THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN r < 4*0.8::DOUBLE THEN 0.2 ELSE 0 END::DOUBLE,
    0.0::DOUBLE + CASE WHEN p > 180*1.25::DOUBLE THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN j > 0.015::DOUBLE THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN sh > 0.08::DOUBLE THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN r > 4*1.2::DOUBLE THEN 0.2 ELSE 0 END::DOUBLE,
    0.0::DOUBLE + CASE WHEN s > 100 THEN 0.3 ELSE 0 END::DOUBLE + CASE WHEN p > 180*0.9::DOUBLE AND p < 180*1.2::DOUBLE THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN r > 4*0.8::DOUBLE AND r < 4*1.1::DOUBLE THEN 0.1 ELSE 0 END::DOUBLE,
    0.0::DOUBLE + CASE WHEN p > 180*0.9::DOUBLE AND p < 180*1.1::DOUBLE THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN i < 65 THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN r < 4*0.95::DOUBLE THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN h > 15 THEN 0.1 ELSE 0 END::DOUBLE,
    0.0::DOUBLE + CASE WHEN p/180 > 0.9::DOUBLE AND p/180 < 1.1::DOUBLE THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN abs(i-65) < 3 THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN r/4 > 0.85::DOUBLE AND r/4 < 1.15::DOUBLE THEN 0.15 ELSE 0 END::DOUBLE
  ] AS v FROM a),
em AS (
  SELECT *, list_max(v) AS best, list_reverse_sort(v)[2] AS second,
         ['angry','frustrated','joyful','sad','fearful','sarcastic','calm','neutral'][list_position(v, list_max(v))] AS top
  FROM sc),
e AS (
  SELECT doc_id, utt_idx, n_words, CASE WHEN p IS NULL AND i IS NULL THEN 'neutral' ELSE top END AS emotion,
         CASE WHEN p IS NULL AND i IS NULL THEN 0.5::DOUBLE
              ELSE round_even(greatest(0.3::DOUBLE, least(0.95::DOUBLE, 0.3::DOUBLE + 0.65::DOUBLE * CASE WHEN best > 0 THEN (best - second) / best ELSE 0 END)) * 100, 0) / 100 END AS confidence
  FROM em)"""

_WHOLE = lambda x: f"CASE WHEN round_even({x}, 0) = 0 AND {x} < 0 THEN '-0' ELSE round_even({x}, 0)::BIGINT::VARCHAR END"
_DEVIATED = f"""{_GROUPED},
b AS (
  SELECT *, coalesce(avg(f0_mean) OVER g, 180) AS b0, coalesce(avg(intensity_mean) OVER g, 65) AS bi,
         start_ms - lag(end_ms) OVER o AS gap_ms
  FROM u WINDOW g AS (PARTITION BY doc_id, utt_idx), o AS (PARTITION BY doc_id, utt_idx ORDER BY word_idx)),
dv AS (SELECT *, (f0_mean - b0) / b0 * 100 AS fp, intensity_mean - bi AS db FROM b),
d AS (
  SELECT *, CASE WHEN abs(fp) > 15 THEN CASE WHEN fp >= 0 THEN '+' ELSE '' END || {_WHOLE('fp')} || '%' END AS pitch,
         CASE WHEN abs(db) > 5 THEN CASE WHEN db >= 0 THEN '+' ELSE '' END || {_WHOLE('db')} || 'dB' END AS volume,
         coalesce(abs(fp) > 20 OR db > 6, coalesce(abs(fp) > 20, false) OR coalesce(db > 6, false)) AS strong,
         CASE WHEN gap_ms >= 200 THEN gap_ms END AS pause_ms
  FROM dv)"""


@query
def utterance_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech.utterances(_words(spark, sf_dir)).groupBy("doc_id", "utt_idx").agg(
        F.count("*").alias("n_words"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")
    )


ORACLE_SQL["utterance_grouping"] = f"WITH {_GROUPED} SELECT doc_id, utt_idx::BIGINT AS utt_idx, count(*) AS n_words, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM u GROUP BY ALL"


@query
def utterance_emotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = speech.with_emotion(speech.averages(speech.utterances(_words(spark, sf_dir))))
    return rows.select("doc_id", "utt_idx", "n_words", "emotion", "confidence")


ORACLE_SQL["utterance_emotion"] = f"WITH {_SCORED} SELECT doc_id, utt_idx::BIGINT AS utt_idx, n_words, emotion, confidence FROM e"


@query
def emotion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = speech.with_emotion(speech.averages(speech.utterances(_words(spark, sf_dir))))
    return rows.groupBy("emotion").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


ORACLE_SQL["emotion_counts"] = f"WITH {_SCORED} SELECT emotion, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM e GROUP BY emotion"


@query
def word_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech.deviations(speech.utterances(_words(spark, sf_dir))).select("doc_id", "word_idx", "pitch", "volume", "strong")


ORACLE_SQL["word_deviation"] = f"WITH {_DEVIATED} SELECT doc_id, word_idx, pitch, volume, strong FROM d"


@query
def pause_insertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech.gaps(speech.utterances(_words(spark, sf_dir))).select("doc_id", "word_idx", "gap_ms", "pause_ms")


ORACLE_SQL["pause_insertion"] = f"WITH {_DEVIATED} SELECT doc_id, word_idx, gap_ms, pause_ms FROM d"


@query
def assembled_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech.assembled(_words(spark, sf_dir))


ORACLE_SQL["assembled_markup"] = f"""WITH {_SCORED}{_DEVIATED[len(_GROUPED):]},
t AS (
  SELECT *, pitch IS NOT NULL OR volume IS NOT NULL AS tagged,
         lag(pitch IS NOT NULL OR volume IS NOT NULL) OVER (PARTITION BY doc_id, utt_idx ORDER BY word_idx) AS was
  FROM d),
x AS (
  SELECT *, CASE WHEN pause_ms IS NOT NULL THEN '<pause duration="' || pause_ms || '"/>' WHEN gap_ms > 0 THEN ' '
                 WHEN NOT tagged AND NOT was AND gap_ms <= 0 THEN ' ' ELSE '' END AS lead,
         CASE WHEN tagged THEN '<prosody' || coalesce(' pitch="' || pitch || '"', '') || coalesce(' volume="' || volume || '"', '') || '>' || word || '</prosody>' ELSE word END AS body
  FROM t),
y AS (
  SELECT doc_id, utt_idx, string_agg(lead || CASE WHEN strong THEN '<emphasis level="strong">' || body || '</emphasis>' ELSE body END, '' ORDER BY word_idx) AS inner_
  FROM x GROUP BY doc_id, utt_idx),
z AS (
  SELECT y.doc_id, y.utt_idx, '<utterance emotion="' || emotion || '" confidence="' || confidence::VARCHAR || '">' || inner_ || '</utterance>' AS one
  FROM y JOIN e ON y.doc_id = e.doc_id AND y.utt_idx = e.utt_idx)
SELECT doc_id, CASE WHEN count(*) = 1 THEN max(one) ELSE '<iml>' || string_agg(one, '' ORDER BY utt_idx) || '</iml>' END AS markup FROM z GROUP BY doc_id"""


def _by_slope(spans: pa.ListArray) -> tuple[pa.Array, pa.Array]:
    """Rising pitch is joyful, falling sad: from the first measured word to the last."""
    f0, edges = spans.flatten().field("f0_mean"), np.concatenate([[0], np.cumsum(spans.value_lengths().to_numpy(zero_copy_only=False))])
    heard = np.flatnonzero(f0.is_valid().to_numpy(zero_copy_only=False))
    values = np.append(f0.fill_null(0.0).to_numpy(zero_copy_only=False)[heard], 0.0)
    first, end = (np.searchsorted(heard, x) for x in (edges[:-1], edges[1:]))
    rise = np.where(end > first, values[end - 1] - values[first], 0.0)
    emotions = np.where(rise > 0, "joyful", np.where(rise < 0, "sad", "neutral"))
    return pa.array(emotions.tolist(), pa.string()), pa.array(np.where(rise == 0, 0.5, 0.75))


@query
def assembled_by_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup whose emotions come from a classifier over the spans in order."""
    return speech.assembled(_words(spark, sf_dir), classify=speech.by_spans(_by_slope))


ORACLE_SQL["assembled_by_slope"] = ORACLE_SQL["assembled_markup"].replace(
    _SCORED[len(_GROUPED):],
    """,
a AS (
  SELECT doc_id, utt_idx, count(*) AS n_words, (arg_max(f0_mean, word_idx) FILTER (WHERE f0_mean IS NOT NULL) - arg_min(f0_mean, word_idx) FILTER (WHERE f0_mean IS NOT NULL)) AS rise
  FROM u GROUP BY doc_id, utt_idx),
e AS (SELECT doc_id, utt_idx, n_words, CASE WHEN rise > 0 THEN 'joyful' WHEN rise < 0 THEN 'sad' ELSE 'neutral' END AS emotion, CASE WHEN coalesce(rise, 0) = 0 THEN 0.5 ELSE 0.75 END::DOUBLE AS confidence FROM a)""",
)


@query
def assembled_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech.assembled(_words(spark, sf_dir), extended=True)


_MORE = " || ".join(
    f"coalesce(' {name}=\"' || {value} || '\"', '')"
    for name, value in {
        "f0_mean": "round_even(f0_mean::DOUBLE, 1)::VARCHAR", "f0_range": f"({_WHOLE('f0_low::DOUBLE')} || '-' || {_WHOLE('f0_high::DOUBLE')})",
        "intensity_mean": "round_even(intensity_mean::DOUBLE, 1)::VARCHAR", "speech_rate": "round_even(speech_rate::DOUBLE, 1)::VARCHAR",
        "jitter": "round_even(jitter::DOUBLE, 4)::VARCHAR", "shimmer": "round_even(shimmer::DOUBLE, 4)::VARCHAR", "hnr": "round_even(hnr::DOUBLE, 1)::VARCHAR",
    }.items()
)
ORACLE_SQL["assembled_extended"] = ORACLE_SQL["assembled_markup"].replace("""coalesce(' volume="' || volume || '"', '') || '>'""", f"""coalesce(' volume="' || volume || '"', '') || {_MORE} || '>'""")


@query
def span_feature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _words(spark, sf_dir)
    measured = words.where("word_idx % 3 < 2")
    again = measured.select("doc_id", "start_ms", "end_ms", F.lit(0).alias("feature_idx"), F.lit(-1.0).alias("measured_f0"))
    last = measured.select("doc_id", "start_ms", "end_ms", F.lit(1).alias("feature_idx"), F.col("f0_span").alias("measured_f0"))
    return speech.joined_features(words.select("doc_id", "word_idx", "start_ms", "end_ms"), again.unionByName(last))


ORACLE_SQL["span_feature_join"] = f"WITH {_GROUPED} SELECT doc_id, word_idx, start_ms, end_ms, CASE WHEN word_idx % 3 < 2 THEN f0_span END AS measured_f0 FROM w"


@query
def voice_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _words(spark, sf_dir)
    return rows.select("doc_id", "word_idx", M.voice_quality(F.col("jitter"), F.col("shimmer"), F.col("hnr")).alias("quality"))


ORACLE_SQL["voice_quality"] = f"""WITH {_GROUPED} SELECT doc_id, word_idx,
CASE WHEN hnr < 7 THEN 'breathy' WHEN jitter > 0.02::DOUBLE THEN 'creaky' WHEN shimmer > 0.12::DOUBLE THEN 'tense' WHEN coalesce(jitter, shimmer, hnr) IS NOT NULL THEN 'modal' END AS quality FROM w"""

_LABELLED = """
SELECT doc_id, word_idx, CASE WHEN f0_mean > 220 THEN 'high' WHEN f0_mean < 150 THEN 'low' WHEN f0_mean IS NOT NULL THEN 'normal' END AS pitch,
       CASE WHEN intensity_mean > 70 THEN 'loud' WHEN intensity_mean < 60 THEN 'quiet' ELSE 'normal' END AS volume,
       CASE WHEN speech_rate > 4.5 THEN 'fast' ELSE 'normal' END AS rate, CASE WHEN shimmer > 0.05 THEN 'tense' ELSE 'modal' END AS quality,
       CASE WHEN jitter > 0.02 THEN 0.9 ELSE 0.6 END AS base_confidence
FROM {words}"""


@query
def profile_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed = spark.sql(_LABELLED, words=_words(spark, sf_dir))
    keys = ["pitch", "volume", "rate", "quality"]
    observed = observed.select(
        "doc_id", "word_idx", F.create_map(*[x for k in keys for x in (F.lit(k), F.col(k))]).alias("labels"), F.lit("neutral").alias("base_emotion"),
        F.col("base_confidence").cast("double").alias("base_confidence"),
    )
    table = spark.createDataFrame(A.PROFILE, "mapping_idx int, pattern map<string,string>, emotion string, boost double")
    out = profiles.applied(observed, table, ["doc_id", "word_idx"])
    return out.select("doc_id", "word_idx", "emotion", F.round("confidence", 6).alias("confidence"), "mapping_idx")


ORACLE_SQL["profile_apply"] = f"""WITH {_GROUPED}, o AS ({_LABELLED.replace('{words}', 'w')}),
m AS (
  SELECT *, CASE WHEN pitch = 'high' AND volume = 'loud' THEN 0 WHEN quality = 'tense' AND rate = 'fast' THEN 1 WHEN pitch = 'low' THEN 2 END AS mapping_idx
  FROM o)
SELECT doc_id, word_idx, coalesce(['excited', 'anxious', 'calm'][mapping_idx + 1], 'neutral') AS emotion,
       round(least(1.0::DOUBLE, base_confidence::DOUBLE + coalesce([0.2, 0.15, 0.1][mapping_idx + 1], 0)::DOUBLE), 6) AS confidence, mapping_idx::INT AS mapping_idx
FROM m"""


@query
def profile_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    c = F.col("c_custkey")
    pattern = F.when(c % 3 == 0, F.create_map().cast("map<string,string>")).when(c % 3 == 1, F.create_map(F.lit("pitch"), F.lit("high"))).otherwise(F.create_map(F.lit("pitch"), F.lit("odd"), F.lit("mood"), F.lit("x")))
    mapping = F.struct(pattern.alias("pattern"), F.struct(F.when(c % 7 == 0, "").otherwise("calm").alias("emotion"), ((c % 4) / 2.0).alias("confidence_boost")).alias("interpretation"))
    table = rows.select(
        F.when(c % 5 == 0, "1.0").otherwise("1.0.0").alias("profile_version"), F.when(c % 13 == 0, "").otherwise(c.cast("string")).alias("user_id"), F.lit(None).cast("string").alias("description"),
        F.when(c % 11 == 0, F.array().cast("array<struct<pattern:map<string,string>,interpretation:struct<emotion:string,confidence_boost:double>>>")).otherwise(F.array(mapping)).alias("prosody_mappings"),
    )
    return profiles.profile_issues(table).groupBy("rule", "severity").agg(F.count("*").alias("n"))


ORACLE_SQL["profile_rules"] = """WITH c AS (SELECT c_custkey AS k FROM customer), r AS (
SELECT 'P1' AS rule, 'error' AS severity FROM c WHERE k % 5 = 0 UNION ALL SELECT 'P2', 'error' FROM c WHERE k % 13 = 0 UNION ALL SELECT 'P3', 'error' FROM c WHERE k % 11 = 0
UNION ALL SELECT 'P4', 'error' FROM c WHERE k % 3 = 0 AND k % 11 <> 0 UNION ALL SELECT 'P5', 'warning' FROM c WHERE k % 3 = 2 AND k % 11 <> 0
UNION ALL SELECT 'P6', 'warning' FROM c WHERE k % 3 = 2 AND k % 11 <> 0 UNION ALL SELECT 'P7', 'error' FROM c WHERE k % 7 = 0 AND k % 11 <> 0
UNION ALL SELECT 'P8', 'error' FROM c WHERE k % 4 = 3 AND k % 11 <> 0)
SELECT rule, severity, count(*) AS n FROM r GROUP BY ALL"""

_USER_PROFILES = """
SELECT CAST(c_custkey AS BIGINT) AS user_id, i AS mapping_idx,
       CASE (c_custkey + i) % 6 WHEN 0 THEN 'pitch=high' WHEN 1 THEN 'volume=loud;pitch=high' WHEN 2 THEN 'rate=fast;quality=tense'
            WHEN 3 THEN 'volume=normal;rate=normal;quality=modal' WHEN 4 THEN 'pitch=odd;rate=normal' ELSE 'volume=quiet' END AS asks,
       CASE i WHEN 0 THEN 'calm' WHEN 1 THEN 'excited' ELSE 'anxious' END AS emotion, (c_custkey % 4 + i) / 10.0 AS boost
FROM {customer}, (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2) x"""


@query
def profile_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word under the profile of its customer."""
    labels = ["pitch", "volume", "rate", "quality"]
    words = spark.sql(_LABELLED, words=_words(spark, sf_dir))
    users = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").cast("long").alias("user_id"))
    observed = words.join(users, "doc_id").select(
        "user_id", "doc_id", "word_idx", F.create_map(*[x for k in labels for x in (F.lit(k), F.col(k))]).alias("labels"), F.lit("neutral").alias("base_emotion"), F.col("base_confidence").cast("double").alias("base_confidence")
    )
    rows = A.view(spark, _USER_PROFILES, sf_dir, "customer").select("user_id", "mapping_idx", F.str_to_map("asks", F.lit(";"), F.lit("=")).alias("pattern"), "emotion", F.col("boost").cast("double").alias("boost"))
    out = profiles.applied_by_user(observed, rows, ["doc_id", "word_idx"])
    return out.select("user_id", "doc_id", "word_idx", "emotion", F.round("confidence", 6).alias("confidence"), "mapping_idx")


ORACLE_SQL["profile_by_user"] = f"""WITH {_GROUPED}, lb AS ({_LABELLED.replace('{words}', 'w')}),
o AS (SELECT o_custkey::BIGINT AS user_id, lb.* FROM lb JOIN orders ON o_orderkey = doc_id),
m AS ({A.duck(_USER_PROFILES)}),
h AS (
  SELECT o.user_id, doc_id, word_idx, base_confidence, mapping_idx, emotion, boost
  FROM o LEFT JOIN m ON m.user_id = o.user_id AND len(list_filter(string_split(asks, ';'),
    lambda x: NOT coalesce(x IN ('pitch=' || pitch, 'volume=' || volume, 'rate=' || rate, 'quality=' || quality), false))) = 0
  QUALIFY row_number() OVER (PARTITION BY doc_id, word_idx ORDER BY len(string_split(asks, ';')) DESC NULLS LAST, mapping_idx) = 1)
SELECT user_id, doc_id, word_idx, coalesce(emotion, 'neutral') AS emotion, round(least(1.0::DOUBLE, base_confidence::DOUBLE + coalesce(boost, 0)::DOUBLE), 6) AS confidence, mapping_idx FROM h"""

_SESSION = f"""
p AS ({A.duck(A.PHONEMES)}),
f AS (
  SELECT session_id, avg(pitch_hz) AS mean_pitch, max(pitch_hz) - min(pitch_hz) AS pitch_range, avg(volume) AS mean_volume,
         max(volume) - min(volume) AS volume_range, avg(breathiness) AS mean_breathiness,
         count(*) / greatest(sum(duration_ms) / 1000.0::DOUBLE, 0.001::DOUBLE) AS speech_rate, count(*) FILTER (WHERE vibrato) / count(*) AS vibrato_ratio, count(*) AS n_events
  FROM p GROUP BY session_id)"""
_SEVEN = ["mean_pitch", "pitch_range", "mean_volume", "volume_range", "mean_breathiness", "speech_rate", "vibrato_ratio"]


@query
def session_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.features(_phonemes(spark, sf_dir)).select("session_id", *_six(*_SEVEN), "n_events")


ORACLE_SQL["session_features"] = f"WITH {_SESSION} SELECT session_id, {', '.join(f'round({c}::DOUBLE, 6) AS {c}' for c in _SEVEN)}, n_events FROM f"


@query
def session_emotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.features(_phonemes(spark, sf_dir)).select("session_id", sessions.emotion().alias("emotion"), F.round(sessions.confidence(), 6).alias("confidence"))


ORACLE_SQL["session_emotion"] = f"""WITH {_SESSION} SELECT session_id,
CASE WHEN mean_volume > 0.8::DOUBLE THEN CASE WHEN mean_pitch > 300 THEN 'angry' ELSE 'joyful' END WHEN mean_breathiness > 0.5::DOUBLE THEN 'sad' WHEN mean_volume < 0.3::DOUBLE THEN 'calm' ELSE 'neutral' END AS emotion,
round(CASE WHEN n_events < 2 THEN 0.5::DOUBLE ELSE least(0.5::DOUBLE + least(volume_range * 0.3::DOUBLE + pitch_range / 500, 0.4::DOUBLE), 0.95::DOUBLE) END, 6) AS confidence FROM f"""


@query
def session_word_prosody(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _phonemes(spark, sf_dir)
    words = events.select("session_id").distinct().select("session_id", F.lit(3).alias("n_words"), F.posexplode(F.array(F.lit("one"), F.lit("two"), F.lit("three"))).alias("word_idx", "word"))
    return sessions.word_prosody(events, words).select("session_id", "word_idx", "word", "pitch", "volume")


ORACLE_SQL["session_word_prosody"] = f"""WITH {_SESSION},
s AS (SELECT p.*, greatest(1, f.n_events // 3) AS per, f.mean_pitch AS mp, f.mean_volume AS mv FROM p JOIN f USING (session_id)),
g AS (SELECT session_id, seq // per AS word_idx, (avg(pitch_hz) - any_value(mp)) / greatest(any_value(mp), 1) * 100 AS dev, avg(volume) / greatest(any_value(mv), 0.001::DOUBLE) AS ratio FROM s GROUP BY session_id, seq // per),
h AS (SELECT *, 20 * log10(greatest(ratio, 0.001::DOUBLE)) AS db, abs(dev) > 10 OR abs(ratio - 1) > 0.3::DOUBLE AS tagged FROM g),
w AS (SELECT session_id, unnest([0, 1, 2]) AS word_idx, unnest(['one', 'two', 'three']) AS word FROM f)
SELECT session_id, word_idx::INT AS word_idx, word, CASE WHEN tagged THEN CASE WHEN dev > 0 THEN '+' ELSE '' END || {_WHOLE('dev')} || '%' END AS pitch,
       CASE WHEN tagged THEN CASE WHEN db >= 0 THEN '+' ELSE '' END || {_WHOLE('db')} || 'dB' END AS volume
FROM w LEFT JOIN h USING (session_id, word_idx)"""


@query
def session_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _phonemes(spark, sf_dir)
    return sessions.session_markup(events, events.select("session_id").distinct().withColumn("transcript", F.lit("one & two"))).select("session_id", "markup")


def _session_markup(emotion: str) -> str:
    tagged = f"""'<prosody pitch="' || CASE WHEN dev > 0 THEN '+' ELSE '' END || {_WHOLE('dev')} || '%" volume="' || CASE WHEN db >= 0 THEN '+' ELSE '' END || {_WHOLE('db')} || 'dB">' || word || '</prosody>'"""
    own, feeling, sure = ORACLE_SQL["session_word_prosody"].split("w AS (")[0], ORACLE_SQL["session_emotion"].split("session_id,")[-1].split(" AS emotion")[0], ORACLE_SQL["session_emotion"].split("round(")[1].split(", 6)")[0]
    return f"""{own}w AS (SELECT session_id, unnest([0, 1, 2]) AS word_idx, unnest(['one', '&amp;', 'two']) AS word FROM f),
i AS (SELECT session_id, string_agg(CASE WHEN tagged THEN {tagged} ELSE word END, ' ' ORDER BY word_idx) AS inner_ FROM w LEFT JOIN h USING (session_id, word_idx) GROUP BY session_id),
z AS (SELECT session_id, n_events, {emotion.replace('EMOTION', feeling)} AS emotion, {sure} AS confidence, inner_ FROM f JOIN i USING (session_id)),
sm AS (SELECT session_id, n_events, emotion, '<utterance emotion="' || emotion || '" confidence="' || printf('%.2f', round(confidence, 2)) || '">' || inner_ || '</utterance>' AS markup FROM z)"""


ORACLE_SQL["session_markup"] = f"{_session_markup('EMOTION')} SELECT session_id, markup FROM sm"


@query
def session_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _phonemes(spark, sf_dir)
    given = F.when(F.length("session_id") % 2 == 0, "surprised")
    made = sessions.entries(events, events.select("session_id").distinct().select("session_id", F.lit("one & two").alias("transcript"), given.alias("emotion_label")))
    return made.drop("timestamp").withColumn("metadata", F.element_at("metadata", "mavis_events"))


ORACLE_SQL["session_entries"] = f"""{_session_markup("CASE WHEN length(session_id) % 2 = 0 THEN 'surprised' ELSE EMOTION END")}
SELECT 'mavis_' || session_id AS id, 'mavis' AS source, 'en-US' AS language, 'audio/' || session_id || '.wav' AS audio_file, 'one & two' AS transcript, markup AS iml,
       emotion AS emotion_label, 'model' AS annotator, true AS consent, NULL::VARCHAR AS speaker_id, n_events::VARCHAR AS metadata FROM sm"""

_PRED = f"p AS (SELECT truth, predicted, confidence::DOUBLE AS confidence, truth = predicted AS correct, doc_id FROM ({A.duck(A.PREDICTION)}))"


@query
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_predictions(spark, sf_dir))


ORACLE_SQL["confusion"] = f"WITH {_PRED} SELECT truth, predicted, count(*) AS n FROM p GROUP BY ALL"


@query
def label_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.labels(_predictions(spark, sf_dir))


ORACLE_SQL["label_union"] = f"WITH {_PRED} SELECT truth AS label FROM p UNION SELECT predicted FROM p"


@query
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_report(_predictions(spark, sf_dir)).select("label", *_six("precision", "recall", "f1"), "support")


_REPORT = f"""{_PRED},
l AS (SELECT truth AS label FROM p UNION SELECT predicted FROM p),
c AS (SELECT label, (SELECT count(*) FROM p WHERE truth = label AND correct) AS tp, (SELECT count(*) FROM p WHERE truth = label) AS support, (SELECT count(*) FROM p WHERE predicted = label) AS claimed FROM l),
q AS (SELECT label, support, CASE WHEN claimed = 0 THEN 0 ELSE tp / claimed END::DOUBLE AS pr, CASE WHEN support = 0 THEN 0 ELSE tp / support END::DOUBLE AS re FROM c),
r AS (SELECT label, pr, re, CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END::DOUBLE AS f1, support FROM q)"""
ORACLE_SQL["classification_report"] = f"WITH {_REPORT} SELECT label, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM r"


@query
def macro_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.macro(metrics.class_report(_predictions(spark, sf_dir))).select(*_six("macro_precision", "macro_recall", "macro_f1"))


ORACLE_SQL["macro_report"] = f"WITH {_REPORT} SELECT round(avg(pr), 6) AS macro_precision, round(avg(re), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 FROM r"


@query
def calibration_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _predictions(spark, sf_dir)
    return metrics.calibration_error(rows).select(F.round("ece", 6).alias("ece"), rows.select(F.round(metrics.accuracy(F.col("correct")), 6)).scalar().alias("accuracy"))


_ECE = f"""{_PRED},
e AS (SELECT k, k * 0.1::DOUBLE AS lo, (k + 1) * 0.1::DOUBLE AS hi FROM range(10) x(k)),
b AS (SELECT k, count(*) AS n, avg(confidence) AS c, avg(correct::INT) AS a FROM p JOIN e ON confidence >= lo AND (confidence < hi OR (k = 9 AND confidence <= hi)) GROUP BY k)"""
ORACLE_SQL["calibration_ece"] = f"WITH {_ECE} SELECT round(sum(n * abs(a - c)) / (SELECT count(*) FROM p), 6) AS ece, (SELECT round(avg(correct::INT), 6) FROM p) AS accuracy FROM b"


@query
def regression_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _predictions(spark, sf_dir)
    now = rows.agg(
        F.round(metrics.accuracy(F.col("correct")), 4).alias("emotion_accuracy"), F.lit(0.0).alias("pitch_accuracy"), F.lit(1.0).alias("pause_f1"), F.lit(1.0).alias("validity_rate"), F.lit(0.05).alias("confidence_ece")
    )
    was = spark.createDataFrame([(1.0, 0.005, 0.9, 1.0, 0.01)], "emotion_accuracy double, pitch_accuracy double, pause_f1 double, validity_rate double, confidence_ece double")
    return metrics.regressions(now, was, {"emotion_accuracy": 0.95, "confidence_ece": 0.1, "unknown": 2.0})


ORACLE_SQL["regression_check"] = f"""WITH {_PRED}, a AS (SELECT round(avg(correct::INT), 4) AS v FROM p),
m AS (SELECT 'emotion_accuracy' AS metric, 'emotion_accuracy = ' || format('{{:.4f}}', v) || ' < threshold 0.9500' AS message FROM a WHERE v < 0.95
UNION ALL SELECT 'emotion_accuracy', 'emotion_accuracy regressed: ' || format('{{:.4f}}', v) || ' < baseline 1.0000' FROM a WHERE v < 0.99
UNION ALL SELECT 'confidence_ece', 'confidence_ece regressed: 0.0500 > baseline 0.0100')
SELECT * FROM m"""


@query
def contour_zip_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _words(spark, sf_dir).select(F.col("doc_id").alias("entry_id"), F.col("word_idx").alias("pos"), "f0_mean", "f0_span")
    label = lambda c: F.when(c > 200, "rise").when(c < 60, "fall").otherwise("flat")
    truth = words.select("entry_id", "pos", label(F.col("f0_mean")).alias("label"))
    guess = words.where("pos > 0").select("entry_id", "pos", label(F.col("f0_span") * 3).alias("label"))
    pairs = metrics.contour_pairs(truth, guess)
    return pairs.agg(F.count("*").alias("n"), F.round(metrics.accuracy(F.col("truth") == F.col("predicted")), 6).alias("pitch_accuracy"))


ORACLE_SQL["contour_zip_accuracy"] = f"""WITH {_GROUPED},
t AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY word_idx) AS k, CASE WHEN f0_mean > 200 THEN 'rise' WHEN f0_mean < 60 THEN 'fall' ELSE 'flat' END AS a FROM w),
g AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY word_idx) AS k, CASE WHEN f0_span * 3 > 200 THEN 'rise' WHEN f0_span * 3 < 60 THEN 'fall' ELSE 'flat' END AS b FROM w WHERE word_idx > 0)
SELECT count(*) AS n, round(avg((a = b)::INT), 6) AS pitch_accuracy FROM t JOIN g USING (doc_id, k)"""


@query
def pause_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = speech.gaps(speech.utterances(_words(spark, sf_dir))).where("pause_ms IS NOT NULL")
    truth = gaps.select("doc_id", F.lit("t").alias("side"), F.col("word_idx").alias("ord"), F.col("pause_ms").alias("ms"))
    guess = gaps.where("word_idx % 4 > 0").select("doc_id", F.lit("p").alias("side"), F.col("word_idx").alias("ord"), (F.col("pause_ms") + (F.col("doc_id") % 300)).alias("ms"))
    return metrics.pause_scores(truth.unionByName(guess), "doc_id").select("doc_id", "tp", "n_predicted", "n_truth", F.round("f1", 6).alias("f1"))


ORACLE_SQL["pause_f1"] = f"""WITH RECURSIVE {_DEVIATED},
n AS (SELECT doc_id, word_idx, pause_ms FROM d WHERE pause_ms IS NOT NULL),
t AS (SELECT doc_id, list(pause_ms::BIGINT ORDER BY word_idx) AS ts, coalesce(list(pause_ms::BIGINT + doc_id % 300 ORDER BY word_idx) FILTER (WHERE word_idx % 4 > 0), []) AS ps FROM n GROUP BY doc_id),
m AS (
  SELECT doc_id, ps, len(ts) AS n_truth, ts AS free, 0 AS k, 0 AS tp FROM t
  UNION ALL
  SELECT doc_id, ps, n_truth, CASE WHEN best <= 200 THEN list_concat(free[1:place - 1], free[place + 1:]) ELSE free END, k + 1, tp + CASE WHEN best <= 200 THEN 1 ELSE 0 END
  FROM (SELECT *, list_min(diffs) AS best, list_position(diffs, list_min(diffs)) AS place FROM (SELECT *, list_transform(free, lambda x: abs(x - ps[k + 1])) AS diffs FROM m WHERE k < len(ps))))
SELECT doc_id, tp::BIGINT AS tp, len(ps)::BIGINT AS n_predicted, n_truth::BIGINT AS n_truth, round(2.0::DOUBLE * tp / (len(ps) + n_truth), 6) AS f1 FROM m WHERE k = len(ps)"""


@query
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.sentences(_cued(spark, sf_dir)).select("doc_id", F.col("sent_idx").cast("long").alias("sent_idx"), "sentence")


_SENT = rf"""
c AS ({A.duck(A.CUED_TEXT)}),
s0 AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(30), 'g'), chr(30)), lambda x: trim(x)), lambda x: x <> '') AS ss FROM c),
s AS (SELECT doc_id, unnest(ss) AS sentence, unnest(range(len(ss))) AS sent_idx FROM s0)"""
ORACLE_SQL["sentence_split"] = f"WITH {_SENT} SELECT doc_id, sent_idx, sentence FROM s"


@query
def quoted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.sentences(_cued(spark, sf_dir))
    spans, rest = text.quotes(F.col("sentence"))
    return rows.select("doc_id", F.col("sent_idx").cast("long").alias("sent_idx"), F.array_join(spans, "|").alias("quotes"), rest.alias("rest"))


_QUOTE = '"[^"]+"|“[^”]+”'
ORACLE_SQL["quoted_spans"] = rf"""WITH {_SENT}
SELECT doc_id, sent_idx, array_to_string(list_transform(regexp_extract_all(sentence, '{_QUOTE}'), lambda q: q[2:-2]), '|') AS quotes,
       regexp_replace(trim(regexp_replace(sentence, '{_QUOTE}', '', 'g')), '\s{{2,}}', ' ', 'g') AS rest FROM s"""


@query
def sentence_emotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    emotion, sure = text.emotion_of(F.col("sentence"), F.col("cues"))
    rows = text.with_cues(text.sentences(_cued(spark, sf_dir)), "sentence")
    return rows.select("doc_id", F.col("sent_idx").cast("long").alias("sent_idx"), emotion.alias("emotion"), sure.cast("double").alias("rule_confidence"))


_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_STRIP = "'" + text.PUNCTUATION.replace("'", "''") + "'"
_COUNT = lambda words: f"len(list_filter(ws, lambda x: list_contains({_LIST(words)}, x)))"
ORACLE_SQL["sentence_emotion"] = rf"""WITH {_SENT},
t AS (SELECT *, list_transform(list_filter(regexp_split_to_array(sentence, '\s+'), lambda x: x <> ''), lambda x: lower(trim(x, {_STRIP}))) AS ws FROM s),
k AS (SELECT *, {_COUNT(text.POSITIVE)} AS p, {_COUNT(text.NEGATIVE)} AS n, {_COUNT(text.UNCERTAIN)} AS u, rtrim(sentence) LIKE '%!' AS loud FROM t)
SELECT doc_id, sent_idx,
  CASE WHEN loud AND n > p THEN 'frustrated' WHEN loud THEN 'joyful' WHEN n > p AND n > u THEN 'frustrated' WHEN p > n AND p > u THEN 'joyful' WHEN u > 0 AND u >= p AND u >= n THEN 'uncertain' END AS emotion,
  CASE WHEN loud THEN 0.55 WHEN (n > p AND n > u) OR (p > n AND p > u) THEN 0.45 WHEN u > 0 AND u >= p AND u >= n THEN 0.4 END::DOUBLE AS rule_confidence FROM k"""


@query
def text_to_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.predicted(_cued(spark, sf_dir))


def _esc(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


ORACLE_SQL["text_to_markup"] = rf"""WITH {_SENT},
q AS (
  SELECT doc_id, sent_idx, list_concat([regexp_replace(trim(regexp_replace(sentence, '{_QUOTE}', '', 'g')), '\s{{2,}}', ' ', 'g')], list_transform(regexp_extract_all(sentence, '{_QUOTE}'), lambda q: q[2:-2])) AS ps
  FROM s),
pt AS (SELECT doc_id, sent_idx, unnest(ps) AS t, unnest(range(len(ps))) AS pi FROM q),
v AS (
  SELECT *, list_transform(regexp_split_to_array(t, '\.{{3,}}|…'), lambda x: trim(x)) AS parts,
         list_transform(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> ''), lambda x: lower(trim(x, {_STRIP}))) AS ws,
         rtrim(t) LIKE '%!' AS loud, rtrim(t) LIKE '%?' OR (regexp_matches(t, '\.{{3,}}|…') AND t LIKE '%?%') AS ask
  FROM pt WHERE trim(t) <> '' OR pi > 0),
i AS (
  SELECT *, array_to_string(list_transform(parts, lambda p, k:
     CASE WHEN p = '' THEN '' ELSE CASE WHEN len(list_filter(parts[1:k - 1], lambda z: z <> '')) > 0 THEN ' ' ELSE '' END ||
       array_to_string(list_transform(regexp_split_to_array(p, '\s+'), lambda w: CASE WHEN regexp_matches(trim(w, {_STRIP}), '^[A-Z]{{2,}}$')
          THEN '<emphasis level="strong">' || {_esc('w')} || '</emphasis>' ELSE {_esc('w')} END), ' ') END ||
     CASE WHEN k < len(parts) AND (p <> '' OR len(list_filter(parts[1:k - 1], lambda z: z <> '')) > 0) THEN '<pause duration="500"/>' ELSE '' END), '') AS inn,
     {_COUNT(text.POSITIVE)} AS p, {_COUNT(text.NEGATIVE)} AS n, {_COUNT(text.UNCERTAIN)} AS u
  FROM v),
m AS (
  SELECT *, CASE WHEN loud AND n > p THEN 'frustrated' WHEN loud THEN 'joyful' WHEN n > p AND n > u THEN 'frustrated' WHEN p > n AND p > u THEN 'joyful' WHEN u > 0 AND u >= p AND u >= n THEN 'uncertain' END AS emotion
  FROM i),
o AS (
  SELECT doc_id, string_agg(coalesce('<utterance emotion="' || emotion || '" confidence="0.6">', '<utterance>') ||
    CASE WHEN inn = '' THEN '' WHEN ask THEN '<prosody pitch_contour="rise">' || inn || '</prosody>' WHEN loud THEN '<prosody pitch="+5%">' || inn || '</prosody>' ELSE inn END || '</utterance>', '' ORDER BY sent_idx, pi) AS b
  FROM m GROUP BY doc_id)
SELECT doc_id, '<iml version="0.1.0">' || coalesce(b, '<utterance></utterance>') || '</iml>' AS markup FROM c LEFT JOIN o USING (doc_id)"""


@query
def token_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.word_features(spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.concat_ws("/", "conv_id", "turn").alias("doc_id"), "text"))
    return rows.withColumn("position_ratio", F.round("position_ratio", 6))


ORACLE_SQL["token_features"] = r"""
WITH t AS (SELECT conv_id || '/' || turn AS doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM conversations),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos, len(ws) AS n FROM t),
c AS (SELECT *, trim(w, '.,!?;:"''()-') AS k FROM w)
SELECT doc_id, pos, length(k)::DOUBLE AS word_length, round(pos / greatest(n - 1, 1), 6) AS position_ratio,
  (upper(k[1]) = k[1] AND lower(k[1]) <> k[1])::INT::DOUBLE AS is_capitalized, (w <> k)::INT::DOUBLE AS has_punctuation, pos::DOUBLE AS sentence_position,
  coalesce(lag(length(k)) OVER o, 0)::DOUBLE AS prev_word_length, coalesce(lead(length(k)) OVER o, 0)::DOUBLE AS next_word_length
FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY pos)"""


@query
def node_shred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).where("kind <> 'error'").groupBy("kind").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"))


_NODE_COUNTS = {  # nodes of each kind in the markup variants that parse
    0: {"utterance": 1, "prosody": 1, "text": 3}, 1: {"iml": 1, "utterance": 2, "pause": 1, "text": 3}, 2: {"utterance": 1, "text": 1}, 3: {"utterance": 1, "text": 1},
    4: {"utterance": 1, "pause": 3, "text": 1}, 5: {"utterance": 1, "pause": 1, "text": 1}, 6: {"utterance": 1, "emphasis": 2, "text": 3}, 7: {"utterance": 1, "prosody": 1, "segment": 1, "text": 1},
    8: {"utterance": 1, "segment": 2, "text": 1}, 9: {"utterance": 1, "prosody": 2, "emphasis": 1, "text": 1}, 10: {"utterance": 1, "unknown": 1, "pause": 1, "text": 2}, 11: {"iml": 1, "text": 1},
    12: {"unknown": 1, "text": 1}, 14: {"utterance": 1, "emphasis": 1, "comment": 1, "text": 1}, 15: {"iml": 1, "utterance": 1, "prosody": 1, "text": 2},
}
_DEEPEST = {"iml": 0, "utterance": 1, "prosody": 3, "text": 4, "pause": 2, "emphasis": 2, "segment": 2, "unknown": 1, "comment": 1}
ORACLE_SQL["node_shred"] = f"""WITH v(variant, kind, k) AS (VALUES {', '.join(f"({v}, '{kind}', {n})" for v, m in _NODE_COUNTS.items() for kind, n in m.items())}),
d(kind, deepest) AS (VALUES {', '.join(f"('{k}', {n})" for k, n in _DEEPEST.items())})
SELECT kind, sum(k)::BIGINT AS n, any_value(deepest)::INT AS deepest FROM orders JOIN v ON o_orderkey % 16 = variant JOIN d USING (kind) GROUP BY kind"""

@query
def node_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by SQL, with the shredder as a table function."""
    shred.register(spark)
    # dealt to tasks: a file of one row group would be parsed by one
    docs = shred.dealt(A.view(spark, A.MARKUP, sf_dir, "orders"), "doc_id")
    return spark.sql("SELECT n.kind, count(*) AS n, max(n.depth) AS deepest FROM {docs} d, LATERAL shred_markup(d.doc_id, d.markup) n WHERE n.kind <> 'error' GROUP BY n.kind", docs=docs)


ORACLE_SQL["node_table"] = ORACLE_SQL["node_shred"]

_BROKEN = {
    2: ["V3"], 3: ["V4", "V15"], 4: ["V5", "V6", "V6"], 5: ["V7"], 6: ["V8", "V9"], 7: ["V13", "V14", "V10"], 8: ["V10", "V11"], 9: ["V12"], 10: ["V16"], 11: ["V17", "V18", "V2"], 12: ["V2"], 13: ["V1"], 15: ["V4"],
}


@query
def validate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.markup_issues(_nodes(spark, sf_dir)).groupBy("doc_id", "rule").agg(F.count("*").alias("n"))


ORACLE_SQL["validate_rules"] = f"""WITH v(variant, rule) AS (VALUES {', '.join(f"({v}, '{r}')" for v, rs in _BROKEN.items() for r in rs)})
SELECT o_orderkey AS doc_id, rule, count(*) AS n FROM orders JOIN v ON o_orderkey % 16 = variant GROUP BY o_orderkey, rule"""


@query
def validity_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.markup_valid(_nodes(spark, sf_dir)).agg(F.count("*").alias("n"), F.round(metrics.accuracy(F.col("valid")), 6).alias("validity_rate"))


ORACLE_SQL["validity_rate"] = "SELECT count(*) AS n, round(avg((o_orderkey % 16 IN (0, 1, 9, 10, 14))::INT), 6) AS validity_rate FROM orders"


@query
def validate_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("html").alias("markup"))
    return validate.markup_issues(shred.shredded(pages)).groupBy("doc_id", "rule").agg(F.count("*").alias("n"))


_PLAIN = """CASE o_orderkey % 16 WHEN 0 THEN 'order ' || w || ' done' WHEN 1 THEN 'a & ' || w || ' bc' WHEN 4 THEN ' ' || w || '  ' WHEN 5 THEN ' ' WHEN 6 THEN w || ' x'
  WHEN 10 THEN w || ' in ' WHEN 11 THEN '' ELSE w END"""


@query
def markup_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.plain_text(_nodes(spark, sf_dir))


ORACLE_SQL["markup_plain_text"] = f"SELECT o_orderkey AS doc_id, {_PLAIN} AS plain FROM (SELECT *, lower(substr(o_orderpriority, 3, 4)) AS w FROM orders) WHERE o_orderkey % 16 NOT IN (12, 13)"


@query
def markup_serialised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.serialised(_nodes(spark, sf_dir))


ORACLE_SQL["markup_serialised"] = f"""SELECT doc_id, CASE variant
  WHEN 4 THEN '<utterance><pause duration="0"/>' || word || '<pause duration="-5"/><pause duration="0"/></utterance>'
  WHEN 5 THEN '<utterance><pause duration="10"/></utterance>'
  WHEN 6 THEN '<utterance><emphasis level="">' || word || '</emphasis> <emphasis level="huge">x</emphasis></utterance>'
  WHEN 10 THEN '<utterance>' || word || ' in </utterance>'
  WHEN 11 THEN '<iml consent="none" processing="hybrid"></iml>'
  WHEN 14 THEN '<utterance emotion="sad" confidence="nan"><emphasis level="reduced">' || word || '</emphasis></utterance>'
  WHEN 15 THEN '<iml version="1.0"><utterance emotion="sad">' || word || '</utterance></iml>' ELSE markup END AS markup
FROM ({A.duck(A.MARKUP)}) WHERE variant NOT IN (12, 13)"""


@query
def markup_to_ssml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.to_ssml(_nodes(spark, sf_dir))


ORACLE_SQL["markup_to_ssml"] = f"""SELECT doc_id, '<speak version="1.0" xmlns="http://www.w3.org/2001/10/synthesis"' || CASE WHEN variant = 1 THEN ' xml:lang="en-US"' ELSE '' END || '>' || CASE variant
  WHEN 0 THEN '<s>order <prosody pitch="+10%" volume="-3dB">' || word || '</prosody> done</s>'
  WHEN 1 THEN '<s>a &amp; ' || word || '<break time="500ms"/>b</s><s>c</s>'
  WHEN 4 THEN '<s><break time="0ms"/>' || word || '<break time="-5ms"/><break time="0ms"/></s>'
  WHEN 5 THEN '<s><break time="10ms"/></s>'
  WHEN 6 THEN '<s><emphasis>' || word || '</emphasis> <emphasis level="huge">x</emphasis></s>'
  WHEN 7 THEN '<s><prosody pitch="high" volume="loud">' || word || '</prosody></s>'
  WHEN 9 THEN '<s><prosody pitch="+1st"><emphasis level="strong"><prosody pitch="90Hz">' || word || '</prosody></emphasis></prosody></s>'
  WHEN 10 THEN '<s>' || word || ' in </s>' WHEN 11 THEN '' WHEN 14 THEN '<s><emphasis level="reduced">' || word || '</emphasis></s>' ELSE '<s>' || word || '</s>' END || '</speak>' AS ssml
FROM ({A.duck(A.MARKUP)}) WHERE variant NOT IN (12, 13)"""


@query
def render_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.rendered_samples(_nodes(spark, sf_dir))


ORACLE_SQL["render_samples"] = f"""WITH t AS (SELECT o_orderkey AS doc_id, o_orderkey % 16 AS v, len(list_filter(regexp_split_to_array(lower(substr(o_orderpriority, 3, 4)), '\\s+'), lambda x: x <> '')) AS k FROM orders)
SELECT doc_id, (CASE v WHEN 0 THEN (2 + k) * 5512 + greatest(k - 1, 0) * 1102 WHEN 1 THEN (2 + k) * 5512 + (1 + k) * 1102 + 11025 + 5512 + 6615 + 5512
  WHEN 4 THEN k * 5512 + greatest(k - 1, 0) * 1102 + floor(22050 * (-5 / 1000.0))::BIGINT WHEN 5 THEN 220 WHEN 6 THEN (k + 1) * 5512 + greatest(k - 1, 0) * 1102
  WHEN 10 THEN (k + 1) * 5512 + greatest(k - 1, 0) * 1102 WHEN 11 THEN 2205 ELSE k * 5512 + greatest(k - 1, 0) * 1102 END)::BIGINT AS n_samples FROM t WHERE v NOT IN (12, 13)"""


@query
def pitch_to_hz(spark: SparkSession, sf_dir: str) -> DataFrame:
    voiced = nodes.voices(_nodes(spark, sf_dir))
    return voiced.select("doc_id", "pre", F.round("frequency", 6).alias("frequency"), F.round("amplitude", 6).alias("amplitude")).where("frequency <> 180 OR amplitude <> 0.5")


ORACLE_SQL["pitch_to_hz"] = """SELECT doc_id, pre::INT AS pre, round(f, 6) AS frequency, round(a, 6) AS amplitude FROM (SELECT o_orderkey AS doc_id, o_orderkey % 16 AS variant FROM orders) JOIN
(VALUES (0, 3, 180 * 1.1::DOUBLE, 0.5::DOUBLE * pow(10.0::DOUBLE, -3 / 20.0::DOUBLE)), (6, 2, 180 * 1.1::DOUBLE, 0.65::DOUBLE), (6, 5, 180 * 1.1::DOUBLE, 0.65::DOUBLE), (9, 4, 90::DOUBLE, 0.75::DOUBLE), (14, 2, 180 * 1.05::DOUBLE, 0.55::DOUBLE)) x(variant, pre, f, a) USING (variant)"""

_VOLUMES = """SELECT DISTINCT concat(CASE WHEN l_linenumber % 2 = 0 THEN '+' ELSE '-' END, CAST(CAST(l_quantity AS INT) AS STRING), CASE WHEN l_partkey % 3 = 0 THEN '.5' ELSE '' END, CASE WHEN l_partkey % 7 = 0 THEN 'x' ELSE 'dB' END) AS volume FROM {lineitem}"""


@query
def volume_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_VOLUMES, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    return rows.select("volume", M.volume_to_ssml(F.col("volume")).alias("ssml"), F.round(M.volume_to_amplitude(F.col("volume")), 6).alias("amplitude"))


ORACLE_SQL["volume_map"] = f"""WITH v AS ({A.duck(_VOLUMES).replace('STRING', 'VARCHAR')}), n AS (SELECT volume, CASE WHEN volume LIKE '%dB' THEN replace(volume, 'dB', '')::DOUBLE END AS db FROM v)
SELECT volume, CASE WHEN db IS NULL THEN volume WHEN db <= -20 THEN 'x-soft' WHEN db >= 20 THEN 'x-loud' ELSE CASE WHEN db >= 0 THEN '+' ELSE '' END || format('{{:g}}', db) || 'dB' END AS ssml,
  round(CASE WHEN db IS NULL THEN 0.5::DOUBLE ELSE 0.5::DOUBLE * pow(10.0::DOUBLE, db / 20) END, 6) AS amplitude FROM n"""


@query
def entry_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.view(spark, A.ENTRY, sf_dir, "documents")
    audio = spark.range(40).select(F.concat(F.lit("audio/"), F.col("id").cast("string"), F.lit(".wav")).alias("audio_file"))
    issues = validate.markup_issues(shred.shredded(rows.select("doc_id", "iml"), "doc_id", "iml"))
    return validate.entry_issues(rows, ["doc_id"], issues, audio).groupBy("doc_id", "rule", "severity").agg(F.count("*").alias("n"))


ORACLE_SQL["entry_rules"] = f"""WITH e AS ({A.duck(A.ENTRY)}),
d1 AS (SELECT doc_id, unnest([id, timestamp, source, language, audio_file, transcript, iml, emotion_label, annotator]) AS x FROM e),
r AS (
  SELECT doc_id, 'D1' AS rule, 'error' AS severity FROM d1 WHERE trim(coalesce(x, '')) = ''
  UNION ALL SELECT doc_id, 'D2', 'error' FROM e WHERE NOT consent
  UNION ALL SELECT doc_id, 'D3', 'error' FROM e WHERE source = 'other'
  UNION ALL SELECT doc_id, 'D4', 'error' FROM e WHERE annotator = 'cat'
  UNION ALL SELECT doc_id, 'D5', 'warning' FROM e WHERE timestamp = 'yesterday'
  UNION ALL SELECT doc_id, 'D6', 'warning' FROM e WHERE language = 'english'
  UNION ALL SELECT doc_id, 'D7', 'error' FROM e WHERE doc_id % 13 = 0
  UNION ALL SELECT doc_id, 'D8', 'error' FROM e WHERE doc_id % 50 >= 40)
SELECT doc_id, rule, severity, count(*) AS n FROM r GROUP BY ALL"""


@query
def dataset_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.hashed_split(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"), "doc_id").select("doc_id", "split")


ORACLE_SQL["dataset_split"] = """WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':42'), doc_id) - 1 AS r, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN r < floor(n * 0.8::DOUBLE) THEN 'train' WHEN r < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM h"""


@query
def f0_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select("vec_id", F.posexplode(M.resampled(F.col("embedding"), 20)).alias("k", "f0")).select("vec_id", F.col("k").cast("long").alias("k"), F.round("f0", 6).alias("f0"))


ORACLE_SQL["f0_resample"] = """WITH k AS (SELECT vec_id, embedding AS e, len(embedding) AS n, unnest(range(20)) AS k FROM embeddings),
p AS (SELECT *, k::DOUBLE * (n - 1) / 19 AS x FROM k), q AS (SELECT *, least(floor(x)::BIGINT, n - 2) AS lo FROM p)
SELECT vec_id, k, round(e[lo + 1]::DOUBLE + (e[lo + 2]::DOUBLE - e[lo + 1]::DOUBLE) * (x - lo), 6) AS f0 FROM q"""


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    home = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    source = spark.readStream.schema(schema)
    if home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(home).isDirectory():
        rows = source.parquet(path)
    else:  # a file source watches folders
        rows = source.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.select("user_id", F.col("ts").cast("timestamp").alias("ts"), (80 + F.col("value")).alias("pitch_hz"), F.lit(0.5).alias("volume"), F.lit(100).alias("duration_ms"), (F.col("event_type") == "error").alias("vibrato"), F.lit(0.1).alias("breathiness"))


@query
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streaming.collected(streaming.windowed(_stream(spark, sf_dir), "1 day"), tables.shared_path(spark, "tumbling"))
    return rows.select("user_id", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n_events", F.round("mean_pitch", 6).alias("mean_pitch"))


ORACLE_SQL["stream_tumbling"] = "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_events, round(avg(80 + value), 6) AS mean_pitch FROM events GROUP BY ALL"


@query
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streaming.collected(streaming.gap_sessions(_stream(spark, sf_dir), "8 hours"), tables.shared_path(spark, "gaps"))
    return rows.select("user_id", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n_events", F.round("mean_pitch", 6).alias("mean_pitch"))


ORACLE_SQL["stream_session"] = """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER o < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS c FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n_events, round(avg(80 + value), 6) AS mean_pitch FROM s GROUP BY user_id, s"""


@query
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("ts"))
    return streaming.rate_limited(rows, 2, 86_400.0).groupBy("client").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"))


ORACLE_SQL["rate_limit"] = """WITH RECURSIVE e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events),
r AS (
  SELECT user_id, rn, [ts] AS held, 1 AS n, 1 AS n_ok FROM e WHERE rn = 1
  UNION ALL
  SELECT user_id, rn, CASE WHEN len(kept) < 2 THEN list_append(kept, ts) ELSE kept END, n + 1, n_ok + CASE WHEN len(kept) < 2 THEN 1 ELSE 0 END
  FROM (SELECT e.user_id, e.rn, e.ts, r.n, r.n_ok, list_filter(r.held, lambda x: x > e.ts - INTERVAL 1 DAY) AS kept FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
SELECT user_id AS client, max(n)::BIGINT AS n, max(n_ok)::BIGINT AS n_ok FROM r GROUP BY user_id"""


def _shuffled(spark: SparkSession, rows: DataFrame, time: str, end: DataFrame) -> DataFrame:
    """``rows`` as a stream of four files into which they are dealt by a hash, and last a file with
    the row ``end``, whose ``time`` lets the watermark pass all others."""
    path = tables.shared_path(spark, "shuffled")
    rows.repartition(4, F.xxhash64(*rows.columns)).write.parquet(path)
    end.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query
def assembled_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose words come as a stream, out of order; spoken on a day after the epoch, at which
    watermarks begin."""
    words = _words(spark, sf_dir)
    words = words.select(*(F.col(c).cast("double") if k.startswith("decimal") else F.col(c) for c, k in words.dtypes), F.timestamp_millis(F.col("start_ms") + 1_600_000_000_000).alias("ts"))
    end = spark.range(1).select(*(F.lit(None).cast(k).alias(c) for c, k in words.dtypes if c != "ts"), F.lit("2100-01-01").cast("timestamp").alias("ts"))
    buckets = max(4 * spark.sparkContext.defaultParallelism, words.count() // 50_000)  # what waits in one fits a task
    stream = _shuffled(spark, words, "ts", end.select(words.columns))
    return assembly.assembled_into(stream, tables.shared_path(spark, "assembled"), late="1 day", buckets=buckets)[0]


ORACLE_SQL["assembled_stream"] = ORACLE_SQL["assembled_markup"]


@query
def rate_limit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limiter over requests that come as a stream, out of order."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("ts"))
    buckets = max(4 * spark.sparkContext.defaultParallelism, rows.count() // 100_000)  # what waits in one fits a task
    end = spark.range(1).select(F.lit(None).cast(rows.schema["client"].dataType).alias("client"), F.lit("2200-01-01").cast("timestamp").alias("ts"))
    with assembly.keyed_state(spark):
        stream = assembly.ordered_limit(_shuffled(spark, rows, "ts", end), 2, 86_400.0, late="20000 days", buckets=buckets)
        judged = streaming.collected(stream, tables.shared_path(spark, "limited"), "append")
    return judged.groupBy("client").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"))


ORACLE_SQL["rate_limit_stream"] = ORACLE_SQL["rate_limit"]


@query
def ser_train_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _predictions(spark, sf_dir)
    rows = split.hashed_split(learning.emotion_features(entries, "doc_id", "truth"), "doc_id")
    model = learning.train(rows.where("split = 'train'"), "ser")
    return metrics.class_report(learning.evaluated(model, rows.where("split <> 'train'")))


@query
def contour_train_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _predictions(spark, sf_dir)
    rows = split.hashed_split(learning.contour_features(entries, "doc_id", "truth"), "doc_id")
    model = learning.train(rows.where("split = 'train'"), "pitch_contour")
    return metrics.class_report(learning.evaluated(model, rows.where("split <> 'train'")))


@query
def text_prosody_train_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.concat_ws("/", "conv_id", "turn").alias("doc_id"), "text", "role")
    rows = text.word_features(talk.select("doc_id", "text")).join(talk.select("doc_id", F.col("role").alias("label")), "doc_id")
    rows = rows.withColumn("key", F.concat_ws("#", "doc_id", "pos"))
    # training reads its rows again and again
    parts = tables.written(split.hashed_split(tables.written(rows, "words"), "key"), "word-splits")
    model = learning.train(parts.where("split = 'train'"), "text_prosody")
    return metrics.class_report(learning.evaluated(model, parts.where("split <> 'train'")))


@query
def prosody_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _predictions(spark, sf_dir)
    return rows.select("doc_id", learning.looked_up(F.col("truth"), learning.PROSODY_LABELS, "mid_normal_normal").alias("prosody"), learning.looked_up(F.col("truth"), learning.CONTOUR_LABELS, "flat").alias("contour"))


def _case(table: dict[str, str], default: str) -> str:
    return "CASE truth " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{default}' END"


ORACLE_SQL["prosody_labels"] = f"WITH {_PRED} SELECT doc_id, {_case(learning.PROSODY_LABELS, 'mid_normal_normal')} AS prosody, {_case(learning.CONTOUR_LABELS, 'flat')} AS contour FROM p"


@query
def cue_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.cues(shred.shredded(text.predicted(_cued(spark, sf_dir))))


_TIMES = lambda part: f"((length(markup) - length(replace(markup, '{part}', ''))) // {len(part)})"
ORACLE_SQL["cue_nodes"] = f"""WITH m AS ({ORACLE_SQL["text_to_markup"]}),
k AS (SELECT doc_id, {_TIMES('<pause duration="500"/>')}::BIGINT AS p, {_TIMES('<prosody pitch_contour="rise">')}::BIGINT AS r FROM m)
SELECT doc_id, nullif(p, 0) AS n_pauses, nullif(p, 0) * 500 AS pause_ms, nullif(r, 0) AS n_rises FROM k WHERE p + r > 0"""


@query
def pause_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.pauses(_nodes(spark, sf_dir)).select("doc_id", "pre", "ms")


ORACLE_SQL["pause_durations"] = """SELECT o_orderkey AS doc_id, pre::INT AS pre, ms::BIGINT AS ms FROM orders JOIN
(VALUES (1, 3, 500), (4, 1, 0), (4, 3, -5), (4, 4, 0), (5, 1, 10)) v(variant, pre, ms) ON o_orderkey % 16 = variant"""


@query
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows over the batch table: the streaming operator on a static frame."""
    rows = _phonemes(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = streaming.windowed(rows, "2 days", "1 day")
    return out.select("user_id", F.date_format("window.start", "yyyy-MM-dd").alias("start"), "n_events", F.round("mean_volume", 6).alias("mean_volume"))


ORACLE_SQL["session_windows"] = f"""WITH {_SESSION},
w AS (SELECT user_id, volume, date_trunc('day', ts)::DATE AS d FROM p), x AS (SELECT user_id, volume, d AS s FROM w UNION ALL SELECT user_id, volume, d - 1 FROM w)
SELECT user_id, strftime(s, '%Y-%m-%d') AS start, count(*) AS n_events, round(avg(volume), 6) AS mean_volume FROM x GROUP BY user_id, s"""


_SAID = """CASE doc_id % 10 WHEN 0 THEN NULL WHEN 1 THEN '<utterance>never closed' WHEN 2 THEN replace(markup, 'duration="500"', 'duration="900"')
WHEN 3 THEN replace(markup, '"rise"', '"fall"') WHEN 4 THEN replace(markup, 'frustrated', 'sad') ELSE markup END"""
_FELT = "CASE doc_id % 3 WHEN 0 THEN 'frustrated' WHEN 1 THEN 'neutral' ELSE 'joyful' END"
_FILE = "concat('e', lpad(CAST(doc_id AS STRING), 12, '0'), '.json')"


def _benchmark(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Entries whose markup comes from the text operator, and predictions that differ from it."""
    rows = tables.written(text.predicted(_cued(spark, sf_dir)), "benchmark-markup")
    entries = rows.select(F.col("doc_id").alias("entry_id"), F.expr(_FILE).alias("file_name"), "markup", F.expr(_FELT).alias("emotion_label"))
    return entries, rows.select(F.col("doc_id").alias("entry_id"), F.expr(_SAID).alias("markup"))


def _scores(report: DataFrame) -> DataFrame:
    rounded = _six("emotion_accuracy", "confidence_ece", "pitch_accuracy", "pause_f1", "validity_rate")
    macro = F.aggregate(F.map_values("emotion_f1"), F.lit(0.0), lambda a, b: a + b) / F.size("emotion_f1")
    return report.select(*rounded, F.round(macro, 6).alias("emotion_macro_f1"), F.size("emotion_f1").alias("n_labels"), "num_samples", "num_failures")


@query
def benchmark_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(benchmark.run(*_benchmark(spark, sf_dir)))


@query
def benchmark_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix of entries is the operator's own feature (``max_samples``)."""
    return _scores(benchmark.run(*_benchmark(spark, sf_dir), max_samples=100))


def _benchmark_sql(limit: str) -> str:
    return f"""WITH m0 AS ({ORACLE_SQL["text_to_markup"]}),
e AS (SELECT doc_id, markup, {_SAID} AS said, {_FELT} AS truth FROM m0 ORDER BY {_FILE.replace("STRING", "VARCHAR")} {limit}),
ok AS (SELECT * FROM e WHERE said IS NOT NULL AND doc_id % 10 <> 1),
u AS (SELECT doc_id, truth, unnest(regexp_extract_all(said, '<utterance[^>]*>')) AS tag FROM ok),
p AS (SELECT truth, CASE WHEN tag LIKE '%emotion=%' THEN regexp_extract(tag, 'emotion="([^"]*)"', 1) ELSE 'neutral' END AS predicted,
      CASE WHEN tag LIKE '%confidence=%' THEN regexp_extract(tag, 'confidence="([^"]*)"', 1)::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM u),
q AS (SELECT *, truth = predicted AS correct FROM p),
l AS (SELECT truth AS label FROM q UNION SELECT predicted FROM q),
f AS (SELECT label, 2.0::DOUBLE * count(*) FILTER (WHERE truth = label AND correct) / (count(*) FILTER (WHERE truth = label) + count(*) FILTER (WHERE predicted = label)) AS f1 FROM l, q GROUP BY label),
g AS (SELECT k, count(*) AS n, avg(confidence) AS c, avg(correct::INT) AS a FROM q JOIN (SELECT k, k * 0.1::DOUBLE AS lo, (k + 1) * 0.1::DOUBLE AS hi FROM range(10) x(k)) ON confidence >= lo AND (confidence < hi OR (k = 9 AND confidence <= hi)) GROUP BY k),
c AS (SELECT doc_id, {_TIMES('<prosody pitch_contour="rise">').replace("markup", "said")} AS same, {_TIMES('<prosody pitch_contour="rise">')} AS n FROM ok),
b AS (SELECT {_TIMES('<pause duration="500"/>').replace("markup", "said")} AS near, {_TIMES('<pause duration="900"/>').replace("markup", "said")} AS far, {_TIMES('<pause duration="500"/>')} AS real FROM ok)
SELECT (SELECT round(avg(correct::INT), 6) FROM q) AS emotion_accuracy, (SELECT round(sum(n * abs(a - c)) / (SELECT count(*) FROM q), 6) FROM g) AS confidence_ece,
  (SELECT round(coalesce(sum(same) / sum(n), 0), 6) FROM c) AS pitch_accuracy,
  (SELECT round(2.0::DOUBLE * least(sum(near), sum(real)) / (sum(near) + sum(far) + sum(real)), 6) FROM b) AS pause_f1,
  (SELECT round(avg((doc_id % 10 <> 1)::INT), 6) FROM e WHERE said IS NOT NULL) AS validity_rate,
  (SELECT round(avg(f1), 6) FROM f) AS emotion_macro_f1, (SELECT count(*)::INT FROM f) AS n_labels,
  (SELECT count(said) FROM e) AS num_samples, (SELECT count(*) - count(said) FROM e) AS num_failures"""


ORACLE_SQL["benchmark_report"] = _benchmark_sql("")
ORACLE_SQL["benchmark_first"] = _benchmark_sql("LIMIT 100")


def _converter(document: str) -> str:
    """Raises on some documents and gives nothing for others, as converters do."""
    if len(document) % 10 == 3:
        raise ValueError("no speech")
    return None if len(document) % 10 == 7 else f'<utterance emotion="calm" confidence="0.{len(document) % 10}">x</utterance>'


@query
def converter_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A converter that fails on some documents: the report counts them, the others are scored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    entries = docs.select(F.col("doc_id").alias("entry_id"), F.expr(_FILE).alias("file_name"), F.lit("<utterance>x</utterance>").alias("markup"), F.expr("CASE WHEN doc_id % 3 = 0 THEN 'calm' ELSE 'sad' END").alias("emotion_label"), F.col("text").alias("transcript"))
    report, failures = benchmark.of_each(_converter, entries)
    kinds = failures.agg(F.count_if(F.col("error") == "ValueError: no speech").alias("n_raised"), F.count_if(F.col("error") == "nothing converted").alias("n_nothing"), F.count_if(F.col("error") == "no document").alias("n_missing"))
    return report.select(F.round("emotion_accuracy", 6).alias("emotion_accuracy"), F.round("confidence_ece", 6).alias("confidence_ece"), F.round("validity_rate", 6).alias("validity_rate"), "num_samples", "num_failures").join(F.broadcast(kinds))


ORACLE_SQL["converter_failures"] = """WITH d AS (SELECT doc_id, length(text) % 10 AS k, doc_id % 3 = 0 AS correct FROM documents),
ok AS (SELECT * FROM d WHERE k NOT IN (3, 7)),
b AS (SELECT j, count(*) AS n, avg(k / 10.0::DOUBLE) AS c, avg(correct::INT) AS a
  FROM ok JOIN (SELECT j, j * 0.1::DOUBLE AS lo, (j + 1) * 0.1::DOUBLE AS hi FROM range(10) x(j)) ON k / 10.0::DOUBLE >= lo AND k / 10.0::DOUBLE < hi GROUP BY j)
SELECT (SELECT round(avg(correct::INT), 6) FROM ok) AS emotion_accuracy, (SELECT round(sum(n * abs(a - c)) / (SELECT count(*) FROM ok), 6) FROM b) AS confidence_ece, 1.0::DOUBLE AS validity_rate,
  (SELECT count(*) FROM ok) AS num_samples, (SELECT count(*) FROM d) - (SELECT count(*) FROM ok) AS num_failures,
  (SELECT count(*) FROM d WHERE k = 3) AS n_raised, (SELECT count(*) FROM d WHERE k = 7) AS n_nothing, (SELECT count(*) FROM d WHERE k IS NULL) AS n_missing"""


@query
def dataset_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries written as a dataset and read back."""
    path = tables.shared_path(spark, "dataset")
    rows = A.view(spark, A.ENTRY, sf_dir, "documents")
    tables.write_dataset(rows.drop("doc_id"), path, "scan")
    read = validate.read_entries(spark, path, strict=False, lines=True)
    size = tables.read_metadata(spark, path).select("size").scalar()
    return read.groupBy("source", "annotator").agg(F.count("*").alias("n"), F.sum(F.length("transcript")).alias("n_chars"), F.count_if("consent").alias("n_consent")).withColumn("size", size)


ORACLE_SQL["dataset_scan"] = f"""WITH e AS ({A.duck(A.ENTRY)})
SELECT source, annotator, count(*) AS n, sum(length(transcript))::BIGINT AS n_chars, count(*) FILTER (WHERE consent) AS n_consent, (SELECT count(*) FROM e) AS size FROM e GROUP BY source, annotator"""


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").cast("string").alias("path"), F.posexplode("embedding").alias("frame", "v")).select("path", "frame", (F.col("v").cast("double") * 100 - 40).alias("db"))


_FRAMES = "fr AS (SELECT vec_id::VARCHAR AS path, unnest(range(len(embedding))) AS frame, unnest(embedding)::DOUBLE * 100 - 40 AS db FROM embeddings)"


@query
def silent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _frames(spark, sf_dir)
    length = frames.groupBy("path").agg((F.count("*") * 10 - 3).alias("duration_ms"))
    return audio.silent_runs(frames, length, least_ms=30).select("path", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"))


ORACLE_SQL["silent_runs"] = f"""WITH {_FRAMES},
a AS (SELECT *, max(frame) OVER (PARTITION BY path) AS last FROM fr),
s AS (SELECT *, frame - row_number() OVER (PARTITION BY path ORDER BY frame) AS g FROM a WHERE db < -40),
r AS (SELECT path, min(frame) * 10 AS start_ms, CASE WHEN max(frame) = any_value(last) THEN (any_value(last) + 1) * 10 - 3 ELSE (max(frame) + 1) * 10 END AS end_ms FROM s GROUP BY path, g)
SELECT path, start_ms::BIGINT AS start_ms, end_ms::BIGINT AS end_ms FROM r WHERE end_ms - start_ms >= 30"""


@query
def loudness_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.peaks(_frames(spark, sf_dir), ["path"])


ORACLE_SQL["loudness_peaks"] = f"""WITH {_FRAMES},
w AS (SELECT *, lag(db) OVER o AS a, lead(db) OVER o AS b, avg(db) OVER (PARTITION BY path) AS m FROM fr WINDOW o AS (PARTITION BY path ORDER BY frame))
SELECT path, count(*) FILTER (WHERE db > a AND db > b AND db > m - 5) AS n_peaks, count(*) AS n_frames FROM w GROUP BY path"""


@query
def rendered_wav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document's sound, in which a pause of negative length is none."""
    return audio.rendered(_nodes(spark, sf_dir)).select("doc_id", F.octet_length("wav").cast("long").alias("n_bytes"))


ORACLE_SQL["rendered_wav"] = f"""SELECT doc_id, 44 + 2 * n_samples AS n_bytes FROM ({ORACLE_SQL["render_samples"].replace(" + floor(22050 * (-5 / 1000.0))::BIGINT", "")})"""


_MEASURED = """
SELECT CAST(floor(vec_id / 10) AS BIGINT) AS path, CAST(vec_id % 10 * 64 + pos AS INT) AS frame,
       CASE WHEN v > 0 THEN 100 + 500 * v END AS f0, CASE WHEN pos % 9 <> 4 THEN v * 100 - 40 END AS db
FROM (SELECT vec_id, CAST(v AS DOUBLE) AS v, pos FROM {rows}) x"""
_SPANS = """
SELECT path, k, k * 131 + path % 7 AS start_ms, k * 131 + path % 7 + CASE k % 7 WHEN 0 THEN 30 WHEN 1 THEN 49 WHEN 2 THEN 210 WHEN 3 THEN 900 WHEN 4 THEN 3300 WHEN 5 THEN 7000 ELSE 0 END AS end_ms
FROM (SELECT DISTINCT CAST(floor(vec_id / 10) AS BIGINT) AS path FROM {embeddings}) p, {numbers} n"""


@query
def span_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means, ranges and rates of spans over measured frames."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    frames = spark.sql(_MEASURED, rows=vectors.select("vec_id", F.posexplode("embedding").alias("pos", "v")))
    spans = spark.sql(_SPANS, embeddings=vectors, numbers=spark.range(50).withColumnRenamed("id", "k"))
    out = intervals.span_statistics(spans, frames, ["k"])
    return out.select("path", "k", *_six("f0_mean", "f0_low", "f0_high", "intensity_mean", "intensity_range", "speech_rate"))


ORACLE_SQL["span_statistics"] = f"""WITH f AS ({_MEASURED.replace('{rows}', '(SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)')}),
s AS ({_SPANS.replace('{embeddings}', 'embeddings').replace('{numbers}', '(SELECT range AS k FROM range(50))')}),
n AS (SELECT path, (max(frame) + 1) * 10 AS ms FROM f GROUP BY path),
j AS (SELECT s.path, s.k, least(s.end_ms, n.ms) - s.start_ms AS len, f.frame, f.f0, f.db FROM s JOIN n USING (path) JOIN f ON f.path = s.path AND f.frame * 10 >= s.start_ms AND f.frame * 10 < s.end_ms),
a AS (SELECT path, k, any_value(len) AS len, avg(f0) AS f0_mean, min(f0) AS f0_low, max(f0) AS f0_high, avg(db) AS intensity_mean, max(db) - min(db) AS intensity_range, count(db) AS n FROM j GROUP BY path, k),
w AS (SELECT path, k, db, lag(db) OVER o AS p, lead(db) OVER o AS q FROM j WHERE db IS NOT NULL WINDOW o AS (PARTITION BY path, k ORDER BY frame)),
c AS (SELECT path, k, count(*) AS peaks FROM w JOIN a USING (path, k) WHERE db > p AND db > q AND db > intensity_mean - 5 GROUP BY path, k)
SELECT s.path, s.k, round(f0_mean, 6) AS f0_mean, round(f0_low, 6) AS f0_low, round(f0_high, 6) AS f0_high, round(intensity_mean, 6) AS intensity_mean, round(intensity_range, 6) AS intensity_range,
       round(CASE WHEN len >= 50 AND n >= 3 THEN coalesce(peaks, 0) * 1000 / len END, 6) AS speech_rate
FROM s LEFT JOIN a USING (path, k) LEFT JOIN c USING (path, k)"""


#: Entry texts in shapes that files come in.
_SHAPED = """CASE doc_id % 7
    WHEN 0 THEN concat('{"id": 1', CAST(doc_id AS VARCHAR(20)), ', "audio_file": "a.wav", "transcript": "t", "iml": "<utterance/>", "emotion_label": "calm", "speaker_id": 7, "metadata": [1], "consent": "true"}')
    WHEN 1 THEN concat('{"id": "', CAST(doc_id AS VARCHAR(20)), '", "audio_file": "a.wav", "transcript": "t", "iml": "<utterance/>", "emotion_label": "calm", "speaker_id": "s", "metadata": {"n": {"k": ', CAST(n_chars AS VARCHAR(20)), '}}, "consent": true}')
    WHEN 2 THEN concat('{"id": "', CAST(doc_id AS VARCHAR(20)), '", "audio_file": "", "transcript": "t", "iml": null, "emotion_label": "calm"}')
    WHEN 3 THEN concat('{"id": "', CAST(doc_id AS VARCHAR(20)), '", ')
    WHEN 4 THEN concat('[', CAST(doc_id AS VARCHAR(20)), ']')
    WHEN 5 THEN concat('{"id": "', CAST(doc_id AS VARCHAR(20)), '", "audio_file": "a.wav", "transcript": "t", "iml": "<utterance/>", "emotion_label": "calm", "metadata": {"n": {"k": "', CAST(n_chars AS VARCHAR(20)), '"}}, "consent": 1}')
    ELSE concat('{"id": "', CAST(doc_id AS VARCHAR(20)), '", "audio_file": "a.wav", "transcript": "t", "iml": "<utterance/>", "emotion_label": "calm", "metadata": null, "consent": false}') END"""


@query
def entry_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry files of several shapes, written and read back: what becomes of each row."""
    path = tables.shared_path(spark, "shapes")
    spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.expr(_SHAPED.replace("VARCHAR(20)", "STRING"))).write.text(f"{path}/entries")
    good, bad = open_entries.read(spark, path, lines=True)
    nested = F.try_variant_get("metadata", "$.n.k", "variant")
    kept = good.select(F.col("id").alias("what"), "speaker_id", "consent", F.schema_of_variant(nested).alias("nested_kind"), F.try_variant_get("metadata", "$.n.k", "string").alias("nested"), (F.schema_of_variant("metadata") == "OBJECT<>").alias("no_metadata"))
    lost = bad.select(F.concat_ws(" | ", "reason", "raw").alias("what"), *(F.lit(None).cast(k).alias(c) for c, k in kept.dtypes[1:]))
    return kept.unionByName(lost)


ORACLE_SQL["entry_shapes"] = f"""WITH d AS (SELECT doc_id, doc_id % 7 AS k, n_chars, {_SHAPED} AS raw FROM documents)
SELECT CASE k WHEN 2 THEN 'missing: audio_file, iml | ' || raw WHEN 3 THEN 'not JSON | ' || raw WHEN 4 THEN 'not an object | ' || raw WHEN 0 THEN '1' || doc_id ELSE doc_id::VARCHAR END AS what,
       CASE WHEN k = 1 THEN 's' END AS speaker_id, CASE WHEN k IN (0, 1, 5, 6) THEN k = 1 END AS consent,
       CASE k WHEN 1 THEN 'BIGINT' WHEN 5 THEN 'STRING' END AS nested_kind, CASE WHEN k IN (1, 5) THEN n_chars::VARCHAR END AS nested, CASE WHEN k IN (0, 1, 5, 6) THEN k IN (0, 6) END AS no_metadata
FROM d"""


@query
def entry_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's entry as a file of its own in a dataset folder, read back with its type."""
    path = tables.shared_path(spark, "folder")
    said = F.concat(F.lit("- "), F.coalesce("transcript", F.lit("")))
    rows = A.view(spark, A.ENTRY, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), said.alias("transcript"), "source", "audio_file", "iml", "emotion_label", "annotator", "consent")
    folders.write(rows, path, title="folder")
    size = tables.read_metadata(spark, path).select("size").scalar()
    return folders.read(spark, path).select("file_name", "source", "annotator", "consent", F.length("transcript").cast("long").alias("n_chars"), "emotion_label").withColumn("size", size)


ORACLE_SQL["entry_folder"] = f"""WITH e AS ({A.duck(A.ENTRY)})
SELECT 'd' || doc_id || '.json' AS file_name, source, annotator, consent, length(coalesce(transcript, '')) + 2 AS n_chars, emotion_label, (SELECT count(*) FROM e) AS size FROM e"""
