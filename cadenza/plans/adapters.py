"""Views over the test tables that exercise the operators.

Each is one SQL text that Spark and DuckDB both run: tables are named in braces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

WORD_SPAN = """
WITH a AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice,
                               l_quantity, l_discount, l_tax, l_shipdate) AS rn
  FROM {lineitem}),
b AS (
  SELECT *, 200 + (l_partkey % 5) * 40 AS dur,
         CASE (l_suppkey + rn) % 6 WHEN 0 THEN 0 WHEN 1 THEN 60 WHEN 2 THEN 150 WHEN 3 THEN 250 WHEN 4 THEN 700 ELSE 1200 END AS gap
  FROM a),
c AS (
  SELECT *, coalesce(sum(dur + gap) OVER (PARTITION BY l_orderkey ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM b)
SELECT l_orderkey AS doc_id, CAST(rn - 1 AS BIGINT) AS word_idx,
       concat(lower(l_returnflag), CAST(l_linenumber AS VARCHAR(9)), CASE WHEN l_partkey % 4 = 0 THEN '.' ELSE '' END) AS word,
       CAST(s AS BIGINT) AS start_ms, CAST(s + dur AS BIGINT) AS end_ms,
       CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE 100 + 4 * l_quantity END AS f0_mean,
       2.5 * l_quantity AS f0_span, 90 + l_quantity AS f0_low, 90 + 3.5 * l_quantity AS f0_high,
       CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE 55 + 200 * l_discount END AS intensity_mean,
       2 + 50 * l_tax AS speech_rate, 0.004 + 0.2 * l_discount AS jitter, 0.02 + l_tax AS shimmer, 5 + l_quantity / 2.5 AS hnr
FROM c"""

PREDICTION = """
SELECT doc_id, CASE quality * 4 + toxic * 2 + doc_id % 2 WHEN 0 THEN 'angry' WHEN 1 THEN 'calm' WHEN 2 THEN 'sad' WHEN 3 THEN 'joyful'
               WHEN 4 THEN 'neutral' WHEN 5 THEN 'fearful' WHEN 6 THEN 'frustrated' ELSE 'sarcastic' END AS truth,
       CASE (quality * 4 + toxic * 2 + doc_id % 2 + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END) % 8
               WHEN 0 THEN 'angry' WHEN 1 THEN 'calm' WHEN 2 THEN 'sad' WHEN 3 THEN 'joyful'
               WHEN 4 THEN 'neutral' WHEN 5 THEN 'fearful' WHEN 6 THEN 'frustrated' ELSE 'sarcastic' END AS predicted,
       (doc_id * 37 % 101) / 100.0 AS confidence
FROM (SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic FROM {labels}) x"""

CUED_TEXT = """
SELECT doc_id, concat(text, ' ', CASE doc_id % 7 WHEN 0 THEN 'love' WHEN 1 THEN 'terrible' WHEN 2 THEN 'Maybe' WHEN 3 THEN 'great,'
         WHEN 4 THEN 'worst' WHEN 5 THEN 'perhaps' ELSE 'plain' END, ' ',
       CASE doc_id % 6 WHEN 0 THEN 'AMAZING!' WHEN 1 THEN 'Really?...' WHEN 2 THEN 'Well... maybe so' WHEN 3 THEN 'She said "great stuff" today.'
         WHEN 4 THEN 'Are you SERIOUS?' ELSE 'Well… I… guess.' END) AS text
FROM {documents}"""

MARKUP = """
SELECT o_orderkey AS doc_id, o_orderkey % 16 AS variant,
       CASE o_orderkey % 16
         WHEN 0 THEN concat('<utterance emotion="calm" confidence="0.9">order <prosody pitch="+10%" volume="-3dB">', word, '</prosody> done</utterance>')
         WHEN 1 THEN concat('<iml version="1.0" language="en-US"><utterance>a &amp; ', word, '<pause duration="500"/>b</utterance><utterance>c</utterance></iml>')
         WHEN 2 THEN concat('<utterance emotion="angry">', word, '</utterance>')
         WHEN 3 THEN concat('<utterance emotion="odd" confidence="1.5">', word, '</utterance>')
         WHEN 4 THEN concat('<utterance><pause/>', word, '<pause duration="-5"/><pause duration="x"/></utterance>')
         WHEN 5 THEN concat('<utterance><pause duration="10">', word, '</pause></utterance>')
         WHEN 6 THEN concat('<utterance><emphasis>', word, '</emphasis> <emphasis level="huge">x</emphasis></utterance>')
         WHEN 7 THEN concat('<utterance><prosody pitch="high" volume="loud"><segment>', word, '</segment></prosody></utterance>')
         WHEN 8 THEN concat('<utterance><segment tempo="slow"><segment>', word, '</segment></segment></utterance>')
         WHEN 9 THEN concat('<utterance><prosody pitch="+1st"><emphasis level="strong"><prosody pitch="90Hz">', word, '</prosody></emphasis></prosody></utterance>')
         WHEN 10 THEN concat('<utterance>', word, ' <custom>in <pause duration="9"/></custom></utterance>')
         WHEN 11 THEN concat('<iml consent="none" processing="hybrid">', word, '</iml>')
         WHEN 12 THEN concat('<speech>', word, '</speech>')
         WHEN 13 THEN concat('<utterance>', word)
         WHEN 14 THEN concat('<utterance emotion="sad" confidence="nan"><emphasis level="reduced">', word, '</emphasis><!-- note --></utterance>')
         ELSE concat('<iml version="1.0"><utterance emotion="sad" confidence="high">', word, '</utterance><prosody pitch="?">x</prosody></iml>')
       END AS markup, word
FROM (SELECT o_orderkey, lower(substr(o_orderpriority, 3, 4)) AS word FROM {orders}) x"""

PHONEMES = """
SELECT concat(CAST(user_id AS VARCHAR(20)), '/', substr(CAST(ts AS VARCHAR(30)), 1, 10)) AS session_id, user_id,
       row_number() OVER (PARTITION BY user_id, substr(CAST(ts AS VARCHAR(30)), 1, 10) ORDER BY ts, event_id) - 1 AS seq,
       60 + k AS duration_ms, k / 99.0E0 AS volume, 80 + value AS pitch_hz,
       event_type = 'error' AS vibrato, CASE WHEN event_type IN ('view', 'signup') THEN 0.9E0 ELSE 0.1E0 END AS breathiness, ts
FROM (SELECT *, CAST(regexp_replace(props, '[^0-9]', '', 'g') AS BIGINT) AS k FROM {events}) x"""

ENTRY = """
SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN '' ELSE concat('e', CAST(doc_id AS VARCHAR(20))) END AS id,
       CASE WHEN doc_id % 7 = 0 THEN 'yesterday' ELSE '2024-01-02T03:04:05Z' END AS timestamp,
       CASE doc_id % 5 WHEN 0 THEN 'mavis' WHEN 1 THEN 'recorded' WHEN 2 THEN 'synthetic' WHEN 3 THEN 'other' ELSE '' END AS source,
       CASE WHEN doc_id % 11 = 0 THEN 'english' ELSE lang END AS language, concat('audio/', CAST(doc_id % 50 AS VARCHAR(20)), '.wav') AS audio_file,
       text AS transcript, CASE WHEN doc_id % 13 = 0 THEN '<utterance emotion="sad">x</utterance>' ELSE '<utterance>x</utterance>' END AS iml, 'neutral' AS emotion_label,
       CASE doc_id % 4 WHEN 0 THEN 'human' WHEN 1 THEN 'model' WHEN 2 THEN 'hybrid' ELSE 'cat' END AS annotator,
       doc_id % 3 > 0 AS consent
FROM {documents}"""

#: The mappings of a profile.
PROFILE = [
    (0, {"pitch": "high", "volume": "loud"}, "excited", 0.2),
    (1, {"quality": "tense", "rate": "fast"}, "anxious", 0.15),
    (2, {"pitch": "low"}, "calm", 0.1),
]


def view(spark: SparkSession, sql: str, sf_dir: str, table: str) -> DataFrame:
    """An adapter over one table's Parquet file."""
    text = sql.replace("VARCHAR(9)", "STRING").replace("VARCHAR(20)", "STRING").replace("VARCHAR(30)", "STRING").replace(", 'g')", ")")
    return spark.sql(text, **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})


def duck(sql: str) -> str:
    """The same for DuckDB, whose views carry the tables' names."""
    import re

    return re.sub(r"\{(\w+)\}", r"\1", sql)
