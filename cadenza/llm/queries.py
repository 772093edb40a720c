"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, cluster, lines, lm, mixing, phrases, pii, quality, simhash, sketch, suffix, urls, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps once repeated 50-byte strings are gone, as a digest."""
    done = suffix.dedup_strings(_read(spark, sf_dir, "documents").select("doc_id", "text"), keep_bytes=False)
    return done.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mixed(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that every document keeps, as a digest."""
    done = lines.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_components(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return urls.filtered(_read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every document."""
    return lm.scored(_read(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages as the archives give them back."""
    return warc.archived(_read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every document and of its edited text."""
    return sketch.edited_neighbours(_read(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text and the bytes they decode to, as digests."""
    import public_tokenizers

    return bpe.token_digests(
        _read(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality.judged(_read(spark, sf_dir, "documents").select("doc_id", "source", "text"), texts=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first collocations."""
    found = phrases.collocations(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every whole vector."""
    found = cluster.clustered(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text."""
    found = pii.personal(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix": op1_suffix,
    "op2_mixing": op2_mixing,
    "op3_line_dedup": op3_line_dedup,
    "op4_simhash": op4_simhash,
    "op5_urls": op5_urls,
    "op6_lm": op6_lm,
    "op7_warc": op7_warc,
    "op8_fingerprints": op8_fingerprints,
    "op9_bpe": op9_bpe,
    "op10_quality": op10_quality,
    "op11_phrases": op11_phrases,
    "op12_clusters": op12_clusters,
    "op13_pii": op13_pii,
}


def _cluster_rounds() -> str:
    """Assignment and centroids of every round, each a common table expression of its own."""
    parts = []
    for r in range(cluster.ROUNDS + 1):
        parts.append(f"""
n{r} AS MATERIALIZED (
  SELECT id, arg_min(struct_pack(c := c, d := d), d::HUGEINT * 1000 + c) AS m
  FROM (SELECT id, c, list_sum(list_transform(list_zip(v, w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM k, c{r}) GROUP BY id),
a{r} AS MATERIALIZED (SELECT k.id, vec_id, v, m.c AS c, m.d AS d FROM k JOIN n{r} USING (id))""")
        if r < cluster.ROUNDS:
            parts.append(f"""
s{r} AS (SELECT c, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(n.w, c{r}.w) AS w FROM c{r} LEFT JOIN (SELECT c, list(x ORDER BY i) AS w FROM s{r} GROUP BY c) n ON n.c = c{r}.c)""")
    return ",".join(parts)

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL: dict[str, str] = {
    "op2_mixing": rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size,
         coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT, 0) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight,
         3 * source_size AS cap
  FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, source IS NULL, source)),
t AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * max(CASE WHEN level <= cap::DOUBLE / weight THEN level END) OVER ()) AS target
  FROM l),
r AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS repeats FROM t),
c AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.repeats, r.target - r.repeats * r.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, h) AS own
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       ((repeats + CASE WHEN upto <= rest OR (upto - own <= rest AND upto - rest < rest - (upto - own)) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM c""",
    "op3_line_dedup": rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
k AS (SELECT *, translate(trim(line, {_SPACES}), '{_UPPER}', '{_LOWER}') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key),
f AS (SELECT k.*, o.owner IS NOT NULL AND o.owner <> k.doc_id AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id""",
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY html)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN f.first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first <> page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON n >= 100 AND p.html = f.html""",
    "op10_quality": rf"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '{_WORD}') AS words FROM t),
g AS (
  SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5),
h AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS gram FROM g),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM h) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM r, range(0, 5) x(k) GROUP BY doc_id),
raw AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM t),
l AS (SELECT * FROM raw WHERE trim(line, {_SPACES}) <> ''),
d AS (SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM l GROUP BY doc_id),
k AS (SELECT doc_id, source, text, pos, lower(trim(line, {_SPACES})) AS key, len(regexp_extract_all(line, '{_WORD}')) AS words FROM l),
m AS (SELECT source, greatest(5, count(*) / 100.0::DOUBLE) AS lim FROM t GROUP BY source),
f AS (
  SELECT k.source, key, min(doc_id) AS keeper FROM k JOIN m ON k.source IS NOT DISTINCT FROM m.source
  GROUP BY k.source, key, lim HAVING count(DISTINCT text) > lim),
x AS (
  SELECT doc_id, sum(words) AS lost FROM k JOIN f ON k.source IS NOT DISTINCT FROM f.source AND k.key = f.key
  WHERE doc_id <> keeper GROUP BY doc_id),
b AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(lost, 0) AS lost
  FROM w LEFT JOIN d USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 3 * (n_words - lost) >= 2 * n_words AS kept
FROM v""",
    "op11_phrases": rf"""
WITH p AS (
  SELECT coalesce(lang, '{phrases.UNKNOWN}') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
g AS (
  SELECT lang, k, words, unnest(range(1, len(words) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(words) >= k),
f AS MATERIALIZED (SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= {phrases.LEAST}),
x AS (
  SELECT c.lang, c.phrase, c.a, j, lf.f AS l, rf.f AS r, (1000000::HUGEINT * c.a * c.a // (lf.f::HUGEINT * rf.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
  JOIN f lf ON lf.lang = c.lang AND lf.phrase = array_to_string(ws[1:j], ' ') JOIN f rf ON rf.lang = c.lang AND rf.phrase = array_to_string(ws[j + 1:], ' ')),
m AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (
  SELECT lang, phrase, max(a) AS longer
  FROM (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3) GROUP BY ALL),
s AS (SELECT m.* FROM m LEFT JOIN o USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {phrases.CONTAINED_PER_CENT} * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM s JOIN n USING (lang) QUALIFY rank <= {phrases.TOP}""",
    "op12_clusters": f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor({cluster.SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = {cluster.DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS w
  FROM (SELECT sha256('{cluster.SEED}' || vec_id) AS h, v FROM k ORDER BY h, v LIMIT {cluster.CENTROIDS})),{_cluster_rounds()},
p AS (SELECT c, sum(d)::BIGINT AS cluster_inertia FROM a{cluster.ROUNDS} GROUP BY c),
q AS (SELECT c, sha256(array_to_string(w, ',')) AS centroid_sha256 FROM c{cluster.ROUNDS})
SELECT vec_id, c::INT AS cluster, d AS distance, cluster_inertia, (SELECT sum(cluster_inertia) FROM p)::BIGINT AS inertia, centroid_sha256
FROM a{cluster.ROUNDS} JOIN p USING (c) JOIN q USING (c)""",
}
