"""Streams with state: documents from shuffled words, late words, restarts, the ordered limiter."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from conftest import SMALL, same_rows
from pyspark.sql import functions as F

from cadenza.operators import speech
from cadenza.plans import queries
from cadenza.plans.queries import ORACLE_SQL, QUERIES
from cadenza.streaming import assembly, sessions

KINDS = "doc_id long, word_idx long, word string, start_ms long, end_ms long, " + ", ".join(f"{c} double" for c in [*speech.MEASURES, "f0_low", "f0_high"])
START = datetime(2024, 1, 1, tzinfo=UTC)


def words(n_docs):
    rng = random.Random(5)
    rows = []
    for d in range(n_docs):
        at = 0
        for k in range(rng.randrange(1, 9)):
            gap, dur = rng.choice([0, 60, 250, 1200]), rng.randrange(80, 400)
            measures = [rng.choice([None, rng.uniform(80, 400)]) for _ in range(len(speech.MEASURES) + 2)]
            rows.append((d, k, rng.choice(["a", "b.", "c & d", None]) or "e!", at + gap, at + gap + dur, *measures))
            at += gap + dur
    return rows


def stamped(spark, rows, shift=None):
    df = spark.createDataFrame(rows, KINDS)
    base = int(START.timestamp() * 1000)
    more = F.col("start_ms") + base if shift is None else F.col("start_ms") + base + shift
    return df.withColumn("ts", F.timestamp_millis(more))


def files(frames, path):
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(path)


def as_stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def mark(spark, schema, at):
    return spark.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name != "ts"), F.lit(at).cast("timestamp").alias("ts")).select([f.name for f in schema])


def test_words_in_any_order_give_the_batch_markup_over_a_restart(spark, tmp_path):
    rows = words(30)
    random.Random(1).shuffle(rows)
    whole = stamped(spark, rows)
    want = {r["doc_id"]: r["markup"] for r in speech.assembled(whole.drop("ts")).collect()}
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    third = len(rows) // 3
    files([stamped(spark, rows[:third]), stamped(spark, rows[third : 2 * third])], source)
    markup, late, dropped = assembly.assembled_into(as_stream(spark, source, whole.schema), out, late="1 hour", buckets=3)
    assert (markup.count(), late.count(), dropped) == (0, 0, 0)  # nothing is known to be whole
    files([stamped(spark, rows[2 * third :]), mark(spark, whole.schema, "2024-06-01")], source)
    markup, late, dropped = assembly.assembled_into(as_stream(spark, source, whole.schema), out, late="1 hour", buckets=3)
    assert {r["doc_id"]: r["markup"] for r in markup.collect()} == want
    assert (markup.count(), late.count(), dropped) == (len(want), 0, 0)
    again, _, _ = assembly.assembled_into(as_stream(spark, source, whole.schema), out, late="1 hour", buckets=3)
    assert again.count() == len(want)


def test_late_words_are_told_apart(spark, tmp_path):
    one = [(1, 0, "on time", 0, 100, *[None] * 9)]
    after = [(1, 1, "after all", 1000 * 60 * 60, 1000 * 60 * 60 + 9, *[None] * 9)]
    behind = [(2, 0, "behind", 0, 10, *[None] * 9)]
    schema = stamped(spark, one).schema
    source = f"{tmp_path}/in"
    # the mark moves the watermark to 00:40; document 1 has left by then, and 01:00 is not behind it
    files([stamped(spark, one), mark(spark, schema, "2024-01-01 00:50:00"), mark(spark, schema, "2024-01-01 00:50:01"), stamped(spark, after + behind), mark(spark, schema, "2024-01-03")], source)
    markup, late, dropped = assembly.assembled_into(as_stream(spark, source, schema), f"{tmp_path}/out", late="10 minutes", keep_ms=10 * 3_600_000, buckets=3)
    assert [(r["doc_id"], r["markup"].count("on time"), r["markup"].count("after all")) for r in markup.where("doc_id IS NOT NULL").collect()] == [(1, 1, 0)]
    assert [(r["doc_id"], r["word"]) for r in late.where("doc_id IS NOT NULL").collect()] == [(1, "after all")]
    assert dropped == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_ordered_limiter_equals_the_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(f"c{rng.randrange(4)}", START + timedelta(milliseconds=rng.randrange(0, 400_000))) for _ in range(200)]
    rows += [rows[0]] * 5
    whole = spark.createDataFrame(rows, "client string, ts timestamp")
    want = sorted(map(tuple, sessions.rate_limited(whole, 3, 20.0).collect()))
    end = spark.createDataFrame([("end", START + timedelta(days=9))], whole.schema)
    files([whole.where(F.col("client") == c) for c in ("c2", "c0")] + [whole.where("client IN ('c1', 'c3')").orderBy(F.rand(seed)), end], f"{tmp_path}/in")
    with assembly.keyed_state(spark):
        got = sessions.collected(assembly.ordered_limit(as_stream(spark, f"{tmp_path}/in", whole.schema), 3, 20.0, late="1 day"), f"{tmp_path}/out", "append")
    assert sorted(map(tuple, got.collect())) == want


def test_ordered_limiter_judges_what_the_watermark_has_passed_only(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    steps = [[0, 30], [20, 10], [200], [500]]
    schema = "client string, ts timestamp"
    files([spark.createDataFrame([("a", at(s)) for s in step], schema) for step in steps], f"{tmp_path}/in")
    with assembly.keyed_state(spark):
        stream = assembly.ordered_limit(as_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema), 2, 25.0, late="60 seconds")
        got = sessions.collected(stream, f"{tmp_path}/out", "append").collect()
    # 0 and 10 pass, 20 finds both in the window, 30 one of them; 500 still waits
    assert sorted((int((r["ts"].replace(tzinfo=UTC) - START).total_seconds()), r["ok"]) for r in got) == [(0, True), (10, True), (20, False), (30, True), (200, True)]


@pytest.mark.parametrize("name", ["assembled_stream", "rate_limit_stream"])
def test_stream_queries_equal_their_sql(spark, name):
    same_rows(QUERIES[name](spark, SMALL), ORACLE_SQL[name], SMALL)


def test_ordered_limiter_judges_many_clients_of_a_bucket_apart(spark, tmp_path):
    rng = random.Random(4)
    at = lambda: START + timedelta(microseconds=rng.randrange(0, 90_000_000))
    clients = [None, *(2**60 + k for k in range(40))]  # doubles could not tell these apart
    steps = [[(rng.choice(clients), at() + timedelta(seconds=60 * k)) for _ in range(150)] for k in range(4)]
    frames = [spark.createDataFrame(s, "client long, ts timestamp") for s in steps]
    files([*frames, spark.createDataFrame([(1, START + timedelta(days=9))], frames[0].schema)], f"{tmp_path}/in")
    with assembly.keyed_state(spark):
        stream = assembly.ordered_limit(as_stream(spark, f"{tmp_path}/in", frames[0].schema), 2, 25.0, late="90 seconds", buckets=2)
        query = stream.writeStream.format("memory").queryName("limited_apart").trigger(availableNow=True).start()
        query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress) <= 3 * 8  # buckets, not clients
    got = sorted((str(r["client"]), r["ts"].replace(tzinfo=UTC), r["ok"]) for r in spark.table("limited_apart").collect())
    want = []
    for c in clients:
        times = sorted(t for s in steps for x, t in s if x == c)
        want += zip([str(c)] * len(times), times, sessions.accepted([t.timestamp() for t in times], [], 2, 25.0)[0])
    assert got == sorted(want)


def test_what_waits_in_a_bucket_does_not_grow_with_the_words(spark, monkeypatch):
    """twenty times the words are in more buckets, not in larger ones."""
    asked = []
    many = spark.range(3_000_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("word_idx"), F.lit("a").alias("word"), F.lit(0).alias("start_ms"), F.lit(9).alias("end_ms"))
    monkeypatch.setattr(queries, "_words", lambda spark, sf_dir: many)
    monkeypatch.setattr(queries, "_shuffled", lambda spark, rows, time, end: rows)
    monkeypatch.setattr(assembly, "assembled_into", lambda words, path, buckets, **more: asked.append(buckets) or (words, words, 0))
    queries.assembled_stream(spark, SMALL)
    assert 3_000_000 / asked[0] <= 60_000


def test_stores_of_an_executor_share_buffers_and_cache(spark):
    """so that their sizes do not add up."""
    bounded = "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage"
    before = spark.conf.get(bounded, None)
    with assembly.keyed_state(spark):
        assert spark.conf.get(bounded) == "true"
        assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert spark.conf.get(bounded, None) == before


def test_finished_words_are_written_not_cached(spark, tmp_path, monkeypatch):
    """a batch's words go to files that are gone once its markup is written."""
    asked = []
    kind = type(spark.range(1))
    monkeypatch.setattr(kind, "persist", lambda self, *level, keep=kind.persist: asked.append(self) or keep(self, *level))
    rows = stamped(spark, words(3))
    files([rows, mark(spark, rows.schema, "2024-06-01")], f"{tmp_path}/in")
    markup, late, _ = assembly.assembled_into(as_stream(spark, f"{tmp_path}/in", rows.schema), f"{tmp_path}/out", late="1 hour", buckets=2)
    assert (markup.count(), late.count(), asked) == (3, 0, [])
    assert not list((tmp_path / "out").glob("left/batch=*"))
