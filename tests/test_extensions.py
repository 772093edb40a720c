"""Own classifiers over spans, converters that fail, profiles by user."""

import pyarrow as pa
import pytest
from conftest import SMALL, same_rows

from cadenza.operators import benchmark, profiles, speech
from cadenza.plans.queries import ORACLE_SQL, QUERIES
from cadenza.sources import shred

OBSERVED = "user_id long, id long, labels map<string,string>, base_emotion string, base_confidence double"
PROFILE = "user_id long, mapping_idx int, pattern map<string,string>, emotion string, boost double"


@pytest.mark.parametrize("name", ["assembled_by_slope", "converter_failures", "profile_by_user", "node_table"])
def test_queries_equal_their_sql(spark, name):
    same_rows(QUERIES[name](spark, SMALL), ORACLE_SQL[name], SMALL)


def test_a_classifier_sees_the_spans_in_order(spark):
    fields = "doc_id long, word_idx long, word string, start_ms long, end_ms long, " + ", ".join(f"{c} double" for c in speech.MEASURES)
    rows = [(1, k, w, k * 300, k * 300 + 200, *[None] * 7) for k, w in [(2, "c"), (0, "a"), (1, "b")]] + [(2, 0, None, 0, 1, *[None] * 7)]
    seen = lambda spans: (pa.array(["".join(w["word"] or "?" for w in u) for u in spans.to_pylist()]), pa.array([1.0] * len(spans)))
    got = {r["doc_id"]: r["emotion"] for r in speech.by_spans(seen)(speech.utterances(spark.createDataFrame(rows, fields).repartition(3))).collect()}
    assert got == {1: "abc", 2: "?"}


def test_one_failing_document_fails_alone(spark):
    def convert(text):
        if text == "bad":
            raise KeyError("x")
        return None if text == "none" else f"<utterance>{text}</utterance>"

    rows = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, None), (4, "none"), (5, "ok too")], "entry_id long, transcript string")
    got = {r["entry_id"]: (r["markup"], r["error"]) for r in benchmark.guarded(convert, rows).collect()}
    assert got == {1: ("<utterance>ok</utterance>", None), 2: (None, "KeyError: 'x'"), 3: (None, "no document"), 4: (None, "nothing converted"), 5: ("<utterance>ok too</utterance>", None)}


def plain(observed, table):
    out = {}
    for user, key, labels, emotion, confidence in observed:
        best = None
        for who, idx, pattern, e, b in sorted(table, key=lambda r: r[1]):
            if who is not None and who == user and pattern and all((labels or {}).get(k) == v for k, v in pattern.items()) and (best is None or len(pattern) > best[0]):
                best = (len(pattern), idx, e, b)
        out[key] = (emotion, confidence, None) if best is None else (best[2], min(1.0, confidence + best[3]), best[1])
    return out


def test_profiles_by_user_equal_a_plain_search(spark):
    import random

    rng = random.Random(2)
    values = {"pitch": ["high", "low"], "volume": ["loud"], "rate": ["fast", "slow", "normal"]}
    some = lambda: {k: rng.choice(v) for k, v in values.items() if rng.random() < 0.6}
    # a third of the rows belong to one user, and all of those are loud
    observed = [(7 if k % 3 == 0 else rng.randrange(5), k, {**some(), **({"volume": "loud"} if k % 3 == 0 else {})}, "neutral", rng.choice([0.2, 0.9])) for k in range(300)]
    observed += [(None, 900, {"volume": "loud"}, "sad", 0.5), (99, 901, {"volume": "loud"}, "sad", 0.5), (7, 902, {}, "sad", 0.5), (7, 903, None, "sad", 0.5)]
    table = [(u, i, some(), f"e{u}{i}", rng.choice([0.1, 0.4])) for u in (0, 1, 2, 3, 7) for i in range(6)] + [(7, 6, {}, "never", 0.1), (7, 7, {"pitch": "odd"}, "never", 0.1)]
    got = profiles.applied_by_user(spark.createDataFrame(observed, OBSERVED).repartition(3), spark.createDataFrame(table, PROFILE), ["id"]).collect()
    assert {r["id"]: (r["emotion"], r["confidence"], r["mapping_idx"]) for r in got} == plain(observed, table)


def test_the_table_function_gives_the_shredder_s_rows(spark):
    texts = ["<utterance>a<pause/>b</utterance>", "<iml><utterance><prosody pitch='+5%'><emphasis level='strong'>x</emphasis></prosody></utterance><!--c--></iml>", "<a", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, markup string")
    shred.register(spark)
    rows = spark.sql("SELECT n.* FROM {d} d, LATERAL shred_markup(d.doc_id, d.markup) n", d=docs)
    plain = lambda df: sorted(str(r) for r in df.collect())
    assert rows.schema.simpleString() == shred.shredded(docs).schema.simpleString()
    assert plain(rows) == plain(shred.shredded(docs))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_pauses_of_few_lengths_match_without_moving_the_rest():
    import time

    from cadenza.operators import metrics

    n = 400_000
    start = time.process_time()
    assert metrics.matched([500] * n, [500] * n) == n
    assert metrics.matched(list(range(0, n, 2)), list(range(n)), 0) == n // 2
    assert time.process_time() - start < 10  # a list that closes up behind each match takes minutes


@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_hashed_split_ranks_only_the_buckets_of_its_bounds(spark, n):
    import hashlib

    from pyspark.sql import functions as F

    from cadenza.operators import split

    rows = spark.range(n).withColumn("id", F.col("id") - F.col("id") % 2 * int(n > 9))  # pairs share a key
    got = split.hashed_split(rows, "id", 0.6, 0.2, 0.2)
    ids = sorted((hashlib.md5(f"{k - k % 2 * (n > 9)}:42".encode()).hexdigest(), k - k % 2 * (n > 9)) for k in range(n))
    a, b = int(n * 0.6), int(n * 0.2)
    want = sorted((k, "train" if i < a else "val" if i < a + b else "test") for i, (_, k) in enumerate(ids))
    assert sorted(map(tuple, got.select("id", "split").collect())) == want
    assert "BroadcastExchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_users_with_few_and_with_many_mappings(spark, monkeypatch):
    observed = [(u, 10 * u + k, {"pitch": "high", "rate": ["fast", "slow"][k % 2]}, "neutral", 0.2) for u in (1, 2) for k in range(4)] + [(None, 99, {"pitch": "high"}, "sad", 0.5)]
    table = [(1, 0, {"pitch": "high"}, "a", 0.1), (1, 1, {"rate": "fast", "pitch": "high"}, "b", 0.4), *((2, i, {"rate": ["fast", "slow"][i % 2]}, f"c{i}", 0.9) for i in range(4)), (1, 2, {"pitch": None}, "never", 0.1)]
    frames = spark.createDataFrame(observed, OBSERVED), spark.createDataFrame(table, PROFILE)
    for most in (0, 3, 32):
        monkeypatch.setattr(profiles, "MOST_MAPPINGS", most)
        got = profiles.applied_by_user(*frames, ["id"])
        assert {r["id"]: (r["emotion"], r["confidence"], r["mapping_idx"]) for r in got.collect()} == plain(observed, table)
    assert "Generate explode" not in got._jdf.queryExecution().optimizedPlan().toString()  # a row is shuffled once, not once a label
