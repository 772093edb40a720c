"""Entry files of any shape: nothing is lost, types stay, a repeated batch adds nothing; span statistics."""

import json
from collections import Counter

import pytest
from conftest import SMALL, same_rows
from pyspark.sql import functions as F

from cadenza.operators import intervals, validate
from cadenza.plans.queries import ORACLE_SQL, QUERIES
from cadenza.sources import entries

FULL = {"id": "a", "audio_file": "a.wav", "transcript": "t", "iml": "<utterance/>", "emotion_label": "calm"}
FILES = {
    "a.json": json.dumps(FULL | {"consent": True, "speaker_id": 5, "metadata": {"x": {"y": [1, "2"]}}}), "b.json": json.dumps(FULL | {"id": 12, "consent": "true", "metadata": "m", "source": "s"}),
    "c.json": json.dumps(FULL | {"iml": "", "transcript": 0, "id": []}), "d.json": "{", "e.json": "[]", "f.json": " ", "g.json": "null", "h.json": json.dumps({}), "i.json": json.dumps(FULL | {"speaker_id": "me"}, indent=2),
}


def lay(path, names):
    home = path / "in" / "entries"
    home.mkdir(parents=True, exist_ok=True)
    for n in names:
        (home / n).write_text(FILES[n])
    return str(path / "in")


WANT_BAD = {
    "c.json": "missing: id, transcript, iml", "d.json": "not JSON", "e.json": "not an object", "f.json": "not JSON", "g.json": "not an object",
    "h.json": "missing: id, audio_file, transcript, iml, emotion_label",
}


def check(good, bad):
    got = {r["file_name"]: r for r in good.withColumn("m", F.to_json("metadata")).drop("metadata").collect()}
    assert sorted(got) == ["a.json", "b.json", "i.json"]
    assert (got["a.json"]["consent"], got["a.json"]["speaker_id"], json.loads(got["a.json"]["m"])) == (True, None, {"x": {"y": [1, "2"]}})
    assert (got["b.json"]["id"], got["b.json"]["consent"], got["b.json"]["m"], got["b.json"]["source"], got["b.json"]["language"]) == ("12", False, "{}", "s", "")
    assert got["i.json"]["speaker_id"] == "me"
    assert {r["file_name"]: r["reason"] for r in bad.collect()} == WANT_BAD
    assert {r["file_name"]: r["raw"] for r in bad.collect()} == {n: FILES[n] for n in WANT_BAD}


def test_every_file_is_an_entry_or_a_reject(spark, tmp_path):
    check(*entries.read(spark, lay(tmp_path, FILES)))


def test_a_stream_reads_each_file_once(spark, tmp_path):
    names = list(FILES)
    out = f"{tmp_path}/out"
    good, bad = entries.stream_into(spark, lay(tmp_path, names[:4]), out)
    assert (good.count(), bad.count()) == (2, 2)
    home = lay(tmp_path, names)
    entries.stream_into(spark, home, out)
    check(*entries.stream_into(spark, home, out))  # nothing new


def test_entry_stream_fills_and_names_as_the_reader(spark, tmp_path):
    home = lay(tmp_path, ["i.json"])
    query = validate.entry_stream(spark, home).writeStream.format("memory").queryName("entry_rows").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("entry_rows").collect() == validate.read_entries(spark, home, strict=False).collect()


@pytest.mark.parametrize("name", ["entry_shapes"])
def test_query_equals_its_sql(spark, name):
    same_rows(QUERIES[name](spark, SMALL), ORACLE_SQL[name], SMALL)


def test_span_statistics_of_odd_spans(spark):
    import random

    rng = random.Random(3)
    frames = [(p, k, rng.choice([None, float("nan"), rng.uniform(80, 300)]), None if p == "c" else rng.choice([None, rng.uniform(-60, 0)])) for p, n in (("a", 700), ("b", 64), ("c", 65), ("d", 1)) for k in range(n)]
    spans = [(p, i, *x) for p in "abcdz" for i, x in enumerate([(0, 7000), (0, 10), (5, 9), (5, 640), (630, 650), (640, 1280), (-50, 30), (3, 99999), (7000, 7100), (50, 50), (60, 20), (0, 49), (0, 50), (1270, 6410)])]
    got = {(r["path"], r["k"]): tuple(r)[2:] for r in intervals.span_statistics(spark.createDataFrame(spans, "path string, k int, start_ms long, end_ms long"), spark.createDataFrame(frames, "path string, frame int, f0 double, db double").repartition(3), ["k"]).collect()}
    assert len(got) == len(spans)
    size = Counter(f[0] for f in frames)
    for p, k, start, end in spans:
        mine = [f for f in frames if f[0] == p and start <= f[1] * 10 < end]
        f0, db = [f[2] for f in mine if f[2] is not None and f[2] == f[2]], [f[3] for f in mine if f[3] is not None]
        long = min(end, size[p] * 10) - max(start, 0)
        mean = sum(db) / len(db) if db else None
        peaks = sum(db[i] > db[i - 1] and db[i] > db[i + 1] and db[i] > mean - 5 for i in range(1, len(db) - 1))
        want = (sum(f0) / len(f0) if f0 else None, min(f0, default=None), max(f0, default=None), mean, max(db) - min(db) if db else None, peaks * 1000 / long if long >= 50 and len(db) >= 3 else None)
        for g, w in zip(got[p, k], want, strict=True):
            assert (g is None) == (w is None) and (w is None or abs(g - w) < 1e-6), (p, k, got[p, k], want)
