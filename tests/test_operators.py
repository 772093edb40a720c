"""Operators against rows worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import markup as M
from cadenza.operators import audio, benchmark, learning, metrics, nodes, profiles, sessions, speech, split, text, validate
from cadenza.plans import adapters
from cadenza.sources import shred, tables
from cadenza.streaming import sessions as streaming


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def parsed(spark, *markups):
    return shred.shredded(spark.createDataFrame(list(enumerate(markups)), "doc_id long, markup string"))


def rules(spark, markup):
    return sorted(r["rule"] for r in validate.markup_issues(parsed(spark, markup)).collect())


@pytest.mark.parametrize(
    ("value", "out"), [("-25dB", "x-soft"), ("+20dB", "x-loud"), ("+6dB", "+6dB"), ("-3.5dB", "-3.5dB"), ("0DB", "+0dB"), ("loud", "loud"), (None, None)]
)
def test_volume_to_ssml(spark, value, out):
    assert one(spark, M.volume_to_ssml(F.lit(value).cast("string"))) == out


@pytest.mark.parametrize(("value", "hz"), [("+10%", 198.0), ("-12st", 90.0), ("185Hz", 185.0), ("high", 180.0), (None, 180.0)])
def test_pitch_to_hz(spark, value, hz):
    assert one(spark, M.pitch_to_hz(F.lit(value).cast("string"))) == pytest.approx(hz)


@pytest.mark.parametrize(("value", "out"), [(2.5, "+2%"), (-0.3, "-0%"), (3.5, "+4%"), (0.0, "+0%")])
def test_relative_values_round_half_even_and_keep_the_sign(spark, value, out):
    assert one(spark, M.relative(F.lit(value), "%")) == out


@pytest.mark.parametrize(
    ("text_", "number"), [("0.9", 0.9), (" 1_0 ", 10.0), ("0.9f", None), ("1.0d", None), ("-inf", -math.inf), ("Infinity", math.inf), (".5", 0.5), ("5.", 5.0), ("x", None), ("", None), ("1e3", 1000.0)]
)
def test_float_text(spark, text_, number):
    assert one(spark, M.float_or_null(F.lit(text_))) == number
    assert math.isnan(one(spark, M.float_or_null(F.lit("NaN"))))


@pytest.mark.parametrize(("text_", "number"), [("12", 12), ("1_000", 1000), ("3.14", None), ("-5", -5), ("x", None)])
def test_int_text(spark, text_, number):
    assert one(spark, M.int_or_null(F.lit(text_))) == number


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 2.0], [1.0, 5.0, 2.0, 8.0]])
def test_resampling_equals_numpy(spark, values):
    want = np.zeros(20) if not values else np.interp(np.linspace(0, 1, 20), np.linspace(0, 1, max(2, len(values))), values if len(values) > 1 else values * 2)
    got = one(spark, M.resampled(F.lit(values).cast("array<double>") if values else F.array().cast("array<double>")))
    assert np.allclose(got, want)


@pytest.mark.parametrize(
    ("markup", "broken"),
    [
        ("<utterance>x</utterance>", []),
        ("<utterance", ["V1"]),
        ("<speech>x</speech>", ["V2"]),
        ("<iml>x</iml>", ["V2"]),
        ('<utterance emotion="sad">x</utterance>', ["V3"]),
        ('<utterance emotion="" confidence="0.5">x</utterance>', ["V15"]),
        ('<utterance confidence="nan">x</utterance>', []),
        ('<utterance confidence="inf">x</utterance>', ["V4"]),
        ('<utterance><pause duration="5">a<b/></pause></utterance>', ["V7", "V7"]),
        ('<utterance><pause duration="5"><!-- c --></pause></utterance>', ["V7"]),
        ('<utterance><pause duration="1_0"/></utterance>', []),
        ('<utterance><prosody pitch="+1st"><prosody pitch="2Hz"><emphasis level="strong">x</emphasis></prosody></prosody></utterance>', ["V12"]),
        ('<utterance><prosody><prosody><segment><prosody>x</prosody></segment></prosody></prosody></utterance>', ["V10"]),
        ("<utterance><other><pause/></other></utterance>", ["V16"]),
        ('<iml><utterance/><prosody pitch="?"/><odd/></iml>', ["V16"]),
        ('<!DOCTYPE u [<!ENTITY x "y">]><utterance>&x;</utterance>', ["V1"]),
        ("<utterance><utterance emotion='sad'/></utterance>", ["V3"]),
    ],
)
def test_markup_rules(spark, markup, broken):
    assert rules(spark, markup) == broken


def test_plain_text_and_serialising(spark):
    docs = parsed(
        spark,
        '<utterance>a<!-- c --><custom>b<pause duration="3"/></custom><pause>zz</pause>d</utterance>',
        '<iml version="1"><utterance emotion="calm" confidence="0.50">x &lt; y</utterance><utterance/></iml>',
        '<iml consent="explicit"><utterance>z</utterance></iml>',
        None,
    )
    assert dict(nodes.plain_text(docs).collect()) == {0: "ab d", 1: "x < y", 2: "z"}
    assert dict(nodes.plain_text(docs, comments="text").collect())[0] == "a c b d"
    assert dict(nodes.serialised(docs).collect()) == {
        0: '<utterance>ab<pause duration="0"/>d</utterance>',
        1: '<iml version="1"><utterance emotion="calm" confidence="0.5">x &lt; y</utterance><utterance></utterance></iml>',
        2: "<utterance>z</utterance>",
    }


def test_serialised_markup_parses_to_itself(spark):
    rows = text.predicted(spark.createDataFrame([(1, 'Well... I SAID "no way" today! Really? & so… on')], "doc_id long, text string"))
    assert nodes.serialised(shred.shredded(rows)).collect() == rows.collect()


def test_sentence_rules(spark):
    rows = spark.createDataFrame([(1, "Well... I suppose so."), (2, "Really?!"), (3, "  "), (4, None), (5, "Wait… what? IBM rocks!")], "doc_id long, text string")
    got = dict(text.predicted(rows).collect())
    assert got[1] == '<iml version="0.1.0"><utterance>Well<pause duration="500"/></utterance><utterance emotion="uncertain" confidence="0.6">I suppose so.</utterance></iml>'
    assert got[2] == '<iml version="0.1.0"><utterance emotion="joyful" confidence="0.6"><prosody pitch="+5%">Really?!</prosody></utterance></iml>'
    assert got[3] == got[4] == '<iml version="0.1.0"><utterance></utterance></iml>'
    assert '<prosody pitch_contour="rise">Wait<pause duration="500"/> what?</prosody>' in got[5]
    assert '<emphasis level="strong">IBM</emphasis> rocks!' in got[5]
    with pytest.raises(NotImplementedError):
        text.predicted(rows, model="other")


def words(spark, rows):
    base = {"f0_span": 10.0, "f0_low": 100.0, "f0_high": 110.0, "intensity_mean": 65.0, "speech_rate": 4.0, "jitter": 0.005, "shimmer": 0.03, "hnr": 18.0}
    kinds = "doc_id long, word_idx long, word string, start_ms long, end_ms long, f0_mean double, " + ", ".join(f"{k} double" for k in base)
    return spark.createDataFrame([(*r, *base.values()) for r in rows], kinds)


def test_utterances_pauses_and_emphasis(spark):
    rows = words(spark, [(1, 0, "Hi", 0, 100, 180.0), (1, 1, "there.", 150, 300, 180.0), (1, 2, "You", 320, 400, 100.0), (1, 3, "go", 700, 800, 300.0), (1, 4, "far", 1900, 2000, None)])
    got = [r["utt_idx"] for r in speech.utterances(rows).orderBy("word_idx").collect()]
    assert got == [0, 0, 1, 1, 2]
    markup = speech.assembled(rows).first()["markup"]
    assert ">Hi there.</utterance>" in markup
    assert '<emphasis level="strong"><prosody pitch="-50%">You</prosody></emphasis><pause duration="300"/><emphasis level="strong"><prosody pitch="+50%">go</prosody></emphasis>' in markup
    assert "f0_mean=" in speech.assembled(rows, extended=True).first()["markup"]


def test_emotion_ties_and_unknown(spark):
    kinds = "doc_id long, utt_idx long, " + ", ".join(f"{m} double" for m in speech.MEASURES)
    rows = spark.createDataFrame([(1, 0, *[None] * 7), (2, 0, 250.0, 200.0, 75.0, 6.0, 0.03, 0.1, 5.0), (3, 0, 205.0, 50.0, 70.0, 10.0, 0.0, 0.0, 0.0)], kinds)
    got = {r["doc_id"]: (r["emotion"], r["confidence"]) for r in speech.with_emotion(rows).collect()}
    assert got[1] == ("neutral", 0.5)
    assert got[2][0] == "angry"
    assert 0.3 <= got[3][1] <= 0.95


def test_last_feature_wins(spark):
    w = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 10, 20)], "doc_id long, word_idx long, start_ms long, end_ms long")
    f = spark.createDataFrame([(1, 0, 10, 0, 1.0), (1, 0, 10, 1, 2.0)], "doc_id long, start_ms long, end_ms long, feature_idx int, f0 double")
    assert {r["word_idx"]: r["f0"] for r in speech.joined_features(w, f).collect()} == {0: 2.0, 1: None}


def test_sessions(spark):
    kinds = "session_id string, seq long, duration_ms long, volume double, pitch_hz double, vibrato boolean, breathiness double"
    rows = spark.createDataFrame([("a", 0, 500, 0.9, 320.0, True, 0.1), ("a", 1, 500, 0.9, 340.0, False, 0.1), ("b", 0, 0, 0.1, 100.0, False, 0.1)], kinds)
    got = {r["session_id"]: r for r in sessions.features(rows).withColumn("e", sessions.emotion()).withColumn("c", sessions.confidence()).collect()}
    assert (got["a"]["e"], got["a"]["speech_rate"], got["a"]["vibrato_ratio"]) == ("angry", 2.0, 0.5)
    assert (got["b"]["e"], got["b"]["c"], got["b"]["speech_rate"]) == ("calm", 0.5, 1000.0)
    markup = {r["session_id"]: r["markup"] for r in sessions.session_markup(rows, spark.createDataFrame([("a", "x & y"), ("b", "")], "session_id string, transcript string")).collect()}
    assert markup["a"].endswith(">x &amp; y</utterance>")
    assert markup["b"] == '<utterance emotion="calm" confidence="0.50"></utterance>'


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_python_takes_many_groups_a_batch(spark):
    pauses = spark.createDataFrame([("a", "t", 0, 100), ("a", "p", 1, 150), ("a", "p", 0, 900), ("b", "t", 0, 5), (None, "p", 0, 5)], "k string, side string, ord int, ms int")
    scored = metrics.pause_scores(pauses, "k")
    assert "FlatMapGroups" not in _plan(scored)
    assert {r["k"]: tuple(r)[1:4] for r in scored.collect()} == {"a": (1, 2, 1), "b": (0, 0, 1), None: (0, 1, 0)}
    assert "FlatMapGroups" not in _plan(audio.rendered(parsed(spark, "<utterance>a</utterance>")))


def test_markup_is_dealt_to_tasks(spark):
    docs = spark.createDataFrame([(k, "<utterance>a</utterance>") for k in range(8)], "doc_id long, markup string").coalesce(1)
    assert "Exchange hashpartitioning(doc_id" in _plan(shred.shredded(docs))
    assert shred.shredded(docs).count() == 16
    # so are texts before their sentences are told apart
    made = text.predicted(docs.select("doc_id", F.lit("Well... yes!").alias("text")))
    assert _plan(made).count("REPARTITION_BY_NUM") == 1


def test_cues_in_one_pass(spark):
    made = parsed(spark, '<iml><utterance><pause duration="5"/><prosody pitch_contour="rise">x</prosody></utterance><utterance><pause duration="x"/></utterance></iml>', "<utterance>x</utterance>", '<utterance><prosody pitch_contour="">x</prosody><prosody pitch_contour="fall">y</prosody></utterance>')
    assert sorted(tuple(r) for r in nodes.cues(made).collect()) == [(0, 2, 5, 1), (2, None, None, 1)]
    assert _plan(nodes.cues(made)).count("MapInArrow") == 1


def test_slope_of_many_utterances_at_once():
    import pyarrow as pa

    from cadenza.plans.queries import _by_slope

    lists = [[1.0, None, 2.0], [None], [], [3.0, 1.0, None], [2.0, 9.0, 2.0]]
    spans = pa.array([[{"f0_mean": v} for v in x] for x in lists], pa.list_(pa.struct([("f0_mean", pa.float64())])))
    for cut in (spans, pa.concat_arrays([spans, spans]).slice(5)):
        emotions, confidences = _by_slope(cut)
        assert emotions.to_pylist() == ["joyful", "neutral", "neutral", "sad", "neutral"]
        assert confidences.to_pylist() == [0.75, 0.5, 0.5, 0.75, 0.5]


def test_sums_follow_the_order_of_events(spark):
    kinds = "session_id string, seq long, duration_ms long, volume double, pitch_hz double, vibrato boolean, breathiness double"
    events = [("a", k, 100, v, v, False, v) for k, v in enumerate((0.1, 0.2, 0.3))]
    for rows in (events, events[::-1]):
        for parts in (1, 3):
            got = sessions.features(spark.createDataFrame(rows, kinds).repartition(parts)).first()
            assert {got["mean_volume"], got["mean_pitch"], got["mean_breathiness"]} == {(0.1 + 0.2 + 0.3) / 3}


def test_sums_follow_the_order_of_words(spark):
    rows = [(1, 0, k, v, v) for k, v in enumerate((0.1, 0.2, 0.3))]
    for given in (rows, rows[::-1]):
        words = spark.createDataFrame(given, "doc_id long, utt_idx long, word_idx long, f0_mean double, intensity_mean double").coalesce(1)
        got = speech.deviations(words).select("base_f0", "base_intensity").distinct().collect()
        assert [tuple(r) for r in got] == [((0.1 + 0.2 + 0.3) / 3,) * 2]


def test_confidence_is_rounded_as_its_sql(spark):
    # 0.565 is a little less than it looks: 56.49999999999999 hundredths; 0.605 is 60.5 of them
    kinds = "session_id string, seq long, duration_ms long, volume double, pitch_hz double, vibrato boolean, breathiness double"
    rows = [(s, k, 100, 0.5, p * k, False, 0.1) for s, p in (("a", 32.5), ("b", 52.5), ("c", 37.5)) for k in (0, 1)]
    texts = spark.createDataFrame([(s, "x") for s in "abc"], "session_id string, transcript string")
    got = {r["session_id"]: r["markup"].split('confidence="')[1][:4] for r in sessions.session_markup(spark.createDataFrame(rows, kinds), texts).collect()}
    assert got == {"a": "0.56", "b": "0.61", "c": "0.57"}


def test_profiles(spark):
    table = spark.createDataFrame(adapters.PROFILE, "mapping_idx int, pattern map<string,string>, emotion string, boost double")
    seen = spark.createDataFrame([(1, {"pitch": "high", "volume": "loud"}, "neutral", 0.9), (2, {"pitch": "low", "quality": "tense", "rate": "fast"}, "neutral", 0.5), (3, {}, "sad", 0.4)], "k long, labels map<string,string>, base_emotion string, base_confidence double")
    got = sorted(tuple(r) for r in profiles.applied(seen, table, ["k"]).collect())
    assert [r[:2] for r in got] == [(1, "excited"), (2, "anxious"), (3, "sad")]
    assert got[0][2] == 1.0
    assert sorted(tuple(r) for r in profiles.ranked(seen, table, ["k"]).collect()) == got


def test_greedy_pause_match():
    assert metrics.matched([500, 700], [600]) == 1
    assert metrics.matched([500], [300, 700]) == 1
    assert metrics.matched([500], [701]) == 0
    assert metrics.matched([600, 500], [500, 700]) == 2


def test_metric_edges(spark):
    empty = spark.createDataFrame([], "confidence double, correct boolean")
    assert metrics.calibration_error(empty).first()["ece"] == 0.0
    edge = spark.createDataFrame([(0.3, True), (0.6, True), (1.0, True), (1.5, True)], "confidence double, correct boolean")
    assert {r["bin"] for r in metrics.calibration(edge).collect()} == {2, 5, 9, None}
    wanted = spark.createDataFrame([("a",), ("z",)], "label string")
    report = {r["label"]: r["support"] for r in metrics.class_report(spark.createDataFrame([("a", "b")], "truth string, predicted string"), wanted).collect()}
    assert report == {"a": 1, "z": 0}


def test_splits(spark):
    rows = spark.range(10)
    exact = [r["id"] for r in split.exact_split(rows, "id", 0.6, 0.2, 0.2).where("split = 'train'").orderBy("id").collect()]
    import random

    places = list(range(10))
    random.Random(42).shuffle(places)
    assert exact == sorted(places[:6])
    hashed = split.hashed_split(rows, "id", 0.6, 0.2, 0.2).groupBy("split").count().collect()
    assert dict(map(tuple, hashed)) == {"train": 6, "val": 2, "test": 2}
    with pytest.raises(ValueError):
        split.hashed_split(rows, "id", 0.5, 0.2, 0.2)


def test_sound_round_trip(spark, tmp_path):
    docs = parsed(spark, '<iml version="1"><utterance>one two<pause duration="100"/></utterance><utterance>x</utterance></iml>', "<utterance/>")
    sounds = {r["doc_id"]: r["wav"] for r in audio.rendered(docs).collect()}
    length = dict(nodes.rendered_samples(docs).collect())
    for k, data in sounds.items():
        samples, rate = audio.read_samples(bytes(data))
        assert (len(samples), rate) == (length[k], 22_050)
    samples = audio.tone(220.0, 1.0, 0.5)
    assert audio.measures(samples, 22_050)["f0_mean"] == pytest.approx(220, rel=0.02)
    assert audio.measures(np.zeros(0), 22_050)["f0_mean"] is None
    audio.write_wavs(audio.rendered(docs), f"file://{tmp_path}/wav")
    assert tables.read_sounds(spark, f"{tmp_path}/wav").count() == 2


def test_silence_and_peaks(spark):
    frames = spark.createDataFrame([("a", k, -60.0 if 5 <= k < 30 or k >= 80 else -10.0 - (k % 3)) for k in range(100)], "path string, frame long, db double")
    length = spark.createDataFrame([("a", 1003)], "path string, duration_ms long")
    assert [tuple(r)[1:] for r in audio.silent_runs(frames, length).orderBy("start_ms").collect()] == [(50, 300), (800, 1003)]
    assert audio.peaks(frames, ["path"]).first()["n_peaks"] > 10


def test_entries_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("e1", "t", "mavis", "en", "a.wav", "hi", "<utterance/>", "calm", "human", True)], ", ".join(f"{c} string" for c in validate.REQUIRED) + ", consent boolean")
    tables.write_dataset(rows, f"{tmp_path}/d", "d")
    back = validate.read_entries(spark, f"{tmp_path}/d")
    assert back.select("id", "consent", "speaker_id").first() == ("e1", True, None)
    assert {r["rule"] for r in validate.entry_issues(back, ["id"]).collect()} == {"D5"}
    tables.save_report(spark.createDataFrame([(0.123456, 1.23456)], "ece double, run_seconds double"), f"{tmp_path}/r")
    assert tables.load_report(spark, f"{tmp_path}/r").select("ece", "run_seconds", "num_failures").first() == (0.1235, 1.235, 0)


def test_learning_beats_chance(spark):
    entries = spark.range(240).select("id", F.element_at(F.lit(["angry", "calm", "sad", "joyful"]), (F.col("id") % 4 + 1).cast("int")).alias("e"))
    rows = learning.emotion_features(entries, "id", "e")
    model = learning.train(rows, "ser")
    right = learning.evaluated(model, rows).select(metrics.accuracy(F.col("truth") == F.col("predicted"))).first()[0]
    assert right > 0.9


def test_rate_limit_counts_accepted_only():
    ok, held = streaming.accepted([0, 10, 20, 65, 66], [], 2)
    assert ok == [True, True, False, True, False]
    assert held == [10, 65]


def test_pages_never_crash_the_shredder(spark, small_dir):
    pages = spark.read.parquet(f"{small_dir}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("html").alias("markup"))
    assert shred.shredded(pages).select("doc_id").distinct().count() == pages.count()


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    made = [("a", start + dt.timedelta(seconds=s)) for s in (0, 10, 20, 65, 66, 130)] + [("b", start)]
    rows = spark.createDataFrame(made, "client string, ts timestamp")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = streaming.rate_limited_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), 2)
    got = streaming.collected(stream, f"{tmp_path}/out", "append")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, streaming.rate_limited(rows, 2).collect()))


def test_exact_words_of_a_stub(spark):
    rows = spark.createDataFrame([("a.wav", 1200)], "path string, duration_ms long")
    assert tuple(tables.stub_words(rows).first()) == ("a.wav", 0, "[speech]", 0, 1200)


def test_markup_files(spark, tmp_path):
    (tmp_path / "one.xml").write_text("<utterance>\nhi</utterance>")
    assert tables.read_markup(spark, str(tmp_path)).first()["markup"] == "<utterance>\nhi</utterance>"


def test_models_save_and_load(spark, tmp_path):
    entries = spark.range(80).select("id", F.element_at(F.lit(["angry", "calm"]), (F.col("id") % 2 + 1).cast("int")).alias("e"))
    rows = learning.contour_features(entries, "id", "e")
    model = learning.train(rows, "pitch_contour")
    learning.save(model, f"{tmp_path}/m")
    again = learning.load(f"{tmp_path}/m")
    assert learning.evaluated(again, rows).collect() == learning.evaluated(model, rows).collect()
    (tmp_path / "c.yaml").write_text("task: ser\nmodel: {}\ndata: {}\ntraining: {}\nevaluation: {}\noutput: {}\n")
    assert learning.load_config(str(tmp_path / "c.yaml"))["task"] == "ser"
    (tmp_path / "d.yaml").write_text("task: ser\n")
    with pytest.raises(ValueError):
        learning.load_config(str(tmp_path / "d.yaml"))


def test_profile_files(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"profile_version": "1.0.0", "user_id": "", "prosody_mappings": [{"pattern": {"pitch": "high"}, "interpretation": {"emotion": "calm"}}]}')
    rows = profiles.read_profiles(spark, str(tmp_path))
    assert [r["rule"] for r in profiles.profile_issues(rows).collect()] == ["P2"]
    assert profiles.mappings(rows).first()["boost"] == 0.0


def walked(predicted, truth):
    free = dict(enumerate(truth))
    found = 0
    for p in predicted:
        near = [(abs(p - t), k) for k, t in free.items() if abs(p - t) <= metrics.TOLERANCE_MS]
        if near:
            found += 1
            del free[min(near)[1]]
    return found


def test_whole_pause_match_equals_a_walk(spark):
    rng = np.random.default_rng(3)
    for _ in range(300):
        p, t = (rng.integers(0, 1500, rng.integers(0, 12)).tolist() for _ in range(2))
        assert metrics.matched(p, t) == walked(p, t)
    rows = [("t", "b.json", 2, 1, 500), ("t", "a.json", 1, 1, 900), ("p", "a.json", 1, 2, 600), ("p", "b.json", 2, 3, 2000)]
    frame = spark.createDataFrame(rows, "side string, file_name string, entry_id long, pre int, ms long")
    assert tuple(benchmark.whole_pause_f1(frame).first()) == (1, 2, 2, 0.5)
    assert tuple(benchmark.whole_pause_f1(frame.where("false")).first()) == (0, 0, 0, 1.0)


def test_benchmark_of_itself(spark):
    markup = '<iml version="1.0"><utterance emotion="sad" confidence="1.0">a<pause duration="300"/><prosody pitch_contour="rise">b</prosody></utterance></iml>'
    entries = spark.createDataFrame([(k, f"{k}.json", markup, "sad") for k in range(4)], "entry_id long, file_name string, markup string, emotion_label string")
    got = benchmark.run(entries, entries.select("entry_id", "markup")).first()
    assert (got["emotion_accuracy"], got["confidence_ece"], got["pitch_accuracy"], got["pause_f1"], got["validity_rate"], got["num_samples"], got["num_failures"]) == (1.0, 0.0, 1.0, 1.0, 1.0, 4, 0)
    assert got["emotion_f1"] == {"sad": 1.0}
    few = benchmark.run(entries, entries.where("entry_id = 0").select("entry_id", F.lit("<utterance>").alias("markup")), max_samples=2).first()
    assert (few["num_samples"], few["num_failures"], few["validity_rate"], few["emotion_accuracy"], few["pause_f1"], few["emotion_f1"]) == (1, 1, 0.0, 0.0, 1.0, {})


def test_entries_of_sessions(spark):
    kinds = "session_id string, seq long, duration_ms long, volume double, pitch_hz double, vibrato boolean, breathiness double"
    rows = spark.createDataFrame([("a", 0, 500, 0.9, 320.0, True, 0.1), ("b", 0, 0, 0.1, 100.0, False, 0.1)], kinds)
    said = spark.createDataFrame([("a", "x & y", None, "s1"), ("b", "z", "sad", None), ("c", "no events", None, None)], "session_id string, transcript string, emotion_label string, speaker_id string")
    got = {r["id"]: r for r in sessions.entries(rows, said, "de").collect()}
    assert set(got) == {"mavis_a", "mavis_b"}
    assert (got["mavis_a"]["emotion_label"], got["mavis_a"]["speaker_id"], got["mavis_a"]["metadata"], got["mavis_a"]["language"]) == ("angry", "s1", {"mavis_events": "1"}, "de")
    assert got["mavis_b"]["emotion_label"] == "sad" and 'emotion="sad"' in got["mavis_b"]["iml"]


def test_late_rows_are_dropped_in_append_mode(spark, tmp_path):
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    kinds = "user_id long, ts timestamp, pitch_hz double, volume double, duration_ms long, vibrato boolean, breathiness double"
    for k, days in enumerate(((0, 9), (10,), (0, 11), (30,), (40,))):  # the third file's first row comes ten days late
        rows = spark.createDataFrame([(1, start + dt.timedelta(days=d), 100.0, 0.5, 10, False, 0.1) for d in days], kinds)
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{k}")
        for f in (tmp_path / f"in{k}").glob("*.parquet"):
            (tmp_path / "in").mkdir(exist_ok=True)
            f.rename(tmp_path / "in" / f"{k}.parquet")
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = streaming.collected(streaming.windowed(stream, "1 day"), f"{tmp_path}/out", "append")
    assert {r["window"]["start"].day: r["n_events"] for r in got.collect()}[1] == 1


def test_located_messages_and_low_confidence(spark):
    said = validate.located(F.lit("bad"), F.lit("a.xml"), F.lit(3))
    assert one(spark, said) == "bad (a.xml, line 3)"
    assert one(spark, validate.located(F.lit("bad"), F.lit(None).cast("string"), F.lit(None).cast("int"))) == "bad"
    rows = spark.createDataFrame([(0.4,), (0.5,), (None,)], "confidence double")
    assert [r[0] for r in validate.low_confidence(rows).collect()] == [0.4]


def test_exact_split_refuses_large_tables(spark, monkeypatch):
    monkeypatch.setattr(split, "MOST_ROWS", 10)
    with pytest.raises(ValueError):
        split.exact_split(spark.range(11), "id")


def test_failures_policy(spark):
    made = parsed(spark, "<utterance>a</utterance>", "<utterance>")
    plain = nodes.plain_text(made)
    assert {r["doc_id"]: r["plain"] for r in nodes.settled(made, plain).collect()} == {0: "a", 1: None}
    assert nodes.settled(made, plain, "drop").count() == 1
    with pytest.raises(Exception, match="document 1"):
        nodes.settled(made, plain, "fail").collect()
    with pytest.raises(ValueError):
        nodes.settled(made, plain, "maybe")


def test_training_report_and_export(spark, tmp_path):
    entries = spark.range(120).select("id", F.element_at(F.lit(["angry", "calm", "sad"]), (F.col("id") % 3 + 1).cast("int")).alias("e"))
    rows = learning.PREPARERS["pitch_contour"](entries, "id", "e").cache()
    first = rows.where("id = 0").first()
    assert len([c for c in rows.columns if c.startswith("f0_")]) == 20 and first["f0_19"] - first["f0_0"] > 20  # anger rises
    model = learning.train(rows.where("id < 90"), "pitch_contour")
    report = learning.training_report(model, "pitch_contour", rows.where("id < 90"), rows.where("id >= 90"))
    got = report.first()
    assert (got["n_train"], got["n_val"], got["n_features"]) == (90, 30, 20) and got["val_accuracy"] > 0.9
    assert learning.training_report(model, "pitch_contour", rows).first()["val_accuracy"] is None
    learning.export(model, report, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out/metadata").first()["task"] == "pitch_contour"
    assert learning.evaluated(learning.load(f"{tmp_path}/out/model"), rows).count() == 120


def test_own_classifier_and_converter(spark):
    w = spark.createDataFrame([(1, 0, "hi", 0, 10, 100.0, *[None] * 8)], "doc_id long, word_idx long, word string, start_ms long, end_ms long, f0_mean double, f0_span double, f0_low double, f0_high double, intensity_mean double, speech_rate double, jitter double, shimmer double, hnr double")
    sure = lambda rows: rows.withColumn("emotion", F.lit("calm")).withColumn("confidence", F.lit(0.9))
    assert speech.assembled(w, classify=sure).first()["markup"] == '<utterance emotion="calm" confidence="0.9">hi</utterance>'
    entries = spark.createDataFrame([(1, "a", '<utterance emotion="calm" confidence="1.0">x</utterance>', "calm")], "entry_id long, file_name string, markup string, emotion_label string")
    assert benchmark.of(lambda e: e.select("entry_id", "markup"), entries).first()["emotion_accuracy"] == 1.0


def test_entries_as_a_stream_and_metadata(spark, tmp_path):
    import json

    (tmp_path / "d" / "entries").mkdir(parents=True)
    for k in (2, 1):
        (tmp_path / "d" / "entries" / f"{k}.json").write_text(json.dumps({"id": f"e{k}", "audio_file": "a", "transcript": "t", "iml": "<utterance/>", "emotion_label": "calm", "consent": True}, indent=1))
    (tmp_path / "d" / "metadata.json").write_text('{"name": "d", "size": 2}')
    rows = validate.read_entries(spark, f"{tmp_path}/d")
    assert [r["id"] for r in rows.orderBy("file_name").collect()] == ["e1", "e2"]
    assert tables.read_metadata(spark, f"{tmp_path}/d").first()["size"] == 2
    got = streaming.collected(validate.entry_stream(spark, f"{tmp_path}/d").select("id"), f"{tmp_path}/s", "append")
    assert sorted(r["id"] for r in got.collect()) == ["e1", "e2"]
    split_rows = spark.createDataFrame([(1, "train"), (2, "test")], "id long, split string")
    tables.write_splits(split_rows, f"{tmp_path}/p")
    assert [tables.prepared(spark, f"{tmp_path}/p", x).count() for x in ("train", "val", "test")] == [1, 0, 1]


def test_vendor_is_reserved(spark):
    with pytest.warns(UserWarning, match="acme"):
        assert nodes.to_ssml(parsed(spark, "<utterance>a</utterance>"), vendor="acme").first()["ssml"].endswith("<s>a</s></speak>")
