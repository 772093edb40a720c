"""Dataset folders: round trip, order, errors that name the file, no metadata after a failed job."""

import json

import pytest
from conftest import SMALL, same_rows
from pyspark.sql import functions as F

from cadenza.plans.queries import ORACLE_SQL, QUERIES
from cadenza.sources import folders

ENTRY = {"id": "b", "audio_file": "b.wav", "transcript": "é\n", "iml": "<utterance/>", "emotion_label": "calm"}


def lay(home, **files):
    (home / "entries").mkdir(parents=True)
    for name, text in files.items():
        (home / "entries" / f"{name}.json").write_text(text)
    return str(home)


def rows_of(spark, *ids):
    rows = [(i, f"{i}.wav", f"é {i}\n", "<utterance/>", "calm", True) for i in ids]
    return spark.createDataFrame(rows, "id string, audio_file string, transcript string, iml string, emotion_label string, consent boolean")


def test_round_trip(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/set"
    folders.write(rows_of(spark, *(f"e{k:03}" for k in range(50))).repartition(5), path, title="t", source="made")
    assert json.loads((tmp_path / "set" / "metadata.json").read_text()) == {"name": "t", "version": "1.0", "source": "made", "size": 50}
    assert sorted(p.name for p in (tmp_path / "set" / "entries").iterdir()) == [f"e{k:03}.json" for k in range(50)]
    monkeypatch.setattr(folders, "OPEN_BYTES", folders.TASK_BYTES // 7)  # several tasks
    got = folders.read(spark, path).collect()
    assert [r["file_name"] for r in got] == [f"e{k:03}.json" for k in range(50)]  # files lie in tasks by name
    assert [(r["id"], r["transcript"], r["consent"], r["speaker_id"], r["source"]) for r in got[:1]] == [("e000", "é e000\n", True, None, "")]
    folders.write(rows_of(spark, "new"), path)
    assert (folders.read(spark, path).count(), json.loads((tmp_path / "set" / "metadata.json").read_text())["size"]) == (51, 51)
    folders.write(rows_of(spark, "only"), path, mode="overwrite")
    assert [r["id"] for r in folders.read(spark, path).collect()] == ["only"]


def test_an_empty_folder_has_no_rows(spark, tmp_path):
    folders.write(rows_of(spark, "x").limit(0), f"{tmp_path}/set")
    assert folders.read(spark, f"{tmp_path}/set").count() == 0
    assert json.loads((tmp_path / "set" / "metadata.json").read_text())["size"] == 0


@pytest.mark.parametrize(("text", "said"), [("{", "cannot read entry bad.json"), ("", "cannot read entry bad.json"), ("[]", "cannot read entry bad.json: not an object"), ('{"id": "x"}', "cannot read entry bad.json: missing: audio_file")])
def test_what_is_no_entry_is_named(spark, tmp_path, text, said):
    home = lay(tmp_path / "set", a=json.dumps(ENTRY), bad=text)
    with pytest.raises(Exception, match=said):
        folders.read(spark, home).collect()


def test_a_folder_without_entries_fails(spark, tmp_path):
    (tmp_path / "set").mkdir()
    for path, said in ((f"{tmp_path}/set", "no such directory: .*set/entries"), (f"{tmp_path}/none", "no such directory: .*none")):
        with pytest.raises(Exception, match=said):
            folders.read(spark, path).collect()


@pytest.mark.parametrize("ids", [["a", "b", "a"], ["a", None], ["a", "x/y"], ["a", ".hidden"]])
def test_a_failed_job_leaves_no_metadata(spark, tmp_path, ids):
    home = tmp_path / "set"
    folders.write(rows_of(spark, "first"), str(home))
    with pytest.raises(Exception, match="different ids|no file can be named"):
        folders.write(rows_of(spark, *ids), str(home))
    assert not (home / "metadata.json").exists()


def test_a_repeated_task_adds_nothing(spark, tmp_path):
    home = tmp_path / "set"
    folders.write(rows_of(spark, "a", "b"), str(home))
    writer = folders.FolderWriter(str(home), {"name": "set"}, True)
    batches = rows_of(spark, "a", "b").select("id", F.to_json(F.struct("*")).alias("raw")).toArrow().to_batches()
    writer.write(iter(batches))  # this attempt's message is lost
    writer.commit([writer.write(iter(batches)), None])
    assert sorted(p.name for p in home.rglob("*") if p.is_file()) == ["a.json", "b.json", "metadata.json"]


def test_query_equals_its_sql(spark):
    same_rows(QUERIES["entry_folder"](spark, SMALL), ORACLE_SQL["entry_folder"], SMALL)
