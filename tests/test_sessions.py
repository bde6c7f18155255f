import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from samplelake.operators import index as ix
from samplelake.operators import similar as si
from samplelake.operators import workflow as wf
from samplelake.schema import upgrade
from samplelake.sources import tables as tb
from samplelake.sources.table import Table
from samplelake.streaming import fsm
from samplelake.streaming.incremental import follow, results


def run(machine, *events):
    state, step = fsm.MACHINES[machine]
    state, asked = state(), []
    for e in events:
        state, out = step(state, *(e if isinstance(e, tuple) else (e, None)))
        asked += out
    return state, asked


def test_search_machine():
    state, asked = run("search", ("QueryChanged", "kick"), "DebounceTick", "SearchStarted", "SearchSettled", "DebounceTick")
    assert asked == ["SpawnSearch(kick)"] and state["transport"] == "Settled"
    state, asked = run("search", "EnterSimilarityMode", ("QueryChanged", "x"), "DebounceTick", "ExitSimilarityMode")
    assert asked == ["CancelSearch", "FilterSimilarity(x)"] and state["dirty"] and state["transport"] == "Idle"


def test_playback_machine():
    state, asked = run("playback", "Pause", "Play", "Pause", "Play", ("Seek", 5), "Restart", "ConsumeRestart", "Stop")
    assert asked == ["Start", "Pause", "Resume", "Stop"] and state == fsm.playback_start()
    assert run("playback", "Play", "ToggleLoop", "ProgramEnded")[0]["pending_restart"]


def test_marker_machine():
    state, _ = run("marker", ("SetMarker1", 100), ("SetMarker2", 300), ("ClearNearest", 200))
    assert state["A"]["marks"] == [fsm.NONE, 300, fsm.NONE] == state["B"]["marks"]
    state, _ = run("marker", "SelectPrev", "IncrementRep", "ToggleMarkerDisplay", ("SetMarker1", 1))
    assert state["selection"] is None and state["A"]["marks"][0] == fsm.NONE and state["A"]["reps"][0] == 1
    state, _ = run("marker", "ToggleBankSync", ("MarkerReset", [0, 400]), "SelectNext", "SelectNext", ("NudgeBackward", 500))
    assert state["A"]["marks"] == [0, 200, 300] and state["B"]["marks"] == [fsm.NONE] * 3


def test_stream_folds_as_batch(spark, tmp_path):
    rows = [("a", i, e, None) for i, e in enumerate(["Play", "Pause", "Resume", "Stop"])] + [("b", 0, "Play", None)]
    events = spark.createDataFrame(rows, "session string, seq long, input string, payload string")
    events.coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = fsm.fold_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")), "playback")
    q = stream.writeStream.format("memory").queryName("folded").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(spark.table("folded").collect()) == sorted(fsm.fold(events, "playback").collect())


def test_index_follows_a_stream(spark, tmp_path):
    listing = spark.createDataFrame([("/a", 1), ("/b", 2)], "path string, mtime long")
    listing.write.parquet(str(tmp_path / "new"))
    table = Table(spark, str(tmp_path / "table"))
    table.create(spark.createDataFrame([("/a", 0), ("/c", 3)], "path string, mtime long"), ["path"], buckets=4)
    stream = spark.readStream.schema(listing.schema).parquet(str(tmp_path / "new"))
    follow(stream, table, str(tmp_path / "cp")).awaitTermination()
    assert sorted(tuple(r) for r in table.read().collect()) == [("/a", 1), ("/b", 2), ("/c", 3)]


def test_results_can_be_cancelled(spark):
    seen = []
    for row in results(spark.range(100), lambda: len(seen) >= 5):
        seen.append(row.id)
    assert seen == [0, 1, 2, 3, 4]


def test_marks_and_markers_as_text(spark, tmp_path):
    marks = spark.createDataFrame([("/b",), ("/a",)], "path string")
    tb.write_marks(marks, str(tmp_path / "marks"))
    assert sorted(r.path for r in tb.read_marks(spark, str(tmp_path / "marks")).collect()) == ["/a", "/b"]
    (tmp_path / "m.csv").write_text("bank,m1,m2,m3,r1,r2,r3,r4\nA,1,2,3,1,1,1,1\nA,5,x,7,1,y,0,15\nC,1,1,1,1,1,1,1\nB,1,2\n")
    rows = {r.bank: tuple(r)[1:] for r in tb.read_markers(spark, str(tmp_path / "m.csv")).collect()}
    assert rows == {"A": (5, fsm.NONE, 7, 1, 0, 0, 15), "B": (fsm.NONE,) * 3 + (0,) * 4}


def test_settings(tmp_path, monkeypatch):
    (tmp_path / "s.toml").write_text("threshold = 99999\nlimit = 0\n")
    got = tb.settings(str(tmp_path), file=str(tmp_path / "s.toml"))
    assert (got.threshold, got.limit, got.source) == (32767, 1, "index")
    (tmp_path / "s.toml").write_text("= broken")
    with pytest.warns(UserWarning):
        assert tb.settings("/nowhere", file=str(tmp_path / "s.toml")).source == "files"
    monkeypatch.setenv("SAMPLELAKE_DB", str(tmp_path))
    assert tb.settings().location == str(tmp_path)


def test_every_setting(tmp_path):
    file = tmp_path / "s.toml"
    file.write_text('columns = ["bpm", "nope", "vendor"]\nsort = "bpm"\ndescending = true\npeak_channel = "left"\nstep_small = 0\ncents_coarse = 5000\nreset_volume = false\nmarks_file = "/m.csv"\nbpm_fine = 2')
    got = tb.settings("x", file=str(file))
    assert got.columns == ("bpm", "vendor") and (got.sort, got.descending, got.peak_channel, got.marks_file, got.reset_volume) == ("bpm", True, "left", "/m.csv", False)
    assert (got.step_small, got.cents_coarse, got.bpm_fine, got.step_large) == (0.01, 1200.0, 2.0, 1.0)
    file.write_text('sort = "nope"\nlimit = "many"\ncolumns = []')
    with pytest.warns(UserWarning):
        got = tb.settings("x", file=str(file))
    assert got == tb.settings("x")


def test_codebook_and_embedding_bytes():
    book = np.arange(128 * 256 * 4, dtype=np.float32).reshape(128, 256, 4)
    assert (si.unpack_codebook(si.pack_codebook(book)) == book).all()
    with pytest.raises(ValueError):
        si.unpack_codebook(b"\0")
    with pytest.raises(ValueError):
        si.pack_embedding([1.0])
    assert si.unpack_embedding(b"\0") is None and si.unpack_embedding(si.pack_embedding([0.5] * 512)).shape == (512,)


def test_limits(spark):
    vectors = spark.createDataFrame([(1, "/1", [1.0, 0.0]), (2, "/2", [0.9, 0.1]), (3, "/3", [0.0, 1.0])], "id long, path string, vec array<float>")
    assert [r.id for r in si.similar(vectors, 1, 2).collect()] == [1, 2]
    assert si.similar(vectors, 9, 3).collect()[0].path == ""
    with pytest.raises(ValueError):
        si.similar(vectors, 1, 0)


def test_script_errors_leave_the_row(spark):
    def bad(s):
        s.set("vendor", "changed")
        raise RuntimeError

    rows = spark.createDataFrame([("/a", "v")], "path string, vendor string")
    assert wf.run_script(rows, bad).collect()[0].vendor == "v"
    with pytest.raises(AttributeError):
        wf.Sample({"take": ""}).set("take", "x")
    assert "- a: x" in wf.diff_text([{"field": "a", "old": "x", "new": "y"}])


def test_empty_and_repeated_rows(spark):
    old = spark.createDataFrame([], "path string, mtime long, marked boolean")
    new = spark.createDataFrame([("/a", 1), ("/a", 2)], "path string, mtime long")
    assert ix.upsert(old, new).count() == 1
    assert ix.refresh(old, new.filter("false")).count() == 0


def test_schema_versions(spark):
    assert "embedding" in upgrade(spark.range(1), 1).columns
    with pytest.raises(ValueError):
        upgrade(spark.range(1), 3)


def test_json_payload(spark):
    events = spark.createDataFrame([("a", 0, "SetMarker1", "7")], "session string, seq long, input string, payload string")
    assert json.loads(fsm.fold(events, "marker").select(F.col("state")).head()[0])["A"]["marks"][0] == 7
