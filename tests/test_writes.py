"""In-place writes: one file, many files, broken writes, repeated attempts."""

import os
import threading

import pytest

from samplelake.operators import workflow as wf
from samplelake.sources import wav
from samplelake.sources import writes as wr

from .test_wav import block, chunk, fmt, riff


def plain(**fields):
    return riff(chunk(b"bext", block(False, **fields)), chunk(b"fmt ", fmt()), chunk(b"data", b"\0\0" * 50))


def meta(path):
    with open(path, "rb") as f:
        return wav.read_metadata(f)


def test_one_file(tmp_path):
    path = tmp_path / "a.wav"
    raw = plain()
    path.write_bytes(raw)
    diff = [("vendor", "", "Maß"), ("category", "", "LOOPS"), ("take", "", "7"), ("description", "", "no")]
    wr.write_changes(str(path), diff)
    assert path.read_bytes() == raw
    assert wr.write_changes(str(path), diff, commit=True) == ["vendor", "category"]
    got = meta(path)
    assert path.stat().st_size == len(raw) and got["packed"] and got["vendor"] == "Ma?" and got["category"] == "LOOP" and got["take"] == ""
    before = path.read_bytes()
    assert wr.write_changes(str(path), diff, commit=True) == ["vendor", "category"] and path.read_bytes() == before
    with pytest.raises(PermissionError):
        wr.write_changes(str(path), [("vendor", "", "other")], commit=True)
    wr.write_changes(str(path), [("vendor", "", "other"), ("bpm", "", "98")], force=True, commit=True)
    assert meta(path)["vendor"] == "other" and meta(path)["bpm"] == 98 and meta(path)["file_id"] == got["file_id"]
    wr.write_markers(str(path), b"\1" * 32, commit=True)
    assert meta(path)["markers"] == b"\1" * 32
    with pytest.raises(ValueError, match="no such place"):
        wr.write_field(str(path), 600, b"abc", commit=True)
    other = tmp_path / "b.wav"
    other.write_bytes(plain())
    with pytest.raises(ValueError, match="packed"):
        wr.write_markers(str(other), b"\1" * 32, commit=True)
    first = wr.init_packed(str(other), commit=True)
    assert wr.init_packed(str(other), commit=True) == first == meta(other)["file_id"]
    with pytest.raises(ValueError, match="in place"):
        wr.write_field("s3://bucket/a.wav", 0, b"x")


@pytest.mark.parametrize("stop", ["note", "begun", "body"])
def test_a_broken_write_is_completed_or_never_was(tmp_path, monkeypatch, stop):
    path = tmp_path / "a.wav"
    raw = plain(vendor="old")
    path.write_bytes(raw)
    diff, put = [("vendor", "", "new"), ("key", "", "Am")], wr._put

    def broken(f, at, new):
        if stop == "body":
            f.seek(at + 8)
            f.write(new[8:300])
            f.flush()
        raise KeyboardInterrupt

    monkeypatch.setattr(wr, "_put", broken)
    with pytest.raises(KeyboardInterrupt):
        wr.write_changes(str(path), diff, commit=True)
    monkeypatch.setattr(wr, "_put", put)
    assert not meta(path)["packed"]
    note = tmp_path / ("a.wav" + wr.JOURNAL)
    if stop == "note":
        note.write_bytes(note.read_bytes()[:-9])
    assert wr.write_changes(str(path), diff, commit=True) == ["vendor", "key"]
    got = meta(path)
    assert (got["vendor"], got["key"], got["packed"]) == ("new", "Am", True) and not note.exists() and path.stat().st_size == len(raw)


def test_two_writers_wait_for_each_other(tmp_path):
    path = tmp_path / "a.wav"
    path.write_bytes(plain())
    fields = ["vendor", "library", "category", "sound_id", "key", "comment", "rating", "umid"]
    threads = [threading.Thread(target=wr.write_changes, args=(str(path), [(f, "", f[:4])], True, True)) for f in fields for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert all(meta(path)[f] == f[:4] for f in fields)


def test_a_folder_of_files(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"{i}.wav").write_bytes(plain(vendor=f"v{i}"))
    (tmp_path / "bad.wav").write_bytes(b"RIFF")
    rows = [(f"{tmp_path}/{i}.wav", f, v) for i in range(30) for f, v in (("vendor", f"n{i}"), ("category", "LOOP"), ("take", "no"))] + [(f"{tmp_path}/bad.wav", "vendor", "x"), (f"{tmp_path}/gone.wav", "vendor", "x"), (None, "vendor", "x")]
    changes = spark.createDataFrame(rows, "path string, field string, value string").repartition(6)
    dry = wr.write_fields(changes)
    assert dry.count() == 32 and not any(meta(tmp_path / f"{i}.wav")["packed"] for i in range(30))
    for _ in range(2):  # a run that is repeated finds all of it done
        report = {r.path: r for r in wr.write_fields(changes, commit=True, tasks=5).collect()}
        assert sum(r.error is None for r in report.values()) == 30
        assert "ValueError" in report[f"{tmp_path}/bad.wav"].error and "FileNotFoundError" in report[f"{tmp_path}/gone.wav"].error
        assert report[f"{tmp_path}/3.wav"].fields == ["category", "vendor"]
    assert all((meta(tmp_path / f"{i}.wav")["vendor"], meta(tmp_path / f"{i}.wav")["category"]) == (f"n{i}", "LOOP") for i in range(30))
    again = {r.path: r.error for r in wr.write_fields(changes.filter("field = 'vendor'").selectExpr("path", "field", "'z' AS value"), commit=True).collect()}
    assert sum("PermissionError" in (e or "") for e in again.values()) == 30
    assert not [n for n in os.listdir(tmp_path) if n.endswith(wr.JOURNAL)]


def test_a_workflow_is_written_back(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"{i}.wav").write_bytes(plain(vendor=f"v{i}", library="L"))
    before = wav.read_headers(spark.createDataFrame([(f"{tmp_path}/{i}.wav",) for i in range(4)], "path string")).drop("error", "peaks")

    def script(row):
        if row.vendor != "v2":
            row.set("vendor", row.vendor.upper())
            row.set("comment", "seen")

    diffs = wf.changes(before, wf.run_script(before, script)).cache()
    report = wr.write_fields(wr.changed_fields(diffs), commit=True)
    assert report.filter("error IS NULL").count() == 3
    after = wav.read_headers(before.select("path"))
    assert sorted((r.vendor, r.comment) for r in after.collect()) == [("V0", "seen"), ("V1", "seen"), ("V3", "seen"), ("v2", "")]
