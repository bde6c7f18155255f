"""Index runs over a folder: new files only, errors counted, broken ones tried again."""

import os
import time

import pytest

from samplelake.operators import stats as st
from samplelake.sources import wav
from samplelake.sources.table import Table
from samplelake.streaming import incremental as inc

from .test_wav import sample


def paths(table, root):
    return {r.path.removeprefix(f"{root}/"): (r.vendor, r.name) for r in table.read().collect()}


def test_runs_follow_the_folder(spark, tmp_path, monkeypatch):
    root, table = tmp_path / "lib", Table(spark, str(tmp_path / "index"))
    (root / "one" / "two").mkdir(parents=True)
    for i in range(6):
        (root / "one" / f"{i}.wav").write_bytes(sample(vendor=f"V{i}"))
    (root / "one" / "two" / "x.y.wav").write_bytes(sample(vendor="X"))
    (root / "bad.wav").write_bytes(b"RIFF")
    first = inc.index_folder(spark, [str(root)], table, buckets=8)
    assert (first.files_indexed, first.errors, first.deleted, first.version) == (7, 1, 0, 1)
    assert paths(table, root)["one/two/x.y.wav"] == ("X", "x.y")

    (root / "one" / "0.wav").write_bytes(sample(vendor="new"))
    os.utime(root / "one" / "0.wav", (1, 1))
    (root / "one" / "1.wav").unlink()
    (root / "bad.wav").write_bytes(sample(vendor="mended"))
    (root / "late.wav").write_bytes(sample(vendor="late"))
    read, headers = [], wav.read_headers
    monkeypatch.setattr(inc.wav, "read_headers", lambda files, *more: read.append(sorted(r.path.removeprefix(f"{root}/") for r in files.collect())) or headers(files, *more))
    second = inc.index_folder(spark, [str(root)], table)
    assert read == [["bad.wav", "late.wav", "one/0.wav"]]
    assert (second.files_indexed, second.errors, second.deleted, second.version) == (3, 0, 1, 2)
    got = paths(table, root)
    assert got["one/0.wav"] == ("new", "0") and got["bad.wav"][0] == "mended" and "one/1.wav" not in got and len(got) == 8

    third = inc.index_folder(spark, [str(root)], table)
    assert (third.files_indexed, third.deleted, third.version) == (0, 0, 2) and read[-1] == []
    assert inc.index_folder(spark, [str(root)], table, force=True).files_indexed == 8
    assert inc.index_folder(spark, [f"{root}/none"], table).errors == 1 and len(paths(table, root)) == 8


def test_counts_agree_with_the_rows(spark, tmp_path):
    rows = spark.createDataFrame([("a", None), ("b", "ValueError: x"), ("c", None)], "path string, error string")
    assert tuple(st.run_stats(rows).first()) == (2, 1)


@pytest.mark.parametrize("n", [0, 1, 500])
def test_ranks(spark, n):
    rows = spark.range(n).selectExpr("id", "(id * 7919) % 500 AS k").repartition(5)
    assert sorted((r.k, r.place) for r in st.ranked(rows, [rows.k]).collect()) == [(k, i + 1) for i, k in enumerate(sorted((i * 7919) % 500 for i in range(n)))]


def running(spark):
    tracker = spark.sparkContext.statusTracker()
    return len(tracker.getActiveJobsIds())


def slow(spark, seconds):
    """Eight tasks that sleep for each row."""

    def run(batches):
        for batch in batches:
            time.sleep(seconds)
            yield batch

    return spark.range(0, 80, 1, 8).mapInArrow(run, "id long")


def test_a_cancelled_search_stops_its_tasks(spark):
    other = inc.Search(slow(spark, 1))
    search = inc.Search(slow(spark, 120))
    deadline = time.time() + 30
    while running(spark) < 2 and time.time() < deadline:
        time.sleep(0.1)
    began = time.time()
    search.cancel()
    assert search.wait(20) and time.time() - began < 20 and list(search) == []
    assert sorted(r.id for r in other) == list(range(80))
    while running(spark) and time.time() < deadline:
        time.sleep(0.1)
    assert running(spark) == 0


def test_searches_end_by_themselves_or_with_their_error(spark):
    search = inc.Search(spark.range(5000), ahead=7)
    assert sorted(r.id for r in search) == list(range(5000)) and search.wait(10)
    with pytest.raises(Exception, match="broken"):
        list(inc.Search(spark.range(3).selectExpr("raise_error('broken') AS x")))
    seen = []
    for row in inc.results(spark.range(10**6), lambda: len(seen) >= 5):
        seen.append(row.id)
    assert seen == [0, 1, 2, 3, 4]
