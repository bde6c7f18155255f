"""Committed tables: versions, untouched files, broken runs, two writers."""

import hashlib
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from samplelake.operators import index as ix
from samplelake.sources.table import Conflict, Table


def files(root):
    return {str(p.relative_to(root)): hashlib.md5(p.read_bytes()).hexdigest() for p in sorted(Path(root).rglob("part-*.parquet"))}


def rows(df):
    return {r.path: r.mtime for r in df.collect()}


@pytest.fixture
def table(spark, tmp_path):
    made = Table(spark, str(tmp_path / "t"))
    made.create(spark.range(200).select(F.concat(F.lit("/p/"), "id").alias("path"), F.col("id").alias("mtime")), ["path"], buckets=16)
    return made


def change(table, paths, mtime, attempts=3):
    new = table.spark.createDataFrame([(p, mtime) for p in paths], "path string, mtime long")
    return table.change(new, lambda old: ix.upsert(old, new, keep=(), order="mtime"), attempts=attempts)


def test_only_touched_buckets_are_written(spark, table):
    before, first = files(table.root), table.version()
    new = change(table, ["/p/7", "/p/new"], -1)
    after = files(table.root)
    assert {k: after[k] for k in before} == before
    moved = [b for b in new.places if new.places[b] != first.places.get(b)]
    assert 1 <= len(moved) <= 2 and new.number == 2
    want = {f"/p/{i}": i for i in range(200)}
    assert rows(table.read()) == want | {"/p/7": -1, "/p/new": -1}
    assert rows(table.read(first)) == want
    assert rows(table.read(table.version(1))) == want
    plan = table.read(new, moved).select(F.input_file_name().alias("f")).distinct().collect()
    assert all(any(f"_bucket={b}/" in r.f for b in moved) for r in plan)


def test_rows_can_go(spark, table):
    gone = spark.createDataFrame([("/p/3",), ("/p/9",), ("/none",)], "path string")
    table.change(gone, lambda old: ix.delete(old, gone))
    assert len(rows(table.read())) == 198
    everything = table.read(table.version())
    table.change(everything, lambda old: old.filter("false"))
    assert rows(table.read()) == {} and table.version().number == 3
    assert table.change(everything.filter("false"), lambda old: old).number == 3


def test_a_broken_run_leaves_the_old_version(spark, table, monkeypatch):
    before = rows(table.read())

    def stops(*_):
        raise OSError("lost")

    monkeypatch.setattr(table, "_commit", stops)
    with pytest.raises(OSError, match="lost"):
        change(table, ["/p/1"], -5)
    monkeypatch.undo()
    assert rows(table.read()) == before and table.version().number == 1
    failing = spark.range(1).select(F.concat(F.lit("/p/1"), F.raise_error(F.lit("broken")).cast("string")).alias("path"), F.lit(0).cast("long").alias("mtime"))
    with pytest.raises(Exception, match="broken"):
        table.change(spark.createDataFrame([("/p/1",)], "path string"), lambda old: failing)
    assert rows(table.read()) == before
    assert table.vacuum() >= 1 and rows(table.read()) == before


def test_two_writers(spark, table):
    """The second one finds its version taken, and does its work again on the first one's."""
    other = Table(spark, table.root)
    new = spark.createDataFrame([("/p/1", -1)], "path string, mtime long")
    met = []

    def make(old):
        if not met:
            met.append(change(other, ["/p/2"], -2).number)
        return ix.upsert(old, new, keep=(), order="mtime")

    assert table.change(new, make).number == 3 and met == [2]
    assert rows(table.read())["/p/1"] == -1 and rows(table.read())["/p/2"] == -2
    met.clear()
    with pytest.raises(Conflict):
        table.change(new, make, attempts=1)
    assert not [p for p in Path(table.root, "versions").iterdir() if p.name.startswith(".draft")]


def test_vacuum_and_strays(spark, table):
    for i in range(3):
        change(table, [f"/p/{i}"], -i)
    table.vacuum(keep=1)
    assert table.numbers() == [4] and len(rows(table.read())) == 200
    with pytest.raises(ValueError, match="no version"):
        table.version(2)
    with pytest.raises(ValueError, match="outside"):
        table.change(spark.createDataFrame([("/p/1",)], "path string"), lambda old: spark.range(99).select(F.col("id").cast("string").alias("path"), F.col("id").alias("mtime")))
    assert Table(spark, table.root + "x").exists() is False
    shutil.rmtree(table.root)


def test_notes(spark, table):
    assert table.change(spark.createDataFrame([], "path string"), lambda old: old, notes={"codebook": "4"}).notes == {"codebook": "4"}
    assert len(rows(table.read())) == 200
