"""Preprocessing, codebook versions, the search runner, run statistics and repeated paths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from samplelake.functions import vectors as ve
from samplelake.operators import index as ix
from samplelake.operators import signal as sg
from samplelake.operators import similar as si
from samplelake.operators import stats as st
from samplelake.operators import workflow as wf
from samplelake.operators.runner import SearchRunner
from samplelake.plans.adapters import view

from .oracle import SF


def test_preprocess():
    loud = np.concatenate([np.zeros(10), np.full(20, 0.5), [-0.25], np.zeros(5)])
    out = sg.preprocess(np.stack([loud, loud], 1), 48_000, 30)
    assert out.dtype == np.float32 and len(out) == 30 and out[0] == pytest.approx(10 ** (-1 / 20)) and not out[21:].any()
    assert out[20] == pytest.approx(-(10 ** (-1 / 20)) / 2)
    assert np.abs(sg.preprocess(np.arange(101.0)[:, None] / 100, 48_000, 11)).max() == pytest.approx(10 ** (-1 / 20))
    assert sg.preprocess(np.zeros((5, 2)), 48_000, 4) is None and sg.preprocess(None, 48_000, 4) is None
    with pytest.raises(ValueError):
        sg.preprocess(loud[:, None], 44_100, 4)


def test_preprocess_files(spark):
    files = spark.createDataFrame([("a", bytearray(b"\x40\x40")), ("b", bytearray(b"")), ("c", bytearray(b"\x00"))], "path string, content binary")

    def decode(raw):
        if not raw:
            raise EOFError("no header")
        return np.frombuffer(raw, np.int8).astype(float)[:, None] / 128, 48_000

    rows = {r.path: r for r in sg.preprocess_files(files, decode, 3).collect()}
    assert len(rows["a"].signal) == 3 and rows["b"].error == "EOFError: no header" and rows["c"].signal is None and rows["c"].error is None
    assert st.run_stats(spark.createDataFrame([(None,), ("x",), (None,)], "error string")).first() == (2, 1)


def test_codebook_versions(spark, tmp_path):
    folder = f"file://{tmp_path}/books"
    assert si.codebook_versions(spark, folder) == []
    with pytest.raises(ValueError):
        si.load_codebook(spark, folder)
    first, second = (np.full((2, 3, 4), x, np.float32) for x in (1, 2))
    assert si.save_codebook(spark, first, folder) == 1 and si.save_codebook(spark, second, folder) == 2
    version, book = si.load_codebook(spark, folder, 2, 3, 4)
    assert version == 2 and (book == 2).all()
    (tmp_path / "books" / "version=x").mkdir()
    with pytest.raises(ValueError):
        si.codebook_versions(spark, folder)


def test_codes_at_full_size(spark):
    rng = np.random.default_rng(1)
    book = rng.normal(size=(128, 256, 4))
    x = rng.normal(size=(40, 512)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(40, None), (41, [1.0])]
    df = spark.createDataFrame(rows, "id long, vec array<float>").select("id", ve.encode(F.col("vec"), book.tolist()).alias("code"))
    table = ve.query_table(x[0].tolist(), book.tolist())
    got = {r.id: r for r in df.withColumn("sq", ve.table_distance(F.col("code"), table)).collect()}
    want = ((x.astype(float).reshape(40, 128, 1, 4) - book[None]) ** 2).sum(3).argmin(2)
    assert all(list(got[i].code) == want[i].tolist() for i in range(40)) and got[40].code is None and got[41].sq is None
    assert got[3].sq == pytest.approx(sum(table[m][k] for m, k in enumerate(want[3])))


def test_exact_search_can_be_refused(spark):
    vectors = view(spark, SF, "vectors")
    assert si.similar(vectors, 7, 3, max_exact=10**6).count() == 3
    with pytest.raises(ValueError):
        si.similar(vectors, 7, 3, max_exact=10)


def test_ranks_are_the_order(spark):
    rows = [(i, f"{(i * 7919) % 1009:04d}") for i in range(1009)]
    got = {r.k: r.place for r in st.ranked(spark.createDataFrame(rows, "i long, k string").repartition(7), [F.col("k")]).collect()}
    assert [got[k] for k in sorted(got)] == list(range(1, 1010))
    assert st.ranked(spark.createDataFrame([], "k string"), [F.col("k")]).count() == 0


def test_search_runner(spark):
    samples = view(spark, SF, "samples").withColumn("id", F.col("id"))
    runner = SearchRunner(samples, view=5)
    assert runner.snapshot() == [] and runner.selected() is None
    n = runner.run("ring")
    paths = sorted(r.path for r in samples.collect() if "ring" in (r.path + r.name + r.description).lower())
    assert n >= len(paths) > 5 and len(runner.snapshot()) == 5
    assert runner.move(-3) == 0 and runner.move(10**9) == n - 1 and runner.selected().place == n
    vectors = samples.select("id", "path", F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("vec"))
    assert runner.enter_similarity(vectors, 7, 4) == 4 and runner.selected().id == 7
    runner.leave_similarity()
    assert runner.total == n and runner.selection == n - 1


def test_last_row_of_a_path_wins(spark):
    old = spark.createDataFrame([(1, "/a", 1, True), (2, "/b", 1, False)], "id long, path string, mtime long, marked boolean")
    new = spark.createDataFrame([("/a", 5), ("/a", 9), ("/a", 7), ("/c", 1)], "path string, mtime long").coalesce(1)
    assert {r.path: (r.id, r.mtime, r.marked) for r in ix.upsert(old, new).collect()} == {"/a": (1, 7, True), "/b": (2, 1, False), "/c": (None, 1, False)}
    assert {r.path: r.mtime for r in ix.upsert(old, new, order="mtime").collect()}["/a"] == 9


def test_scripts_report_errors(spark):
    samples = view(spark, SF, "samples").limit(3)

    def script(sample):
        raise KeyError("no such field")

    rows = wf.run_script(samples, script, "wrong").collect()
    assert [r.wrong for r in rows] == ["KeyError: 'no such field'"] * 3 and rows[0].path
