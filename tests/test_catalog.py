"""The library as a whole, and its command line, over a folder of files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from samplelake.__main__ import main
from samplelake.catalog import Catalog, from_files
from samplelake.operators import postings as po
from samplelake.operators import search as se

from .test_wav import sample
from .test_writes import plain


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "lib"
    (root / "sub").mkdir(parents=True)
    for i, (vendor, category) in enumerate([("Mars", "KICK"), ("Mars", "LOOP"), ("Moon", "KICK"), ("Sun", "PAD")]):
        (root / "sub" / f"{category.lower()}_{i}.wav").write_bytes(sample(vendor=vendor, category=category, bpm=str(100 + i)))
    (root / "plain.wav").write_bytes(plain(vendor="Mars Two"))
    (root / "bad.wav").write_bytes(b"RIFF")
    return root


def said(spark, *arguments):
    out = []
    return main([str(a) for a in arguments], spark, out.append), out


def fresh(catalog):
    """The text index is what a new one of the samples would be."""
    assert catalog.text.version().notes["samples"] == str(catalog.samples.version().number)
    columns = ["field", "gram", "block", "offsets", "counts"]
    assert sorted(map(tuple, catalog.text.read().select(*columns).collect())) == sorted(map(tuple, po.postings(catalog.samples.read()).collect()))


def test_index_and_search(spark, folder, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "db"))
    run = catalog.index([str(folder)], buckets=4)
    assert (run.files_indexed, run.errors) == (5, 1)
    fresh(catalog)
    for query in ("mars", "ma", "kick @vendor=mars", "@bpm=102", "pad_3", "", "nothing here"):
        free, filters = se.parse_filters(query)
        scan = [] if 0 < len(free) < 3 else [r.path for r in se.search(catalog.samples.read(), se.SearchQuery(free_text=free, filters=filters, scope="name")).collect()]
        assert [r.path for r in catalog.search(query).collect()] == scan
    ids = {r.path: r.id for r in catalog.samples.read().collect()}
    assert sorted(ids.values()) == [1, 2, 3, 4, 5]

    catalog.mark(catalog.samples.read().filter("vendor = 'Moon'"))
    (folder / "sub" / "kick_0.wav").unlink()
    (folder / "new.wav").write_bytes(sample(vendor="Venus"))
    (folder / "plain.wav").write_bytes(plain(vendor="Mercury"))
    import os

    os.utime(folder / "plain.wav", (5, 5))
    run = catalog.index([str(folder)])
    assert (run.files_indexed, run.deleted) == (2, 1)
    fresh(catalog)
    run = catalog.index([str(folder)])
    assert run.files_indexed == 0
    rows = {r.name: r for r in catalog.samples.read().collect()}
    assert rows["new"].id == 6 and rows["plain"].id == ids[f"{folder}/plain.wav"] and rows["kick_2"].marked and not rows["new"].marked
    assert [r.vendor for r in catalog.search("mercury").collect()] == ["Mercury"]
    (folder / "last.wav").write_bytes(sample(vendor="Pluto"))
    catalog.index([str(folder)])
    fresh(catalog)


def test_embeddings_and_codes(spark, folder, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "db"))
    catalog.index([str(folder)], buckets=4)
    deal = np.random.default_rng(1)
    new = spark.createDataFrame([(r.path, deal.normal(size=8).tolist()) for r in catalog.samples.read().filter("vendor <> 'Sun'").collect()], "path string, vec array<float>")
    catalog.set_embeddings(new, 8)
    assert catalog.stats().first()["embedded"] == 4
    path = f"{folder}/sub/kick_0.wav"
    exact = catalog.similar(path, 3).collect()
    assert exact[0].path == path and len(exact) == 3
    book = deal.normal(size=(2, 16, 4)).tolist()
    assert catalog.encode(book, 1) == 4 and catalog.encode(book, 1) == 0
    assert catalog.similar(path, 3, book).collect()[0].path == path
    with pytest.raises(ValueError, match="no sample"):
        catalog.similar("/none")


def test_command_line(spark, folder, tmp_path, monkeypatch):
    place = tmp_path / "db"
    assert said(spark, "--vendor", "mars", "--no-db", folder) == (0, [f"{folder}/plain.wav", f"{folder}/sub/kick_0.wav", f"{folder}/sub/loop_1.wav"])
    code, out = said(spark, "--index", "--db-path", place, folder)
    assert code == 0 and out == ["5 indexed, 0 deleted, 1 errors, version 1"]
    assert said(spark, "--db-path", place, "--find", "kick", "--count") == (0, ["2"])
    assert said(spark, "--db-path", place, "--vendor", "none") == (1, [])
    assert said(spark, "--db-path", place, "--vendor", "none", "--count") == (1, ["0"])
    assert said(spark, "--db-path", place, "--vendor", "M[ao]", "--regex", "--bpm", "101-102")[1] == [f"{folder}/sub/kick_2.wav", f"{folder}/sub/loop_1.wav"]
    assert said(spark, "--db-path", place, "--vendor", "sun", "--category", "loop", "--or", "--limit", "1")[1] == [f"{folder}/sub/loop_1.wav"]
    assert '"vendor":"Sun"' in said(spark, "--db-path", place, "--vendor", "sun", "--json")[1][0]
    assert "vendor: Sun" in said(spark, "--db-path", place, "--vendor", "sun", "--verbose")[1][0]
    assert said(spark, "--db-path", place, "--vendor", "mars", f"{folder}/sub")[1] == [f"{folder}/sub/kick_0.wav", f"{folder}/sub/loop_1.wav"]
    assert said(spark, "--db-path", place, "--db-stats")[1][0].startswith("files: 5")


def test_workflow_by_command_line(spark, folder, tmp_path):
    script = tmp_path / "edit.py"
    script.write_text("def edit(sample):\n    sample.set('library', 'New ' + sample.vendor)\n")
    code, out = said(spark, "--no-db", "--vendor", "two", "-w", script, folder)
    assert code == 0 and "+ library: New Mars Two" in out[0]
    read = lambda: {r.name: r.library for r in from_files(spark, [str(folder)]).collect()}
    assert not any(read().values())
    assert said(spark, "--no-db", "--vendor", "two", "-w", script, "--commit", folder)[0] == 0
    assert read()["plain"] == "New Mars Two"
    code, out = said(spark, "--no-db", "--vendor", "sun", "-w", script, "--commit", folder)
    assert code == 1 and "PermissionError" in out[-1]
    assert said(spark, "--no-db", "--vendor", "sun", "-w", script, "--commit", "--force", folder)[0] == 0
    assert read()["pad_3"] == "New Sun"
    script.write_text("x = 1\n")
    with pytest.raises(ValueError, match="no function"):
        said(spark, "--no-db", "-w", script, folder)
