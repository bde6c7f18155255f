"""The text index against scans: build, search, changes, and what a search reads."""

import random
import re

import pytest
from pyspark.sql import functions as F

from samplelake.operators import postings as po
from samplelake.operators import search as se
from samplelake.operators import stats as st
from samplelake.sources.table import Table

SCHEMA = "id long, path string, " + ", ".join(f"{f} string" for f in po.FIELDS)


def rows(deal, ids):
    word = lambda: "".join(deal.choice("abAB é") for _ in range(deal.randint(0, 9)))
    return [(i, f"/p/{i}", *[word() if deal.random() < 0.9 else None for _ in po.FIELDS]) for i in ids]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    deal = random.Random(1)
    data = rows(deal, [*range(300), *range(65_500, 65_600), 2**40])
    samples = spark.createDataFrame(data, SCHEMA).cache()
    table = Table(spark, str(tmp_path_factory.mktemp("index") / "t"))
    po.build(table, samples, buckets=8, spread=2)
    return samples, table


@pytest.mark.parametrize("words", ["aba", "ABAB", "b a", "é a", "aaaa", "abé", "zzz", "aba zz", "ab", "", "bbbbbbbbb"])
def test_same_rows_as_a_scan(made, words):
    samples, table = made
    scan = se.search(samples, se.SearchQuery(free_text=words, scope="name")).select("id").collect()
    found = po.find(samples, table, words).select("id").collect()
    assert found == (scan if len(words) >= 3 else [])
    only = po.find(samples, table, words, ["vendor"]).select("id").collect()
    assert only == (samples.filter(F.col("vendor").isNotNull()).filter(se.tx.contains("vendor", words)).orderBy("path").select("id").collect() if len(words) >= 3 else [])


def test_more_candidates_than_a_filter_holds(made, monkeypatch):
    samples, table = made
    monkeypatch.setattr(po, "FEW", 3)
    scan = se.search(samples, se.SearchQuery(free_text="aba", scope="name")).select("id").collect()
    assert len(scan) > 3 and po.find(samples, table, "ABA").select("id").collect() == scan


def test_whole_queries(made):
    samples, table = made
    query = se.SearchQuery({"vendor": "a", "library": "b"}, free_text="aba", match_any=True, filters=(se.ColumnFilter("key", ("a",)),), scope="name")
    assert po.indexed(samples, table, query).collect() == se.search(samples, query).collect()


def test_only_the_words_lists_are_read(made):
    _, table = made
    lists = po.lists_of(table, ["aba", "bab"], ["vendor"])
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[.*In\(gram, \[aba,bab\]\)", plan)
    opened = {r.f.split("_bucket=")[1].split("/")[0] for r in table.read(table.version(), table.buckets_of(lists, table.version())).select(F.input_file_name().alias("f")).collect()}
    assert 1 <= len(opened) <= 2


def test_relevance_is_the_scans(made):
    samples, table = made
    for words in ("aba", "bab a", "zzzz"):
        assert po.relevance(table, "vendor", words).collect() == st.relevance(samples, "vendor", words).collect()


def test_changes_are_followed(spark, made, tmp_path):
    samples, _ = made
    table = Table(spark, str(tmp_path / "t"))
    po.build(table, samples, buckets=64)
    before = samples.filter("id IN (5, 65501, 299, 2)")
    after = spark.createDataFrame(rows(random.Random(7), [5, 65501, 70_000, 1000]), SCHEMA)
    first = table.version()
    second = po.update(table, before, after)
    assert 0 < sum(first.places.get(b) != p for b, p in second.places.items()) < 64
    now = samples.filter("id NOT IN (5, 65501, 299, 2)").unionByName(after)
    fresh = sorted(map(tuple, po.postings(now).collect()))
    assert sorted(map(tuple, table.read().select("field", "gram", "block", "offsets", "counts").collect())) == fresh


def test_lists_are_made_by_tasks_that_grow_with_the_rows(spark):
    """A task makes the lists of some blocks, whatever the table's size, and a bucket's file
    isn't one task's alone."""
    n = 9 * po.BLOCK
    rows = spark.range(n).select("id", F.concat(F.lit("ring "), F.col("id").cast("string")).alias("name"))
    lists = po.postings(rows, ["name"]).withColumn("task", F.spark_partition_id())
    assert lists.groupBy("task").agg(F.count_distinct("block").alias("blocks")).agg(F.max("blocks")).first()[0] <= 3
    assert lists.filter(F.col("gram") == po.LENGTH).agg(F.sum(F.size("offsets"))).first()[0] == n


def test_tasks_that_write_an_index_grow_with_its_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(po, "SHARE", 1000)
    rows = spark.range(8000).select("id", F.lit("ring").alias("name"))
    table = Table(spark, str(tmp_path / "t"))
    po.build(table, rows, ["name"], buckets=2)
    assert len(table.read().inputFiles()) > 2
    assert table.read().filter(F.col("gram") == "rin").agg(F.sum(F.size("offsets"))).first()[0] == 8000
