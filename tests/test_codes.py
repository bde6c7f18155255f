"""Stored codes, codebook versions under two writers, and k-means over all vectors."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from samplelake.functions import vectors as ve
from samplelake.operators import similar as si
from samplelake.sources.table import Table


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, f"/{first + i}", v.tolist()) for i, v in enumerate(x.astype(np.float32))], "id long, path string, vec array<float>")


def lloyd(x, parts, centroids, rounds, seed):
    """Random starts and plain rounds on the driver; the summed squared distance."""
    x = x.reshape(len(x), parts, -1).astype(float)
    deal, cost = np.random.default_rng(seed), 0.0
    for m in range(parts):
        c = x[deal.choice(len(x), centroids, replace=False), m]
        for _ in range(rounds):
            near = ((x[:, m, None] - c[None]) ** 2).sum(2).argmin(1)
            c = np.array([x[near == k, m].mean(0) if (near == k).any() else c[k] for k in range(centroids)])
        cost += ((x[:, m, None] - c[None]) ** 2).sum(2).min(1).sum()
    return cost


def as_book(rows, parts):
    return [[r.centroid for r in sorted((r for r in rows if r.m == m), key=lambda r: r.k)] for m in range(parts)]


def test_training_is_no_worse_than_plain_rounds(spark):
    deal = np.random.default_rng(1)
    x = deal.normal(size=(40, 8))[deal.integers(0, 40, 3000)] + deal.normal(scale=0.2, size=(3000, 8))
    vectors = frame(spark, x).repartition(7).cache()
    rows = si.train_codebook(vectors, 2, 32, rounds=8).collect()
    book = as_book(rows, 2)
    assert [len(c) for c in book] == [32, 32]
    cost = si.distortion(vectors, book, 2)
    y = x.astype(np.float32).astype(float).reshape(3000, 2, 4)
    assert cost == pytest.approx(sum(((y[:, m, None] - np.array(book[m])[None]) ** 2).sum(2).min(1).sum() for m in range(2)))
    assert cost <= 1.02 * min(lloyd(x.astype(np.float32), 2, 32, 8, s) for s in range(3))
    again = as_book(si.train_codebook(vectors.repartition(3), 2, 32, rounds=8).collect(), 2)
    assert np.allclose(np.array(again), np.array(book))


def test_training_on_few_vectors(spark):
    same = frame(spark, np.ones((20, 4)))
    assert [r.centroid for r in si.train_codebook(same, 2, 8).collect()] == [[1.0, 1.0]] * 2
    three = frame(spark, np.arange(12).reshape(3, 4))
    assert len(si.train_codebook(three, 1, 8).collect()) == 3
    with pytest.raises(ValueError, match="no vectors"):
        si.train_codebook(three.filter("false"), 1, 8)


def test_only_new_vectors_are_encoded(spark, tmp_path):
    deal = np.random.default_rng(2)
    x, book = deal.normal(size=(60, 8)), deal.normal(size=(2, 16, 4)).tolist()
    table = Table(spark, str(tmp_path / "codes"))
    want = lambda df, book: {r.id: r.code for r in df.select("id", ve.encode(F.col("vec"), book).alias("code")).collect()}
    stored = lambda: {r.id: r.code for r in table.read().collect()}
    assert si.encode_new(table, frame(spark, x), book, 1, buckets=8) == 60
    assert si.encode_new(table, frame(spark, x), book, 1) == 0 and table.version().number == 1
    x[5], before = x[5] + 1, table.version()
    more = frame(spark, np.vstack([x[:50], deal.normal(size=(1, 8))]))
    assert si.encode_new(table, more, book, 1) == 2
    assert stored() == want(more, book) and table.version().number == 2
    assert any(table.version().places.get(b) == p for b, p in before.places.items())
    other = deal.normal(size=(2, 16, 4)).tolist()
    assert si.encode_new(table, more, other, 2) == 51
    assert stored() == want(more, other) and table.version().notes == {"codebook": "2"}


def test_quantised_search_reads_codes(spark, tmp_path):
    deal = np.random.default_rng(3)
    x, book = deal.normal(size=(80, 8)), deal.normal(size=(2, 16, 4)).tolist()
    vectors = frame(spark, x)
    table = Table(spark, str(tmp_path / "codes"))
    si.encode_new(table, vectors, book, 1)
    coded = vectors.select("id", "path", ve.encode(F.col("vec"), book).alias("code"))
    assert si.similar_quantised(table.read(), vectors, 4, book, 9).collect() == si.similar_quantised(coded, vectors, 4, book, 9).collect()
    missing = table.read().limit(3).unionByName(spark.createDataFrame([(900, "/x", 0, None)], table.read().schema))
    sums = ve.query_table(x[4].tolist(), book)
    got = {r.id: r.d for r in missing.select("id", ve.table_distance(F.col("code"), sums).alias("d")).collect()}
    assert got.pop(900) is None and all(d > 0 for d in got.values())


def test_two_writers_never_have_one_version(spark, tmp_path):
    folder, book, got = f"file://{tmp_path}/books", np.zeros((1, 2, 4)).tolist(), []
    writers = [threading.Thread(target=lambda: got.append(si.save_codebook(spark, book, folder))) for _ in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(got) == [1, 2, 3, 4] and si.codebook_versions(spark, folder) == [1, 2, 3, 4]
