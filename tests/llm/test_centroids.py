"""Exact centroid clustering against SQL and a plain version in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from samplelake.llm import centroids
from samplelake.llm.queries import ORACLES, QUERIES

from ..oracle import same


def plain(rows, k=16, rounds=3, dim=64):
    kept = [(i, [math.floor(64 * x) if abs(x) < 2**900 else int(x) * 64 for x in v]) for i, v in rows if v and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    c = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        groups = [[v for (_, v), j in zip(kept, at) if j == g] for g in range(len(c))]
        c = [[sum(x) // len(m) for x in zip(*m)] if m else old for old, m in zip(c, groups)]
    out = [(i, *near(v)) for i, v in kept]
    inertia = [sum(d for _, d, j in out if j == g) for g in range(len(c))]
    fit = lambda x: x if x < 2**63 else None
    return sorted(
        ((i, j, fit(d), fit(inertia[j]), fit(sum(inertia)), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in out), key=repr
    )


def found(spark, rows, kind="double", **options):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 AS cluster", "'x' AS vector", "2 AS kind")
    return sorted((tuple(r) for r in centroids.cluster_vectors(df, **options).collect()), key=repr)


def test_same_as_sql(spark):
    same(spark, QUERIES["op11_centroids"], ORACLES["op11_centroids"])


@pytest.mark.parametrize("size", [1.0, 1e6, 1e8, 1e17, 1e307])
def test_every_magnitude(spark, size):
    """float64, int64 and Python's integers give the same exact rows as the plain version."""
    deal = random.Random(size)
    rows = [(i, [deal.uniform(-size, size) for _ in range(64)]) for i in range(80)]
    assert found(spark, rows) == plain(rows)


def test_one_large_vector_among_small(spark):
    deal = random.Random(5)
    rows = [(i, [deal.uniform(-1, 1) for _ in range(64)]) for i in range(60)] + [(99, [1e12] * 64), (98, [-1e30] * 64)]
    assert found(spark, rows) == plain(rows)


def test_odd_rows(spark):
    v = [float(i % 7) for i in range(64)]
    odd = [(1, None), (2, []), (3, v[:63]), (4, v + [0.0]), (5, [None] + v[1:]), (6, [math.nan] + v[1:]), (7, [math.inf] + v[1:])]
    assert found(spark, odd) == [] and found(spark, []) == []
    rows = odd + [(8, v), (8, v), (None, v), (None, [x + 1 for x in v]), (9, [-0.0] * 64)]
    assert found(spark, rows) == plain(rows)
    assert len(found(spark, [(1, v)] * 40, "float")) == 40


def test_ties_take_the_smaller_number():
    block = np.array([[0, 0], [2, 2]], dtype=np.int64)
    chosen, square = centroids.nearest(block, [[1, 1], [1, 1], [2, 2]])
    assert chosen.tolist() == [0, 2] and square.tolist() == [2, 0]


def test_blocks_round_trip():
    for top in (1, 2**15 - 1, 2**15, 2**31, 2**61):
        block = np.array([[top, -top], [0, 1]], dtype=np.int64)
        assert centroids.unpack(*centroids.pack(block), 2).tolist() == block.tolist()
    large = np.array([[2**70, -(2**65)]], dtype=object)
    assert centroids.unpack(*centroids.pack(large), 2).tolist() == large.tolist()
