"""Centroid clustering in exact integers: blocked float64 products where they are exact."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, staged

SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
#: Rows of a block: a product of a block and the centroids is one call.
ROWS = 4096
#: float64 holds every integer below this; int64 every one below LONG.
EXACT, LONG = 2**53, 2**63
KINDS = (("i2", 2**15), ("i4", 2**31), ("i8", 2**62))


def usable(vector: str, dim: int) -> Column:
    """Exactly ``dim`` components, none null, NaN or infinite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) == dim) & finite


def quantise(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): int64, or Python integers where one doesn't fit."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values.astype(np.float64) * scale)
    if np.all(np.abs(scaled) < 2.0**62):
        return scaled.astype(np.int64)
    # A double this large is an integer itself.
    whole = [int(s) if abs(s) < 2.0**62 else int(x) * scale for s, x in zip(scaled.ravel().tolist(), values.astype(np.float64).ravel().tolist())]
    return np.array(whole, dtype=object).reshape(values.shape)


def pack(block: np.ndarray) -> tuple[str, bytes]:
    """The narrowest form that holds the block's integers."""
    if block.dtype != object:
        top = int(np.abs(block).max(initial=0))
        kind = next(k for k, bound in KINDS if top < bound)
        return kind, block.astype(f"<{kind}").tobytes()
    return "text", ",".join(map(str, block.ravel())).encode()


def unpack(kind: str, data: bytes, dim: int) -> np.ndarray:
    if kind == "text":
        return np.array([int(x) for x in data.decode().split(",")], dtype=object).reshape(-1, dim)
    return np.frombuffer(data, dtype=f"<{kind}").reshape(-1, dim).astype(np.int64)


def largest(values: np.ndarray) -> int:
    return max((abs(int(values.min())), abs(int(values.max()))), default=0) if values.size else 0


def nearest(block: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Each row's centroid (the smaller number on ties) and its squared distance, exactly.

    |x|² - 2x·c + |c|², every partial sum of which is at most dim * (max|x| + max|c|)².
    Below 2^53 that is float64's matrix product; below 2^63 int64's; else Python's integers.
    """
    bound = block.shape[1] * (largest(block) + max(abs(x) for c in centroids for x in c)) ** 2
    kind = np.float64 if bound < EXACT else np.int64 if bound < LONG else object
    x, c = block.astype(kind), np.array(centroids, dtype=object).astype(kind)
    square = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
    chosen = np.argmin(square, axis=1)
    best = square[np.arange(len(x)), chosen]
    return chosen, best if kind is object else best.astype(np.int64)


def tally(block: np.ndarray, centroids: list[list[int]]) -> tuple[list, list, list]:
    """Sums, counts and summed distances of a block by centroid, in Python's integers."""
    chosen, square = nearest(block, centroids)
    one_hot = (chosen[:, None] == np.arange(len(centroids))[None, :]).T
    bound = len(block) * max(largest(block), 1)
    kind = np.float64 if bound < EXACT else np.int64 if bound < LONG else object
    sums = one_hot.astype(kind) @ block.astype(kind)
    sums = sums.astype(np.int64).tolist() if kind is np.float64 else sums.tolist()
    whole = square.astype(object)
    return sums, one_hot.sum(axis=1).tolist(), [int(sum(whole[row])) for row in one_hot]


def merge(a: tuple | None, b: tuple | None) -> tuple | None:
    if a is None or b is None:
        return b if a is None else a
    return [[x + y for x, y in zip(p, q)] for p, q in zip(a[0], b[0])], [x + y for x, y in zip(a[1], b[1])], [x + y for x, y in zip(a[2], b[2])]


def totals(blocks: DataFrame, centroids: list[list[int]], dim: int) -> tuple:
    """Sums, counts and inertia over all blocks: as many numbers as the centroids have."""

    def add(acc: tuple | None, row) -> tuple:
        return merge(acc, tally(unpack(row[0], bytes(row[1]), dim), centroids))

    return blocks.select("kind", "data").rdd.treeAggregate(None, add, merge)


def starts(rows: DataFrame, k: int, seed: int, scale: int) -> list[list[int]]:
    """The ``k`` vectors whose ids hash least: the one ordered, bounded result of all rows."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(name.alias("name"), "vector").orderBy("name", "vector").limit(k).collect()
    return [quantise(np.array([r["vector"]]), scale)[0].tolist() for r in first]


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Exact k-means over integer vectors: each row's cluster, distance and the inertia.

    Vectors become integers once and are kept as blocks of 4096 in the narrowest form, in
    the shared folder. Each round is one pass: a task multiplies its blocks with the
    centroids and ``treeAggregate`` merges k * dim sums, so nothing that grows with the
    rows leaves a task. A last pass sums the inertia, and rows are assigned from the blocks.

    Vectors that are null, of another length, or with null or non-finite components have no
    row. Repeated rows count each for itself; ids that repeat among the starts are ordered
    by their vectors; a null id hashes like the empty text and stays null. With fewer than
    ``k`` vectors there are as many centroids; with none, no rows. A distance or an inertia
    beyond a long is null, as no long is right. Other columns are ignored.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector")).filter(usable("vector", dim))
    centroids = starts(rows, k, seed, scale)
    if not centroids:
        return spark.createDataFrame([], SCHEMA)

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                values = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                kind, data = pack(quantise(values, scale))
                ids = pa.array([part.column(0).to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([kind]), pa.array([data], pa.binary())], names=["ids", "kind", "data"])

    blocks = staged(rows.mapInArrow(to_blocks, "ids array<long>, kind string, data binary"), "vectors")
    for _ in range(rounds):
        sums, counts, _ = totals(blocks, centroids, dim)
        centroids = [[x // n for x in total] if n else old for old, total, n in zip(centroids, sums, counts)]
    _, _, inertia = totals(blocks, centroids, dim)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def whole(x: int) -> int | None:
        return x if x < LONG else None

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, kind, data in zip(*(c.to_pylist() for c in batch.columns)):
                chosen, square = nearest(unpack(kind, data, dim), centroids)
                chosen = chosen.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array(chosen, pa.int32()),
                        pa.array([whole(d) for d in square.tolist()], pa.int64()),
                        pa.array([whole(inertia[c]) for c in chosen], pa.int64()),
                        pa.array([whole(sum(inertia))] * len(ids), pa.int64()),
                        pa.array([names[c] for c in chosen], pa.string()),
                    ],
                    names=[f.split()[0] for f in SCHEMA.split(", ")],
                )

    return blocks.mapInArrow(assign, SCHEMA)


def _oracle(k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1) -> str:
    """The same in SQL: a common table expression for each assignment and each update."""
    ctes = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
          WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('{seed}:' || COALESCE(CAST(vec_id AS VARCHAR), '')) AS h, v FROM v ORDER BY 1, 2 LIMIT {k}))""",
    ]
    for i in range(rounds + 1):
        ctes.append(
            f"""a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, c := c)) AS best
          FROM (SELECT v.r, c.c, list_sum(list_transform(range(1, {dim + 1}), lambda j: (v.v[j] - c.v[j]) * (v.v[j] - c.v[j]))) AS d FROM v, c{i} c) GROUP BY r)"""
        )
        if i < rounds:
            ctes.append(
                f"""c{i + 1} AS MATERIALIZED (SELECT old.c, COALESCE(new.v, old.v) AS v FROM c{i} old LEFT JOIN
          (SELECT c, list(CAST((s - (((s % n) + n) % n)) // n AS BIGINT) ORDER BY j) AS v FROM
            (SELECT a.best.c AS c, t.j AS j, CAST(sum(v.v[t.j]) AS HUGEINT) AS s, CAST(count(*) AS HUGEINT) AS n FROM a{i} a JOIN v USING (r), range(1, {dim + 1}) t(j) GROUP BY 1, 2) GROUP BY c) new USING (c))"""
            )
    return (
        "WITH "
        + ",\n".join(ctes)
        + f"""
      SELECT vec_id, CAST(best.c AS INTEGER) AS "cluster", CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
        CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
      FROM a{rounds} JOIN v USING (r) JOIN c{rounds} c ON c.c = best.c"""
    )


ORACLE = _oracle()
