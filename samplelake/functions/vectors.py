"""Distances and product quantisation of float vectors, as columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def squared(a: Column, b: Column) -> Column:
    """Squared Euclidean distance in double precision."""
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda total, x: total + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared(a, b))


def similarity(dist: Column, most: Column) -> Column:
    """1 - dist / most within 0 to 1; 1 if nothing is further away than 0."""
    return F.when(most <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - dist / most)))


def encode(vec: Column, codebook: list[list[list[float]]]) -> Column:
    """For each sub-vector the number of the nearest centroid; ties give the lowest. A null
    vector, or one of another length, has a null code.

    The codebook [m][k][width] has a fixed size and goes to each worker with the function,
    which takes vectors in Arrow batches and compares them a block at a time.
    """
    book = np.asarray(codebook, np.float64)
    parts, _, width = book.shape
    whole = parts * width

    @F.pandas_udf("array<smallint>")
    def nearest(vectors: pd.Series) -> pd.Series:
        out: list = [None] * len(vectors)
        good = [i for i, x in enumerate(vectors) if x is not None and len(x) == whole]
        for a in range(0, len(good), 512):
            rows = good[a : a + 512]
            x = np.stack([vectors.iloc[i] for i in rows]).astype(np.float64).reshape(len(rows), parts, width)
            codes = np.empty((len(rows), parts), np.int16)
            for m in range(parts):
                codes[:, m] = np.round(((x[:, m, None] - book[None, m]) ** 2).sum(2), 9).argmin(1)
            for i, code in zip(rows, codes):
                out[i] = code
        return pd.Series(out)

    return nearest(vec)


def table_distance(code: Column, table: list[list[float]]) -> Column:
    """Sum over sub-spaces of the query's distance to the code's centroid."""
    rows = np.asarray(table, np.float64)
    at = np.arange(len(rows))[None]

    @F.pandas_udf("double")
    def total(codes: pd.Series) -> pd.Series:
        there = codes.notna().to_numpy()
        out = np.full(len(codes), np.nan)
        if there.any():
            out[there] = rows[at, np.stack(codes[there].to_numpy())].sum(1)
        return pd.Series(out).where(there)

    return total(code)


def query_table(query: list[float], codebook: list[list[list[float]]]) -> list[list[float]]:
    """Squared distances of the query's parts to all centroids."""
    width = len(codebook[0][0])
    return [[round(sum((float(query[m * width + i]) - c[i]) ** 2 for i in range(width)), 9) for c in part] for m, part in enumerate(codebook)]


def valid(vectors: DataFrame, dim: int) -> DataFrame:
    """Rows whose vector is there and has ``dim`` numbers."""
    return vectors.filter(F.col("vec").isNotNull() & (F.size("vec") == dim))
