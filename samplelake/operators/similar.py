"""Similarity: exact and product-quantised ranking, codebooks and embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import ship, stage
from ..functions import vectors as ve
from ..sources.table import Conflict, Table, claim


def _subject(vectors: DataFrame, subject: int) -> tuple[str, list[float]]:
    row = vectors.filter(F.col("id") == subject).select("path", "vec").head()
    return (row["path"], list(row["vec"])) if row else ("", [])


def _literal(vec: list[float]):
    return F.array(*[F.lit(float(x)) for x in vec])


def similar(vectors: DataFrame, subject: int, limit: int = 50, max_exact: int | None = None) -> DataFrame:
    """(id, path, dist, sim): the subject, then the ``limit`` - 1 nearest others (ties by id).

    ``sim`` is relative to the furthest row returned. Each task keeps its own nearest rows,
    so nothing is shuffled but these. With ``max_exact``, more vectors than that raise
    ValueError: codes are meant for them.
    """
    if limit < 1:
        raise ValueError("limit must be 1 or more")
    if max_exact is not None and (n := vectors.count()) > max_exact:
        raise ValueError(f"{n} vectors are too many for an exact search of at most {max_exact}")
    path, vec = _subject(vectors, subject)
    own = vectors.sparkSession.createDataFrame([(subject, path, 0.0, 1.0)], "id long, path string, dist double, sim double")
    if limit == 1 or not vec:
        return own
    others = vectors.filter((F.col("id") != subject) & (F.size("vec") == len(vec))).select("id", "path", ve.distance(F.col("vec"), _literal(vec)).alias("dist"))
    near = others.orderBy("dist", "id").limit(limit - 1)
    ranked = near.withColumn("sim", ve.similarity(F.col("dist"), F.max("dist").over(Window.partitionBy())))  # ``limit`` rows
    return own.unionByName(ranked)


def similar_quantised(coded: DataFrame, vectors: DataFrame, subject: int, codebook: list, limit: int = 50) -> DataFrame:
    """As :func:`similar`, by the summed table distances of codes (id, path, code). The
    furthest of the ``limit`` + 1 nearest rows, the subject among them or not, is 0."""
    if limit < 1:
        raise ValueError("limit must be 1 or more")
    path, vec = _subject(vectors, subject)
    own = vectors.sparkSession.createDataFrame([(subject, path, 0.0, 1.0)], "id long, path string, dist double, sim double")
    if not vec:
        return own
    near = coded.select("id", "path", F.round(ve.table_distance(F.col("code"), ve.query_table(vec, codebook)), 6).alias("sq")).orderBy("sq", "id").limit(limit + 1)
    ranked = near.select("id", "path", F.sqrt("sq").alias("dist")).withColumn("sim", ve.similarity(F.col("dist"), F.max("dist").over(Window.partitionBy())))
    return own.unionByName(ranked.filter(F.col("id") != subject).orderBy("dist", "id").limit(limit - 1))


def codebook_rows(codebook: list) -> list[tuple[int, int, list[float]]]:
    return [(m, k, [float(x) for x in c]) for m, part in enumerate(codebook) for k, c in enumerate(part)]


def pack_codebook(codebook: list) -> bytes:
    return np.asarray(codebook, "<f4").tobytes()


def unpack_codebook(raw: bytes, m: int = 128, k: int = 256, width: int = 4) -> np.ndarray:
    """Little-endian floats; any other length raises ValueError."""
    if len(raw) != 4 * m * k * width:
        raise ValueError(f"a codebook has {4 * m * k * width} bytes, not {len(raw)}")
    return np.frombuffer(raw, "<f4").reshape(m, k, width)


def save_codebook(spark, codebook: list, folder: str) -> int:
    """Writes the codebook as the next version of ``folder`` and returns its number. The
    number is taken first, by an exclusive name, so two writers never have the same one;
    readers take the highest version that is complete."""
    version = max([0, *codebook_versions(spark, folder)])
    while True:
        version += 1
        try:
            claim(spark, f"{folder}/.claims", f"{version:010d}")
            break
        except Conflict:
            continue
    rows = spark.createDataFrame([(version, bytearray(pack_codebook(codebook)))], "version int, codebook binary")
    rows.coalesce(1).write.parquet(f"{folder}/version={version}")
    return version


def codebook_versions(spark, folder: str) -> list[int]:
    """The complete versions in ``folder``; a malformed version raises ValueError."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    out = []
    for entry in files.listStatus(path):
        name = entry.getPath().getName()
        if name.startswith("version="):
            if not name[8:].isdigit():
                raise ValueError(f"{name} is no version")
            if files.exists(spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")):
                out.append(int(name[8:]))
    return sorted(out)


def load_codebook(spark, folder: str, m: int = 128, k: int = 256, width: int = 4) -> tuple[int, np.ndarray]:
    """The highest version and its codebook; ValueError if there is none."""
    versions = codebook_versions(spark, folder)
    if not versions:
        raise ValueError(f"no codebook in {folder}")
    row = spark.read.parquet(f"{folder}/version={versions[-1]}").select("codebook").first()
    return versions[-1], unpack_codebook(bytes(row["codebook"]), m, k, width)


def pack_embedding(vec: list[float], dim: int = 512) -> bytes:
    if len(vec) != dim:
        raise ValueError(f"an embedding has {dim} numbers, not {len(vec)}")
    return np.asarray(vec, "<f4").tobytes()


def unpack_embedding(raw: bytes | None, dim: int = 512) -> np.ndarray | None:
    """None if it is missing or of another length."""
    return np.frombuffer(raw, "<f4") if raw is not None and len(raw) == 4 * dim else None


def training_sample(samples: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows drawn by a seeded hash; rows of loops are left out."""
    rest = samples.filter(~F.coalesce(F.upper(F.col("category").cast("string")).startswith("LOOP"), F.lit(False)))
    return rest.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)


def _nearest(x: np.ndarray, book: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For vectors (n, parts, width) the nearest row of each part's ``book``, and its squared
    distance; parts may have different numbers of rows."""
    near, square = np.empty(x.shape[:2], np.int64), np.empty(x.shape[:2])
    for m, c in enumerate(book):
        d = (x[:, m] ** 2).sum(1)[:, None] - 2 * (x[:, m] @ c.T) + (c**2).sum(1)[None]
        near[:, m] = d.argmin(1)
        square[:, m] = np.maximum(d[np.arange(len(x)), near[:, m]], 0)
    return near, square


def _uniform(ids: np.ndarray, parts: int, salt: int) -> np.ndarray:
    """A number in 0 to 1 for each id and part, the same whichever task asks."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(parts, dtype=np.uint64) + np.uint64(salt * parts + 1))[None] * np.uint64(0xD1B54A32D192ED03)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / 2.0**53


def _blocks(batches: Iterator[pa.RecordBatch], parts: int, rows: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors (n, parts, width) in double precision."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            part = batch.slice(at, rows)
            yield part.column(0).to_numpy(zero_copy_only=False), part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), parts, -1)


def _sums(vectors: DataFrame, book: list[np.ndarray], parts: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Of each row of the book: the sum and the number of its vectors; and each part's summed
    squared distance. A task adds up its own vectors; a row for each row of the book is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, cost = [np.zeros(c.shape) for c in book], [np.zeros(len(c), np.int64) for c in book], np.zeros(parts)
        for _, x in _blocks(batches, parts):
            near, square = _nearest(x, book)
            cost += square.sum(0)
            for m in range(parts):
                np.add.at(total[m], near[:, m], x[:, m])
                count[m] += np.bincount(near[:, m], minlength=len(book[m]))
        for m in range(parts):
            n = len(book[m])
            spent = np.where(np.arange(n) == 0, cost[m], 0.0)
            yield pa.RecordBatch.from_arrays([pa.array([m] * n, pa.int32()), pa.array(np.arange(n, dtype=np.int32)), pa.array(list(total[m])), pa.array(count[m]), pa.array(spent)], names=["m", "k", "total", "n", "cost"])

    width = book[0].shape[1]
    partial = vectors.mapInArrow(run, "m int, k int, total array<double>, n long, cost double")
    added = [F.sum(F.col("total")[i]) for i in range(width)]
    rows = partial.groupBy("m", "k").agg(F.array(*added).alias("total"), F.sum("n").alias("n"), F.sum("cost").alias("cost")).collect()
    total, count, cost = [np.zeros(c.shape) for c in book], [np.zeros(len(c), np.int64) for c in book], np.zeros(parts)
    for r in rows:
        total[r["m"]][r["k"]], count[r["m"]][r["k"]] = r["total"], r["n"]
        cost[r["m"]] += r["cost"]
    return total, count, cost


def _seeds(vectors: DataFrame, parts: int, centroids: int, seed: int, passes: int) -> list[np.ndarray]:
    """Starts for all parts at once: each pass draws every vector with a chance in proportion
    to its squared distance, some 2 * ``centroids`` in all; of these, weighted by how many
    vectors they are nearest to, the driver picks by the same rule."""
    first = vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(centroids).collect()
    if not first:
        raise ValueError("there are no vectors to train on")
    some = np.array([r["vec"] for r in first], np.float64).reshape(len(first), parts, -1)
    book = [some[:1, m] for m in range(parts)]
    each = 2 * centroids / passes
    for i in range(passes):
        _, _, cost = _sums(vectors, book, parts)
        rate = np.where(cost > 0, each / np.where(cost > 0, cost, 1), 0.0)

        def drawn(batches: Iterator[pa.RecordBatch], book=book, rate=rate, salt=seed * 1009 + i) -> Iterator[pa.RecordBatch]:
            for ids, x in _blocks(batches, parts):
                rows, m = np.nonzero(_uniform(ids, parts, salt) < _nearest(x, book)[1] * rate[None])
                yield pa.RecordBatch.from_arrays([pa.array(m.astype(np.int32)), pa.array(list(x[rows, m]), pa.list_(pa.float64()))], names=["m", "part"])

        for r in vectors.mapInArrow(drawn, "m int, part array<double>").collect():  # some ``each`` a part
            book[r["m"]] = np.vstack([book[r["m"]], r["part"]])
    # spare starts, for parts that have fewer different vectors than centroids
    book = [np.unique(np.vstack([book[m], some[:, m]]), axis=0) for m in range(parts)]
    _, count, _ = _sums(vectors, book, parts)
    picks = np.random.default_rng(seed)
    out = []
    for c, weight in zip(book, count):
        chance, chosen = weight.astype(np.float64), []
        for _ in range(min(centroids, len(c))):
            chance[chosen] = 0
            chosen.append(int(picks.choice(len(c), p=chance / chance.sum())) if chance.sum() > 0 else next(i for i in range(len(c)) if i not in chosen))
            chance = weight * ((c[:, None] - c[None, chosen]) ** 2).sum(2).min(1)
        out.append(c[chosen])
    return out


def train_codebook(vectors: DataFrame, parts: int, centroids: int, rounds: int = 10, seed: int = 0, passes: int = 4) -> DataFrame:
    """(m, k, centroid): k-means in each part of vectors (id, vec) of one length, over all.

    Every task adds up its own vectors by their nearest centroids, for all parts in one
    pass, and the sums are merged each round: nothing leaves a task that grows with the
    vectors, and no task has a part's all. Starts come from :func:`_seeds`; a centroid
    without vectors stays. A part with fewer different vectors has fewer centroids. Stage
    ``vectors`` if they are dear to make: there are ``rounds`` + 2 * ``passes`` passes.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col("id").cast("long").alias("id"), "vec").filter("vec IS NOT NULL")
    book = _seeds(rows, parts, centroids, seed, passes)
    for _ in range(rounds):
        total, count, _ = _sums(rows, book, parts)
        book = [np.where(n[:, None] > 0, t / np.maximum(n, 1)[:, None], c) for c, t, n in zip(book, total, count)]
    return spark.createDataFrame([(m, k, row.tolist()) for m, c in enumerate(book) for k, row in enumerate(c)], "m int, k int, centroid array<double>")


def distortion(vectors: DataFrame, codebook: list, parts: int) -> float:
    """The summed squared distance of all vectors to their nearest centroids."""
    return float(_sums(vectors.select("id", "vec"), [np.asarray(c, np.float64) for c in codebook], parts)[2].sum())


def encode_new(table: Table, vectors: DataFrame, codebook: list, version: int, buckets: int = 64) -> int:
    """Brings a committed table of codes (id, path, stamp, code) up to date with vectors (id,
    path, vec) and returns how many were encoded: with the codebook version that the table
    was made with, only new and changed vectors; with another one, all. Codes of vectors
    that are gone go. ``stamp`` is the vector's hash."""
    ship(table.spark)
    stamped = vectors.select("id", "path", "vec", F.xxhash64("vec").alias("stamp"))
    coded = lambda rows: rows.select("id", "path", "stamp", ve.encode(F.col("vec"), codebook).alias("code"))
    noted = {"codebook": str(version)}
    if not table.exists():
        table.create(coded(stamped), ["id"], buckets, notes=noted)
        return table.read().count()
    known = table.version()
    old = table.read(known).select("id", "path", "stamp")
    if known.notes.get("codebook") != str(version):
        new = stage(coded(stamped), "codes")
        table.change(new.select("id").unionByName(old.select("id")), lambda _: new, notes=noted)
        return new.count()
    new = stage(coded(stamped.join(old, ["id", "path", "stamp"], "left_anti")), "codes")
    gone = stage(old.select("id").join(vectors.select("id"), "id", "left_anti"), "gone")
    changed = new.select("id").unionByName(gone)
    table.change(changed, lambda rows: rows.join(changed, "id", "left_anti").unionByName(new))
    return new.count()


def embed(rows: DataFrame, encoder: Callable[[list[str]], np.ndarray], dim: int, batch: int = 32) -> DataFrame:
    """(path, vec) of the rows' paths by a batch encoder, which must give (n, dim) numbers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), batch):
                paths = frame["path"].iloc[i : i + batch].tolist()
                out = np.asarray(encoder(paths), np.float32)
                if out.shape != (len(paths), dim):
                    raise ValueError(f"the encoder gave {out.shape}, not {(len(paths), dim)}")
                yield pd.DataFrame({"path": paths, "vec": list(out)})

    return rows.select("path").mapInPandas(run, "path string, vec array<float>")


def set_embeddings(samples: DataFrame, new: DataFrame, dim: int) -> DataFrame:
    """``samples`` with the vectors of ``new`` where they have none yet; another length raises."""
    checked = new.select("path", F.when(F.size("vec") == dim, F.col("vec")).otherwise(F.raise_error(F.lit(f"an embedding has {dim} numbers"))).alias("_new"))
    return samples.join(checked, "path", "left").withColumn("embedding", F.coalesce("embedding", "_new")).drop("_new")


def synthetic(rows: DataFrame, dim: int, seed: int = 0) -> DataFrame:
    """(id, vec): for each id a Gaussian vector of unit length, the same in every run: pairs
    of uniform numbers are cut from the md5 of seed, id and place."""

    def uniform(place: Column, salt: int) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit(seed), "id", place, F.lit(salt)))
        return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 2.0**32

    normal = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.sqrt(-2 * F.ln(uniform(i, 0))) * F.cos(2 * np.pi * uniform(i, 1)))
    raw = rows.select("id", normal.alias("vec"))
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda t, x: t + x * x))
    return raw.select("id", length.alias("length"), "vec").select("id", F.transform("vec", lambda x: (x / F.col("length")).cast("float")).alias("vec"))


def attach(samples: DataFrame, scores: DataFrame) -> DataFrame:
    """``samples`` with the score ``sim`` of their path, null for others."""
    return samples.join(scores.select("path", "sim"), "path", "left")


def similarity_order(found: DataFrame, path: str, then: str) -> DataFrame:
    """The query's row first, then by falling similarity, missing ones last."""
    return found.orderBy((F.col("path") == path).desc(), F.col("sim").desc_nulls_last(), then)


def lines(found: DataFrame, style: str) -> DataFrame:
    """One text for each row: path, tab-separated or JSON."""
    if style == "path":
        return found.select(F.col("path").alias("line"))
    if style == "tab":
        return found.select(F.format_string("%.4f\t%.4f\t%s", "sim", "dist", "path").alias("line"))
    return found.select(F.to_json(F.struct("path", F.round("dist", 6).alias("dist"), F.round("sim", 6).alias("sim"))).alias("line"))
