"""Quality by compression: which of two dictionaries, of good and of bad text, fits better."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fold, text_or_empty

SCHEMA = "doc_id long, held_out boolean, score double, predicted int, size_difference double"


@dataclass(frozen=True)
class CompressionModel:
    """Two dictionaries' bytes (None: no example), and the calibration's slope, centre and intercept."""

    good: bytes | None
    bad: bytes | None
    raw: tuple[bool, bool]
    slope: float
    centre: float
    intercept: float
    level: int
    piece: int

    def compressors(self) -> list:
        import zstandard

        out = []
        for content, raw in zip((self.good, self.bad), self.raw):
            kind = zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_AUTO
            known = zstandard.ZstdCompressionDict(content, dict_type=kind)
            known.precompute_compress(level=self.level)
            out.append(zstandard.ZstdCompressor(level=self.level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out

    def differences(self, texts: list[str]) -> np.ndarray:
        """(compressed size with the bad dictionary - with the good one) / raw size."""
        if not self.good or not self.bad:
            return np.zeros(len(texts))
        good, bad = (c.compress for c in self.compressors())
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            raw, gap = text.encode("utf-8", "replace"), 0
            for a in range(0, len(raw), self.piece):
                part = raw[a : a + self.piece]
                gap += len(bad(part)) - len(good(part))
            out[i] = gap / max(1, len(raw))
        return out

    def scores(self, gaps: np.ndarray) -> np.ndarray:
        x = self.slope * (np.clip(gaps, -0.3, 0.3) - self.centre) + self.intercept
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _dictionary(texts: list[str], size: int, piece: int) -> tuple[bytes | None, bool]:
    """A trained dictionary; of too few examples, their own last bytes."""
    import zstandard

    raw = [t.encode("utf-8", "replace") for t in texts]
    parts = [r[a : a + piece] for r in raw for a in range(0, len(r), piece)]
    if sum(map(len, parts)) >= 8 * 4096:
        try:
            return zstandard.train_dictionary(min(size, sum(map(len, parts)) // 4), parts).as_bytes(), False
        except zstandard.ZstdError:
            pass
    joined = b"\n".join(raw)[-size:]
    return joined or None, True


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Platt's calibration by Newton's steps, with a small ridge."""
    centre = float(x.mean())
    design = np.stack([x - centre, np.ones_like(x)], 1)
    w, ridge = np.zeros(2), np.diag([1e-5, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge, design.T @ (y - p) - ridge @ w)
        w += np.clip(step, -50, 50)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), centre, float(w[1])


def fit(texts: list[str], labels: list[int], dictionary: int = 262_144, level: int = 3, piece: int = 256, folds: int = 3) -> CompressionModel:
    """Dictionaries from all examples; the calibration from differences that dictionaries
    of the other folds give to each fold."""

    def of(chosen: list[tuple[str, int]]) -> CompressionModel:
        (good, raw_good), (bad, raw_bad) = (_dictionary([t for t, y in chosen if y == k], dictionary, piece) for k in (1, 0))
        return CompressionModel(good, bad, (raw_good, raw_bad), 0.0, 0.0, 0.0, level, piece)

    examples = list(zip(texts, labels))
    share = (sum(labels) + 1) / (len(labels) + 2)
    slope, centre, intercept = 0.0, 0.0, float(np.log(share / (1 - share)))
    if min(labels.count(0), labels.count(1)) >= folds:
        gaps = np.zeros(len(examples))
        for k in range(folds):
            other = of([x for i, x in enumerate(examples) if i % folds != k])
            gaps[k::folds] = other.differences([t for t, _ in examples[k::folds]])
        slope, centre, intercept = _logistic(np.clip(gaps, -0.3, 0.3), np.array(labels, float))
    model = of(examples)
    return CompressionModel(model.good, model.bad, model.raw, slope, centre, intercept, level, piece)


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int, longest: int, doc_id: str, text: str) -> tuple[list[str], list[int]]:
    """At most ``per_class`` labelled texts of each class, outside the held-out fold."""
    known = labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", 4) != 2)).distinct()
    order = F.xxhash64("doc_id", F.lit(7))
    some = [known.filter(F.col("quality") == k).orderBy(order, "doc_id").limit(per_class) for k in (0, 1)]
    some = some[0].unionByName(some[1])  # 2 * per_class rows at most, so broadcast() is bounded
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull() & (F.length("text") <= longest))
    rows = chosen.join(F.broadcast(some), "doc_id").select(order.alias("h"), "text", "quality").orderBy("h", "quality", "text").limit(2 * per_class).collect()
    return [r["text"] for r in rows], [r["quality"] for r in rows]


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 1500,
    longest: int = 20_000,
    threshold: float = 0.7,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Scores every whole text by a compression classifier learnt from ``labels``.

    zstandard dictionaries are built from good and from bad text. A text is cut into short
    pieces, each compressed with either dictionary; the difference of the sums, divided by
    the text's bytes, becomes a probability by logistic calibration (cross-fitted). The
    classifier is fitted on a bounded sample: of each class the ``per_class`` labelled rows
    with the smallest hash, of ``longest`` characters at most, outside the held-out fold
    (crc32 of the id modulo 4 is 2). Every document is scored in full, without a shuffle.

    A null text counts as empty; an empty text has the difference 0. Without examples of
    both classes every score is the smoothed share of label 1. Null labels are left out; an
    id labelled both ways is an example of both; repeated rows are scored each for itself;
    an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    model = fit(*training_rows(docs, labels, per_class, longest, doc_id, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gaps = model.differences(batch.column(1).to_pylist())
            scores = model.scores(gaps)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype("int32")), pa.array(gaps, pa.float64())],
                names=[f.split()[0] for f in SCHEMA.split(", ")],
            )

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"), (fold(doc_id, 4) == 2).alias("held_out"))
    return chosen.mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, labels: DataFrame, per_class: int = 1500, longest: int = 20_000, threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns; fitted
    and defined as in :func:`score_quality`. Rows are filtered where they are read."""
    bounded_batches(docs.sparkSession)
    model = fit(*training_rows(docs, labels, per_class, longest, doc_id, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield batch.filter(pa.array(model.scores(model.differences(texts)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
