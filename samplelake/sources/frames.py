"""Samples of WAV and AIFF files as rows: byte ranges of the data chunk are the unit of work."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import dealt, ship, stage
from ..functions.resampling import Resampler
from . import wav
from .files import list_tree, opened

SHAPE = "path string, kind string, channels int, sample_rate int, block_align int, bit_depth int, begin long, frames long, error string"
FRAME = "path string, channel int, frame long, s int, x double"
#: Frames that a task reads at a time.
STEP = 65_536


def shape_of(path: str) -> tuple:
    """Where a file's samples are and what they look like; the file's own end counts."""
    try:
        with opened(path) as f:
            if path.lower().endswith((".aif", ".aiff")):
                a = wav.scan_aiff(f)
                size = min(a["size"], a["frames"] * a["block_align"], max(f.size() - a["begin"], 0))
                return path, a["kind"], a["channels"], a["sample_rate"], a["block_align"], a["bit_depth"], a["begin"], size // a["block_align"], None
            found = wav.scan_chunks(f)
            if found.fmt is None or found.data is None:
                raise ValueError("no fmt or no data chunk")
            f.seek(found.fmt[0])
            fmt = wav.decode_fmt(f.read(min(found.fmt[1], 40)))
            width = fmt["bit_depth"] // 8 * fmt["channels"]
            if width <= 0:
                raise ValueError("samples without a size")
            size = min(found.data[1], max(f.size() - found.data[0], 0))
            return path, fmt["kind"], fmt["channels"], fmt["sample_rate"], width, fmt["bit_depth"], found.data[0], size // width, None
    except (OSError, ValueError, struct.error) as raised:
        return path, None, None, None, None, None, None, None, f"{type(raised).__name__}: {raised}"


def shapes(files: DataFrame, each: int = 500) -> DataFrame:
    """A row for each file (path): its sample format, where its data begins and how many
    frames it has; or its error. Headers only are read, of ``each`` files a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
        schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in SHAPE.split(", ")])
        for batch in batches:
            rows = [shape_of(p) for p in batch.column(0).to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    ship(files.sparkSession)
    return dealt(files.select("path"), each).mapInArrow(run, SHAPE)


def as_int16(x: np.ndarray, kind: str) -> np.ndarray:
    """Samples in -1 to 1 as 16-bit integers: floats are cut off, integers shifted."""
    if kind == "float":
        return np.trunc(np.clip(x, -1, 1) * 32767).astype(np.int32)
    return np.floor(x * 32768).astype(np.int32)


def read_range(shape: dict, first: int, count: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first frame, frames by channels in -1 to 1) of a range, a step at a time."""
    fmt = {"kind": shape["kind"], "channels": shape["channels"], "bit_depth": shape["bit_depth"]}
    with opened(shape["path"]) as f:
        f.seek(shape["begin"] + first * shape["block_align"])
        for at in range(first, first + count, STEP):
            raw = f.read(min(STEP, first + count - at) * shape["block_align"])
            values = wav.samples(raw, fmt)
            if not len(values):
                return
            yield at, values


def ranges_of(known: DataFrame, total: str, size: int, each: int) -> DataFrame:
    """Rows of (path, …, first, count): the ranges of ``size`` of each file, ``each`` a task."""
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col(total) - 1, F.lit(size).cast("long")))
    cut = known.select("*", first.alias("first")).withColumn("count", F.least(F.lit(size), F.col(total) - F.col("first")))
    return dealt(cut, each, "path", "first")


def read_frames(files: DataFrame, mix: bool = False, range_frames: int = 1 << 20, each: int = 4) -> DataFrame:
    """(path, channel, frame, s, x) of WAV and AIFF files (path): every sample of every channel, or of
    their mean (``mix``, channel 0); x in -1 to 1, s as 16 bits.

    A file is cut into ranges of ``range_frames`` frames; ``each`` of them are a task, so
    one long file is as many tasks as it has ranges, and a task reads only its bytes, 65 536
    frames at a time. Files that can't be read have no rows here: :func:`shapes` has their
    errors. A data chunk that ends early has the frames that are there.
    """
    known = stage(shapes(files), "shapes").filter("error IS NULL AND frames > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shape in batch.to_pylist():
                for at, values in read_range(shape, shape["first"], shape["count"]):
                    values = values.mean(1, keepdims=True) if mix else values
                    n, channels = values.shape
                    flat = values.ravel()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([shape["path"]]).take(pa.array(np.zeros(n * channels, np.int32))),
                            pa.array(np.tile(np.arange(channels, dtype=np.int32), n)),
                            pa.array(np.repeat(np.arange(at, at + n), channels)),
                            pa.array(as_int16(flat, shape["kind"])),
                            pa.array(flat.astype(np.float64)),
                        ],
                        names=["path", "channel", "frame", "s", "x"],
                    )

    return ranges_of(known, "frames", range_frames, each).mapInArrow(run, FRAME)


def frames_of(spark: SparkSession, roots: list[str], **options) -> DataFrame:
    """:func:`read_frames` of all WAV and AIFF files under ``roots``."""
    return read_frames(list_tree(spark, roots).filter(r"error IS NULL AND lower(path) RLIKE '\\.(wav|aiff?)$'"), **options)


def resampled(shape: dict, rate: Resampler, first: int, count: int) -> np.ndarray:
    """A range of the mean of a file's channels at another rate, from the bytes it needs."""
    begin, end = rate.needs(first, count)
    parts = [values.mean(1) for _, values in read_range(shape, begin, min(end, shape["frames"]) - begin)]
    return rate(np.concatenate(parts) if parts else np.zeros(0), first, count, begin)


def resample_frames(files: DataFrame, target: int = 48_000, range_frames: int = 1 << 18, each: int = 4) -> DataFrame:
    """(path, frame, x): the mean of the channels of WAV files (path) at the rate ``target``.

    Ranges of the output are dealt to tasks; each reads its part of the source and a margin
    of the filter's reach on both sides, so that ranges meet without a seam.
    """
    known = stage(shapes(files), "shapes").filter("error IS NULL AND frames > 0 AND sample_rate > 0")
    known = known.withColumn("total", F.ceil(F.col("frames").cast("decimal(20,0)") * target / F.col("sample_rate")).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rates: dict[int, Resampler] = {}
        for batch in batches:
            for shape in batch.to_pylist():
                rate = rates.setdefault(shape["sample_rate"], Resampler(shape["sample_rate"], target))
                values = resampled(shape, rate, shape["first"], shape["count"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shape["path"]]).take(pa.array(np.zeros(len(values), np.int32))), pa.array(np.arange(shape["first"], shape["first"] + len(values))), pa.array(values)],
                    names=["path", "frame", "x"],
                )

    return ranges_of(known, "total", range_frames, each).mapInArrow(run, "path string, frame long, x double")


def prepare_signals(files: DataFrame, width: int = 96_000, target: int = 48_000, silence_db: float = -60.0, peak_db: float = -1.0, each: int = 50) -> DataFrame:
    """(path, signal, error): WAV files (path) as an encoder takes them: the mean of the
    channels at the rate ``target``, without silence at its ends, the middle ``width`` samples
    or zeros after the last, at its peak level. A silent file has no signal and no error.

    A file is walked once for where its sound begins and ends, a step at a time, and then
    only its window is read, so a task holds a window whatever the file's length.
    """
    known = stage(shapes(files), "shapes")
    level, most = 10 ** (silence_db / 20), 10 ** (peak_db / 20)

    def prepared(shape: dict, rate: Resampler) -> np.ndarray | None:
        total, first, last = rate.length(shape["frames"]), None, None
        for at in range(0, total, STEP):
            loud = np.flatnonzero(np.abs(resampled(shape, rate, at, min(STEP, total - at))) > level)
            if len(loud):
                first, last = at + loud[0] if first is None else first, at + loud[-1]
        if first is None:
            return None
        size = last + 1 - first
        values = resampled(shape, rate, first + max(0, (size - width) // 2), min(size, width))
        values = np.pad(values, (0, width - len(values)))
        return (values * (most / np.abs(values).max())).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rates: dict[int, Resampler] = {}
        for batch in batches:
            for shape in batch.to_pylist():
                signal, error = None, shape["error"]
                if error is None:
                    try:
                        signal = prepared(shape, rates.setdefault(shape["sample_rate"], Resampler(shape["sample_rate"], target)))
                    except (OSError, ValueError) as raised:
                        error = f"{type(raised).__name__}: {raised}"
                yield pa.RecordBatch.from_arrays([pa.array([shape["path"]]), pa.array([signal], pa.list_(pa.float32())), pa.array([error], pa.string())], names=["path", "signal", "error"])

    return dealt(known, each, "path").mapInArrow(run, "path string, signal array<float>, error string")
