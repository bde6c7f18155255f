"""Waveform reductions over frames (path, frame, s): a row for each sample."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 180


def decode(raw: Column, bits: int) -> Column:
    """A stored integer as a number in -1 to 1; other widths give 0."""
    scale = {8: (raw - 128) / 128.0, 16: raw / 32768.0, 24: raw / 8388608.0, 32: raw / 2147483648.0}
    return scale.get(bits, F.lit(0.0)).cast("double")


def amplitude_byte(s: Column) -> Column:
    """A 16-bit sample's size in 0 to 255."""
    return F.floor(F.least(F.abs(s), F.lit(32767)) / 128).cast("int")


def binned(frames: DataFrame, bins: int = BINS) -> DataFrame:
    """``frames`` with their bin: min(trunc(frame / (n / bins)), bins - 1), n the path's frames.

    The path's length is a partial aggregate joined back, so no path needs one task.
    """
    n = frames.groupBy("path").agg((F.max("frame") + 1).alias("n"))
    place = F.floor(F.col("frame").cast("double") / (F.col("n").cast("double") / F.lit(float(bins))))
    return frames.join(n, "path").withColumn("bin", F.least(place, F.lit(bins - 1)).cast("int"))


def filled(values: DataFrame, bins: int, *more: str) -> DataFrame:
    """(path, …, bin, v) with every bin of every path, empty ones 0."""
    keys = ["path", *more]
    every = values.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(values, [*keys, "bin"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def normalised(values: DataFrame) -> DataFrame:
    """v as 0 to 255 of the path's largest, rounded half up; silence is 0."""
    most = values.groupBy("path").agg(F.max("v").alias("most"))
    scaled = F.when(F.col("most") > 0, F.round(F.col("v") / F.col("most") * 255)).otherwise(0.0)
    return values.join(most, "path").withColumn("p", scaled.cast("int")).drop("most")


def rms() -> Column:
    x = F.col("s").cast("double")
    return F.sqrt(F.avg(x * x))


def rms_envelope(frames: DataFrame, bins: int = BINS) -> DataFrame:
    """(path, bin, p): root mean squares of the bins, normalised."""
    return normalised(filled(binned(frames, bins).groupBy("path", "bin").agg(rms().alias("v")), bins)).select("path", "bin", "p")


def peak_envelope(frames: DataFrame, bins: int = BINS) -> DataFrame:
    """(path, bin, p): the bins' largest sizes, normalised."""
    return normalised(filled(binned(frames, bins).groupBy("path", "bin").agg(F.max(F.abs("s").cast("double")).alias("v")), bins)).select("path", "bin", "p")


def stereo_envelope(frames: DataFrame, bins: int = BINS) -> DataFrame:
    """(path, bin, p): the left channel's bins, then the right one's, under one maximum; a
    mono path has its only channel twice. ``frames`` has a column ``channel``."""
    both = frames.groupBy("path").agg((F.max("frame") + 1).alias("n"), F.max("channel").alias("last"))
    place = F.floor(F.col("frame").cast("double") / (F.col("n").cast("double") / F.lit(float(bins))))
    placed = frames.join(both, "path").withColumn("bin", F.least(place, F.lit(bins - 1)).cast("int"))
    own = placed.groupBy("path", "last", "channel", "bin").agg(rms().alias("v"))
    twice = own.withColumn("channel", F.explode(F.when(F.col("last") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array("channel"))))
    sides = twice.select("path").distinct().withColumn("channel", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    whole = sides.join(twice.select("path", "channel", "bin", "v"), ["path", "channel", "bin"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    return normalised(whole).select("path", (F.col("channel") * bins + F.col("bin")).cast("int").alias("bin"), "p")


def block_peaks(frames: DataFrame, block: int) -> DataFrame:
    """(path, block, p): the largest 0 to 255 size in each run of ``block`` frames."""
    return frames.groupBy("path", F.floor(F.col("frame") / block).alias("block")).agg(F.max(amplitude_byte(F.col("s"))).alias("p"))


def level_sizes(columns: int, levels: int) -> Column:
    """Frames of a column at each level: max(k0 >> L, 1), k0 = max(n / columns, 1)."""
    first = F.greatest(F.floor(F.col("n") / columns), F.lit(1)).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda i: F.greatest(F.floor(first / F.pow(F.lit(2), i)).cast("long"), F.lit(1)))


def pyramid(frames: DataFrame, levels: int = 13, columns: int = BINS) -> DataFrame:
    """(path, level, col, p): level L has columns * 2^L columns of max(k0 >> L, 1) frames,
    k0 = frames / columns. Columns that hold no frame are 0 and have no row.

    A level whose columns are one or two of the next level's whole ones is merged from the
    next; the others, where a size is odd, are read from the frames. So frames are reduced
    once for each odd size, and all levels are exact.
    """
    n = frames.groupBy("path").agg((F.max("frame") + 1).alias("n")).withColumn("k", level_sizes(columns, levels))
    # each level's base: itself where its size isn't a multiple of the next one's
    own = F.transform("k", lambda x, i: F.when((i == levels - 1) | (x % F.col("k")[i + 1] != 0), i))
    bases = n.select("path", "k", F.array_compact(own).alias("bases"))
    spread = frames.join(bases, "path").select("path", "k", "bases", "frame", amplitude_byte(F.col("s")).alias("p"), F.explode("bases").alias("base"))
    col = F.expr("frame div k[base]")
    grid = spread.withColumn("col", col).filter(F.col("col") < F.lit(columns) * F.pow(F.lit(2), F.col("base"))).groupBy("path", "base", "col").agg(F.max("p").alias("p"))
    steps = bases.select("path", "k", F.posexplode("bases").alias("i", "base"), F.col("bases").alias("all"))
    first = F.when(F.col("i") == 0, F.lit(0)).otherwise(F.expr("all[i - 1]") + 1)
    steps = steps.select("path", "base", F.transform(F.sequence(first, F.col("base")), lambda level: F.struct(level.alias("level"), F.floor(F.col("k")[level] / F.col("k")[F.col("base")]).alias("of"))).alias("up"))
    merged = grid.join(steps, ["path", "base"]).select("path", "col", "p", F.explode("up").alias("up")).select("path", F.col("up.level").alias("level"), F.expr("col div up.of").alias("col"), "p")
    wide = F.lit(columns) * F.pow(F.lit(2), F.col("level"))
    return merged.filter(F.col("col") < wide).groupBy("path", "level", "col").agg(F.max("p").alias("p"))


#: Frames of a block of crossings.
BLOCK = 65_536


def crossing_index(frames: DataFrame, threshold: int = 64, block: int = BLOCK) -> DataFrame:
    """(path, block, offsets): where, within each block of frames, the sign changes to the
    next frame (0 counts as positive) and one of the two is ``threshold`` or more in size.

    A block's last frame meets the next block's first one, which is there twice: a halo of
    one frame, so that a path is as many tasks as it has blocks. Frames have no gaps.
    """
    here = F.expr(f"frame div {block}")
    halo = F.when((F.col("frame") % block == 0) & (F.col("frame") > 0), F.array(here - 1, here)).otherwise(F.array(here))
    ahead = F.lead("s").over(Window.partitionBy("path", "block").orderBy("frame"))
    both = frames.select("path", "frame", "s", F.explode(halo).alias("block")).select("path", "block", "frame", F.col("s").alias("a"), ahead.alias("b")).filter("b IS NOT NULL")
    crossed = both.filter(((F.col("a") >= 0) != (F.col("b") >= 0)) & (F.greatest(F.abs("a"), F.abs("b")) >= threshold))
    offset = (F.col("frame") - F.col("block") * block).cast("int")
    return crossed.groupBy("path", "block").agg(F.sort_array(F.collect_list(offset)).alias("offsets"))  # a block's own


def crossings(index: DataFrame, block: int = BLOCK) -> DataFrame:
    """(path, frame) of an index."""
    return index.select("path", "block", F.explode("offsets").alias("offset")).select("path", (F.col("block") * block + F.col("offset")).alias("frame"))


def directory(index: DataFrame) -> DataFrame:
    """(path, blocks, total): each path's blocks in order, with the crossings before them and
    their own; an entry for a block, so a path of a billion frames has some 15 000."""
    counts = index.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("block", F.size("offsets").cast("long").alias("n")))).alias("counts"))
    entry = F.struct(F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("n"))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.slice(F.array(entry), F.lit(1), F.lit(0)).alias("blocks"))
    added = F.aggregate(
        "counts", start, lambda acc, c: F.struct((acc["total"] + c["n"]).alias("total"), F.array_append(acc["blocks"], F.struct(c["block"].cast("long").alias("block"), acc["total"].alias("before"), c["n"].alias("n"))).alias("blocks"))
    )
    return counts.select("path", added.alias("d")).select("path", "d.blocks", "d.total")


def counted_below(index: DataFrame, points: DataFrame, at: str, name: str, block: int = BLOCK) -> DataFrame:
    """``points``, which have their path's ``blocks``, with the number of crossings before
    the frame ``at``: the directory's, and those of the one block that has it."""
    placed = points.withColumn("_block", F.expr(f"{at} div {block}"))
    earlier = F.filter("blocks", lambda b: b["block"] < F.col("_block"))
    last = F.try_element_at(earlier, F.lit(-1))
    found = placed.join(index.select("path", F.col("block").alias("_block"), F.col("offsets").alias("_offsets")), ["path", "_block"], "left")
    within = F.size(F.filter(F.coalesce("_offsets", F.array().cast("array<int>")), lambda o: o < F.col(at) - F.col("_block") * block))
    return found.withColumn(name, F.coalesce(last["before"] + last["n"], F.lit(0)) + within).drop("_block", "_offsets")


def frame_of(index: DataFrame, points: DataFrame, rank: str, name: str, block: int = BLOCK) -> DataFrame:
    """``points`` with the frame of the crossing numbered ``rank`` (from 1) of its path, null
    where there is none: the directory tells the one block to read."""
    holds = F.filter("blocks", lambda b: (b["before"] < F.col(rank)) & (F.col(rank) <= b["before"] + b["n"]))
    placed = points.withColumn("_at", F.try_element_at(holds, F.lit(1))).withColumn("_block", F.col("_at.block"))
    found = placed.join(index.select("path", F.col("block").alias("_block"), F.col("offsets").alias("_offsets")), ["path", "_block"], "left")
    own = F.try_element_at("_offsets", (F.col(rank) - F.col("_at.before")).cast("int"))
    return found.withColumn(name, F.col("_block") * block + own).drop("_at", "_block", "_offsets")


def _points(index: DataFrame, starts: DataFrame) -> DataFrame:
    none = F.array().cast("array<struct<block:bigint,before:bigint,n:bigint>>")
    return starts.select("path", "start").distinct().join(directory(index), "path", "left").withColumns({"blocks": F.coalesce("blocks", none), "total": F.coalesce("total", F.lit(0))})


def nearest(index: DataFrame, starts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(path, start, ahead, back): the first crossing from ``start`` on, the last one up to it."""
    points = counted_below(index, _points(index, starts), "start", "below", block).withColumn("next", F.col("below") + 1)
    found = frame_of(index, points, "next", "ahead", block)
    # one that begins at the start itself is both; else the last one before is numbered below
    found = found.withColumn("upto", F.when(F.col("ahead") == F.col("start"), F.col("next")).otherwise(F.col("below")))
    return frame_of(index, found, "upto", "back", block).select("path", "start", "ahead", "back")


def nth(index: DataFrame, starts: DataFrame, n: int, forward: bool = True, reach: int | None = None, block: int = BLOCK) -> DataFrame:
    """(path, start, frame): the nth crossing from ``start``, or the last found if fewer, of
    all or of those within ``reach``; n = 0 gives none."""
    points = _points(index, starts).withColumn("far", F.col("start") + (reach if forward else -reach) if reach is not None else F.lit(None).cast("long"))
    if forward:
        points = counted_below(index, points, "start", "low", block)
        points = counted_below(index, points.withColumn("_end", F.col("far") + 1), "_end", "high", block) if reach is not None else points.withColumn("high", F.col("total"))
        rank = F.least(F.col("low") + n, F.col("high"))
    else:
        points = counted_below(index, points.withColumn("_end", F.col("start") + 1), "_end", "high", block)
        points = counted_below(index, points, "far", "low", block) if reach is not None else points.withColumn("low", F.lit(0))
        rank = F.greatest(F.col("high") - n + 1, F.col("low") + 1)
    wanted = points.filter(F.col("low") < F.col("high")).filter(F.lit(n > 0)).withColumn("rank", rank)
    return frame_of(index, wanted, "rank", "frame", block).select("path", "start", "frame")


def snap(index: DataFrame, starts: DataFrame, reach: int = 4096, block: int = BLOCK) -> DataFrame:
    """(path, start, frame): the crossing next to ``start`` within reach; ties go forward."""
    found = nearest(index, starts, block)
    ahead, back = F.col("ahead") - F.col("start"), F.col("start") - F.col("back")
    best = F.when(back.isNull() | (ahead <= back), F.col("ahead")).otherwise(F.col("back"))
    return found.select("path", "start", best.alias("frame")).filter(F.abs(F.col("frame") - F.col("start")) <= reach)


def nudge(index: DataFrame, starts: DataFrame, n: int, forward: bool = True, reach: int = 8192, block: int = BLOCK) -> DataFrame:
    """The nth crossing beyond ``start``, which itself doesn't count, within reach."""
    step = 1 if forward else -1
    found = nth(index, starts.withColumn("start", F.col("start") + step), n, forward, reach, block)
    return found.withColumn("start", F.col("start") - step)


def resample(values: Column, m: int) -> Column:
    """``values`` at ``m`` evenly spaced places, linearly between neighbours, rounded."""
    n = F.size(values)

    def at(i: Column) -> Column:
        pos = i.cast("double") * (n - 1).cast("double") / F.lit(float(max(m - 1, 1)))
        low = F.floor(pos).cast("int")
        a, b = F.element_at(values, low + 1), F.element_at(values, F.least(low + 2, n))
        return F.round(a + (b - a) * (pos - low)).cast("int")

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.lit(m - 1)), at))


def trim_silence(frames: DataFrame, level_db: float = -60.0) -> DataFrame:
    """The frames from the first to the last one above the level; ``s`` is in -1 to 1."""
    loud = frames.filter(F.abs("s") > 10 ** (level_db / 20)).groupBy("path").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
    kept = frames.join(loud, "path").filter(F.col("frame").between(F.col("first"), F.col("last")))
    return kept.withColumn("frame", F.col("frame") - F.col("first")).drop("first", "last")


def fit_window(values: Column, width: int) -> Column:
    """The middle ``width`` values, or all with zeros after them."""
    n = F.size(values)
    cut = F.slice(values, F.floor((n - width) / 2).cast("int") + 1, F.lit(width))
    return F.when(n >= width, cut).otherwise(F.concat(values, F.array_repeat(F.lit(0.0), F.greatest(F.lit(width) - n, F.lit(0)))))


def normalise_peak(values: Column, level_db: float = -1.0) -> Column:
    """Scaled so that the largest size is at the level; silence stays."""
    most = F.array_max(F.transform(values, lambda x: F.abs(x)))
    return F.when(most > 0, F.transform(values, lambda x: x * F.lit(10 ** (level_db / 20)) / most)).otherwise(values)


def window(frames: DataFrame, center: int, radius: int) -> DataFrame:
    return frames.filter(F.col("frame").between(center - radius, center + radius))


def preprocess(frames: np.ndarray | None, rate: int, width: int, silence_db: float = -60.0, peak_db: float = -1.0) -> np.ndarray | None:
    """A signal as an encoder takes it: the mean of the channels of ``frames`` (n, channels)
    in -1 to 1, without silence at its ends, centred in ``width`` samples or filled up with
    zeros, at its peak level. None for an unreadable or silent signal; a rate other than
    48 kHz raises ValueError, since nothing here resamples."""
    if rate != 48_000:
        raise ValueError(f"a signal of {rate} Hz must be resampled to 48000 Hz first")
    if frames is None or not len(frames):
        return None
    mono = np.asarray(frames, np.float64).reshape(len(frames), -1).mean(1)
    loud = np.flatnonzero(np.abs(mono) > 10 ** (silence_db / 20))
    if not len(loud):
        return None
    mono = mono[loud[0] : loud[-1] + 1]
    extra = len(mono) - width
    mono = mono[extra // 2 : extra // 2 + width] if extra >= 0 else np.pad(mono, (0, -extra))
    most = np.abs(mono).max()
    return (mono * (10 ** (peak_db / 20) / most) if most > 0 else mono).astype(np.float32)


def preprocess_files(files: DataFrame, decode: Callable[[bytes], tuple[np.ndarray | None, int]], width: int) -> DataFrame:
    """(path, signal, error) of files (path, content), each by itself; ``decode`` gives a
    file's frames and rate. What can't be read, is silent or has another rate has no signal."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    signal, error = preprocess(*decode(bytes(content)), width), None
                except Exception as raised:  # noqa: BLE001  a broken file is reported, and the run goes on
                    signal, error = None, f"{type(raised).__name__}: {raised}"
                rows.append((path, signal, error))
            yield pd.DataFrame(rows, columns=["path", "signal", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, signal array<float>, error string")
