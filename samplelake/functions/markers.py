"""Marker banks, segments and playback programs, as columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import dealt, ship

#: A marker that isn't set.
EMPTY = 4294967295


def pack_reps(a: Column, b: Column) -> Column:
    """Two counts of 0 to 15 in one byte."""
    return (a.bitwiseAND(15) * 16 + b.bitwiseAND(15)).cast("int")


def unpack_reps(byte: Column) -> Column:
    return F.array(F.shiftright(byte, 4).bitwiseAND(15), byte.bitwiseAND(15))


def defined(*markers: Column) -> Column:
    return F.filter(F.array(*markers), lambda m: m != EMPTY)


def is_empty(*markers: Column) -> Column:
    return F.size(defined(*markers)) == 0


def preset(total: Column) -> Column:
    """From 96000 frames on a loop of quarters, each once; else one shot of the whole."""
    loop = total >= 96_000

    def mark(i: int) -> Column:
        return F.when(loop, F.floor(total * i / 4)).otherwise(0).cast("long").alias(f"m{i}")

    return F.struct(F.when(loop, "loop").otherwise("shot").alias("kind"), mark(1), mark(2), mark(3), F.when(loop, F.array(*[F.lit(1)] * 4)).otherwise(F.array(*[F.lit(x) for x in (0, 0, 0, 1)])).alias("reps"))


def segments(markers: list[Column], reps: list[Column], total: Column) -> Column:
    """Four segments between 0, the markers and the end; a marker that isn't set is where the
    one before is, none is beyond the end, and a segment that runs back is reversed."""
    bounds = [F.lit(0).cast("long")]
    for m in markers:
        bounds.append(F.when(m == EMPTY, bounds[-1]).otherwise(F.least(m, total)))
    bounds.append(total)
    return F.array(*[F.struct(a.alias("start"), b.alias("end"), r.alias("rep"), (a > b).alias("reverse")) for a, b, r in zip(bounds, bounds[1:], reps)])


def program(parts: Column, total: Column) -> Column:
    """Segments to play, as forward ranges with their direction: those with repeats and a
    length; with no repeats at all the whole file once. 15 repeats are without end (255)."""
    silent = F.forall(parts, lambda s: s["rep"] == 0)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("lo"), total.alias("hi"), F.lit(1).alias("reps"), F.lit(False).alias("reversed")))
    ranges = F.transform(
        F.filter(parts, lambda s: (s["rep"] > 0) & (s["start"] != s["end"])),
        lambda s: F.struct(F.least(s["start"], s["end"]).alias("lo"), F.least(F.greatest(s["start"], s["end"]), total).alias("hi"), F.when(s["rep"] == 15, 255).otherwise(s["rep"]).alias("reps"), s["reverse"].alias("reversed")),
    )
    return F.when(silent, whole).otherwise(F.filter(ranges, lambda r: r["lo"] < r["hi"]))


def program_runs(programs: DataFrame, run: int = 65_536) -> DataFrame:
    """(path, slot, rep, pos, frame, step, n): all frames in playing order, as runs of up to
    ``run`` that begin at ``frame`` and go up or down; an endless segment plays once, an
    empty one not at all."""
    # outer, for else a filter on the program's size works out all programs once more, where they are read
    slots = programs.select("path", F.posexplode_outer("program").alias("slot", "r"))
    reps = F.when(F.col("r.reps") == 255, 1).otherwise(F.col("r.reps"))
    length = F.col("r.hi") - F.col("r.lo")
    turns = slots.filter(length > 0).select("path", "slot", "r", F.explode(F.sequence(F.lit(1), reps)).alias("rep"))
    cut = turns.select("path", "slot", "rep", "r", length.alias("length"), F.explode(F.sequence(F.lit(0).cast("long"), length - 1, F.lit(run).cast("long"))).alias("pos"))
    begin = F.when(F.col("r.reversed"), F.col("r.hi") - 1 - F.col("pos")).otherwise(F.col("r.lo") + F.col("pos"))
    return cut.select("path", "slot", "rep", "pos", begin.alias("frame"), F.when(F.col("r.reversed"), -1).otherwise(1).alias("step"), F.least(F.lit(run), F.col("length") - F.col("pos")).alias("n"))


def program_frames(programs: DataFrame, run: int = 65_536, each: int = 2048) -> DataFrame:
    """(path, slot, rep, pos, frame): each frame in playing order. The runs are dealt out,
    ``each`` a task, before they are written out, so that a long program is many tasks."""
    runs = dealt(program_runs(programs, run), each, "path", "slot", "rep", "pos")
    steps = runs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("i"))
    return steps.select("path", "slot", "rep", (F.col("pos") + F.col("i")).alias("pos"), (F.col("frame") + F.col("step") * F.col("i")).alias("frame"))


def played(frame: int, step: int, n: int, order: dict) -> tuple[int, ...]:
    """What a run counts to: its frames are written out as one array, in float64 where each
    sum is below 2^53, in int64 below 2^63, else in Python's integers."""
    bound = (abs(frame) + n) * n * (n + 1) // 2
    kind = np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object
    if kind not in order:
        order[kind] = tuple(x.astype(kind) for x in order[np.int64])
    steps, places = (x[:n] for x in order[kind])
    frames = frame + steps if step > 0 else frame - steps
    return len(frames), int(frames.min()), int(frames.max()), int(frames.sum()), int(frames @ places)


def program_blocks(programs: DataFrame, run: int = 65_536, each: int = 8192) -> DataFrame:
    """(path, slot, rep, pos, frame, n, low, high, frame_sum, place_sum): every frame of all
    programs is played, and each ``run`` of a turn counted: where it begins, its first, least
    and greatest frame, how many there are, their sum, and that of each times its place. The
    runs are dealt out, ``each`` a task, which plays one after the other in memory."""
    ship(programs.sparkSession)
    fields = ["n", "low", "high", "frame_sum", "place_sum"]

    @F.arrow_udf(", ".join(f"{f} long" for f in fields))
    def play(frame: pa.Array, step: pa.Array, n: pa.Array) -> pa.Array:
        lengths = n.to_pylist()
        longest = np.arange(max(lengths, default=0))
        order = {np.int64: (longest, longest + 1)}
        rows = [played(*r, order) for r in zip(frame.to_pylist(), step.to_pylist(), lengths)]
        columns = list(zip(*rows)) or [()] * len(fields)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields)

    runs = dealt(program_runs(programs, run), each, "path", "slot", "rep", "pos")
    counted = runs.select("path", "slot", "rep", "pos", "frame", play("frame", "step", "n").alias("played"))
    # programs of several rows of a path are counted together
    return counted.groupBy("path", "slot", "rep", "pos").agg(
        F.max("frame").alias("frame"),
        F.sum("played.n").alias("n"),
        F.min("played.low").alias("low"),
        F.max("played.high").alias("high"),
        F.sum("played.frame_sum").alias("frame_sum"),
        F.sum("played.place_sum").alias("place_sum"),
    )


def segment_at(parts: Column, position: Column) -> Column:
    """The first segment that has the position in it, else the last."""
    inside = F.transform(parts, lambda s, i: F.when((position >= F.least(s["start"], s["end"])) & (position < F.greatest(s["start"], s["end"])), i))
    return F.coalesce(F.array_min(inside), F.lit(3))


def nearest_slot(markers: list[Column], cursor: Column) -> Column:
    """The number of the marker next to the cursor (ties: the first); null if none is set."""
    found = F.array(*[F.when(m != EMPTY, F.struct(F.abs(m - cursor).alias("d"), F.lit(i).alias("i"))) for i, m in enumerate(markers, 1)])
    return F.array_min(found)["i"]


def linear_gain(db: Column) -> Column:
    return F.pow(F.lit(10.0), F.greatest(F.lit(-60.0), F.least(F.lit(6.0), db)) / 20)


def cents_ratio(cents: Column) -> Column:
    return F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.pow(F.lit(2.0), cents / 1200)))


def tempo_ratio(own: Column, session: Column) -> Column:
    clamped = F.greatest(F.lit(10.0), F.least(F.lit(999.9), session))
    return F.when(own > 0, F.greatest(F.lit(0.5), F.least(F.lit(2.0), clamped / own)))


def view_column(sample: Column, start: Column, span: Column, width: int) -> Column:
    """The screen column of a sample within [start, start + span); null outside."""
    inside = (sample >= start) & (sample < start + span) & (span > 0)
    return F.when(inside, F.floor((sample - start) * width / F.when(span > 0, span)).cast("long"))


def fade_gain(left: Column, length: Column, rising: bool, frames: int = 64) -> Column:
    """Gain while ``left`` frames of a fade are to come, of at most ``frames`` or the length."""
    part = F.least(left, F.least(F.lit(frames), length)) / float(frames)
    return 1 - part if rising else part
