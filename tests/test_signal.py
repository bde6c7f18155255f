"""Crossings by blocks, pyramids and programs against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from samplelake.functions import markers as mk
from samplelake.operators import signal as sg


def crossed(x, threshold):
    return [i for i in range(len(x) - 1) if (x[i] >= 0) != (x[i + 1] >= 0) and max(abs(x[i]), abs(x[i + 1])) >= threshold]


@pytest.fixture(scope="module")
def signals():
    deal = random.Random(2)
    out = {p: [deal.randint(-100, 100) for _ in range(n)] for p, n in enumerate((1, 2, 7, 8, 9, 64, 333))}
    return out | {90: [5] * 40, 91: [0, 1000, 2000, 1000, 0, -1000, -2000, -1000, 0, 1000]}


@pytest.fixture(scope="module")
def frames(spark, signals):
    return spark.createDataFrame([(p, i, s) for p, x in signals.items() for i, s in enumerate(x)], "path long, frame long, s int")


@pytest.mark.parametrize("block", [1, 4, 8, 65536])
def test_crossings_in_blocks(spark, signals, frames, block):
    """Any block size gives what a walk over the whole signal gives."""
    index = sg.crossing_index(frames, 50, block).cache()
    want = {p: crossed(x, 50) for p, x in signals.items()}
    assert sorted(map(tuple, sg.crossings(index, block).collect())) == sorted((p, i) for p, x in want.items() for i in x)
    points = [(p, s) for p, x in signals.items() for s in {0, 1, len(x) // 2, len(x) - 1, len(x) + 9}]
    starts = spark.createDataFrame(points, "path long, start long")

    near = {(p, s): (next((i for i in want[p] if i >= s), None), next((i for i in want[p][::-1] if i <= s), None)) for p, s in points}
    assert {(r.path, r.start): (r.ahead, r.back) for r in sg.nearest(index, starts, block).collect()} == near
    for n in (0, 1, 3):
        for forward in (True, False):
            for reach in (None, 20):
                sides = {(p, s): [i for i in (want[p] if forward else want[p][::-1]) if (i >= s if forward else i <= s) and (reach is None or abs(i - s) <= reach)] for p, s in points}
                best = {k: v[min(n, len(v)) - 1] for k, v in sides.items() if v and n}
                assert {(r.path, r.start): r.frame for r in sg.nth(index, starts, n, forward, reach, block).collect()} == best
    snapped = {k: min((abs(i - k[1]), i < k[1], i) for i in v if i is not None)[2] for k, v in near.items() if any(i is not None and abs(i - k[1]) <= 10 for i in v)}
    assert {(r.path, r.start): r.frame for r in sg.snap(index, starts, 10, block).collect()} == snapped
    beyond = {(p, s): [i for i in want[p] if s < i <= s + 13] for p, s in points}
    assert {(r.path, r.start): r.frame for r in sg.nudge(index, starts, 2, True, 12, block).collect()} == {k: v[min(2, len(v)) - 1] for k, v in beyond.items() if v}
    index.unpersist()


def test_a_long_path_is_many_tasks(spark):
    """Ten million frames of one path: no window or group takes them all."""
    long = spark.range(10_000_000).select((F.col("id") / 2**40 + 1).cast("int").alias("path"), F.col("id").alias("frame"), F.when(F.col("id") % 1000 < 500, 100).otherwise(-100).alias("s"))
    index = sg.crossing_index(long).cache()
    sizes = [r.n for r in index.select(F.size("offsets").alias("n")).collect()]
    assert len(sizes) == 153 and sum(sizes) == 19_999
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(path" in plan and "block" in plan.split("hashpartitioning(path", 1)[1][:40]
    found = sg.nth(index, spark.createDataFrame([(1, 5_000_000)], "path int, start long"), 1000).collect()
    assert [tuple(r) for r in found] == [(1, 5_000_000, 5_499_999)]
    index.unpersist()


@pytest.mark.parametrize("levels", [1, 3, 13])
def test_pyramid(spark, levels):
    deal = random.Random(3)
    signals = {p: [deal.randint(-32768, 32767) for _ in range(n)] for p, n in enumerate((1, 5, 9, 77, 1000, 3333))}
    frames = spark.createDataFrame([(p, i, s) for p, x in signals.items() for i, s in enumerate(x)], "path long, frame long, s int")
    want = {}
    for p, x in signals.items():
        for level in range(levels):
            k = max(max(len(x) // 9, 1) >> level, 1)
            for i, s in enumerate(x):
                if i // k < 9 << level:
                    key = p, level, i // k
                    want[key] = max(want.get(key, 0), min(abs(s), 32767) // 128)
    assert {(r.path, r.level, r.col): r.p for r in sg.pyramid(frames, levels, 9).collect()} == want


def test_program_frames(spark):
    """Runs written out are the frames, whatever the runs' length."""
    rows = [(1, [(0, 10, 2, False), (3, 7, 255, True), (5, 5, 1, False)]), (2, [(0, 1, 1, True)]), (3, [])]
    programs = spark.createDataFrame(rows, "path long, program array<struct<lo:bigint,hi:bigint,reps:int,reversed:boolean>>")
    want = []
    for path, program in rows:
        for slot, (lo, hi, reps, back) in enumerate(program):
            for rep in range(1, (1 if reps == 255 else reps) + 1):
                want += [(path, slot, rep, i, f) for i, f in enumerate(range(hi - 1, lo - 1, -1) if back else range(lo, hi))]
    for run in (1, 3, 65536):
        assert sorted(map(tuple, mk.program_frames(programs, run).collect())) == sorted(want)
        runs = mk.program_runs(programs, run).collect()
        assert sum(r.n for r in runs) == len(want) and all(0 < r.n <= run for r in runs)


def test_program_blocks_play_every_frame(spark):
    rows = [(1, [(0, 10, 2, False), (3, 7, 255, True), (5, 5, 1, False)]), (2, [(0, 1, 1, True)]), (3, [])]
    programs = spark.createDataFrame(rows, "path long, program array<struct<lo:bigint,hi:bigint,reps:int,reversed:boolean>>")
    for run in (1, 3, 65536):
        blocks = {}
        for path, slot, rep, pos, frame in mk.program_frames(programs, run).collect():
            blocks.setdefault((path, slot, rep, pos // run), []).append((pos, frame))
        want = []
        for (path, slot, rep, _), played in blocks.items():
            played.sort()
            frames = [f for _, f in played]
            places = sum(f * (i + 1) for i, f in enumerate(frames))
            want.append((path, slot, rep, played[0][0], frames[0], len(frames), min(frames), max(frames), sum(frames), places))
        assert sorted(map(tuple, mk.program_blocks(programs, run).collect())) == sorted(want)


def test_program_query_plays_every_frame(spark):
    """The query's work is that of its frames: none is left to a shorter description."""
    from samplelake.plans import registry

    from .oracle import SF

    registry.load()
    blocks = registry.QUERIES["c43_program_frames"](spark, SF)
    total = blocks.agg(F.sum("n").alias("n"), F.sum(F.col("high") - F.col("low") + 1).alias("span")).first()
    program = registry.QUERIES["c27_program"](spark, SF)
    turns = F.when(F.col("reps") == 255, 1).otherwise(F.col("reps"))
    assert total.n == total.span == program.agg(F.sum((F.col("hi") - F.col("lo")) * turns).alias("n")).first().n


PROGRAMS = "path long, program array<struct<lo:bigint,hi:bigint,reps:int,reversed:boolean>>"


def test_program_blocks_make_a_row_for_a_run(spark):
    """Frames are played within the tasks: no step of the plan makes a row for each."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        blocks = mk.program_blocks(spark.createDataFrame([(1, [(0, 2**24, 2, True)])], PROGRAMS))
        found = blocks.collect()
        made, nodes = [], [blocks._jdf.queryExecution().executedPlan()]
        while nodes:
            node = nodes.pop()
            nodes += [node.children().apply(i) for i in range(node.children().size())]
            rows = node.metrics().get("numOutputRows")
            made += [rows.get().value()] if rows.isDefined() else []
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert len(found) == 512 and sum(r.n for r in found) == 2**25
    assert max(made) == 512


def test_program_blocks_are_exact(spark):
    """Sums below 2^53, below 2^63 and close to it, of both directions; a sum beyond a long fails."""
    rows = [(1, [(lo, lo + 5000, 1, back)]) for lo in (0, 2**30, 2**32 - 5000, 2**39, 737_600_000_000) for back in (False, True)]
    rows = [(i, program) for i, (_, program) in enumerate(rows)] + [(0, [(7, 4999, 2, True)])]  # a path twice
    programs = spark.createDataFrame(rows, PROGRAMS)
    want = mk.program_frames(programs, 4096).withColumn("block", F.expr("pos div 4096")).withColumn("place", F.col("frame") * (F.col("pos") % 4096 + 1))
    first = F.max(F.when(F.col("pos") % 4096 == 0, F.col("frame")))
    sums = [F.min("pos"), first, F.count("*"), F.min("frame"), F.max("frame"), F.sum("frame"), F.sum("place")]
    want = want.groupBy("path", "slot", "rep", "block").agg(*sums).drop("block")
    assert sorted(map(tuple, mk.program_blocks(programs, 4096).collect())) == sorted(map(tuple, want.collect()))
    for back in (False, True):
        top = 2**63 // (5000 * 5001 // 2) - 5000  # the last sums that a long holds, by Python's integers
        frames = list(range(top, top + 5000))[:: -1 if back else 1]
        [row] = mk.program_blocks(spark.createDataFrame([(1, [(top, top + 5000, 1, back)])], PROGRAMS)).collect()
        assert row.frame_sum == sum(frames) and row.place_sum == sum(f * (i + 1) for i, f in enumerate(frames)) > 2**62
        with pytest.raises(Exception, match="(?i)overflow|too large"):
            mk.program_blocks(spark.createDataFrame([(1, [(2**40, 2**40 + 5000, 1, back), (2**61, 2**61 + 9, 1, back)])], PROGRAMS)).collect()
