"""Signals, markers, segments and playback programs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cluster import dealt
from ..functions import markers as mk
from ..operators import signal as sg
from .registry import query

BIN = "CAST(least(floor(CAST(frame AS DOUBLE) / (CAST(n AS DOUBLE) / 180.0e0)), 179.0e0) AS INT)"
BINNED = f"n AS (SELECT path, max(frame) + 1 AS n FROM frames GROUP BY path), b AS (SELECT f.path, s, {BIN} AS bin FROM frames f JOIN n ON f.path = n.path)"
EVERY = "e AS (SELECT path, CAST(unnest(range(180)) AS INT) AS bin FROM n)"


def _envelope(value: str) -> str:
    return f"""WITH {BINNED}, {EVERY}, g AS (SELECT path, bin, {value} AS v FROM b GROUP BY path, bin), w AS (SELECT e.path, e.bin, coalesce(v, 0) AS v FROM e LEFT JOIN g ON e.path = g.path AND e.bin = g.bin)
 SELECT path, bin, CAST(CASE WHEN max(v) OVER (PARTITION BY path) > 0 THEN round(v / max(v) OVER (PARTITION BY path) * 255) ELSE 0 END AS INT) AS p FROM w"""


@query("a07_rms_envelope", _envelope("sqrt(avg(CAST(s AS DOUBLE) * CAST(s AS DOUBLE)))"))
@query("a09_normalised_envelope", _envelope("sqrt(avg(CAST(s AS DOUBLE) * CAST(s AS DOUBLE)))"))
def a07(v):
    return sg.rms_envelope(v.frames)


@query("a08_peak_envelope", _envelope("max(abs(CAST(s AS DOUBLE)))"))
def a08(v):
    return sg.peak_envelope(v.frames)


@query("a10_stereo_envelope", f"""WITH n AS (SELECT path, max(frame) + 1 AS n, max(channel) AS last FROM stereo GROUP BY path),
 g AS (SELECT f.path, last, channel, {BIN} AS bin, sqrt(avg(CAST(s AS DOUBLE) * CAST(s AS DOUBLE))) AS v FROM stereo f JOIN n ON f.path = n.path GROUP BY 1, 2, 3, 4),
 t AS (SELECT path, channel, bin, v FROM g UNION ALL SELECT path, 1, bin, v FROM g WHERE last = 0),
 e AS (SELECT DISTINCT path, c AS channel, CAST(unnest(range(180)) AS INT) AS bin FROM n, (VALUES (0), (1)) x(c)),
 w AS (SELECT e.path, e.channel, e.bin, coalesce(v, 0) AS v FROM e LEFT JOIN t ON e.path = t.path AND e.channel = t.channel AND e.bin = t.bin)
 SELECT path, CAST(channel * 180 + bin AS INT) AS bin, CAST(CASE WHEN max(v) OVER (PARTITION BY path) > 0 THEN round(v / max(v) OVER (PARTITION BY path) * 255) ELSE 0 END AS INT) AS p FROM w""")
def a10(v):
    return sg.stereo_envelope(v.stereo)


BYTE = "CAST(least(abs(s * 200), 32767) // 128 AS INT)"


@query("a13_block_peaks", f"SELECT path, frame // 16 AS block, max({BYTE}) AS p FROM frames GROUP BY 1, 2")
def a13(v):
    return sg.block_peaks(v.frames.withColumn("s", F.col("s") * 200), 16)


@query("c32_amplitude_byte", f"SELECT path, frame, {BYTE} AS p FROM frames")
def c32(v):
    return v.frames.select("path", "frame", sg.amplitude_byte(F.col("s") * 200).alias("p"))


@query("a14_pyramid", f"""WITH n AS (SELECT path, max(frame) + 1 AS n FROM frames GROUP BY path),
 k AS (SELECT path, l AS level, greatest(greatest(n // 180, 1) // CAST(pow(2, l) AS BIGINT), 1) AS k, CAST(180 * pow(2, l) AS BIGINT) AS wide FROM n, (SELECT CAST(unnest(range(13)) AS INT) AS l) x)
 SELECT f.path, level, frame // k AS col, max({BYTE}) AS p FROM frames f JOIN k ON f.path = k.path WHERE frame // k < wide GROUP BY 1, 2, 3""")
def a14(v):
    return sg.pyramid(v.frames.withColumn("s", F.col("s") * 200))


Z = """z AS (SELECT path, frame FROM (SELECT path, frame, s AS a, lead(s) OVER (PARTITION BY path ORDER BY frame) AS b FROM frames)
 WHERE b IS NOT NULL AND (a >= 0) <> (b >= 0) AND greatest(abs(a), abs(b)) >= 64)"""
STARTS = "st AS (SELECT path, max(frame) // 2 AS start FROM frames GROUP BY path)"


def starts(v):
    return v.frames.groupBy("path").agg(F.floor(F.max("frame") / 2).alias("start"))


@query("w01_zero_crossings", f"WITH {Z} SELECT path, frame FROM z")
def w01(v):
    return sg.crossings(sg.crossing_index(v.frames))


@query("w02_nearest_crossing", f"WITH {Z}, {STARTS} SELECT st.path, start, min(CASE WHEN frame >= start THEN frame END) AS ahead, max(CASE WHEN frame <= start THEN frame END) AS back FROM st LEFT JOIN z ON st.path = z.path GROUP BY 1, 2")
def w02(v):
    return sg.nearest(sg.crossing_index(v.frames), starts(v))


@query("w03_nth_crossing", f"""WITH {Z}, {STARTS}, f AS (SELECT st.path, start, frame, row_number() OVER (PARTITION BY st.path ORDER BY frame) AS rn FROM st JOIN z ON st.path = z.path WHERE frame >= start)
 SELECT path, start, max(frame) AS frame FROM f WHERE rn <= 5 GROUP BY 1, 2""")
def w03(v):
    return sg.nth(sg.crossing_index(v.frames), starts(v), 5)


@query("w03_nth_crossing_back", f"""WITH {Z}, {STARTS}, f AS (SELECT st.path, start, frame, row_number() OVER (PARTITION BY st.path ORDER BY frame DESC) AS rn FROM st JOIN z ON st.path = z.path WHERE frame <= start)
 SELECT path, start, min(frame) AS frame FROM f WHERE rn <= 5 GROUP BY 1, 2""")
def w03_back(v):
    return sg.nth(sg.crossing_index(v.frames), starts(v), 5, forward=False)


@query("w04_snap", f"""WITH {Z}, {STARTS}, f AS (SELECT st.path, start, frame, row_number() OVER (PARTITION BY st.path ORDER BY abs(frame - start), CASE WHEN frame < start THEN 1 ELSE 0 END) AS rn
 FROM st JOIN z ON st.path = z.path WHERE abs(frame - start) <= 4096) SELECT path, start, frame FROM f WHERE rn = 1""")
def w04(v):
    return sg.snap(sg.crossing_index(v.frames), starts(v))


@query("w05_nudge", f"""WITH {Z}, {STARTS}, f AS (SELECT st.path, start, frame, row_number() OVER (PARTITION BY st.path ORDER BY frame) AS rn FROM st JOIN z ON st.path = z.path
 WHERE frame >= start + 1 AND frame - start - 1 <= 8192) SELECT path, start, max(frame) AS frame FROM f WHERE rn <= 2 GROUP BY 1, 2""")
def w05(v):
    return sg.nudge(sg.crossing_index(v.frames), starts(v), 2)


LISTS = "l AS (SELECT path, list(s ORDER BY frame) AS x FROM frames GROUP BY path)"


def lists(v):
    pairs = v.frames.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("frame", "s"))).alias("x"))  # a window function needs a signal whole
    return pairs.select("path", F.transform("x", lambda p: p["s"]).alias("x"))


@query("w07_resample", f"""WITH {LISTS}, i AS (SELECT path, x, CAST(unnest(range(20)) AS INT) AS i FROM l), p AS (SELECT path, x, i, CAST(i AS DOUBLE) * CAST(len(x) - 1 AS DOUBLE) / 19.0e0 AS pos FROM i)
 SELECT path, i, CAST(round(x[CAST(floor(pos) AS INT) + 1] + (x[least(CAST(floor(pos) AS INT) + 2, len(x))] - x[CAST(floor(pos) AS INT) + 1]) * (pos - floor(pos))) AS INT) AS v FROM p""")
def w07(v):
    return lists(v).select("path", F.posexplode(sg.resample(F.col("x"), 20)).alias("i", "v"))


@query("s14_decode_sample", "SELECT path, frame, round((s + 128 - 128) / 128e0, 9) AS b8, round(s / 32768e0, 9) AS b16, round(s / 8388608e0, 9) AS b24, round(s / 2147483648e0, 12) AS b32 FROM frames")
def s14(v):
    s = F.col("s").cast("double")
    return v.frames.select("path", "frame", F.round(sg.decode(s + 128, 8), 9).alias("b8"), F.round(sg.decode(s, 16), 9).alias("b16"), F.round(sg.decode(s, 24), 9).alias("b24"), F.round(sg.decode(s, 32), 12).alias("b32"))


@query("s16_sample_window", "SELECT path, frame, s FROM frames WHERE frame BETWEEN 10 AND 30")
def s16(v):
    return sg.window(v.frames, 20, 10)


@query("m02_trim_silence", """WITH l AS (SELECT path, min(frame) AS a, max(frame) AS b FROM frames WHERE abs(s / 128e0) > 0.5e0 GROUP BY path)
 SELECT f.path, frame - a AS frame, round(s / 128e0, 9) AS s FROM frames f JOIN l ON f.path = l.path WHERE frame BETWEEN a AND b""")
def m02(v):
    level = F.col("s") / 128.0
    return sg.trim_silence(v.frames.withColumn("s", level), -6.020599913279624).withColumn("s", F.round("s", 9))


@query("m03_fit_window", f"WITH {LISTS} SELECT path, CASE WHEN len(x) >= 30 THEN list_transform(x, lambda y: CAST(y AS DOUBLE))[(len(x) - 30) // 2 + 1:(len(x) - 30) // 2 + 30] ELSE list_concat(list_transform(x, lambda y: CAST(y AS DOUBLE)), list_transform(range(30 - len(x)), lambda y: 0e0)) END AS x FROM l")
def m03(v):
    return lists(v).select("path", sg.fit_window(F.transform("x", lambda y: y.cast("double")), 30).alias("x"))


@query("m04_normalise_peak", f"WITH {LISTS}, m AS (SELECT path, x, list_max(list_transform(x, lambda y: abs(y))) AS m FROM l) SELECT path, list_transform(x, lambda y: round(CASE WHEN m > 0 THEN CAST(y AS DOUBLE) * pow(10e0, -0.05e0) / m ELSE y END, 9)) AS x FROM m")
def m04(v):
    scaled = sg.normalise_peak(F.transform("x", lambda y: y.cast("double")))
    return lists(v).select("path", F.transform(scaled, lambda y: F.round(y, 9)).alias("x"))


def marks():
    return [F.col(f"m{i}") for i in (1, 2, 3)]


def reps():
    return [F.col(f"r{i}") for i in (1, 2, 3, 4)]


B = """b AS (SELECT *, CASE WHEN m1 = 4294967295 THEN 0 ELSE least(m1, total) END AS b1 FROM markers), c AS (SELECT *, CASE WHEN m2 = 4294967295 THEN b1 ELSE least(m2, total) END AS b2 FROM b),
d AS (SELECT *, CASE WHEN m3 = 4294967295 THEN b2 ELSE least(m3, total) END AS b3 FROM c),
seg AS (SELECT path, total, cursor, r1 + r2 + r3 + r4 = 0 AS silent, 0 AS slot, 0 AS a, b1 AS z, r1 AS rep FROM d UNION ALL SELECT path, total, cursor, r1 + r2 + r3 + r4 = 0, 1, b1, b2, r2 FROM d
 UNION ALL SELECT path, total, cursor, r1 + r2 + r3 + r4 = 0, 2, b2, b3, r3 FROM d UNION ALL SELECT path, total, cursor, r1 + r2 + r3 + r4 = 0, 3, b3, total, r4 FROM d)"""
PROGRAM = f"""{B}, play AS (SELECT path, slot, least(a, z) AS lo, least(greatest(a, z), total) AS hi, CASE WHEN rep = 15 THEN 255 ELSE rep END AS reps, a > z AS reversed FROM seg
 WHERE NOT silent AND rep > 0 AND least(a, z) < least(greatest(a, z), total) UNION ALL SELECT DISTINCT path, 0, 0, total, 1, FALSE FROM seg WHERE silent),
 pl AS (SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY slot) - 1 AS INT) AS slot, lo, hi, reps, reversed FROM play)"""


def parts(markers):
    return markers.withColumn("parts", mk.segments(marks(), reps(), F.col("total")))


def programs(markers):
    return parts(markers).select("path", mk.program(F.col("parts"), F.col("total")).alias("program"))


@query("c22_pack_reps", "SELECT path, r1 * 16 + r2 AS byte, r3 AS a, r4 AS b FROM markers")
def c22(v):
    two = mk.unpack_reps(mk.pack_reps(F.col("r3"), F.col("r4")))
    return v.markers.select("path", mk.pack_reps(F.col("r1"), F.col("r2")).alias("byte"), two[0].alias("a"), two[1].alias("b"))


PRESET = "SELECT path, CASE WHEN total >= 96000 THEN 'loop' ELSE 'shot' END AS kind, CASE WHEN total >= 96000 THEN total // 4 ELSE 0 END AS m1, CASE WHEN total >= 96000 THEN total * 2 // 4 ELSE 0 END AS m2, CASE WHEN total >= 96000 THEN total * 3 // 4 ELSE 0 END AS m3 FROM markers"


@query("c23_preset", PRESET)
@query("c25_default_preset", PRESET)
def c23(v):
    return v.markers.select("path", mk.preset(F.col("total")).alias("p")).select("path", "p.kind", "p.m1", "p.m2", "p.m3")


@query("c24_bank_predicates", "SELECT path, list_filter([m1, m2, m3], lambda m: m <> 4294967295) AS defined, len(list_filter([m1, m2, m3], lambda m: m <> 4294967295)) = 0 AS empty FROM markers")
def c24(v):
    return v.markers.select("path", mk.defined(*marks()).alias("defined"), mk.is_empty(*marks()).alias("empty"))


@query("c26_segments", f"WITH {B} SELECT path, slot, a AS start, z AS \"end\", rep, a > z AS reverse FROM seg")
def c26(v):
    return parts(v.markers).select("path", F.posexplode("parts").alias("slot", "s")).select("path", "slot", "s.*")


@query("c27_program", f"WITH {PROGRAM} SELECT path, slot, lo, hi, reps, reversed FROM pl WHERE lo < hi OR reps = 1")
@query("c28_normalised_segments", f"WITH {PROGRAM} SELECT path, slot, lo, hi, reps, reversed FROM pl WHERE lo < hi OR reps = 1")
def c27(v):
    return programs(v.markers).select("path", F.posexplode("program").alias("slot", "p")).select("path", "slot", "p.*")


@query("c29_segment_at", f"WITH {B} SELECT path, coalesce(min(CASE WHEN cursor >= least(a, z) AND cursor < greatest(a, z) THEN slot END), 3) AS slot FROM seg GROUP BY path")
def c29(v):
    return parts(v.markers).select("path", mk.segment_at(F.col("parts"), F.col("cursor")).alias("slot"))


@query("c30_gain_and_speed", """SELECT path, round(pow(10e0, greatest(-60e0, least(6e0, total / 1000e0 - 100)) / 20), 9) AS gain, round(greatest(0.5e0, least(2e0, pow(2e0, (total / 100e0 - 1500) / 1200))), 9) AS cents,
 CASE WHEN r1 > 0 THEN round(greatest(0.5e0, least(2e0, greatest(10e0, least(999.9e0, total / 1000e0)) / (r1 * 60))), 9) END AS tempo FROM markers""")
def c30(v):
    t = F.col("total").cast("double")
    return v.markers.select("path", F.round(mk.linear_gain(t / 1000 - 100), 9).alias("gain"), F.round(mk.cents_ratio((t / 100 - 1500)), 9).alias("cents"), F.round(mk.tempo_ratio(F.col("r1") * 60, t / 1000), 9).alias("tempo"))


@query("c31_view_column", "SELECT path, CASE WHEN total > 0 AND m2 >= 1000 AND m2 < 1000 + total THEN (m2 - 1000) * 120 // total END AS col FROM markers")
def c31(v):
    return v.markers.select("path", mk.view_column(F.col("m2"), F.lit(1000), F.col("total"), 120).alias("col"))


@query("c41_direction", f"WITH {B} SELECT path, slot, (a > z) <> (path % 2 = 0) AS backward FROM seg")
def c41(v):
    return parts(v.markers).select("path", F.posexplode("parts").alias("slot", "s")).select("path", "slot", (F.col("s.reverse") != (F.col("path") % 2 == 0)).alias("backward"))


@query("c42_fade_gain", "SELECT path, round(least(cursor % 100, least(64, total)) / 64e0, 9) AS out, round(1 - least(cursor % 100, least(64, total)) / 64e0, 9) AS rising FROM markers")
def c42(v):
    left = F.col("cursor") % 100
    return v.markers.select("path", F.round(mk.fade_gain(left, F.col("total"), False), 9).alias("out"), F.round(mk.fade_gain(left, F.col("total"), True), 9).alias("rising"))


@query("c43_program_frames", f"""WITH {PROGRAM}, t AS (SELECT *, unnest(range(1, CASE WHEN reps = 255 THEN 1 ELSE reps END + 1)) AS rep FROM pl WHERE lo < hi), s AS (SELECT *, unnest(range(hi - lo)) AS pos FROM t),
 f AS (SELECT path, slot, rep, pos, CASE WHEN reversed THEN hi - 1 - pos ELSE lo + pos END AS frame FROM s)
 SELECT path, slot, rep, min(pos) AS pos, max(CASE WHEN pos % 65536 = 0 THEN frame END) AS frame, count(*) AS n, min(frame) AS low, max(frame) AS high,
 CAST(sum(frame) AS BIGINT) AS frame_sum, CAST(sum(frame * (pos % 65536 + 1)) AS BIGINT) AS place_sum FROM f GROUP BY path, slot, rep, pos // 65536""")
def c43(v):
    return mk.program_blocks(programs(dealt(v.markers, 8192, "path")))  # a small file would be one task


@query("t12_nearest_marker", """SELECT path, arg_min(slot, d * 10 + slot) AS slot FROM (SELECT path, 1 AS slot, m1 AS m, abs(m1 - cursor) AS d FROM markers UNION ALL SELECT path, 2, m2, abs(m2 - cursor) FROM markers
 UNION ALL SELECT path, 3, m3, abs(m3 - cursor) FROM markers) WHERE m <> 4294967295 GROUP BY path UNION ALL SELECT path, NULL FROM markers WHERE m1 = 4294967295 AND m2 = 4294967295 AND m3 = 4294967295""")
def t12(v):
    return v.markers.select("path", mk.nearest_slot(marks(), F.col("cursor")).alias("slot"))


@query("k13_marker_rows", "SELECT path, 'A' AS bank, m1, m2, m3, r1, r2, r3, r4 FROM markers UNION ALL SELECT path, 'B', m3, m2, m1, r4, r3, r2, r1 FROM markers")
def k13(v):
    a = F.struct(F.lit("A").alias("bank"), *marks(), *reps())
    b = F.struct(F.lit("B").alias("bank"), *[F.col(x).alias(y) for x, y in zip("m3 m2 m1 r4 r3 r2 r1".split(), "m1 m2 m3 r1 r2 r3 r4".split())])
    return v.markers.select("path", F.explode(F.array(a, b)).alias("x")).select("path", "x.*")
