"""Samples of built files against numpy; listing, ranges, rates and errors."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from samplelake.functions.resampling import Resampler
from samplelake.operators import signal as sg
from samplelake.sources import files as fl
from samplelake.sources import frames as fr

from .test_wav import chunk, fmt, riff


def built(values, rate=48000, bits=16, tag=1):
    """A WAV of (n, channels) integers, or floats with tag 3."""
    values = np.asarray(values).reshape(len(values), -1)
    if tag == 3:
        raw = values.astype("<f4").tobytes()
    elif bits == 24:
        raw = b"".join(int(v).to_bytes(3, "little", signed=True) for v in values.ravel())
    else:
        raw = (values + (128 if bits == 8 else 0)).astype({8: "u1", 16: "<i2", 32: "<i4"}[bits]).tobytes()
    return riff(chunk(b"fmt ", fmt(tag, values.shape[1], rate, bits)), chunk(b"data", raw))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root, deal = tmp_path_factory.mktemp("audio"), np.random.default_rng(1)
    (root / "a" / "b").mkdir(parents=True)
    made = {"a/mono16.wav": (deal.integers(-(2**15), 2**15, (5000, 1)), 16, 1), "a/stereo24.WAV": (deal.integers(-(2**23), 2**23, (3001, 2)), 24, 1), "a/b/three8.wav": (deal.integers(-128, 128, (77, 3)), 8, 1),
            "float.wav": (deal.uniform(-1.2, 1.2, (600, 2)), 32, 3), "short.wav": (deal.integers(-9, 9, (10, 1)), 32, 1)}
    for name, (values, bits, tag) in made.items():
        (root / name).write_bytes(built(values, bits=bits, tag=tag))
    (root / "empty.wav").write_bytes(riff(chunk(b"fmt ", fmt()), chunk(b"data", b"")))
    (root / "cut.wav").write_bytes(built(deal.integers(-99, 99, (100, 1)))[:-40])
    (root / "bad.wav").write_bytes(b"RIFF")
    (root / "a" / "nodata.wav").write_bytes(riff(chunk(b"fmt ", fmt())))
    (root / "a" / "text.txt").write_bytes(b"no")
    (root / "a" / "b" / "other.mp3").write_bytes(b"\0")
    return root, made


def test_listing(spark, folder):
    root, made = folder
    found = {r.path.removeprefix(f"{root}/"): r for r in fl.list_tree(spark, [str(root), f"{root}/a"]).collect()}
    assert set(found) == {*made, "empty.wav", "cut.wav", "bad.wav", "a/nodata.wav", "a/b/other.mp3"}
    assert found["a/mono16.wav"].size == 10044 and found["bad.wav"].mtime == int((root / "bad.wav").stat().st_mtime)
    missing = fl.list_tree(spark, [f"{root}/none"]).collect()
    assert len(missing) == 1 and missing[0].error
    assert fl.list_tree(spark, []).count() == 0
    assert {r.path for r in fl.list_tree(spark, [f"file://{root}/a/b"]).collect()} == {f"file://{root}/a/b/three8.wav", f"file://{root}/a/b/other.mp3"}


@pytest.mark.parametrize("size", [64, 1 << 20])
def test_every_sample(spark, folder, size):
    """One file over several ranges has the same samples as over one."""
    root, made = folder
    frames = fr.frames_of(spark, [str(root)], range_frames=size)
    rows = {}
    for r in frames.collect():
        rows.setdefault(r.path.removeprefix(f"{root}/"), {})[r.frame, r.channel] = r.s, r.x
    for name, (values, bits, tag) in made.items():
        scaled = values.astype("f4").astype(float) if tag == 3 else values / 2 ** (bits - 1)
        assert len(rows[name]) == values.size
        for (i, c), (s, x) in rows[name].items():
            assert x == scaled[i, c]
            assert s == (int(np.clip(x, -1, 1) * 32767) if tag == 3 else int(np.floor(x * 32768)))
    assert len(rows["cut.wav"]) == 80 and "empty.wav" not in rows and "bad.wav" not in rows


def test_ranges_are_tasks_and_errors_rows(spark, folder):
    root, _ = folder
    listed = fl.list_tree(spark, [str(root)]).filter("path LIKE '%.wav'")
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in fr.shapes(listed).filter("error IS NOT NULL").collect()}
    assert set(errors) == {"bad.wav", "nodata.wav"}
    mix = {(r.path.rsplit("/", 1)[1], r.frame): r.x for r in fr.read_frames(listed, mix=True).collect()}
    assert mix["float.wav", 0] == pytest.approx(np.mean(folder[1]["float.wav"][0][0].astype("f4").astype(float)))
    spread = fr.read_frames(listed.filter("path LIKE '%mono16%'"), range_frames=500, each=1).select(F.spark_partition_id().alias("p")).distinct().count()
    assert spread > 1


def test_envelopes_of_files(spark, folder):
    """A07 and A10 over files are numpy's."""
    root, made = folder
    frames = fr.frames_of(spark, [str(root)], range_frames=256)
    one = frames.filter("path LIKE '%mono16.wav'").select("path", "frame", "s")
    x = made["a/mono16.wav"][0][:, 0].astype(float)
    place = np.minimum(np.floor(np.arange(5000) / (5000 / 180)), 179).astype(int)
    rms = np.array([np.sqrt(np.mean(x[place == b] ** 2)) for b in range(180)])
    want = np.floor(rms / rms.max() * 255 + 0.5).astype(int).tolist()
    assert [r.p for r in sg.rms_envelope(one).orderBy("bin").collect()] == want
    both = sg.stereo_envelope(frames.filter("path LIKE '%stereo24%'")).orderBy("bin").collect()
    y = np.floor(made["a/stereo24.WAV"][0] / 256)
    place = np.minimum(np.floor(np.arange(3001) / (3001 / 180)), 179).astype(int)
    sides = np.array([[np.sqrt(np.mean(y[place == b, c] ** 2)) for b in range(180)] for c in (0, 1)]).ravel()
    assert [r.p for r in both] == np.floor(sides / sides.max() * 255 + 0.5).astype(int).tolist()


@pytest.mark.parametrize("rate", [8000, 44100, 48000, 96000])
def test_tones_keep_their_level(rate):
    made = Resampler(rate, 48000)
    t = np.arange(rate // 2) / rate
    for tone in (100.0, 997.0, 0.85 * min(rate, 48000) / 2):
        out = made(np.sin(2 * np.pi * tone * t))
        assert len(out) == 24000
        want = np.sin(2 * np.pi * tone * np.arange(24000) / 48000)
        edge = 2 * made.reach * 48000 // rate + 2
        assert np.abs(out - want)[edge:-edge].max() < 1e-4


def test_tones_beyond_the_target_vanish():
    out = Resampler(96000, 48000)(np.sin(2 * np.pi * 30000 * np.arange(48000) / 96000))
    assert np.abs(out[200:-200]).max() < 1e-5


def test_resampled_ranges_meet_without_a_seam(spark, tmp_path):
    values = np.random.default_rng(2).integers(-20000, 20000, (4410, 2))
    (tmp_path / "x.wav").write_bytes(built(values, rate=44100))
    files = spark.createDataFrame([(str(tmp_path / "x.wav"),)], "path string")
    whole = Resampler(44100, 48000)((values / 32768).mean(1))
    for size in (333, 1 << 18):
        rows = sorted((r.frame, r.x) for r in fr.resample_frames(files, range_frames=size).collect())
        assert [i for i, _ in rows] == list(range(4800)) and np.allclose([x for _, x in rows], whole, atol=1e-12)


def test_prepared_signals(spark, folder, tmp_path):
    root, _ = folder
    t = np.arange(88200)
    loud = np.where((t > 20000) & (t < 60000), 12000 * np.sin(2 * np.pi * 441 * t / 44100), 0).astype(int)
    (tmp_path / "tone.wav").write_bytes(built(np.stack([loud, loud], 1), rate=44100))
    (tmp_path / "silent.wav").write_bytes(built(np.zeros((500, 1), int)))
    paths = [str(p) for p in (tmp_path / "tone.wav", tmp_path / "silent.wav", root / "bad.wav", root / "short.wav")]
    out = {r.path: r for r in fr.prepare_signals(spark.createDataFrame([(p,) for p in paths], "path string"), 24000).collect()}
    tone = np.array(out[paths[0]].signal)
    assert len(tone) == 24000 and np.abs(tone).max() == pytest.approx(10 ** (-1 / 20), rel=1e-6)
    spectrum = np.abs(np.fft.rfft(tone * np.hanning(len(tone))))
    assert abs(spectrum.argmax() * 48000 / 24000 - 441) < 3
    assert out[paths[1]].signal is None and out[paths[1]].error is None
    assert out[paths[2]].signal is None and "ValueError" in out[paths[2]].error


def aiff(values, rate=44100, bits=16, coding=None):
    values = np.asarray(values).reshape(len(values), -1)
    order = "little" if coding == b"sowt" else "big"
    raw = b"".join(int(v).to_bytes(bits // 8, order, signed=True) for v in values.ravel())
    exponent = rate.bit_length() - 1
    extended = struct.pack(">HQ", 16383 + exponent, rate << 63 - exponent)
    part = lambda name, body: name + struct.pack(">I", len(body)) + body + b"\0" * (len(body) % 2)
    comm = struct.pack(">hIh", values.shape[1], len(values), bits) + extended + (coding or b"")
    body = (b"AIFC" if coding else b"AIFF") + part(b"NAME", b"odd") + part(b"COMM", comm) + part(b"SSND", struct.pack(">II", 0, 0) + raw)
    return b"FORM" + struct.pack(">I", len(body)) + body


@pytest.mark.parametrize(("bits", "coding"), [(8, None), (16, None), (24, b"NONE"), (16, b"sowt"), (32, None)])
def test_aiff(spark, tmp_path, bits, coding):
    from samplelake.sources import wav

    values = np.random.default_rng(bits).integers(-(2 ** (bits - 1)), 2 ** (bits - 1), (333, 2))
    (tmp_path / "a.aif").write_bytes(aiff(values, 44100, bits, coding))
    (tmp_path / "b.aiff").write_bytes(b"FORM")
    (tmp_path / "c.aiff").write_bytes(aiff(values, 44100, bits, b"ulaw"))
    rows = {(r.frame, r.channel): r.x for r in fr.frames_of(spark, [str(tmp_path)], range_frames=100).collect()}
    assert rows == {(i, c): values[i, c] / 2 ** (bits - 1) for i in range(333) for c in (0, 1)}
    read = {r.path.rsplit("/", 1)[1]: r for r in wav.read_headers(fl.list_tree(spark, [str(tmp_path)])).collect()}
    assert (read["a.aif"].total_samples, read["a.aif"].sample_rate, read["a.aif"].bit_depth, read["a.aif"].channels, read["a.aif"].vendor) == (333, 44100, 16, 2, "")
    assert read["a.aif"].duration == pytest.approx(333 / 44100) and read["b.aiff"].error and "ulaw" in read["c.aiff"].error
