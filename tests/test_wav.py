"""WAV bytes are made here; see the byte map in the source module."""

import io
import struct

import numpy as np
import pytest

from samplelake.sources import wav
from samplelake.sources.files import list_tree


def block(packed=True, version=2, **fields):
    raw = bytearray(wav.BLOCK)
    if packed:
        raw[0:8] = (0x01937BEEFCAFE701).to_bytes(8, "big")
        raw[8:12] = struct.pack("<HH", 1, 2)
    raw[346:348] = struct.pack("<H", version)
    for name, a, b in wav.PLAIN + (wav.PACKED if packed else ()):
        if name in fields and not (packed and name == "description"):
            raw[a:b] = fields[name].encode()[: b - a].ljust(b - a, b"\0")
    return bytes(raw)


def chunk(name, body):
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def fmt(tag=1, channels=1, rate=48000, bits=16):
    return struct.pack("<HHIIHH", tag, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)


def riff(*chunks):
    body = b"WAVE" + b"".join(chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def info(**values):
    return chunk(b"LIST", b"INFO" + b"".join(chunk(k.encode(), v) for k, v in values.items()))


def sample(**fields):
    return riff(chunk(b"bext", block(**fields)), chunk(b"fmt ", fmt()), chunk(b"data", b"\0" * 96000))


def test_packed_block():
    got = wav.read_metadata(io.BytesIO(sample(comment="test marker file", rating="****", bpm="120", category="TEST", sound_id="MRK1", vendor="TestVendor", date="2026-02-16")))
    assert got["packed"] and got["bpm"] == 120 and got["description"] == got["comment"] == "test marker file"
    assert (got["vendor"], got["category"], got["sound_id"], got["date"], got["rating"]) == ("TestVendor", "TEST", "MRK1", "2026-02-16", "****")
    assert got["total_samples"] == 48000 and got["duration"] == 1.0 and got["file_id"] == 0x01937BEEFCAFE701


@pytest.mark.parametrize("change", [(0, b"\0" * 8), (8, b"\2"), (10, b"\0"), (346, b"\1")])
def test_not_packed(change):
    raw = bytearray(block(comment="x"))
    raw[change[0] : change[0] + len(change[1])] = change[1]
    assert not wav.decode_bext(bytes(raw))["packed"]


def test_info_fills_only_what_is_empty():
    raw = riff(chunk(b"bext", block(False, vendor="own")), info(IART=b"other", IKEY=b"key\0", ICMT=b""), chunk(b"fmt ", fmt()), chunk(b"data", b""))
    got = wav.read_metadata(io.BytesIO(raw))
    assert got["vendor"] == "own" and got["sound_id"] == "key" and got["description"] == "" and got["duration"] == 0


def test_chunks_behind_the_header_and_odd_sizes():
    late = riff(chunk(b"junk", b"\0" * 5001), chunk(b"bext", block()), chunk(b"fmt ", fmt()), chunk(b"data", b"\0" * 4))
    found = wav.scan_chunks(io.BytesIO(late))
    assert found.bext is None and found.fmt and found.data[1] == 4


@pytest.mark.parametrize("raw", [b"", b"text", b"RIFF\0\0\0\0NOPE", b"RIFF"])
def test_other_files(raw):
    with pytest.raises(ValueError):
        wav.scan_chunks(io.BytesIO(raw))


def test_short_block():
    with pytest.raises(ValueError):
        wav.decode_bext(b"\0" * 601)


def test_scalar_fields():
    assert wav.umid_field(b"\0" * 64) == "" and wav.umid_field(b"abc\0") == "abc" and wav.umid_field(b"\x01\xff\0\0") == "01ff"
    assert [wav.bpm_field(x) for x in ("120 ", "+7", " 9", "65536", "x", "")] == [120, 7, None, None, None, None]
    assert wav.ascii_field(b" a \0\0") == " a"


def test_id3():
    frame = lambda name, body: name + struct.pack(">I", len(body)) + b"\0\0" + body
    body = frame(b"TPE1", b"\3 Artist ") + frame(b"COMM", b"\0eng\0Words") + frame(b"TBPM", b"\x00128")
    tag = b"ID3\3\0\0" + bytes([0, 0, len(body) >> 7, len(body) & 127]) + body
    got = wav.decode_id3(tag)
    assert got == {"vendor": "Artist", "description": "Words", "bpm": "128"}
    assert wav.merge({"vendor": "", "bpm": None}, got)["bpm"] == 128


@pytest.mark.parametrize(("bits", "raw", "value"), [(8, b"\xc0", 0.5), (16, struct.pack("<h", -16384), -0.5), (24, b"\0\0\x40", 0.5), (32, struct.pack("<i", 1 << 30), 0.5)])
def test_samples(bits, raw, value):
    shape = wav.decode_fmt(fmt(bits=bits))
    assert wav.samples(raw, shape)[0, 0] == value
    assert wav.pcm16(raw, shape)[0] == int(value * 32768)


def test_float_and_channels():
    shape = wav.decode_fmt(fmt(3, 2, bits=32))
    raw = np.array([0.5, 0.25, 2.0, 0.0], "<f4").tobytes()
    assert wav.pcm16(raw, shape).tolist() == [16383, 32767]
    assert wav.channel(wav.samples(raw, shape), "mix").tolist() == [0.375, 1.0]


def test_sources_agree(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.wav").write_bytes(sample(vendor="V", bpm="99"))
    (tmp_path / "sub" / "b.WAV").write_bytes(sample(vendor="W"))
    (tmp_path / "bad.wav").write_bytes(b"RIFF")
    (tmp_path / "c.mp3").write_bytes(b"\0")
    (tmp_path / "d.txt").write_bytes(b"\0")
    spark.dataSource.register(wav.WavSource)
    name = lambda r: r.path.rsplit("/", 1)[1]
    rows = {name(r): (r.vendor, r.bpm, r.duration, r.error and r.error.split(":")[0]) for r in spark.read.format("wavmeta").load(str(tmp_path)).collect()}
    assert rows == {"a.wav": ("V", 99, 1.0, None), "b.WAV": ("W", None, 1.0, None), "c.mp3": ("", None, None, None), "bad.wav": ("", None, None, "ValueError")}
    for other in (wav.read_files(spark, str(tmp_path)), wav.read_headers(list_tree(spark, [str(tmp_path)]), each=2)):
        assert {name(r): (r.vendor, r.bpm, r.duration, r.error and r.error.split(":")[0]) for r in other.collect()} == rows
    assert wav.list_files(spark, str(tmp_path)).count() == 4
