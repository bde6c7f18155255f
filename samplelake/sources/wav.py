"""Headers of RIFF/WAVE files: chunks, fields, audio facts and samples."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..cluster import dealt, ship
from .files import EXTENSIONS, entries, opened

#: Chunk limits and sizes of the format.
HEADER, BLOCK, LONGEST_INFO = 4096, 602, 4096
#: Fixed values: (field, begin, end) of the plain and of the packed block.
PLAIN = (("description", 0, 256), ("vendor", 256, 288), ("library", 288, 320), ("date", 320, 330))
PACKED = (
    ("comment", 44, 76), ("rating", 76, 80), ("bpm", 80, 84), ("subcategory", 84, 88), ("category", 88, 92), ("genre_id", 92, 96), ("sound_id", 96, 100),
    ("usage_id", 100, 104), ("key", 104, 112), ("take", 112, 116), ("track", 116, 120), ("item", 120, 128),
)
#: INFO chunks and ID3 frames that fill empty fields.
INFO = {b"IART": "vendor", b"INAM": "library", b"IGNR": "category", b"IKEY": "sound_id", b"ICMT": "description"}
ID3 = {
    "TPE1": "vendor", "TPE2": "library", "TALB": "library", "COMM": "description", "TCON": "category", "TIT2": "sound_id", "TCOM": "subcategory",
    "TIT1": "genre_id", "TIT3": "usage_id", "TKEY": "key", "TRCK": "track", "TDRC": "date",
}


def ascii_field(raw: bytes) -> str:
    """Lossy UTF-8, without NULs and then white space at the end."""
    return raw.decode("utf-8", "replace").rstrip("\0").rstrip()


def umid_field(raw: bytes) -> str:
    """Nothing if all zero; text if it is printable; else hexadecimal without zeros at the end."""
    if not raw.strip(b"\0"):
        return ""
    text = raw.rstrip(b"\0")
    if all(32 <= b < 127 for b in text):
        return text.decode("ascii").rstrip()
    return text.hex()


def bpm_field(text: str) -> int | None:
    text = text.rstrip()
    digits = text[1:] if text.startswith("+") else text
    return int(digits) if digits.isascii() and digits.isdigit() and int(digits) <= 65535 else None


@dataclass
class Chunks:
    """Places and sizes of the chunks that matter; None for those that are missing."""

    bext: tuple[int, int] | None = None
    info: tuple[int, int] | None = None
    fmt: tuple[int, int] | None = None
    data: tuple[int, int] | None = None
    id3: tuple[int, int] | None = None


def scan_chunks(f: BinaryIO) -> Chunks:
    """Walks the chunks up to the RIFF size. The first fmt and data count, of bext and INFO
    the last that begins within the header; odd sizes are padded."""
    f.seek(0)
    head = f.read(12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    end, at, found = 8 + struct.unpack("<I", head[4:8])[0], 12, Chunks()
    while at + 8 <= end:
        f.seek(at)
        raw = f.read(12)
        if len(raw) < 8:
            break
        name, size = raw[:4], struct.unpack("<I", raw[4:8])[0]
        place = (at + 8, size)
        if name == b"bext" and at < HEADER:
            found.bext = place
        elif name == b"LIST" and raw[8:12] == b"INFO" and at < HEADER:
            found.info = place
        elif name == b"fmt " and found.fmt is None:
            found.fmt = place
        elif name == b"data" and found.data is None:
            found.data = place
        elif name.lower() == b"id3 ":
            found.id3 = place
        at += 8 + size + size % 2
    return found


def decode_bext(raw: bytes) -> dict:
    """The block's fields; with fewer than 602 bytes ValueError."""
    if len(raw) < BLOCK:
        raise ValueError("the block is too short")
    file_id = int.from_bytes(raw[0:8], "big")
    major, minor = struct.unpack("<HH", raw[8:12])
    version = struct.unpack("<H", raw[346:348])[0]
    packed = major == 1 and minor >= 1 and version >= 2 and file_id != 0
    out = {name: ascii_field(raw[a:b]) for name, a, b in PLAIN}
    out |= dict.fromkeys((n for n, _, _ in PACKED), "") | {"bpm": None, "file_id": 0, "markers": None}
    if packed:
        out |= {name: ascii_field(raw[a:b]) for name, a, b in PACKED}
        out |= {"bpm": bpm_field(out["bpm"]), "description": out["comment"], "file_id": file_id, "markers": raw[12:44]}
    out["umid"] = umid_field(raw[348:412]) if version >= 1 else ""
    peaks = raw[422:602]
    out["peaks"] = list(peaks) if any(peaks) else None
    out["peaks_source"] = "none" if not any(peaks) else "packed_u8" if packed else "bwf_reserved"
    out["packed"] = packed
    return out


def decode_info(raw: bytes) -> dict[str, str]:
    """Sub-chunks of an INFO list; values of 1 to 4096 bytes count."""
    out, at = {}, 4
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack("<I", raw[at + 4 : at + 8])[0]
        if name in INFO:
            out[INFO[name]] = ascii_field(raw[at + 8 : at + 8 + size]) if 1 <= size <= LONGEST_INFO else ""
        at += 8 + size + size % 2
    return out


def decode_id3(raw: bytes) -> dict[str, str]:
    """Text frames of an ID3v2.3 or 2.4 tag, trimmed on both sides."""
    out: dict[str, str] = {}
    if raw[:3] != b"ID3" or len(raw) < 10:
        return out
    version, at = raw[3], 10
    end = min(len(raw), 10 + (raw[6] << 21 | raw[7] << 14 | raw[8] << 7 | raw[9]))
    while at + 10 <= end and raw[at : at + 1].isalnum():
        name, size = raw[at : at + 4].decode("latin-1"), int.from_bytes(raw[at + 4 : at + 8], "big")
        if version == 4:
            size = raw[at + 4] << 21 | raw[at + 5] << 14 | raw[at + 6] << 7 | raw[at + 7]
        body = raw[at + 10 : at + 10 + size]
        if body and (name in ID3 or name == "TBPM"):
            kind = ("latin-1", "utf-16", "utf-16-be", "utf-8")[min(body[0], 3)]
            text = body[1:].decode(kind, "replace")
            if name == "COMM":
                text = body[4:].decode(kind, "replace").split("\0", 1)[-1]
            target = "bpm" if name == "TBPM" else ID3[name]
            if text.strip("\0 \t\r\n") and not out.get(target):
                out[target] = text.strip("\0 \t\r\n")
        at += 10 + size
    return out


def merge(first: dict, *others: dict) -> dict:
    """Later sources fill only what is empty."""
    out = dict(first)
    for other in others:
        for name, value in other.items():
            if value and not out.get(name):
                out[name] = bpm_field(value) if name == "bpm" and isinstance(value, str) else value
    return out


def decode_fmt(raw: bytes) -> dict:
    if len(raw) < 16:
        raise ValueError("the fmt chunk is too short")
    tag, channels, rate, _, align, bits = struct.unpack("<HHIIHH", raw[:16])
    return {"kind": {1: "pcm", 3: "float"}.get(tag, "other"), "channels": channels, "sample_rate": rate, "block_align": align, "bit_depth": bits}


def audio_info(fmt: dict, data_size: int) -> dict:
    total = data_size // fmt["block_align"] if fmt["block_align"] else 0
    return {"total_samples": total, "duration": total / fmt["sample_rate"] if fmt["sample_rate"] else 0.0, **{k: fmt[k] for k in ("sample_rate", "bit_depth", "channels")}}


def samples(raw: bytes, fmt: dict) -> np.ndarray:
    """Frames by channels in -1 to 1; unknown formats are silent."""
    n, bits = fmt["channels"], fmt["bit_depth"]
    width = bits // 8
    raw = raw[: len(raw) // (n * width) * n * width] if width and n else b""
    if fmt["kind"] in ("pcm-be", "pcm-le") and width:
        parts = np.frombuffer(raw, "u1").reshape(-1, width)
        raw = (parts[:, ::-1] if fmt["kind"] == "pcm-be" else parts).tobytes()
        if bits == 8:
            return (np.frombuffer(raw, "i1") / 128).reshape(-1, n)
        return samples(raw, fmt | {"kind": "pcm"})
    if fmt["kind"] == "float" and bits == 32:
        x = np.frombuffer(raw, "<f4").astype(float)
    elif fmt["kind"] == "pcm" and bits == 8:
        x = (np.frombuffer(raw, "u1").astype(float) - 128) / 128
    elif fmt["kind"] == "pcm" and bits == 16:
        x = np.frombuffer(raw, "<i2") / 32768
    elif fmt["kind"] == "pcm" and bits == 24:
        b = np.frombuffer(raw, "u1").reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 8388608
    elif fmt["kind"] == "pcm" and bits == 32:
        x = np.frombuffer(raw, "<i4") / 2147483648
    else:
        x = np.zeros(len(raw) // max(1, width))
    return x.reshape(-1, n) if n else x.reshape(0, 1)


def pcm16(raw: bytes, fmt: dict) -> np.ndarray:
    """The left channel as 16-bit integers."""
    left = samples(raw, fmt)[:, 0]
    if fmt["kind"] == "float":
        return np.trunc(np.clip(left, -1, 1) * 32767).astype(np.int16)
    return np.floor(left * 32768).astype(np.int16)


def channel(frames: np.ndarray, mode: str) -> np.ndarray:
    """``left`` is channel 0, ``mix`` the mean of all."""
    return frames[:, 0] if mode == "left" else frames.mean(1)


def scan_aiff(f: BinaryIO) -> dict:
    """Sample format and place of an AIFF or uncompressed AIFF-C file: big-endian integers,
    of 8 bits signed ones too."""
    f.seek(0)
    head = f.read(12)
    if len(head) < 12 or head[:4] != b"FORM" or head[8:] not in (b"AIFF", b"AIFC"):
        raise ValueError("not an AIFF file")
    end, at, out = 8 + struct.unpack(">I", head[4:8])[0], 12, {}
    while at + 8 <= end:
        f.seek(at)
        raw = f.read(8)
        if len(raw) < 8:
            break
        name, size = raw[:4], struct.unpack(">I", raw[4:])[0]
        if name == b"COMM":
            body = f.read(min(size, 22))
            channels, frames, bits, exponent, mantissa = struct.unpack(">hIhHQ", body[:18])
            coding = body[18:22] if head[8:] == b"AIFC" else b"NONE"
            kind = {b"NONE": "pcm-be", b"twos": "pcm-be", b"sowt": "pcm-le"}.get(coding)
            if kind is None:
                raise ValueError(f"AIFF-C coding {coding!r} isn't decoded")
            rate = round(mantissa * 2.0 ** ((exponent & 0x7FFF) - 16446)) if exponent else 0
            out |= {"kind": kind, "channels": channels, "sample_rate": rate, "block_align": (bits + 7) // 8 * channels, "bit_depth": (bits + 7) // 8 * 8, "frames": frames}
        elif name == b"SSND":
            skip = struct.unpack(">I", f.read(4))[0]
            out |= {"begin": at + 16 + skip, "size": size - 8 - skip}
        at += 8 + size + size % 2
    if "begin" not in out or "frames" not in out or out["block_align"] <= 0:
        raise ValueError("no COMM or no SSND chunk")
    return out


def read_metadata(f: BinaryIO, id3: bool = False) -> dict:
    """All fields of a file's header; INFO fills what bext leaves empty, then ID3 if asked."""
    found = scan_chunks(f)

    def chunk(place: tuple[int, int] | None, most: int) -> bytes:
        if place is None:
            return b""
        f.seek(place[0])
        return f.read(min(place[1], most))

    empty = dict.fromkeys([n for n, _, _ in PLAIN + PACKED] + ["umid"], "") | {"bpm": None, "file_id": 0, "markers": None, "peaks": None, "peaks_source": "none", "packed": False}
    own = empty
    if found.bext:
        raw = chunk(found.bext, BLOCK)
        own = empty | decode_bext(raw)
    out = merge(own, decode_info(chunk(found.info, 1 << 20)), decode_id3(chunk(found.id3, 1 << 20)) if id3 else {})
    if found.fmt and found.data:
        out |= audio_info(decode_fmt(chunk(found.fmt, 40)), found.data[1])
    return out


GLOB = "*.{" + ",".join(x for e in EXTENSIONS for x in (e, e.upper())) + "}"
COLUMNS = [n for n, _, _ in PLAIN + PACKED if n != "bpm"]
SCHEMA = (
    "path string, " + ", ".join(f"{n} string" for n in COLUMNS) + ", umid string, bpm int, file_id long, peaks array<smallint>, peaks_source string, "
    "duration double, sample_rate int, bit_depth int, channels int, total_samples long, error string"
)


def _row(path: str, meta: dict, error: str | None = None) -> tuple:
    number = meta.get("file_id") or 0
    return (
        path, *[meta.get(n, "") for n in COLUMNS], meta.get("umid", ""), meta.get("bpm"), number - (1 << 64) if number >= 1 << 63 else number, meta.get("peaks"),
        meta.get("peaks_source", "none"), meta.get("duration"), meta.get("sample_rate"), meta.get("bit_depth"), meta.get("channels"), meta.get("total_samples"), error,
    )


def header_row(path: str, open_file: Callable[[], BinaryIO], id3: bool) -> tuple:
    """A file's fields, or what is wrong with it. Of files other than RIFF, AIFF ones have
    their audio facts, as of 16 bits; the others have a path only."""
    kind = path.lower().rpartition(".")[2]
    if kind not in ("wav", "aif", "aiff"):
        return _row(path, {})
    try:
        with open_file() as f:
            if kind == "wav":
                return _row(path, read_metadata(f, id3))
            found = scan_aiff(f)
            seconds = found["frames"] / found["sample_rate"] if found["sample_rate"] else 0.0
            return _row(path, {"total_samples": found["frames"], "duration": seconds, "sample_rate": found["sample_rate"], "bit_depth": 16, "channels": found["channels"]})
    except (OSError, ValueError, struct.error) as raised:
        return _row(path, {}, f"{type(raised).__name__}: {raised}")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<smallint>": pa.list_(pa.int16())}
    fields = [f.split() for f in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


@dataclass
class Folders(InputPartition):
    paths: list[str] = field(default_factory=list)
    deep: bool = True


class WavReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.roots = [r for r in options.get("path", "").split(",") if r]
        self.id3 = options.get("id3", "false").lower() == "true"

    def partitions(self) -> list[Folders]:
        """The roots' own files, and each folder right under a root: tasks walk on from there."""
        found = [Folders([r], deep=False) for r in self.roots]
        return found + [Folders([path]) for r in self.roots for path, folder, *_ in entries(r) if folder] or [Folders([])]

    def read(self, partition: Folders) -> Iterator[tuple]:
        """Header bytes only; a file or folder that can't be read is a row with an error."""
        folders = list(partition.paths)
        while folders:
            for path, folder, _, _, error in entries(folders.pop()):
                if folder:
                    folders += [path] if partition.deep else []
                else:
                    yield _row(path, {}, error) if error else header_row(path, lambda path=path: opened(path), self.id3)


class WavSource(DataSource):
    """``spark.read.format("wavmeta").load(folder)`` for folders that every machine mounts.
    Its tasks are the folders under the roots; :func:`read_headers` balances files."""

    @classmethod
    def name(cls) -> str:
        return "wavmeta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WavReader:  # noqa: ANN001
        return WavReader(self.options)


def read_headers(files: DataFrame, id3: bool = False, each: int = 500) -> DataFrame:
    """The fields of files (path), ``each`` of them a task, which reads their headers only;
    a file that can't be read is a row with an error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if rows := [header_row(path, lambda path=path: opened(path), id3) for path in batch.column(0).to_pylist()]:
                yield _batch(rows)

    ship(files.sparkSession)
    return dealt(files.select("path"), each).mapInArrow(run, SCHEMA)


def read_files(spark: SparkSession, path: str, id3: bool = False) -> DataFrame:
    """The same rows through Spark's file reader, for stores that only Spark reads. It reads
    whole files, so use :func:`read_headers` where Arrow opens the store."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", GLOB).load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield _batch([header_row(name, lambda raw=raw: io.BytesIO(raw.as_py()), id3)])

    ship(spark)
    return files.mapInArrow(run, SCHEMA)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, mtime) of the audio files under ``path``; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", GLOB).load(path)
    return files.select("path", F.unix_timestamp("modificationTime").alias("mtime"))
