"""Writes into the block of WAV files, in place: one file, or the files of a table of changes."""

from __future__ import annotations

import fcntl
import json
import os
import struct
import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..cluster import shared, ship
from .files import store_of
from .wav import BLOCK, PACKED, PLAIN, decode_bext, scan_chunks

#: Fields that are written, and where; the others are shown only.
PLACES = {n: (a, b) for n, a, b in PLAIN + PACKED if n not in ("description", "take", "track", "item")} | {"umid": (348, 412)}
IN_PACKED = {n for n, _, _ in PACKED}
#: Both marker banks without markers.
NO_MARKERS = (b"\xff" * 12 + b"\0" * 4) * 2
JOURNAL = ".block~"


def local(path: str) -> str:
    """The path on a disk that is mounted here; in-place writes need one."""
    if "://" in path and not path.startswith("file:"):
        raise ValueError(f"{path} can't be written in place")
    return store_of(path)[1]


def _recover(path: str, f) -> None:  # noqa: ANN001
    """Carries out what a broken-off write had noted whole; a note cut short is dropped, as
    the file wasn't touched by then."""
    note = path + JOURNAL
    if not os.path.exists(note):
        return
    with open(note, "rb") as n:
        raw = n.read()
    if len(raw) > 12 and zlib.crc32(raw[4:]) == struct.unpack("<I", raw[:4])[0]:
        _put(f, struct.unpack("<Q", raw[4:12])[0], raw[12:])
    os.unlink(note)


def _put(f, at: int, block: bytes) -> None:  # noqa: ANN001
    """The id last: until then a file that wasn't packed doesn't count as packed."""
    for offset, part in ((8, block[8:]), (0, block[:8])):
        f.seek(at + offset)
        f.write(part)
        f.flush()
        os.fsync(f.fileno())


def edit(path: str, change: Callable[[bytearray], object], commit: bool = False) -> object:
    """Lets ``change`` edit a file's block (602 bytes, or what there is) and returns what it
    returns. The file's size stays. With ``commit`` the new block is noted beside the file,
    written, and the note removed, under a lock: a write that is broken off is completed by
    the next one, and two writers of a file wait for each other."""
    path = local(path)
    with open(path, "r+b" if commit else "rb") as f:
        if commit:
            fcntl.flock(f, fcntl.LOCK_EX)
            _recover(path, f)
        place = scan_chunks(f).bext
        if place is None:
            raise ValueError("the file has no block")
        f.seek(place[0])
        block = bytearray(f.read(min(place[1], BLOCK)))
        before = bytes(block)
        out = change(block)
        if len(block) != len(before):
            raise ValueError("the block's size can't change")
        if commit and bytes(block) != before:
            noted = struct.pack("<Q", place[0]) + bytes(block)
            with open(path + JOURNAL, "wb") as n:
                n.write(struct.pack("<I", zlib.crc32(noted)) + noted)
                n.flush()
                os.fsync(n.fileno())
            _put(f, place[0], bytes(block))
            os.unlink(path + JOURNAL)
    return out


def _set(block: bytearray, offset: int, raw: bytes) -> None:
    if offset + len(raw) > len(block):
        raise ValueError("no such place in the block")
    block[offset : offset + len(raw)] = raw


def write_field(path: str, offset: int, raw: bytes, commit: bool = False) -> bool:
    """Overwrites bytes of the block. Nothing without ``commit``."""
    edit(path, lambda block: _set(block, offset, raw), commit)
    return commit


def fixed(text: str, width: int) -> bytes:
    """ASCII with question marks for other characters, cut and zero-padded."""
    return text.encode("ascii", "replace")[:width].ljust(width, b"\0")


def _markers(block: bytearray, markers: bytes) -> None:
    if not decode_bext(bytes(block))["packed"]:
        raise ValueError("the file isn't packed")
    _set(block, 12, markers)
    _set(block, 10, struct.pack("<H", 2))


def write_markers(path: str, markers: bytes, commit: bool = False) -> bool:
    """Both banks (32 bytes) into a packed file, whose minor version becomes 2."""
    edit(path, lambda block: _markers(block, markers), commit)
    return commit


def _pack(block: bytearray, markers: bytes = NO_MARKERS) -> int:
    """Versions, markers, block version and a new id, unless the block has all of it."""
    if decode_bext(bytes(block))["packed"]:
        return int.from_bytes(block[:8], "big")
    file_id = (time.time_ns() // 1_000_000 << 16 | 0x7000 | uuid.uuid4().int & 0x0FFF) & (1 << 64) - 1
    for offset, raw in ((0, file_id.to_bytes(8, "big")), (8, struct.pack("<HH", 1, 2)), (12, markers), (346, struct.pack("<H", 2))):
        _set(block, offset, raw)
    return file_id


def init_packed(path: str, markers: bytes = NO_MARKERS, commit: bool = False) -> int:
    """Makes a block packed and returns its id; a packed one keeps what it has."""
    return edit(path, lambda block: _pack(block, markers), commit)


def _apply(block: bytearray, changes: list[tuple[str, str]], force: bool) -> list[str]:
    wanted = [(n, new) for n, new in changes if n in PLACES or n in ("markers", "packed")]
    packed = decode_bext(bytes(block))["packed"]
    new = bytearray(block)
    if any(n in IN_PACKED or n == "packed" for n, _ in wanted):
        _pack(new)
    for name, value in wanted:
        if name == "markers":
            _markers(new, bytes.fromhex(value))
        elif name != "packed":
            a, b = PLACES[name]
            _set(new, a, fixed("" if value == "—" else value, b - a))
    # a repeated attempt finds its own work done
    if new != block and packed and not force:
        raise PermissionError("the file is packed already")
    block[:] = new
    return [n for n, _ in wanted]


def write_changes(path: str, changes: list[tuple[str, str, str]], force: bool = False, commit: bool = False) -> list[str]:
    """Writes a diff's fields that have a fixed place; returns their names. A packed file is
    refused unless ``force``, or if it has the values. Description, take, track and item are
    shown, never written."""
    return edit(path, lambda block: _apply(block, [(n, new) for n, _, new in changes], force), commit)


@dataclass
class Written(WriterCommitMessage):
    part: str = ""
    files: int = 0
    errors: int = 0


class FieldWriter(DataSourceWriter):
    """Rows (path, field, value), each path's one after another, to the files' blocks. A file
    that can't be written is a line of the report and no failure of the task."""

    def __init__(self, options: dict[str, str]) -> None:
        self.report = options["report"]
        self.force = options.get("force", "false").lower() == "true"
        self.commit_writes = options.get("commit", "false").lower() == "true"

    def write(self, iterator: Iterator) -> Written:
        system, folder, _ = store_of(self.report)
        system.create_dir(folder, recursive=True)
        message = Written(part=f"part-{uuid.uuid4().hex}.json")
        with system.open_output_stream(f"{folder}/{message.part}") as out:
            for path, rows in groupby(iterator, key=lambda r: r[0]):
                done, error = [], None
                try:
                    done = edit(path, lambda block, rows=rows: _apply(block, [(r[1], r[2]) for r in rows], self.force), self.commit_writes)
                    message.files += 1
                except (OSError, ValueError, struct.error) as raised:
                    error = f"{type(raised).__name__}: {raised}"
                    message.errors += 1
                out.write((json.dumps({"path": path, "fields": done, "error": error}) + "\n").encode())
        return message

    def commit(self, messages: list) -> None:
        """Names the parts that count: those of attempts that were lost don't."""
        system, folder, _ = store_of(self.report)
        system.create_dir(folder, recursive=True)
        parts = [m for m in messages if m is not None]
        with system.open_output_stream(f"{folder}/_committed") as out:
            out.write(json.dumps({"parts": [m.part for m in parts], "files": sum(m.files for m in parts), "errors": sum(m.errors for m in parts)}).encode())

    def abort(self, messages: list) -> None:
        """Files that were written stay so: each is whole, and a new run finds it done."""


class FieldSink(DataSource):
    """``df.write.format("wavfields")``; see :func:`write_fields`."""

    @classmethod
    def name(cls) -> str:
        return "wavfields"

    def schema(self) -> str:
        return "path string, field string, value string"

    def writer(self, schema, overwrite: bool) -> FieldWriter:  # noqa: ANN001
        return FieldWriter(self.options)


def write_fields(changes: DataFrame, force: bool = False, commit: bool = False, tasks: int | None = None) -> DataFrame:
    """Writes changes (path, field, value) into the files' blocks, on machines that mount
    them, and returns the report (path, fields, error).

    A path's changes go to one task and into its file as one write of the block. Fields are
    those of :data:`PLACES`, ``markers`` (both banks in hexadecimal) and ``packed`` (any
    value). Without ``commit`` the report says what would be written. Runs and attempts can
    be repeated: what is written is found done.
    """
    spark: SparkSession = changes.sparkSession
    ship(spark)
    spark.dataSource.register(FieldSink)
    report = shared(spark, "writes")
    rows = changes.select("path", "field", "value").filter("path IS NOT NULL AND field IS NOT NULL AND value IS NOT NULL")
    dealt = rows.repartition(tasks, "path") if tasks else rows.repartition("path")
    options = {"report": report, "force": str(force), "commit": str(commit)}
    dealt.sortWithinPartitions("path", "field", "value").write.format("wavfields").mode("append").options(**options).save()
    system, folder, _ = store_of(report)
    with system.open_input_stream(f"{folder}/_committed") as f:
        parts = json.loads(f.read())["parts"]
    schema = "path string, fields array<string>, error string"
    return spark.read.schema(schema).json([f"{report}/{p}" for p in parts]) if parts else spark.createDataFrame([], schema)


def changed_fields(diffs: DataFrame) -> DataFrame:
    """(path, field, value) of a workflow's diffs (path, diff), as :func:`write_fields` takes
    them."""
    return diffs.select("path", F.explode("diff").alias("d")).select("path", "d.field", F.col("d.new").alias("value"))
