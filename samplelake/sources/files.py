"""Files behind any path that Arrow's file systems open: listing by tasks, and ranged reads."""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from ..cluster import shared, ship

#: Extensions of audio files.
EXTENSIONS = ("wav", "aif", "aiff", "mp3", "flac", "ogg")
ENTRY = "path string, folder boolean, size long, mtime long, error string"


def store_of(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system, the path in it, and the prefix that its own paths lack."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path, ""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/"), "file://"
    system, inside = fs.FileSystem.from_uri(path)
    return system, inside, path[: len(path) - len(inside)] if path.endswith(inside) else path.split("://")[0] + "://"


def opened(path: str) -> BinaryIO:
    """The file for reads at any place; nothing is read but what is asked for."""
    system, inside, _ = store_of(path)
    return system.open_input_file(inside)


def is_audio(name: str) -> bool:
    """The extension in small or in capital letters, as the walk takes it."""
    ending = name.rpartition(".")[2]
    return ending in EXTENSIONS or ending in {e.upper() for e in EXTENSIONS}


def entries(path: str) -> Iterator[tuple]:
    """What a folder holds: (path, folder, size, mtime, error); one that can't be read has
    one row with the error."""
    try:
        system, inside, prefix = store_of(path)
        for info in sorted(system.get_file_info(fs.FileSelector(inside)), key=lambda i: i.path):
            folder = info.type == fs.FileType.Directory
            if folder or info.type == fs.FileType.File and is_audio(info.base_name):
                yield prefix + info.path, folder, info.size or 0, int(info.mtime.timestamp()) if info.mtime else 0, None
    except OSError as raised:
        yield path, False, 0, 0, f"{type(raised).__name__}: {raised}"


def list_tree(spark: SparkSession, roots: list[str], folders_per_task: int = 64) -> DataFrame:
    """(path, size, mtime, error) of the audio files under ``roots``, folders at any depth.

    Each level's folders are dealt to tasks, which list them; the next level's are among
    the rows. Levels are written to the shared folder, so the driver knows the roots and
    each level's number of folders, and no path. Links to folders are followed as they are
    listed; a folder that can't be read is a row with an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("folder", pa.bool_()), ("size", pa.int64()), ("mtime", pa.int64()), ("error", pa.string())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = list(entries(path))
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 10_000]), schema.types)], schema=schema)

    ship(spark)
    # no root within another, so that two roots that contain each other list no file twice
    top = sorted({r.rstrip("/") or "/" for r in roots})
    top = [r for r in top if not any(r != o and r.startswith(o.rstrip("/") + "/") for o in top)]
    level, at, found = spark.createDataFrame([(r,) for r in top], "path string"), shared(spark, "listing"), []
    folders = len(top)
    while folders:
        path = f"{at}/{len(found)}"
        level.repartition(max(1, -(-folders // folders_per_task))).mapInArrow(run, ENTRY).write.parquet(path)
        found.append(path)
        level = spark.read.schema(ENTRY).parquet(path).filter("folder").select("path")
        folders = level.count()
    rows = spark.read.schema(ENTRY).parquet(*found) if found else spark.createDataFrame([], ENTRY)
    return rows.filter("NOT folder").select("path", "size", "mtime", "error")
