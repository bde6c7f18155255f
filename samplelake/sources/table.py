"""A committed table: Parquet in buckets by key, and a manifest for each version."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..cluster import file_system, remove

BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was to become."""


@dataclass(frozen=True)
class Version:
    """What a manifest says: where each bucket's files are, and of which schema."""

    number: int
    buckets: int
    keys: tuple[str, ...]
    schema: StructType
    #: bucket -> folder under data/, for those that have rows
    places: dict[int, str]
    #: values of the writer's own, as the codebook that codes belong to
    notes: dict[str, str]


class Table:
    """Rows in buckets by the hash of their keys.

    A change rewrites the buckets it touches into a new folder and then names a manifest
    that has the new folders beside the old ones. The manifest's name is taken by one writer
    only and it comes last, so a reader sees a version whole or not at all; a run that stops
    midway leaves files that no manifest has, which :meth:`vacuum` deletes. A reader keeps
    the version it began with.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # versions

    def numbers(self) -> list[int]:
        system, where = file_system(self.spark, f"{self.root}/versions")
        if not system.exists(where):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in system.listStatus(where) if s.getPath().getName().endswith(".json"))

    def exists(self) -> bool:
        return bool(self.numbers())

    def version(self, number: int | None = None) -> Version:
        """The version of that number, or the last one."""
        known = self.numbers()
        if not known or number is not None and number not in known:
            raise ValueError(f"{self.root} has no version {'' if number is None else number}")
        system, where = file_system(self.spark, f"{self.root}/versions/{known[-1] if number is None else number:010d}.json")
        stream = system.open(where)
        try:
            said = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        places = {int(k): v for k, v in said["places"].items()}
        return Version(said["number"], said["buckets"], tuple(said["keys"]), StructType.fromJson(said["schema"]), places, said["notes"])

    def _commit(self, new: Version) -> Version:
        said = {"number": new.number, "buckets": new.buckets, "keys": new.keys, "schema": new.schema.jsonValue(), "places": new.places, "notes": new.notes}
        system, draft = file_system(self.spark, f"{self.root}/versions/.draft-{uuid.uuid4().hex}")
        out = system.create(draft, False)
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        _, final = file_system(self.spark, f"{self.root}/versions/{new.number:010d}.json")
        try:
            take_name(self.spark, draft, final)
        finally:
            if system.exists(draft):
                system.delete(draft, False)
        return new

    # reads

    def read(self, version: Version | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets; other files aren't opened."""
        version = version or self.version()
        wanted = version.places if buckets is None else {b: version.places[b] for b in buckets if b in version.places}
        if not wanted:
            return self.spark.createDataFrame([], version.schema)
        return self.spark.read.schema(version.schema).parquet(*(f"{self.root}/data/{place}" for place in wanted.values()))

    def buckets_of(self, rows: DataFrame, version: Version) -> list[int]:
        """The buckets that rows belong to: a number for each bucket at most."""
        return sorted(r[0] for r in rows.select(bucket(version.keys, version.buckets).alias(BUCKET)).distinct().collect())

    # writes

    def _write(self, rows: DataFrame, keys: tuple[str, ...], buckets: int, spread: int) -> dict[int, str]:
        """Writes rows into a new folder; bucket -> place. ``spread`` tasks share a bucket."""
        folder = uuid.uuid4().hex
        placed = rows.withColumn(BUCKET, bucket(keys, buckets))
        share = F.pmod(F.xxhash64(*rows.columns if spread > 1 else keys), F.lit(spread))
        placed.repartition(buckets * spread, BUCKET, share).write.partitionBy(BUCKET).parquet(f"{self.root}/data/{folder}")
        system, where = file_system(self.spark, f"{self.root}/data/{folder}")
        names = [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []
        return {int(n.split("=")[1]): f"{folder}/{n}" for n in names if n.startswith(f"{BUCKET}=")}

    def create(self, rows: DataFrame, keys: Iterable[str], buckets: int = 64, spread: int = 1, notes: dict[str, str] | None = None) -> Version:
        """Version 1."""
        keys = tuple(keys)
        places = self._write(rows, keys, buckets, spread)
        return self._commit(Version(1, buckets, keys, rows.schema, places, notes or {}))

    def change(self, keys: DataFrame, make: Callable[[DataFrame], DataFrame], spread: int = 1, notes: dict[str, str] | None = None, attempts: int = 3) -> Version:
        """Commits ``make(old)`` in place of the buckets that ``keys`` (rows with the key
        columns) touch; ``old`` are those buckets' rows, and ``make`` gives the whole new
        ones. If another writer comes first, it is done again on what that one left."""
        for left in range(attempts - 1, -1, -1):
            old = self.version()
            touched = self.buckets_of(keys, old)
            if not touched and notes is None:
                return old
            rows = make(self.read(old, touched)).select(*old.schema.fieldNames())
            new = self._write(rows, old.keys, old.buckets, spread) if touched else {}
            if strays := set(new) - set(touched):
                raise ValueError(f"rows outside of the touched buckets: {sorted(strays)}")
            kept = {b: place for b, place in old.places.items() if b not in touched}
            try:
                return self._commit(Version(old.number + 1, old.buckets, old.keys, old.schema, kept | new, old.notes | (notes or {})))
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def vacuum(self, keep: int = 2) -> int:
        """Deletes all but the last ``keep`` versions, and folders that none of these has:
        not while a writer is at work. Returns how many folders went."""
        numbers = self.numbers()
        needed = {place for n in numbers[-keep:] for place in self.version(n).places.values()}
        for n in numbers[:-keep]:
            remove(self.spark, f"{self.root}/versions/{n:010d}.json")
        system, where = file_system(self.spark, f"{self.root}/data")
        gone = 0
        for folder in [s.getPath() for s in system.listStatus(where)]:
            for part in [s.getPath() for s in system.listStatus(folder)]:
                place = f"{folder.getName()}/{part.getName()}"
                if part.getName().startswith(f"{BUCKET}=") and place not in needed:
                    gone += bool(system.delete(part, True))
            if not any(s.getPath().getName().startswith(f"{BUCKET}=") for s in system.listStatus(folder)):
                system.delete(folder, True)
        return gone


def bucket(keys: Iterable[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def claim(spark: SparkSession, folder: str, name: str) -> None:
    """Takes a name in a folder for good; raises :class:`Conflict` if somebody has it."""
    system, draft = file_system(spark, f"{folder}/.draft-{uuid.uuid4().hex}")
    system.create(draft, False).close()
    try:
        take_name(spark, draft, file_system(spark, f"{folder}/{name}")[1])
    finally:
        if system.exists(draft):
            system.delete(draft, False)


def take_name(spark: SparkSession, draft, final) -> None:  # noqa: ANN001
    """Gives a file its final name, which nobody else may have: a link on a local disk, else
    the store's rename, which refuses a name that exists. Raises :class:`Conflict`."""
    scheme = final.toUri().getScheme()
    if scheme in (None, "file"):
        try:
            os.link(draft.toUri().getPath(), final.toUri().getPath())
        except FileExistsError as taken:
            raise Conflict(str(final)) from taken
        return
    from py4j.java_gateway import java_import
    from py4j.protocol import Py4JJavaError

    jvm = spark._jvm
    java_import(jvm, "org.apache.hadoop.fs.Options")
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, final, none)
    except Py4JJavaError as raised:
        if "AlreadyExists" in str(raised.java_exception):
            raise Conflict(str(final)) from raised
        raise
