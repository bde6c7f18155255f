"""What executors need: this package, and a folder that all machines share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, for they need not have it."""
    context = spark.sparkContext
    if getattr(context, "_samplelake_sent", False):
        return
    package = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="samplelake-"), "samplelake.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for module in sorted(package.rglob("*.py")):
            out.write(module, Path(package.name) / module.relative_to(package))
    context.addPyFile(archive)
    context._samplelake_sent = True


def shared(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``, which all machines share; in a local session
    without one, in a folder of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="samplelake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: a lost executor costs a re-read."""
    path = shared(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, each: int, *keys: str) -> DataFrame:
    """Small rows that stand for much work, ``each`` of them a task. The number is stated,
    since partitions by size alone would put them all into one."""
    return df.repartition(max(1, -(-df.count() // each)), *keys)


def file_system(spark: SparkSession, path: str):  # noqa: ANN201
    """Hadoop's file system and path, for small files and folders of the driver's own."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    system, where = file_system(spark, path)
    system.delete(where, True)
