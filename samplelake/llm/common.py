"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of str.split() beyond blank, tab, \n, \v, \f and \r.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``, which all machines share.

    Only where that is unset, as in tests, a folder of this machine is made and set.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        known = "file://" + tempfile.mkdtemp(prefix="samplelake-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it again.

    Cuts the lineage, so a lost executor costs a re-read and no recomputation.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that no later plan reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, for they need not have it."""
    context = spark.sparkContext
    if getattr(context, "_samplelake_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="samplelake-")
    archive = os.path.join(folder, "samplelake.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for module in sorted(package.rglob("*.py")):
            out.write(module, Path(package.name) / module.relative_to(package))
    context.addPyFile(archive)
    context._samplelake_shipped = True


def bounded_batches(spark: SparkSession, megabytes: int = 4) -> None:
    """Readies Python workers: sends them this package, and bounds the bytes (not only the
    rows) that one Arrow batch hands to them."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1))) != megabytes << 20:
        spark.conf.set(key, str(megabytes << 20))


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    as_text = F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))
    return F.crc32(as_text.cast("binary")) % n


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """128-bit key of a document, never null: only rows that repeat both id and text share
    it. A null differs from every value."""
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (F.col(doc_id).cast("string"), F.col(text))]
    return F.unhex(F.md5(F.concat(*parts)))


def beside(docs: DataFrame, **helpers: Column) -> DataFrame:
    """All columns of ``docs`` in one struct named doc, so that their names can't clash
    with the helper columns; ``select("doc.*")`` gives them back."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), *(c.alias(name) for name, c in helpers.items()))


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; ``SAMPLELAKE_TOKENIZERS`` names another folder."""
    if folder := os.environ.get("SAMPLELAKE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
