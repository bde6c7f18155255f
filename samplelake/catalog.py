"""A library of samples in one place: its tables, and what is done with them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import stage
from .operators import index as ix
from .operators import postings as po
from .operators import search as se
from .operators import similar as si
from .operators import stats as st
from .operators import workflow as wf
from .schema import SAMPLES, SCHEMA_VERSION, upgrade
from .sources import wav
from .sources import writes as wr
from .sources.files import list_tree
from .sources.table import Table, Version
from .streaming.incremental import Run, index_folder


class Catalog:
    """Tables under ``location``: ``samples`` by path, ``text`` (their trigrams) and
    ``codes`` (of their embeddings), each in versions; see :class:`Table`."""

    def __init__(self, spark: SparkSession, location: str) -> None:
        self.spark, self.location = spark, location.rstrip("/")
        self.samples, self.text, self.codes = (Table(spark, f"{self.location}/{name}") for name in ("samples", "text", "codes"))

    def index(self, roots: Sequence[str], id3: bool = False, force: bool = False, buckets: int = 64) -> Run:
        """Brings samples and text index up to date with folders; see :func:`index_folder`."""
        return index_folder(self.spark, list(roots), self.samples, id3, force, buckets, self.text)

    def search(self, query: se.SearchQuery | str, limit: int = 0) -> DataFrame:
        """Matching rows by path. Free text of three characters or more goes through the text
        index if it is of the samples' version; shorter text finds nothing there, and all
        else is a scan of the samples."""
        if isinstance(query, str):
            free, filters = se.parse_filters(query)
            query = se.SearchQuery(free_text=free, filters=filters)
        query = replace(query, scope="name")
        version = self.samples.version()
        rows = self.samples.read(version)
        fresh = self.text.exists() and self.text.version().notes.get("samples") == str(version.number)
        found = po.indexed(rows, self.text, query) if query.free_text and fresh else se.search(rows, query)
        return found.limit(limit) if limit else found

    def stats(self) -> DataFrame:
        return st.summary(self.samples.read())

    def set_embeddings(self, new: DataFrame, dim: int) -> Version:
        """Vectors (path, vec) for samples that have none; only their buckets are written."""
        return self.samples.change(new.select("path"), lambda old: si.set_embeddings(old, new, dim))

    def vectors(self) -> DataFrame:
        return self.samples.read().filter("embedding IS NOT NULL").select("id", "path", F.col("embedding").alias("vec"))

    def encode(self, codebook: list, version: int) -> int:
        """Brings the codes up to date; returns how many vectors were encoded."""
        return si.encode_new(self.codes, self.vectors(), codebook, version)

    def similar(self, path: str, limit: int = 50, codebook: list | None = None, max_exact: int = 100_000) -> DataFrame:
        """The samples most like that of ``path``: by their codes if a codebook is given, else
        exactly, for as many vectors as ``max_exact``."""
        row = self.samples.read().filter(F.col("path") == path).select("id").head()
        if row is None:
            raise ValueError(f"no sample {path}")
        if codebook is not None:
            return si.similar_quantised(self.codes.read(), self.vectors(), row["id"], codebook, limit)
        return si.similar(self.vectors(), row["id"], limit, max_exact)

    def mark(self, paths: DataFrame, marked: bool = True) -> Version:
        wanted = paths.select("path", F.lit(True).alias("_wanted")).dropDuplicates(["path"])

        def make(old: DataFrame) -> DataFrame:
            return old.join(wanted, "path", "left").withColumn("marked", F.when(F.col("_wanted"), F.lit(marked)).otherwise(F.col("marked"))).drop("_wanted")

        return self.samples.change(paths.select("path"), make)

    def delete(self, paths: DataFrame) -> Version:
        return ix.delete_table(self.samples, paths)


def from_files(spark: SparkSession, roots: Sequence[str], id3: bool = False) -> DataFrame:
    """Rows as the samples have them, read from the files' headers, without an index; files
    that can't be read are left out."""
    read = wav.read_headers(list_tree(spark, list(roots)).filter("error IS NULL"), id3).filter("error IS NULL").drop("error")
    named = read.withColumns({"name": F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1), "parent_folder": F.regexp_extract("path", "^(.*)/[^/]*$", 1), "marked": F.lit(False)})
    return upgrade(named, SCHEMA_VERSION).select(*SAMPLES.fieldNames())


def run_workflow(found: DataFrame, script: Callable[[wf.Sample], None], commit: bool = False, force: bool = False, limit: int = 0) -> tuple[DataFrame, DataFrame | None]:
    """The script's diffs (path, diff) over ``found``, and with ``commit`` the report of what
    was written into the files. Without ``force`` a packed file stays as it is."""
    rows = found.orderBy("path").limit(limit) if limit else found
    rows = rows.drop("peaks", "embedding")
    diffs = stage(wf.changes(rows, wf.run_script(rows, script)), "diffs")
    return diffs, wr.write_fields(wr.changed_fields(diffs), force, True) if commit else None
