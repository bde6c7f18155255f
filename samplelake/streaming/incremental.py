"""Streams: an index that follows a folder, and results that come row by row."""

from __future__ import annotations

import queue
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from ..cluster import stage
from ..operators import index as ix
from ..operators import postings as po
from ..operators import stats as st
from ..schema import SAMPLES, SCHEMA_VERSION, upgrade
from ..sources import wav
from ..sources.files import list_tree
from ..sources.table import Table


#: With more unreadable folders than this a run deletes nothing.
MOST_UNREAD = 1000


@dataclass(frozen=True)
class Run:
    """What an index run did; errors are of files and of folders."""

    files_indexed: int
    errors: int
    deleted: int
    version: int


def index_folder(spark: SparkSession, roots: list[str], table: Table, id3: bool = False, force: bool = False, buckets: int = 64, text: Table | None = None) -> Run:
    """Brings a table of samples up to date with the folders under ``roots``.

    The listing is spread over tasks, and joined with the table's paths and mtimes; only new
    and changed files are opened. Their rows are written once, and counted while they are;
    then the touched buckets are committed. A file with an error stays as the table has it
    and is tried again by the next run; one that is gone from under a root goes. Names and
    folders come from the path; ids are given in the order of new paths; marks and
    embeddings stay. The text index ``text`` follows the same change, and is made anew if
    it isn't of the version that was changed.
    """
    listed = list_tree(spark, roots)
    files = listed.filter("error IS NULL")
    began = table.version() if table.exists() else None
    known = table.read(began).select("path", "mtime", "id") if began else spark.createDataFrame([], "path string, mtime long, id long")
    wanted = ix.to_read(files.select("path", "mtime"), known, force)
    watch = Observation()
    name = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    rows = wav.read_headers(wanted, id3).join(wanted, "path").withColumns({"name": name, "parent_folder": F.regexp_extract("path", "^(.*)/[^/]*$", 1)})
    read = stage(rows.observe(watch, *st.run_counts()), "headers")
    failed = listed.filter("error IS NOT NULL").count()
    counts = watch.get
    good = read.filter("error IS NULL").drop("error").join(known.select("path", "id"), "path", "left")
    top = known.agg(F.max("id")).first()[0] or 0
    fresh = st.ranked(good.filter("id IS NULL").select("path"), [F.col("path")], "place").select("path", (F.col("place") + top).alias("new"))
    good = good.join(fresh, "path", "left").withColumn("id", F.coalesce("id", "new"))
    good = stage(upgrade(good.withColumn("marked", F.lit(False)), SCHEMA_VERSION).select(*SAMPLES.fieldNames()), "samples")
    if began is None:
        done = table.create(good, ["path"], buckets)
        if text is not None:
            po.build(text, good, buckets=buckets, notes={"samples": "1"})
        return Run(counts["files_indexed"], counts["errors"] + failed, 0, done.number)
    gone = ix.vanished(known, files, roots)
    if failed > MOST_UNREAD:
        gone = gone.filter("false")
    elif failed:
        # a folder that couldn't be listed says nothing about its files
        unread = F.broadcast(listed.filter("error IS NOT NULL").select(F.concat("path", F.lit("/")).alias("folder")))
        gone = gone.join(unread, F.col("path").startswith(F.col("folder")), "left_anti")
    gone = stage(gone, "vanished")
    touched = good.select("path").unionByName(gone)
    before = table.read(began, table.buckets_of(touched, began)).join(touched, "path", "left_semi")
    done = table.change(touched, lambda old: ix.upsert(ix.delete(old, gone), good, keep=("marked", "embedding"), order="mtime"))
    if text is not None:
        of, now = text.version().notes.get("samples") if text.exists() else None, {"samples": str(done.number)}
        if of == str(began.number) and done.number == began.number + 1:
            po.update(text, before, good, notes=now)
        elif of != str(done.number):
            po.rebuild(text, table.read(done), buckets, notes=now)
    return Run(counts["files_indexed"], counts["errors"] + failed, gone.count(), done.number)


def follow(listing: DataFrame, table: Table, checkpoint: str):
    """Commits each batch of a streaming listing to the table; handles what is there, then
    ends."""

    def batch(rows: DataFrame, _: int) -> None:
        ix.upsert_table(Table(rows.sparkSession, table.root), rows)

    return listing.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Search:
    """A search that runs beside its caller: rows come as their partitions end, and
    :meth:`cancel` stops the tasks that still run.

    The jobs carry a tag of their own, so that nothing else of the session is stopped. At
    most ``ahead`` rows wait for the caller; then the search waits too.
    """

    def __init__(self, found: DataFrame, ahead: int = 1000) -> None:
        self.tag = f"search-{uuid.uuid4().hex}"
        self.cancelled = False
        self._context = found.sparkSession.sparkContext
        self._rows: queue.Queue = queue.Queue(ahead)
        self._thread = InheritableThread(target=self._run, args=(found,), daemon=True)
        self._thread.start()

    def _run(self, found: DataFrame) -> None:
        self._context.addJobTag(self.tag)
        end: BaseException | None = None
        try:
            for row in found.toLocalIterator(prefetchPartitions=True):
                while not self.cancelled:
                    try:
                        self._rows.put(row, timeout=0.1)
                        break
                    except queue.Full:
                        continue
                if self.cancelled:
                    break
        except Exception as raised:  # noqa: BLE001  handed to the caller
            end = raised
        finally:
            self._context.removeJobTag(self.tag)
        while True:
            try:
                self._rows.put(_End(end), timeout=0.1)
                return
            except queue.Full:
                if self.cancelled:
                    return

    def cancel(self) -> None:
        """Stops the search; the rows that have come are dropped."""
        self.cancelled = True
        self._context.cancelJobsWithTag(self.tag)

    def wait(self, seconds: float | None = None) -> bool:
        """Whether the search has ended, within ``seconds``."""
        self._thread.join(seconds)
        return not self._thread.is_alive()

    def __iter__(self) -> Iterator[Row]:
        while not self.cancelled:
            try:
                row = self._rows.get(timeout=0.1)
            except queue.Empty:
                if not self._thread.is_alive() and self._rows.empty():
                    return
                continue
            if isinstance(row, _End):
                if row.error is not None and not self.cancelled:
                    raise row.error
                return
            yield row


@dataclass(frozen=True)
class _End:
    error: BaseException | None


def results(found: DataFrame, cancelled: Callable[[], bool] = lambda: False) -> Iterator[Row]:
    """Rows as they come, until ``cancelled`` says so; then the search's tasks are stopped."""
    search = Search(found)
    try:
        for row in search:
            if cancelled():
                return
            yield row
    finally:
        search.cancel()
