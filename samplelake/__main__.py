"""The command line: ``python -m samplelake --help``."""

from __future__ import annotations

import argparse
import runpy
import sys
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog, from_files, run_workflow
from .operators import search as se
from .operators import similar as si
from .operators import stats as st
from .operators.workflow import Sample, diff_text
from .sources.tables import settings

FIELDS = ("vendor", "library", "category", "sound_id", "description", "key")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("samplelake", description="Searches, indexes and edits libraries of audio samples on Spark.")
    out.add_argument("paths", nargs="*", help="folders; with --find, none")
    for name in FIELDS:
        out.add_argument(f"--{name.replace('_', '-')}", dest=name, metavar="PATTERN")
    out.add_argument("--bpm", default="", metavar="N or N-M")
    out.add_argument("--find", default="", metavar="TEXT", help="free text and @column=value filters")
    out.add_argument("--regex", action="store_true", help="field patterns are regular expressions")
    out.add_argument("--or", dest="match_any", action="store_true", help="any field pattern is enough")
    style = out.add_mutually_exclusive_group()
    for name in ("verbose", "json", "count"):
        style.add_argument(f"--{name}", action="store_true")
    out.add_argument("--db-path", metavar="PLACE", help="where the tables are")
    out.add_argument("--no-db", action="store_true", help="search files, not the index")
    out.add_argument("--index", action="store_true", help="bring the index up to date with the folders")
    out.add_argument("--force-reindex", action="store_true", help="read all files anew")
    out.add_argument("--db-stats", action="store_true")
    out.add_argument("--similar", metavar="PATH")
    out.add_argument("-w", "--workflow", metavar="FILE", help="a Python file whose function edit(sample) is run on each match")
    out.add_argument("--commit", action="store_true", help="write a workflow's changes; else they are shown")
    out.add_argument("--force", action="store_true", help="also into packed files")
    out.add_argument("--limit", type=int, default=0, metavar="N")
    out.add_argument("--id3", action="store_true", help="read ID3 tags too")
    return out


def lines(found: DataFrame, options: argparse.Namespace) -> Iterator[str]:
    """Rows in the chosen style, as they come."""
    if options.count:
        yield str(found.count())
        return
    if options.json:
        shown = F.to_json(F.struct(*[c for c in found.columns if c not in ("peaks", "embedding")]))
    else:
        shown = se.verbose() if options.verbose else F.col("path")
    for row in found.select(shown.alias("line")).toLocalIterator():
        yield row["line"]


def script_of(path: str) -> Callable[[Sample], None]:
    """A file's function ``edit``. Its source goes to the executors with the function."""
    with open(path) as f:
        source = f.read()
    if "edit" not in runpy.run_path(path):
        raise ValueError(f"{path} has no function edit(sample)")
    made: dict = {}

    def edit(sample: Sample) -> None:
        if "edit" not in made:
            exec(compile(source, path, "exec"), made)  # noqa: S102  the user's own script
        made["edit"](sample)

    return edit


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None, out: Callable[[str], None] = print) -> int:
    """Runs one command. 0, or 1 where a search finds nothing or a write has errors."""
    options = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("samplelake").getOrCreate()
    place = settings(options.db_path, default="samplelake-db", files_only=options.no_db)
    catalog = Catalog(spark, place.location)
    if options.index or options.force_reindex:
        run = catalog.index(options.paths or ["."], options.id3, options.force_reindex)
        out(f"{run.files_indexed} indexed, {run.deleted} deleted, {run.errors} errors, version {run.version}")
        return 0
    if options.db_stats:
        row = catalog.stats().first()
        out(f"files: {row['files']}\nlatest: {row['latest']}\nembedded: {row['embedded']}")
        for r in st.top_vendors(catalog.samples.read()).collect():
            out(f"  {r['vendor']}: {r['n']}")
        return 0
    if options.similar:
        found = catalog.similar(options.similar, options.limit or 50)
        for row in si.lines(found.orderBy(F.col("sim").desc(), "id"), "json" if options.json else "tab").collect():  # the limit's rows
            out(row["line"])
        return 0
    free, filters = se.parse_filters(options.find)
    fields = {n: getattr(options, n) for n in FIELDS if getattr(options, n)}
    query = se.SearchQuery(fields, options.bpm, free, filters, options.regex, options.match_any)
    walk = place.source == "files" or not catalog.samples.exists()
    found = se.search(from_files(spark, options.paths or ["."], options.id3), query) if walk else catalog.search(query)
    if options.paths and not walk:
        found = found.filter(F.concat_ws("|", *[F.col("path").startswith(p.rstrip("/") + "/").cast("string") for p in options.paths]).contains("true"))
    if options.workflow:
        diffs, report = run_workflow(found, script_of(options.workflow), options.commit, options.force, options.limit)
        for row in diffs.orderBy("path").toLocalIterator():
            out(f"{row['path']}\n{diff_text(row['diff'])}")
        errors = report.filter("error IS NOT NULL").orderBy("path").limit(100).collect() if report is not None else []
        for row in errors:
            out(f"{row['path']}: {row['error']}")
        return int(bool(errors))
    shown = 0
    for line in lines(found.limit(options.limit) if options.limit else found, options):
        out(line)
        shown += line != "0" if options.count else 1
    return int(shown == 0)


if __name__ == "__main__":
    sys.exit(main())
