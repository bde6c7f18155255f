"""Index maintenance, marks and enrichment, as new versions of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import stage
from ..functions import text as tx
from ..sources.table import Table, Version


def to_read(listing: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """Listed files that are new or whose mtime changed."""
    return listing if force else listing.join(state.select("path", "mtime"), ["path", "mtime"], "left_anti")


def vanished(state: DataFrame, listing: DataFrame, roots: list[str] | None = None) -> DataFrame:
    """Indexed paths that are no longer listed; only those under the walked roots."""
    own = state.filter(tx.any_of([F.col("path").startswith(r.rstrip("/") + "/") for r in roots])) if roots else state
    return own.select("path").join(listing.select("path"), "path", "left_anti")


def upsert(old: DataFrame, new: DataFrame, keep: tuple[str, ...] = ("id", "marked", "embedding"), strict: bool = False, order: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same path.

    The columns in ``keep`` survive in a replaced row, unless ``strict``: then they are null,
    and ``marked`` false. Of a path that ``new`` has twice the last row stays, in the order of its column
    ``order``, or else as the rows come, which a rerun of a shuffled input may deal otherwise.
    """
    at = F.col(order) if order else F.monotonically_increasing_id()
    last = new.select("path", F.struct(*new.columns).alias("_row"), at.alias("_at")).groupBy("path").agg(F.max_by("_row", "_at").alias("_row"))
    new = last.select("_row.*")
    kept = [c for c in keep if c in old.columns]
    rest = old.join(new.select("path"), "path", "left_anti")
    if strict:
        filled = new.select("*", *[F.lit(False if c == "marked" else None).cast(old.schema[c].dataType).alias(c) for c in kept if c not in new.columns])
    else:
        before = old.select("path", *[F.col(c).alias(f"_{c}") for c in kept])
        filled = new.join(before, "path", "left").select(*[c for c in new.columns if c not in kept], *[F.col(f"_{c}").alias(c) for c in kept])
        if "marked" in kept:
            filled = filled.withColumn("marked", F.coalesce("marked", F.lit(False)))
    return rest.unionByName(filled, allowMissingColumns=True)


def delete(samples: DataFrame, paths: DataFrame) -> DataFrame:
    return samples.join(paths.select("path"), "path", "left_anti")


def refresh(state: DataFrame, listing: DataFrame, force: bool = False, roots: list[str] | None = None) -> DataFrame:
    """One incremental run: changed rows replaced, new ones added, vanished ones deleted."""
    kept = state if force else delete(state, vanished(state, listing, roots))
    return upsert(kept, to_read(listing, state, force))


def upsert_table(table: Table, new: DataFrame, **options) -> Version:
    """:func:`upsert` into a committed table keyed by path: only the buckets of the new
    rows' paths are read and written."""
    return table.change(new.select("path"), lambda old: upsert(old, new, **options))


def delete_table(table: Table, paths: DataFrame) -> Version:
    """:func:`delete` from a committed table; only the paths' buckets are read and written."""
    return table.change(paths.select("path"), lambda old: delete(old, paths))


def refresh_table(table: Table, listing: DataFrame, force: bool = False, roots: list[str] | None = None) -> Version:
    """:func:`refresh` of a committed table. Of the table only paths and mtimes are read to
    find what changed, and then the buckets that changed."""
    known = table.read().select("path", "mtime")
    new = stage(to_read(listing, known, force), "changed")
    gone = known.select("path").filter("false") if force else stage(vanished(known, listing, roots), "vanished")
    return table.change(new.select("path").unionByName(gone), lambda old: upsert(delete(old, gone), new))


def merge_sources(first: DataFrame, others: list[tuple[DataFrame, Column, dict[str, str]]]) -> DataFrame:
    """``first`` with its empty texts filled from other sources, the earlier before the later.

    A source is a table, the key of ``first`` that its column ``key`` must equal (a key once
    at most), and the names its columns fill.
    """
    out = first
    for i, (source, key, names) in enumerate(others):
        own = source.select(F.col("key").alias(f"_key{i}"), *[F.col(c).alias(f"_{i}_{c}") for c in names])
        out = out.join(own, key == F.col(f"_key{i}"), "left")
        out = out.withColumns({to: tx.first_filled(to, f"_{i}_{c}") for c, to in names.items()}).select(*first.columns)
    return out


def put(store: DataFrame, key: str, value: Column) -> DataFrame:
    """A key-value table with the key's value replaced."""
    row = store.sparkSession.range(1).select(F.lit(key).alias("key"), value.alias("value"))
    return store.filter(F.col("key") != key).unionByName(row)


def mark(marks: DataFrame, paths: DataFrame) -> DataFrame:
    return marks.select("path").unionByName(paths.select("path")).distinct()


def unmark(marks: DataFrame, paths: DataFrame) -> DataFrame:
    return marks.select("path").join(paths.select("path"), "path", "left_anti")


def with_marks(samples: DataFrame, marks: DataFrame) -> DataFrame:
    flags = marks.select("path", F.lit(True).alias("_mark")).dropDuplicates(["path"])
    return samples.join(flags, "path", "left").withColumn("marked", F.col("_mark").isNotNull()).drop("_mark")


def one_for_each(ref: DataFrame, key: str, order: str) -> DataFrame:
    """Of the reference rows with the same key in either case, the first by ``order``."""
    rest = [c for c in ref.columns if c != key]
    best = ref.groupBy(tx.ascii_lower(key).alias("_key")).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return best.select("_key", "_row.*")


def enrich(samples: DataFrame, ref: DataFrame, on: str, key: str = "file_path", order: str = "id") -> DataFrame:
    """``samples`` with the filled fields of the reference row of their path, in any case."""
    found = one_for_each(ref, key, order).select("_key", *[F.col(c).alias(f"_{c}") for c in ref.columns if c not in (key, order)])
    joined = samples.join(found, tx.ascii_lower(on) == F.col("_key"), "left")

    def filled(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names[:-1]], F.col(names[-1]))

    number = F.col("_rating").try_cast("int")
    return joined.withColumns(
        {
            "vendor": filled("_artist", "vendor"),
            "library": filled("_library", "_cd_title", "library"),
            "key": filled("_key_name", "key") if "_key_name" in joined.columns else F.col("key"),
            "bpm": F.coalesce(F.col("_bpm").try_cast("int"), F.col("bpm")),
            "rating": F.when(number.between(1, 5), F.repeat(F.lit("*"), number)).otherwise(F.col("rating")),
            "comment": filled("_description", "comment"),
            "umid": filled("_umid", "umid"),
        }
    ).select(*samples.columns)
