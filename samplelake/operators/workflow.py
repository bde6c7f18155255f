"""Workflows: rows go through a function or through expressions, and changes become diffs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import index as ix

#: The fields that a diff compares, in its order.
DIFF_FIELDS = "vendor library description comment category sound_id usage_id subcategory genre_id key rating take track item umid".split()
#: The fields that are stored in the packed block.
PACKED_FIELDS = "comment rating bpm subcategory category genre_id sound_id usage_id key".split()
#: Widths of the fields that a workflow may set.
WIDTHS = {
    "vendor": 32, "library": 32, "description": 256, "comment": 32, "category": 4, "sound_id": 4, "usage_id": 4, "subcategory": 4, "genre_id": 4, "key": 8, "rating": 4, "umid": 64,
}


def meta_diff(before: str, after: str) -> Column:
    """Array of (field, old, new) of two structs' differing fields; a missing bpm is a dash."""
    parts = [F.struct(F.lit(n).alias("field"), F.col(f"{before}.{n}").alias("old"), F.col(f"{after}.{n}").alias("new")) for n in DIFF_FIELDS]
    dash = [F.coalesce(F.col(f"{side}.bpm").cast("string"), F.lit("—")) for side in (before, after)]
    parts.append(F.struct(F.lit("bpm").alias("field"), dash[0].alias("old"), dash[1].alias("new")))
    return F.filter(F.array(*parts), lambda x: x["old"] != x["new"])


def packed_fields_differ(before: str, after: str) -> Column:
    return tx.any_of([~F.col(f"{before}.{n}").eqNullSafe(F.col(f"{after}.{n}")) for n in PACKED_FIELDS])


def diff_text(changes: list[Any]) -> str:
    """Red lines with the old values, green ones with the new."""
    return "".join(f"\x1b[31m- {c['field']}: {c['old']}\x1b[0m\n\x1b[32m+ {c['field']}: {c['new']}\x1b[0m\n" for c in changes)


class Sample:
    """A row inside a workflow's function: fields to read, setters that clean and cut."""

    def __init__(self, row: dict[str, Any]) -> None:
        self._row = row

    def __getattr__(self, name: str) -> Any:
        try:
            return self._row[name]
        except KeyError:
            raise AttributeError(name) from None

    def set(self, name: str, value: Any) -> None:
        if name == "bpm":
            self._row["bpm"] = None if value is None else int(value)
        elif name in WIDTHS:
            self._row[name] = re.sub(r"[^\x00-\x7f]", "?", str(value))[: WIDTHS[name]]
        else:
            raise AttributeError(f"{name} can't be set")


def run_script(samples: DataFrame, script: Callable[[Sample], None], error: str | None = None) -> DataFrame:
    """The rows as the script leaves them; a row where it raises stays as it was. ``error``
    names a column that is added for what went wrong, null elsewhere."""
    columns = samples.columns + ([error] if error else [])
    schema = samples.schema.simpleString()[7:-1]
    schema += f",{error}:string" if error else ""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.astype(object).where(frame.notna(), None).to_dict("records"):
                new, wrong = dict(row), None
                try:
                    script(Sample(new))
                except Exception as raised:  # noqa: BLE001  a script's error skips its row
                    new, wrong = dict(row), f"{type(raised).__name__}: {raised}"
                if error:
                    new[error] = wrong
                rows.append(new)
            yield pd.DataFrame(rows, columns=columns)

    return samples.mapInPandas(run, schema)


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, diff) of the rows that differ."""
    fields = [*DIFF_FIELDS, "bpm"]
    joined = before.select("path", F.struct(*fields).alias("b")).join(after.select("path", F.struct(*fields).alias("a")), "path")
    return joined.select("path", meta_diff("b", "a").alias("diff")).filter(F.size("diff") > 0)


def tag_categories(samples: DataFrame) -> DataFrame:
    return samples.withColumn("category", tx.tag_category("category", "description", "sound_id", "comment", "vendor", "library"))


def move_prefix(path: str | Column, volume: str) -> Column:
    """``/Users/…`` is on the volume."""
    return F.regexp_replace(tx.col(path), "^/Users/", f"{volume}/Users/")


def lookup_update(samples: DataFrame, ref: DataFrame, on: Column, key: str = "file_path", order: str = "id") -> DataFrame:
    """Rows with a reference row (same path, case as it is) take over its category,
    subcategory, sound id and key, join its description to theirs as the comment, and fill
    an empty vendor or library; the others stay."""
    best = ref.groupBy(key).agg(F.min_by(F.struct(*[c for c in ref.columns if c != key]), order).alias("r"))
    joined = samples.withColumn("_on", on).join(best, F.col("_on") == F.col(key), "left")
    there = F.col(key).isNotNull()

    def taken(column: str, value: Column) -> Column:
        return F.when(there, value).otherwise(F.col(column))

    empty = F.lit("")
    return joined.withColumns(
        {
            "category": taken("category", F.coalesce("r.category", empty)),
            "subcategory": taken("subcategory", F.coalesce("r.sub_category", empty)),
            "sound_id": taken("sound_id", F.coalesce("r.short_id", empty)),
            "key": taken("key", F.coalesce("r.key", empty)),
            "comment": taken("comment", tx.ascii_clean(tx.combine_comments("description", "r.description"), 32)),
            "vendor": taken("vendor", tx.first_filled("vendor", "r.artist")),
            "library": taken("library", tx.first_filled("library", "r.library")),
            "bpm": taken("bpm", F.coalesce(F.col("r.bpm").try_cast("int"), F.col("bpm"))),
            "umid": taken("umid", F.coalesce("r.umid", "umid")),
        }
    ).select(*samples.columns)


def reference_row(samples: DataFrame, ref: DataFrame, on: str, key: str = "file_path", order: str = "id") -> DataFrame:
    """``samples`` with the reference row of their path, compared without regard to case."""
    found = ix.one_for_each(ref, key, order)
    return samples.join(found.select("_key", F.struct(*[c for c in found.columns if c != "_key"]).alias("ref")), tx.ascii_lower(on) == F.col("_key"), "left").drop("_key")
