"""Search: a flat query compiled to one column, and typed sorting."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schema import COLUMNS, FREE_TEXT, NUMERIC

LOOK_AROUND = re.compile(r"\(\?<?[=!]|(?<!\\)\\[1-9]|\(\?P?[<>=]\w*[>)]?.*\\k")


@dataclass(frozen=True)
class ColumnFilter:
    """``@name=value`` or ``@name=[value,…]``: any of the values."""

    name: str
    values: tuple[str, ...]

    def column(self) -> Column:
        if self.name == "sim":
            raise ValueError("a search cannot filter by similarity")
        if self.name not in COLUMNS:
            raise ValueError(f"no column {self.name}")
        if self.name in NUMERIC:
            if not all(re.fullmatch(r"\s*\d+\s*", v) for v in self.values):
                raise ValueError(f"{self.name} is a number, not {self.values}")
            return F.col(self.name).isin(*[int(v) for v in self.values])
        on = tx.format_text("bit_depth", "channels") if self.name == "format" else F.col(self.name).cast("string")
        return tx.any_of([tx.contains(on, v) for v in self.values])


def parse_filters(text: str) -> tuple[str, tuple[ColumnFilter, ...]]:
    """Free text without its ``@name=value`` tokens, and these as filters.

    A value is bare, ``"quoted"`` (an open quote reads to the end) or a ``[list]``. Tokens
    without a value or with an unknown name stay in the free text.
    """
    left, found = [], []
    for m in re.finditer(r'@(\w+)=("[^"]*"?|\[[^\]]*\]?|\S*)|\S+', text):
        name, value = (m[1] or "").lower(), m[2] or ""
        if value.startswith("["):
            values = tuple(v.strip().strip('"') for v in value.strip("[]").split(",") if v.strip().strip('"'))
        else:
            values = tuple(v for v in (value.strip('"'),) if v)
        if name in COLUMNS and values:
            found.append(ColumnFilter(name, values))
        else:
            left.append(m[0])
    return " ".join(left), tuple(found)


def parse_range(text: str) -> tuple[int, int] | None:
    """``120`` or ``120-128``; None if it is neither, and then no filter applies."""
    m = re.fullmatch(r"\s*(\d{1,5})\s*(?:-\s*(\d{1,5})\s*)?", text)
    if not m or max(int(m[1]), int(m[2] or 0)) > 65535:
        return None
    return int(m[1]), int(m[2] or m[1])


@dataclass(frozen=True)
class SearchQuery:
    """Field patterns joined by AND or OR; free text and column filters always by AND."""

    fields: dict[str, str] = field(default_factory=dict)
    bpm: str = ""
    free_text: str = ""
    filters: tuple[ColumnFilter, ...] = ()
    regex: bool = False
    match_any: bool = False
    scope: str = "path"

    def pattern(self, name: str, pattern: str) -> Column:
        on = ("description", "comment") if name == "description" else (name,)
        if self.regex:
            if LOOK_AROUND.search(pattern):
                raise ValueError(f"look-around and back-references aren't supported: {pattern}")
            re.compile(pattern)
            return tx.any_of([F.col(c).rlike(pattern) for c in on])
        return tx.any_of([tx.contains(c, pattern) for c in on])

    def column(self) -> Column:
        parts = [self.pattern(n, p) for n, p in self.fields.items()]
        if bounds := parse_range(self.bpm):
            parts.append(F.col("bpm").between(*bounds))  # a null never matches
        both = [tx.any_of(parts) if self.match_any else tx.all_of(parts)] if parts else []
        if self.free_text:
            both.append(tx.any_of([tx.contains(c, self.free_text) for c in (*FREE_TEXT, self.scope)]))
        return tx.all_of(both + [f.column() for f in self.filters])


def search(samples: DataFrame, query: SearchQuery | str, limit: int = 0) -> DataFrame:
    """Matching rows in the order of their paths; a limit of 0 is none."""
    if isinstance(query, str):
        free, filters = parse_filters(query)
        query = SearchQuery(free_text=free, filters=filters)
    found = samples.filter(query.column()).orderBy("path")
    return found.limit(limit) if limit else found


def sort_key(name: str) -> Column:
    """Empty values are null; numbers and durations by value, other text in lower case."""
    if name in ("bpm", "bit_depth", "channels"):
        return F.col(name).cast("double")
    if name == "sample_rate":
        return (F.floor(F.col(name) / 1000) * 1000).cast("double")
    if name == "duration":
        return F.round(F.col(name)).cast("double")
    if name == "sim":
        return F.floor(F.round(F.col(name), 2) * 1000).cast("double")
    return F.nullif(tx.ascii_lower(F.col(name)), F.lit(""))


def sort_by(found: DataFrame, name: str, descending: bool = False, then: str = "path") -> DataFrame:
    """Empty values last, in descending order first, as the reversed comparison has it."""
    key = sort_key(name)
    return found.orderBy(key.desc_nulls_first() if descending else key.asc_nulls_last(), then)


def rows_for(samples: DataFrame, paths: Sequence[str], most: int = 500) -> DataFrame:
    """Rows of the given paths in the given order; missing ones are left out."""
    if len(paths) > most:
        raise ValueError(f"more than {most} paths")
    if len(set(paths)) < len(paths):
        raise ValueError("a path is given twice")
    wanted = samples.sparkSession.createDataFrame([(i, p) for i, p in enumerate(paths)], "ordinal int, path string")
    return samples.join(F.broadcast(wanted), "path").orderBy("ordinal")  # ``most`` rows at most


def display(samples: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns as text; a missing number is ``-``."""
    special = {
        "rating": tx.stars("rating"),
        "duration": F.coalesce(tx.duration_text("duration"), F.lit("-")),
        "format": F.coalesce(tx.format_text("bit_depth", "channels"), F.lit("-")),
        "parent_folder": tx.basename("parent_folder"),
    }
    numbers = {n: F.coalesce(F.col(n).cast("string"), F.lit("-")) for n in NUMERIC}
    return samples.select(*[(special | numbers).get(n, F.col(n)).alias(n) for n in names])


def verbose() -> Column:
    """The path, then ``name: value`` lines of the filled fields in their fixed order."""
    names = ("vendor", "library", "category", "sound_id", "description", "comment", "subcategory", "genre_id", "usage_id", "key", "rating", "umid")
    lines = [F.when(F.col(n) != "", F.concat(F.lit(f"  {n}: "), F.col(n))) for n in names]
    lines.append(F.when(F.col("bpm").isNotNull(), F.concat(F.lit("  bpm: "), F.col("bpm").cast("string"))))
    lines.append(F.when(F.col("file_id") != 0, F.concat(F.lit("  file_id: "), F.lower(F.lpad(F.hex("file_id"), 16, "0")))))
    return F.concat_ws("\n", F.col("path"), *lines)
