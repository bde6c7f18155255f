"""Marks and markers as text files, locations and settings."""

from __future__ import annotations

import os
import tomllib
import warnings
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.markers import EMPTY
from ..schema import COLUMNS, DEFAULT_COLUMNS


def read_marks(spark: SparkSession, path: str) -> DataFrame:
    """One path a line; blank lines don't count."""
    return spark.read.text(path).filter("value <> ''").select(F.col("value").alias("path")).distinct()


def write_marks(marks: DataFrame, path: str) -> None:
    """Sorted, one path a line, in one file: the sink is a small list that a person keeps."""
    marks.select(F.col("path").alias("value")).distinct().orderBy("value").coalesce(1).write.mode("overwrite").text(path)


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    """(bank, m1 … r4) of banks A and B. Lines with under eight fields are left out, a
    position that is no number is empty, a count that is none is 0; the last line of a bank
    counts, a bank without a line is empty. The file is that of one sample."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    parts = lines.filter("n > 0").select("n", F.split("line", ",").alias("p")).filter((F.size("p") >= 8) & F.trim(F.col("p")[0]).isin("A", "B"))

    def number(i: int, other: int):
        return F.coalesce(F.trim(F.col("p")[i]).try_cast("long"), F.lit(other))

    names = ("m1", "m2", "m3", "r1", "r2", "r3", "r4")
    rows = parts.select("n", F.trim(F.col("p")[0]).alias("bank"), *[number(i, EMPTY if i < 4 else 0).alias(x) for i, x in enumerate(names, 1)])
    last = rows.groupBy("bank").agg(F.max_by(F.struct(*names), "n").alias("v")).select("bank", "v.*")
    both = spark.createDataFrame([("A",), ("B",)], "bank string").join(last, "bank", "left")
    return both.select("bank", *[F.coalesce(x, F.lit(EMPTY if x[0] == "m" else 0)).alias(x) for x in names])


@dataclass(frozen=True)
class Settings:
    """Location, limits and choices of an engine; values out of range are brought into it,
    unknown ones are the default."""

    location: str = ""
    threshold: int = 64
    limit: int = 50
    source: str = "index"
    columns: tuple[str, ...] = tuple(DEFAULT_COLUMNS)
    marks_file: str = "marks.csv"
    sort: str = "name"
    descending: bool = False
    peak_measure: str = "rms"
    peak_channel: str = "mix"
    step_small: float = 0.1
    step_large: float = 1.0
    reset_volume: bool = True
    cents_coarse: float = 100.0
    cents_fine: float = 1.0
    bpm_coarse: float = 1.0
    bpm_fine: float = 0.1


#: Least and greatest values.
RANGES = {
    "threshold": (0, 32767), "limit": (1, 500), "step_small": (0.01, 100.0), "step_large": (0.01, 100.0), "cents_coarse": (0.01, 1200.0), "cents_fine": (0.01, 100.0),
    "bpm_coarse": (0.01, 100.0), "bpm_fine": (0.001, 10.0),
}
CHOICES = {"sort": COLUMNS, "peak_measure": ("rms", "peak"), "peak_channel": ("mix", "left")}


def settings(flag: str | None = None, environment: str = "SAMPLELAKE_DB", file: str | None = None, default: str = "samples.parquet", files_only: bool = False) -> Settings:
    """The location by flag, then environment, then file, then default; all else by the file.
    Without an index, or if asked, files are searched. A malformed settings file warns and
    leaves the defaults, and so does a value of another type."""
    values: dict = {}
    if file and os.path.exists(file):
        try:
            with open(file, "rb") as f:
                values = tomllib.load(f)
        except tomllib.TOMLDecodeError as error:
            warnings.warn(f"{file}: {error}", stacklevel=2)
    location = flag or os.environ.get(environment) or values.get("location") or default
    there = "://" in location or os.path.exists(location)
    chosen: dict = {}
    for known in fields(Settings):
        name, value = known.name, values.get(known.name)
        if value is None or name in ("location", "source"):
            continue
        kind = type(known.default)
        if name == "columns" and isinstance(value, list):
            kept = tuple(c for c in value if c in COLUMNS)
            chosen |= {"columns": kept} if kept else {}
        elif kind in (int, float) and isinstance(value, int | float) and not isinstance(value, bool):
            low, high = RANGES[name]
            chosen[name] = max(low, min(high, kind(value)))
        elif isinstance(value, kind) and value in CHOICES.get(name, (value,)):
            chosen[name] = value
        else:
            warnings.warn(f"{file}: {name} can't be {value!r}", stacklevel=2)
    return Settings(location, source="files" if files_only or not there else "index", **chosen)
