"""The canonical ``samples`` table: a row for each file."""

from __future__ import annotations

from pyspark.sql import types as T

STRINGS = (
    "path name parent_folder vendor library category sound_id description comment key rating subcategory genre_id usage_id umid date take track item"
).split()

SAMPLES = T.StructType(
    [T.StructField("id", T.LongType())]
    + [T.StructField(c, T.StringType(), False) for c in STRINGS]
    + [
        T.StructField("bpm", T.IntegerType()),
        T.StructField("file_id", T.LongType()),
        T.StructField("mtime", T.LongType()),
        T.StructField("peaks", T.ArrayType(T.ShortType())),
        T.StructField("peaks_source", T.StringType()),
        T.StructField("marked", T.BooleanType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("sample_rate", T.IntegerType()),
        T.StructField("bit_depth", T.IntegerType()),
        T.StructField("channels", T.IntegerType()),
        T.StructField("total_samples", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

#: Keys of the columns that a user may show, filter or sort by.
COLUMNS = (
    "name vendor library category sound_id description comment key bpm rating subcategory genre_id usage_id duration sample_rate bit_depth channels "
    "date take track item format parent_folder sim"
).split()
#: Those shown by default, in their order.
DEFAULT_COLUMNS = (
    "vendor library date duration sample_rate bit_depth channels rating bpm subcategory category genre_id sound_id usage_id key take track item comment"
).split()
#: Columns that a filter compares as numbers.
NUMERIC = ("bpm", "sample_rate", "bit_depth", "channels")
#: Columns that a free text is looked for in, besides path or name.
FREE_TEXT = ("vendor", "library", "category", "sound_id", "description", "comment", "key")
SCHEMA_VERSION = 2


def upgrade(df, version: int):
    """A table of an older schema version gets the columns it lacks, as nulls; a newer one
    than this library knows raises ValueError."""
    from pyspark.sql import functions as F

    if version > SCHEMA_VERSION:
        raise ValueError(f"schema version {version} is newer than {SCHEMA_VERSION}")
    for field in SAMPLES:
        if field.name not in df.columns:
            df = df.withColumn(field.name, F.lit(None).cast(field.dataType))
    return df
