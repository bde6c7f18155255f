"""Statistics and derived columns of the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import stage
from ..functions import text as tx

#: Which decoder reads which extension.
SOURCES = {"riff": ("wav",), "decoder": ("aif", "aiff", "mp3", "flac", "ogg")}


def source_of(path: str | Column) -> Column:
    """The decoder by the extension's lower case; ``unknown`` for any other."""
    out = F.lit("unknown")
    for name, extensions in SOURCES.items():
        out = F.when(tx.extension(path).isin(*extensions), name).otherwise(out)
    return out


def audio_info(data_size: Column, block: Column, rate: Column) -> Column:
    """total = data size div block, seconds = total / rate; 0 where the divisor is 0."""
    total = F.when(block == 0, F.lit(0)).otherwise(F.floor(data_size / block)).cast("long")
    return F.struct(total.alias("total"), F.when(rate == 0, F.lit(0.0)).otherwise(total / rate).alias("seconds"))


def table_rows(samples: DataFrame) -> DataFrame:
    """bpm within 16 bits; audio only with all its parts, its length from the duration if missing."""
    return samples.select(
        "*",
        F.coalesce(F.col("total_samples"), (F.col("duration") * F.col("sample_rate")).cast("long")).alias("total"),
        (F.col("duration").isNotNull() & F.col("sample_rate").isNotNull() & F.col("bit_depth").isNotNull() & F.col("channels").isNotNull()).alias("has_audio"),
    ).withColumn("bpm", F.when(F.col("bpm").between(0, 65535), F.col("bpm")))


def summary(samples: DataFrame) -> DataFrame:
    return samples.agg(F.count(F.lit(1)).alias("files"), F.max("mtime").alias("latest"), F.count("embedding").alias("embedded"))


def top_vendors(samples: DataFrame, n: int = 10) -> DataFrame:
    return samples.filter("vendor <> ''").groupBy("vendor").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "vendor").limit(n)


def peak_sources(samples: DataFrame) -> DataFrame:
    return samples.groupBy("peaks_source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "peaks_source")


def staleness(indexed: DataFrame, listing: DataFrame, n: int = 100, seed: int = 0) -> DataFrame:
    """Of ``n`` indexed paths drawn by a seeded hash, how many the listing lacks."""
    drawn = indexed.orderBy(F.xxhash64("path", F.lit(seed)), "path").limit(n)
    there = listing.select("path", F.lit(True).alias("there")).dropDuplicates(["path"])
    return drawn.join(there, "path", "left").agg(F.count_if(F.col("there").isNull()).alias("stale"), F.count(F.lit(1)).alias("sampled"))


def peak_decision(source: Column, regenerate: Column, silent: Column) -> Column:
    """Stored peaks count only if packed and not to be made anew; silence has none."""
    return F.when(silent, "none").when((source == "packed_u8") & ~regenerate, "packed_u8").otherwise("generated")


def duplicates(paths: DataFrame) -> DataFrame:
    return paths.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def embeddable() -> Column:
    return ~F.coalesce(F.upper("category").startswith("LOOP"), F.lit(False))


def trigrams(c: str | Column) -> Column:
    """All runs of three characters, in ASCII lower case; shorter texts have none."""
    low = tx.ascii_lower(c)
    return F.when(F.length(low) >= 3, F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: F.substring(low, i, F.lit(3)))).otherwise(F.expr("array()").cast("array<string>"))


def relevance(samples: DataFrame, column: str, words: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 over trigrams, best first (ties by id); an option, the default order is the path.

    The statistics are of all rows; only postings of the query's trigrams are counted.
    """
    wanted = sorted({words[i : i + 3] for i in range(len(words) - 2)})
    rows = samples.select("id", trigrams(column).alias("grams")).filter(F.size("grams") > 0).withColumn("len", F.size("grams"))
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"))
    postings = rows.select("id", "len", F.explode(F.filter("grams", lambda g: g.isin(*wanted))).alias("gram"))
    tf = postings.groupBy("id", "len", "gram").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))  # a row for each of the query's trigrams
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    term = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    joined = tf.join(F.broadcast(df), "gram").join(F.broadcast(whole))  # one row
    return joined.groupBy("id").agg(F.round(F.sum(term), 6).alias("score")).orderBy(F.col("score").desc(), "id")


def ranked(found: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``found`` with each row's number in the order, from 1.

    No single task holds all rows: a sort deals them to ranges, which are written to the
    shared folder as they are numbered, and the ranges' sizes, a row for each, are added up
    and joined back.
    """
    within, own = F.col("_number").bitwiseAND((1 << 33) - 1), F.shiftright("_number", 33).cast("int")
    numbered = stage(found.orderBy(*order).withColumn("_number", F.monotonically_increasing_id()), "ranked").withColumn("_own", own)
    sizes = numbered.groupBy("_own").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_own").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_own", before.alias("_before")))  # a row for each partition of the sort
    return numbered.join(starts, "_own").withColumn(name, (F.col("_before") + within + 1).cast("long")).drop("_number", "_own", "_before")


def run_stats(rows: DataFrame, error: str = "error") -> DataFrame:
    """(files_indexed, errors) of an index run: rows without and with an error."""
    return rows.agg(*run_counts(error))


def run_counts(error: str = "error") -> list[Column]:
    """The same as columns, to be observed while the rows are written."""
    return [F.count_if(F.col(error).isNull()).alias("files_indexed"), F.count_if(F.col(error).isNotNull()).alias("errors")]
