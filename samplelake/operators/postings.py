"""A text index: for each field and trigram the rows that have it, as a committed table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import stage
from ..functions import text as tx
from ..sources.table import Table, Version
from .search import FREE_TEXT, ColumnFilter, SearchQuery
from .stats import trigrams

FIELDS = (*FREE_TEXT, "name")
#: Ids of a block: a list's entries are offsets within it, and a list has so many at most.
BLOCK = 4096
#: Rows whose lists a task makes, and rows whose lists the tasks of one share write, about.
TASK, SHARE = 8192, 500_000
#: The entry under which a field's rows have their numbers of trigrams.
LENGTH = ""
#: Trigrams whose lists are intersected, and ids that go into a filter, at most.
RAREST, FEW = 3, 10_000


def postings(rows: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """(field, gram, block, offsets, counts): in each block of 4096 ids, which have the
    trigram in the field (ASCII lower case) and how often; ``LENGTH`` has all of them.

    The rows are dealt by their blocks to a number of tasks that grows with them, and a task
    makes its blocks' lists whole: what it holds doesn't grow with the table."""
    wide = F.array(*[F.struct(F.lit(f).alias("field"), trigrams(f).alias("grams")) for f in fields])
    tasks = max(1, -(-rows.count() // TASK))  # stated, since by size alone they would be too few
    near = rows.select("id", *fields, F.expr(f"id div {BLOCK}").alias("block")).repartitionByRange(tasks, "block")
    texts = near.select("id", "block", F.explode(wide).alias("x")).select("id", "block", "x.field", "x.grams").filter(F.size("grams") > 0)
    each = F.transform("grams", lambda g: F.struct(g.alias("gram"), F.lit(1).alias("n")))
    whole = F.array(F.struct(F.lit(LENGTH).alias("gram"), F.size("grams").alias("n")))
    entries = texts.select("field", "block", F.expr(f"CAST(id % {BLOCK} AS INT)").alias("offset"), F.explode(F.concat(each, whole)).alias("e"))
    return _listed(entries.groupBy("field", "e.gram", "block", "offset").agg(F.sum("e.n").cast("int").alias("n")))


def _listed(entries: DataFrame) -> DataFrame:
    lists = entries.groupBy("field", "gram", "block").agg(F.sort_array(F.collect_list(F.struct("offset", "n"))).alias("e"))  # a block's ids at most
    return lists.select("field", "gram", "block", F.col("e.offset").alias("offsets"), F.col("e.n").alias("counts"))


def build(table: Table, rows: DataFrame, fields: Sequence[str] = FIELDS, buckets: int = 64, spread: int = 0, notes: dict[str, str] | None = None) -> Version:
    """Version 1 of an index: lists in buckets by their trigram; ``spread`` tasks write one,
    by default as many as the rows ask for."""
    return table.create(postings(rows, fields), ["gram"], buckets, spread or _spread(rows), notes)


def _spread(rows: DataFrame) -> int:
    return max(1, -(-rows.count() // SHARE))


def rebuild(table: Table, rows: DataFrame, buckets: int = 64, fields: Sequence[str] = FIELDS, notes: dict[str, str] | None = None) -> Version:
    """The next version, or the first, from all rows."""
    if not table.exists():
        return build(table, rows, fields, buckets, notes=notes)
    new = stage(postings(rows, fields), "postings")
    return table.change(new.select("gram").unionByName(table.read().select("gram")), lambda _: new, _spread(rows), notes)


def update(table: Table, before: DataFrame, after: DataFrame, fields: Sequence[str] = FIELDS, notes: dict[str, str] | None = None) -> Version:
    """Follows a change: ``before`` are the changed and deleted rows as they were, ``after``
    the changed and new ones. Only buckets of their trigrams are read and written."""
    old, new = postings(before, fields), postings(after, fields)
    gone = before.select(F.expr(f"id div {BLOCK}").alias("block"), F.expr(f"CAST(id % {BLOCK} AS INT)").alias("offset"))
    gone = gone.groupBy("block").agg(F.collect_set("offset").alias("gone"))  # a block's ids at most

    def make(lists: DataFrame) -> DataFrame:
        left = lists.join(gone, "block", "left").select("field", "gram", "block", F.explode(F.arrays_zip("offsets", "counts")).alias("e"), "gone")
        left = left.filter(F.col("gone").isNull() | ~F.array_contains("gone", F.col("e.offsets"))).select("field", "gram", "block", F.col("e.offsets").alias("offset"), F.col("e.counts").alias("n"))
        more = new.select("field", "gram", "block", F.explode(F.arrays_zip("offsets", "counts")).alias("e")).select("field", "gram", "block", F.col("e.offsets").alias("offset"), F.col("e.counts").alias("n"))
        return _listed(left.unionByName(more))

    return table.change(old.select("gram").unionByName(new.select("gram")).distinct(), make, notes=notes)


def grams_of(words: str) -> list[str]:
    """The distinct trigrams of words, folded as the index folds."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in words)
    return sorted({low[i : i + 3] for i in range(len(low) - 2)})


def lists_of(table: Table, grams: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The lists of some trigrams: only their buckets are opened, and the scan is told the
    trigrams."""
    version = table.version()
    wanted = table.spark.createDataFrame([(g,) for g in grams], "gram string")
    return table.read(version, table.buckets_of(wanted, version)).filter(F.col("gram").isin(*grams) & F.col("field").isin(*fields))


def candidates(table: Table, words: str, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Ids of rows that have, in one field, the rarest trigrams of ``words``; a few may lack
    the words themselves. Words of fewer than three characters have none."""
    grams = grams_of(words)
    none = table.spark.createDataFrame([], "id long")
    if not grams:
        return none
    lists = lists_of(table, grams, fields)
    sizes = {r["gram"]: r["n"] for r in lists.groupBy("gram").agg(F.sum(F.size("offsets")).alias("n")).collect()}  # a row for each trigram of the words
    if len(sizes) < len(grams):
        return none
    rarest = sorted(grams, key=lambda g: (sizes[g], g))[:RAREST]
    met = lists.filter(F.col("gram").isin(*rarest)).groupBy("field", "block").pivot("gram", rarest).agg(F.first("offsets"))
    both: Column = reduce(F.array_intersect, [F.col(f"`{g}`") for g in rarest])  # null where a list is missing
    return met.select("block", F.explode(both).alias("offset")).select((F.col("block") * BLOCK + F.col("offset")).alias("id")).distinct()


def find(samples: DataFrame, table: Table, words: str, fields: Sequence[str] = FIELDS, filters: Sequence[ColumnFilter] = ()) -> DataFrame:
    """Rows that have ``words`` in a field, in the order of their paths: candidates from the
    lists, then the exact predicate. Up to 10 000 candidates are a filter that the scan of
    the samples can use; more are a semi-join."""
    ids = candidates(table, words, fields)
    some = [r["id"] for r in ids.limit(FEW + 1).collect()]
    near = samples.filter(F.col("id").isin(*some)) if some and len(some) <= FEW else samples.filter("false") if not some else samples.join(ids, "id", "left_semi")
    exact = tx.any_of([tx.contains(f, words) for f in fields])
    return near.filter(tx.all_of([exact, *(f.column() for f in filters)])).orderBy("path")


def indexed(samples: DataFrame, table: Table, query: SearchQuery) -> DataFrame:
    """A whole query: its free text through the index, all else as the scan has it."""
    if not query.free_text:
        return samples.filter(query.column()).orderBy("path")
    rest = SearchQuery(query.fields, query.bpm, "", query.filters, query.regex, query.match_any, query.scope)
    found = find(samples, table, query.free_text)
    return found.filter(rest.column()) if query.fields or query.bpm or query.filters else found


def relevance(table: Table, field: str, words: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of BM25 over the trigrams of ``words``, best first, ties by id: from the
    words' lists, and the field's lengths; no text is read."""
    wanted = grams_of(words)
    lists = lists_of(table, [*wanted, LENGTH], [field])
    lengths = lists.filter(F.col("gram") == LENGTH)
    whole = lengths.agg(F.sum(F.size("offsets")).alias("n"), (F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)) / F.sum(F.size("offsets"))).alias("mean"))
    rows = lists.filter(F.col("gram").isin(*wanted))
    df = rows.groupBy("gram").agg(F.sum(F.size("offsets")).alias("df"))  # a row for each trigram of the words
    entry = lambda x: x.select("gram", "block", F.explode(F.arrays_zip("offsets", "counts")).alias("e")).select("gram", "block", F.col("e.offsets").alias("offset"), F.col("e.counts").alias("n"))
    # of the lengths only those in blocks that the words have
    near = lengths.join(rows.select("block").distinct(), "block", "left_semi")
    long = entry(near).select("block", "offset", F.col("n").alias("len"))
    tf = entry(rows).withColumnRenamed("n", "tf").join(long, ["block", "offset"])
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    term = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    joined = tf.join(F.broadcast(df), "gram").join(F.broadcast(whole))  # one row
    scored = joined.withColumn("id", F.col("block") * BLOCK + F.col("offset"))
    return scored.groupBy("id").agg(F.round(F.sum(term), 6).alias("score")).orderBy(F.col("score").desc(), "id")
