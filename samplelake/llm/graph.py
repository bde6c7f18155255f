"""Connected components and pairs of texts, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): the least node of its component.

    Each round a node takes the least label of its neighbours and itself, and then that
    label's own label, until no label changes. Both are joins whose large keys Spark can
    split, followed by a group-by with partial aggregation, so a hub's edges meet in no one
    task. The driver sees a count and a checksum only. Loops and repeated edges don't matter.
    """
    links = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    ways = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    now = staged(ways.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    mark = _mark(now)
    for _ in range(rounds):
        seen = ways.join(now.select(F.col("node").alias("v"), "label"), "v").select(F.col("u").alias("node"), "label")
        low = seen.unionByName(now).groupBy("node").agg(F.min("label").alias("label"))
        jumped = low.join(now.select(F.col("node").alias("label"), F.col("label").alias("next")), "label").select("node", F.col("next").alias("label"))
        new = staged(jumped, "labels")
        discard(now)
        now, before, mark = new, mark, _mark(new)
        if mark == before:
            discard(links)
            return now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _mark(labels: DataFrame) -> tuple:
    return tuple(labels.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(node, label))")).first())


def labelled(nodes: DataFrame, found: DataFrame, node: str, label: str) -> DataFrame:
    """``nodes`` with their component's label; a node without edges is its own."""
    named = found.select(F.col("node").alias(node), F.col("label").alias(label))
    return nodes.join(named, node, "left").withColumn(label, F.coalesce(label, node))


def texts_of(docs: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """(row, text) of the documents in ``pairs`` (a, b), one for each row key; written to
    the shared folder, since it is read once for either end of a pair. A merge join at any
    size: documents are shuffled once however few they are."""
    ends = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row")))
    wanted = ends.distinct().hint("merge")
    return staged(docs.select("row", "text").join(wanted, "row", "left_semi").dropDuplicates(["row"]), name)


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` with the columns text_a and text_b."""
    first = pairs.join(texts.select(F.col("row").alias("a"), F.col("text").alias("text_a")), "a")
    return first.join(texts.select(F.col("row").alias("b"), F.col("text").alias("text_b")), "b")
