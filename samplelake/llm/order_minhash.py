"""Near-duplicates by Order MinHash and banded alignment."""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, bounded_batches, discard, row_key, staged, text_or_empty
from .graph import components, labelled, texts_of, with_texts

U = np.uint64
#: Words from which a chain of common shingles is tried before the exact alignment.
LONG = 2000
#: Bins into which a text's words fall, and words that one counts; 64-bit numbers of the bits that
#: go with a rare word; and of those of the most frequent rare words by which a pair has met.
BINS, MOST, BITS, SEEN = 256, 127, 8, 8
#: Rows in no leader's component down to which new leaders are chosen; the last step has the others.
LEFT = 4096


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").split()


def shingles_of(words: list[bytes], k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; of fewer words, one of them all."""
    if not words:
        return np.empty(0, U)
    codes = mix(np.fromiter(map(zlib.crc32, words), U, len(words)) + U(0x9E3779B97F4A7C15))
    k = min(k, len(codes))
    out = codes[: len(codes) - k + 1].copy()
    for i in range(1, k):
        out = mix(out) + codes[i : len(codes) - k + 1 + i]
    return mix(out)


def shingles(text: str, k: int) -> np.ndarray:
    return shingles_of(words_of(text), k)


def labelled_codes(codes: np.ndarray) -> np.ndarray:
    """Shingle hashes made distinct by their occurrence's number in the text."""
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    fresh = np.ones(len(codes), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    if fresh.all():
        return codes
    starts = np.flatnonzero(fresh)
    number = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes))))
    out = codes.copy()
    out[order] = mix(ranked + number.astype(U) * U(0xD6E8FEB86659FD93))
    out[order[number == 0]] = ranked[number == 0]
    return out


def sketch(codes: np.ndarray, bands: int, lengths: tuple[int, ...]) -> np.ndarray:
    """Order MinHash: for each length and band a hash of the band's ``length`` least labelled
    shingles, in text order. All lengths of a band sample from one order, so a longer sample
    holds the shorter."""
    if not len(codes):
        return np.empty(0, np.int64)
    most = min(max(lengths), len(codes))
    seeds = mix(np.arange(1, bands + 1, dtype=U) * U(0xA0761D6478BD642F))
    chosen = np.empty((bands, most), np.int64)
    step = max(1, (1 << 20) // len(codes))
    for i in range(0, bands, step):
        values = mix(codes[None, :] ^ seeds[i : i + step, None])
        some = np.argpartition(values, most - 1, axis=1)[:, :most] if most < len(codes) else np.tile(np.arange(most), (len(values), 1))
        ranks = np.argsort(np.take_along_axis(values, some, 1), axis=1)
        chosen[i : i + step] = np.take_along_axis(some, ranks, 1)
    found = []
    for length in lengths:
        places = np.sort(chosen[:, :length], axis=1)
        out = mix(seeds + U(length))
        for j in range(places.shape[1]):
            out = mix(out * U(0x9FB21C651E98DF25) + codes[places[:, j]])
        found.append(out)
    return np.concatenate(found).view(np.int64)


def chained(a: list[bytes], b: list[bytes], band: int, k: int) -> int:
    """Words that a chain of common shingles aligns, within the band: not more than
    :func:`aligned_words` finds, and quick for long texts."""
    x, y = (labelled_codes(shingles_of(t, k)) for t in (a, b))
    _, left, right = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    order = np.argsort(left)
    left, right = left[order], right[order]
    near = np.abs(left - right) <= band
    left, right = left[near].tolist(), right[near].tolist()
    tails: list[int] = []
    at: list[int] = []  # of each tail, which pair it is
    before = [-1] * len(right)
    for i, place in enumerate(right):
        j = bisect_left(tails, place)
        if j == len(tails):
            tails.append(place)
            at.append(i)
        else:
            tails[j], at[j] = place, i
        before[i] = at[j - 1] if j else -1
    chain, i = [], at[-1] if at else -1
    while i >= 0:
        chain.append((left[i], right[i]))
        i = before[i]
    total = end_a = end_b = 0
    for p, q in reversed(chain):  # each shingle aligns those of its words that no earlier one has
        done = max(0, end_a - p, end_b - q)
        if done < k:
            total += k - done
            end_a, end_b = p + k, q + k
    return total


def aligned_words(a: list[bytes], b: list[bytes], band: int) -> int:
    """The most words that can be aligned in the order of both texts, each with an equal one
    at most ``band`` places away: a row of the alignment's table in one number's bits."""
    masks: dict[bytes, int] = {}
    for i, word in enumerate(a):
        masks[word] = masks.get(word, 0) | 1 << i
    room = (1 << 2 * band + 1) - 1
    free = full = (1 << len(a)) - 1
    for j, word in enumerate(b):
        own = masks.get(word)
        if own:
            hit = free & own & (room << j - band if j > band else room >> band - j)
            free = (free + hit | free - hit) & full
    return len(a) - free.bit_count()


def similarity_of(a: list[bytes], b: list[bytes], least: float, k: int = 5) -> float:
    """Aligned words / words of the longer text: 1 less the edits for each of its words.

    The band is as wide as an alignment of the share ``least`` can stray. Below ``least``
    the result is an upper bound's share, or the banded alignment's.
    """
    longer = max(len(a), len(b))
    if not longer:
        return 1.0
    shorter, first = min(len(a), len(b)), 0
    if shorter < least * longer:
        return shorter / longer
    while first < shorter and a[first] == b[first]:
        first += 1
    last = 0
    while last < shorter - first and a[-1 - last] == b[-1 - last]:
        last += 1
    x, y = a[first : len(a) - last], b[first : len(b) - last]
    same = first + last
    if same < least * longer:
        bound = same + (Counter(x) & Counter(y)).total()
        if bound < least * longer:
            return bound / longer
    band = int(longer * (1 - least)) + 1
    if longer > LONG and x and y:
        quick = same + chained(x, y, band, k)
        if quick >= least * longer:
            return quick / longer
    return (same + aligned_words(x, y, band)) / longer


def sketches(docs: DataFrame, k: int, bands: int, lengths: tuple[int, ...]) -> DataFrame:
    """(row, doc_id, same, size, bands) of each document; ``same`` identifies its words."""
    bounded_batches(docs.sparkSession)
    schema = "row binary, doc_id string, same binary, size int, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            same, sizes, found = [], [], []
            for text in batch.column(2).to_pylist():
                words = words_of(text)
                same.append(hashlib.md5(b" ".join(words)).digest())
                sizes.append(len(words))
                found.append(sketch(labelled_codes(shingles_of(words, k)), bands, lengths))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(same, pa.binary()), pa.array(sizes, pa.int32()), pa.array(found, pa.list_(pa.int64()))],
                names=["row", "doc_id", "same", "size", "bands"],
            )

    return docs.select("row", F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, schema)


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b) of the pairs whose banded alignment reaches ``least``."""
    bounded_batches(pairs.sparkSession, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(batch.schema.get_field_index(c)) for c in "ab")
            split = (map(words_of, batch.column(batch.schema.get_field_index(c)).to_pylist()) for c in ("text_a", "text_b"))
            good = pa.array([similarity_of(x, y, least) >= least for x, y in zip(*split)], pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(good), b.filter(good)], names=["a", "b"])

    return with_texts(pairs, texts).mapInArrow(run, "a binary, b binary")


def _possible(n: str | Column, m: str | Column, similarity: float) -> Column:
    return F.least(n, m) >= similarity * F.greatest(n, m)


def _buckets(members: DataFrame, key: str) -> DataFrame:
    """``members`` (row, size, ...) of the keys that two rows or more have, with how many and
    the leader, the least row. Row keys are hashes, so a group of copies has the same leader
    in most of its buckets."""
    found = members.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "size")).alias("leader")).filter("n > 1")
    return members.join(found, key)


def _across(buckets: DataFrame, parents: DataFrame, similarity: float, full: int) -> DataFrame:
    """(a, b) of the pairs of buckets of up to ``full`` rows, and of rows and leaders in larger
    ones, whose ends have different parents."""
    held = labelled(buckets, parents, "row", "label").withColumn("x", F.struct("row", "size", "label"))
    held = held.join(held.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("x").alias("y")), "key").filter("low <> high")
    lists = held.filter(F.col("n") <= full).groupBy("key").agg(F.sort_array(F.collect_set("x")).alias("xs")).select("xs", F.posexplode("xs").alias("i", "x"))
    pairs = lists.select("x", F.explode(F.expr("filter(slice(xs, i + 2, size(xs)), y -> y.label <> x.label)")).alias("y"))
    met = pairs.unionByName(held.filter((F.col("n") > full) & (F.col("x.label") != F.col("y.label"))).select("x", "y"))
    met = met.filter(_possible("x.size", "y.size", similarity) & (F.col("x.row") != F.col("y.label")) & (F.col("y.row") != F.col("x.label")))
    return met.select(F.least("x.row", "y.row").alias("a"), F.greatest("x.row", "y.row").alias("b")).distinct()


def rare_words(texts: DataFrame, least: float, ordered: int = 50_000) -> DataFrame:
    """(row, code) of each text's rarest words, one for each occurrence: so many that two
    texts of which a share ``least`` of the longer one's words is common have one of them in
    common. Any order of words will do for that; here the ``ordered`` most frequent ones come
    last, by how many texts have them."""
    return _rarest(texts, least, ordered).select("row", F.explode("codes").alias("code"))


def _rarest(texts: DataFrame, least: float, ordered: int = 50_000) -> DataFrame:
    """(row, codes, bins, bits): the words of :func:`rare_words` in their order, how many of the
    text's words fall into each of ``BINS`` bins, ``MOST`` at most, and of 64 * ``BITS`` bins
    whether these are odd."""
    bounded_batches(texts.sparkSession)

    def codes_of(text: str) -> np.ndarray:
        return labelled_codes(shingles_of(words_of(text), 1))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # a word once for all texts of the batch
            found, n = np.unique(np.concatenate([np.empty(0, U), *map(codes_of, batch.column(0).to_pylist())]).view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n, pa.int64())], names=["code", "n"])

    counts = texts.select("text").mapInArrow(words, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    known = counts.filter("n > 1").orderBy(F.col("n").desc(), "code").limit(ordered).collect()  # bounded by ``ordered``
    known.sort(key=lambda r: r["code"])
    codes, ranks = np.array([r["code"] for r in known], np.int64), np.array([r["n"] for r in known], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, bins, bits = [], [], []
            for text in batch.column(1).to_pylist():
                own = codes_of(text).view(np.int64)
                rank = np.zeros(len(own), np.int64)
                if len(codes) and len(own):
                    at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
                    rank = np.where(codes[at] == own, ranks[at], 0)
                shown = len(own) - int(np.ceil(least * len(own) - 1e-9)) + 1
                found.append(own[np.lexsort((own, rank))[:shown]])
                bins.append(np.minimum(np.bincount(own & (BINS - 1), minlength=BINS), MOST).astype(np.int8))
                odd = np.bincount(own & (64 * BITS - 1), minlength=64 * BITS) & 1
                bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            columns = [batch.column(0), pa.array(found, pa.list_(pa.int64())), pa.array(bins, pa.list_(pa.int8())), pa.array(bits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "codes", "bins", "bits"])

    return texts.select("row", "text").mapInArrow(run, "row binary, codes array<long>, bins array<tinyint>, bits array<long>")


def _with_words(profiles: DataFrame, frequent: list[int]) -> DataFrame:
    """(id, class, size, bits, code, seen): ``profiles`` by their rarest words. ``seen`` has a bit
    for each of the text's words among the ``frequent`` ones that come before ``code`` there; of
    any other word, for all of them."""
    bounded_batches(profiles.sparkSession)
    known, order = np.sort(np.array(frequent, np.int64)), np.argsort(np.array(frequent, np.int64))
    places = np.arange(64 * SEEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, seen, texts = [np.empty(0, np.int64)], [], []
            for i, own in enumerate(batch.column(4)):
                own = own.values.to_numpy()
                at = np.searchsorted(known, own)
                place = np.full(len(own), len(places))
                found = at < len(known)
                found[found] = known[at[found]] == own[found]
                place[found] = order[at[found]]
                there = np.isin(places, place) & (places < place[:, None])
                codes.append(own)
                seen += list(np.packbits(there, axis=1).view(np.int64))
                texts.append(np.full(len(own), i))
            rows = batch.take(pa.array(np.concatenate([np.empty(0, np.int64), *texts])))
            columns = [*(rows.column(i) for i in range(4)), pa.array(np.concatenate(codes)), pa.array(seen, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "class", "size", "bits", "code", "seen"])

    schema = "id long, class long, size int, bits array<long>, code long, seen array<long>"
    return profiles.select("id", "class", "size", "bits", "codes").mapInArrow(run, schema)


def _rest(hot: DataFrame, known: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of all pairs of rows of a bucket whose classes differ and which can be similar.

    They have one of their rarest words in common (see :func:`rare_words`), and their words
    fall into bins alike: words that differ are at least as many as the bins' counts do, or as
    the bins of which one is odd. Only this bit of each goes with a word; what is left of the
    pairs, each once, takes the counts and the buckets from the texts' profiles. Of a word's
    rows those of its largest class aren't paired with each other. Of the words that a pair
    shares, it comes from the first among the 64 * ``SEEN`` that the most rows have, however
    many they share; from others only if it shares none of these, and few rows have those. A
    row is there once however many buckets it is in; joins' large keys Spark can split."""
    held = labelled(hot, known, "row", "label")
    mixed = held.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    held = held.join(mixed, "key").groupBy("row", "size", "label").agg(F.collect_set("key").alias("keys"))  # a text's own buckets
    held = staged(held.withColumn("id", F.monotonically_increasing_id()), "mixed")
    own = staged(texts.join(held.select("row").hint("merge"), "row", "left_semi"), "mixed-texts")
    named = held.join(held.groupBy("label").agg(F.min("id").alias("class")), "label").drop("label")
    profiles = staged(_rarest(own, similarity).join(named, "row"), "profiles")
    tops = profiles.select("class", F.posexplode("codes").alias("place", "code")).groupBy("code", "class").agg(F.count(F.lit(1)).alias("n"))
    tops = tops.groupBy("code").agg(F.max(F.struct("n", "class")).alias("top"), F.count(F.lit(1)).alias("classes"), F.sum("n").alias("n"))
    tops = staged(tops.filter("classes > 1").select("code", F.col("top.class").alias("top"), "n"), "tops")
    frequent = [r["code"] for r in tops.orderBy(F.col("n").desc(), "code").limit(64 * SEEN).collect()]  # bounded
    members = staged(_with_words(profiles, frequent[::-1]).join(tops.drop("n"), "code"), "rare")
    columns = [c for c in members.columns if c not in ("code", "top")]
    x = members.filter("class <> top").select("code", "top", *(F.col(c).alias(f"{c}_a") for c in columns))
    y = members.select("code", *(F.col(c).alias(f"{c}_b") for c in columns))
    room = F.col("size_a") + F.col("size_b") - 2 * similarity * F.greatest("size_a", "size_b") + 1e-6
    odd = reduce(add, (F.bit_count(F.col("bits_a")[i].bitwiseXOR(F.col("bits_b")[i])) for i in range(BITS)))
    met_before = reduce(Column.bitwiseOR, (F.col("seen_a")[i].bitwiseAND(F.col("seen_b")[i]) for i in range(SEEN)))
    once = (F.col("class_a") != F.col("class_b")) & ((F.col("class_b") == F.col("top")) | (F.col("id_a") < F.col("id_b")))
    met = x.join(y, "code").filter(once & (met_before == 0) & _possible("size_a", "size_b", similarity) & (odd <= room))
    met = met.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()
    for side in "ab":
        met = met.join(profiles.select(*(F.col(c).alias(f"{c}_{side}") for c in ("id", "row", "size", "keys", "bins"))), f"id_{side}")
    differ = F.aggregate(F.zip_with("bins_a", "bins_b", lambda i, j: F.abs(i.cast("int") - j.cast("int"))), F.lit(0), lambda total, d: total + d)
    met = met.filter((differ <= room) & F.arrays_overlap("keys_a", "keys_b"))
    rest = staged(met.select(F.least("row_a", "row_b").alias("a"), F.greatest("row_a", "row_b").alias("b")), "rest")
    discard(held, own, profiles, tops, members)
    return rest


def near_duplicates(
    docs: DataFrame,
    k: int = 5,
    bands: int = 16,
    lengths: tuple[int, int, int] = (2, 4, 8),
    similarity: float = 0.8,
    full: int = 16,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, class_id) of every document: the least id of its class.

    Documents with the same lower-cased words are one node. Each node has ``bands`` Order
    MinHash samples: the least of its occurrence-labelled shingles of ``k`` words, in text
    order, ``lengths[0]`` of them. Nodes that share a sample are candidates. A pair is a
    link if a banded alignment of its words keeps the share ``similarity`` of the longer
    text; classes are the connected components of all links.

    Every node first meets the least leader of its buckets; nodes that match the same one
    need no further check. Of the others, a bucket of up to ``full`` nodes gives all pairs.
    In a larger one every node meets the bucket's leader, and the bucket is divided by the
    longer samples of the same band, where the same holds. Nodes of a bucket that is still
    large at the longest sample and that are in no leader's component become leaders too:
    all if they are up to ``full``, else about as many, and four times as many each round.
    They meet the whole bucket, until no more than ``LEFT`` such nodes remain. All other pairs of a large bucket whose
    classes still differ are then compared too, if they can be similar at all: if they have
    one of their rarest words in common, and not too many others (see :func:`_rest`). So the classes are those of all pairs that share a
    sample, whatever ``full`` is; nodes of one class aren't paired. Two texts that differ much find each other by chance: of
    pairs with a tenth of the words replaced about 0.95 share a sample, of those with a
    twentieth all do.

    Null and empty texts are one class; texts of fewer than ``k`` words have one shingle, so
    only equal ones meet. Repeated rows are in one class; null ids are the least; an empty
    table gives no rows; other columns are ignored.
    """
    return classes(docs, k, bands, lengths, similarity, full, doc_id, text).select("doc_id", "class_id")


def classes(docs: DataFrame, k: int, bands: int, lengths: tuple[int, ...], similarity: float, full: int, doc_id: str, text: str) -> DataFrame:
    """(row, doc_id, class_id, class_row): each document's class, and its least document's key."""
    kind = docs.schema[doc_id].dataType
    keyed = docs.select(row_key(doc_id, text).alias("row"), F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    all_rows = staged(sketches(keyed, k, bands, lengths).withColumn("doc_id", F.col("doc_id").cast(kind)), "sketches")
    nodes = all_rows.groupBy("same").agg(F.min(F.struct("doc_id", "row")).alias("node"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = staged(nodes.select("same", F.col("node.row").alias("row"), F.col("node.doc_id").alias("node_id"), "size", "bands"), "nodes")

    known = _links(keyed, nodes, bands, similarity, full)
    found = labelled(nodes.select("same", "row", "node_id"), known, "row", "label")
    least = found.groupBy("label").agg(F.min(F.struct("node_id", "row")).alias("first"))
    named = found.join(least, "label").select("same", F.col("first.node_id").alias("class_id"), F.col("first.row").alias("class_row"))
    return all_rows.select("row", "doc_id", "same").join(named, "same").select("row", "doc_id", "class_id", "class_row")


def _links(docs: DataFrame, nodes: DataFrame, bands: int, similarity: float, full: int) -> DataFrame:
    """(node, label): the components of all links."""
    levels = [F.slice("bands", 1 + i * bands, bands).alias(f"k{i}") for i in range(3)]
    banded = nodes.select("row", "size", F.explode(F.arrays_zip(*levels)).alias("k")).select("row", "size", "k.*")
    firsts = staged(_buckets(banded, "k0"), "members")
    longer = F.explode(F.array(F.struct(F.lit(1).alias("level"), F.col("k1").alias("key")), F.struct(F.lit(2).alias("level"), F.col("k2").alias("key"))))
    divided = _buckets(firsts.filter(F.col("n") > full).select("row", "size", longer.alias("k")).select("row", "size", "k.*"), "key")
    columns = ["key", "row", "size", "n", "leader", "level"]
    buckets = staged(firsts.withColumn("level", F.lit(0)).withColumnRenamed("k0", "key").select(*columns).unionByName(divided.select(*columns)), "buckets")

    # each row meets its least leader first: what shares a parent then needs no further check
    near = buckets.filter((F.col("row") != F.col("leader.row")) & _possible("size", "leader.size", similarity))
    best = near.groupBy("row").agg(F.min("leader.row").alias("a")).select("a", F.col("row").alias("b"))
    texts = texts_of(docs, buckets.select(F.col("row").alias("a"), F.col("row").alias("b")), "texts")
    stars = staged(verified(best, texts, similarity), "links")
    pairs = staged(_across(buckets, stars.select(F.col("b").alias("node"), F.col("a").alias("label")), similarity, full), "pairs")
    links = stars.unionByName(staged(verified(pairs, texts, similarity), "links"))
    discard(pairs, firsts)

    known = components(links)
    hot = buckets.filter((F.col("level") == 2) & (F.col("n") > full)).select("key", "row", "size", F.col("leader.row").alias("leader"))
    left = labelled(labelled(hot, known, "row", "label"), known, "leader", "top").filter("label <> top").select("key", "row", "size")
    turn = 0
    while (left := staged(left, "left")).count() > LEFT:
        turn += 1
        counted = left.join(left.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("one")), "key")
        chosen = counted.filter((F.col("row") == F.col("one")) | (F.pmod(F.xxhash64("row", F.lit(turn)), "n") < full * 4 ** (turn - 1)))
        chosen = staged(chosen.select("key", F.col("row").alias("new"), F.col("size").alias("new_size")), "leaders")
        met = hot.join(chosen, "key").filter((F.col("row") != F.col("new")) & _possible("size", "new_size", similarity))
        met = met.select(F.least("row", "new").alias("a"), F.greatest("row", "new").alias("b")).distinct()
        across = labelled(labelled(met, known, "a", "la"), known, "b", "lb").filter("la <> lb").select("a", "b")
        more = staged(verified(across, texts, similarity), "links")
        known = components(known.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))
        tops = labelled(chosen.select("key", F.col("new").alias("leader")), known, "leader", "label").select("key", "label").distinct()
        left = labelled(left.join(chosen.select("key", F.col("new").alias("row")), ["key", "row"], "left_anti"), known, "row", "label")
        left = left.join(tops, ["key", "label"], "left_anti").select("key", "row", "size")
    hot = buckets.filter((F.col("level") == 0) & (F.col("n") > full)).select("key", "row", "size")
    rest = _rest(hot, known, texts, similarity)
    if not rest.isEmpty():
        last = staged(verified(rest, texts, similarity), "links")
        known = components(known.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(last))
    discard(texts, buckets, rest)
    return known


def keep_one(docs: DataFrame, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class of near-duplicates, that with the least id (of repeated
    rows, same id and text, one), with all its columns, whatever their names; defaults and
    cases as in :func:`near_duplicates`."""
    firsts = classes(docs, 5, 16, (2, 4, 8), similarity, 16, doc_id, text).select(F.col("class_row").alias("row")).distinct()
    return beside(docs, row=row_key(doc_id, text)).join(firsts, "row", "left_semi").dropDuplicates(["row"]).select("doc.*")
