"""Items that share a template, many occurrences, and very long texts."""

import random
import time

from samplelake.llm.decontaminate import find_leaks

ITEM = "{a} had {x} apples and bought {y} more at the market near the old town hall before giving {x} of them to {b}"
FILL = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))


def leaks(spark, docs, items):
    found = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return sorted(tuple(r) for r in found.select("doc_id", "item_id", "n_items").collect())


def test_rows_grow_with_documents_not_with_items(spark):
    """200 items that differ in their values, 200 documents with one each: a row a document."""
    items = [(i, ITEM.format(a="Anna", b="Ben", x=i + 2, y=1000 + i)) for i in range(200)]
    docs = [(i, f"{FILL} {text} {FILL}") for i, text in items]
    assert leaks(spark, docs, items) == [(i, 0, 200) for i in range(200)]


def test_items_of_one_class_are_as_consistent(spark):
    """Slots that are equal in one item and not in another make two classes, so an exact copy
    of either is found whichever comes first."""
    same, other = ITEM.format(a="Anna", b="Ben", x=5, y=5), ITEM.format(a="Carl", b="Dora", x=3, y=4)
    for items in ([(1, same), (2, other)], [(2, same), (1, other)]):
        ids = {text: i for i, text in items}
        found = leaks(spark, [(10, same), (11, other)], items)
        assert (10, ids[same], 1) in found and (11, ids[other], 1) in found
    assert leaks(spark, [(10, ITEM.format(a="Eve", b="Fay", x=8, y=9))], [(1, other), (2, ITEM.format(a="Gus", b="Hal", x=6, y=2))]) == [(10, 1, 2)]


def test_a_thousand_occurrences_in_one_text(spark):
    """Time is in proportion to the matches: the text is cut into tokens once."""
    item = ITEM.format(a="Anna", b="Ben", x=3, y=7)
    text = " ".join([f"{FILL} {item}"] * 1000)
    assert len(text) > 100_000
    leaks(spark, [(1, item)], [(1, item)])
    began = time.time()
    assert leaks(spark, [(1, text), (2, FILL * 2000)], [(1, item)]) == [(1, 1, 1)]
    assert time.time() - began < 60


def test_shuffled_values_are_no_copy(spark):
    deal = random.Random(1)
    item = ITEM.format(a="Anna", b="Ben", x=3, y=7)
    words = item.split()
    deal.shuffle(words)
    assert leaks(spark, [(1, " ".join(words))], [(1, item)]) == []
