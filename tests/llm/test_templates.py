"""Line templates by brute force, and cases that seeds and counts of ends would miss."""

import random
import re
from itertools import combinations

import pytest

from samplelake.llm import template_tree
from samplelake.llm.template_tree import drop_recurring_lines


def dropped(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts, 1)]
    return {r.doc_id: r.n_dropped for r in drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def brute(texts):
    """The numbers of dropped lines, from all subsets of one or two variable parts."""
    lines = {}
    for doc, text in enumerate(texts, 1):
        for line, raw in enumerate(text.split("\n")):
            tokens = tuple("<*>" if re.search("[0-9]", t) else t for t in raw.split())
            if any(t != "<*>" for t in tokens):
                lines.setdefault(tokens, []).append((doc, line))
    templates = {}
    for tokens in lines:
        n, rest = len(tokens), len(tokens) - 3
        if n < 5:
            continue
        parts = min(11, rest)
        cuts = [3 + i * rest // parts for i in range(parts + 1)]
        for hidden in [*((i, i) for i in range(parts)), *combinations(range(parts), 2)]:
            places = {p for i in hidden for p in range(cuts[i], cuts[i + 1])}
            if len(places) <= n // 5:
                shape = tuple(None if p in places else t for p, t in enumerate(tokens))
                templates.setdefault((n, tokens[:3], hidden, shape), []).append(tokens)
    best = {}
    for (_, _, hidden, shape), forms in templates.items():
        docs = {d for f in forms for d, _ in lines[f]}
        if len(forms) > 1 and len(docs) >= 3:
            weight = sum(len({d for d, _ in lines[f]}) for f in forms)
            rank = -weight, min(min(lines[f]) for f in forms), hidden
            for f in forms:
                best[f] = min(best.get(f, (rank, shape)), (rank, shape), key=lambda x: x[0])
    firsts = {}
    for f, (rank, shape) in best.items():
        key = rank[2], shape
        firsts[key] = min(firsts.get(key, (9**9, 0)), min(lines[f]))
    out = dict.fromkeys(range(1, len(texts) + 1), 0)
    for f, places in lines.items():
        keeper = firsts[best[f][0][2], best[f][1]][0] if f in best else min(places)[0]
        for d, _ in places:
            out[d] += d != keeper
    return out


def test_documents_are_counted_not_ends(spark):
    """Alice's line is in three documents, Bob's in one of these: the template has three."""
    by = "Posted in category Sports by {}".format
    texts = [by("Alice"), by("Alice"), "x", "y", by("Alice") + "\n" + by("Bob")]
    assert dropped(spark, texts) == {1: 0, 2: 1, 3: 0, 4: 0, 5: 2}
    # two documents only, each with both
    assert dropped(spark, [by("Alice") + "\n" + by("Bob")] * 2) == {1: 0, 2: 2}
    assert dropped(spark, [by("Alice"), by("Bob")]) == {1: 0, 2: 0}


def test_other_recurring_lines_of_a_leaf_hide_no_template(spark):
    seen = [f"please see the full list of open positions at {x}" for x in "Acme Bolt Cord Dune Echo Fern Gale Hill".split()]
    rivals = ["please see the full list below or ask for more", "please see the nice set of open positions for chefs"]
    texts = [*seen, *[r for r in rivals for _ in range(4)]]
    out = dropped(spark, texts)
    assert [out[i] for i in range(1, 9)] == [0] + [1] * 7
    assert sum(out[i] for i in range(9, 17)) == 6
    assert out == brute(texts)


@pytest.mark.parametrize("seed", range(4))
def test_brute_force(spark, seed):
    """Leaves with many forms, ties, repeated lines and lines of every length up to 60."""
    deal = random.Random(seed)
    frames = [[deal.choice("red blue green open shut left right 7 x9".split()) for _ in range(n)] for n in (1, 3, 5, 6, 9, 10, 13, 14, 15, 16, 22, 60)]

    def line():
        tokens = list(deal.choice(frames))
        for _ in range(deal.choice([0, 0, 1, 1, 2, 3])):
            tokens[deal.randrange(len(tokens))] = deal.choice(["one", "two", "three", "4", "five"])
        return " ".join(tokens)

    texts = ["\n".join(line() for _ in range(deal.randint(0, 6))) for _ in range(60)]
    assert dropped(spark, texts) == brute(texts)


def test_long_lines_and_hot_templates(spark):
    long = " ".join(f"word{chr(97 + i % 26)}" for i in range(30_000))
    texts = [long + f" {x} end" for x in ("a", "b", "c", "d")]
    texts += [f"Served by host {x} in the north hall" for x in "abcdefghijklmnopqrstuvwxyz"] * 20
    out = dropped(spark, texts)
    assert [out[i] for i in range(1, 5)] == [0, 1, 1, 1]
    assert sum(out.values()) == 3 + 26 * 20 - 1


def test_few_lines_meet_in_the_join(spark, monkeypatch):
    """Of 400 lines 6 share a leaf with others: their wordings go on to the join, and hardly any
    others; none is lost with so few bits that others' are set too."""
    texts = ["\n".join(f"{chr(97 + i)}x{chr(97 + j)} only here" for j in range(20)).replace("x", f" {chr(65 + i)}") for i in range(20)]
    for i, name in enumerate(("Alice", "Bob", "Carol")):
        texts[i] += f"\nPosted in category Sports by {name}\nRead more about the Sports of {name}"
    want, sift, left = brute(texts), template_tree._sifted, []
    monkeypatch.setattr(template_tree, "_sifted", lambda lines, wanted: (left.append((out := sift(lines, wanted)).count()), out)[1])
    for bits in (template_tree.SIEVE, 64):
        monkeypatch.setattr(template_tree, "SIEVE", bits)
        assert dropped(spark, texts) == want
    assert sum(want.values()) == 4 and left[0] <= 8 < left[1]
