"""Conversation repair against a table over all cells, and against every edit there is."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from samplelake.llm import conversations as conv

from ..oracle import SF


def damaged(rows):
    """Each conversation's rows after damage, in plain Python."""
    out = {}
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        kept = out.setdefault(conv_id, [])
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        kept += [(turn, "user" if fault == 4 else role, text)] * (fault != 0) * (1 + (fault == 3))
    digest = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
    return {c: sorted(kept, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), digest(r))) for c, kept in out.items()}


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        shown = re.sub("[ \t-\r]", "", text)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def table(turns):
    """Cheapest (cost, audit, turns) for each state after each turn, cell by cell."""
    to = {"": "su", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}

    def inserts(cells):
        for _ in range(4):
            for s, (c, w, t) in list(cells.items()):
                for r in to[s]:
                    if r in full and ((new := (c + 5, w + "I", t + [full[r] + ":"]))[:2] < cells.get(r, (9**9,))[:2]):
                        cells[r] = new
        return cells

    cells = inserts({"": (0, "", [])})
    for (_, role, text), fault in zip(turns, faults(turns)):
        after = {}

        def put(s, new):
            if s not in after or new[:2] < after[s][:2]:
                after[s] = new

        for s, (c, w, t) in cells.items():
            put(s, (c + 2, w + "D", t))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 * (fault == "truncated")
            for r in to[s]:
                if role[:1] == r:
                    put(r, (c + more, w + "K", t + [f"{role}:{text}"]))
                if r in full:
                    put(r, (c + 1 + more, w + "R", t + [f"{full[r]}:{text}"]))
        cells = inserts(after)
    return min(cells[s] for s in ("", "a") if s in cells)


def expected(rows):
    out = []
    for conv_id, turns in damaged(rows).items():
        found, numbers = faults(turns), {t for t, *_ in turns if t is not None}
        cost, audit, left = table(turns)
        roles = [r[:1] for _, r, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        out.append((conv_id, gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS present", "2 AS digest", "3 AS kind")


def check(spark, rows):
    broken = conv.damage(frame(spark, rows))
    found = sorted((tuple(r) for r in conv.audit_conversations(broken).collect()), key=repr)
    assert found == expected(rows)
    return broken, found


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    broken, found = check(spark, rows)
    turns = {}
    for r in sorted(conv.repair_conversations(broken).collect(), key=lambda r: (str(r["conv_id"]), r["place"])):
        turns.setdefault(r["conv_id"], []).append(r)
    for conv_id, *_, digest in found:
        left = turns.get(conv_id, [])
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in left).encode()).hexdigest() == digest
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in left))
        assert [r["place"] for r in left] == list(range(len(left)))


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed, monkeypatch):
    """Also with blocks of a few turns, which change nothing."""
    deal = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", None, "", "ua"], ["Yes.", "No!", "open", " ", "", None, "é?", "Yes.\n", "x" * 50]
    rows = [(c, deal.choice([None, *range(12)]) if c % 3 else t, deal.choice(roles[: 2 + c % 6]), deal.choice(texts)) for c in range(60) for t in range(deal.randint(0, 14))]
    rows += rows[:20] + [(None, 1, "user", "Hi."), (None, 2, None, None)]
    check(spark, rows)


def test_blocks_change_nothing(monkeypatch):
    deal = random.Random(9)
    for _ in range(300):
        turns = [(deal.choice(["user", "assistant", "system", "x"]), f"{i}", deal.randint(0, 3)) for i in range(deal.randint(0, 12))]
        seen = []
        for block in (1, 3, 100):
            paths, audit = {0: conv.Path()}, ""
            parts = [turns[i : i + block] for i in range(0, len(turns), block)] or [[]]
            for i, part in enumerate(parts):
                paths = conv.search(part, paths, i == len(parts) - 1)
            (path,) = paths.values()
            seen.append((path.cost, path.audit, path.digest.hexdigest()))
        assert len(set(seen)) == 1


def test_against_every_edit():
    """All words of edits with up to three inserts, for short conversations."""
    deal = random.Random(4)
    for _ in range(40):
        turns = [(deal.choice(["user", "assistant", "system"]), f"{i}", deal.randint(0, 3)) for i in range(deal.randint(0, 4))]
        best = None
        for size in range(len(turns), len(turns) + 4):
            for word in product("DIKR", repeat=size):
                if size - word.count("I") != len(turns):
                    continue
                rest, state, cost = iter(turns), 0, 0
                for letter in word:
                    role, _, fault = ("", "", 0) if letter == "I" else next(rest)
                    if letter == "D":
                        cost += 2
                        continue
                    to = role[:1] if letter == "K" else next((r for r in conv.LEADS[state] if r in "ua"), "")
                    if fault in (1, 2) or to not in conv.LEADS[state]:
                        break
                    cost += {"K": 0, "R": 1, "I": 5}[letter] + 5 * (fault == 3)
                    state = conv.LEADS[state][to]
                else:
                    if state in (0, 3):
                        best = min(best or (9**9, ""), (cost, "".join(word)))
        (path,) = conv.search(turns, {0: conv.Path()}, True).values()
        assert (path.cost, path.audit) == best


def test_long_conversation_and_no_rows(spark):
    """Over many blocks, with one text beyond what a block holds; ties and repeated rows."""
    deal = random.Random(1)
    rows = [(7, i // 2 if i % 50 == 0 else i, deal.choice(["user", "assistant"]), f"Turn {i % 700}.") for i in range(3000)] + [(7, 5, "user", "long " * 900_000 + ".")] + [(8, 1, "user", "Same.")] * 400
    check(spark, rows)
    assert conv.audit_conversations(conv.damage(frame(spark, []))).collect() == []
