"""Repair of conversation structure by cheapest edits: Dijkstra over turns and grammar states."""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, staged

SPACE = " \t\n\v\f\r"
NAMES = {"u": "user", "a": "assistant"}
#: The grammar (s?(ua)+)?: where each initial leads from nothing, a system turn, a user's
#: and an assistant's. A conversation may end at nothing or after an assistant.
LEADS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTING = (0, 3)
LEGAL = ("su", "ua", "au")
RIGHT, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Costs of edits; an undeleted truncated turn costs CUT more.
DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5
#: Turns, and characters, of a conversation that a task holds at a time.
BLOCK, HELD = 256, 4_000_000
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
REPAIRED = "conv_id long, place long, turn long, role string, text string, edit string"


@dataclass
class Path:
    """The cheapest way to one grammar state at a block's end."""

    cost: int = 0
    audit: str = ""
    digest: object = field(default_factory=hashlib.sha256)
    begun: bool = False

    def then(self, cost: int, audit: str, turns: list[tuple[str, str]]) -> Path:
        out = Path(cost, audit, self.digest.copy(), self.begun)
        for role, text in turns:
            out.digest.update((("\n" if out.begun else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            out.begun = True
        return out


def edits(state: int, initial: str, fault: int) -> Iterator[tuple[str, int, int, str | None]]:
    """Letter, cost, next state and the new role (None: no turn is left) of what may become
    of a turn."""
    yield "D", DELETE, state, None
    if fault in (BLANK, DUPLICATE):
        return
    more = CUT if fault == TRUNCATED else 0
    if initial in LEADS[state]:
        yield "K", more, LEADS[state][initial], ""
    for role in LEADS[state]:
        if role in NAMES:
            yield "R", REROLE + more, LEADS[state][role], NAMES[role]


def search(turns: list[tuple[str, str, int]], sources: dict[int, Path], last: bool) -> dict[int, Path]:
    """Dijkstra from the sources over (turn, state), least (cost, audit) first.

    The last block ends with the first accepting end that is popped; another, when its ends
    have been popped in each state that can be reached. Ways to one node with equal costs
    never have audits that begin each other, as what one has more would cost more; so what
    is least here stays least whatever follows, and blocks give what one search would.
    """
    heap = [(p.cost, p.audit, 0, s) for s, p in sources.items()]
    heapq.heapify(heap)
    before: dict[tuple[int, int], tuple] = {}
    came: dict[tuple, tuple] = {(0, s, p.audit): None for s, p in sources.items()}
    ends: dict[int, tuple[int, str]] = {}
    size = len(turns)
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in before:
            continue
        before[i, state] = came[i, state, audit]
        if i == size and (not last or state in ACCEPTING):
            ends[state] = cost, audit
            if last:
                break
            continue
        steps = [("I", INSERT, i, to, NAMES[r]) for r, to in LEADS[state].items() if r in NAMES]
        if i < size:
            role, _, fault = turns[i]
            steps += [(letter, more, i + 1, to, new) for letter, more, to, new in edits(state, role[:1], fault)]
        for letter, more, at, to, new in steps:
            if (at, to) not in before:
                came.setdefault((at, to, audit + letter), (i, state, letter, new))
                heapq.heappush(heap, (cost + more, audit + letter, at, to))
    out = {}
    for state, (cost, audit) in ends.items():
        kept, node = [], (size, state)
        while before[node] is not None:
            i, old, letter, new = before[node]
            if letter == "I":
                kept.append((new, ""))
            elif letter != "D":
                kept.append((new or turns[i][0], turns[i][1]))
            node = i, old
        out[state] = sources[node[1]].then(cost, audit, kept[::-1])
    return out


class Conversation:
    """Reads one conversation's turns in order; holds a block and a path for each state."""

    def __init__(self) -> None:
        self.turns: list[tuple[str, str, int]] = []
        self.held = 0
        self.paths = {0: Path()}
        self.audit: list[str] = []
        self.faults = [0] * 4
        self.illegal = self.numbers = 0
        self.least = self.most = self.initial = None

    def add(self, turn: int | None, role: str, text: str, first: bool) -> None:
        if len(self.turns) >= BLOCK or self.held > HELD:
            self.settle(last=False)
        if turn is not None and turn != self.most:
            self.numbers += 1
            self.least, self.most = turn if self.least is None else self.least, turn
        end = text.rstrip(SPACE)
        fault = BLANK if not end else DUPLICATE if not first else RIGHT if end[-1] in ".!?" else TRUNCATED
        self.faults[fault] += 1
        self.illegal += self.initial is not None and self.initial + role[:1] not in LEGAL
        self.initial = role[:1]
        self.turns.append((role, text, fault))
        self.held += len(text)

    def settle(self, last: bool) -> None:
        self.paths = search(self.turns, self.paths, last)
        shared = os.path.commonprefix([p.audit for p in self.paths.values()])
        self.audit.append(shared)
        for path in self.paths.values():
            path.audit = path.audit[len(shared) :]
        self.turns, self.held = [], 0

    def report(self) -> tuple:
        self.settle(last=True)
        (path,) = self.paths.values()
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.numbers
        return gaps, *self.faults[1:], self.illegal, path.cost, "".join(self.audit), path.digest.hexdigest()


def damage(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, present): damaged rows, by crc32 of ``conv_id:turn``
    modulo 20. A dropped row is there with present false, so that its conversation is."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(spaced(conv_id), F.lit(":"), spaced(turn)).cast("binary")) % 20
    new = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(spaced(text), "[.!?]", "")).otherwise(spaced(text))
    copies = F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return conversations.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.when(fault == 4, "user").otherwise(spaced(role)).alias("role"), new.alias("text"),
        (fault != 0).alias("present"), F.explode(copies).alias("copy"),
    ).drop("copy")


#: Turns in order, nulls first; those of one number by role and then the text's digest.
ORDER = ("conv_id", "numbered", "turn", "role", "digest", "kind")


def _stream(rows: DataFrame, extra: DataFrame) -> DataFrame:
    """Rows and ``extra`` ones of each conversation in one task, sorted: a row's mark of kind
    0 comes right before it."""
    return rows.unionByName(extra, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions(*ORDER)


def _keyed(rows: DataFrame) -> DataFrame:
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    return rows.select("conv_id", F.col("turn").isNotNull().alias("numbered"), "turn", "role", "text", "present", digest.alias("digest"), F.lit(1).alias("kind"))


def _conversations(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    rows = (row for batch in batches for row in zip(*(batch.column(n).to_pylist() for n in names)))
    return groupby(rows, key=lambda r: r[0])


def _batches(found: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in found:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= 1024 or size > HELD:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(f.split()[0], {"long": pa.int64(), "string": pa.string()}[f.split()[1]]) for f in ddl.split(", ")])


def audit_conversations(rows: DataFrame) -> DataFrame:
    """For each conversation its gaps and faults, the cheapest edits that make its roles
    ``(s?(ua)+)?``, their cost, and the digest of what they leave.

    ``rows`` are as :func:`damage` gives them. Keep costs 0, Rerole 1, Delete 2 (a blank turn
    or a duplicate must go), Insert 5, an undeleted truncated turn 5 more; of the cheapest
    the least initials in ASCII win. The first places of equal turns are found by partial
    aggregation and come as narrow rows that sort right before them, so copies gather
    nowhere. A conversation's turns pass through one task in order, as its digest is one
    chain; the task holds a block of 256 turns, a path for each of four states, and the audit.

    Nulls are one blank by then, a null conv_id is a conversation; turns without a number come
    first; those of one number are ordered by role and digest; a role that is empty can't be
    kept. A conversation without rows has zeros, an empty audit and the empty text's digest.
    No rows give none. Very long texts are held one block, 4 MB or a text, at a time.
    """
    bounded_batches(rows.sparkSession)
    keyed = _keyed(rows)
    first = keyed.filter("present").groupBy("conv_id", "role", "digest").agg(F.min(F.struct("numbered", "turn")).alias("at"))
    marks = first.select("conv_id", "at.*", "role", "digest", F.lit(0).alias("kind"), F.lit(True).alias("present"))
    schema = _schema(REPORT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for conv_id, turns in _conversations(batches, "conv_id", "kind", "present", "turn", "role", "digest", "text"):
                conversation, mark = Conversation(), None
                for _, kind, present, turn, role, digest, text in turns:
                    if kind == 0:
                        mark = turn, role, digest
                    elif present:
                        conversation.add(turn, role, text, mark == (turn, role, digest))
                        mark = None
                yield conv_id, *conversation.report()

        return _batches(found(), schema)

    return _stream(keyed, marks).mapInArrow(run, REPORT)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """The repaired turns themselves: conv_id, place (from 0), turn (null where inserted),
    role, text, edit. Each conversation's audit, staged, comes as a row before its turns and
    is carried out as they pass, so that a task holds one turn at a time."""
    audits = staged(audit_conversations(rows).select("conv_id", "audit"), "audits")
    script = audits.select("conv_id", F.col("audit").alias("text"), F.lit(False).alias("numbered"), F.lit(0).alias("kind"), F.lit(True).alias("present"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("digest"))
    schema = _schema(REPAIRED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for conv_id, turns in _conversations(batches, "conv_id", "kind", "present", "turn", "role", "text"):
                rest = ((turn, role, text) for _, kind, present, turn, role, text in turns if kind and present)
                # The script sorts first: no number, and no role where others have one.
                _, _, _, _, _, audit = next(turns)
                state = place = 0
                for letter in audit:
                    turn, role, text = (None, None, "") if letter == "I" else next(rest)
                    if letter == "D":
                        continue
                    if letter != "K":
                        role = next(NAMES[r] for r in LEADS[state] if r in NAMES)
                    state = LEADS[state][role[:1]]
                    yield conv_id, place, turn, role, text, letter
                    place += 1

        return _batches(found(), schema)

    return _stream(_keyed(rows), script).mapInArrow(run, REPAIRED)
