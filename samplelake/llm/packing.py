"""Packing of token sequences into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_or_empty, tokenizer_path

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Latin letters that lower-case one by one and are composed, then marks without an
#: apostrophe, which could begin a contraction.
SIMPLE = "\\A(?P<stem>[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)(?P<tail>[!-&(-/:;=?@\\[-`{}~]*)\\z"


class WordCache:
    """Ids of whole texts, through the ids of their parts between ASCII white space.

    The tokenizer's patterns never match across white space, nor does its normaliser
    compose across it, so a text's ids are its parts' ids in order. A part of Latin letters
    and a tail of marks is likewise its lower-cased letters' ids and its tail's, and these
    two are kept, not the part. What is new goes to the library once while it is kept. Kept
    parts are in two generations of at most ``room`` bytes: a full one becomes the older, whose parts return when they are met
    again and are forgotten otherwise. The library stays in the worker, parts until the
    end of a task.
    """

    _of: ClassVar[dict[tuple[str, int], WordCache]] = {}
    #: Bytes of an entry beside its characters and ids: two objects and their place.
    ENTRY = 200

    @classmethod
    def of(cls, path: str, room: int) -> WordCache:
        if (path, room) not in cls._of:
            cls._of[path, room] = cls(path, room)
        return cls._of[path, room]

    def __init__(self, path: str, room: int) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.room = Tokenizer.from_file(path), room
        self.library.no_truncation()
        self.library.no_padding()
        self.forget()

    def forget(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def get(self, part: str) -> bytes | None:
        """What is kept, from either generation; it is young again."""
        ids = self.young.get(part)
        if ids is None and (ids := self.old.get(part)) is not None:
            self.keep(part, ids)
        return ids

    def keep(self, part: str, ids: bytes) -> None:
        if len(part) > 64:
            return
        self.young[part] = ids
        self.held += self.ENTRY + len(part) + len(ids)
        if self.held > self.room:
            self.young, self.old, self.held = {}, self.young, 0

    def ask(self, parts: list[str]) -> dict[str, bytes]:
        """The library's ids of each part; many go to it as one text."""
        out: dict[str, bytes] = {}
        for i in range(0, len(parts), 200):
            some = parts[i : i + 200]
            joined = self.library.encode(" ".join(some), add_special_tokens=False)
            cuts = np.searchsorted([x[0] for x in joined.offsets], np.cumsum([len(p) + 1 for p in some]))
            raw, at = np.array(joined.ids, "<u4").tobytes(), 0
            for part, cut in zip(some, (4 * cuts).tolist()):
                out[part] = raw[at:cut]
                at = cut
        return out

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers.

        Arrow splits the batch, numbers its distinct parts, divides these into stems and
        tails, and puts ids in order; Python sees each distinct stem or tail once.
        """
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        parts = coded.dictionary
        cut = pc.extract_regex(parts, SIMPLE)
        simple = cut.is_valid()
        stems = pc.if_else(simple, pc.utf8_lower(pc.struct_field(cut, "stem")), parts)
        tails = pc.if_else(simple, pc.struct_field(cut, "tail"), pa.scalar("", parts.type))
        pieces = pa.concat_arrays([stems, tails]).dictionary_encode()
        names = pieces.dictionary.to_pylist()
        found = [self.get(p) if ids is None else ids for p, ids in zip(names, map(self.young.get, names))]
        fresh = self.ask([p for p, ids in zip(names, found) if ids is None and p])
        for piece, ids in fresh.items():
            self.keep(piece, ids)
        fresh[""] = b""
        found = [fresh[p] if ids is None else ids for p, ids in zip(names, found)]

        own = pa.array(found, pa.large_binary()).take(pieces.indices)
        whole = pc.binary_join_element_wise(own[: len(parts)], own[len(parts) :], pa.scalar(b"", pa.large_binary()))
        words = whole.take(coded.indices)
        ends = np.cumsum(pc.binary_length(words).to_numpy())
        ids = memoryview(words.buffers()[2] or b"")
        bounds = np.concatenate([[0], ends])[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        for a, b in zip(bounds, bounds[1:]):
            yield bytes(ids[a:b])


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Multiway largest differencing: ``ways`` lists of indices with near-equal sums.

    Starts with a partial partition for each size and always merges the two with the
    largest imbalance, the heaviest part of one with the lightest of the other.
    """
    if ways == 1:
        return [list(range(len(sizes)))]
    empty: list[int] = []
    heap = []
    for i, size in enumerate(sizes):
        loads = np.zeros(ways, np.int64)
        loads[0] = size
        heap.append((-size, i, loads, [[i]] + [empty] * (ways - 1)))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, key, a, left = heapq.heappop(heap)
        _, _, b, right = heapq.heappop(heap)
        loads = a + b[::-1]
        order = np.argsort(-loads, kind="stable")
        loads = loads[order]
        loads -= loads[-1]
        merged = [x + y if x and y else x or y for x, y in zip(left, reversed(right))]
        heapq.heappush(heap, (-int(loads[0]), key, loads, [merged[j] for j in order]))
    return heap[0][3] if heap else [[] for _ in range(ways)]


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``: as few as the total needs, then one more at a time
    for as long as differencing exceeds the capacity. No size may exceed it."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = differencing(sizes, ways)
        if max((sum(sizes[i] for i in w) for w in windows), default=0) <= capacity:
            return [w for w in windows if w]
        ways += 1


def pack_documents(
    docs: DataFrame,
    tokenizer: str | None = None,
    capacity: int = 4096,
    end_id: int = 2,
    piece: int = 512,
    windows: int = 32,
    slack: float = 0.005,
    cache_bytes: int = 40 << 20,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Packs every document into sequences of at most ``capacity`` tokens.

    A document is its ids by the tokenizer, then ``end_id``; null text counts as empty.
    It is cut into full windows, and its rest into parts of at most ``piece`` tokens. Each
    task packs its own documents: it gathers parts for ``windows`` windows, less ``slack``
    of their room, and lets Karmarkar-Karp differencing spread them. What is left at a
    task's end fills whole windows too, and the last few tokens go to sequences whose
    lengths are powers of two, which need no padding. No shuffle; a task holds the parts
    of one group of windows, and ``cache_bytes`` of encoded parts twice. Sequence ids hold the partition's number, so a task that runs
    again gives the same rows. Repeated rows are packed each for itself; an empty table
    gives no rows; other columns are ignored.
    """
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    bounded_batches(docs.sparkSession)
    room = int(windows * capacity * (1 - slack))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache.of(path, cache_bytes)
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 40
        end = np.array([end_id], "<u4").tobytes()
        rows: list[tuple] = []
        waiting: list[tuple] = []
        held = 0

        def place(window: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for one in window:
                rows.append((*one, sequence, offset))
                offset += one[2]
            sequence += 1

        def cut(key, ids: bytes, a: int, b: int) -> tuple:
            return key, a, b - a, zlib.crc32(memoryview(ids)[4 * a : 4 * b]), len(ids) // 4

        def close(group: list[tuple]) -> None:
            for window in pack([x[2] for x in group], capacity):
                place([group[i] for i in window])

        def flush() -> pa.RecordBatch:
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 7)], names=names)
            rows.clear()
            return out

        sources: list[tuple] = []  # of waiting parts: their ids, while a last cut may still fall into them
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for key, ids in zip(keys, cache.encode(batch.column(1))):
                ids += end
                at, n = 0, len(ids) // 4
                while n - at >= capacity:
                    place([cut(key, ids, at, at + capacity)])
                    at += capacity
                while at < n:
                    size = min(piece, n - at, room - held)
                    waiting.append(cut(key, ids, at, at + size))
                    sources.append((ids, at))
                    held += size
                    at += size
                    if held == room:
                        close(waiting)
                        waiting, sources, held = [], [], 0
            yield flush()
        # the rest: whole windows first, then powers of two
        whole = held // capacity * capacity
        whole = int(whole * (1 - slack)) if whole else 0
        group: list[tuple] = []
        rest: list[tuple] = []
        for one, (ids, at) in zip(waiting, sources):
            fits = min(one[2], whole)
            if fits:
                group.append(cut(one[0], ids, at, at + fits))
                whole -= fits
            if fits < one[2]:
                rest.append((one[0], ids, at + fits, at + one[2]))
        if group:
            close(group)
        left = sum(b - a for _, _, a, b in rest)
        while left:
            size = min(capacity, 1 << (left.bit_length() - 1))
            left -= size
            window = []
            while size:
                key, ids, a, b = rest[0]
                take = min(size, b - a)
                window.append(cut(key, ids, a, a + take))
                size -= take
                rest[0] = (key, ids, a + take, b)
                if a + take == b:
                    rest.pop(0)
            place(window)
        cache.forget()
        yield flush()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(run, SCHEMA)
