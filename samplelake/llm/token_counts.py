"""Token counts of whole texts; huge ones by overlapping chunks that are resynchronised."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_or_empty, tokenizer_path

#: A blank between two characters that aren't white space: a byte-level tokenizer of this
#: kind starts a new pre-token there, whatever stands around it.
CUT = re.compile(r"(?<=\S) (?=\S)")
ODD_BLANK = re.compile(r" \s|\s ")


def boundaries(encoding) -> dict[int, int]:
    """Pre-token starts: their place in the text and the number of tokens before."""
    words, spans = encoding.word_ids, encoding.offsets
    return {spans[i][0]: i for i in range(len(words)) if i == 0 or words[i] != words[i - 1] or words[i] is None}


def resynchronised(library, text: str, chunk: int, overlap: int, margin: int) -> tuple[int, int]:
    """The number of tokens of ``text``, and how often an overlap had to be widened.

    Chunks of ``chunk`` characters overlap by ``overlap``. The pre-tokenizer reads from left
    to right and never looks back, so what follows a pre-token's start depends on the text
    from there on alone. A start found by the left chunk is true unless the chunk's end is
    within reach: it counts only with ``margin`` characters and another start after it. If
    the right chunk has a start at the same place, both agree from there on, and they are
    spliced. If the overlap has no such place, the right chunk begins earlier and the left
    one ends later, by twice as much each time, up to the whole text.
    """
    total, at, widened = 0, 0, 0
    while True:  # ``at`` is a true start
        reach, back = chunk, overlap
        while True:
            end = min(len(text), at + reach)
            left = library.encode(text[at:end], add_special_tokens=False)
            if end == len(text):
                return total + len(left.ids), widened
            starts = boundaries(left)
            begin = max(at, end - back)
            right = boundaries(library.encode(text[begin : min(len(text), end + back)], add_special_tokens=False))
            last = max(starts)
            common = [p for p in starts if p < last and at + p >= begin and at + p + margin <= end and p > 0 and at + p - begin in right]
            if common:
                total += starts[max(common)]
                at += max(common)
                break
            widened += 1
            reach, back = reach + back, back * 2


def count_tokens(
    docs: DataFrame,
    tokenizer: str | None = None,
    limit: int = 512,
    huge: int = 32_768,
    chunk: int = 16_384,
    overlap: int = 512,
    cache_entries: int = 1_000_000,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Counts the tokens of every whole text as the tokenizer's library does, without
    begin, end or padding; special strings inside texts are special tokens, its default.

    Texts over ``huge`` characters go through :func:`resynchronised`. Others are cut at
    blanks between two other characters, where pre-tokens always begin; each part goes to
    the library once while no more than about ``cache_entries`` are kept. A null text
    counts as empty, with 0 bytes and tokens; repeated rows are counted each for itself; an
    empty table gives no rows; other columns are ignored. No shuffle; a task holds a batch.
    """
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    bounded_batches(docs.sparkSession, 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        margin = 2 + max([0, *(len(x.content) for x in library.get_added_tokens_decoder().values())])
        known: dict[str, int] = {}

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            split = [None if len(t) > huge else CUT.split(t) if ODD_BLANK.search(t) else t.split(" ") for t in texts]
            # a text that begins or ends with a blank must not be cut there
            split = [s if s is None or (s[0] and s[-1]) or len(s) == 1 else CUT.split(t) for s, t in zip(split, texts)]
            found = [s and list(map(known.get, s[1:])) for s in split]
            new = list({p for s, ns in zip(split, found) if s and None in ns for p, n in zip(s[1:], ns) if n is None})
            fresh: dict[str, int] = {}
            for i in range(0, len(new), 200):
                some = new[i : i + 200]
                starts = [x[0] for x in library.encode("".join([" " + p for p in some]), add_special_tokens=False).offsets]
                cuts = np.searchsorted(starts, np.cumsum([len(p) + 1 for p in some]))
                fresh.update(zip(some, np.diff(cuts, prepend=0).tolist()))
            firsts = iter([len(x) for x in library.encode_batch_fast([s[0] for s in split if s], add_special_tokens=False)])
            counts = []
            for s, ns, t in zip(split, found, texts):
                if s is None:
                    counts.append(resynchronised(library, t, chunk, overlap, margin)[0])
                else:
                    counts.append(next(firsts) + sum(ns if None not in ns else [fresh[p] if n is None else n for p, n in zip(s[1:], ns)]))
            if len(known) < cache_entries:
                known.update((p, n) for p, n in fresh.items() if len(p) <= 64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), batch.column(2), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return chosen.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
