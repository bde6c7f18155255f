"""Line-first cleaning: rules for each line, then for what is left of the document."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ODD_SPACE, bounded_batches, text_or_empty

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, n_removed_lines long, lost_chars long, clean_text string"
)
WORD = re.compile("[^\x20\x09-\x0d]+")
SYMBOLS = "#*$%&|<>"
#: Phrases, in lower case, of lines that belong to a page and not to its text.
PHRASES = (
    "all rights reserved", "licensed under", "released under the", "general public license", "copyright (c)", "©", "terms of use", "terms of service", "privacy policy",
    "cookie policy", "cookie settings", "accept cookies", "accept all cookies", "subscribe to our", "sign in to", "sign in for", "sign up to", "sign up for", "click here",
    "enable javascript", "share on facebook", "share on twitter",
    "tous droits réservés", "mentions légales", "politique de confidentialité", "conditions d'utilisation", "conditions d’utilisation", "accepter les cookies",
    "accepter tous les cookies", "cliquez ici", "abonnez-vous à", "se connecter",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "impressum", "cookies akzeptieren", "hier klicken", "newsletter abonnieren", "jetzt anmelden",
    "todos los derechos reservados", "política de privacidad", "términos de uso", "términos y condiciones", "aviso legal", "aceptar cookies", "aceptar las cookies",
    "aceptar todas las cookies", "haga clic aquí", "suscríbase a", "iniciar sesión",
)
WORDS_IN = {p: len(p.split()) for p in PHRASES}
#: A line is boilerplate if one of so many of its words, or more, is in such a phrase.
SHARE = 15
NAVIGATION = re.compile(r"(?:^|\s)[|»›•·>](?=\s|$)")
SHOUT = re.compile(r"!{2,}(?=\s|$)")
NOISE = re.compile(r"([#*$%&|<>~^=_+\\])\1+(?=\s|$)")
LETTER = re.compile(r"[^\W_]")
ENDING = re.compile(r"[.!?…:;\"'”’»)\]。！？]\s*$")


def words_of(text: str) -> list[str]:
    return WORD.findall(text) if ODD_SPACE.search(text) else text.split()


def repeated_words(words: list[str], window: int = 5) -> int:
    """Words that lie in a window of ``window`` words found twice or more; exact.

    Windows get numbers by the pair of the numbers of their beginning and their last word.
    """
    if len(words) <= window:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    n, last = len(number), len(ids) - window + 1
    codes = ids[:last]
    for k in range(1, window):
        codes = _pairs(codes, ids[k : last + k], n)
    codes = np.unique(codes, return_inverse=True)[1]
    again = np.bincount(codes)[codes] > 1
    if not again.any():
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def _pairs(codes: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the pairs; kept as products while these fit 62 bits."""
    if (int(codes.max()) + 1) * n < 2**62 // n:
        return codes * n + ids
    return np.unique(codes * n + ids, return_inverse=True)[1]


def phrases_of(text: str) -> list[str]:
    """The phrases that a text has: few have any, so that lines needn't look for all."""
    low = text.lower()
    return [p for p in PHRASES if p in low]


def line_fails(line: str, words: list[str], phrases: list[str]) -> str | None:
    """The rule that a line with words fails, or None; ``phrases`` are those to look for."""
    if phrases:
        low = line.lower()
        inside = sum(low.count(p) * WORDS_IN[p] for p in phrases)
        if inside and SHARE * inside >= len(words):
            return "boilerplate"
    if 5 * len(NAVIGATION.findall(line)) >= len(words):
        return "navigation"
    n = len(words)
    if not LETTER.search(line) or 10 * len(SHOUT.findall(line)) >= 3 * n or 10 * len(NOISE.findall(line)) >= 3 * n:
        return "punctuation"
    if not ENDING.search(line) and n <= 3:
        return "punctuation"
    return None


def clean(text: str, most_lost: float = 0.5) -> tuple:
    """The columns of SCHEMA after the id, for one text."""
    words = words_of(text)
    n_words, word_chars = len(words), sum(map(len, words))
    n_symbols = sum(map(text.count, SYMBOLS))
    n_repeat = repeated_words(words)
    base_failed = n_words < 10 or 100 * n_repeat > 20 * n_words
    seen: set[str] = set()
    dup = removed = lines = lost = 0
    left, phrases = [], phrases_of(text)
    for line in text.split("\n"):
        own = words_of(line)
        if not own:
            left.append(line)
            continue
        lines += 1
        if line in seen:
            dup += 1
        seen.add(line)
        if line_fails(line, own, phrases):
            removed += 1
            lost += sum(map(len, own))
        else:
            left.append(line)
    kept = not base_failed and lost <= most_lost * word_chars
    return n_words, word_chars, n_symbols, dup, n_repeat, base_failed, kept, lines, removed, lost, "\n".join(left)


def clean_documents(docs: DataFrame, most_lost: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Cleans every whole text line by line and judges what is left of it.

    Each ``\\n``-split line with a word faces the rules: boilerplate phrases (one of 15 words in one, or more); navigation (a
    separator for every five words or fewer); punctuation (no letter or digit at all, three
    of ten words shouted or followed by runs of symbols, or up to three words without an
    end mark). Lines that fail are removed. A document is rejected if it fails the base
    rules (under 10 words, or over 20 % of its words in repeated windows of five), or if
    the removed lines hold more than ``most_lost`` of its word characters. ``clean_text``
    is the text without them.

    A null text counts as empty: no words, so it is rejected. Repeated rows are judged each
    for itself; an empty table gives no rows; other columns are ignored. No shuffle.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = zip(*(f.split() for f in SCHEMA.split(", ")))
        arrow = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
        for batch in batches:
            rows = [clean(t, most_lost) for t in batch.column(1).to_pylist()]
            columns = list(zip(*rows)) if rows else [()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, arrow[k]) for c, k in zip(columns, kinds[1:]))], names=list(names))

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(run, SCHEMA)
