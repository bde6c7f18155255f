"""URL rules indexed by their rarest literal token."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

SCHEMA = "page_id long, host string, path string, rule string, verdict string, pattern string"
TOKEN = re.compile(rb"[a-z0-9]+")
UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """``host/path`` rules fit a host with its subdomains and a path's beginning; of these
    the longest wins. Patterns are tried where none fits: ``||`` is a domain's beginning,
    ``^`` a separator or the end, ``*`` anything; blocking wins among them."""

    text: str
    verdict: str
    is_pattern: bool = False

    def regex(self) -> str:
        """Over host + tab + path."""
        if not self.is_pattern:
            host, _, path = self.text.partition("/")
            return rf"(?:[^\t]*\.)?{re.escape(host)}\t/{re.escape(path)}"
        start, body = ("(?:[^\\t]*\\.)?", self.text[2:]) if self.text.startswith("||") else (".*", self.text)
        parts = {"*": ".*", "^": r"(?:[^A-Za-z0-9_.%-]|$)"}
        return start + "".join(parts.get(c) or re.escape(c) for c in body)

    def literals(self) -> list[str]:
        """Tokens that every url the rule fits must have: runs of letters and digits with a
        separator on either side. Tokens of a pattern's open ends don't count."""
        if not self.is_pattern:
            return [t.decode() for t in TOKEN.findall(self.text.partition("/")[0].encode().translate(UPPER))]
        anchored = self.text.startswith("||")
        body = self.text[2:] if anchored else self.text
        found = []
        for m in re.finditer("[A-Za-z0-9]+", body):
            left = anchored if m.start() == 0 else body[m.start() - 1] != "*"
            right = m.end() < len(body) and body[m.end()] != "*"
            if left and right:
                found.append(m[0].lower())
        return found


#: The listed rules.
LISTED = (
    Rule("net/", "block"),
    Rule("example.net/en/", "allow"),
    Rule("example.com/de/", "block"),
    Rule("org/fr/", "allow"),
)
#: Patterns of hosts and paths that carry no text worth training on.
PATTERNS = tuple(
    Rule(p, "block", True)
    for p in (
        "||spam-*", "||*spam-farm.", "||cheap-pills.", "||*.cheap-pills.", "||casino.", "-casino.", ".casino^", "||viagra.", "-viagra-", "||free-money.",
        "||click-bait.", "||porn.", ".xxx^", "||adult.", "-adult-", "||ads.", "||adserver.", "||tracker.", "/wp-login.", "/cgi-bin/", "/logout^", "/signin^",
    )
)


class RuleIndex:
    """Rules by their rarest literal; those without one run on every url."""

    def __init__(self, rules: Sequence[Rule], counts: dict[str, int]) -> None:
        self.by_token: dict[bytes, list[tuple]] = defaultdict(list)
        self.always: list[tuple] = []
        for rule in rules:
            entry = (rule, re.compile(rule.regex(), re.DOTALL))
            literals = rule.literals()
            if literals:
                self.by_token[min(literals, key=lambda t: (counts.get(t, 0), -len(t), t)).encode()].append(entry)
            else:
                self.always.append(entry)

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, str | None]:
        """host, path, the listed rule or null, the verdict, the pattern or null."""
        host, path = split_url(url)
        target = f"{host}\t{path}"
        candidates = list(self.always)
        for token in set(TOKEN.findall(target.encode("utf-8", "replace").translate(UPPER))):
            candidates += self.by_token.get(token, ())
        fits = [rule for rule, regex in candidates if regex.match(target)]
        if listed := [r for r in fits if not r.is_pattern]:
            best = max(listed, key=lambda r: (len(r.text), r.text))
            return host, path, best.text, best.verdict, None
        blocking = sorted(r.text for r in fits if r.verdict == "block")
        allowing = sorted(r.text for r in fits if r.verdict == "allow")
        return host, path, None, "block" if blocking else "allow", (blocking or allowing or [None])[0]


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def token_frequencies(pages: DataFrame, tokens: Sequence[str], url: str) -> dict[str, int]:
    """How many urls have each of the rules' tokens; as many rows as the rules have tokens."""
    if not tokens:
        return {}
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.col(url)), F.lit("([a-z0-9]+)")))
    rows = pages.select(F.explode(found).alias("token")).filter(F.col("token").isin(*tokens)).groupBy("token").count().collect()
    return {r["token"]: r["count"] for r in rows}


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = LISTED + PATTERNS, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Judges every url by the rules whose rarest literal token it has.

    A rule's literals are counted over all urls, and the rarest indexes it. A url's tokens
    fetch candidate rules; only those run their regular expressions. The rules come from
    the driver with the function itself, so their number is bounded by what it holds; the
    urls are not shuffled (the count has a row for each literal).

    A null url, or one without ``://``, has an empty host and path, fits no listed rule and
    is allowed. Hosts are lower-cased (A-Z), paths compared as they are. Repeated rows are
    judged each for itself; an empty table gives no rows; other columns are ignored.
    """
    bounded_batches(pages.sparkSession)
    counts = token_frequencies(pages, sorted({t for r in rules for t in r.literals()}), url)
    rules = tuple(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(rules, counts)
        for batch in batches:
            rows = [index.judge(u) for u in batch.column(1).to_pylist()]
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url")).mapInArrow(run, SCHEMA)
