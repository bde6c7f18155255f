"""Secrets by listed forms and by a battery of randomness tests, with SQL functions only."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, text_or_empty

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs end where no symbol follows, so their least lengths may stand in the patterns.
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"
#: Shortest value of an assignment. A shorter one still takes its place in the text.
VALUE = 12
TOKEN = "[A-Za-z0-9+/_-]{16,}={0,2}"
#: Tokens that a listed form finds already.
FOUND = f"{ACCESS}|{HEX}"
KINDS = ("assign", "access", "hex", "random")

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings by what their symbols match, the narrowest first, with the symbols in order.
ENCODINGS = (
    ("[0-9]+", DIGITS),
    ("[0-9a-f]+", DIGITS + LOWER[:6]),
    ("[0-9A-F]+", DIGITS + UPPER[:6]),
    ("[a-z]+", LOWER),
    ("[A-Z]+", UPPER),
    ("[A-Z2-7]+", UPPER + DIGITS[2:8]),
    ("[0-9a-z]+", DIGITS + LOWER),
    ("[0-9A-Z]+", DIGITS + UPPER),
    ("[A-Za-z]+", UPPER + LOWER),
    ("[A-Za-z0-9]+", UPPER + LOWER + DIGITS),
    ("[A-Za-z0-9+/]+", UPPER + LOWER + DIGITS + "+/"),
    ("[A-Za-z0-9_-]+", UPPER + LOWER + DIGITS + "-_"),
    ("[A-Za-z0-9+/_-]+", UPPER + LOWER + DIGITS + "+/-_"),
)
#: Lower ends of the length classes; false discoveries are controlled in each for itself.
LENGTHS = (16, 20, 24, 32, 48, 96)
#: Standard deviations that each of the three two-sided tests allows: 0.001 for all together.
GATE = 3.588
#: A p-value p is in bin floor(-20 log10 p), the last one open.
BINS = 600
#: The coefficients of the usual polynomial for a normal tail.
TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
#: Prefix sums go over runs of so many elements.
RUN = 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, also where inner functions use it."""
    return F.transform(F.array(value), body)[0]


def added_up(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x)


def running(values: Column) -> Column:
    """Prefix sums of an array: over whole runs of it, then within the element's own."""
    run = F.lit(RUN)
    return let(
        values,
        lambda v: let(
            F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / run).cast("int")), lambda j: added_up(F.slice(v, j * run + 1, run))),
            lambda sums: let(
                F.transform(sums, lambda _, j: added_up(F.slice(sums, F.lit(1), j))),
                lambda before: F.transform(v, lambda _, i: before[F.floor(i / run).cast("int")] + added_up(F.slice(v, F.floor(i / run).cast("int") * run + 1, i % run + 1))),
            ),
        ),
    )


def located(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None, group: int = 0) -> Column:
    """Non-overlapping matches from the left: start, end (code points) and the group's text,
    of all or of those whose group passes ``keep``."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches

    def spans(m: Column) -> Column:
        ends = running(F.zip_with(F.transform(m, F.length), F.slice(F.transform(gaps, F.length), F.lit(1), F.size(m)), lambda a, b: a + b))
        starts = F.zip_with(ends, m, lambda e, x: F.struct((e - F.length(x)).alias("start"), e.alias("end")))
        return F.zip_with(starts, groups, lambda s, g: F.struct(s["start"].alias("start"), s["end"].alias("end"), g.alias("token")))

    none = F.array().cast("array<struct<start:bigint,end:bigint,token:string>>")
    return F.when(text.rlike(pattern), F.filter(let(matches, spans), lambda s: keep(s["token"]) if keep else F.lit(True))).otherwise(none)


def case(symbols: Column, values: list) -> Column:
    """One of ``values``, by the encoding that the symbols have."""
    out = F.when(symbols.rlike(f"^{ENCODINGS[0][0]}$"), F.lit(values[0]))
    for (pattern, _), value in zip(ENCODINGS[1:], values[1:]):
        out = out.when(symbols.rlike(f"^{pattern}$"), F.lit(value))
    return out


def battery(span: Column) -> Column:
    """What the tests need of a token: its length n, its alphabet's k symbols, the symbols'
    summed squared counts, changes between the alphabet's halves, and summed products of
    neighbours; symbols count as odd numbers around 0, so that all of it is whole."""
    symbols = F.regexp_replace(span["token"], "=+$", "")
    bound = F.struct(symbols.alias("symbols"), case(symbols, [a for _, a in ENCODINGS]).alias("alphabet"), case(symbols, list(range(len(ENCODINGS)))).alias("encoding"))

    def sums(b: Column) -> Column:
        n, k = F.length(b["symbols"]), F.length(b["alphabet"])
        counts = F.transform(F.split(b["alphabet"], ""), lambda a: (n - F.length(F.replace(b["symbols"], a, F.lit("")))).cast("long"))
        zero = F.lit(0).cast("long")

        def step(acc: Column, symbol: Column) -> Column:
            u = (2 * F.call_function("instr", b["alphabet"], symbol) - 1 - k).cast("long")
            change = F.when((acc["last"] != 0) & ((acc["last"] > 0) != (u > 0)), 1).otherwise(0)
            return F.struct(u.alias("last"), (acc["changes"] + change).alias("changes"), (acc["products"] + acc["last"] * u).alias("products"))

        walked = F.aggregate(F.split(b["symbols"], ""), F.struct(zero.alias("last"), zero.alias("changes"), zero.alias("products")), step)
        fields = {"n": n, "k": k, "squares": added_up(F.transform(counts, lambda c: c * c)), "changes": walked["changes"], "products": walked["products"]}
        return F.struct(b["encoding"].alias("encoding"), *(c.cast("double").alias(name) for name, c in fields.items()))

    return let(bound, sums)


#: The tests in SQL, which the oracle shares; all names are doubles. Chi-squared, the worst
#: of the three tests, chi-squared's mean and the spread of the squares in ordinary text.
CHI = "(k * squares / n - n)"
WORST = f"greatest(abs({CHI} - (k - 1)) / sqrt(2 * (k - 1) * (n - 1) / n), abs(2 * changes - (n - 1)) / sqrt(n - 1), 3 * abs(products) / ((k * k - 1) * sqrt(n - 1)))"
MEAN = "(k + k * (n - 1) * s2 - n)"
SPREAD = "(4 * n * (n - 1) * (n - 2) * s3 + 2 * n * (n - 1) * s2 - 2 * n * (n - 1) * (2 * n - 3) * s2 * s2)"
BELOW = f"CASE WHEN {SPREAD} > 0 THEN ({MEAN} - {CHI}) / (k / n * sqrt(abs({SPREAD}))) ELSE 0 END"
POLYNOMIAL = "(" + " + ".join(f"{c!r} * pow(1 / (1 + 0.2316419 * below), {i + 1})" for i, c in enumerate(TAIL)) + ")"
BIN = (
    f"CAST(CASE WHEN below <= 0 OR worst > {GATE} THEN 0 "
    f"ELSE least({BINS}, floor(20 * (below * below / 4.605170185988092 + 0.3990899341790575 - log10({POLYNOMIAL})))) END AS INT)"
)
LENGTH = "CASE " + " ".join(f"WHEN n >= {n} THEN {n}" for n in reversed(LENGTHS[1:])) + f" ELSE {LENGTHS[0]} END"


def within(sql: str) -> str:
    """The same over fields of an element x."""
    return re.sub(r"\b(n|k|squares|changes|products|s2|s3|below|worst)\b", r"x.\1", sql)


def symbol_counts(texts: DataFrame) -> dict[str, int]:
    """How often each symbol is in all texts, but for the tokens: 66 rows at most."""
    known = UPPER + LOWER + DIGITS + "+/-_"
    rows = texts.select(F.explode(F.split(F.regexp_replace("text", TOKEN, ""), "")).alias("symbol")).filter(F.col("symbol").isin(*known)).groupBy("symbol").count().collect()
    return {r["symbol"]: r["count"] for r in rows}


def moments(counts: dict[str, int]) -> list[tuple[float, float]]:
    """Summed squares and cubes of the symbols' shares of ordinary text, by encoding; each
    symbol counts once more than it is there."""
    out = []
    for _, alphabet in ENCODINGS:
        c = [counts.get(a, 0) + 1 for a in alphabet]
        total = float(sum(c))
        out.append((float(sum(x**2 for x in c)) / total**2, float(sum(x**3 for x in c)) / total**3))
    return out


def thresholds(histogram: list[tuple[int, int, int]], level: float) -> dict[int, int]:
    """Benjamini and Hochberg's step-up rule in each length class, over bins' upper ends:
    the least bin from which tokens are taken."""
    out = {}
    for length in {h[0] for h in histogram}:
        bins = sorted(((b, n) for c, b, n in histogram if c == length), reverse=True)
        all_of, beyond = sum(n for _, n in bins), 0
        for b, n in bins:
            beyond += n
            if b > 0 and all_of * 10.0 ** (-b / 20) <= level * beyond:
                out[length] = b
    return out


def find_secrets(docs: DataFrame, level: float = 0.01, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of listed forms, and of tokens that are random beyond what ordinary text gives:
    doc_id and arrays assign, access, hex and random of (start, end).

    A token is a run of 16 or more symbols of base 64. Its alphabet is the narrowest that
    has all of them. Chi-squared uniformity, runs and serial correlation test it against
    independent uniform symbols; it must pass all. What speaks against chance is the other
    side: of a token drawn from ordinary text (symbols as often as in all documents outside of tokens), the
    chi-squared statistic has a known mean and spread, which part from the uniform ones as
    the length grows; how far the token is below gives its p-value. In each length class
    the step-up rule keeps the expected share of false discoveries at ``level``.

    Random spans add to the others: not the values of assignments, nor tokens in which hex
    or access matches. Positions are code points of the whole text. A null text is empty, an
    empty one has no spans; ids may be null or repeat, rows count each for itself; an empty
    table gives no rows; other columns are ignored. Very long texts cost time in proportion
    to their length and their matches; nothing is shuffled but counts of symbols and bins.
    """
    texts = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    t, assign = F.col("text"), f"(?i:{ASSIGN})"
    bare = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
    scan = texts.select(
        "doc_id",
        F.transform(located(t, assign, lambda g: F.length(g) >= VALUE, 2), bare).alias("assign"),
        F.transform(located(t, ACCESS), bare).alias("access"),
        F.transform(located(t, HEX), bare).alias("hex"),
        F.transform(
            located(t, f"{assign}|({TOKEN})", lambda g: (g != "") & ~g.rlike(FOUND), 3), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), battery(s).alias("of"))
        ).alias("tokens"),
    )
    scan = staged(scan, "secrets")
    shares = moments(symbol_counts(texts))
    s2, s3 = ("CASE x.of.encoding " + " ".join(f"WHEN {i} THEN CAST({s[j]!r} AS DOUBLE)" for i, s in enumerate(shares)) + " END" for j in (0, 1))
    fields = ", ".join(f"x.of.{f} AS {f}" for f in ("n", "k", "squares", "changes", "products"))
    steps = (
        f"transform(tokens, x -> struct(x.start AS start, x.end AS end, {fields}, {s2} AS s2, {s3} AS s3))",
        f"transform(tokens, x -> struct(x.start AS start, x.end AS end, x.n AS n, {within(BELOW)} AS below, {within(WORST)} AS worst))",
        f"transform(tokens, x -> struct(x.start AS start, x.end AS end, {within(LENGTH)} AS length, {within(BIN)} AS bin))",
    )
    judged = scan
    for step in steps:
        judged = judged.withColumn("tokens", F.expr(step))
    histogram = judged.select(F.explode("tokens").alias("x")).groupBy("x.length", "x.bin").count().collect()
    least = thresholds([tuple(r) for r in histogram], level)
    taken = " OR ".join(f"x.length = {n} AND x.bin >= {b}" for n, b in sorted(least.items())) or "false"
    return judged.withColumn("random", F.expr(f"transform(filter(tokens, x -> {taken}), x -> struct(x.start AS start, x.end AS end))")).drop("tokens")


def report_secrets(docs: DataFrame, **options) -> DataFrame:
    """A row for each document: counts of listed spans, their digest, and all spans."""
    found = find_secrets(docs, **options)

    def ranked(i: int) -> Callable[[Column], Column]:
        return lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end"))

    def joined(kinds: tuple[str, ...]) -> Column:
        spans = [F.transform(kind, ranked(i)) for i, kind in enumerate(kinds)]
        texts = F.transform(F.array_sort(F.concat(*spans)), lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, kinds)), s["kind"] + 1), s["start"], s["end"]))
        return F.array_join(texts, ",")

    counts = [F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(KINDS[:3]), 256).alias("base_sha256"), joined(KINDS).alias("spans"))


def _spans(kind: str, pattern: str, keep: str, group: int = 0) -> str:
    """SQL: match i lies behind i gaps and i - 1 matches."""
    return f"""SELECT r, '{kind}' AS kind, {KINDS.index(kind)} AS rank, b, b + len(m[i]) AS e, g[i] AS token FROM (
      SELECT r, i, m, g, list_sum(list_transform(gaps[1:i], lambda x: len(x))) + COALESCE(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS b FROM (
        SELECT r, t, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {group}) AS g, string_split_regex(t, '{pattern}') AS gaps
        FROM t WHERE regexp_matches(t, '{pattern}')) s, range(1, len(m) + 1) u(i)) WHERE {keep.replace("TOKEN", "g[i]")}"""


def _oracle(level: float = 0.01) -> str:
    either = re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", ASSIGN.partition(")")[0])
    assign = (either + ")" + ASSIGN.partition(")")[2]).replace("\\x20", " ").replace("'", "''")
    encodings = " ".join(f"WHEN regexp_full_match(s, '{p}') THEN '{a}'" for p, a in ENCODINGS)
    alphabets = ", ".join(f"('{a}')" for _, a in ENCODINGS)
    return f"""WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, COALESCE(text, '') AS t FROM documents),
    base AS MATERIALIZED ({_spans("assign", assign, f"len(TOKEN) >= {VALUE}", 2)} UNION ALL {_spans("access", ACCESS, "true")}
      UNION ALL {_spans("hex", HEX, "true")}),
    tokens AS MATERIALIZED (SELECT *, CASE {encodings} END AS alphabet FROM (SELECT *, regexp_replace(token, '=+$', '') AS s FROM ({_spans("random", f"{assign}|({TOKEN})", f"TOKEN <> '' AND NOT regexp_matches(TOKEN, '{FOUND}')", 3)}))),
    symbols AS MATERIALIZED (SELECT c, count(*) AS n FROM (SELECT unnest(string_split(regexp_replace(t, '{TOKEN}', '', 'g'), '')) AS c FROM t) GROUP BY c),
    known AS (SELECT alphabet, COALESCE(n, 0) + 1 AS n FROM (SELECT alphabet, unnest(string_split(alphabet, '')) AS c FROM (VALUES {alphabets}) a(alphabet)) LEFT JOIN symbols USING (c)),
    shares AS (SELECT alphabet, CAST(sum(n * n) AS DOUBLE) / pow(CAST(sum(n) AS DOUBLE), 2) AS s2, CAST(sum(CAST(n AS HUGEINT) * n * n) AS DOUBLE) / pow(CAST(sum(n) AS DOUBLE), 3) AS s3 FROM known GROUP BY alphabet),
    u AS (SELECT *, list_transform(string_split(s, ''), lambda x: 2 * instr(alphabet, x) - 1 - len(alphabet)) AS u FROM tokens),
    sums AS (SELECT r, kind, rank, b, e, alphabet, CAST(len(s) AS DOUBLE) AS n, CAST(len(alphabet) AS DOUBLE) AS k,
      CAST(list_sum(list_transform(string_split(alphabet, ''), lambda a: (len(s) - len(replace(s, a, ''))) * (len(s) - len(replace(s, a, ''))))) AS DOUBLE) AS squares,
      CAST(list_sum(list_transform(range(1, len(u)), lambda i: CASE WHEN (u[i] > 0) <> (u[i + 1] > 0) THEN 1 ELSE 0 END)) AS DOUBLE) AS changes,
      CAST(list_sum(list_transform(range(1, len(u)), lambda i: u[i] * u[i + 1])) AS DOUBLE) AS products FROM u),
    tests AS (SELECT *, {BELOW} AS below, {WORST} AS worst FROM sums JOIN shares USING (alphabet)),
    bins AS MATERIALIZED (SELECT *, {LENGTH} AS length, {BIN} AS bin FROM tests),
    steps AS (SELECT length, bin, sum(count(*)) OVER (PARTITION BY length) AS all_of, sum(count(*)) OVER (PARTITION BY length ORDER BY bin DESC) AS beyond FROM bins GROUP BY length, bin),
    least_bin AS (SELECT length, min(bin) AS least FROM steps WHERE bin > 0 AND all_of * pow(10, -bin / 20) <= {level} * beyond GROUP BY length),
    spans AS (SELECT r, kind, rank, b, e FROM base UNION ALL SELECT r, kind, rank, b, e FROM bins JOIN least_bin USING (length) WHERE bin >= least),
    joined AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind = 'random') AS n_random,
      string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank) FILTER (kind <> 'random') AS base, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank) AS spans FROM spans GROUP BY r)
    SELECT doc_id, COALESCE(n_assign, 0) AS n_assign, COALESCE(n_access, 0) AS n_access, COALESCE(n_hex, 0) AS n_hex, COALESCE(n_random, 0) AS n_random,
      sha256(COALESCE(base, '')) AS base_sha256, COALESCE(spans, '') AS spans FROM t LEFT JOIN joined USING (r)"""


ORACLE = _oracle()
