"""Line deduplication by a log-template tree, with SQL functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, discard, row_key, staged, text_or_empty

#: A variable field by its form: a token with a digit. The pattern starts at tokens only.
VARIABLE = r"(?<!\S)[^\s0-9]*+[0-9]\S*"
FIELD = "<*>"
#: White space of a line that isn't a single blank.
SPACE = r"\s{2,}|[^\S ]"
#: The start of a token that isn't a field, in a line with single blanks.
CONSTANT = r"(?<![^ ])(?!<\*>(?: |\z))[^ ]"


#: Parts into which a line's tokens are cut, and tasks that share the lines of a template.
PARTS, SHARES = 11, 8
#: Bits of the sieve that keeps most lines from a join.
SIEVE = 1 << 24


def _lines(docs: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    """A row for each line of ``min_tokens`` tokens or more, one of them constant: where it
    is, its leaf of the tree (token count and leading tokens), and its masked wording, as a
    128-bit form and as it is."""
    # inside the generator each line meets its patterns once, and that of fields only if it
    # has a digit; a filter on lines would run them again. The outer form keeps them there
    masked = lambda w: F.when(w.rlike("[0-9]"), F.regexp_replace(w, VARIABLE, FIELD)).otherwise(w)
    wordings = F.transform(F.split("text", "\n"), lambda w: F.trim(F.regexp_replace(masked(w), SPACE, " ")))
    lines = docs.select("row", "doc_id", F.posexplode_outer(wordings).alias("line", "wording"))
    kept = lines.filter(F.col("wording").rlike(CONSTANT)).withColumn("tokens", F.split("wording", " "))
    if min_tokens > 1:
        kept = kept.filter(F.size("tokens") >= min_tokens)
    return kept.select("row", "doc_id", "line", F.xxhash64(F.size("tokens"), F.slice("tokens", 1, depth)).alias("leaf"), F.unhex(F.md5("wording")).alias("form"), "wording")


def _masks(tokens: Column, leaf: Column, depth: int, similarity: float) -> Column:
    """(key, i, j) of each template that the line may be of: the tokens after the leading ones
    are cut into up to ``PARTS`` parts, and one of them, or two, are variable, as long as a
    share ``similarity`` of all tokens is constant. The key is a hash of the leaf, of which
    parts are variable and of the constant ones, so the lines of a template are those that
    share its key. Each part is hashed once."""

    def cut(t: Column) -> Column:
        rest = F.size(t) - depth
        parts = F.least(F.lit(PARTS), rest)
        begin = lambda i: F.floor(i * rest / parts).cast("int")
        return F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.struct((begin(i + 1) - begin(i)).alias("size"), F.xxhash64(i, F.slice(t, begin(i) + depth + 1, begin(i + 1) - begin(i))).alias("hash")))

    def masks(p: Column) -> Column:
        variable = F.floor(F.size(tokens) * (1 - similarity) + 1e-9).cast("int")
        whole = F.aggregate(p, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(x["hash"]))

        def mask(i: Column) -> Callable[[Column], Column]:
            def pair(j: Column) -> Column:
                hidden = p[i]["size"] + F.when(j > i, p[j]["size"]).otherwise(0)
                shown = whole.bitwiseXOR(p[i]["hash"]).bitwiseXOR(F.when(j > i, p[j]["hash"]).otherwise(F.lit(0).cast("long")))
                return F.when(hidden <= variable, F.struct(F.xxhash64(leaf, i, j, shown).alias("key"), i.alias("i"), j.alias("j")))

            return pair

        last = F.size(p) - 1
        return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), last), lambda i: F.transform(F.sequence(i, last), mask(i)))))

    bound = F.transform(F.transform(F.array(tokens), cut), masks)[0]  # parts are cut once, masks read them
    n = F.size(tokens)
    return F.when((F.floor(n * (1 - similarity) + 1e-9) > 0) & (n > depth), bound)


def _sifted(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """``lines`` at the places (row, line) of ``wanted``, and few others: those whose hash has
    its bit among ``SIEVE``. The bits are broadcast, in ``SIEVE`` / 64 rows at most."""
    place = F.pmod(F.xxhash64("row", "line"), F.lit(SIEVE))
    bit = F.expr("shiftleft(1L, cast(place % 64 as int))")
    bits = wanted.select(place.alias("place")).groupBy(F.expr("place div 64").alias("word")).agg(F.bit_or(bit).alias("bits"))
    there = lines.withColumn("place", place).withColumn("word", F.expr("place div 64")).join(F.broadcast(bits), "word")
    return there.filter(F.col("bits").bitwiseAND(bit) != 0).select(*lines.columns)


def recurring_lines(lines: DataFrame, depth: int, similarity: float, support: int) -> DataFrame:
    """(form, keeper) of the lines that recur: literally in two documents, or as a template
    in ``support``. ``keeper`` is the first document that has the template, or else the line.

    A leaf has as many templates as its lines share keys (see :func:`_masks`); no line
    stands for others, and none is compared with another. A line that is of several goes to
    the one with the most lines in documents (ties: the earliest), and of those that go to
    one the first stays. Templates' documents are counted one by one: a form in fewer than
    three has no others than its first and its last.
    """
    own = lines.groupBy("leaf", "form", "row").agg(F.min("doc_id").alias("doc_id"), F.min("line").alias("line"))
    first, last = F.min(F.struct("doc_id", "row", "line")).alias("first"), F.max(F.struct("doc_id", "row")).alias("last")
    forms = staged(own.groupBy("leaf", "form").agg(first, last, F.count(F.lit(1)).alias("docs")), "forms")
    busy = forms.groupBy("leaf").agg(F.count(F.lit(1)).alias("k"), F.sum("docs").alias("n")).filter((F.col("k") > 1) & (F.col("n") >= support)).select("leaf")
    wanted = staged(forms.join(busy, "leaf").select("leaf", "form", "docs", F.col("first.row").alias("row"), F.col("first.line").alias("line")), "wanted")
    rivals = _sifted(lines.select("row", "line", "wording"), wanted).join(wanted, ["row", "line"])
    masked = rivals.select("form", "docs", F.explode(_masks(F.split("wording", " "), F.col("leaf"), depth, similarity)).alias("m"))
    masked = staged(masked.select("form", "docs", "m.*", F.pmod(F.xxhash64("form"), F.lit(SHARES)).cast("int").alias("share")), "masks")

    every = F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share")
    shared = masked.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.sum("docs").alias("n"), F.max("docs").alias("most"))
    shared = shared.filter((F.col("k") > 1) & (F.col("n") >= support)).select("key", "n", "most", every)
    members = masked.join(shared, ["key", "share"]).select("form", "key", "share", "i", "j", "n", "most")
    members = staged(members.join(forms.select("form", "first", "last"), "form"), "members")
    few = members.filter(F.col("most") < support)
    rows = few.select("key", F.explode(F.array("first.row", "last.row")).alias("row")).distinct()
    counted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("there")).filter(F.col("there") >= support).select("key", every)
    good = members.filter(F.col("most") >= support).unionByName(few.join(counted, ["key", "share"], "left_semi"))
    earliest = good.groupBy("key").agg(F.min("first").alias("earliest")).select("key", "earliest", every)
    rank = F.struct((-F.col("n")).alias("n"), "earliest", "i", "j", "key")
    best = good.join(earliest, ["key", "share"]).groupBy("form", "share").agg(F.min(rank).alias("rank"), F.min("first").alias("first"))
    chosen = staged(best.select("form", "share", F.col("rank.key").alias("key"), "first"), "chosen")
    kept = chosen.groupBy("key").agg(F.min("first").alias("kept")).select("key", F.col("kept.row").alias("keeper"), every)
    by_template = chosen.join(kept, ["key", "share"]).select("form", F.col("keeper").alias("held"))
    again = forms.filter("docs > 1").select("form", F.col("first.row").alias("again"))
    found = staged(again.join(by_template, "form", "full").select("form", F.coalesce("held", "again").alias("keeper")), "recurring")
    discard(forms, wanted, masked, members, chosen)
    return found


def _dropped(docs: DataFrame, depth: int, similarity: float, support: int, min_tokens: int, doc_id: str, text: str) -> DataFrame:
    """doc (all columns), and the numbers of its dropped lines."""
    keyed = docs.select(row_key(doc_id, text).alias("row"), F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    lines = staged(_lines(keyed, depth, min_tokens), "lines")
    found = lines.select("row", "line", "form").join(recurring_lines(lines, depth, similarity, support), "form").filter("row <> keeper")
    dropped = staged(found.groupBy("row").agg(F.collect_set("line").alias("dropped")), "dropped")  # a document's own lines
    discard(lines)
    none = F.expr("array()").cast("array<int>")
    return beside(docs, row=row_key(doc_id, text)).join(dropped, "row", "left").select("doc", F.coalesce("dropped", none).alias("dropped"))


def _left(text: str) -> Column:
    """The text without its dropped lines."""
    own = F.col(f"doc.`{text}`")
    left = F.array_join(F.filter(F.split(own, "\n"), lambda _, i: ~F.array_contains("dropped", i)), "\n")
    return F.when(F.size("dropped") == 0, own).otherwise(left)


def drop_recurring_lines(
    docs: DataFrame, depth: int = 3, similarity: float = 0.8, support: int = 3, min_tokens: int = 1, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with the lines of recurring templates dropped from ``text`` in all documents
    but the first that has them (the least id), and n_lines and n_dropped added.

    Fields with a digit are variable; the tree's leaves are the number of tokens and the
    first ``depth`` tokens; within a leaf, lines that are the same but for one or two parts
    have a template in which these are variable (see :func:`_masks`). A line that is the
    same but for fields with digits recurs in two documents; one with other variable words
    recurs if its template is in ``support``, so two sentences of like wording stay. Lines
    without a constant token, or of fewer than ``min_tokens``, stay. A template in copies of
    one row, same id and text, doesn't recur. Very long lines have as many parts as others.

    A null text counts as empty with one line and stays null; null ids are the least.
    Repeated rows are treated alike; an empty table gives no rows. Other columns stay as they
    are, whatever their names; those named n_lines or n_dropped are replaced.
    """
    kept = docs.drop("n_lines", "n_dropped")
    out = _dropped(kept, depth, similarity, support, min_tokens, doc_id, text)
    lines = F.size(F.split(F.coalesce(f"doc.`{text}`", F.lit("")), "\n")).cast("long")
    return out.select(
        *(_left(text).alias(c) if c == text else F.col(f"doc.`{c}`") for c in kept.columns), lines.alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped")
    )


def clean_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """The columns of ``docs``, without the lines that :func:`drop_recurring_lines` drops;
    where there is a column ``length``, it follows the text (null for a null text)."""
    out = _dropped(docs, 3, 0.8, 3, 1, doc_id, text)
    left = _left(text)
    new = {text: left, length: F.length(left).cast(docs.schema[length].dataType)} if length in docs.columns else {text: left}
    return out.select(*(new[c].alias(c) if c in new else F.col(f"doc.`{c}`") for c in docs.columns))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(l)))::BIGINT AS line, unnest(l) AS masked
  FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '\S*[0-9]\S*', '<*>', 'g'), chr(10)) AS l FROM documents)),
t AS (SELECT doc_id, line, string_split(trim(regexp_replace(masked, '\s+', ' ', 'g')), ' ') AS tok FROM lines),
e AS (SELECT doc_id, line, tok, len(tok)::VARCHAR || ' ' || array_to_string(tok[1:3], ' ') AS leaf, array_to_string(tok, ' ') AS form
  FROM t WHERE len(list_filter(tok, lambda x: x <> '<*>' AND x <> '')) > 0),
forms AS (SELECT leaf, form, any_value(tok) AS tok, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc, min(doc_id * 1000000 + line) AS first_at FROM e GROUP BY leaf, form),
cut AS (SELECT leaf, form, tok, docs, first_doc, last_doc, first_at, len(tok) - 3 AS rest, least(len(tok) - 3, 11) AS g FROM forms WHERE len(tok) >= 5),
pair AS (SELECT *, (i * rest) // g AS bi, ((i + 1) * rest) // g AS ei, (j * rest) // g AS bj, ((j + 1) * rest) // g AS ej
  FROM (SELECT *, unnest(range(i, g)) AS j FROM (SELECT *, unnest(range(g)) AS i FROM cut))),
mask AS (SELECT form, docs, first_doc, last_doc, first_at, i, j,
  leaf || chr(1) || i || ',' || j || chr(1) || array_to_string(tok[1:3 + bi], ' ') || chr(1) || array_to_string(tok[4 + ei:3 + bj], ' ') || chr(1) || array_to_string(tok[4 + ej:], ' ') AS key
  FROM pair WHERE ei - bi + CASE WHEN j > i THEN ej - bj ELSE 0 END <= len(tok) // 5),
shared AS (SELECT key, sum(docs) AS n, min(first_at) AS earliest FROM mask GROUP BY key HAVING count(*) > 1),
support AS (SELECT key FROM (SELECT m.key, e.doc_id FROM mask m JOIN shared USING (key) JOIN e ON e.form = m.form) GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
chosen AS (SELECT form, key, first_at, first_doc FROM (
  SELECT m.*, row_number() OVER (PARTITION BY form ORDER BY n DESC, earliest, i, j) AS k FROM mask m JOIN shared USING (key) JOIN support USING (key)) WHERE k = 1),
kept AS (SELECT key, arg_min(first_doc, first_at) AS keeper FROM chosen GROUP BY key),
found AS (SELECT f.form, coalesce(k.keeper, CASE WHEN f.docs > 1 THEN f.first_doc END) AS keeper
  FROM forms f LEFT JOIN chosen c ON f.form = c.form LEFT JOIN kept k ON c.key = k.key),
gone AS (SELECT e.doc_id, e.line FROM e JOIN found k ON e.form = k.form WHERE keeper IS NOT NULL AND e.doc_id <> k.keeper),
parts AS (SELECT doc_id, unnest(range(len(l)))::BIGINT AS line, unnest(l) AS part FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
SELECT p.doc_id, count(*) AS n_lines, count(g.line) AS n_dropped,
  md5(coalesce(string_agg(p.part, chr(10) ORDER BY p.line) FILTER (WHERE g.line IS NULL), '')) AS clean_md5
FROM parts p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.line = g.line GROUP BY p.doc_id
"""
