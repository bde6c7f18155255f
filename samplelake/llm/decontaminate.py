"""Benchmark decontamination by canonical templates, with SQL functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, row_key, text_or_empty

NUMBER, NAME, UNIT = "<n>", "<name>", "<unit>"
#: Words that are units or currencies, in lower case.
UNITS = (
    "mm cm m km inch inches ft feet foot yard yards mile miles mg g kg gram grams kilogram kilograms ton tons oz lb lbs pound pounds "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars cent cents euro euros percent degree degrees celsius fahrenheit mph kmh watt watts kw kwh volt volts hz khz mhz ghz kb mb gb tb"
).split()


def plain(text: str | Column) -> Column:
    """Runs of letters and digits with one blank between."""
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))


def forms(text: Column) -> Column:
    """The template of :func:`plain` text: tokens that begin with a digit are numbers, those
    that begin with a capital and a small letter names; the others are lower-cased."""
    named = F.regexp_replace(text, r"(?<![^ ])\p{Lu}\p{Ll}[^ ]*", NAME)
    tokens = F.split(F.lower(F.regexp_replace(named, r"(?<![^ ])[0-9][^ ]*", NUMBER)), " ")
    return F.transform(tokens, lambda t: F.when(t.isin(*UNITS), UNIT).otherwise(t))


def codes(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(t))


def is_slot(t: Column) -> Column:
    return t.isin(NUMBER, NAME, UNIT)


def benchmark_windows(benchmark: DataFrame, width: int, literals: int, item_id: str, text: str) -> DataFrame:
    """Windows of ``width`` template tokens (shorter items: one, of all), each anchored at its
    longest plain word. Those with fewer than ``literals`` plain words are used where an
    item has no other, and then must agree in their values too: raw_code is not 0. Of the
    windows of an item with the same template the first stands for all, and of the items
    with the same template and the same slots alike the least (see :func:`item_classes`)."""
    items = benchmark_items(benchmark, item_id, text)
    classes = item_classes(items)
    span = F.least(F.lit(width), F.size("raw"))
    starts = items.select("item_id", "raw", "form", span.alias("span"), F.explode(F.sequence(F.lit(0), F.size("raw") - span)).alias("at"))
    cut = starts.select("item_id", "at", "span", F.expr("slice(form, at + 1, span)").alias("form"), F.expr("slice(raw, at + 1, span)").alias("raw"))
    cut = cut.withColumn("words", F.filter("form", lambda t: ~is_slot(t))).filter(F.expr("size(words) > 0 AND words[0] <> ''"))
    cut = cut.withColumn("few", F.size("words") < F.least(F.lit(literals), F.col("span")))
    bare = cut.groupBy("item_id").agg(F.min("few").alias("bare"))
    kept = cut.join(bare, "item_id").filter("bare = few").join(classes, "item_id").filter("bare OR item_id = first_id")
    kept = kept.withColumn("n_items", F.when(F.col("bare"), F.lit(1)).otherwise(F.col("n_items")).cast("long"))
    longest = F.array_max(F.transform(F.col("words"), lambda t: F.struct(F.length(t).alias("n"), t.alias("word"))))["word"]
    kept = kept.withColumn("anchor", longest).select(
        "item_id", "at", "span", F.xxhash64("anchor").alias("anchor"), (F.array_position("form", F.col("anchor")) - 1).cast("int").alias("offset"),
        F.xxhash64(codes(F.col("form"))).alias("code"), F.when(F.col("few"), F.xxhash64(lowered(F.col("raw")))).otherwise(F.lit(0)).cast("long").alias("raw_code"),
        F.col("form").alias("item_form"), F.col("raw").alias("item_raw"), "n_items",
    )
    first = F.struct("at", "span", "anchor", "offset", "item_form", "item_raw", "n_items")
    return kept.groupBy("item_id", "code", "raw_code").agg(F.min(first).alias("w")).select("item_id", "code", "raw_code", "w.*")


def benchmark_items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, raw, form) of the distinct items that have an id."""
    items = benchmark.select(F.col(item_id).alias("item_id"), plain(text_or_empty(text)).alias("text")).filter("item_id IS NOT NULL").distinct()
    return items.select("item_id", F.split("text", " ").alias("raw"), forms(F.col("text")).alias("form"))


def item_classes(items: DataFrame) -> DataFrame:
    """(item_id, first_id, n_items): items with the same template whose slots are alike, that
    is, equal or not in the same places. A document is as consistent with one of them as
    with another, so the least item of a class stands for all."""
    pairs = items.withColumn("pairs", F.zip_with("form", "raw", lambda f, r: F.concat(f, F.lit("\x01"), r)))
    alike = F.transform("form", lambda f, i: F.when(is_slot(f), F.array_position("pairs", F.col("pairs")[i])).otherwise(F.lit(0)))
    named = pairs.select("item_id", F.md5(F.concat(F.concat_ws(" ", "form"), F.lit(":"), F.concat_ws(",", F.transform(alike, lambda x: x.cast("string"))))).alias("digest"))
    least = named.groupBy("digest").agg(F.min("item_id").alias("first_id"), F.count_distinct("item_id").alias("n_items"))
    own = named.join(least, "digest").groupBy("item_id").agg(F.min("first_id").alias("first_id"), F.max("n_items").alias("n_items"), F.count(F.lit(1)).alias("texts"))
    # an id with several texts stands for itself
    alone = F.col("texts") > 1
    return own.select("item_id", F.when(alone, F.col("item_id")).otherwise(F.col("first_id")).alias("first_id"), F.when(alone, 1).otherwise(F.col("n_items")).alias("n_items"))


def lowered(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.lower(t))


def matches(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows of documents with the hashes of benchmark windows: where, and their tokens.

    Only where a document has an anchor's word are windows cut and compared, so neither all
    windows nor the texts are shuffled.
    """
    cleaned = docs.select("row", "doc_id", plain("text").alias("text"))
    # a text is cut into tokens once, and each match takes its own few of them
    tokens = cleaned.select("row", "doc_id", F.split("text", " ").alias("raw"), F.split(F.lower("text"), " ").alias("values"), codes(forms(F.col("text"))).alias("codes"))
    # the outer form keeps the optimizer from computing the codes once more in a filter
    placed = tokens.select("row", "doc_id", "raw", "values", "codes", F.posexplode_outer("codes").alias("pos", "anchor"))
    near = placed.join(windows, "anchor").withColumn("begin", F.col("pos") - F.col("offset") + 1)
    inside = near.filter((F.col("begin") >= 1) & (F.col("begin") + F.col("span") - 1 <= F.size("codes")))
    # no lambda here: the join's condition must stay in generated code, or each token copies its arrays
    cut = "slice({}, greatest(begin, 1), span)"
    by_form = F.xxhash64(F.expr(cut.format("codes"))) == F.col("code")
    by_value = F.xxhash64(F.expr(cut.format("values"))) == F.col("raw_code")
    same = inside.filter(F.when(F.col("raw_code") == 0, by_form).otherwise(by_value))
    return same.select("row", "doc_id", "code", "raw_code", "begin", F.expr(cut.format("raw")).alias("raw"))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = 8,
    literals: int = 4,
    coverage: float = 0.3,
    consistency: float = 0.75,
    drift: int = 16,
    block: int = 1_000_000,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(row, doc_id, item_id, n_items, n_windows, item_windows, slot_share) of leaked items.

    Items and documents become templates: letter and digit runs, where numbers, units and
    capitalised words are typed slots (a word all in capitals is lower-cased). A document
    leaks an item if one occurrence in it has a share ``coverage`` of the item's windows of
    ``width`` tokens, with consistent slots: of the distinct (item value, document value)
    pairs at least the share ``consistency`` is explained by one document value for each
    item value. An exact copy maps each value to itself; a re-parameterised question maps
    each to another, always the same. Windows are of one occurrence if they are as far from
    their places in the item, give or take: distances are dealt into overlapping ranges
    of ``drift`` tokens. Reported is the occurrence with the most windows, then the highest
    slot share.

    Benchmark windows' hashes, five numbers each, are counted first and broadcast in blocks
    of at most ``block`` rows (40 MB); documents are read once for each block. What is
    shuffled are matches; they meet the windows' wording afterwards, where each plain word
    is compared, so equal hashes alone give none.

    Null or empty texts have no windows; an item without any plain word can't be found; one
    of slots for the most part is found with its own values only. Repeated documents are
    found once, items once for each id, and those without an id are left out; empty tables give no rows; other columns are ignored.
    """
    windows = benchmark_windows(benchmark, width, literals, item_id, item_text)
    chosen = docs.select(row_key(doc_id, text).alias("row"), F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    hashes = windows.select("anchor", "offset", "span", "code", "raw_code").distinct()
    blocks = max(1, -(-hashes.count() // block))
    parts = [matches(chosen, F.broadcast(hashes.filter(F.pmod("code", F.lit(blocks)) == b))) for b in range(blocks)]
    found = reduce(DataFrame.unionByName, parts).join(windows, ["code", "raw_code"])
    true = F.expr("forall(sequence(0, span - 1), i -> lower(item_raw[i]) = lower(raw[i]) OR raw_code = 0 AND (item_form[i] IN ('<n>', '<name>', '<unit>') OR item_form[i] = lower(raw[i])))")
    slots = F.expr(
        "transform(filter(sequence(0, span - 1), i -> item_form[i] IN ('<n>', '<name>', '<unit>')),"
        " i -> named_struct('kind', item_form[i], 'item', item_raw[i], 'doc', raw[i]))"
    )
    away = F.col("begin") - F.col("at")
    ranges = F.array(F.floor(away / drift) * 2, F.floor((away + drift // 2) / drift) * 2 + 1)
    found = found.filter(true).select("row", "doc_id", "item_id", "at", slots.alias("slots"), F.explode(ranges).alias("range"))
    by = found.groupBy("row", "doc_id", "item_id", "range").agg(F.collect_set("at").alias("at"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("pairs"))
    values = F.array_distinct(F.transform("pairs", lambda p: F.struct(p["kind"].alias("kind"), p["item"].alias("item"))))
    share = F.when(F.size("pairs") == 0, 1.0).otherwise(F.size(values) / F.size("pairs"))
    sizes = windows.groupBy("item_id").agg(F.count(F.lit(1)).alias("item_windows"), F.max("n_items").alias("n_items"))
    counted = by.select("row", "doc_id", "item_id", F.size("at").cast("long").alias("n_windows"), share.alias("slot_share")).join(sizes, "item_id")
    good = counted.filter((F.col("n_windows") >= coverage * F.col("item_windows")) & (F.col("slot_share") >= consistency))
    best = good.groupBy("row", "doc_id", "item_id", "item_windows", "n_items").agg(F.max(F.struct("n_windows", "slot_share")).alias("best"))
    return best.select("row", "doc_id", "item_id", "n_items", "best.n_windows", "item_windows", "best.slot_share")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without those that leak an item; all their columns stay, whatever their
    names. Null and empty texts stay; repeated rows stay or go together."""
    leaks = find_leaks(docs, benchmark, doc_id=doc_id, text=text).select("row").distinct()
    return beside(docs, row=row_key(doc_id, text)).join(leaks, "row", "left_anti").select("doc.*")


ORACLE = r"""
WITH w AS (
  SELECT item_id AS id, string_split(trim(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS raw FROM benchmark),
wf AS (SELECT *, min(id) OVER (PARTITION BY form, alike) AS first_id, count(*) OVER (PARTITION BY form, alike) AS n_items FROM (SELECT *, list_transform(range(1, len(raw) + 1),
  lambda i: CASE WHEN form[i] IN ('<n>', '<name>', '<unit>') THEN list_position(list_transform(range(1, len(raw) + 1), lambda j: form[j] || chr(1) || raw[j]), form[i] || chr(1) || raw[i]) ELSE 0 END) AS alike
  FROM (SELECT id, raw, list_transform(raw, lambda t: CASE WHEN regexp_matches(t, '^[0-9]') THEN '<n>' WHEN regexp_matches(t, '^\p{Lu}\p{Ll}') THEN '<name>' WHEN lower(t) IN (__UNITS__) THEN '<unit>' ELSE lower(t) END) AS form FROM w) x) y),
ws AS (SELECT id, first_id, n_items, unnest(range(len(raw) - least(8, len(raw)) + 1)) AS pos, least(8, len(raw)) AS span, raw, form FROM wf),
wc AS (SELECT id, first_id, n_items, pos, span, form[pos + 1:pos + span] AS form, raw[pos + 1:pos + span] AS raw FROM ws),
wl AS (SELECT *, list_filter(form, lambda t: t NOT IN ('<n>', '<name>', '<unit>')) AS words FROM wc),
wk AS (SELECT *, len(words) < least(4, span) AS few, min(len(words) < least(4, span)) OVER (PARTITION BY id) AS bare FROM wl WHERE words[1] <> ''),
win AS (SELECT id AS item_id, array_to_string(form, ' ') AS code, CASE WHEN few THEN lower(array_to_string(raw, ' ')) END AS exact, min(pos) AS pos,
  arg_min(form, pos) AS form, arg_min(raw, pos) AS raw, CASE WHEN few THEN 1 ELSE n_items END AS n_items FROM wk WHERE few = bare AND (bare OR id = first_id) GROUP BY ALL),
spans AS (SELECT DISTINCT len(form) AS span FROM win),
d AS (SELECT doc_id, string_split(trim(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS raw FROM documents),
df AS (SELECT doc_id, raw, list_transform(raw, lambda t: CASE WHEN regexp_matches(t, '^[0-9]') THEN '<n>' WHEN regexp_matches(t, '^\p{Lu}\p{Ll}') THEN '<name>' WHEN lower(t) IN (__UNITS__) THEN '<unit>' ELSE lower(t) END) AS form FROM d),
ds AS (SELECT doc_id, span, unnest(range(len(raw) - span + 1)) AS pos, raw, form FROM df, spans WHERE len(raw) >= span),
dw AS MATERIALIZED (SELECT doc_id, pos AS begin, raw[pos + 1:pos + span] AS raw, array_to_string(form[pos + 1:pos + span], ' ') AS code FROM ds),
mm AS (SELECT dw.doc_id, win.item_id, win.pos, win.form AS f, win.raw AS i, dw.raw AS d, begin - win.pos + 1 AS away
  FROM dw JOIN win ON dw.code = win.code WHERE exact IS NULL
  UNION ALL SELECT dw.doc_id, win.item_id, win.pos, win.form, win.raw, dw.raw, begin - win.pos + 1 FROM dw JOIN win ON lower(array_to_string(dw.raw, ' ')) = exact),
m AS (SELECT *, unnest([(floor(away / 16) * 2)::BIGINT, (floor((away + 8) / 16) * 2 + 1)::BIGINT]) AS g FROM mm),
counted AS (SELECT doc_id, item_id, g, count(DISTINCT pos) AS n_windows FROM m GROUP BY ALL),
slot AS (SELECT DISTINCT doc_id, item_id, g, f[k] AS kind, i[k] AS v, d[k] AS x FROM (SELECT *, unnest(range(1, len(f) + 1)) AS k FROM m) WHERE f[k] IN ('<n>', '<name>', '<unit>')),
share AS (SELECT doc_id, item_id, g, count(DISTINCT (kind, v)) / count(*) AS slot_share FROM slot GROUP BY ALL),
sizes AS (SELECT item_id, count(*) AS item_windows, max(n_items) AS n_items FROM win GROUP BY item_id),
good AS (SELECT c.doc_id, c.item_id, n_items, n_windows, item_windows, round(coalesce(slot_share, 1.0), 6) AS slot_share
  FROM counted c JOIN sizes s ON c.item_id = s.item_id LEFT JOIN share h ON c.doc_id = h.doc_id AND c.item_id = h.item_id AND c.g = h.g
  WHERE n_windows >= 0.3 * item_windows AND coalesce(slot_share, 1.0) >= 0.75)
SELECT doc_id, item_id, n_items, n_windows, item_windows, slot_share FROM good
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_windows DESC, slot_share DESC) = 1
""".replace("__UNITS__", ", ".join(f"'{u}'" for u in UNITS))
