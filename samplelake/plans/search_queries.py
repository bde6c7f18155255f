"""Search, projection, sorting, statistics and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cluster import shared
from ..functions import text as tx
from ..operators import index as ix
from ..operators import postings as po
from ..operators import search as se
from ..operators import stats as st
from ..operators.search import ColumnFilter, SearchQuery
from ..sources.table import Table
from .registry import query

LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def low(c: str) -> str:
    return LOW.format(c)


def has(c: str, p: str) -> str:
    return f"contains({low(c)}, '{p}')"


def any_has(columns: str, p: str) -> str:
    return "(" + " OR ".join(has(c, p) for c in columns.split()) + ")"


FREE = "vendor library category sound_id description comment key path"


@query("flagship_search", f"SELECT id, path, vendor, category, bpm FROM samples WHERE {any_has(FREE, 'brand')} AND {has('category', 'economy')} AND bpm BETWEEN 90 AND 150")
def flagship(v):
    """Free text, column filter and range, in the order of paths."""
    q = SearchQuery(bpm="90-150", free_text="brand", filters=(ColumnFilter("category", ("ECONOMY",)),))
    return se.search(v.samples, q).select("id", "path", "vendor", "category", "bpm")


@query("s02_format_dispatch", "SELECT path, CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) WHEN 'wav' THEN 'riff' WHEN 'txt' THEN 'unknown' END AS source FROM docs UNION ALL SELECT path, 'riff' FROM samples")
def s02(v):
    source = lambda df: df.select("path", st.source_of("path").alias("source"))
    return source(v.docs.select("path")).unionByName(source(v.samples.select("path")))


@query("s09_source_merge", """WITH r AS (SELECT lower(file_path) AS k, arg_min(artist, id) AS artist, arg_min(description, id) AS description FROM ref GROUP BY 1),
 d AS (SELECT id, path, category FROM docs)
 SELECT s.id, coalesce(nullif(s.vendor, ''), r.artist, '') AS vendor, coalesce(nullif(s.category, ''), d.category, '') AS category,
 coalesce(nullif(s.comment, ''), nullif(r.description, ''), d.path, '') AS comment
 FROM samples s LEFT JOIN r ON lower(s.parent_folder) = r.k LEFT JOIN d ON s.id = d.id""")
def s09(v):
    """The samples' own fields, then a reference table's by folder, then a text source's by id."""
    ref = v.ref.groupBy(F.lower("file_path").alias("key")).agg(*[F.min_by(c, "id").alias(c) for c in ("artist", "description")])
    docs = v.docs.select(F.col("id").alias("key"), "category", "path")
    sources = [(ref, F.lower("parent_folder"), {"artist": "vendor", "description": "comment"}), (docs, F.col("id"), {"category": "category", "path": "comment"})]
    return ix.merge_sources(v.samples.select("id", "parent_folder", "vendor", "category", "comment"), sources).select("id", "vendor", "category", "comment")


@query("s11_audio_info", """SELECT id, CASE WHEN channels * bit_depth // 8 = 0 THEN 0 ELSE total_samples // (channels * bit_depth // 8) END AS total,
 round(CASE WHEN sample_rate = 0 THEN 0e0 ELSE (total_samples // (channels * bit_depth // 8)) / sample_rate END, 9) AS seconds FROM samples""")
def s11(v):
    info = st.audio_info(F.col("total_samples"), (F.col("channels") * F.col("bit_depth") / 8).cast("long"), F.col("sample_rate"))
    return v.samples.select("id", info["total"].alias("total"), F.round(info["seconds"], 9).alias("seconds"))


@query("s17_full_scan", "SELECT id, path, vendor, mtime FROM samples")
@query("f01_match_all", "SELECT id, path, vendor, mtime FROM samples")
def s17(v):
    return se.search(v.samples, SearchQuery()).select("id", "path", "vendor", "mtime")


@query("s18_row_to_metadata", """SELECT id, path, CASE WHEN bpm BETWEEN 0 AND 65535 THEN bpm END AS bpm, total_samples IS NOT NULL AS has_audio,
 coalesce(CASE WHEN id % 2 = 0 THEN total_samples END, CAST(trunc(duration * sample_rate) AS BIGINT)) AS total FROM samples""")
def s18(v):
    return st.table_rows(v.samples.withColumn("total_samples", F.when(F.col("id") % 2 == 0, F.col("total_samples")))).select("id", "path", "bpm", "has_audio", "total")


@query("s19_point_lookup", "SELECT id, path, marked, umid FROM samples WHERE path = (SELECT path FROM samples WHERE id = 7)")
def s19(v):
    wanted = v.samples.filter("id = 7").select("path").limit(1)
    return v.samples.join(F.broadcast(wanted), "path", "left_semi").select("id", "path", "marked", "umid")


def _some_paths(v):
    return [r.path for r in v.samples.filter("id IN (3, 77, 12, 150)").orderBy(F.col("id").desc()).limit(4).collect()] + ["/missing.wav"]


@query("s20_ordered_lookup", "SELECT CAST(row_number() OVER (ORDER BY id DESC) - 1 AS INT) AS ordinal, id, path FROM samples WHERE id IN (3, 77, 12, 150)")
@query("j06_ordered_rows", "SELECT CAST(row_number() OVER (ORDER BY id DESC) - 1 AS INT) AS ordinal, id, path FROM samples WHERE id IN (3, 77, 12, 150)")
def s20(v):
    return se.rows_for(v.samples, _some_paths(v)).select("ordinal", "id", "path")


@query("s21_embedding_scan", "SELECT id, path, len(vec) AS dim FROM vectors WHERE vec IS NOT NULL AND len(vec) = 64")
def s21(v):
    return v.vectors.filter("vec IS NOT NULL AND size(vec) = 64").select("id", "path", F.size("vec").cast("long").alias("dim"))


@query("k01_paths", f"SELECT path FROM samples WHERE {has('vendor', 'brand#1')}")
def k01(v):
    return se.search(v.samples, SearchQuery({"vendor": "Brand#1"})).select("path")


@query("k02_verbose", """SELECT id, concat_ws(chr(10), path, CASE WHEN vendor <> '' THEN '  vendor: ' || vendor END, CASE WHEN library <> '' THEN '  library: ' || library END,
 CASE WHEN category <> '' THEN '  category: ' || category END, CASE WHEN sound_id <> '' THEN '  sound_id: ' || sound_id END, CASE WHEN description <> '' THEN '  description: ' || description END,
 CASE WHEN comment <> '' THEN '  comment: ' || comment END, CASE WHEN genre_id <> '' THEN '  genre_id: ' || genre_id END, CASE WHEN key <> '' THEN '  key: ' || key END,
 CASE WHEN rating <> '' THEN '  rating: ' || rating END, CASE WHEN umid <> '' THEN '  umid: ' || umid END, '  bpm: ' || bpm,
 CASE WHEN file_id <> 0 THEN '  file_id: ' || lpad(lower(to_hex(file_id)), 16, '0') END) AS line FROM samples""")
def k02(v):
    return v.samples.select("id", se.verbose().alias("line"))


@query("k03_json_lines", "SELECT id, CAST(to_json({'path': path, 'vendor': vendor, 'library': library, 'category': category, 'key': key, 'bpm': bpm, 'rating': rating}) AS VARCHAR) AS line FROM samples")
def k03(v):
    return v.samples.select("id", F.to_json(F.struct("path", "vendor", "library", "category", "key", "bpm", "rating"), {"ignoreNullFields": "false"}).alias("line"))


@query("k04_count_line", f"SELECT count(*) || ' matches' AS line FROM samples WHERE {has('vendor', 'brand#2')}")
def k04(v):
    return se.search(v.samples, SearchQuery({"vendor": "brand#2"})).agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit(" matches")).alias("line"))


@query("k19_stats_lines", """SELECT count(*) AS files, format('{:,}', count(*)) AS files_text, strftime(to_timestamp(max(mtime)) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S UTC') AS latest,
 count(umid) AS embedded FROM samples""")
def k19(v):
    s = st.summary(v.samples.withColumnRenamed("umid", "embedding"))
    return s.select("files", tx.thousands("files").alias("files_text"), tx.utc_time("latest").alias("latest"), "embedded")


@query("f02_substring", f"SELECT id, path FROM docs WHERE {has('description', 'the ')}")
def f02(v):
    return v.docs.filter(tx.contains("description", "The ")).select("id", "path")


@query("f03_like", "SELECT id, path FROM samples WHERE translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%g\\_1%' ESCAPE '\\'")
def f03(v):
    return v.samples.filter(tx.contains("path", "G_1")).select("id", "path")


@query("f04_regex", "SELECT id, path FROM samples WHERE regexp_matches(vendor, 'and#1[0-9]')")
@query("x01_regexp", "SELECT id, path FROM samples WHERE regexp_matches(vendor, 'and#1[0-9]')")
def f04(v):
    return se.search(v.samples, SearchQuery({"vendor": "and#1[0-9]"}, regex=True)).select("id", "path")


FIELDS = {"vendor": "brand#3", "library": "promo", "category": "econ", "sound_id": "s4", "key": "a#"}
for _field, _value in FIELDS.items():

    @query(f"f05_field_{_field}", f"SELECT id, path FROM samples WHERE {has(_field, _value)}")
    def f05(v, field=_field, value=_value):
        return se.search(v.samples, SearchQuery({field: value.upper()})).select("id", "path")


@query("f06_description", f"SELECT id, path FROM samples WHERE {any_has('description comment', 'ring')} ")
def f06(v):
    return se.search(v.samples, SearchQuery({"description": "RING"})).select("id", "path")


@query("f07_bpm_range", "SELECT id, bpm FROM samples WHERE bpm BETWEEN 120 AND 128")
def f07(v):
    return se.search(v.samples, SearchQuery(bpm="120 - 128")).select("id", "bpm")


@query("f08_match_any", f"SELECT id, path FROM samples WHERE {has('vendor', 'brand#7')} OR {has('category', 'promo')} OR coalesce(bpm BETWEEN 100 AND 110, FALSE)")
def f08(v):
    return se.search(v.samples, SearchQuery({"vendor": "brand#7", "category": "promo"}, bpm="100-110", match_any=True)).select("id", "path")


@query("f09_free_text", f"SELECT id, path FROM samples WHERE {any_has(FREE, 'widget')}")
def f09(v):
    return se.search(v.samples, "WIDGET").select("id", "path")


def text_index(v):
    """The samples' text index, built once for a session and a folder of tables."""
    key = v.spark.sparkContext.applicationId, v.sf_dir
    if key not in INDEXES:
        table = Table(v.spark, shared(v.spark, "postings"))
        po.build(table, v.samples, buckets=32)
        INDEXES[key] = table.root
    return Table(v.spark, INDEXES[key])


INDEXES: dict[tuple[str, str], str] = {}


@query("f10_free_text_names", f"SELECT id, path FROM samples WHERE {any_has(FREE.replace('path', 'name'), 'ring_1')}")
@query("j04_semi_join_search", f"SELECT id, path FROM samples WHERE {any_has(FREE.replace('path', 'name'), 'ring_1')}")
def f10(v):
    return po.indexed(v.samples, text_index(v), SearchQuery(free_text="RING_1")).select("id", "path")


@query("f11_column_filter", f"SELECT id, bpm FROM samples WHERE bpm = 125 AND {has('vendor', 'brand')}")
def f11(v):
    return se.search(v.samples, "@bpm=125 @Vendor=BRAND").select("id", "bpm")


@query("f12_multi_value", f"SELECT id, bpm, category FROM samples WHERE bpm IN (120, 125) AND ({has('category', 'promo')} OR {has('category', 'econ')})")
def f12(v):
    return se.search(v.samples, "@bpm=[120,125] @category=[promo,ECON]").select("id", "bpm", "category")


@query("f13_conjunction", f"SELECT id FROM samples WHERE ({has('vendor', 'brand#1')} OR {has('category', 'promo')}) AND {any_has(FREE, 'red')} AND sample_rate = 44100")
def f13(v):
    q = SearchQuery({"vendor": "brand#1", "category": "promo"}, match_any=True, free_text="red", filters=(ColumnFilter("sample_rate", ("44100",)),))
    return se.search(v.samples, q).select("id")


@query("f15_format_filter", "SELECT id FROM samples WHERE contains(bit_depth || CASE WHEN channels = 1 THEN '-bit mono' ELSE '-bit stereo' END, '24-bit st')")
def f15(v):
    return se.search(v.samples, '@format="24-bit ST"').select("id")


@query("f16_name_and_folder", "SELECT id, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') AS name, regexp_extract(path, '([^/]*)/[^/]*$', 1) AS folder FROM samples")
def f16(v):
    return v.samples.select("id", tx.stem("path").alias("name"), tx.basename(tx.parent("path")).alias("folder"))


@query("f17_local_filter", "SELECT id, path FROM vectors WHERE contains(lower(path), '/vec/1')")
def f17(v):
    return v.vectors.filter(F.lower("path").contains("/VEC/1".lower())).select("id", "path")


@query("f18_marked_only", "SELECT id, path FROM samples WHERE marked")
def f18(v):
    return v.samples.filter("marked").select("id", "path")


@query("f19_embeddable", "SELECT id, category FROM samples WHERE NOT starts_with(upper(category), 'LOOP')")
def f19(v):
    return v.samples.filter(st.embeddable()).select("id", "category")


@query("f20_filled_vendor", "SELECT id, vendor FROM samples WHERE vendor <> ''")
def f20(v):
    return v.samples.filter("vendor <> ''").select("id", "vendor")


STARS = "CASE WHEN regexp_full_match({0}, '\\*+') THEN {0} WHEN regexp_full_match({0}, '[0-9]+') THEN repeat('*', least(TRY_CAST({0} AS INT), 5)) ELSE {0} END"
CLOCK = "CASE WHEN {0} >= 3600 THEN ({0} // 3600) || ':' || lpad('' || ({0} % 3600 // 60), 2, '0') || ':' || lpad('' || ({0} % 60), 2, '0') ELSE ({0} // 60) || ':' || lpad('' || ({0} % 60), 2, '0') END"


@query("p01_projection", f"SELECT id, vendor, coalesce('' || bpm, '-') AS bpm, {STARS.format('rating')} AS rating, bit_depth || CASE WHEN channels = 1 THEN '-bit mono' ELSE '-bit stereo' END AS format, regexp_extract(parent_folder, '[^/]*$') AS parent_folder FROM samples")
def p01(v):
    return se.display(v.samples, ["id", "vendor", "bpm", "rating", "format", "parent_folder"])


@query("p02_default_columns", f"SELECT vendor, library, date, {CLOCK.format('CAST(round(duration) AS BIGINT)')} AS duration, '' || sample_rate AS sample_rate, '' || bit_depth AS bit_depth, '' || channels AS channels, {STARS.format('rating')} AS rating, coalesce('' || bpm, '-') AS bpm, subcategory, category, genre_id, sound_id, usage_id, key, take, track, item, comment FROM samples")
def p02(v):
    from ..schema import DEFAULT_COLUMNS

    return se.display(v.samples, DEFAULT_COLUMNS)


@query("a01_row_count", "SELECT count(*) AS files FROM samples")
@query("a15_result_total", "SELECT count(*) AS files FROM samples")
def a01(v):
    return st.summary(v.samples.withColumnRenamed("umid", "embedding")).select("files")


@query("a02_latest", "SELECT max(mtime) AS latest FROM samples")
def a02(v):
    return st.summary(v.samples.withColumnRenamed("umid", "embedding")).select("latest")


@query("a03_top_vendors", "SELECT vendor, count(*) AS n FROM samples WHERE vendor <> '' GROUP BY vendor ORDER BY n DESC, vendor LIMIT 10")
def a03(v):
    return st.top_vendors(v.samples)


@query("a04_peak_sources", "SELECT peaks_source, count(*) AS n FROM samples GROUP BY peaks_source")
def a04(v):
    return st.peak_sources(v.samples)


@query("a05_embedded_count", "SELECT count(vec) AS embedded FROM vectors")
def a05(v):
    return v.vectors.agg(F.count("vec").alias("embedded"))


@query("a06_staleness")
def a06(v):
    return st.staleness(v.state.select("path"), v.listing.select("path"))


@query("a12_peak_decision", """SELECT id, CASE WHEN total_samples % 9 = 0 THEN 'none' WHEN peaks_source = 'packed_u8' THEN 'packed_u8' ELSE 'generated' END AS decided FROM samples""")
def a12(v):
    return v.samples.select("id", st.peak_decision(F.col("peaks_source"), F.lit(False), F.col("total_samples") % 9 == 0).alias("decided"))


@query("a17_duplicate_paths", "SELECT path, count(*) AS n FROM (SELECT parent_folder AS path FROM samples) GROUP BY path HAVING count(*) > 1")
def a17(v):
    return st.duplicates(v.samples.select(F.col("parent_folder").alias("path")))


KEYS = {"bpm": "bpm", "sample_rate": "sample_rate // 1000", "duration": "round(duration)", "vendor": f"nullif({low('vendor')}, '')"}
for _name, _sql in KEYS.items():
    for _down in (False, True):
        _order = f"{_sql} {'DESC NULLS FIRST' if _down else 'ASC NULLS LAST'}, path"

        @query(f"t04_sort_{_name}_{'desc' if _down else 'asc'}", f"SELECT id, row_number() OVER (ORDER BY {_order}) AS place FROM samples")
        def t04(v, name=_name, down=_down):
            order = F.col("k").desc_nulls_first() if down else F.col("k").asc_nulls_last()
            return st.ranked(v.samples.select("id", se.sort_key(name).alias("k"), "path"), [order, F.col("path")]).select("id", "place")


@query("t01_path_order", "SELECT id, row_number() OVER (ORDER BY path) AS place FROM samples")
def t01(v):
    return st.ranked(se.search(v.samples, SearchQuery()).select("id", "path"), [F.col("path")]).select("id", "place")


@query("t02_text_order", f"SELECT id, row_number() OVER (ORDER BY path) AS place FROM samples WHERE {any_has(FREE.replace('path', 'name'), 'ring_1')}")
def t02(v):
    found = po.indexed(v.samples, text_index(v), SearchQuery(free_text="ring_1"))
    return st.ranked(found.select("id", "path"), [F.col("path")]).select("id", "place")


@query("t06_shuffle")
def t06(v):
    return v.samples.select("id", "path").orderBy(F.rand(7))


@query("t07_limit", "SELECT id, path FROM samples ORDER BY path LIMIT 25")
def t07(v):
    return se.search(v.samples, SearchQuery(), 25).select("id", "path")


GRAMS = "SELECT id, unnest(list_transform(range(1, length(d) - 1), lambda i: substr(d, i, 3))) AS gram FROM (SELECT id, translate(description, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS d FROM samples) WHERE length(d) >= 3"


@query("t03_relevance", f"""WITH g AS ({GRAMS}), f AS (SELECT id, gram, count(*) AS tf FROM g GROUP BY id, gram), l AS (SELECT id, count(*) AS len FROM g GROUP BY id),
 q AS (SELECT unnest(['rin', 'ing']) AS gram), d AS (SELECT gram, count(*) AS df FROM f JOIN q USING (gram) GROUP BY gram), n AS (SELECT count(*) AS n, avg(len) AS mean FROM l)
 SELECT id, round(sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * len / mean))), 6) AS score
 FROM f JOIN d USING (gram) JOIN l USING (id), n GROUP BY id """)
def t03(v):
    return po.relevance(text_index(v), "description", "ring")


@query("u01_root_union", "SELECT DISTINCT path FROM (SELECT path FROM state UNION ALL SELECT path FROM listing)")
def u01(v):
    return v.state.select("path").unionByName(v.listing.select("path")).dropDuplicates(["path"])


SCALARS = {
    "c01_ascii_lower": ("docs", lambda: tx.ascii_lower("description"), low("description")),
    "c05_like_escape": ("samples", lambda: tx.like_escape("path"), "replace(replace(replace(path, '\\', '\\\\'), '%', '\\%'), '_', '\\_')"),
    "c06_ascii_clean": ("docs", lambda: tx.ascii_clean("description", 32), "substr(regexp_replace(description, '[^\\x00-\\x7F]', '?', 'g'), 1, 32)"),
    "c07_human_size": ("samples", lambda: tx.human_size(F.col("total_samples") * 512 * (F.col("id") % 3)), "CASE WHEN x >= 1073741824 THEN printf('%.1f GB', round_even(x / 1073741824.0e0, 1)) WHEN x >= 1048576 THEN printf('%.1f MB', round_even(x / 1048576.0e0, 1)) WHEN x >= 1024 THEN printf('%.1f KB', round_even(x / 1024.0e0, 1)) ELSE x || ' bytes' END"),
    "c08_thousands": ("samples", lambda: tx.thousands("total_samples"), "format('{:,}', total_samples)"),
    "c09_utc_time": ("samples", lambda: tx.utc_time("mtime"), "strftime(to_timestamp(mtime) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S UTC')"),
    "c10_duration_text": ("samples", lambda: tx.duration_text(F.col("duration") * 900), CLOCK.format("CAST(round(duration * 900) AS BIGINT)")),
    "c12_stars": ("samples", lambda: tx.stars("rating"), STARS.format("rating")),
    "c13_format_text": ("samples", lambda: tx.format_text("bit_depth", "channels"), "bit_depth || CASE WHEN channels = 1 THEN '-bit mono' ELSE '-bit stereo' END"),
    "c14_path_parts": ("samples", lambda: F.concat_ws("|", tx.stem("path"), tx.parent("path"), tx.basename("path")), "concat_ws('|', regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', ''), regexp_replace(path, '/[^/]*$', ''), regexp_extract(path, '[^/]*$'))"),
    "c38_combine_comments": ("samples", lambda: tx.combine_comments("comment", "key"), "CASE WHEN comment = '' THEN key WHEN key = '' THEN comment WHEN contains(key, comment) THEN key WHEN contains(comment, key) THEN comment ELSE comment || ', ' || key END"),
    "c40_rating_of_number": ("samples", lambda: tx.rating_of_number("rating"), "CASE WHEN regexp_full_match(rating, '[1-5]') THEN repeat('*', TRY_CAST(rating AS INT)) ELSE rating END"),
}
for _name, (_view, _column, _sql) in SCALARS.items():
    _from = "(SELECT *, total_samples * 512 * (id % 3) AS x FROM samples)" if _name.startswith("c07") else _view

    @query(_name, f"SELECT id, {_sql} AS value FROM {_from}")
    def scalar(v, view=_view, column=_column):
        return getattr(v, view).select("id", column().alias("value"))


@query("c04_bpm_parse", "SELECT id, CASE WHEN regexp_full_match(b, '\\+?[0-9]+\\s*') AND TRY_CAST(trim(b) AS BIGINT) <= 65535 THEN TRY_CAST(trim(b) AS INT) END AS value FROM (SELECT id, CASE id % 5 WHEN 0 THEN ' ' || id WHEN 1 THEN id || '  ' WHEN 2 THEN '+' || id WHEN 3 THEN id * 1000 || '' ELSE 'x' || id END AS b FROM samples)")
def c04(v):
    b = F.expr("CASE id % 5 WHEN 0 THEN ' ' || id WHEN 1 THEN id || '  ' WHEN 2 THEN '+' || id WHEN 3 THEN id * 1000 || '' ELSE 'x' || id END")
    return v.samples.select("id", tx.parse_bpm(b).alias("value"))


@query("c11_duration_parse", "SELECT id, CASE len(p) WHEN 2 THEN p[1] * 60 + p[2] WHEN 3 THEN p[1] * 3600 + p[2] * 60 + p[3] END AS value FROM (SELECT id, list_transform(string_split(CASE id % 3 WHEN 0 THEN id || ':07' WHEN 1 THEN '1:' || id % 60 || ':30' ELSE '' || id END, ':'), lambda x: CAST(x AS BIGINT)) AS p FROM samples)")
def c11(v):
    text = F.expr("CASE id % 3 WHEN 0 THEN id || ':07' WHEN 1 THEN '1:' || id % 60 || ':30' ELSE '' || id END")
    return v.samples.select("id", tx.parse_duration(text).alias("value"))
