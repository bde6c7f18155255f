"""Index maintenance, marks, enrichment and workflows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cluster import shared
from ..functions import text as tx
from ..operators import index as ix
from ..operators import workflow as wf
from ..sources.table import Table
from .registry import query
from .search_queries import low

READ = "SELECT l.* FROM listing l LEFT JOIN state s ON l.path = s.path AND l.mtime = s.mtime WHERE s.path IS NULL"
GONE = "SELECT s.path FROM state s LEFT JOIN listing l ON s.path = l.path WHERE l.path IS NULL"


def committed(v):
    """The state as version 1 of a committed table."""
    table = Table(v.spark, shared(v.spark, "state"))
    table.create(v.state, ["path"], buckets=8)
    return table


@query("j02_incremental_skip", f"SELECT path, mtime FROM ({READ})")
def j02(v):
    return ix.to_read(v.listing, v.state).select("path", "mtime")


@query("j03_vanished", GONE)
def j03(v):
    return ix.vanished(v.state, v.listing, ["/o"])


UPSERTED = """SELECT n.path, n.mtime, n.vendor, n.payload, s.id, coalesce(s.marked, FALSE) AS marked FROM ({new}) n LEFT JOIN state s ON n.path = s.path
UNION ALL SELECT s.path, s.mtime, s.vendor, s.payload, s.id, s.marked FROM ({old}) s LEFT JOIN ({new}) n ON n.path = s.path WHERE n.path IS NULL"""


@query("k06_upsert", UPSERTED.format(new="SELECT * FROM listing", old="SELECT * FROM state"))
def k06(v):
    table = committed(v)
    ix.upsert_table(table, v.listing)
    return table.read().select("path", "mtime", "vendor", "payload", "id", "marked")


@query("k06_upsert_strict", """SELECT path, mtime, vendor, payload, NULL AS id, FALSE AS marked FROM listing
UNION ALL SELECT s.path, s.mtime, s.vendor, s.payload, s.id, s.marked FROM state s LEFT JOIN listing n ON n.path = s.path WHERE n.path IS NULL""")
def k06_strict(v):
    table = committed(v)
    ix.upsert_table(table, v.listing, strict=True)
    return table.read().select("path", "mtime", "vendor", "payload", "id", "marked")


@query("k07_row_count")
def k07(v):
    return ix.upsert(v.state, v.listing).agg(F.count(F.lit(1)).alias("rows_written"))


@query("k08_delete", "SELECT s.path, s.mtime FROM state s JOIN listing l ON s.path = l.path")
def k08(v):
    table = committed(v)
    ix.delete_table(table, ix.vanished(v.state, v.listing))
    return table.read().select("path", "mtime")


@query("e02_incremental_index", UPSERTED.format(new=READ, old="SELECT s.* FROM state s JOIN listing l ON s.path = l.path"))
def e02(v):
    table = committed(v)
    ix.refresh_table(table, v.listing, roots=["/o"])
    return table.read().select("path", "mtime", "vendor", "payload", "id", "marked")


@query("k10_put", "SELECT DISTINCT vendor AS key, CASE WHEN vendor = '5-LOW' THEN 'new' ELSE 'old' END AS value FROM state")
def k10(v):
    store = v.state.select(F.col("vendor").alias("key")).distinct().withColumn("value", F.lit("old"))
    return ix.put(store, "5-LOW", F.lit("new"))


@query("k11_marks", "SELECT path FROM state WHERE marked UNION SELECT path FROM listing WHERE payload % 3 = 0 EXCEPT SELECT path FROM state WHERE payload % 5 = 0")
@query("u02_mark_sets", "SELECT path FROM state WHERE marked UNION SELECT path FROM listing WHERE payload % 3 = 0 EXCEPT SELECT path FROM state WHERE payload % 5 = 0")
def k11(v):
    marked = ix.mark(v.state.filter("marked"), v.listing.filter("payload % 3 = 0"))
    return ix.unmark(marked, v.state.filter("payload % 5 = 0"))


@query("j07_attach_marks", "SELECT l.path, s.path IS NOT NULL AS marked FROM listing l LEFT JOIN (SELECT path FROM state WHERE marked) s ON l.path = s.path")
def j07(v):
    return ix.with_marks(v.listing, v.state.filter("marked")).select("path", "marked")


BEST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {low('file_path')} ORDER BY id) AS rn FROM ref) WHERE rn = 1"


@query("j01_enrich", f"""SELECT s.id, coalesce(nullif(r.artist, ''), s.vendor) AS vendor, coalesce(nullif(r.library, ''), nullif(r.cd_title, ''), s.library) AS library,
 coalesce(nullif(r.key, ''), s.key) AS key, coalesce(TRY_CAST(nullif(r.bpm, '') AS INT), s.bpm) AS bpm,
 CASE WHEN TRY_CAST(r.rating AS INT) BETWEEN 1 AND 5 THEN repeat('*', CAST(r.rating AS INT)) ELSE s.rating END AS rating,
 coalesce(nullif(r.description, ''), s.comment) AS comment, coalesce(nullif(r.umid, ''), s.umid) AS umid
 FROM samples s LEFT JOIN ({BEST}) r ON {low('s.parent_folder')} = {low('r.file_path')}""")
def j01(v):
    ref = v.ref.withColumnRenamed("key", "key_name")
    return ix.enrich(v.samples, ref, "parent_folder").select("id", "vendor", "library", "key", "bpm", "rating", "comment", "umid")


@query("j12_nocase_lookup", f"SELECT s.id, r.id AS ref_id, r.artist FROM samples s LEFT JOIN ({BEST}) r ON {low('s.parent_folder')} = {low('r.file_path')}")
@query("s25_external_lookup", f"SELECT s.id, r.id AS ref_id, r.artist FROM samples s LEFT JOIN ({BEST}) r ON {low('s.parent_folder')} = {low('r.file_path')}")
def j12(v):
    return wf.reference_row(v.samples, v.ref, "parent_folder").select("id", F.col("ref.id").alias("ref_id"), "ref.artist")


LOOKUP = """SELECT s.id, CASE WHEN r.id IS NULL THEN s.category ELSE r.category END AS category, CASE WHEN r.id IS NULL THEN s.sound_id ELSE r.short_id END AS sound_id,
 CASE WHEN r.id IS NULL THEN s.key ELSE r.key END AS key,
 CASE WHEN r.id IS NULL THEN s.comment ELSE substr(CASE WHEN s.description = '' THEN r.description WHEN r.description = '' THEN s.description WHEN contains(r.description, s.description) THEN r.description
  WHEN contains(s.description, r.description) THEN s.description ELSE s.description || ', ' || r.description END, 1, 32) END AS comment,
 CASE WHEN r.id IS NULL OR s.vendor <> '' THEN s.vendor ELSE r.artist END AS vendor, CASE WHEN r.id IS NULL THEN s.bpm ELSE coalesce(TRY_CAST(nullif(r.bpm, '') AS INT), s.bpm) END AS bpm,
 coalesce(r.umid, s.umid) AS umid
 FROM samples s LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY id) AS rn FROM ref) WHERE rn = 1) r ON s.parent_folder = r.file_path"""


@query("j11_prefix_lookup", LOOKUP)
@query("x05_lookup_script", LOOKUP)
def j11(v):
    users = v.samples.withColumn("parent_folder", F.concat(F.lit("/Users"), "parent_folder"))
    moved = F.substring(wf.move_prefix("parent_folder", "/vol"), len("/vol/Users") + 1, 1000)
    return wf.lookup_update(users, v.ref, moved).select("id", "category", "sound_id", "key", "comment", "vendor", "bpm", "umid")


def _tag_sql(corpus: str) -> str:
    groups = " ".join("WHEN " + " OR ".join(f"contains({corpus}, '{w}')" for w in words) + f" THEN '{tag}'" for words, tag in tx.KEYWORDS)
    return f"CASE WHEN category <> '' THEN category {groups} ELSE '' END"


TAG = _tag_sql("lower(concat_ws(' ', description, sound_id, comment, vendor, library))")


@query("c39_tag_category", f"SELECT id, {TAG} AS category FROM samples")
def c39(v):
    return wf.tag_categories(v.samples).select("id", "category")


@query("c36_packed_change", f"SELECT id, category IS DISTINCT FROM {TAG} OR bpm IS DISTINCT FROM coalesce(bpm, 120) AS differs FROM samples")
def c36(v):
    after = wf.tag_categories(v.samples).withColumn("bpm", F.coalesce("bpm", F.lit(120)))
    fields = [*wf.DIFF_FIELDS, "bpm"]
    both = v.samples.select("id", F.struct(*fields).alias("b")).join(after.select("id", F.struct(*fields).alias("a")), "id")
    return both.select("id", wf.packed_fields_differ("b", "a").alias("differs"))


DIFF = f"""SELECT path, 'category' AS field, category AS old, {TAG} AS new FROM samples WHERE category <> {TAG}
 UNION ALL SELECT path, 'bpm', '—', '120' FROM samples WHERE bpm IS NULL"""


@query("c34_meta_diff", DIFF)
@query("x04_workflow", DIFF)
def c34(v):
    after = wf.tag_categories(v.samples).withColumn("bpm", F.coalesce("bpm", F.lit(120)))
    return wf.changes(v.samples, after).select("path", F.explode("diff").alias("d")).select("path", "d.*")


def shout(sample: wf.Sample) -> None:
    if sample.bpm is None:
        sample.set("bpm", 100)
    sample.set("comment", f"{sample.vendor}: {sample.description} – {sample.library}")


@query("x02_row_script", "SELECT id, coalesce(bpm, 100) AS bpm, substr(vendor || ': ' || description || ' ? ' || library, 1, 32) AS comment FROM samples")
def x02(v):
    rows = v.samples.select("id", "vendor", "description", "library", "comment", "bpm")
    return wf.run_script(rows, shout).select("id", "bpm", "comment")
