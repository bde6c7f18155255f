"""The driver's tables as the library's views, for Spark and for DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: SQL that both engines run; ``{text}`` is the engine's text type.
VIEWS = {
    "samples": """
SELECT p_partkey AS id, '/lib/' || p_brand || '/' || replace(p_name, ' ', '_') || '_' || p_partkey || '.wav' AS path,
  replace(p_name, ' ', '_') || '_' || p_partkey AS name, '/lib/' || p_brand AS parent_folder,
  CASE WHEN p_partkey % 17 = 0 THEN '' ELSE p_brand END AS vendor, p_brand || ' ' || p_type AS library,
  CASE WHEN p_partkey % 13 = 0 THEN '' WHEN p_partkey % 19 = 0 THEN 'LOOP' ELSE p_type END AS category,
  'S' || p_size AS sound_id, p_name AS description, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE 'Comment ' || p_partkey END AS comment,
  CASE WHEN p_partkey % 12 = 0 THEN 'C' WHEN p_partkey % 12 = 5 THEN 'A#m' ELSE '' END AS key,
  CASE WHEN p_partkey % 4 = 0 THEN '****' WHEN p_partkey % 4 = 1 THEN '' || (p_partkey % 7) ELSE '' END AS rating,
  '' AS subcategory, CASE WHEN p_partkey % 6 = 0 THEN 'ACID' ELSE '' END AS genre_id, '' AS usage_id, 'u' || p_partkey AS umid,
  '2026-02-16' AS date, '' AS take, '' AS track, '' AS item,
  CASE WHEN p_partkey % 3 = 0 THEN CAST(80 + p_partkey % 100 AS INT) END AS bpm, p_partkey * 7919 AS file_id, 1700000000 + p_partkey * 977 AS mtime,
  CASE p_partkey % 4 WHEN 0 THEN 'packed_u8' WHEN 1 THEN 'bwf_reserved' WHEN 2 THEN 'generated' ELSE 'none' END AS peaks_source, p_partkey % 5 = 0 AS marked,
  (p_partkey * 997) % 400000 AS total_samples,
  CASE p_partkey % 3 WHEN 0 THEN 44100 WHEN 1 THEN 48000 ELSE 96000 END AS sample_rate,
  CASE p_partkey % 2 WHEN 0 THEN 16 ELSE 24 END AS bit_depth, CAST(1 + p_partkey % 2 AS INT) AS channels,
  CAST((p_partkey * 997) % 400000 AS DOUBLE) / CASE p_partkey % 3 WHEN 0 THEN 44100 WHEN 1 THEN 48000 ELSE 96000 END AS duration
FROM part""",
    "docs": """
SELECT doc_id AS id, '/docs/' || source || '/' || doc_id || '.txt' AS path, '' || doc_id AS name, source AS vendor, lang AS library, lang AS category,
  '' AS sound_id, text AS description, '' AS comment, '' AS key FROM documents""",
    "frames": """
SELECT user_id AS path, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
  CAST(floor(value * 10) AS INT) % 257 - 128 AS s FROM events""",
    "stereo": """
SELECT user_id AS path, CAST(event_id % 2 AS INT) AS channel, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id) - 1 AS frame,
  CAST(floor(value * 10) AS INT) % 257 - 128 AS s FROM events""",
    "vectors": "SELECT vec_id AS id, '/vec/' || vec_id AS path, embedding AS vec, label FROM embeddings",
    "state": """
SELECT o_orderkey AS id, '/o/' || o_orderkey AS path, 1000 + o_orderkey AS mtime, o_orderpriority AS vendor, o_orderkey % 4 = 0 AS marked,
  CAST(floor(o_totalprice) AS BIGINT) AS payload FROM orders WHERE o_orderkey % 10 <> 0""",
    "listing": """
SELECT '/o/' || o_orderkey AS path, 1000 + o_orderkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS mtime, 'new ' || o_orderstatus AS vendor,
  CAST(floor(o_totalprice) AS BIGINT) + 1 AS payload FROM orders WHERE o_orderkey % 7 <> 0""",
    "ref": """
SELECT CASE WHEN c_custkey % 2 = 0 THEN upper('/lib/Brand#' || (c_custkey % 25)) ELSE '/lib/Brand#' || (c_custkey % 25) END AS file_path,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS artist, CASE WHEN c_custkey % 5 = 0 THEN 'Lib ' || c_custkey ELSE '' END AS library,
  CASE WHEN c_custkey % 5 = 1 THEN 'CD ' || c_custkey ELSE '' END AS cd_title, c_mktsegment AS category, 'Sub' AS sub_category, 'ID' || (c_custkey % 9) AS short_id,
  CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '' || (60 + c_custkey % 120) END AS bpm, CASE WHEN c_custkey % 6 = 0 THEN 'Dm' ELSE '' END AS key,
  '' || (c_custkey % 8) AS rating, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'about ' || c_custkey END AS description, CASE WHEN c_custkey % 2 = 0 THEN 'r' || c_custkey ELSE '' END AS umid,
  c_custkey AS id FROM customer""",
    "markers": """
SELECT p_partkey AS path, (p_partkey * 997) % 400000 AS total,
  CASE WHEN p_partkey % 7 = 0 THEN 4294967295 ELSE (p_partkey * 131) % 500000 END AS m1,
  CASE WHEN p_partkey % 5 = 0 THEN 4294967295 ELSE (p_partkey * 37) % 400000 END AS m2,
  CASE WHEN p_partkey % 3 = 0 THEN 4294967295 ELSE (p_partkey * 211) % 450000 END AS m3,
  CAST(p_partkey % 3 AS INT) AS r1, CAST(CASE WHEN p_partkey % 11 = 0 THEN 15 ELSE p_partkey % 2 END AS INT) AS r2,
  CAST(p_partkey % 4 AS INT) AS r3, CAST(p_partkey % 5 AS INT) AS r4, (p_partkey * 53) % 400000 AS cursor FROM part""",
}
TABLES = {"samples": "part", "docs": "documents", "frames": "events", "stereo": "events", "vectors": "embeddings", "state": "orders", "listing": "orders", "ref": "customer", "markers": "part"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the table in ``sf_dir``."""
    table = TABLES[name]
    sql = VIEWS[name].rsplit(f"FROM {table}", 1)
    return spark.sql(f"FROM {table}".join([sql[0], sql[1]]).replace(f"FROM {table}", "FROM {source}"), source=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def with_views(sql: str) -> str:
    """DuckDB SQL with the views it names as its first common tables."""
    import re

    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in used)
    body = sql.strip()
    if not head:
        return body
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
