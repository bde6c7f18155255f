"""Vectors: distances, quantised codes and rankings."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from ..cluster import shared
from ..functions import vectors as ve
from ..operators import similar as si
from ..operators import stats as st
from ..sources.table import Table
from .registry import query

SUBJECT, PARTS, CENTROIDS, WIDTH = 7, 16, 256, 4

D = "sqrt(list_sum(list_transform(list_zip(v.vec, q.vec), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))))"
ALL = f"SELECT v.id, v.path, {D} AS dist FROM vectors v, (SELECT vec FROM vectors WHERE id = {SUBJECT}) q"
CODES = f"""x AS (SELECT id, CAST(unnest(range(len(vec))) AS INT) AS pos, unnest(vec) AS v FROM vectors),
cb AS (SELECT id AS k, pos, CAST(v AS DOUBLE) AS cv FROM x WHERE id < {CENTROIDS}),
dd AS (SELECT x.id, CAST(floor(x.pos / 4e0) AS INT) AS m, cb.k, round(sum((CAST(x.v AS DOUBLE) - cv) * (CAST(x.v AS DOUBLE) - cv)), 9) AS d FROM x JOIN cb ON x.pos = cb.pos GROUP BY 1, 2, 3),
code AS (SELECT id, m, k FROM (SELECT *, row_number() OVER (PARTITION BY id, m ORDER BY d, k) AS rn FROM dd) WHERE rn = 1)"""


def book(v):
    """Centroid k of part m: that part of vector k. Collected once for a session and folder."""
    key = v.spark.sparkContext.applicationId, v.sf_dir
    if key not in BOOKS:
        rows = v.vectors.filter(F.col("id") < CENTROIDS).orderBy("id").select("vec").limit(CENTROIDS).collect()
        BOOKS[key] = [[[float(x) for x in r.vec[m * WIDTH : (m + 1) * WIDTH]] for r in rows] for m in range(PARTS)]
    return BOOKS[key]


def coded(v):
    """The stored codes of all vectors, brought up to date once for a session and folder."""
    key = v.spark.sparkContext.applicationId, v.sf_dir
    if key not in CODED:
        table = Table(v.spark, shared(v.spark, "codes"))
        si.encode_new(table, v.vectors, book(v), 1, buckets=8)
        CODED[key] = table.root
    return Table(v.spark, CODED[key]).read()


BOOKS: dict[tuple[str, str], list] = {}
CODED: dict[tuple[str, str], str] = {}


@query("c15_distance", f"SELECT id, round(dist, 6) AS dist FROM ({ALL})")
@query("j08_one_to_all", f"SELECT id, round(dist, 6) AS dist FROM ({ALL})")
def c15(v):
    one = v.vectors.filter(f"id = {SUBJECT}").select(F.col("vec").alias("q")).limit(1)
    return v.vectors.join(F.broadcast(one)).select("id", F.round(ve.distance(F.col("vec"), F.col("q")), 6).alias("dist"))  # one row


@query("c16_similarity", f"SELECT id, round(greatest(0e0, least(1e0, 1 - dist / max(dist) OVER ())), 6) AS sim FROM ({ALL})")
def c16(v):
    _, vec = si._subject(v.vectors, SUBJECT)
    dist = v.vectors.select("id", ve.distance(F.col("vec"), si._literal(vec)).alias("dist"))
    most = dist.agg(F.max("dist").alias("most"))
    return dist.join(F.broadcast(most)).select("id", F.round(ve.similarity(F.col("dist"), F.col("most")), 6).alias("sim"))  # one row


TOP = f"""WITH o AS (SELECT id, path, dist FROM ({ALL}) WHERE id <> {SUBJECT} ORDER BY dist, id LIMIT 9),
r AS (SELECT id, path, dist, 1 - dist / max(dist) OVER () AS sim FROM o UNION ALL SELECT id, path, 0, 1 FROM vectors WHERE id = {SUBJECT})"""


@query("t08_exact_top", f"{TOP} SELECT id, path, round(dist, 6) AS dist, round(greatest(0e0, least(1e0, sim)), 6) AS sim FROM r")
@query("w06_similarity_window", f"{TOP} SELECT id, path, round(dist, 6) AS dist, round(greatest(0e0, least(1e0, sim)), 6) AS sim FROM r")
def t08(v):
    return si.similar(v.vectors, SUBJECT, 10).select("id", "path", F.round("dist", 6).alias("dist"), F.round("sim", 6).alias("sim"))


@query("k05_similar_lines", f"{TOP} SELECT path AS line FROM r")
def k05(v):
    return si.lines(si.similar(v.vectors, SUBJECT, 10), "path")


@query("j05_attach_scores", f"{TOP} SELECT v.id, CASE WHEN r.sim IS NOT NULL THEN round(greatest(0e0, least(1e0, r.sim)), 6) END AS sim FROM vectors v LEFT JOIN r ON v.path = r.path")
def j05(v):
    return si.attach(v.vectors, si.similar(v.vectors, SUBJECT, 10)).select("id", F.round("sim", 6).alias("sim"))


@query("t05_similarity_sort", f"{TOP} SELECT v.id, row_number() OVER (ORDER BY v.id = {SUBJECT} DESC, round(r.sim, 6) DESC NULLS LAST, v.id) AS place FROM vectors v LEFT JOIN r ON v.path = r.path")
def t05(v):
    scores = si.similar(v.vectors, SUBJECT, 10).withColumn("sim", F.round("sim", 6))
    order = [(F.col("id") == SUBJECT).desc(), F.col("sim").desc_nulls_last(), F.col("id")]
    return st.ranked(si.attach(v.vectors, scores).select("id", "sim"), order).select("id", "place")


@query("c17_encode", f"WITH {CODES} SELECT id, m, k FROM code")
@query("j09_nearest_centroid", f"WITH {CODES} SELECT id, m, k FROM code")
def c17(v):
    return coded(v).select("id", F.posexplode("code").alias("m", "k")).withColumn("k", F.col("k").cast("long"))


@query("c18_query_table", f"WITH {CODES} SELECT m, k, d FROM dd WHERE id = {SUBJECT}")
def c18(v):
    table = ve.query_table(si._subject(v.vectors, SUBJECT)[1], book(v))
    return v.spark.createDataFrame([(m, k, d) for m, row in enumerate(table) for k, d in enumerate(row)], "m int, k long, d double")


ADC = f"{CODES}, tab AS (SELECT m, k, d FROM dd WHERE id = {SUBJECT}), s AS (SELECT c.id, round(sum(t.d), 6) AS sq FROM code c JOIN tab t ON c.m = t.m AND c.k = t.k GROUP BY 1)"


@query("c19_table_distance", f"WITH {ADC} SELECT id, sq FROM s")
@query("j10_code_lookup", f"WITH {ADC} SELECT id, sq FROM s")
def c19(v):
    table = ve.query_table(si._subject(v.vectors, SUBJECT)[1], book(v))
    return coded(v).select("id", F.round(ve.table_distance(F.col("code"), table), 6).alias("sq"))


@query("t09_quantised_top", f"""WITH {ADC}, top AS (SELECT id, sqrt(sq) AS dist FROM s ORDER BY sq, id LIMIT 11), w AS (SELECT id, dist, max(dist) OVER () AS mx FROM top),
 o AS (SELECT id, dist, 1 - dist / mx AS sim FROM w WHERE id <> {SUBJECT} ORDER BY dist, id LIMIT 9)
 SELECT id, round(dist, 6) AS dist, round(greatest(0e0, least(1e0, sim)), 6) AS sim FROM (SELECT * FROM o UNION ALL SELECT {SUBJECT}, 0, 1)""")
def t09(v):
    found = si.similar_quantised(coded(v), v.vectors, SUBJECT, book(v), 10)
    return found.select("id", F.round("dist", 6).alias("dist"), F.round("sim", 6).alias("sim"))


@query("k09_set_embedding", "SELECT id, CASE WHEN id % 3 = 0 THEN len(vec) END AS dim FROM vectors")
def k09(v):
    samples = v.vectors.select("id", "path", F.expr("CAST(NULL AS array<float>)").alias("embedding"))
    return si.set_embeddings(samples, v.vectors.filter("id % 3 = 0"), 64).select("id", F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("long").alias("dim"))


def stub(paths: list[str]) -> np.ndarray:
    return np.array([np.random.default_rng(zlib.crc32(p.encode())).normal(size=64) for p in paths])


@query("m06_batch_encode")
def m06(v):
    return si.embed(v.vectors, stub, 64)


@query("m07_training_sample")
def m07(v):
    return si.training_sample(v.vectors.withColumnRenamed("label", "category"), 100).select("id")


@query("m08_train_codebook")
def m08(v):
    return si.train_codebook(v.vectors, PARTS, CENTROIDS, rounds=4, passes=2)


UNIFORM = "(CAST(('0x' || substr(md5('0:' || id || ':' || i || ':{}'), 1, 8)) AS BIGINT) + 0.5e0) / 4294967296e0"


@query("m10_synthetic", f"""WITH g AS (SELECT id, i, sqrt(-2 * ln({UNIFORM.format(0)})) * cos(2 * pi() * {UNIFORM.format(1)}) AS g FROM vectors, range(1, 17) t(i)),
 l AS (SELECT id, sqrt(sum(g * g)) AS l FROM g GROUP BY id) SELECT g.id, CAST(i - 1 AS INT) AS pos, round(CAST(CAST(g / l AS FLOAT) AS DOUBLE), 5) AS v FROM g JOIN l USING (id)""")
def m10(v):
    made = si.synthetic(v.vectors, 16)
    return made.select("id", F.posexplode("vec").alias("pos", "v")).withColumn("v", F.round(F.col("v").cast("double"), 5))
