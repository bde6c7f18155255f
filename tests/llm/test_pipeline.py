import corpus_pipeline as cp

from ..oracle import SF


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    packed = cp.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == before
    assert [n for n, _ in cp.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_stages_on_odd_rows(spark):
    """Nulls, empties, repeated rows, no rows, and columns whose names the operators use."""
    from pyspark.sql import functions as F

    rows = [(None, None), (1, ""), (2, "a"), (2, "a"), (3, None), (4, "x y z " * 400), (5, "line one two three\n" * 3), (None, "t")]
    odd = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    odd = odd.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("row", "dropped", "_row", "_leak", "n_lines", "n_dropped", "doc", "line"))])
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns, name
        assert {tuple(r[5:]) for r in out.collect()} <= {tuple(range(8))}, name
        assert out.count() <= odd.count() and stage(spark, odd.filter("false"), SF).count() == 0, name
    assert cp.near_dedup(spark, odd, SF).count() == 5
    assert cp.line_dedup(spark, odd, SF).filter("text IS NULL").count() == 2
    assert cp.packing(spark, odd, SF).count() >= odd.count() and cp.packing(spark, odd.filter("false"), SF).count() == 0


def test_run(spark):
    assert cp.run(spark, SF).count() > 0
