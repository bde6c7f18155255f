import pytest

from samplelake.operators import search as se
from samplelake.operators.search import ColumnFilter, SearchQuery
from samplelake.plans.adapters import view

from .oracle import SF


@pytest.mark.parametrize(
    ("text", "free", "filters"),
    [
        ("@vendor=Mars", "", [("vendor", ("Mars",))]),
        ("kick @vendor=Mars", "kick", [("vendor", ("Mars",))]),
        ("@bpm=[120,125]", "", [("bpm", ("120", "125"))]),
        ("@vendor=Mars @category=LOOP", "", [("vendor", ("Mars",)), ("category", ("LOOP",))]),
        ("@foo=bar", "@foo=bar", []),
        ("@vendor=", "@vendor=", []),
        ("@Vendor=x", "", [("vendor", ("x",))]),
        ('@vendor="Beat MPC"', "", [("vendor", ("Beat MPC",))]),
        ('@vendor="open end', "", [("vendor", ("open end",))]),
        ('@vendor=""', '@vendor=""', []),
        ("", "", []),
    ],
)
def test_parse_filters(text, free, filters):
    assert se.parse_filters(text) == (free, tuple(ColumnFilter(*f) for f in filters))


@pytest.mark.parametrize(("text", "bounds"), [("120", (120, 120)), ("120-128", (120, 128)), (" 120 - 128 ", (120, 128)), ("fast", None), ("99999", None), ("", None)])
def test_parse_range(text, bounds):
    assert se.parse_range(text) == bounds


def test_refused(spark):
    samples = view(spark, SF, "samples")
    for bad in (SearchQuery({"vendor": "(?=x)"}, regex=True), SearchQuery(filters=(ColumnFilter("sim", ("1",)),)), SearchQuery(filters=(ColumnFilter("bpm", ("x",)),))):
        with pytest.raises(ValueError):
            se.search(samples, bad)
    with pytest.raises(ValueError):
        se.rows_for(samples, ["/a", "/a"])
    with pytest.raises(ValueError):
        se.rows_for(samples, [str(i) for i in range(501)])


def test_unparsable_range_is_no_filter(spark):
    samples = view(spark, SF, "samples")
    assert se.search(samples, SearchQuery(bpm="fast")).count() == samples.count()


def test_filter_is_pushed_to_the_scan(spark):
    samples = spark.read.parquet(f"{SF}/part.parquet").selectExpr("p_brand AS vendor", "p_size AS bpm", "p_name AS path")
    plan = se.search(samples, SearchQuery(bpm="10-20")).select("path")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(p_size,10)" in plan and "p_brand" not in plan.split("ReadSchema")[1]
