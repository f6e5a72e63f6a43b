import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfield.errors import FilterParseError
from nearfield.plans.filters import filter_column, parse

ROWS = [
    (1, '{"type": "article", "year": 2024, "price": 99.5, "deleted": false}'),
    (2, '{"type": "book", "year": "2023", "price": "cheap", "deleted": true}'),
    (3, '{"type": null, "year": null}'),
    (4, "{}"),
    (5, None),
    (6, "not json"),
    (7, '{"a": {"b": 5}, "type": "it\'s", "deleted": "true", "year": 5}'),
]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("type = 'article' AND year >= 2024", {1}),
        ("year >= 2023", {1, 2}),
        ("year = '2024'", {1}),
        ("NOT deleted", {1, 3, 4, 5, 6}),
        ("deleted", {2, 7}),
        ("deleted = false", {1}),
        ("price < 100 AND year > 1", {1}),
        ("NOT (type = 'article' or type = 'book')", {3, 4, 5, 6, 7}),
        ("type != 'book'", {1, 7}),
        ("type <> 'book' AND NOT a.b = 4", {1, 7}),
        ("a.b <= 5.0", {7}),
        ("type = 'it''s'", {7}),
        ("NOT NOT year = 5", {7}),
        ("year = 5 OR year = 2024 AND price > 1000", {7}),
        ("missing = 1", set()),
        (None, {1, 2, 3, 4, 5, 6, 7}),
        ("  ", {1, 2, 3, 4, 5, 6, 7}),
    ],
)
def test_rows(spark, text, expected):
    df = spark.createDataFrame(ROWS, "id long, metadata string")
    where = filter_column(text, F.col("metadata"))
    assert {r.id for r in (df if where is None else df.where(where)).collect()} == expected


@pytest.mark.parametrize("text", ["a =", "= 3", "(a", "a)", "a b", "a = 'x", "AND", "a = b", "NOT", "a == 3", "a = 3 OR", "a.", "a = -", "1 = a", "("])
def test_errors(text):
    with pytest.raises(FilterParseError) as e:
        parse(text)
    assert e.value.code == -9


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text_parses_or_fails_cleanly(text):
    try:
        parse(text)
    except FilterParseError:
        pass


def test_promoted_fields_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, 5.0, "{}")], "id long, p_year double, metadata string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = df.where(filter_column("year >= 3", F.col("metadata"), {"year": F.col("p_year")})).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "metadata" not in plan and "GreaterThanOrEqual(p_year,3.0)" in plan
