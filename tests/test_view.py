import math
import operator
import re

import pytest

from colscope.functions.cells import stage
from colscope.operators.display import render_columns, tsv_rows, value_text
from colscope.operators.metadata import column_listing, match_columns, search_columns
from colscope.operators.view import (
    Filter, Sort, ViewSpec, apply_view, filter_predicate, number_rows, operators_for_type, parse_date, parse_number,
)
from colscope.sources.table import Table

TYPES = ("text", "number", "date", "boolean")


@pytest.fixture(scope="module")
def people(spark):
    rows = [
        ("Ada", 10, "2024-01-03", True, 0), ("Grace", None, "2023-06-15", False, 1),
        ("Alan", 10, "2024-02-01", True, 2), (None, 25, None, None, 3),
    ]
    df = spark.createDataFrame(rows, "name string, score int, joined string, active boolean, _row_index bigint")
    return Table.from_dataframe(df, order=["_row_index"])


def ids(table, spec, types=TYPES):
    return [r["_row_index"] for r in apply_view(table, spec, types).df.collect()]


def test_all_filters_in_one_pass(people):
    cases = [
        (0, "contains", "AD", [0]), (0, "notContains", "D", [1, 2]), (0, "equals", "ada", [0]),
        (0, "notEquals", "ADA", [1, 2]), (0, "startsWith", "GR", [1]), (0, "endsWith", "AN", [2]),
        (0, "isEmpty", None, [3]), (0, "isNotEmpty", None, [0, 1, 2]),
        (1, "equals", "10", [0, 2]), (1, "notEquals", "10", [3]), (1, "greaterThan", "10", [3]),
        (1, "greaterThanOrEqual", "10", [0, 2, 3]), (1, "lessThan", "25", [0, 2]),
        (1, "lessThanOrEqual", "10", [0, 2]), (1, "isEmpty", None, [1]), (1, "isNotEmpty", None, [0, 2, 3]),
        (1, "equals", "10.5", []), (1, "lessThan", "10.5", [0, 2]), (1, "equals", "0xA", [0, 2]),
        (2, "greaterThan", "2024-01-03", [2]), (2, "equals", "2024-01-03T00:00:00Z", [0]),
        (2, "notEquals", "2024-01-03", [1, 2]), (2, "contains", "2024", []),
        (3, "isTrue", None, [0, 2]), (3, "isFalse", None, [1]), (3, "isEmpty", None, [3]),
    ]
    for column, operator, value, expected in cases:
        assert ids(people, ViewSpec(filters=(Filter(column, operator, value),))) == expected, (operator, value)


def test_ranges_search_and_sort(people):
    between = ViewSpec(filters=(Filter(1, "between", "20", "10"),))
    assert ids(people, between) == [0, 2]
    dates = ViewSpec(filters=(Filter(2, "between", "2024-01-01", "2024-01-31"),))
    assert ids(people, dates) == [0]
    both = ViewSpec("a", (Filter(1, "greaterThanOrEqual", "10"), Filter(3, "isTrue")))
    assert ids(people, both) == [0, 2]
    assert ids(people, ViewSpec(" TRUE ")) == [0, 2]
    assert ids(people, ViewSpec("25")) == [3]
    assert ids(people, ViewSpec(sort=Sort(1, "asc"))) == [0, 2, 3, 1]
    assert ids(people, ViewSpec(sort=Sort(1, "desc"))) == [3, 0, 2, 1]
    assert ids(people, ViewSpec(sort=Sort(3, "desc"))) == [0, 2, 1, 3]


def test_natural_sort(spark):
    words = ["item10", "Eclair2", "item1", "zeta", "éclair", "Item2", None]
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "w string, _row_index bigint")
    table = Table.from_dataframe(df, order=["_row_index"])
    found = apply_view(table, ViewSpec(sort=Sort(0, "asc")), ["text"]).df.collect()
    assert [r["c0"] for r in found] == ["éclair", "Eclair2", "item1", "Item2", "item10", "zeta", None]


def test_natural_sort_of_long_numbers(spark):
    words = ["n" + "9" * 41, "n1" + "0" * 44, "n" + "0" * 60 + "7", "n8", "n" + "9" * 40]
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "w string, _row_index bigint")
    found = apply_view(Table.from_dataframe(df, order=["_row_index"]), ViewSpec(sort=Sort(0, "asc")), ["text"]).df.collect()
    assert [words.index(r["c0"]) for r in found] == [2, 3, 4, 0, 1]


def test_decimal_bounds_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.sql("SELECT CAST(id AS DECIMAL(12,2)) / 8 AS v FROM range(100)").selectExpr("CAST(v AS DECIMAL(12,2)) AS v").write.parquet(path)
    view = apply_view(
        Table.from_dataframe(spark.read.parquet(path)), ViewSpec(filters=(Filter(0, "between", "1.005", "2.5"),)), ["number"]
    )
    assert sorted(float(r["c0"]) for r in view.df.collect()) == [1.13, 1.25, 1.38, 1.5, 1.63, 1.75, 1.88, 2.0, 2.13, 2.25, 2.38, 2.5]
    assert "GreaterThanOrEqual(v,1.01)" in view.df._jdf.queryExecution().executedPlan().toString()


def test_typed_filters_reach_the_scan(spark, sf):
    table = Table.from_dataframe(spark.read.parquet(f"{sf}/orders.parquet"))
    spec = ViewSpec(filters=(Filter(4, "between", "1997-01-01", "1997-06-30"), Filter(0, "greaterThan", "10.5")))
    view = apply_view(table, spec, ["number", "number", "text", "number", "date", "text"])
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = view.df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(o_orderdate" in plan and "GreaterThanOrEqual(o_orderkey,11)" in plan


def test_whole_texts_are_searched(spark):
    table = Table.from_dataframe(spark.createDataFrame([("x" * 150_000 + "Needle",)], "t string"))
    assert apply_view(table, ViewSpec("needle"), ["text"]).df.count() == 1
    assert apply_view(table, ViewSpec(filters=(Filter(0, "endsWith", "NEEDLE"),)), ["text"]).df.count() == 1


def test_validation_messages():
    assert operators_for_type("boolean") == ("isTrue", "isFalse", "isEmpty", "isNotEmpty")
    cases = [
        (Filter(1, "greaterThan", "ten"), "number", "Enter a valid number."),
        (Filter(2, "greaterThan", "not-a-date"), "date", "Enter a valid date."),
        (Filter(-1, "isEmpty"), "text", "Select a valid column."),
        (Filter(0, "isTrue"), "text", "This operator is not available for the column type."),
        (Filter(0, "contains", "  "), "text", "Enter a filter value."),
        (Filter(0, "contains", "x" * 2001), "text", "Filter values are limited to 2,000 characters."),
        (Filter(1, "between", "1"), "number", "Enter both ends of the range."),
        (Filter(1, "between", "1", "b"), "number", "Enter a valid number for both ends of the range."),
        (Filter(1, "between", "2024-01-01", "b"), "date", "Enter a valid date for both ends of the range."),
        (Filter(1, "between", "1", "2"), "number", None),
    ]
    for condition, kind, message in cases:
        assert condition.error(kind) == message
    assert parse_number("0x1F") == 31 and parse_number("1e999") is None and parse_number("Infinity") is None
    assert parse_date("1970-01-01T01:00:00.250+01:00") == 250 and parse_date("2024-02-30") is None


def test_saved_views():
    saved = {
        "query": "Ada",
        "filters": [
            {"id": "valid", "columnIndex": 0, "operator": "contains", "value": "ad"},
            {"id": "wrong-type", "columnIndex": 1, "operator": "contains", "value": "1"},
            {"id": "outside", "columnIndex": 99, "operator": "contains", "value": "x"},
            {"id": "", "columnIndex": 0, "operator": "contains", "value": "x"}, "junk",
        ],
        "sort": {"columnIndex": 2, "direction": "desc"},
    }
    spec = ViewSpec.from_dict(saved, TYPES)
    assert spec.query == "Ada" and [f.id for f in spec.filters] == ["valid"] and spec.sort == Sort(2, "desc")
    assert ViewSpec.from_dict(None, TYPES) == ViewSpec()
    assert spec.toggle_sort(2).sort == Sort(2, "asc") and spec.toggle_sort(2).toggle_sort(2).sort == Sort(2, "desc")
    assert Filter(1, "between", "1", "5").describe(["name", "score"]) == "score: Between 1 and 5"
    assert Filter(7, "isEmpty").describe(["name"]) == "Column 8: Is empty"


def test_row_numbers_follow_the_order(spark):
    df = spark.range(5000).selectExpr("(id * 7919) % 5000 AS v").orderBy("v")
    assert number_rows(df, "n", start=0).where("n <> v").count() == 0


def test_display_and_copy(spark):
    df = spark.createDataFrame(
        [(1234567.5, "true", "2024-01-02", "00123"), (None, "no", "not-a-date", "a\tb"), (1e-7, "FALSE", "2024-01-02T03:04:05Z", 'say "hi"')],
        "n double, b string, d string, t string",
    ).coalesce(1)
    table = Table.from_dataframe(df)
    shown = render_columns(table, ["number", "boolean", "date", "text"]).collect()
    assert tuple(shown[0]) == ("1,234,567.5", "True", "Jan 02, 2024", "00123")
    assert tuple(shown[1]) == ("NULL", "no", "not-a-date", "a\tb")
    assert tuple(shown[2]) == ("0.0000001", "False", "Jan 02, 2024, 03:04:05 UTC", 'say "hi"')
    lines = [r["value"] for r in tsv_rows(table).collect()]
    assert lines[1] == '\tno\tnot-a-date\t"a\tb"' and lines[2].endswith('\t"say ""hi"""')
    assert [r["value"] for r in value_text(table, 0).collect()] == ["1234567.5", "", "1e-7"]


def test_column_search(spark):
    names = ["event_date", "date_column", "created_date", "DATE", "name"]
    assert match_columns(names, "date") == ([3, 1, 0, 2], 4)
    assert match_columns(["a", "ab", "abc"], "a", 2) == ([0, 1], 3)
    assert match_columns(["name"], "  ") == ([], 0)
    listing = column_listing(spark, {"t": names, "u": ["Dates"]})
    found = search_columns(listing, "date", 3).orderBy("position").collect()
    assert [(r["table"], r["ordinal"], r["total"]) for r in found] == [("t", 3, 5), ("t", 1, 5), ("u", 0, 5)]
    assert search_columns(listing, " ").count() == 0


SINGLES = [0.1, -0.1, 0.0, 1.5, 16777216.0, 3.4028235e38, -3.4028235e38, 1e-45, None, float("nan"), float("inf"), float("-inf")]
WIDE = ["0.10", "0.11", "-0.10", "123456789012345678.90", "123456789012345678.91", "-999999999999999999.99", "0.00", None]
BOUNDS = ["0.1", "0", "-0.1", "1.5", "16777217", "1e39", "-1e39", "123456789012345678.9", "1e18", "1e308", "-1e308"]


@pytest.mark.parametrize("kind, values", [("float", SINGLES), ("decimal(20,2)", WIDE)])
def test_pushed_bounds_of_floats_and_wide_decimals(spark, tmp_path, kind, values):
    """Filters keep what the comparison of doubles keeps, and their bounds reach the scan."""
    path = str(tmp_path / "t")
    spark.createDataFrame([(None if v is None else str(v),) for v in values], "s string").selectExpr(
        "CAST(s AS DOUBLE) AS d" if kind == "float" else "s AS d"
    ).selectExpr(f"CAST(d AS {kind}) AS n").coalesce(1).write.parquet(path)
    table = spark.read.parquet(path)
    cell = stage(table).cells[0]
    doubles = [r["d"] for r in table.selectExpr("CAST(n AS DOUBLE) AS d").collect()]
    finite = [d for d in doubles if d is not None and math.isfinite(d)]
    compare = {
        "equals": operator.eq, "notEquals": operator.ne, "greaterThan": operator.gt,
        "greaterThanOrEqual": operator.ge, "lessThan": operator.lt, "lessThanOrEqual": operator.le,
    }
    staged = stage(table)
    for bound in BOUNDS:
        for name, test in compare.items():
            kept = staged.df.where(filter_predicate(Filter(0, name, bound), cell, "number"))
            found = [r["d"] for r in kept.selectExpr("CAST(n AS DOUBLE) AS d").collect()]
            assert sorted(found) == sorted(d for d in finite if test(d, float(bound))), (bound, name)
    between = filter_predicate(Filter(0, "between", "0.05", "1.6"), cell, "number")
    kept = staged.df.where(between)
    assert kept.count() == sum(0.05 <= d <= 1.6 for d in finite)
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    pushed = re.search(r"PushedFilters: \[(.*?)\]", kept._jdf.queryExecution().toString())[1]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(n" in pushed and "LessThan" in pushed
