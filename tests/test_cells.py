import datetime as dt
import decimal

from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.functions.cells import stage
from colscope.functions.numbers import localized_number, number_text
from colscope.functions.text import CUT_MARKER, cut_text, is_cut, trim_blanks, utf16_units


def texts(spark, values, *expressions):
    df = spark.createDataFrame([(v,) for v in values], "v string").coalesce(1)
    return [tuple(r) for r in df.selectExpr(*expressions).collect()]


def test_value_types_of_text(spark):
    cases = {
        "12": "number", " +1.5e3\t": "number", ".5": "number", "5.": "number", "1e999": "number",
        "5d": "text", "NaN": "text", "Infinity": "text", "0x10": "text", "1\n2": "text",
        "true": "boolean", " FALSE ": "boolean", "truely": "text",
        "2024-01-31": "date", "2024-01-02T03:04:05Z": "date", "2024-01-02 03:04": "date",
        "2024-02-30": "text", "2024-1-2": "text", "2024-01-02 foo": "text", "": None, None: None,
        " ﻿7　": "number", "12\n": "number",
    }
    df = spark.createDataFrame([(i, v) for i, v in enumerate(cases)], "i int, v string")
    staged = stage(df, ["v"])
    found = staged.df.orderBy("i").selectExpr(f"{staged.cells[0].vtype} AS t", f"{staged.cells[0].num} AS n").collect()
    assert [r["t"] for r in found] == list(cases.values())
    assert found[1]["n"] == 1500.0 and found[4]["n"] is None


def test_typed_columns(spark):
    schema = T.StructType([
        T.StructField("long", T.LongType()), T.StructField("double", T.DoubleType()),
        T.StructField("float", T.FloatType()), T.StructField("bool", T.BooleanType()),
        T.StructField("ts", T.TimestampNTZType()), T.StructField("day", T.DateType()),
        T.StructField("raw", T.BinaryType()), T.StructField("dec", T.DecimalType(10, 3)),
        T.StructField("list", T.ArrayType(T.LongType())),
        T.StructField("nested", T.StructType([T.StructField("a", T.DoubleType()), T.StructField("b", T.StringType())])),
        T.StructField("map", T.MapType(T.StringType(), T.IntegerType())),
    ])
    row = (
        9007199254740993, float("inf"), 0.1, True, dt.datetime(2024, 1, 2, 3, 4, 5, 678901), dt.date(2024, 1, 2),
        b"abc", decimal.Decimal("1.500"), [9007199254740993, None], (1.0, 'x"y'), {"k": 1},
    )
    staged = stage(spark.createDataFrame([row, (None,) * len(row)], schema))
    found = staged.df.selectExpr(*(f"struct({c.kind} AS k, {c.text} AS t, {c.vtype} AS v) AS c{c.index}" for c in staged.cells)).collect()
    assert [tuple(v) for v in found[0]] == [
        ("s", "9007199254740993", "number"), ("s", "Infinity", "text"), ("n", "0.10000000149011612", "number"),
        ("b", "true", "boolean"), ("s", "2024-01-02T03:04:05.678Z", "date"), ("s", "2024-01-02T00:00:00.000Z", "date"),
        ("s", "[binary: 3 bytes]", "text"), ("n", "1.5", "number"), ("s", '["9007199254740993",null]', "text"),
        ("s", '{"a":1,"b":"x\\"y"}', "text"), ("s", '{"k":1}', "text"),
    ]
    assert all(v["v"] is None for v in found[1])


def test_number_text(spark):
    cases = {
        1.0: "1", 12345678.9: "12345678.9", 0.1: "0.1", 100.0: "100", 0.000123: "0.000123", 1e21: "1e+21",
        1.5e-7: "1.5e-7", 0.0: "0", -0.0: "0", 1e-6: "0.000001", 123456789012345680.0: "123456789012345680",
        -2.5e10: "-25000000000", 1.2345e20: "123450000000000000000",
    }
    df = spark.createDataFrame([(i, v) for i, v in enumerate(cases)], "i int, d double").orderBy("i")
    expected = [cases[v] for v in cases]
    assert [r[0] for r in df.selectExpr(number_text("d")).collect()] == expected


def test_localized_numbers(spark):
    def value(text, decimal_, thousands):
        return texts(spark, [text], localized_number("v", decimal_, thousands))[0][0]

    assert value("1.234,50", "comma", "dot") == 1234.5
    assert value("12 345,5", "comma", "space") == 12345.5
    assert value("12.34,5", "comma", "dot") is None
    assert value("0012", "dot", "none") is None
    assert value(" -1,234.5e2 ", "dot", "comma") == -123450.0
    assert value("1e999", "comma", "none") is None


def test_units_and_cuts(spark):
    assert texts(spark, ["a😀", "abc", "é"], utf16_units("v")) == [(3,), (3,), (1,)]
    assert texts(spark, ["﻿\t x  "], trim_blanks("v")) == [("x",)]
    long = "x" * 30
    pair = "x" * 6 + "😀" * 12
    exact = "y" * 20
    cut = texts(spark, [long, pair, exact, "é" * 21], cut_text("v", 20), is_cut(cut_text("v", 20), 20))
    assert cut[0] == ("x" * 7 + CUT_MARKER, True)
    assert cut[1] == ("x" * 6 + "�" + CUT_MARKER, True)
    assert cut[2] == (exact, False)
    assert cut[3] == ("é" * 7 + CUT_MARKER, True)
    assert texts(spark, ["user text … [truncated]"], is_cut("v")) == [(False,)]
