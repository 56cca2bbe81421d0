import time
import math
import random

import pytest
from pyspark.sql import functions as F

from colscope.operators.quality import quality_warnings
from colscope.plans import profile as plan
from colscope.functions.cells import long_form, stage
from colscope.plans.profile import frequency_table, profile


def one(result, index=0):
    return result.profiles.where(F.col("column_index") == index).first()


def test_distribution(spark):
    p = one(profile(spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "score int")))
    assert (p.type, p.mean, p.median, p.missing_ratio, p.unique_ratio) == ("number", 2.5, 2.5, 0.2, 1.0)
    assert p.std_dev == pytest.approx(math.sqrt(1.25))
    assert [tuple(b) for b in p.histogram] == [(1.0, 2.5, 2), (2.5, 4.0, 2)]


def test_constant_and_caps(spark):
    p = one(profile(spark.createDataFrame([(7,)] * 3, "c int")))
    assert [tuple(b) for b in p.histogram] == [(7.0, 7.0, 3)] and p.std_dev == 0
    df = spark.range(200).selectExpr("id", "concat('value-', id) AS text")
    found = profile(df).profiles.collect()
    assert len(found[0].histogram) == 12 and len(found[1].top_values) == 5


def test_tie_order(spark):
    p = one(profile(spark.createDataFrame([(v,) for v in "zamazbcd"], "v string")))
    assert [tuple(t) for t in p.top_values] == [("a", 2), ("z", 2), ("b", 1), ("c", 1), ("d", 1)]


def test_lengths_dates_and_mixed_number_text(spark):
    rows = [("longer", "2024-12-01", "1"), ("x", "2023-01-15", None), ("x", "2024-01-01", "2")]
    label, date, score = profile(spark.createDataFrame(rows, "l string, d string, s string")).profiles.collect()
    assert (label.min_length, label.max_length) == (1, 6) and tuple(label.top_values[0]) == ("x", 2)
    assert (date.type, date.min_text, date.max_text) == ("date", "2023-01-15", "2024-12-01")
    assert (score.type, score.missing, score.mean) == ("number", 1, 1.5)


@pytest.mark.parametrize("mode", ["approx", "auto"])
def test_estimates(spark, mode):
    df = spark.range(2000).selectExpr("id AS value", "IF(id < 1500, 'early', 'late') AS grp")
    numeric, group = profile(df, mode=mode).profiles.collect()
    assert (numeric.non_null, numeric.min_number, numeric.max_number, numeric.mean) == (2000, 0, 1999, 999.5)
    assert abs(numeric.distinct - 2000) < 300
    assert set(numeric.approximate_metrics) == {"distinct", "topValues", "median", "histogram"}
    assert sum(b["count"] for b in numeric.histogram) == 2000 and len(numeric.histogram) == 12
    assert abs(numeric.median - 999.5) < 60
    assert group.distinct == 2 and tuple(group.top_values[0]) == ("early", 1500)
    if mode == "auto":
        assert group.approximate_metrics is None


def test_quality_rules(spark):
    rows = [(f"id-{i}", "text" if i == 0 else str(i), None, None if i < 15 else "same") for i in range(50)]
    rows.append(rows[0])
    result = profile(spark.createDataFrame(rows, "id string, mixed string, empty string, missing string"))
    found = {(w["name"], w["code"]): w["message"] for w in result.warnings.collect()}
    assert found[("mixed", "mixedType")] == "mixed contains mixed value types across the full dataset."
    assert found[("empty", "allEmpty")] == "empty is entirely empty."
    assert found[("empty", "highMissing")] == "empty is 100% missing."
    assert found[("missing", "constant")] == "missing contains one non-null value."
    assert found[("missing", "highMissing")] == "missing is 31% missing."
    assert found[("id", "possibleIdentifier")] == "id may be an identifier (98% unique)."


def test_no_rows(spark):
    result = profile(spark.createDataFrame([], "a int, b string"))
    assert result.row_count == 0 and result.types == ("empty", "empty")
    assert [w["code"] for w in result.warnings.collect()] == ["allEmpty", "allEmpty"]
    p = one(result)
    assert (p.missing_ratio, p.unique_ratio, p.distinct, p.top_values) == (0.0, 0.0, 0, [])


def test_nan_makes_a_column_mixed(spark):
    p = one(profile(spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),)], "d double")))
    assert (p.type, p.distinct, p.mean) == ("mixed", 3, None)
    assert sorted(t["value"] for t in p.top_values) == ["1", "Infinity", "NaN"]


def test_long_texts_stay_distinct_beyond_the_shown_part(spark):
    base = "x" * 600
    p = one(profile(spark.createDataFrame([(base + "a",), (base + "b",), (base + "b",)], "t string")))
    assert p.distinct == 2 and p.max_length == 601
    assert [t["count"] for t in p.top_values] == [2, 1] and len(p.top_values[0]["value"]) == 512


@pytest.mark.parametrize("gather", [500_000, 20])
def test_exact_median_against_brute_force(spark, monkeypatch, gather):
    """Heavy tails and a value with a third of all rows; a small limit forces the narrowing."""
    monkeypatch.setattr(plan, "MEDIAN_GATHER_VALUES", gather)
    monkeypatch.setattr(plan, "MEDIAN_BUCKETS", 16 if gather < 100 else 4096)
    rng = random.Random(7)
    heavy = [rng.lognormvariate(0, 8) for _ in range(3000)] + [1e300, -1e300]
    hot = [5.0] * 1000 + [rng.random() * 10 for _ in range(2002)]
    even = [float(rng.randrange(10**6)) for _ in range(3002)]
    df = spark.createDataFrame(list(zip(heavy, hot, even)), "heavy double, hot double, even double")
    found = [p.median for p in profile(df, metrics={"median"}).profiles.collect()]
    for values, median in zip((heavy, hot, even), found):
        ordered = sorted(values)
        assert median == pytest.approx((ordered[1500] + ordered[1501]) / 2 if len(ordered) % 2 == 0 else ordered[1501])


def test_median_rounds_serve_all_columns(spark, monkeypatch):
    """The jobs of the narrowing do not grow with the columns."""
    monkeypatch.setattr(plan, "MEDIAN_GATHER_VALUES", 20)
    monkeypatch.setattr(plan, "MEDIAN_BUCKETS", 16)
    df = spark.range(4001).selectExpr(*(f"exp(rand({i}) * 40) AS c{i}" for i in range(8)))
    df = df.checkpoint() if spark.sparkContext.getCheckpointDir() else df.cache()
    df.count()

    def jobs(columns):
        group = f"median-{len(columns)}"
        spark.sparkContext.setJobGroup(group, group)
        medians = [p.median for p in profile(df.select(columns), metrics={"median"}).profiles.collect()]
        spark.sparkContext.setJobGroup("", "")
        assert medians == [sorted(r[0] for r in df.select(c).collect())[2000] for c in columns]
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    few, many = jobs(df.columns[:2]), jobs(df.columns)
    assert many <= few + 8, (few, many)


def test_middle_ranks_on_values_of_many_spellings(spark, monkeypatch):
    """Two numbers in the middle, each with more spellings than a bracket may hold."""
    monkeypatch.setattr(plan, "MEDIAN_GATHER_VALUES", 5)
    monkeypatch.setattr(plan, "MEDIAN_BUCKETS", 2)
    rows = [(f"{n}.{'0' * k}",) for n in (1, 2) for k in range(1, 41)]
    p = one(profile(spark.createDataFrame(rows, "t string"), metrics={"median"}))
    assert p.median == 1.5


def test_random_data_properties(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, rng.gauss(0, 1), float(rng.randrange(5))]), rng.choice([None, "", "a", "7"])) for _ in range(999)]
    result = profile(spark.createDataFrame(rows, "n double, t string"))
    for p in result.profiles.collect():
        assert p.missing + p.non_null == result.row_count == 999
    p = one(result)
    assert sum(b["count"] for b in p.histogram) == p.non_null
    assert p.distinct == len({r[0] for r in rows if r[0] is not None})


def test_skewed_key_keeps_exact_counts(spark):
    df = spark.range(30_000).selectExpr("IF(id % 3 = 0, 'hot', concat('cold-', id)) AS k")
    p = one(profile(df))
    assert p.distinct == 20_001 and tuple(p.top_values[0]) == ("hot", 10_000)


def test_warnings_need_only_profile_columns(spark):
    row = [(0, "a", "text", 30, 1, 0.5, 1 / 30)]
    df = spark.createDataFrame(row, "column_index int, name string, type string, non_null bigint, distinct bigint, missing_ratio double, unique_ratio double")
    assert [w["code"] for w in quality_warnings(df).collect()] == ["constant", "highMissing"]


def test_dates_do_not_depend_on_the_session_zone(spark):
    rows = spark.sql(
        "SELECT DATE'2024-01-01' AS day, TIMESTAMP_NTZ'2024-06-01 10:00:00' AS ntz, "
        "timestamp_seconds(1704067200) AS at, '2024-01-01' AS text_day, '2024-01-01T00:00:00Z' AS text_at"
    )
    found = {}
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            profiles = profile(rows, metrics={"top_values"}).profiles
            found[zone] = [(r["name"], r["min_text"], r["top_values"][0]["value"]) for r in profiles.collect()]
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert found["UTC"] == found["America/New_York"]
    assert [x[1] for x in found["UTC"]][:3] == ["2024-01-01T00:00:00.000Z", "2024-06-01T10:00:00.000Z", "2024-01-01T00:00:00.000Z"]


def test_long_texts_are_told_apart_by_sketches(spark):
    df = spark.range(700).selectExpr("concat(repeat('x', 600), id % 7) AS v")
    top = profile(df, mode="approx", metrics={"top_values"}).profiles.first()["top_values"]
    assert [x["count"] for x in top] == [100] * 5


def test_one_scan_for_all_columns(spark, sf):
    lineitem = spark.read.parquet(f"{sf}/lineitem.parquet")
    staged = stage(lineitem)
    plan = frequency_table(staged, staged.cells)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert len(long_form(staged, staged.cells)) == 1


def test_many_text_columns_together(spark):
    wide = spark.range(100).selectExpr(*[f"concat('t', id % {k + 1}) AS c{k}" for k in range(24)])
    profile(wide.limit(1))
    started = time.time()
    rows = profile(wide).profiles.collect()
    assert time.time() - started < 5
    assert [r["distinct"] for r in rows] == list(range(1, 25))


def test_more_columns_than_one_scan_takes(spark, monkeypatch):
    monkeypatch.setattr("colscope.functions.cells.LONG_COLUMNS", 3)
    df = spark.createDataFrame(
        [(1, "a", 1.5, True, None, "2024-01-01", "7")] * 3 + [(2, None, None, None, None, "x", "9")],
        "i long, s string, d double, b boolean, n string, t string, u string",
    )
    rows = [(r["type"], r["non_null"], r["distinct"], r["mean"]) for r in profile(df).profiles.collect()]
    assert rows == [
        ("number", 4, 2, 1.25), ("text", 3, 1, None), ("number", 3, 1, 1.5), ("boolean", 3, 1, None), ("empty", 0, 0, None),
        ("mixed", 4, 2, None), ("number", 4, 2, 7.5),
    ]


def test_columns_to_estimate_are_chosen(spark):
    df = spark.range(3000).selectExpr("id", "id % 7 AS few", "concat('t', id) AS text", "id * 0.5D AS half")
    found = {r["name"]: r for r in profile(df, estimate=("id", "text")).profiles.collect()}
    assert found["few"]["approximate_metrics"] is None and found["half"]["approximate_metrics"] is None and found["half"]["distinct"] == 3000
    assert "distinct" in found["id"]["approximate_metrics"] and "topValues" in found["text"]["approximate_metrics"]
    assert abs(found["text"]["distinct"] - 3000) < 300
    small = {r["name"]: r["approximate_metrics"] for r in profile(df.limit(10), estimate=("id", "text")).profiles.collect()}
    assert small == {name: r["approximate_metrics"] for name, r in found.items()}
    with pytest.raises(ValueError, match="exact profile"):
        profile(df, mode="approx", estimate=("id",))
