"""Times mean the same in any session zone, also around the hours that clocks skip."""

import pytest

from colscope.operators.display import render_columns
from colscope.operators.view import Filter, Sort, ViewSpec, apply_view
from colscope.plans.profile import profile
from colscope.sources.table import Table

ROWS = (
    "(TIMESTAMP'2024-03-11 02:30:00Z', DATE'2024-03-10', TIMESTAMP_NTZ'2024-03-10 02:30:00.123456', '2024-03-10', '2024-03-10T02:30:00Z', '\ttrue'), "
    "(TIMESTAMP'2024-03-10 07:00:00.5Z', DATE'1969-12-31', TIMESTAMP_NTZ'1969-12-31 23:59:59.999', '2024-11-03', '2024-11-03T01:30:00.250Z', 'FALSE'), "
    "(TIMESTAMP'2024-11-03 05:30:00Z', NULL, NULL, NULL, NULL, NULL)"
)


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kathmandu", "America/Sao_Paulo"])
def test_results_do_not_depend_on_the_zone(spark, zone):
    found = {}
    for name in ("UTC", zone):
        spark.conf.set("spark.sql.session.timeZone", name)
        try:
            df = spark.sql(f"SELECT * FROM VALUES {ROWS} AS t(instant, day, wall, day_text, time_text, flag)")
            result = profile(df)
            types = [r["type"] for r in result.profiles.orderBy("column_index").collect()]
            table = Table.from_dataframe(df)
            shown = sorted(map(tuple, render_columns(table, types).collect()), key=str)
            views = [
                ViewSpec(filters=(Filter(0, "greaterThan", "2024-03-10T08:00:00Z"),)),
                ViewSpec(filters=(Filter(2, "between", "2024-03-10T02:00:00Z", "2024-03-10T03:00:00Z"),)),
                ViewSpec(filters=(Filter(1, "equals", "2024-03-10"),)),
                ViewSpec("02:30:00"), ViewSpec(sort=Sort(2, "desc")),
            ]
            kept = [apply_view(table, view, types).named().selectExpr("day_text").collect() for view in views]
            found[name] = types, shown, kept, [tuple(r) for r in result.profiles.orderBy("column_index").collect()]
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert found["UTC"] == found[zone]
    types, shown, kept, _ = found[zone]
    assert types == ["date", "date", "date", "date", "date", "boolean"]
    first = next(row for row in shown if row[5] == "True")
    assert first[:5] == (
        "Mar 11, 2024, 02:30:00 UTC", "Mar 10, 2024, 00:00:00 UTC", "Mar 10, 2024, 02:30:00 UTC", "Mar 10, 2024",
        "Mar 10, 2024, 02:30:00 UTC",
    )
    assert len(kept[0]) == 2 and len(kept[1]) == 1 and len(kept[2]) == 1
