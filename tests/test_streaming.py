import time

from pyspark.sql import functions as F

from colscope.plans.profile import profile
from colscope.plans.progress import count_rows
from colscope.streaming.profiles import (
    RowCounter, log_frequencies, logged_frequencies, on_warnings, rows_processed, stream_frequencies, stream_profile,
    top_of_frequencies,
)


def drop_files(spark, folder, parts):
    for i in range(parts):
        df = spark.range(i * 100, (i + 1) * 100).selectExpr(
            "id AS value", "IF(id < 150, 'early', 'late') AS grp", "IF(id % 4 = 0, NULL, 'x') AS gaps"
        )
        df.coalesce(1).write.parquet(f"{folder}/part-{i}")


def test_running_profile_equals_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    drop_files(spark, folder, 3)
    schema = "value bigint, grp string, gaps string"
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part-*")
    counter = RowCounter()
    spark.streams.addListener(counter)
    query = (
        stream_profile(source).writeStream.outputMode("complete").format("memory").queryName("running")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert rows_processed(query) == 300
    for _ in range(50):
        if counter.rows.get(str(query.id)) == 300:
            break
        time.sleep(0.1)
    spark.streams.removeListener(counter)
    assert counter.rows[str(query.id)] == 300
    found = {r["name"]: r for r in spark.table("running").collect()}
    for p in profile(spark.read.schema(schema).parquet(f"{folder}/part-*")).profiles.collect():
        row = found[p.name]
        assert (row.type, row.missing, row.non_null, row.min_number, row.mean) == (p.type, p.missing, p.non_null, p.min_number, p.mean)
        assert abs(row.distinct - p.distinct) <= 0.06 * p.distinct
    estimated = profile(spark.read.schema(schema).parquet(f"{folder}/part-*"), mode="approx").profiles.collect()
    assert found["value"].histogram == estimated[0].histogram


def test_running_histograms_and_dates(spark):
    """Few values fit the sketch, so both routes estimate alike; dates keep their spelling."""
    df = spark.range(-90, 211).selectExpr(
        "CAST(id AS DOUBLE) AS whole", "id / 7 AS parts", "3 AS same", "CAST(NULL AS INT) AS none",
        "IF(id = -90, '2024-01-01T10:00:00Z', IF(id = 210, ' 2024-03-01 ', '2024-02-01')) AS day",
    )
    found = {r["name"]: r for r in stream_profile(df).collect()}
    exact, estimated = ({r["name"]: r for r in profile(df, mode=m).profiles.collect()} for m in ("exact", "approx"))
    for name in ("whole", "parts", "same", "none"):
        assert found[name].histogram == estimated[name].histogram
        for ours, true in zip(found[name].histogram or [], exact[name].histogram or []):
            assert (ours.start, ours.end) == (true.start, true.end) and abs(ours["count"] - true["count"]) <= 3
        assert "histogram" in found[name].approximate_metrics or name in ("same", "none")
    assert [found["day"][k] == exact["day"][k] for k in ("min_text", "max_text")] == [True, True]
    assert found["day"].min_text == "2024-01-01T10:00:00Z"


def test_logged_frequencies_write_changes_only(spark, tmp_path):
    source, log, state = (str(tmp_path / name) for name in ("in", "log", "state"))
    for batch in ("id % 50", "IF(id < 97, 7, 60 + id % 3)"):
        spark.range(100).selectExpr(f"{batch} AS v").coalesce(1).write.mode("append").parquet(source)
        log_frequencies(spark.readStream.schema("v bigint").parquet(source), log, state).awaitTermination()
    written = {r["batch"]: r["count"] for r in spark.read.parquet(log).groupBy("batch").count().collect()}
    assert written == {0: 50, 1: 4}
    now = {int(r["num"]): r["cnt"] for r in logged_frequencies(spark, log).collect()}
    assert now == {v: 2 for v in range(50)} | {7: 99, 60: 1, 61: 1, 62: 1}
    before = logged_frequencies(spark, log, through=0).collect()
    assert len(before) == 50 and {r["cnt"] for r in before} == {2}


def test_running_frequencies_and_warnings(spark, tmp_path):
    folder = str(tmp_path / "in")
    drop_files(spark, folder, 2)
    source = spark.readStream.schema("value bigint, grp string, gaps string").parquet(f"{folder}/part-*")
    query = (
        stream_frequencies(source.select("grp")).writeStream.outputMode("complete").format("memory")
        .queryName("freq").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    top = top_of_frequencies(spark.table("freq")).orderBy("position").collect()
    assert [(r["value"], r["cnt"]) for r in top] == [("early", 150), ("late", 50)]
    seen = []
    on_warnings(
        stream_profile(source.select("gaps")), lambda w, batch: seen.append([r["code"] for r in w.collect()]),
        str(tmp_path / "state"),
    ).awaitTermination()
    assert seen[-1] == ["constant", "highMissing"]


def test_observed_rows(spark):
    df, observation = count_rows(spark.range(123), "seen")
    df.agg(F.sum("id")).collect()
    assert observation.get["rows"] == 123
