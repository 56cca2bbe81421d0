"""Profiles of arriving data with Structured Streaming.

The per-column aggregates are mergeable, so Spark keeps one state row per column. Frequencies come
in two forms: exact counts, whose state grows with the distinct values, and a bounded sketch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from colscope.functions.cells import StagedCells, key_value_text, stage
from colscope.functions.text import literal
from colscope.operators.quality import quality_warnings
from colscope.plans.aggregates import DISTINCT_ERROR, SKETCH_K, TOP_VALUES, tracked_text, tracked_value
from colscope.plans.profile import QUANTILE_STEPS, top_values


def _long_cells(staged: StagedCells) -> DataFrame:
    """One row per cell: ``column_index`` and the fields of the cell, null when missing."""
    packed = []
    for cell in staged.cells:
        code, text, digest, num = cell.key
        packed.append(
            f"struct({cell.vtype} AS vtype, {cell.num} AS num, {cell.instant} AS instant, "
            f"{cell.units} AS units, {code} AS code, {text} AS shown, {digest} AS digest, "
            f"{num} AS key_num, IF({cell.vtype} = 'date', struct({cell.instant} AS at, {cell.text} AS text), NULL) "
            f"AS dated) AS `{cell.index}`"
        )
    long = staged.df.selectExpr(*packed).unpivot(
        [], [str(c.index) for c in staged.cells], "column_index", "cell"
    )
    return long.selectExpr("CAST(column_index AS INT) AS column_index", "cell.*")


def _names(columns: list[str]) -> str:
    return f"element_at(array({', '.join(map(literal, columns))}), column_index + 1)"


def _histogram(grid: str, low: str, high: str, count: str) -> str:
    """Equal bins ``array<struct<start, end, count>>``; the share of even quantiles below an inner edge
    gives the rows below it, and the last bin takes the rest."""
    bins = f"CAST(least(12, greatest(2, ceil(sqrt({count})))) AS INT)"

    def edge(step: str) -> str:
        return f"({low} + ({high} - {low}) / {bins} * {step})"

    below = f"CAST(floor(size(filter({grid}, g -> g < {edge('i')})) / CAST(size({grid}) AS DOUBLE) * {count}) AS BIGINT)"
    passed = f"transform(sequence(0, {bins}), i -> CASE WHEN i = 0 THEN 0L WHEN i = {bins} THEN {count} ELSE {below} END)"
    rows = f"greatest(0L, element_at({passed}, j + 2) - element_at({passed}, j + 1))"
    return (
        f"IF({low} = {high}, array(struct({low} AS start, {high} AS end, {count} AS count)), "
        f"transform(sequence(0, {bins} - 1), j -> struct({edge('j')} AS start, "
        f"IF(j = {bins} - 1, {high}, {edge('(j + 1)')}) AS end, {rows} AS count)))"
    )


def stream_profile(df: DataFrame) -> DataFrame:
    """Running profile of a stream, one row per column.

    Use output mode ``complete`` or ``update``. Works on batch DataFrames too. Counts, ranges, moments
    and lengths equal those of ``profile``; the metrics named in ``approximate_metrics`` are estimates,
    the histogram by an even grid of quantiles from the sketch.
    """
    cells = _long_cells(stage(df))
    shown = tracked_text(key_value_text("code", "shown", "key_num"), "digest")
    grouped = cells.groupBy("column_index").agg(
        F.expr("count(1)").alias("row_count"),
        F.expr("count(vtype)").alias("non_null"),
        *(
            F.expr(f"count_if(vtype = '{kind}')").alias(f"n_{kind}")
            for kind in ("number", "boolean", "date", "text")
        ),
        F.expr("min(num)").alias("low"),
        F.expr("max(num)").alias("high"),
        F.expr("avg(num)").alias("average"),
        F.expr("stddev_pop(num)").alias("deviation"),
        F.expr(f"kll_sketch_agg_double(num, {SKETCH_K})").alias("sketch"),
        F.expr("count(num)").alias("num_count"),
        F.expr("min(dated).text").alias("first_date"),
        F.expr("max(dated).text").alias("last_date"),
        F.expr("min(units)").alias("shortest"),
        F.expr("max(units)").alias("longest"),
        F.expr(
            f"approx_count_distinct(IF(vtype IS NULL, NULL, struct(code, coalesce(digest, shown), key_num)), {DISTINCT_ERROR}D)"
        ).alias("estimate"),
        F.expr(f"approx_top_k(IF(vtype IS NULL, NULL, {shown}), {TOP_VALUES})").alias("top"),
    )
    seen = "(IF(n_number > 0, 1, 0) + IF(n_boolean > 0, 1, 0) + IF(n_date > 0, 1, 0) + IF(n_text > 0, 1, 0))"
    kind = (
        f"CASE WHEN non_null = 0 THEN 'empty' WHEN {seen} > 1 THEN 'mixed' WHEN n_number > 0 THEN 'number' "
        "WHEN n_boolean > 0 THEN 'boolean' WHEN n_date > 0 THEN 'date' ELSE 'text' END"
    )
    shares = ", ".join(f"{step / QUANTILE_STEPS}D" for step in range(QUANTILE_STEPS + 1))
    typed = grouped.selectExpr(
        "*", f"{kind} AS type", "least(non_null, estimate) AS distinct",
        f"IF(num_count > 0, kll_sketch_get_quantile_double(sketch, array({shares})), NULL) AS grid",
    )

    def only(wanted: str, value: str) -> str:
        return f"IF(type = '{wanted}', {value}, NULL)"

    return typed.selectExpr(
        "column_index", f"{_names(df.columns)} AS name", "type", "row_count",
        "row_count - non_null AS missing", "non_null", "distinct",
        "IF(row_count = 0, 0D, (row_count - non_null) / row_count) AS missing_ratio",
        "IF(non_null = 0, 0D, distinct / non_null) AS unique_ratio",
        f"{only('number', 'low')} AS min_number", f"{only('number', 'high')} AS max_number",
        f"{only('number', 'average')} AS mean",
        f"{only('number', 'IF(num_count > 0, kll_sketch_get_quantile_double(sketch, 0.5D), NULL)')} AS median",
        f"{only('number', 'deviation')} AS std_dev",
        f"{only('date', 'first_date')} AS min_text", f"{only('date', 'last_date')} AS max_text",
        f"CAST({only('text', 'shortest')} AS BIGINT) AS min_length",
        f"CAST({only('text', 'longest')} AS BIGINT) AS max_length",
        f"{only('number', _histogram('grid', 'low', 'high', 'num_count'))} AS histogram",
        "transform(top, e -> struct(" + tracked_value("e.item") + " AS value, CAST(e.count AS BIGINT) AS count)) AS top_values",
        "filter(array(IF(non_null > 0, 'distinct', NULL), IF(non_null > 0, 'topValues', NULL), "
        "IF(type = 'number', 'median', NULL), IF(type = 'number' AND low < high, 'histogram', NULL)), m -> m IS NOT NULL) AS approximate_metrics",
    )


def stream_frequencies(df: DataFrame) -> DataFrame:
    """Running exact counts ``(column_index, code, text, digest, num, cnt)``.

    The state holds every distinct value, spread over the shuffle partitions. For unbounded
    streams of unbounded values use ``stream_top_values``.
    """
    cells = _long_cells(stage(df)).where("vtype IS NOT NULL")
    return (
        cells.selectExpr("column_index", "code", "shown AS text", "digest", "key_num AS num")
        .groupBy("column_index", "code", "text", "digest", "num")
        .agg(F.expr("count(1)").alias("cnt"))
    )


def log_frequencies(df: DataFrame, folder: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Keep exact running counts of a stream as a log of changes, one folder ``batch=N`` a batch.

    Each batch writes only the values it has changed, with their counts so far; a batch that is
    repeated after a failure replaces its own folder. ``logged_frequencies`` reads the counts.
    """

    def each(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    writer = stream_frequencies(df).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).foreachBatch(each).start()


def logged_frequencies(spark: SparkSession, folder: str, through: int | None = None) -> DataFrame:
    """Counts of a log of ``log_frequencies``, as they were after batch ``through`` (now, by default).

    Counts only grow, so the largest one logged for a value is its last.
    """
    log = spark.read.parquet(folder)
    if through is not None:
        log = log.where(F.col("batch") <= through)
    return log.groupBy("column_index", "code", "text", "digest", "num").agg(F.max("cnt").alias("cnt"))


def stream_top_values(df: DataFrame, count: int = TOP_VALUES) -> DataFrame:
    """Running approximate top values ``(column_index, name, position, value, count)``; the state
    is one sketch per column."""
    cells = _long_cells(stage(df)).where("vtype IS NOT NULL")
    shown = tracked_text(key_value_text("code", "shown", "key_num"), "digest")
    top = cells.groupBy("column_index").agg(F.expr(f"approx_top_k({shown}, {count})").alias("top"))
    return top.selectExpr(
        "column_index", f"{_names(df.columns)} AS name", "posexplode(top) AS (position, entry)"
    ).selectExpr(
        "column_index", "name", "position + 1 AS position", f"{tracked_value('entry.item')} AS value",
        "CAST(entry.count AS BIGINT) AS count",
    )


def top_of_frequencies(frequencies: DataFrame) -> DataFrame:
    """Exact top values of a finished snapshot of ``stream_frequencies``."""
    return top_values(frequencies)


def on_warnings(
    profile: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, **trigger: object
) -> StreamingQuery:
    """Hand the quality warnings of the running profile to ``handle`` after each batch.

    ``profile`` is a streaming ``stream_profile``; its snapshots have one row per column.
    """

    def each(snapshot: DataFrame, batch: int) -> None:
        handle(quality_warnings(snapshot), batch)

    writer = profile.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).foreachBatch(each).start()


class RowCounter(StreamingQueryListener):
    """Rows read by each query over its whole life; register with ``spark.streams.addListener``."""

    def __init__(self):
        self.rows: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.rows.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        identity = str(event.progress.id)
        self.rows[identity] = self.rows.get(identity, 0) + event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def rows_processed(query: StreamingQuery) -> int:
    """Rows a streaming query has read, over the progress reports it keeps (100 by default)."""
    return sum(progress["numInputRows"] for progress in query.recentProgress)
