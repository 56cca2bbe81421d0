"""Column profiles of whole tables.

Three modes share one result:

* ``exact``   one wide aggregate for counts, moments and ranges, then one frequency plan over the
  distinct values of each column for distinct counts, top values, histograms and the median.
* ``approx``  one wide aggregate with mergeable sketches; a single scan, nothing is shuffled but
  one small row per task.
* ``auto``    the wide aggregate also estimates distinct counts; columns with few distinct values
  take the frequency plan, which is small for them, and all others take the sketches.

Only per-column results reach the driver: at most a few dozen rows per profiled column.
"""

from __future__ import annotations

import bisect
import functools
import math
from collections.abc import Callable, Collection, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.functions.cells import (
    NO_NUMBER,
    Cell,
    StagedCells,
    iso_text,
    key_value_text,
    long_form,
    stage,
)
from colscope.functions.text import quoted
from colscope.operators.quality import quality_warnings
from colscope.plans.aggregates import (
    TOP_VALUES,
    VALUE_TYPES,
    basic_aggregates,
    date_texts,
    distinct_estimate,
    possible_types,
    quantile_sketch,
    top_values_sketch,
)

# When frequencies are still counted exactly in ``auto`` mode.
EXACT_VALUES_PER_COLUMN = 512
EXACT_VALUES_IN_TOTAL = 32_768
MIN_EXACT_VALUES = 32

GROUP_WEIGHT = 3
CONCURRENT_JOBS = 4
MEDIAN_BUCKETS = 4096
MEDIAN_GATHER_VALUES = 500_000
RANK_ACCURACY = 10_000
MEDIAN_CUTS = 128  # a power of two
QUANTILE_STEPS = 400

METRICS = frozenset({"distinct", "top_values", "median", "histogram"})

PROFILE_SCHEMA = T.StructType(
    [
        T.StructField("column_index", T.IntegerType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("type", T.StringType(), False),
        T.StructField("missing", T.LongType(), False),
        T.StructField("non_null", T.LongType(), False),
        T.StructField("distinct", T.LongType()),
        T.StructField("missing_ratio", T.DoubleType(), False),
        T.StructField("unique_ratio", T.DoubleType()),
        T.StructField("min_number", T.DoubleType()),
        T.StructField("max_number", T.DoubleType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("median", T.DoubleType()),
        T.StructField("std_dev", T.DoubleType()),
        T.StructField("min_text", T.StringType()),
        T.StructField("max_text", T.StringType()),
        T.StructField("min_length", T.LongType()),
        T.StructField("max_length", T.LongType()),
        T.StructField(
            "histogram",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("start", T.DoubleType()),
                        T.StructField("end", T.DoubleType()),
                        T.StructField("count", T.LongType()),
                    ]
                )
            ),
        ),
        T.StructField(
            "top_values",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("value", T.StringType()),
                        T.StructField("count", T.LongType()),
                    ]
                )
            ),
        ),
        T.StructField("approximate_metrics", T.ArrayType(T.StringType())),
    ]
)


@dataclass(frozen=True)
class ProfileResult:
    profiles: DataFrame
    row_count: int
    warnings: DataFrame
    types: tuple[str, ...]
    """Column types by position, as the view operators take them."""
    scope: str = "full"
    mode: str = "exact"


@dataclass
class _ColumnState:
    """What is known about one column while a profile is being built."""

    cell: Cell
    name: str
    stats: dict[str, Any] = field(default_factory=dict)
    type: str = "empty"
    distinct: int | None = None
    top_values: list[tuple[str, int]] | None = None
    median: float | None = None
    histogram: list[tuple[float, float, int]] | None = None
    estimated: list[str] = field(default_factory=list)

    @property
    def numeric(self) -> bool:
        return self.type == "number" and (self.stats.get("num_count") or 0) > 0

    def settle_type(self) -> None:
        non_null = self.stats["non_null"]
        if non_null == 0:
            self.type = "empty"
            return
        types = possible_types(self.cell)
        seen = (
            list(types)
            if len(types) == 1
            else [name for name in types if self.stats[f"n_{name}"] > 0]
        )
        self.type = seen[0] if len(seen) == 1 else "mixed"


def exact_value_limit(column_count: int) -> int:
    """Distinct values per column up to which ``auto`` counts exactly."""
    share = EXACT_VALUES_IN_TOTAL // max(1, column_count)
    return max(MIN_EXACT_VALUES, min(EXACT_VALUES_PER_COLUMN, share))


def profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    names: Sequence[str] | None = None,
    mode: str = "exact",
    scope: str = "full",
    metrics: Collection[str] = METRICS,
    cell_units: int | None = None,
    estimate: Collection[str] = (),
) -> ProfileResult:
    """Profile the given columns of ``df`` (all by default) over every row and every whole text.

    ``names`` are the shown names when they differ from the DataFrame's. ``metrics`` limits the
    work beyond the basic statistics. ``cell_units`` shortens long texts, for previews only.

    ``exact`` counts every distinct value, but for the columns that ``estimate`` names (as shown): their counts come from
    sketches and are flagged. The choice is the caller's, so flags do not depend on the size of the data. ``approx``
    estimates all columns, ``auto`` those that seem to hold more distinct values than ``exact_value_limit``.
    """
    metrics = frozenset(metrics)
    if estimate and mode != "exact":
        raise ValueError("estimate names columns of an exact profile")
    if mode not in ("exact", "approx", "auto"):
        raise ValueError(f"Unknown profile mode: {mode}")
    if not metrics <= METRICS:
        raise ValueError(f"Unknown metrics: {sorted(metrics - METRICS)}")
    spark = df.sparkSession
    columns = list(df.columns if columns is None else columns)
    shown = list(names if names is not None else columns)
    staged = stage(_spread(df, columns), columns, cell_units)
    states = [_ColumnState(cell, name) for cell, name in zip(staged.cells, shown, strict=True)]

    row_count = _basic_pass(staged, states, mode, metrics)
    for state in states:
        state.settle_type()
    _date_text_pass(staged, [s for s in states if s.type == "date"])
    by_frequency, by_sketch = states, []
    if mode == "approx":
        by_frequency, by_sketch = [], states
    elif mode == "auto":
        limit = exact_value_limit(len(states))
        by_sketch = [s for s in states if (s.stats["distinct_estimate"] or 0) > limit]
        by_frequency = [s for s in states if s not in by_sketch]
    elif estimate:
        by_sketch = [s for s in states if s.name in set(estimate)]
        by_frequency = [s for s in states if s.name not in set(estimate)]
    empty = [s for s in by_frequency if s.type == "empty"]
    for state in empty:
        state.distinct, state.top_values = 0, []
    counted = [s for s in by_frequency if s.type != "empty"]
    passes = [lambda: _frequency_pass(spark, staged, counted, metrics)]
    if mode != "approx" and by_sketch:
        passes.append(lambda: _sketch_pass(staged, by_sketch, metrics))
    _run_together(spark, [lambda _, run=run: run() for run in passes])
    _finish_sketches(by_sketch, metrics)

    rows = [_profile_row(state, row_count) for state in states]
    profiles = spark.createDataFrame(rows, PROFILE_SCHEMA)
    return ProfileResult(
        profiles=profiles,
        row_count=row_count,
        warnings=quality_warnings(profiles),
        types=tuple(state.type for state in states),
        scope=scope,
        mode=mode,
    )


#: Bytes for each core below which rows are dealt out anew, as few row groups would leave cores idle.
SMALL_SHARE = 32 << 20


def _spread(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns of a small table, its rows dealt to all cores. Larger tables have splits enough and are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # an estimate; nothing is run
    return df.select(*map(quoted, columns)).repartition(cores) if columns and size < cores * SMALL_SHARE else df


# -- one wide aggregate -------------------------------------------------------------------------


def _run_together(spark: SparkSession, jobs: Sequence[Callable[[None], Any]]) -> list:
    """Run independent Spark jobs from a few threads and return their results in order."""
    with ThreadPoolExecutor(min(CONCURRENT_JOBS, len(jobs))) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(job), None) for job in jobs]
        return [job.result() for job in started]


def _groups(items: Sequence[Any], cell_of: Callable[[Any], Cell] = lambda s: s.cell) -> list[list]:
    """Split columns into groups whose generated code stays small enough for the JIT compiler.

    Columnar sources read each column once, whatever the grouping.
    """
    groups: list[list] = [[]]
    weight = 0
    for item in items:
        cost = 3 if cell_of(item).decided_by_value else 1
        if weight + cost > GROUP_WEIGHT and groups[-1]:
            groups.append([])
            weight = 0
        groups[-1].append(item)
        weight += cost
    return groups


def _sketch_aggregates(state: _ColumnState, metrics: Collection[str]) -> dict[str, str]:
    found = {}
    if "top_values" in metrics:
        found["top_sketch"] = top_values_sketch(state.cell)
    if "number" in possible_types(state.cell) and metrics & {"median", "histogram"}:
        found["quantiles"] = quantile_sketch(state.cell)
        found["sketch_count"] = f"count({state.cell.num})"
    return found


def _read_back(key: str, position: int) -> list[str]:
    """What of an aggregate reaches the driver: quantile sketches as their median and an even
    grid of quantiles, instants as text, everything else as it is."""
    name = f"{key}_{position}"
    if key == "quantiles":
        shares = ", ".join(f"{step / QUANTILE_STEPS}D" for step in range(QUANTILE_STEPS + 1))
        filled = f"sketch_count_{position} > 0"
        return [
            f"IF({filled}, kll_sketch_get_quantile_double({name}, {share}), NULL) AS {target}_{position}"
            for share, target in (("0.5D", "sketch_median"), (f"array({shares})", "sketch_grid"))
        ]
    if key in ("min_instant", "max_instant"):
        return [f"{iso_text(name)} AS {key[:3]}_iso_{position}"]
    return [name]


def _aggregate(
    staged: StagedCells,
    states: Sequence[_ColumnState],
    aggregates: Callable[[_ColumnState], dict[str, str]],
) -> int:
    """Compute one row of aggregates per group of columns and file the values with their columns.

    The groups are independent jobs; running a few at once keeps the cluster busy to the end.
    """

    def run(group: Sequence[_ColumnState]) -> int:
        flat, read = ["count(1) AS rows"], ["rows"]
        for position, state in enumerate(group):
            for key, expression in aggregates(state).items():
                flat.append(f"{expression} AS {key}_{position}")
                read += _read_back(key, position)
        row = staged.df.selectExpr(*flat).selectExpr(*read).collect()[0].asDict()
        row_count = row.pop("rows")
        for name, value in row.items():
            key, _, position = name.rpartition("_")
            group[int(position)].stats[key] = value
        return row_count

    groups = _groups(states)
    return _run_together(
        staged.df.sparkSession, [lambda _, group=group: run(group) for group in groups]
    )[0]


def _basic_pass(
    staged: StagedCells, states: Sequence[_ColumnState], mode: str, metrics: Collection[str]
) -> int:
    def aggregates(state: _ColumnState) -> dict[str, str]:
        found = basic_aggregates(state.cell)
        if mode == "auto" or (mode == "approx" and "distinct" in metrics):
            found["distinct_estimate"] = distinct_estimate(state.cell)
        if mode == "approx":
            found |= _sketch_aggregates(state, metrics)
        return found

    if not states:
        return staged.df.count()
    if mode == "exact":
        return _basic_by_column(staged, states)
    return _aggregate(staged, states, aggregates)


#: The basic statistics of a column, over its cells as rows.
BASIC = {
    "non_null": "count(vtype)",
    **{f"n_{value_type}": f"count_if(vtype = '{value_type}')" for value_type in VALUE_TYPES},
    "num_count": "count(num)", "min_number": "min(num)", "max_number": "max(num)", "mean": "avg(num)",
    "std_dev": "stddev_pop(num)", "min_instant": "min(instant)", "max_instant": "max(instant)",
    "min_length": "min(units)", "max_length": "max(units)",
}


def _basic_by_column(staged: StagedCells, states: Sequence[_ColumnState]) -> int:
    """Basic statistics of all columns in one scan and one aggregate by column; a row for each task and column is shuffled."""
    for state in states:
        state.stats = {key: 0 if expression.startswith("count") else None for key, expression in BASIC.items()}
        state.stats |= {"min_iso": None, "max_iso": None}
    known = {state.cell.index: state for state in states}
    row_count = None
    for part, _ in long_form(staged, [state.cell for state in states]):
        values = [
            f"coalesce({', '.join(getattr(cell, what) for cell in part.cells)}) AS {what}"
            for what in ("vtype", "num", "instant", "units")
        ]
        found = part.df.selectExpr("column_index", *values).groupBy("column_index").agg(
            F.expr("count(1)").alias("rows"), *(F.expr(expression).alias(key) for key, expression in BASIC.items())
        )
        instants = [f"{iso_text(f'{end}_instant')} AS {end}_iso" for end in ("min", "max")]
        shown = [key for key in BASIC if not key.endswith("instant")]
        for row in found.selectExpr("column_index", "rows", *shown, *instants).collect():  # one for each column
            stats = row.asDict()
            row_count = stats.pop("rows")
            known[stats.pop("column_index")].stats |= stats
    return row_count or 0


def _date_text_pass(staged: StagedCells, dated: Sequence[_ColumnState]) -> None:
    """Ranges of date columns as text. Typed columns are formatted; text columns are looked up."""
    as_text = []
    for state in dated:
        if state.cell.only_type == "date":
            for end in ("min", "max"):
                state.stats[f"{end}_text"] = state.stats.get(f"{end}_iso")
        else:
            as_text.append(state)
    if as_text:
        _aggregate(staged, as_text, lambda state: date_texts(state.cell))


def _sketch_pass(
    staged: StagedCells, states: Sequence[_ColumnState], metrics: Collection[str]
) -> None:
    def aggregates(state: _ColumnState) -> dict[str, str]:
        found = _sketch_aggregates(state, metrics)
        if "distinct" in metrics and "distinct_estimate" not in state.stats:
            found["distinct_estimate"] = distinct_estimate(state.cell)
        return found

    _aggregate(staged, states, aggregates)


def _finish_sketches(states: Sequence[_ColumnState], metrics: Collection[str]) -> None:
    for state in states:
        non_null = state.stats["non_null"]
        if "distinct" in metrics:
            state.distinct = min(non_null, state.stats["distinct_estimate"] or 0)
            if non_null:
                state.estimated.append("distinct")
        if "top_values" in metrics:
            found = state.stats["top_sketch"] or []
            state.top_values = [(entry["value"], entry["count"]) for entry in found]
            if non_null:
                state.estimated.append("topValues")
        if not state.numeric:
            continue
        low, high = state.stats["min_number"], state.stats["max_number"]
        count = state.stats["num_count"]
        if "median" in metrics:
            state.median = low if low == high else state.stats["sketch_median"]
            if low != high:
                state.estimated.append("median")
        if "histogram" in metrics:
            if low == high:
                state.histogram = [(low, high, count)]
                continue
            state.histogram = _ranked_histogram(low, high, count, state.stats["sketch_grid"])
            state.estimated.append("histogram")


def _ranked_histogram(
    low: float, high: float, count: int, grid: Sequence[float]
) -> list[tuple[float, float, int]]:
    """Bins from the share of even quantiles below each inner edge; the last bin takes the rest."""
    bins = min(12, max(1, math.ceil(math.sqrt(count))))
    width = (high - low) / bins
    edges = [low + width * i for i in range(bins)] + [high]
    below = [bisect.bisect_left(grid, edge) / len(grid) for edge in edges[1:-1]]
    cumulative = [0] + [math.floor(share * count) for share in below] + [count]
    return [
        (edges[i], edges[i + 1], max(0, cumulative[i + 1] - cumulative[i])) for i in range(bins)
    ]


# -- the frequency plan -------------------------------------------------------------------------


def frequency_table(
    staged: StagedCells, cells: Sequence[Cell], with_numbers: Collection[int] | None = None
) -> DataFrame:
    """One row per distinct value: ``(column_index, code, text, digest, num, cnt)``.

    Long texts travel as a short form plus digest, so shuffle keys stay small whatever the data
    holds, and a frequent value is folded before the shuffle by partial aggregation. Text columns
    outside ``with_numbers`` (column positions, all by default) skip the parsing of numbers.
    """
    skipped = [
        cell.decided_by_value and with_numbers is not None and cell.index not in with_numbers for cell in cells
    ]
    parts = []
    for part, skips in long_form(staged, cells, skipped):
        keys = [
            f"WHEN {c.present} THEN struct({c.key[0]} AS code, {c.key[1]} AS text, {c.key[2]} AS digest, "
            f"{NO_NUMBER if skip else c.key[3]} AS num)"
            for c, skip in zip(part.cells, skips, strict=True)
        ]
        parts.append(
            part.df.selectExpr("column_index", f"CASE {' '.join(keys)} END AS key")
            .where("key IS NOT NULL")
            .selectExpr("column_index", "key.*")
        )
    return (
        functools.reduce(DataFrame.union, parts)
        .groupBy("column_index", "code", "text", "digest", "num")
        .agg(F.expr("count(1)").alias("cnt"))
    )


def top_values(frequencies: DataFrame, count: int = TOP_VALUES) -> DataFrame:
    """The most frequent values per column; ties in collation order of their text.

    The rank limit is also applied before the shuffle, per task, so a column with a vast number
    of distinct values sends only ``count`` rows per task to its group.
    """
    order = (
        "cnt DESC, IF(code = 'n', NULL, value COLLATE UNICODE) NULLS FIRST, value, code, "
        "digest NULLS FIRST"
    )
    return (
        frequencies.selectExpr("*", f"{key_value_text('code', 'text', 'num')} AS value")
        .selectExpr(
            "column_index", "value", "cnt",
            f"row_number() OVER (PARTITION BY column_index ORDER BY {order}) AS position",
        )
        .where(f"position <= {count}")
    )


def _bounds(spark: SparkSession, states: Sequence[_ColumnState]) -> DataFrame:
    """One row per numeric column: value range, bin layout and the ranks of the middle values."""
    rows = []
    for state in states:
        low, high = state.stats["min_number"], state.stats["max_number"]
        count = state.stats["num_count"]
        bins = 1 if low == high else min(12, max(1, math.ceil(math.sqrt(count))))
        rows.append(
            (
                state.cell.index, low, high, (high - low) / bins, bins,
                (count - 1) // 2, count // 2,
            )
        )
    schema = "column_index int, low double, high double, width double, bins int, rank_low bigint, rank_high bigint"
    return spark.createDataFrame(rows, schema)


def _bucketed(frequencies: DataFrame, bounds: DataFrame) -> DataFrame:
    """Counts per histogram bin and, finer, per median bucket; at most a few thousand rows per column.

    ``bounds`` has one row per profiled column (2000 at most), hence the broadcast.
    """
    bin_index = (
        "IF(num = high OR width = 0, bins - 1, least(bins - 1, CAST(floor((num - low) / width) AS INT)))"
    )
    share = f"(num / 2 - low / 2) / (high / 2 - low / 2) * {MEDIAN_BUCKETS}"
    bucket = f"IF(high / 2 = low / 2, 0, least({MEDIAN_BUCKETS - 1}, CAST(floor({share}) AS INT)))"
    return (
        frequencies.where("num IS NOT NULL")
        .join(F.broadcast(bounds), "column_index")
        .groupBy(
            "column_index", "rank_low", "rank_high",
            F.expr(bin_index).alias("bin"), F.expr(bucket).alias("bucket"),
        )
        .agg(
            F.expr("sum(cnt)").alias("rows"),
            F.expr("count(1)").alias("n_values"),
            F.expr("min(num)").alias("first_value"),
            F.expr("max(num)").alias("last_value"),
        )
    )


def _frequency_pass(
    spark: SparkSession,
    staged: StagedCells,
    states: Sequence[_ColumnState],
    metrics: Collection[str],
) -> None:
    if not states or not metrics:
        return
    numeric = [s for s in states if s.numeric] if metrics & {"median", "histogram"} else []
    wanted = states if metrics & {"distinct", "top_values"} else numeric
    if not wanted:
        return
    # Several small plans read the frequencies. Lost cached blocks are rebuilt from the shuffle.
    with_numbers = {s.cell.index for s in numeric}
    frequencies = frequency_table(staged, [s.cell for s in wanted], with_numbers).persist(
        StorageLevel.MEMORY_AND_DISK
    )
    try:
        _read_frequencies(spark, frequencies, wanted, numeric, metrics)
    finally:
        frequencies.unpersist()


def _read_frequencies(
    spark: SparkSession,
    frequencies: DataFrame,
    states: Sequence[_ColumnState],
    numeric: Sequence[_ColumnState],
    metrics: Collection[str],
) -> None:
    parts = []
    if "distinct" in metrics:
        parts.append(
            frequencies.groupBy("column_index")
            .agg(F.expr("count(1)").alias("n_values"))
            .selectExpr("'distinct' AS tag", *_result_columns(n_values="n_values"))
        )
    if "top_values" in metrics:
        columns = _result_columns(position="position", value="value", rows="cnt")
        parts.append(top_values(frequencies).selectExpr("'top' AS tag", *columns))
    if numeric:
        bins = _bins_and_middle(_bucketed(frequencies, _bounds(spark, numeric)))
        columns = _result_columns(position="bin", rows="rows", middle="middle")
        parts.append(bins.selectExpr("'bin' AS tag", *columns))

    combined = functools.reduce(DataFrame.union, parts)
    found: dict[tuple[str, int], list] = {}
    for row in combined.collect():
        found.setdefault((row["tag"], row["column_index"]), []).append(row)

    for state in states:
        index = state.cell.index
        if "distinct" in metrics:
            state.distinct = sum(r["n_values"] for r in found.get(("distinct", index), []))
        if "top_values" in metrics:
            ranked = sorted(found.get(("top", index), []), key=lambda r: r["position"])
            state.top_values = [(r["value"], r["rows"]) for r in ranked]
        if state.numeric and "histogram" in metrics:
            counts = {r["position"]: r["rows"] for r in found[("bin", index)]}
            state.histogram = _binned_histogram(state, counts)
    if "median" in metrics and numeric:
        middles = {
            s.cell.index: sorted(m for r in found[("bin", s.cell.index)] for m in r["middle"])
            for s in numeric
        }
        _resolve_medians(frequencies, numeric, middles)


def _result_columns(**given: str) -> list[str]:
    """The shared layout of everything read from the frequencies; what is not given is null."""
    layout = {
        "position": "BIGINT", "value": "STRING", "rows": "BIGINT", "n_values": "BIGINT",
        "middle": MIDDLE_TYPE,
    }
    return ["column_index"] + [
        f"CAST({given.get(name, 'NULL')} AS {kind}) AS {name}" for name, kind in layout.items()
    ]


def _binned_histogram(state: _ColumnState, counts: dict[int, int]) -> list[tuple[float, float, int]]:
    low, high = state.stats["min_number"], state.stats["max_number"]
    if low == high:
        return [(low, high, sum(counts.values()))]
    bins = min(12, max(1, math.ceil(math.sqrt(state.stats["num_count"]))))
    width = (high - low) / bins
    return [
        (low + width * i, high if i == bins - 1 else low + width * (i + 1), counts.get(i, 0))
        for i in range(bins)
    ]


# -- the exact median ---------------------------------------------------------------------------


MIDDLE_TYPE = (
    "ARRAY<STRUCT<rows_before BIGINT, low DOUBLE, high DOUBLE, rows BIGINT, n_values BIGINT>>"
)


def _bins_and_middle(bucketed: DataFrame) -> DataFrame:
    """Rows per histogram bin, and in it the one or two buckets that hold the middle ranks.

    Buckets and bins both follow the value order, so one window per column serves both; it sees at
    most a few thousand rows.
    """
    order = Window.partitionBy("column_index").orderBy("bucket", "bin")
    before = F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, -1))
    middle = (
        "IF(rows_before <= rank_high AND rows_before + rows > rank_low, "
        "struct(rows_before, first_value AS low, last_value AS high, rows, n_values), NULL)"
    )
    return (
        bucketed.withColumn("rows_before", F.coalesce(before, F.lit(0)))
        .groupBy("column_index", "bin")
        .agg(
            F.expr(f"collect_list({middle})").alias("middle"),
            F.expr("sum(rows)").alias("rows"),
        )
    )


def _double(value: float) -> str:
    return f"DOUBLE('{value!r}')"


@dataclass
class _Bracket:
    """A value range known to hold the middle ranks of a column."""

    state: _ColumnState
    low: float
    high: float
    rows_before: int
    rows: int
    n_values: int

    @property
    def ranks(self) -> tuple[int, int]:
        """Middle ranks counted from the first row of the bracket."""
        count = self.state.stats["num_count"]
        return (count - 1) // 2 - self.rows_before, count // 2 - self.rows_before


def _resolve_medians(
    frequencies: DataFrame, states: Sequence[_ColumnState], found: dict[int, list]
) -> None:
    open_brackets = []
    for state in states:
        rows = found[state.cell.index]
        bracket = _Bracket(
            state, rows[0]["low"], rows[-1]["high"], rows[0]["rows_before"],
            sum(r["rows"] for r in rows), sum(r["n_values"] for r in rows),
        )
        if bracket.low == bracket.high:
            state.median = bracket.low
        elif len(rows) == 2 and rows[0]["low"] == rows[0]["high"] and rows[1]["low"] == rows[1]["high"]:
            state.median = (rows[0]["low"] + rows[1]["low"]) / 2
        else:
            open_brackets.append(bracket)
    while wide := [b for b in open_brackets if b.n_values > MEDIAN_GATHER_VALUES]:
        _narrow(frequencies, wide)
        open_brackets = [b for b in open_brackets if b.state.median is None]
    if open_brackets:
        _gather(frequencies, open_brackets)


def _inside(frequencies: DataFrame, brackets: Sequence[_Bracket]) -> DataFrame:
    """The frequency rows inside the brackets, with the middle ranks and the number of the bracket.

    The brackets are a table of one row per column, so the plan does not grow with the columns.
    """
    targets = frequencies.sparkSession.createDataFrame(
        [(b.state.cell.index, b.low, b.high, *b.ranks) for b in brackets],
        "column_index int, bracket_low double, bracket_high double, rank_low bigint, rank_high bigint",
    )
    return frequencies.join(F.broadcast(targets), "column_index").where(
        "num BETWEEN bracket_low AND bracket_high"
    )


def _narrow(frequencies: DataFrame, brackets: Sequence[_Bracket]) -> None:
    """Split brackets at values spread evenly over their distinct values, keep the middle part.

    The cuts come from a rank sketch with a guaranteed error, so each round leaves about
    1/``MEDIAN_CUTS`` of the distinct values. Exact row counts between the cuts decide which part
    holds the middle ranks; the result does not depend on the sketch. Two jobs serve all columns.
    """
    spark = frequencies.sparkSession
    inside = _inside(frequencies, brackets)
    shares = ", ".join(f"{step / MEDIAN_CUTS!r}D" for step in range(1, MEDIAN_CUTS))
    cuts = inside.groupBy("column_index").agg(
        F.expr(f"percentile_approx(num, array({shares}), {RANK_ACCURACY})").alias("cuts")
    )
    known = spark.createDataFrame(
        [(r["column_index"], r["cuts"]) for r in cuts.collect()], "column_index int, cuts array<double>"
    )
    # The part is the number of cuts at or below a value, found by halving.
    parted = inside.join(F.broadcast(known), "column_index").selectExpr(
        "column_index", "num", "cnt", "rank_low", "rank_high", "cuts", "0 AS part"
    )
    step = MEDIAN_CUTS // 2
    while step:
        parted = parted.withColumn(
            "part", F.expr(f"part + IF(num >= element_at(cuts, part + {step}), {step}, 0)")
        )
        step //= 2
    order = Window.partitionBy("column_index").orderBy("part")
    before = F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, -1))
    middle = (
        parted.groupBy("column_index", "rank_low", "rank_high", "part")
        .agg(
            F.expr("sum(cnt)").alias("rows"), F.expr("count(1)").alias("n_values"),
            F.expr("min(num)").alias("low"), F.expr("max(num)").alias("high"),
        )
        .withColumn("before", F.coalesce(before, F.lit(0)))
        .where("before <= rank_high AND before + rows > rank_low")
    )
    found: dict[int, list] = {}
    for row in middle.collect():
        found.setdefault(row["column_index"], []).append(row)
    for bracket in brackets:
        kept = sorted(found[bracket.state.cell.index], key=lambda r: r["part"])
        bracket.low, bracket.high = kept[0]["low"], kept[-1]["high"]
        bracket.rows_before += kept[0]["before"]
        bracket.rows = sum(r["rows"] for r in kept)
        bracket.n_values = sum(r["n_values"] for r in kept)
        if all(r["low"] == r["high"] for r in kept):
            bracket.state.median = (bracket.low + bracket.high) / 2


def _gather(frequencies: DataFrame, brackets: Sequence[_Bracket]) -> None:
    """Read the middle values from the few distinct values left inside the brackets."""
    order = Window.partitionBy("column_index").orderBy("num")
    through = F.sum("cnt").over(order.rowsBetween(Window.unboundedPreceding, 0))
    middle = (
        _inside(frequencies, brackets)
        .select("column_index", "num", "cnt", "rank_low", "rank_high", through.alias("through"))
        .where("through > rank_low AND through - cnt <= rank_high")
        .groupBy("column_index")
        .agg(F.expr("(min(num) + max(num)) / 2").alias("median"))
    )
    medians = {row["column_index"]: row["median"] for row in middle.collect()}
    for bracket in brackets:
        bracket.state.median = medians[bracket.state.cell.index]


# -- the result ---------------------------------------------------------------------------------


def _profile_row(state: _ColumnState, row_count: int) -> tuple:
    stats = state.stats
    non_null = stats["non_null"]
    missing = row_count - non_null
    unique = None
    if state.distinct is not None:
        unique = state.distinct / non_null if non_null else 0.0
    number = state.numeric
    date, text = state.type == "date", state.type == "text"

    def when(condition: bool, key: str):
        return stats.get(key) if condition else None

    return (
        state.cell.index, state.name, state.type, missing, non_null, state.distinct,
        missing / row_count if row_count else 0.0, unique,
        when(number, "min_number"), when(number, "max_number"), when(number, "mean"),
        state.median if number else None, when(number, "std_dev"),
        when(date, "min_text"), when(date, "max_text"),
        when(text, "min_length"), when(text, "max_length"),
        state.histogram if number else None,
        state.top_values,
        state.estimated or None,
    )
