"""The registered queries: each operator applied to whole tables, with the SQL it must agree with.

Every entry is ``name: (query, sql)``. A query takes a session and a folder of Parquet tables and
returns a DataFrame; ``sql`` is the same result for DuckDB, or ``None`` where SQL cannot express it.
The given tables hold no nulls, so several queries blank out cells by the same rule on both sides.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.functions.cells import stage
from colscope.functions.text import CUT_MARKER, MAX_DISPLAY_UNITS, quoted
from colscope.operators.display import render_columns, tsv_rows, value_text
from colscope.operators.metadata import (
    column_listing,
    column_warnings,
    profile_report,
    search_columns,
    table_summary,
)
from colscope.operators.sinks import write_profile, write_tsv
from colscope.operators.view import (
    Filter,
    Sort,
    ViewSpec,
    apply_view,
    filter_predicate,
    number_rows,
    operators_for_type,
)
from colscope.options import DelimitedOptions, Limits
from colscope.plans.profile import profile
from colscope.plans.progress import count_rows
from colscope.session import scratch_folder
from colscope.sources.delimited import open_delimited
from colscope.sources.files import source_bytes
from colscope.sources.heads import detect_delimiters
from colscope.sources.open import count_cut_cells, open_table, preview, profile_table
from colscope.sources.parquet import footer_audit
from colscope.sources.table import Table
from colscope.sources.workbook import archive_audit, list_sheets, workbook_rows
from colscope.streaming.profiles import (
    log_frequencies,
    logged_frequencies,
    on_warnings,
    stream_frequencies,
    stream_profile,
    stream_top_values,
    top_of_frequencies,
)

Query = Callable[[SparkSession, str], DataFrame]
CATALOGUE: dict[str, tuple[Query, str | None]] = {}

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def register(name: str, sql: str | None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        CATALOGUE[name] = (query, sql)
        return query

    return add


def table(spark: SparkSession, folder: str, name: str) -> Table:
    return open_table(spark, f"{folder}/{name}.parquet")


def load(spark: SparkSession, folder: str, name: str, *expressions: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.selectExpr(*expressions) if expressions else df


def rounded(*names: str, digits: int = 4) -> list[str]:
    return [f"round({name}, {digits}) AS {name}" for name in names]


# -- profiles -----------------------------------------------------------------------------------

GAPS = "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE {0} END AS {0}"
LINEITEM_WITH_GAPS = [
    "l_orderkey", GAPS.format("l_quantity"), "l_extendedprice", GAPS.format("l_discount"),
    GAPS.format("l_returnflag"), "l_linenumber",
]


def _basic_sql(source: str, numbers: list[str], texts: list[str]) -> str:
    parts = []
    for name in numbers + texts:
        number = name in numbers
        value = name if number else "NULL"
        parts.append(
            f"SELECT '{name}' AS name, '{'number' if number else 'text'}' AS type, "
            f"CAST(count(*) - count({name}) AS BIGINT) AS missing, CAST(count({name}) AS BIGINT) AS non_null, "
            f"round((count(*) - count({name})) / count(*)::DOUBLE, 4) AS missing_ratio, "
            f"CAST(min({value}) AS DOUBLE) AS min_number, CAST(max({value}) AS DOUBLE) AS max_number, "
            f"round(avg(CAST({value} AS DOUBLE)), 4) AS mean, "
            f"round(stddev_pop(CAST({value} AS DOUBLE)), 4) AS std_dev FROM t"
        )
    return f"WITH t AS ({source}) " + " UNION ALL ".join(parts)


@register(
    "profile_basic_lineitem",
    _basic_sql(
        f"SELECT {', '.join(LINEITEM_WITH_GAPS)} FROM lineitem",
        ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_linenumber"],
        ["l_returnflag"],
    ),
)
def profile_basic_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    df = load(spark, folder, "lineitem", *LINEITEM_WITH_GAPS)
    return profile(df, metrics=()).profiles.selectExpr(
        "name", "type", "missing", "non_null", *rounded("missing_ratio"), "min_number", "max_number",
        *rounded("mean", "std_dev"),
    )


def _each(source: str, names: list[str], columns: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS name, {columns.replace('@', name)} FROM {source}" for name in names
    )


@register("profile_median_orders", _each("orders", ["o_orderkey", "o_custkey", "o_totalprice"], "CAST(median(@) AS DOUBLE) AS median"))
def profile_median_orders(spark: SparkSession, folder: str) -> DataFrame:
    df = load(spark, folder, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    return profile(df, metrics={"median"}).profiles.select("name", "median")


@register(
    "profile_median_lineitem",
    _each("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "round(median(@), 6) AS median"),
)
def profile_median_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    df = load(spark, folder, "lineitem", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return profile(df, metrics={"median"}).profiles.selectExpr("name", *rounded("median", digits=6))


DISTINCT_SQL = (
    "CAST(count(DISTINCT @) AS BIGINT) AS distinct_values, "
    "round(count(DISTINCT @) / count(@)::DOUBLE, 4) AS unique_ratio"
)


@register(
    "profile_distinct_customer",
    _each("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], DISTINCT_SQL),
)
def profile_distinct_customer(spark: SparkSession, folder: str) -> DataFrame:
    return profile(load(spark, folder, "customer"), metrics={"distinct"}).profiles.selectExpr(
        "name", "distinct AS distinct_values", *rounded("unique_ratio")
    )


@register("profile_distinct_documents", _each("documents", ["doc_id", "text", "lang", "source", "n_chars"], DISTINCT_SQL))
def profile_distinct_documents(spark: SparkSession, folder: str) -> DataFrame:
    return profile(load(spark, folder, "documents"), metrics={"distinct"}).profiles.selectExpr(
        "name", "distinct AS distinct_values", *rounded("unique_ratio")
    )


LONG_TEXT = "CONCAT(repeat('abc ', 30000), CAST(s_suppkey % 20 AS VARCHAR(20)))"


@register("profile_distinct_long_texts", _each(f"(SELECT {LONG_TEXT} AS long_text FROM supplier)", ["long_text"], DISTINCT_SQL))
def profile_distinct_long_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of more than 100 000 characters that differ at their end only."""
    df = load(spark, folder, "supplier", f"{LONG_TEXT} AS long_text")
    return profile(df, metrics={"distinct"}).profiles.selectExpr(
        "name", "distinct AS distinct_values", *rounded("unique_ratio")
    )


TYPED_TEXTS = [
    "CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE CAST(p_size AS VARCHAR(20)) END AS mixed_text",
    "CONCAT(' ', CAST(p_size AS VARCHAR(20)), CASE WHEN p_partkey % 2 = 0 THEN '.5e1' ELSE '' END) AS number_text",
    "CASE WHEN p_size % 2 = 0 THEN 'TRUE' ELSE ' false ' END AS boolean_text",
    "CONCAT('20', CAST(10 + p_size % 10 AS VARCHAR(20)), '-03-', CAST(10 + p_size % 18 AS VARCHAR(20))) AS date_text",
    "CONCAT(CAST(p_size AS VARCHAR(20)), 'd') AS plain_text",
    "CASE WHEN p_size < 0 THEN p_name END AS empty_text",
    "CASE WHEN p_size % 2 = 0 THEN 'NaN' ELSE 'Infinity' END AS odd_text",
]
_TYPE_OF = (
    "CASE WHEN regexp_full_match(trim(@), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 'number' "
    "WHEN lower(trim(@)) IN ('true', 'false') THEN 'boolean' "
    "WHEN regexp_full_match(trim(@), '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'date' ELSE 'text' END"
)


@register(
    "profile_types_mixed",
    f"WITH t AS (SELECT {', '.join(TYPED_TEXTS)} FROM part) "
    + _each(
        "t",
        ["mixed_text", "number_text", "boolean_text", "date_text", "plain_text", "empty_text", "odd_text"],
        "CASE WHEN count(@) = 0 THEN 'empty' "
        f"WHEN count(DISTINCT CASE WHEN @ IS NOT NULL THEN {_TYPE_OF} END) > 1 THEN 'mixed' "
        f"ELSE min(CASE WHEN @ IS NOT NULL THEN {_TYPE_OF} END) END AS type",
    ),
)
def profile_types_mixed(spark: SparkSession, folder: str) -> DataFrame:
    return profile(load(spark, folder, "part", *TYPED_TEXTS), metrics=()).profiles.select("name", "type")


@register(
    "profile_number_text_part",
    "WITH t AS (SELECT CAST(CONCAT(p_size, CASE WHEN p_partkey % 2 = 0 THEN '.5e1' ELSE '' END) AS DOUBLE) AS v FROM part) "
    "SELECT 'number_text' AS name, min(v) AS min_number, max(v) AS max_number, round(avg(v), 4) AS mean, "
    "median(v) AS median, round(stddev_pop(v), 4) AS std_dev FROM t",
)
def profile_number_text_part(spark: SparkSession, folder: str) -> DataFrame:
    found = profile(load(spark, folder, "part", TYPED_TEXTS[1]), metrics={"median"}).profiles
    return found.selectExpr("name", "min_number", "max_number", *rounded("mean"), "median", *rounded("std_dev"))


@register(
    "profile_dates_orders",
    "SELECT 'o_orderdate' AS name, strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S.%gZ') AS min_text, "
    "strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S.%gZ') AS max_text FROM orders UNION ALL "
    "SELECT 'date_text', strftime(min(o_orderdate), '%Y-%m-%d'), strftime(max(o_orderdate), '%Y-%m-%d') FROM orders",
)
def profile_dates_orders(spark: SparkSession, folder: str) -> DataFrame:
    df = load(spark, folder, "orders", "o_orderdate", "date_format(o_orderdate, 'yyyy-MM-dd') AS date_text")
    return profile(df, metrics=()).profiles.select("name", "min_text", "max_text")


_UNITS = "length(@) + length(regexp_replace(@, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))"


@register(
    "top_sketch_long_texts",
    "SELECT CAST(count(*) AS BIGINT) AS frequency FROM orders GROUP BY o_orderpriority",
)
def top_sketch_long_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Sketched top values of texts that share their first 600 characters."""
    df = load(spark, folder, "orders", "concat(repeat('x', 600), o_orderpriority) AS long_text")
    found = profile(df, mode="approx", metrics={"top_values"}).profiles
    return found.selectExpr("explode(top_values) AS entry").selectExpr("entry.count AS frequency")


@register(
    "profile_text_lengths_documents",
    _each(
        "documents", ["text", "lang", "source"],
        f"CAST(min({_UNITS}) AS BIGINT) AS min_length, "
        f"CAST(max({_UNITS}) AS BIGINT) AS max_length",
    ),
)
def profile_text_lengths_documents(spark: SparkSession, folder: str) -> DataFrame:
    df = load(spark, folder, "documents", "text", "lang", "source")
    return profile(df, metrics=()).profiles.select("name", "min_length", "max_length")


def _histogram(profiles: DataFrame) -> DataFrame:
    return profiles.selectExpr("name", "posexplode(histogram) AS (bin, entry)").selectExpr(
        "name", "CAST(bin AS BIGINT) AS bin", "round(entry.start, 4) AS bin_start",
        "round(entry.end, 4) AS bin_end", "entry.count AS rows_in_bin",
    )


def _histogram_sql(source: str, name: str) -> str:
    return (
        f"WITH b AS (SELECT min({name}) AS lo, max({name}) AS hi, "
        f"CAST(least(12, greatest(1, ceil(sqrt(count({name}))))) AS BIGINT) AS n FROM {source}), "
        "e AS (SELECT unnest(generate_series(0, n - 1)) AS bin, lo, hi, n, (hi - lo) / n AS w FROM b), "
        f"c AS (SELECT CASE WHEN {name} = hi THEN n - 1 ELSE CAST(floor(({name} - lo) / ((hi - lo) / n)) AS BIGINT) END AS bin, "
        f"count(*) AS k FROM {source}, b GROUP BY 1) "
        f"SELECT '{name}' AS name, CAST(e.bin AS BIGINT) AS bin, round(lo + w * e.bin, 4) AS bin_start, "
        "round(CASE WHEN e.bin = n - 1 THEN hi ELSE lo + w * (e.bin + 1) END, 4) AS bin_end, "
        "CAST(coalesce(k, 0) AS BIGINT) AS rows_in_bin FROM e LEFT JOIN c ON e.bin = c.bin"
    )


@register("profile_histogram_extendedprice", _histogram_sql("lineitem", "l_extendedprice"))
def profile_histogram_extendedprice(spark: SparkSession, folder: str) -> DataFrame:
    df = load(spark, folder, "lineitem", "l_extendedprice")
    return _histogram(profile(df, metrics={"histogram"}).profiles)


@register(
    "profile_histogram_constant",
    "SELECT 'constant' AS name, CAST(0 AS BIGINT) AS bin, CAST(7 AS DOUBLE) AS bin_start, CAST(7 AS DOUBLE) AS bin_end, "
    "CAST(count(*) AS BIGINT) AS rows_in_bin FROM orders",
)
def profile_histogram_constant(spark: SparkSession, folder: str) -> DataFrame:
    df = load(spark, folder, "orders", "CAST(7 AS DOUBLE) AS constant")
    return _histogram(profile(df, metrics={"histogram"}).profiles)


def _top_values(profiles: DataFrame) -> DataFrame:
    return profiles.selectExpr("name", "posexplode(top_values) AS (p, entry)").selectExpr(
        "name", "CAST(p + 1 AS BIGINT) AS position", "entry.value AS value", "entry.count AS frequency"
    )


def _top_sql(source: str, names: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS name, position, value, frequency FROM (SELECT CAST({name} AS VARCHAR) AS value, "
        "CAST(count(*) AS BIGINT) AS frequency, CAST(row_number() OVER "
        f"(ORDER BY count(*) DESC, CAST({name} AS VARCHAR)) AS BIGINT) AS position "
        f"FROM {source} GROUP BY {name}) WHERE position <= 5"
        for name in names
    )


@register("top_values_orders", _top_sql("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]))
def top_values_orders(spark: SparkSession, folder: str) -> DataFrame:
    df = load(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return _top_values(profile(df, metrics={"top_values"}).profiles)


@register("top_values_events", _top_sql("events", ["user_id", "event_type", "props"]))
def top_values_events(spark: SparkSession, folder: str) -> DataFrame:
    df = load(spark, folder, "events", "user_id", "event_type", "props")
    return _top_values(profile(df, metrics={"top_values"}).profiles)


@register(
    "profile_nested_embeddings",
    "SELECT 'embedding' AS name, 'text' AS type, CAST(0 AS BIGINT) AS missing, CAST(count(*) AS BIGINT) AS non_null, "
    "CAST(count(DISTINCT embedding) AS BIGINT) AS distinct_values FROM embeddings",
)
def profile_nested_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    found = profile(load(spark, folder, "embeddings", "embedding"), metrics={"distinct"}).profiles
    return found.selectExpr("name", "type", "missing", "non_null", "distinct AS distinct_values")


@register(
    "profile_json_props",
    "SELECT 'props' AS name, 'text' AS type, CAST(count(DISTINCT props) AS BIGINT) AS distinct_values, "
    "CAST(min(length(props)) AS BIGINT) AS min_length, CAST(max(length(props)) AS BIGINT) AS max_length FROM events",
)
def profile_json_props(spark: SparkSession, folder: str) -> DataFrame:
    found = profile(load(spark, folder, "events", "props"), metrics={"distinct"}).profiles
    return found.selectExpr("name", "type", "distinct AS distinct_values", "min_length", "max_length")


LINEITEM_NUMBERS = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice"]


def _estimates(spark: SparkSession, folder: str, mode: str) -> DataFrame:
    """Exact parts of an estimated profile, and whether the estimates keep their error bounds."""
    df = load(spark, folder, "lineitem", *LINEITEM_NUMBERS)
    exact = profile(df, metrics={"distinct"}).profiles
    found = profile(df, mode=mode).profiles.alias("a").join(
        exact.select("name", F.col("distinct").alias("exact")), "name"
    )
    pairs = ", ".join(f"'{n}', CAST({n} AS DOUBLE)" for n in LINEITEM_NUMBERS)
    below = df.selectExpr(f"stack({len(LINEITEM_NUMBERS)}, {pairs}) AS (name, v)")
    share = (
        below.join(F.broadcast(found.select("name", "median")), "name").groupBy("name")
        .agg(F.expr("avg(IF(v < median, 1D, 0D))").alias("below"), F.expr("avg(IF(v <= median, 1D, 0D))").alias("through"))
    )
    return found.join(share, "name").selectExpr(
        "name", "non_null", "min_number", "max_number", *rounded("mean"),
        "abs(a.`distinct` - exact) <= 0.1 * exact AS distinct_close",
        "below <= 0.53 AND through >= 0.47 AS median_close",
        "aggregate(histogram, 0L, (s, b) -> s + b.count) AS histogram_rows",
    )


_ESTIMATES_SQL = _each(
    "lineitem", LINEITEM_NUMBERS,
    "CAST(count(@) AS BIGINT) AS non_null, CAST(min(@) AS DOUBLE) AS min_number, CAST(max(@) AS DOUBLE) AS max_number, "
    "round(avg(CAST(@ AS DOUBLE)), 4) AS mean, TRUE AS distinct_close, TRUE AS median_close, CAST(count(@) AS BIGINT) AS histogram_rows",
)


@register("profile_approx_lineitem", _ESTIMATES_SQL)
def profile_approx_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return _estimates(spark, folder, "approx")


@register("profile_auto_lineitem", _ESTIMATES_SQL)
def profile_auto_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return _estimates(spark, folder, "auto")


@register(
    "profile_flags_auto_lineitem",
    "SELECT * FROM (VALUES ('l_returnflag', NULL), ('l_linenumber', NULL), "
    "('l_extendedprice', 'distinct,histogram,median,topValues')) AS v(name, estimated)",
)
def profile_flags_auto_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    df = load(spark, folder, "lineitem", "l_returnflag", "l_linenumber", "l_extendedprice")
    found = profile(df, mode="auto").profiles
    return found.selectExpr("name", "array_join(array_sort(approximate_metrics), ',') AS estimated")


RULED = [
    "l_linenumber + 10 * l_orderkey + 0.5 * l_partkey AS maybe_key",
    "CASE WHEN l_linenumber = 1 THEN l_returnflag ELSE CAST(l_linenumber AS VARCHAR(20)) END AS mixed",
    "CASE WHEN l_linenumber < 0 THEN 1 END AS nothing",
    "CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN NULL ELSE 'same' END AS gaps",
    "l_quantity",
    "CONCAT(l_orderkey, '-', l_partkey, '-', l_suppkey, '-', l_linenumber, '-', l_extendedprice) AS identifier",
]


def _rules_sql(source: str, types: dict[str, str]) -> str:
    stats = " UNION ALL ".join(
        f"SELECT {i} AS ci, '{name}' AS name, '{kind}' AS type, count(*) AS n, count({name}) AS k, "
        f"count(DISTINCT {name}) AS d FROM t"
        for i, (name, kind) in enumerate(types.items())
    )
    percent = "CAST(CAST(floor({0} * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%'"
    return (
        f"WITH t AS ({source}), p AS ({stats}), r AS (SELECT *, (n - k) / n::DOUBLE AS m, "
        "CASE WHEN k = 0 THEN 0 ELSE d / k::DOUBLE END AS u FROM p) "
        "SELECT name, 'mixedType' AS code, name || ' contains mixed value types across the full dataset.' AS message FROM r WHERE type = 'mixed' "
        "UNION ALL SELECT name, 'allEmpty', name || ' is entirely empty.' FROM r WHERE k = 0 "
        "UNION ALL SELECT name, 'constant', name || ' contains one non-null value.' FROM r WHERE k > 0 AND d = 1 "
        f"UNION ALL SELECT name, 'highMissing', name || ' is ' || {percent.format('m')} || ' missing.' FROM r WHERE m >= 0.2 "
        f"UNION ALL SELECT name, 'possibleIdentifier', name || ' may be an identifier (' || {percent.format('u')} || ' unique).' FROM r WHERE k >= 20 AND u >= 0.98"
    )


@register(
    "quality_warnings_all",
    _rules_sql(
        f"SELECT {', '.join(RULED)} FROM lineitem",
        {"maybe_key": "number", "mixed": "mixed", "nothing": "empty", "gaps": "text", "l_quantity": "number", "identifier": "text"},
    ),
)
def quality_warnings_all(spark: SparkSession, folder: str) -> DataFrame:
    df = load(spark, folder, "lineitem", *RULED)
    return profile(df, metrics={"distinct"}).warnings.select("name", "code", "message")


@register(
    "profile_sink_customer",
    "SELECT 'c_acctbal' AS name, 'number' AS type, CAST(count(*) AS BIGINT) AS non_null FROM customer UNION ALL "
    "SELECT 'c_mktsegment', 'text', CAST(count(*) AS BIGINT) FROM customer",
)
def profile_sink_customer(spark: SparkSession, folder: str) -> DataFrame:
    target = scratch_folder(spark)
    write_profile(profile(load(spark, folder, "customer", "c_acctbal", "c_mktsegment")), target)
    return spark.read.parquet(f"{target}/profiles").select("name", "type", "non_null")


@register(
    "profile_report_orders",
    "SELECT 'o_orderstatus' AS name, '0 (0%)' AS missing, CAST(count(DISTINCT o_orderstatus) AS VARCHAR) AS distinct_label FROM orders UNION ALL "
    "SELECT 'o_orderpriority', '0 (0%)', CAST(count(DISTINCT o_orderpriority) AS VARCHAR) FROM orders",
)
def profile_report_orders(spark: SparkSession, folder: str) -> DataFrame:
    found = profile(load(spark, folder, "orders", "o_orderstatus", "o_orderpriority"))
    return profile_report(found).selectExpr("name", "missing", "distinct AS distinct_label")


@register("rows_observed_lineitem", "SELECT CAST(count(*) AS BIGINT) AS rows_processed FROM lineitem")
def rows_observed_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    watched, observation = count_rows(load(spark, folder, "lineitem"), f"rows-{uuid.uuid4().hex}")
    watched.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(observation.get["rows"],)], "rows_processed bigint")


# -- previews -----------------------------------------------------------------------------------


@register(
    "preview_head",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 2000",
)
def preview_head(spark: SparkSession, folder: str) -> DataFrame:
    shown = preview(table(spark, folder, "orders"))
    return shown.table.named().select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@register(
    "preview_truncation",
    "SELECT count(*) > 1000 AS rows_cut, FALSE AS columns_cut, CAST(0 AS BIGINT) AS cells_cut, "
    "CAST(least(count(*), 1000) AS BIGINT) AS shown_rows, CAST(count(*) AS BIGINT) AS total_rows FROM orders",
)
def preview_truncation(spark: SparkSession, folder: str) -> DataFrame:
    shown = preview(table(spark, folder, "orders"), Limits(preview_rows=1000))
    return shown.truncation().selectExpr(
        "rows AS rows_cut", "columns AS columns_cut", "cells AS cells_cut",
        f"CAST({shown.row_count} AS BIGINT) AS shown_rows",
        f"CAST({shown.total_rows} AS BIGINT) AS total_rows",
    )


@register(
    "dataset_summary",
    "SELECT 'PARQUET' AS format, format('{:,}', count(*)) || ' rows' AS rows_label, '6 columns' AS columns_label FROM orders",
)
def dataset_summary(spark: SparkSession, folder: str) -> DataFrame:
    shown = preview(table(spark, folder, "orders"))
    return table_summary(shown.table, shown).selectExpr(
        "format", "rows AS rows_label", "columns AS columns_label"
    )


# -- filters, search and sort -------------------------------------------------------------------


def _view(spark: SparkSession, folder: str, name: str, types: list[str], spec: ViewSpec) -> DataFrame:
    return apply_view(table(spark, folder, name), spec, types).named()


PART_TYPES = ["number", "text", "text", "text", "number", "number"]
for _suffix, _operator, _value, _condition in [
    ("contains", "contains", "RING", "contains(lower(p_name), 'ring')"),
    ("not_contains", "notContains", "Ring", "NOT contains(lower(p_name), 'ring')"),
    ("starts", "startsWith", "Small", "starts_with(lower(p_name), 'small')"),
    ("ends", "endsWith", "WIDGET", "ends_with(lower(p_name), 'widget')"),
    ("equals", "equals", "small RING", "lower(p_name) = 'small ring'"),
    ("not_equals", "notEquals", "small ring", "lower(p_name) <> 'small ring'"),
]:
    register(f"filter_text_{_suffix}", f"SELECT p_partkey, p_name FROM part WHERE {_condition}")(
        lambda spark, folder, op=_operator, value=_value: _view(
            spark, folder, "part", PART_TYPES, ViewSpec(filters=(Filter(1, op, value),))
        ).select("p_partkey", "p_name")
    )

LINEITEM_TYPES = ["number"] * 8 + ["text", "text", "date"]
for _suffix, _column, _operator, _value, _second, _condition in [
    ("eq", 4, "equals", "25", None, "l_quantity = 25"),
    ("ne", 3, "notEquals", "0x3", None, "l_linenumber <> 3"),
    ("gt", 5, "greaterThan", "99000.5", None, "l_extendedprice > 99000.5"),
    ("ge", 6, "greaterThanOrEqual", "0.09", None, "l_discount >= 0.09"),
    ("lt", 2, "lessThan", "10.5", None, "l_suppkey < 10.5"),
    ("le", 1, "lessThanOrEqual", "2e1", None, "l_partkey <= 20"),
    ("between_swapped", 5, "between", "20000", "1e4", "l_extendedprice BETWEEN 10000 AND 20000"),
]:
    register(
        f"filter_num_{_suffix}",
        f"SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE {_condition}",
    )(
        lambda spark, folder, c=_column, op=_operator, value=_value, second=_second: _view(
            spark, folder, "lineitem", LINEITEM_TYPES, ViewSpec(filters=(Filter(c, op, value, second),))
        ).select("l_orderkey", "l_linenumber", "l_extendedprice")
    )

ORDER_TYPES = ["number", "number", "text", "number", "date", "text"]
for _suffix, _operator, _value, _second, _condition in [
    ("between", "between", "1997-06-30", "1997-01-01", "o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-06-30'"),
    ("after", "greaterThan", "2000-01-01T00:00:00Z", None, "o_orderdate > TIMESTAMP '2000-01-01'"),
    ("not_equals", "notEquals", "1998-10-03", None, "o_orderdate <> TIMESTAMP '1998-10-03'"),
]:
    register(f"filter_date_{_suffix}", f"SELECT o_orderkey FROM orders WHERE {_condition}")(
        lambda spark, folder, op=_operator, value=_value, second=_second: _view(
            spark, folder, "orders", ORDER_TYPES, ViewSpec(filters=(Filter(4, op, value, second),))
        ).select("o_orderkey")
    )


def _from(spark: SparkSession, folder: str, name: str, *expressions: str) -> Table:
    return Table.from_dataframe(load(spark, folder, name, *expressions))


DECIMAL_FILTERS = {
    "between": (("between", "5000.505", "-100.125"), "v BETWEEN -100.125 AND 5000.505"),
    "eq": (("equals", "1e3", None), "v = 1000"),
    "gt": (("greaterThan", "9000.999", None), "v > 9000.999"),
    "ne": (("notEquals", "0.005", None), "v <> 0.005"),
    "huge": (("lessThan", "1e40", None), "v < 1e40"),
}
for _suffix, (_filter, _condition) in DECIMAL_FILTERS.items():

    @register(
        f"filter_decimal_{_suffix}",
        f"SELECT c_custkey FROM (SELECT c_custkey, CAST(c_acctbal AS DECIMAL(12,2)) AS v FROM customer) WHERE {_condition}",
    )
    def filter_decimal(spark: SparkSession, folder: str, chosen=_filter) -> DataFrame:
        path = scratch_folder(spark)
        load(spark, folder, "customer", "c_custkey", "CAST(c_acctbal AS DECIMAL(12,2)) AS v").write.parquet(path)
        stored = open_table(spark, path, format="parquet")
        return apply_view(stored, ViewSpec(filters=(Filter(1, *chosen),)), ["number", "number"]).named().select("c_custkey")


NARROWED = {
    "wide_decimal_between": ("l_extendedprice", "DECIMAL(20,2)", ("between", "1000.005", "2500.5"), "v BETWEEN 1000.005 AND 2500.5"),
    "wide_decimal_lt": ("l_extendedprice", "DECIMAL(20,2)", ("lessThan", "1500"), "v < 1500"),
    "float_ge": ("l_discount", "FLOAT", ("greaterThanOrEqual", "0.07"), "v >= CAST(0.07 AS DOUBLE)"),
    "float_eq": ("l_discount", "FLOAT", ("equals", "0.05"), "v = CAST(0.05 AS DOUBLE)"),
    "float_ne": ("l_quantity", "FLOAT", ("notEquals", "7"), "v <> 7"),
}
for _suffix, (_column, _kind, _filter, _condition) in NARROWED.items():

    @register(
        f"filter_{_suffix}",
        f"SELECT l_orderkey, l_linenumber FROM (SELECT *, CAST(CAST({_column} AS {_kind}) AS DOUBLE) AS v FROM lineitem) WHERE {_condition}",
    )
    def filter_narrowed(spark: SparkSession, folder: str, column=_column, kind=_kind, chosen=_filter) -> DataFrame:
        path = scratch_folder(spark)
        load(spark, folder, "lineitem", "l_orderkey", "l_linenumber", f"CAST({column} AS {kind}) AS v").write.parquet(path)
        stored = open_table(spark, path, format="parquet")
        found = apply_view(stored, ViewSpec(filters=(Filter(2, *chosen),)), ["number"] * 3)
        return found.named().select("l_orderkey", "l_linenumber")


FLAGS = "CASE WHEN toxic = 1 THEN 'True' WHEN quality = 1 THEN 'FALSE' ELSE ' true ' END"
for _suffix, _operator, _wanted in [("true", "isTrue", "true"), ("false", "isFalse", "false")]:
    register(f"filter_bool_{_suffix}", f"SELECT doc_id FROM labels WHERE lower({FLAGS}) = '{_wanted}'")(
        lambda spark, folder, op=_operator: apply_view(
            _from(spark, folder, "labels", "doc_id", f"{FLAGS} AS flag"),
            ViewSpec(filters=(Filter(1, op),)), ["number", "boolean"],
        ).named().select("doc_id")
    )

SPARSE_SOURCE = "CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 THEN NULL ELSE source END"
for _suffix, _operator, _condition in [
    ("empty", "isEmpty", "IS NULL"), ("not_empty", "isNotEmpty", "IS NOT NULL"),
]:
    register(
        f"filter_{_suffix}", f"SELECT doc_id FROM documents WHERE nullif({SPARSE_SOURCE}, '') {_condition}"
    )(
        lambda spark, folder, op=_operator: apply_view(
            _from(spark, folder, "documents", "doc_id", f"{SPARSE_SOURCE} AS source"),
            ViewSpec(filters=(Filter(1, op),)), ["number", "text"],
        ).named().select("doc_id")
    )


@register(
    "search_global",
    "SELECT s_suppkey FROM supplier WHERE contains(lower(CAST(s_suppkey AS VARCHAR)), '17') "
    "OR contains(lower(s_name), '17') OR contains(CAST(s_nationkey AS VARCHAR), '17') "
    "OR contains(CAST(s_acctbal AS VARCHAR), '17')",
)
def search_global(spark: SparkSession, folder: str) -> DataFrame:
    types = ["number", "text", "number", "number"]
    return _view(spark, folder, "supplier", types, ViewSpec(query="  17 ")).select("s_suppkey")


@register("search_documents", "SELECT doc_id FROM documents WHERE contains(lower(text), 'eau') OR contains(lower(source), 'eau') OR contains(lower(lang), 'eau')")
def search_documents(spark: SparkSession, folder: str) -> DataFrame:
    types = ["number", "text", "text", "text", "number"]
    return _view(spark, folder, "documents", types, ViewSpec(query="EAU")).select("doc_id")


SPARSE_BALANCE = "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal"


@register(
    "view_filter_search_sort",
    "SELECT c_custkey, c_acctbal, CAST(row_number() OVER (ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS BIGINT) AS place "
    f"FROM (SELECT c_custkey, {SPARSE_BALANCE}, c_mktsegment FROM customer) WHERE contains(lower(c_mktsegment), 'house') AND c_custkey >= 10",
)
def view_filter_search_sort(spark: SparkSession, folder: str) -> DataFrame:
    df = load(spark, folder, "customer", "c_custkey", SPARSE_BALANCE, "c_mktsegment", "c_custkey AS _row_index")
    source = Table.from_dataframe(df, order=["_row_index"])
    spec = ViewSpec("HOUSE", (Filter(0, "greaterThanOrEqual", "10"),), Sort(1, "desc"))
    found = apply_view(source, spec, ["number", "number", "text"])
    return number_rows(found.df, "place").selectExpr("c0 AS c_custkey", "c1 AS c_acctbal", "place")


@register(
    "sort_natural_text",
    "SELECT name, CAST(row_number() OVER (ORDER BY lower(kind), n, p_partkey) AS BIGINT) AS place, p_partkey FROM "
    "(SELECT CONCAT(CASE WHEN p_partkey % 2 = 0 THEN 'Item ' ELSE 'item ' END, CAST(p_size AS VARCHAR(20))) AS name, 'item' AS kind, p_size AS n, p_partkey FROM part)",
)
def sort_natural_text(spark: SparkSession, folder: str) -> DataFrame:
    df = load(
        spark, folder, "part",
        "CONCAT(CASE WHEN p_partkey % 2 = 0 THEN 'Item ' ELSE 'item ' END, CAST(p_size AS VARCHAR(20))) AS name",
        "p_partkey",
    )
    source = Table.from_dataframe(df.withColumn("_row_index", F.col("p_partkey")), order=["_row_index"])
    found = apply_view(source, ViewSpec(sort=Sort(0, "asc")), ["text", "number"])
    return number_rows(found.df, "place").selectExpr("c0 AS name", "place", "c1 AS p_partkey")


@register(
    "sort_date_desc",
    "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS BIGINT) AS place FROM orders",
)
def sort_date_desc(spark: SparkSession, folder: str) -> DataFrame:
    found = apply_view(table(spark, folder, "orders"), ViewSpec(sort=Sort(4, "desc")), ORDER_TYPES)
    return number_rows(found.df, "place").selectExpr("c0 AS o_orderkey", "place")


@register(
    "sort_boolean_text",
    f"SELECT doc_id, CAST(row_number() OVER (ORDER BY CASE WHEN lower({FLAGS}) = 'true' THEN 1 ELSE 0 END, doc_id) AS BIGINT) AS place FROM labels",
)
def sort_boolean_text(spark: SparkSession, folder: str) -> DataFrame:
    df = load(spark, folder, "labels", "doc_id", f"{FLAGS} AS flag", "doc_id AS _row_index")
    source = Table.from_dataframe(df, order=["_row_index"])
    found = apply_view(source, ViewSpec(sort=Sort(1, "asc")), ["number", "boolean"])
    return number_rows(found.df, "place").selectExpr("c0 AS doc_id", "place")


# -- delimited files ----------------------------------------------------------------------------

ORDER_TEXTS = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
ORDERS_SQL = "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"


def _write_csv(df: DataFrame, target: str | None = None, **options: str) -> str:
    target = target or scratch_folder(df.sparkSession)
    given = {"header": "true", "escape": '"', "emptyValue": ""} | options
    df.write.options(**given).csv(target)
    return target


def _write_lines(df: DataFrame, value: str, first: tuple[str, ...] = ()) -> str:
    """Write lines of text, each file starting with the given ones."""
    def with_head(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": list(first)})
        yield from batches

    target = scratch_folder(df.sparkSession)
    df.selectExpr(f"{value} AS value").mapInPandas(with_head, "value string").write.text(target)
    return target


def _orders_back(source: Table) -> DataFrame:
    names = dict(zip(source.columns, source.fields, strict=True))
    return source.df.selectExpr(
        f"CAST({names['o_orderkey']} AS BIGINT) AS o_orderkey", f"{names['o_orderstatus']} AS o_orderstatus",
        f"CAST({names['o_totalprice']} AS DOUBLE) AS o_totalprice", f"{names['o_orderpriority']} AS o_orderpriority",
    )


@register("csv_roundtrip_orders", ORDERS_SQL)
def csv_roundtrip_orders(spark: SparkSession, folder: str) -> DataFrame:
    path = _write_csv(load(spark, folder, "orders", *ORDER_TEXTS))
    return _orders_back(open_table(spark, path, format="delimited"))


@register(
    "csv_late_wide",
    "SELECT CAST(o_orderkey AS VARCHAR) AS order_key, o_orderstatus AS status, "
    "CASE WHEN o_orderkey % 500 = 0 THEN o_orderpriority END AS late FROM orders",
)
def csv_late_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Records that turn out wider than the first ones, with default options."""
    path = scratch_folder(spark)
    late = "IF(o_orderkey % 500 = 0, concat(',', o_orderpriority), '')"
    line = f"concat(o_orderkey, ',', o_orderstatus, {late}) AS value"
    load(spark, folder, "orders", line).write.text(path)
    names = open_table(spark, path, format="delimited", options=DelimitedOptions(header="none")).named()
    return names.selectExpr("column_1 AS order_key", "column_2 AS status", "column_3 AS late")


@register("csv_pipe_custom", ORDERS_SQL)
def csv_pipe_custom(spark: SparkSession, folder: str) -> DataFrame:
    path = _write_csv(load(spark, folder, "orders", *ORDER_TEXTS), sep="^")
    options = DelimitedOptions(delimiter="custom", custom_delimiter="^")
    return _orders_back(open_delimited(spark, path, options))


@register(
    "csv_semicolon_locale",
    "SELECT o_orderkey, o_totalprice AS amount, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS status FROM orders",
)
def csv_semicolon_locale(spark: SparkSession, folder: str) -> DataFrame:
    df = load(
        spark, folder, "orders", "o_orderkey",
        "translate(format_number(o_totalprice, 2), ',.', '.,') AS amount",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'NA' ELSE o_orderstatus END AS status",
    )
    options = DelimitedOptions(
        delimiter="semicolon", null_tokens=("NA",), decimal_separator="comma", thousands_separator="dot"
    )
    source = open_delimited(spark, _write_csv(df, sep=";"), options)
    return source.df.selectExpr("CAST(c0.text AS BIGINT) AS o_orderkey", "c1.num AS amount", "c2.text AS status")


@register("csv_skip_rows", "SELECT o_orderkey, o_orderstatus FROM orders")
def csv_skip_rows(spark: SparkSession, folder: str) -> DataFrame:
    df = load(spark, folder, "orders").repartition(4)
    path = _write_lines(df, "concat(o_orderkey, ';', o_orderstatus)", ("Report; of, orders", "", "key;status"))
    source = open_delimited(spark, path, DelimitedOptions(skip_rows=2))
    return source.df.selectExpr("CAST(c0 AS BIGINT) AS o_orderkey", "c1 AS o_orderstatus")


@register("csv_skip_rows_latin1", "SELECT c_custkey, CONCAT('Zürich ', c_name) AS label FROM customer")
def csv_skip_rows_latin1(spark: SparkSession, folder: str) -> DataFrame:
    df = load(spark, folder, "customer", "c_custkey AS key", "concat('Zürich ', c_name) AS label")
    path = _write_csv(df, encoding="ISO-8859-1")
    options = DelimitedOptions(skip_rows=1, header="none", encoding="latin1")
    source = open_delimited(spark, path, options)
    return source.df.selectExpr("CAST(c0 AS BIGINT) AS c_custkey", "c1 AS label")


@register(
    "csv_null_tokens",
    "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN NULL ELSE p_name END AS name FROM part",
)
def csv_null_tokens(spark: SparkSession, folder: str) -> DataFrame:
    df = load(
        spark, folder, "part", "p_partkey",
        "CASE WHEN p_size % 3 = 0 THEN 'NULL' WHEN p_size % 3 = 1 THEN '-' ELSE p_name END AS name",
    )
    source = open_delimited(spark, _write_csv(df), DelimitedOptions(null_tokens=("NULL", "-")))
    return source.df.selectExpr("CAST(c0 AS BIGINT) AS p_partkey", "c1 AS name")


@register("csv_headerless", "SELECT CAST(n_nationkey AS VARCHAR) AS column_1, n_name AS column_2 FROM nation")
def csv_headerless(spark: SparkSession, folder: str) -> DataFrame:
    path = _write_csv(load(spark, folder, "nation", "n_nationkey", "n_name"), header="false", sep="|")
    return open_delimited(spark, path, DelimitedOptions(delimiter="pipe", header="none")).named()


@register("csv_latin1", "SELECT c_custkey, CONCAT('André ', c_name) AS label FROM customer")
def csv_latin1(spark: SparkSession, folder: str) -> DataFrame:
    df = load(spark, folder, "customer", "c_custkey", "concat('André ', c_name) AS label")
    source = open_delimited(spark, _write_csv(df, encoding="ISO-8859-1"), DelimitedOptions(encoding="latin1"))
    return source.df.selectExpr("CAST(c0 AS BIGINT) AS c_custkey", "c1 AS label")


@register("csv_utf16", "SELECT c_custkey, CONCAT('İstanbul ', c_name) AS label FROM customer")
def csv_utf16(spark: SparkSession, folder: str) -> DataFrame:
    df = load(spark, folder, "customer", "c_custkey", "concat('İstanbul ', c_name) AS label")
    source = open_delimited(spark, _write_csv(df, encoding="UTF-16LE"), DelimitedOptions(encoding="utf16le"))
    return source.df.selectExpr("CAST(c0 AS BIGINT) AS c_custkey", "c1 AS label")


@register("csv_quotes", "SELECT p_partkey, CONCAT('\"', p_name, '\", ', p_brand) AS label FROM part")
def csv_quotes(spark: SparkSession, folder: str) -> DataFrame:
    df = load(spark, folder, "part", "p_partkey", "concat('\"', p_name, '\", ', p_brand) AS label")
    source = open_delimited(spark, _write_csv(df))
    return source.df.selectExpr("CAST(c0 AS BIGINT) AS p_partkey", "c1 AS label")


@register("csv_multiline_conversations", "SELECT conv_id, turn, text FROM conversations")
def csv_multiline_conversations(spark: SparkSession, folder: str) -> DataFrame:
    path = _write_csv(load(spark, folder, "conversations", "conv_id", "turn", "text"), quoteAll="true")
    source = open_delimited(spark, path, DelimitedOptions(delimiter="comma"), multi_line=True)
    return source.df.selectExpr("CAST(c0 AS BIGINT) AS conv_id", "CAST(c1 AS BIGINT) AS turn", "c2 AS text")


TURNS_SQL = "SELECT conv_id, turn, role, text FROM conversations"


def _turns_back(source: Table) -> DataFrame:
    return source.named().selectExpr("CAST(conv_id AS BIGINT) AS conv_id", "CAST(turn AS BIGINT) AS turn", "role", "text")


@register("csv_multiline_default", TURNS_SQL)
def csv_multiline_default(spark: SparkSession, folder: str) -> DataFrame:
    """Quoted line breaks with default options, in files that are read in many splits."""
    path = _write_csv(load(spark, folder, "conversations", "conv_id", "turn", "role", "text"))
    return _turns_back(open_delimited(spark, path, DelimitedOptions(delimiter="comma")))


@register("csv_skip_multiline", TURNS_SQL)
def csv_skip_multiline(spark: SparkSession, folder: str) -> DataFrame:
    """Quoted line breaks behind skipped lines, one of which holds a lone quote."""
    quoted = "concat('\"', replace(text, '\"', '\"\"'), '\"')"
    line = f"concat_ws(',', conv_id, turn, role, {quoted})"
    first = ('An export, "unfinished', "", "conv_id,turn,role,text")
    path = _write_lines(load(spark, folder, "conversations").repartition(3), line, first)
    return _turns_back(open_delimited(spark, path, DelimitedOptions(delimiter="comma", skip_rows=2)))


@register(
    "csv_mixed_headers",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN o_orderstatus END AS status, "
    "CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS priority FROM orders",
)
def csv_mixed_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Files of one folder whose headers differ in order and names."""
    target = scratch_folder(spark)
    layouts = (
        ("o_orderkey AS key", "o_orderstatus AS status"),
        ("o_orderpriority AS priority", "o_orderstatus AS status", "o_orderkey AS key"),
        ("o_orderpriority AS priority", "o_orderkey AS key"),
    )
    for number, columns in enumerate(layouts):
        df = load(spark, folder, "orders").where(f"o_orderkey % 3 = {number}").selectExpr(*columns)
        _write_csv(df, f"{target}/written-{number}")
    source = open_delimited(spark, target, DelimitedOptions(delimiter="comma"))
    return source.named().selectExpr("CAST(key AS BIGINT) AS o_orderkey", "status", "priority")


@register(
    "csv_record_cap",
    "SELECT CAST(max(strlen(CAST(conv_id AS VARCHAR)) + strlen(text) + 3) AS BIGINT) AS longest, TRUE AS rejected, FALSE AS rejected_at_longest FROM conversations",
)
def csv_record_cap(spark: SparkSession, folder: str) -> DataFrame:
    """The cap on record bytes, before anything is decoded: the longest record passes, one byte less fails."""
    df = load(spark, folder, "conversations")
    path = scratch_folder(spark)
    df.selectExpr("concat(conv_id, ',\"', replace(text, '\"', '\"\"'), '\"') AS value").write.text(path)
    longest = df.selectExpr("max(octet_length(CAST(conv_id AS STRING)) + octet_length(replace(text, '\"', '\"\"')) + 3) AS n").first()["n"]
    options, rejected = DelimitedOptions(delimiter="comma", header="none"), []
    for cap in (longest - 1, longest):
        try:
            open_delimited(spark, path, options, max_record_bytes=cap)
            rejected.append(False)
        except ValueError:
            rejected.append(True)
    return df.selectExpr(
        "CAST(max(octet_length(CAST(conv_id AS STRING)) + octet_length(text) + 3) AS BIGINT) AS longest",
        f"{rejected[0]} AS rejected", f"{rejected[1]} AS rejected_at_longest",
    )


@register(
    "csv_ragged",
    "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS status, "
    "CASE WHEN o_orderkey % 3 = 2 THEN o_orderpriority END AS extra, CAST(3 AS BIGINT) AS width FROM orders",
)
def csv_ragged(spark: SparkSession, folder: str) -> DataFrame:
    line = (
        "concat_ws(',', o_orderkey, IF(o_orderkey % 3 > 0, o_orderstatus, NULL), "
        "IF(o_orderkey % 3 = 2, o_orderpriority, NULL))"
    )
    path = _write_lines(load(spark, folder, "orders"), line, ("key,status",))
    source = open_delimited(spark, path, DelimitedOptions(delimiter="comma"), widen="full")
    return source.df.selectExpr(
        "CAST(c0 AS BIGINT) AS key", "c1 AS status", "c2 AS extra", f"CAST({source.width} AS BIGINT) AS width"
    )


@register(
    "csv_profile_orders",
    "SELECT 'o_orderkey' AS name, 'number' AS type, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS distinct_values, "
    "round(avg(CAST(o_orderkey AS DOUBLE)), 4) AS mean, median(o_orderkey) AS median FROM orders UNION ALL "
    "SELECT 'o_orderstatus', 'text', count(DISTINCT o_orderstatus), NULL, NULL FROM orders UNION ALL "
    "SELECT 'o_totalprice', 'number', count(DISTINCT o_totalprice), round(avg(o_totalprice), 4), median(o_totalprice) FROM orders UNION ALL "
    "SELECT 'o_orderpriority', 'text', count(DISTINCT o_orderpriority), NULL, NULL FROM orders",
)
def csv_profile_orders(spark: SparkSession, folder: str) -> DataFrame:
    path = _write_csv(load(spark, folder, "orders", *ORDER_TEXTS))
    found = profile_table(open_table(spark, path, format="delimited"), metrics={"distinct", "median"})
    return found.profiles.selectExpr("name", "type", "distinct AS distinct_values", *rounded("mean"), "median")


@register(
    "detect_delimiters",
    "SELECT * FROM (VALUES (','), (';'), (chr(9)), ('|')) AS v(detected)",
)
def detect_written_delimiters(spark: SparkSession, folder: str) -> DataFrame:
    target = scratch_folder(spark)
    for number, separator in enumerate((",", ";", "\t", "|")):
        df = load(spark, folder, "orders", *ORDER_TEXTS)
        _write_csv(df, f"{target}/written-{number}", sep=separator)
    return detect_delimiters(spark, target).select("detected").distinct()


# -- display, export and metadata ---------------------------------------------------------------


@register(
    "tsv_export",
    "SELECT CONCAT(CAST(conv_id AS VARCHAR), chr(9), CAST(turn AS VARCHAR), chr(9), role, chr(9), "
    "CASE WHEN regexp_matches(text, '[\\t\\r\\n\"]') THEN CONCAT('\"', replace(text, '\"', '\"\"'), '\"') ELSE text END) AS value FROM conversations",
)
def tsv_export(spark: SparkSession, folder: str) -> DataFrame:
    return tsv_rows(table(spark, folder, "conversations")).select("value")


@register(
    "tsv_long_texts",
    "SELECT CONCAT(CAST(doc_id AS VARCHAR), chr(9), "
    "CASE WHEN regexp_matches(text, '[\\t\\r\\n\"]') THEN CONCAT('\"', replace(text, '\"', '\"\"'), '\"') ELSE text END) AS value FROM documents",
)
def tsv_long_texts(spark: SparkSession, folder: str) -> DataFrame:
    return tsv_rows(Table.from_dataframe(load(spark, folder, "documents", "doc_id", "text"))).select("value")


@register("tsv_file_orders", "SELECT CONCAT(CAST(o_orderkey AS VARCHAR), chr(9), o_orderpriority) AS value FROM orders UNION ALL SELECT CONCAT('o_orderkey', chr(9), 'o_orderpriority')")
def tsv_file_orders(spark: SparkSession, folder: str) -> DataFrame:
    target = scratch_folder(spark)
    df = load(spark, folder, "orders", "o_orderkey", "o_orderpriority", "o_orderkey AS _row_index")
    write_tsv(Table.from_dataframe(df, order=["_row_index"]), target, header=True)
    return spark.read.text(target)


@register("value_text_acctbal", "SELECT regexp_replace(CAST(c_acctbal AS VARCHAR), '\\.0$', '') AS value FROM customer")
def value_text_acctbal(spark: SparkSession, folder: str) -> DataFrame:
    return value_text(table(spark, folder, "customer"), 3).select("value")


@register(
    "display_render",
    "SELECT format('{:,}', o_orderkey) AS o_orderkey, regexp_replace(format('{:,.2f}', o_totalprice), '\\.?0+$', '') AS o_totalprice, "
    "o_orderstatus, strftime(o_orderdate, '%b %d, %Y, %H:%M:%S UTC') AS o_orderdate FROM orders",
)
def display_render(spark: SparkSession, folder: str) -> DataFrame:
    source = _from(spark, folder, "orders", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate")
    return render_columns(source, ["number", "number", "text", "date"])


@register(
    "column_search",
    "SELECT table_name AS table_, column_name AS column_, CAST(CASE WHEN lower(column_name) = 'text' THEN 0 "
    "WHEN starts_with(lower(column_name), 'text') THEN 1 ELSE 2 END AS INTEGER) AS rank_ FROM information_schema.columns "
    f"WHERE contains(lower(column_name), 'text') AND table_name IN ({', '.join(repr(t) for t in TABLES)})",
)
def column_search(spark: SparkSession, folder: str) -> DataFrame:
    listing = column_listing(spark, {name: load(spark, folder, name) for name in TABLES})
    return search_columns(listing, "Text").selectExpr("table AS table_", "column AS column_", "rank AS rank_")


@register(
    "truncated_cells",
    f"SELECT CAST(count(*) AS BIGINT) AS cells FROM documents WHERE 10 * ({_UNITS.replace('@', 'text')}) > 100000",
)
def truncated_cells(spark: SparkSession, folder: str) -> DataFrame:
    return count_cut_cells(_from(spark, folder, "documents", "doc_id", "repeat(text, 10) AS text"))


@register(
    "value_types_events",
    "SELECT event_type, CAST(count(*) AS BIGINT) AS numbers FROM events GROUP BY event_type",
)
def value_types_events(spark: SparkSession, folder: str) -> DataFrame:
    df = load(spark, folder, "events", "event_type", "CAST(value AS STRING) AS value")
    staged = stage(df)
    kind = staged.cells[1].vtype
    return staged.df.groupBy(quoted("event_type")).agg(F.expr(f"count_if({kind} = 'number')").alias("numbers"))


# -- audits and workbooks -----------------------------------------------------------------------


@register(
    "footer_audit",
    " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, CAST(count(*) AS BIGINT) AS rows_total, 'accepted' AS verdict FROM {name}" for name in TABLES
    ),
)
def footer_audit_tables(spark: SparkSession, folder: str) -> DataFrame:
    audit = footer_audit(spark, folder, 2**62)
    return audit.selectExpr(
        "regexp_extract(path, '([a-z]+)[.]parquet', 1) AS table_name", "rows AS rows_total", "verdict"
    )


@register(
    "scan_budget",
    "SELECT CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, sum(strlen(text) + 1) <= 1073741824 AS within_default "
    "FROM (SELECT replace(text, chr(10), ' ') AS text FROM documents)",
)
def scan_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of a source, known from its files alone, here lines of text."""
    path = scratch_folder(spark)
    load(spark, folder, "documents", "translate(text, chr(10), ' ') AS value").write.text(path)
    size = source_bytes(spark, path)
    return spark.createDataFrame([(size, size <= 1024**3)], "bytes bigint, within_default boolean")


def _write_workbooks(df: DataFrame, sheet: str, rows_per_file: int = 5000) -> str:
    """Write a table as workbooks of a few thousand rows, one or more per partition."""
    target = scratch_folder(df.sparkSession)
    names = df.columns

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re
        import uuid as ids
        import zipfile
        from xml.sax.saxutils import escape

        from pyarrow import fs

        local = re.sub(r"^file:/*", "/", target)
        system, base = (
            (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(local)
        )
        system.create_dir(base, recursive=True)
        for batch in batches:
            for start in range(0, len(batch), rows_per_file):
                body = []
                records = [tuple(names), *batch[start : start + rows_per_file].itertuples(index=False)]
                for number, record in enumerate(records, 1):
                    cells = "".join(
                        f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
                        if isinstance(v, str) else f"<c><v>{v}</v></c>"
                        for v in record
                    )
                    body.append(f'<row r="{number}">{cells}</row>')
                path = f"{base}/{ids.uuid4().hex}.xlsx"
                with system.open_output_stream(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(
                        "xl/workbook.xml",
                        '<workbook xmlns:r="r"><sheets>'
                        f'<sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
                    )
                    z.writestr(
                        "xl/_rels/workbook.xml.rels",
                        '<Relationships><Relationship Id="rId1" Type="t/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
                    )
                    z.writestr(
                        "xl/worksheets/sheet1.xml",
                        f"<worksheet><sheetData>{''.join(body)}</sheetData></worksheet>",
                    )
                yield pd.DataFrame({"path": [path]})

    df.mapInPandas(write, "path string").write.format("noop").mode("overwrite").save()
    return target


@register("workbook_scan", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def workbook_scan(spark: SparkSession, folder: str) -> DataFrame:
    path = _write_workbooks(load(spark, folder, "customer", "c_custkey", "c_name", "c_acctbal"), "Customers")
    return workbook_rows(spark, path).where("row_no > 1").selectExpr(
        "CAST(cells[0].num AS BIGINT) AS c_custkey", "cells[1].text AS c_name", "cells[2].num AS c_acctbal"
    )


@register(
    "workbook_sheets",
    "SELECT 'Parts & more' AS sheet, CAST(count(*) AS BIGINT) AS data_rows, CAST(3 AS INTEGER) AS column_count FROM part",
)
def workbook_sheets(spark: SparkSession, folder: str) -> DataFrame:
    path = _write_workbooks(load(spark, folder, "part", "p_partkey", "p_name", "p_retailprice"), "Parts & more")
    return list_sheets(workbook_rows(spark, path)).groupBy("sheet").agg(
        F.expr("sum(rows - 1)").alias("data_rows"), F.expr("max(columns)").alias("column_count")
    )


@register("archive_audit", "SELECT 'accepted' AS verdict, CAST(3 AS BIGINT) AS entries")
def archive_audit_parts(spark: SparkSession, folder: str) -> DataFrame:
    path = _write_workbooks(load(spark, folder, "part", "p_partkey", "p_name"), "Parts")
    return archive_audit(spark, path).select("verdict", "entries").distinct()


# -- streams ------------------------------------------------------------------------------------


def _event_stream(spark: SparkSession, folder: str, *expressions: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/events.parq*").selectExpr(*expressions)


def _last_snapshot(result: DataFrame) -> DataFrame:
    """Run a stream over what is there and return the result after its last batch."""
    spark = result.sparkSession
    target = scratch_folder(spark)

    def keep(snapshot: DataFrame, batch: int) -> None:
        snapshot.write.mode("overwrite").parquet(f"{target}/batch={batch}")

    query = (
        result.writeStream.outputMode("complete").foreachBatch(keep)
        .option("checkpointLocation", f"{target}-state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    snapshots = spark.read.parquet(target)
    last = snapshots.agg(F.max("batch").alias("batch"))
    return snapshots.join(F.broadcast(last), "batch").drop("batch")


STREAMED = ["event_type", "value", "ts", "CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id END AS user_id"]


@register(
    "stream_profile_events",
    "WITH t AS (SELECT event_type, value, ts, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id END AS user_id FROM events) "
    "SELECT 'event_type' AS name, 'text' AS type, CAST(0 AS BIGINT) AS missing, CAST(count(*) AS BIGINT) AS non_null, NULL::DOUBLE AS min_number, "
    "NULL::DOUBLE AS max_number, NULL::DOUBLE AS mean, NULL::DOUBLE AS std_dev, NULL AS min_text, CAST(max(length(event_type)) AS BIGINT) AS max_length FROM t UNION ALL "
    "SELECT 'value', 'number', 0, count(value), min(value), max(value), round(avg(value), 4), round(stddev_pop(value), 4), NULL, NULL FROM t UNION ALL "
    "SELECT 'ts', 'date', 0, count(ts), NULL, NULL, NULL, NULL, strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%gZ'), NULL FROM t UNION ALL "
    "SELECT 'user_id', 'number', count(*) - count(user_id), count(user_id), min(user_id), max(user_id), round(avg(CAST(user_id AS DOUBLE)), 4), "
    "round(stddev_pop(CAST(user_id AS DOUBLE)), 4), NULL, NULL FROM t",
)
def stream_profile_events(spark: SparkSession, folder: str) -> DataFrame:
    found = _last_snapshot(stream_profile(_event_stream(spark, folder, *STREAMED)))
    return found.selectExpr(
        "name", "type", "missing", "non_null", "min_number", "max_number", *rounded("mean", "std_dev"),
        "min_text", "max_length",
    )


def _bins_sql(table: str, column: str) -> str:
    """Edges of the 12 bins of a column and the share of rows below the end of each."""
    return (
        f"WITH s AS (SELECT min({column}) AS low, max({column}) AS high, count({column}) AS n FROM {table}), "
        "e AS (SELECT low, high, n, CAST(i AS BIGINT) AS position, low + (high - low) / 12 * i AS edge FROM s, range(1, 13) AS r(i)) "
        f"SELECT position, round(edge, 6) AS edge, n AS total, true AS close FROM e"
    )


@register("stream_histogram_events", _bins_sql("events", "value"))
def stream_histogram_events(spark: SparkSession, folder: str) -> DataFrame:
    """Bins of the running profile; ``close`` where the rows up to an edge are within 2 % of all rows."""
    running = _last_snapshot(stream_profile(_event_stream(spark, folder, "value")))
    bins = running.selectExpr(
        "non_null", "aggregate(histogram, 0L, (a, b) -> a + b.count) AS total", "posexplode(histogram) AS (i, bin)", "histogram",
    ).selectExpr(
        "CAST(i + 1 AS BIGINT) AS position", "bin.end AS edge", "total",
        "aggregate(slice(histogram, 1, i + 1), 0L, (a, b) -> a + b.count) AS below",
    )
    events = load(spark, folder, "events", "value")
    counted = events.join(F.broadcast(bins.select("position", "edge")), F.col("value") < F.col("edge"))
    exact = counted.groupBy("position").agg(F.count("*").alias("exact"))
    return bins.join(exact, "position", "left").selectExpr(
        "position", "round(edge, 6) AS edge", "total",
        "abs(below - IF(position = 12, total, coalesce(exact, 0))) <= 0.02 * total AS close",
    )


SPELLED_TS = (
    "CASE WHEN user_id % 2 = 0 THEN date_format(ts, 'yyyy-MM-dd') "
    "ELSE concat(date_format(ts, 'yyyy-MM-dd'), 'T', date_format(ts, 'HH:mm:ss'), 'Z') END AS spelled"
)


@register(
    "stream_dates_text",
    "WITH t AS (SELECT CASE WHEN user_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS spelled, "
    "CASE WHEN user_id % 2 = 0 THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END AS moment FROM events) "
    "SELECT 'spelled' AS name, 'date' AS type, CAST(count(*) AS BIGINT) AS non_null, "
    "(SELECT spelled FROM t ORDER BY moment, spelled LIMIT 1) AS min_text, "
    "(SELECT spelled FROM t ORDER BY moment DESC, spelled DESC LIMIT 1) AS max_text FROM t",
)
def stream_dates_text(spark: SparkSession, folder: str) -> DataFrame:
    found = _last_snapshot(stream_profile(_event_stream(spark, folder, SPELLED_TS)))
    return found.select("name", "type", "non_null", "min_text", "max_text")


@register("stream_logged_top_events", _top_sql("events", ["event_type", "user_id"]))
def stream_logged_top_events(spark: SparkSession, folder: str) -> DataFrame:
    """Top values from the log of changed counts."""
    log = scratch_folder(spark)
    log_frequencies(_event_stream(spark, folder, "event_type", "user_id"), log, f"{log}-state").awaitTermination()
    return top_of_frequencies(logged_frequencies(spark, log)).selectExpr(
        "element_at(array('event_type', 'user_id'), column_index + 1) AS name",
        "CAST(position AS BIGINT) AS position", "value", "cnt AS frequency",
    )


@register("stream_top_events", _top_sql("events", ["event_type", "user_id"]))
def stream_top_events(spark: SparkSession, folder: str) -> DataFrame:
    stream = _event_stream(spark, folder, "event_type", "user_id")
    top = top_of_frequencies(_last_snapshot(stream_frequencies(stream)))
    return top.selectExpr(
        "element_at(array('event_type', 'user_id'), column_index + 1) AS name",
        "CAST(position AS BIGINT) AS position", "value", "cnt AS frequency",
    )


@register(
    "stream_top_sketch_events",
    "SELECT 'event_type' AS name, event_type AS value, CAST(count(*) AS BIGINT) AS frequency FROM events GROUP BY event_type ORDER BY count(*) DESC LIMIT 5",
)
def stream_top_sketch_events(spark: SparkSession, folder: str) -> DataFrame:
    found = _last_snapshot(stream_top_values(_event_stream(spark, folder, "event_type")))
    return found.selectExpr("name", "value", "count AS frequency")


STREAM_RULED = [
    "'one' AS same",
    "CASE WHEN user_id % 2 = 0 THEN NULL ELSE event_type END AS gaps",
    "CASE WHEN user_id % 3 = 0 THEN CAST(user_id AS STRING) ELSE event_type END AS mixed",
]


@register(
    "stream_warnings_events",
    _rules_sql(
        "SELECT " + ", ".join(STREAM_RULED).replace("STRING", "VARCHAR") + " FROM events",
        {"same": "text", "gaps": "text", "mixed": "mixed"},
    ),
)
def stream_warnings_events(spark: SparkSession, folder: str) -> DataFrame:
    target = scratch_folder(spark)

    def keep(warnings: DataFrame, batch: int) -> None:
        warnings.write.mode("overwrite").parquet(f"{target}/batch={batch}")

    running = stream_profile(_event_stream(spark, folder, *STREAM_RULED))
    on_warnings(running, keep, f"{target}-state").awaitTermination()
    found = spark.read.parquet(target)
    last = found.agg(F.max("batch").alias("batch"))
    return found.join(F.broadcast(last), "batch").select("name", "code", "message")


# -- headers, options, saved views --------------------------------------------------------------


@register(
    "csv_header_names",
    " UNION ALL ".join(
        f"SELECT '{name}' AS name, CAST(count(*) AS BIGINT) AS non_null, CAST(count(DISTINCT {column}) AS BIGINT) AS values_seen FROM orders"
        for name, column in (("id", "o_orderkey"), ("column_2", "o_custkey"), ("id_2", "o_orderstatus"), ("id_3", "o_orderpriority"))
    ),
)
def csv_header_names(spark: SparkSession, folder: str) -> DataFrame:
    """Blank and repeated headers get names of their own."""
    value = "concat_ws(',', o_orderkey, o_custkey, o_orderstatus, o_orderpriority)"
    path = _write_lines(load(spark, folder, "orders").repartition(4), value, ("id,,id, id ",))
    source = open_delimited(spark, path, DelimitedOptions())
    found = profile(source.df, source.fields, source.columns, metrics={"distinct"})
    return found.profiles.selectExpr("name", "non_null", "distinct AS values_seen")


@register(
    "csv_parsing_metadata",
    "SELECT 'auto' AS chosen, ';' AS detected, ';' AS resolved, CAST(2 AS BIGINT) AS width, CAST(count(*) AS BIGINT) AS n_rows FROM orders "
    "UNION ALL SELECT 'pipe', ';', '|', 1, count(*) FROM orders",
)
def csv_parsing_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """What was detected, what was used, and the table that came of it."""
    path = _write_csv(load(spark, folder, "orders", "o_orderkey", "o_orderstatus"), sep=";")
    parts = []
    for chosen in ("auto", "pipe"):
        source = open_delimited(spark, path, DelimitedOptions(delimiter=chosen))
        known = source.parsing
        parts.append(source.df.agg(F.count("*").alias("n_rows")).select(
            F.lit(known.applied.delimiter).alias("chosen"), F.lit(known.detected_delimiter).alias("detected"),
            F.lit(known.resolved_delimiter).alias("resolved"), F.lit(len(source.columns)).cast("long").alias("width"), "n_rows",
        ))
    return functools.reduce(DataFrame.unionAll, parts)


HEAD_NUMBERS = ("l_orderkey", "l_quantity", "l_extendedprice", "l_discount")


@register(
    "preview_profile_lineitem",
    "WITH h AS (SELECT * FROM lineitem LIMIT 150), n AS (SELECT CAST(count(*) AS BIGINT) AS total_rows FROM lineitem) "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS name, CAST(count({name}) AS BIGINT) AS non_null, CAST(min({name}) AS DOUBLE) AS min_number, "
        f"CAST(max({name}) AS DOUBLE) AS max_number, CAST(count(DISTINCT {name}) AS BIGINT) AS values_seen, any_value(total_rows) AS total_rows FROM h, n"
        for name in HEAD_NUMBERS
    ),
)
def preview_profile_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """Profile of the first rows and columns; the number of all rows comes with it."""
    found = preview(table(spark, folder, "lineitem"), Limits(preview_rows=150, max_columns=10))
    return found.profile.profiles.where(F.col("name").isin(*HEAD_NUMBERS)).selectExpr(
        "name", "non_null", "min_number", "max_number", "distinct AS values_seen", f"{found.total_rows}L AS total_rows"
    )


@register(
    "top_values_shown_texts",
    "SELECT 'text' AS name, position, value, frequency FROM (SELECT "
    f"CASE WHEN length(text) > {MAX_DISPLAY_UNITS} THEN substr(text, 1, {MAX_DISPLAY_UNITS - len(CUT_MARKER)}) || '{CUT_MARKER}' ELSE text END AS value, "
    "CAST(count(*) AS BIGINT) AS frequency, CAST(row_number() OVER (ORDER BY count(*) DESC, text) AS BIGINT) AS position "
    "FROM documents WHERE text <> '' GROUP BY text) WHERE position <= 5",
)
def top_values_shown_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts are counted, short forms are shown."""
    return _top_values(profile(load(spark, folder, "documents", "text"), metrics={"top_values"}).profiles)


SAVED_VIEWS = (
    {
        "filters": [
            {"id": "a", "columnIndex": 3, "operator": "between", "value": "1000", "secondValue": "50000.5"},
            {"id": "b", "columnIndex": 99, "operator": "equals", "value": "x"},
        ],
        "sort": {"columnIndex": 3, "direction": "desc"},
    },
    {
        "query": " f ",
        "filters": [{"id": "c", "columnIndex": 2, "operator": "greaterThan", "value": "5"}, {"id": "", "columnIndex": 0}],
        "sort": {"columnIndex": 0, "direction": "up"},
    },
    {"filters": "none"},
)
SAVED_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@register(
    "saved_views_orders",
    "SELECT 'o_totalprice: Between 1000 and 50000.5; Sort: o_totalprice desc' AS described, CAST(count(*) AS BIGINT) AS n_rows, "
    "CAST(coalesce(sum(o_orderkey), 0) AS BIGINT) AS key_sum FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000.5 "
    "UNION ALL SELECT 'Search: f', count(*), coalesce(sum(o_orderkey), 0) FROM orders WHERE lower(o_orderstatus) LIKE '%f%' "
    "UNION ALL SELECT '', count(*), sum(o_orderkey) FROM orders",
)
def saved_views_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Views restored from saved records against the profiled columns; what does not fit is dropped."""
    df = load(spark, folder, "orders", *SAVED_COLUMNS)
    source, types = Table.from_dataframe(df), profile(df, metrics=()).types
    parts = []
    for saved in SAVED_VIEWS:
        spec = ViewSpec.from_dict(saved, types)
        parts.append(apply_view(source, spec, types).df.agg(F.count("*").alias("n_rows"), F.sum("c0").alias("sum")).select(
            F.lit(spec.describe(source.columns)).alias("described"), "n_rows",
            F.coalesce("sum", F.lit(0)).cast("long").alias("key_sum"),
        ))
    return functools.reduce(DataFrame.unionAll, parts)


@register(
    "filter_errors_orders",
    " UNION ALL ".join(
        f"SELECT '{name}' AS name, '{message}' AS message, CAST({operators} AS BIGINT) AS operators, CAST(0 AS BIGINT) AS kept, CAST(count(*) AS BIGINT) AS n_rows FROM orders"
        for name, message, operators in (
            ("o_orderkey", "Enter a valid number.", 9),
            ("o_orderstatus", "This operator is not available for the column type.", 8),
            ("o_orderdate", "Enter a valid date.", 9),
        )
    ),
)
def filter_errors_orders(spark: SparkSession, folder: str) -> DataFrame:
    """A filter that fits no column: why it is refused, and that it keeps no row where it is applied."""
    df = load(spark, folder, "orders", "o_orderkey", "o_orderstatus", "o_orderdate")
    types, staged = profile(df, metrics=()).types, stage(df)
    parts = []
    for cell, name, kind in zip(staged.cells, df.columns, types, strict=True):
        wrong = Filter(cell.index, "greaterThan", "many")
        rows = staged.df.agg(
            F.expr(f"count_if({filter_predicate(wrong, cell, kind)})").alias("kept"), F.count("*").alias("n_rows")
        )
        parts.append(rows.select(
            F.lit(name).alias("name"), F.lit(wrong.error(kind)).alias("message"),
            F.lit(len(operators_for_type(kind))).cast("long").alias("operators"), "kept", "n_rows",
        ))
    return functools.reduce(DataFrame.unionAll, parts)


@register(
    "sort_toggled_orders",
    "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS place FROM orders",
)
def sort_toggled_orders(spark: SparkSession, folder: str) -> DataFrame:
    """A second click on a column turns its order."""
    df = load(spark, folder, "orders", "o_orderkey", "o_totalprice", "o_orderkey AS _row_index")
    spec = ViewSpec().toggle_sort(1).toggle_sort(1)
    found = apply_view(Table.from_dataframe(df, order=["_row_index"]), spec, ["number", "number"])
    return number_rows(found.df, "place").selectExpr("c0 AS o_orderkey", "place")


PART_NUMBERS = "CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus ELSE CAST(o_custkey AS {}) END"


@register(
    "sort_number_then_text",
    "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END, "
    "CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_custkey END, CASE WHEN o_orderkey % 4 = 0 THEN lower(o_orderstatus) ELSE '' END, o_orderkey) AS BIGINT) AS place FROM orders",
)
def sort_number_then_text(spark: SparkSession, folder: str) -> DataFrame:
    """Values that are no numbers follow the numbers in text order."""
    df = load(spark, folder, "orders", "o_orderkey", PART_NUMBERS.format("STRING") + " AS v", "o_orderkey AS _row_index")
    found = apply_view(Table.from_dataframe(df, order=["_row_index"]), ViewSpec(sort=Sort(1)), ["number", "number"])
    return number_rows(found.df, "place").selectExpr("c0 AS o_orderkey", "place")


RULED_TYPES = {"maybe_key": "number", "mixed": "mixed", "nothing": "empty", "gaps": "text", "l_quantity": "number", "identifier": "text"}


@register(
    "column_warnings_lineitem",
    "SELECT k.column_index, w.name, k.type, w.code FROM ("
    + _rules_sql(f"SELECT {', '.join(RULED)} FROM lineitem", RULED_TYPES)
    + ") w JOIN (VALUES " + ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(RULED_TYPES.items()))
    + ") k(column_index, name, type) ON k.name = w.name",
)
def column_warnings_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    found = profile(load(spark, folder, "lineitem", *RULED), metrics={"distinct"})
    return column_warnings(found).select("column_index", "name", "type", "code")
