"""Filter, search and sort over complete tables.

Filters follow the column type found by a profile. On typed columns they compile to comparisons
of the raw column with a literal, so that they reach the Parquet scan; the literal is parsed once,
here. Sorting is total and stable: nulls last in both directions, ties in source order.
"""

from __future__ import annotations

import datetime as dt
import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal, localcontext
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.functions.cells import TIME_TYPES, Cell, is_cell_type, stage
from colscope.functions.numbers import MAX_DOUBLE
from colscope.functions.text import BLANKS, literal
from colscope.session import scratch_folder
from colscope.sources.table import Table

# Operators by column type, their labels, limits and messages.
TEXT_OPERATORS = (
    "contains", "notContains", "equals", "notEquals", "startsWith", "endsWith",
    "isEmpty", "isNotEmpty",
)
ORDERED_OPERATORS = (
    "equals", "notEquals", "greaterThan", "greaterThanOrEqual", "lessThan", "lessThanOrEqual",
    "between", "isEmpty", "isNotEmpty",
)
BOOLEAN_OPERATORS = ("isTrue", "isFalse", "isEmpty", "isNotEmpty")
OPERATOR_LABELS = {
    "contains": "Contains",
    "notContains": "Does not contain",
    "equals": "Equals",
    "notEquals": "Does not equal",
    "startsWith": "Starts with",
    "endsWith": "Ends with",
    "greaterThan": "Greater than",
    "greaterThanOrEqual": "Greater than or equal",
    "lessThan": "Less than",
    "lessThanOrEqual": "Less than or equal",
    "between": "Between",
    "isTrue": "Is true",
    "isFalse": "Is false",
    "isEmpty": "Is empty",
    "isNotEmpty": "Is not empty",
}
MAX_QUERY_LENGTH = 2000
MAX_FILTERS = 100
MAX_FILTER_VALUE_LENGTH = 2000
MAX_FILTER_ID_LENGTH = 128
TOO_LONG = "Filter values are limited to 2,000 characters."

LENGTH_DIGITS = 10
"""Digits of the length that precedes a number within a sort key; no text is longer."""
ISO_DATE = re.compile(
    r"([0-9]{4})(?:-([0-9]{2})(?:-([0-9]{2}))?)?"
    r"(?:[T ]([0-9]{2}):([0-9]{2})(?::([0-9]{2})(?:[.]([0-9]+))?)?"
    r"(Z|[+-][0-9]{2}:?[0-9]{2})?)?"
)


def operators_for_type(column_type: str) -> tuple[str, ...]:
    if column_type in ("number", "date"):
        return ORDERED_OPERATORS
    return BOOLEAN_OPERATORS if column_type == "boolean" else TEXT_OPERATORS


def needs_value(operator: str) -> bool:
    return operator not in BOOLEAN_OPERATORS


# -- literals -----------------------------------------------------------------------------------


def parse_number(text: str | None) -> float | None:
    """A finite number from user input: decimal, or hex, octal and binary with their prefix."""
    trimmed = (text or "").strip(BLANKS)
    if re.fullmatch(r"0(?:[xX][0-9a-fA-F]+|[oO][0-7]+|[bB][01]+)", trimmed):
        return float(int(trimmed, 0))
    if re.fullmatch(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", trimmed):
        value = float(trimmed)
        return value if math.isfinite(value) else None
    return None


def parse_date(text: str | None) -> int | None:
    """Epoch milliseconds of ISO user input; input without a zone is taken as UTC."""
    match = ISO_DATE.fullmatch((text or "").strip(BLANKS))
    if not match:
        return None
    year, month, day, hour, minute, second, fraction, zone = match.groups()
    try:
        moment = dt.datetime(
            int(year), int(month or 1), int(day or 1), int(hour or 0), int(minute or 0),
            int(second or 0), tzinfo=dt.timezone.utc,
        )
    except ValueError:
        return None
    millis = (moment - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(milliseconds=1)
    millis += int(((fraction or "") + "000")[:3])
    if zone and zone != "Z":
        offset = int(zone[1:3]) * 60 + int(zone[-2:])
        millis -= (offset if zone[0] == "+" else -offset) * 60_000
    return millis


# -- the view specification ---------------------------------------------------------------------


@dataclass(frozen=True)
class Filter:
    column_index: int
    operator: str
    value: str | None = None
    second_value: str | None = None
    id: str = "filter"

    def error(self, column_type: str) -> str | None:
        """Why this filter cannot be used on a column of the given type, or ``None``."""
        index = self.column_index
        if isinstance(index, bool) or not isinstance(index, int) or index < 0:
            return "Select a valid column."
        if self.operator not in operators_for_type(column_type):
            return "This operator is not available for the column type."
        if not needs_value(self.operator):
            return None
        ranged = self.operator == "between"
        value = (self.value or "").strip(BLANKS)
        second = (self.second_value or "").strip(BLANKS)
        if not value:
            return "Enter a filter value."
        if len(value) > MAX_FILTER_VALUE_LENGTH:
            return TOO_LONG
        if ranged and not second:
            return "Enter both ends of the range."
        if ranged and len(second) > MAX_FILTER_VALUE_LENGTH:
            return TOO_LONG
        parsers = {"number": parse_number, "date": parse_date}
        if column_type in parsers:
            parse = parsers[column_type]
            if parse(value) is None:
                return f"Enter a valid {column_type}."
            if ranged and parse(second) is None:
                return f"Enter a valid {column_type} for both ends of the range."
        return None

    def describe(self, columns: Sequence[str]) -> str:
        known = self.column_index < len(columns)
        column = columns[self.column_index] if known else f"Column {self.column_index + 1}"
        text = f"{column}: {OPERATOR_LABELS[self.operator]}"
        if not needs_value(self.operator):
            return text
        text += f" {self.value or ''}"
        return f"{text} and {self.second_value or ''}" if self.operator == "between" else text

    @classmethod
    def from_dict(cls, saved: Any) -> Filter | None:
        """Restore a saved filter; anything malformed gives ``None``."""
        if not isinstance(saved, dict):
            return None
        identity, index, operator = saved.get("id"), saved.get("columnIndex"), saved.get("operator")
        if not isinstance(identity, str) or not 1 <= len(identity) <= MAX_FILTER_ID_LENGTH:
            return None
        if isinstance(index, bool) or not isinstance(index, int) or index < 0:
            return None
        if operator not in OPERATOR_LABELS:
            return None

        def clipped(key: str) -> str | None:
            value = saved.get(key)
            return value[:MAX_FILTER_VALUE_LENGTH] if isinstance(value, str) else None

        return cls(index, operator, clipped("value"), clipped("secondValue"), identity)


@dataclass(frozen=True)
class Sort:
    column_index: int
    direction: str = "asc"


@dataclass(frozen=True)
class ViewSpec:
    query: str = ""
    filters: tuple[Filter, ...] = field(default=())
    sort: Sort | None = None

    @classmethod
    def from_dict(cls, saved: Any, types: Sequence[str]) -> ViewSpec:
        """Restore a saved view against the current columns; what no longer fits is dropped."""
        if not isinstance(saved, dict):
            return cls()
        query = saved.get("query")
        kept = []
        listed = saved.get("filters")
        for entry in listed[:MAX_FILTERS] if isinstance(listed, list) else []:
            found = Filter.from_dict(entry)
            if found and found.column_index < len(types) and not found.error(types[found.column_index]):
                kept.append(found)
        sort = None
        wanted = saved.get("sort")
        if isinstance(wanted, dict):
            index, direction = wanted.get("columnIndex"), wanted.get("direction")
            valid = isinstance(index, int) and not isinstance(index, bool) and 0 <= index < len(types)
            if valid and direction in ("asc", "desc"):
                sort = Sort(index, direction)
        return cls(query[:MAX_QUERY_LENGTH] if isinstance(query, str) else "", tuple(kept), sort)

    def toggle_sort(self, column_index: int) -> ViewSpec:
        """Sort ascending by a column, or descending when it already is ascending."""
        ascending = self.sort == Sort(column_index, "asc")
        return replace(self, sort=Sort(column_index, "desc" if ascending else "asc"))

    def describe(self, columns: Sequence[str]) -> str:
        parts = [f.describe(columns) for f in self.filters]
        if self.query.strip(BLANKS):
            parts.append(f"Search: {self.query.strip(BLANKS)}")
        if self.sort:
            parts.append(f"Sort: {columns[self.sort.column_index]} {self.sort.direction}")
        return "; ".join(parts)


MAX_FLOAT = "CAST('3.4028235E38' AS FLOAT)"


# -- predicates ---------------------------------------------------------------------------------


def full_text(cell: Cell) -> str:
    """Text of a cell for matching. Text columns match on the whole text, however long."""
    if isinstance(cell.data_type, T.StringType):
        return f"nullif({cell.raw}, '')"
    if is_cell_type(cell.data_type):
        return f"nullif({cell.raw}.text, '')"
    return cell.text


def filter_predicate(condition: Filter, cell: Cell, column_type: str) -> str:
    """SQL predicate of a filter. It is never true for a missing cell, ``isEmpty`` aside."""
    operator = condition.operator
    if operator in ("isEmpty", "isNotEmpty"):
        if isinstance(cell.data_type, T.StringType):
            empty = f"({cell.raw} IS NULL OR {cell.raw} = '')"
        elif is_cell_type(cell.data_type):
            empty = f"{full_text(cell)} IS NULL"
        else:
            empty = f"{cell.raw} IS NULL"
        return empty if operator == "isEmpty" else f"NOT ({empty})"
    if operator in ("isTrue", "isFalse"):
        wanted = "true" if operator == "isTrue" else "false"
        if isinstance(cell.data_type, T.BooleanType):
            return f"{cell.raw} = {wanted}"
        return f"lower({full_text(cell)}) = '{wanted}'"
    if column_type in ("number", "date"):
        return _ordered_predicate(condition, cell, column_type)
    value = literal((condition.value or "").lower())
    text = f"lower({full_text(cell)})"
    return {
        "contains": f"contains({text}, {value})",
        "notContains": f"NOT contains({text}, {value})",
        "equals": f"{text} = {value}",
        "notEquals": f"{text} <> {value}",
        "startsWith": f"startswith({text}, {value})",
        "endsWith": f"endswith({text}, {value})",
    }.get(operator, "FALSE")


def _ordered_predicate(condition: Filter, cell: Cell, column_type: str) -> str:
    parse = parse_number if column_type == "number" else parse_date
    first, last = parse(condition.value), None
    if first is None:
        return "FALSE"
    if condition.operator == "between":
        last = parse(condition.second_value)
        if last is None:
            return "FALSE"
        first, last = min(first, last), max(first, last)

    column, at_least, above = _scale(cell, column_type)
    if isinstance(cell.data_type, T.DecimalType) and above(first) is None:
        outer = _outer_interval(condition.operator, cell, first, first if last is None else last)
    elif isinstance(cell.data_type, T.FloatType) and column_type == "number":
        outer = f"{column} BETWEEN -{MAX_FLOAT} AND {MAX_FLOAT}"
    else:
        outer = ""
    inner = _interval(condition.operator, column, at_least, above, first, last)
    return f"({outer} AND ({inner}))" if outer else inner


def _interval(operator: str, column: str, at_least, above, first, last) -> str:
    start, end = f"{column} >= {at_least(first)}", f"{column} < {above(first)}"
    if above(first) is None:  # a continuous scale: compare with the value itself
        value = at_least(first)
        bounded = f"{column} <= {MAX_DOUBLE}", f"{column} >= -{MAX_DOUBLE}"
        return {
            "equals": f"{column} = {value}",
            "notEquals": f"({column} <> {value} AND {bounded[0]} AND {bounded[1]})",
            "greaterThan": f"({column} > {value} AND {bounded[0]})",
            "greaterThanOrEqual": f"({column} >= {value} AND {bounded[0]})",
            "lessThan": f"({column} < {value} AND {bounded[1]})",
            "lessThanOrEqual": f"({column} <= {value} AND {bounded[1]})",
            "between": f"({column} >= {value} AND {column} <= {at_least(last or first)})",
        }.get(operator, "FALSE")
    return {
        "equals": f"({start} AND {end})",
        "notEquals": f"({column} < {at_least(first)} OR {column} >= {above(first)})",
        "greaterThan": f"{column} >= {above(first)}",
        "greaterThanOrEqual": start,
        "lessThan": f"{column} < {at_least(first)}",
        "lessThanOrEqual": end,
        "between": f"({start} AND {column} < {above(first if last is None else last)})",
    }.get(operator, "FALSE")


def _outer_interval(operator: str, cell: Cell, first: float, last: float) -> str:
    """Bounds of a wide decimal that hold wherever its nearest double passes the comparison.

    A decimal that rounds to a double lies between that double's neighbours; sources can use them.
    """
    kind = cell.data_type
    with localcontext() as context:
        context.prec = 400
        step = Decimal(1).scaleb(-kind.scale)
        most = Decimal(10) ** (kind.precision - kind.scale) - step

        def bound(value: float, rounding: str) -> str:
            exact = max(-most, min(most, Decimal(value))).quantize(step, rounding)
            return f"CAST('{exact:f}' AS DECIMAL({kind.precision}, {kind.scale}))"

        start = f"{cell.raw} >= {bound(math.nextafter(first, -math.inf), ROUND_FLOOR)}"
        end = f"{cell.raw} <= {bound(math.nextafter(last, math.inf), ROUND_CEILING)}"
    return {
        "equals": f"{start} AND {end}", "between": f"{start} AND {end}",
        "greaterThan": start, "greaterThanOrEqual": start, "lessThan": end, "lessThanOrEqual": end,
    }.get(operator, "")


def _single(value: float, strict: bool) -> str:
    """The first single-precision number at or above a value, or above it."""
    with np.errstate(over="ignore"):
        found = np.float32(value)
    if float(found) < value or (strict and float(found) == value):
        found = np.nextafter(found, np.float32(np.inf))
    return f"CAST('{'Infinity' if np.isposinf(found) else '-Infinity' if np.isneginf(found) else str(found)}' AS FLOAT)"


def _scale(cell: Cell, column_type: str):
    """The column to compare and how to write the first value at or above, and above, a literal.

    On a discrete scale (whole numbers, days, microseconds) every comparison becomes a half-open
    interval of the raw column, which sources can use; a continuous scale has no value ``above``.
    """
    kind = cell.data_type
    if column_type == "number" and isinstance(
        kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    ):
        def whole(value: int) -> str:
            if isinstance(kind, T.LongType):
                value = max(-(2**63) + 1, min(2**63 - 1, value))
                return f"{value}L"
            return str(value) if abs(value) < 2**31 else f"{max(-2**62, min(2**62, value))}L"

        return cell.raw, lambda v: whole(math.ceil(v)), lambda v: whole(math.floor(v) + 1)
    if column_type == "number" and isinstance(kind, T.DoubleType):
        return cell.raw, lambda v: f"{v!r}D", lambda v: None
    if column_type == "number" and isinstance(kind, T.FloatType):
        return cell.raw, lambda v: _single(v, False), lambda v: _single(v, True)
    if column_type == "number" and isinstance(kind, T.DecimalType) and kind.precision <= 15:
        # A double holds all values of the column, so the nearest ones of its scale decide alike.
        step, most = Decimal(1).scaleb(-kind.scale), Decimal(10) ** (kind.precision - kind.scale)

        def exact(value: float, rounding: str, steps: int = 0) -> str:
            bound = max(-most, min(most, Decimal(repr(value)))).quantize(step, rounding) + steps * step
            return f"CAST('{bound:f}' AS DECIMAL({kind.precision + (abs(bound) >= most)}, {kind.scale}))"

        return cell.raw, lambda v: exact(v, ROUND_CEILING), lambda v: exact(v, ROUND_FLOOR, 1)
    if column_type == "number":
        return cell.num, lambda v: f"{v!r}D", lambda v: None
    if isinstance(kind, T.DateType):
        day = 86_400_000

        def date(days: int) -> str:
            return f"DATE'{dt.date(1970, 1, 1) + dt.timedelta(days=days)}'"

        return cell.raw, lambda v: date(-(-v // day)), lambda v: date(v // day + 1)

    def moment(millis: int) -> str:
        text = (dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=millis)).isoformat(sep=" ")
        if isinstance(kind, T.TimestampNTZType):
            return f"TIMESTAMP_NTZ'{text}'"
        return f"TIMESTAMP_LTZ'{text}Z'"

    column = cell.raw if isinstance(kind, TIME_TYPES) else cell.instant
    return column, moment, lambda v: moment(v + 1)


def search_predicate(cells: Sequence[Cell], query: str) -> str | None:
    """True where any cell holds the query, case-insensitively; ``None`` without a query.

    Columns whose texts cannot hold the query's characters are left out, so a word search never
    formats numbers or times.
    """
    wanted = query.strip(BLANKS).lower()
    if not wanted:
        return None
    parts = []
    for cell in cells:
        if isinstance(cell.data_type, T.BooleanType):
            hits = [word for word in ("true", "false") if wanted in word]
            parts += [f"{cell.raw} = {word}" for word in hits]
            continue
        alphabet = None
        if isinstance(cell.data_type, TIME_TYPES):
            alphabet = set("0123456789-:.tz+")
        elif isinstance(cell.data_type, (T.FloatType, T.DoubleType)):
            alphabet = set("0123456789+-.einfatyn")
        elif isinstance(cell.data_type, T.NumericType):
            alphabet = set("0123456789-.")
        if alphabet is None or set(wanted) <= alphabet:
            parts.append(f"contains(lower({full_text(cell)}), {literal(wanted)})")
    return "(" + " OR ".join(parts) + ")" if parts else "FALSE"


# -- sort keys ----------------------------------------------------------------------------------


def natural_key(text: str) -> str:
    """Sort key of text: digit runs compare as numbers, case and accents do not count."""
    number = "ltrim('0', x)"
    sized = f"concat(lpad(CAST(length({number}) AS STRING), {LENGTH_DIGITS}, '0'), {number})"
    parts = f"transform(regexp_extract_all({text}, '([0-9]+|[^0-9]+)', 1), x -> IF(x RLIKE '^[0-9]', {sized}, x))"
    return f"IF({text} RLIKE '[0-9]', array_join({parts}, ''), {text}) COLLATE UNICODE_CI_AI"


def sort_keys(cell: Cell, column_type: str) -> list[str]:
    """Sort expressions of a column, most significant first; a missing cell gives only nulls."""
    natural = natural_key(full_text(cell))
    if column_type == "number":
        if cell.only_type == "number":
            return [cell.raw]
        return [cell.num, f"IF({cell.num} IS NULL, {natural}, NULL)"]
    if column_type == "date":
        if cell.only_type == "date":
            return [cell.instant]
        return [cell.instant, f"IF({cell.instant} IS NULL, {natural}, NULL)"]
    if column_type == "boolean":
        if isinstance(cell.data_type, T.BooleanType):
            return [f"CAST({cell.raw} AS INT)"]
        return [f"CAST(lower({full_text(cell)}) = 'true' AS INT)"]
    return [natural]


def apply_view(table: Table, spec: ViewSpec, types: Sequence[str]) -> Table:
    """All rows that pass every filter and the search, in the asked order.

    ``types`` are the column types of a profile. Filters are compiled as they stand; use
    ``Filter.error`` or ``ViewSpec.from_dict`` to validate them first.
    """
    staged = stage(table.df, table.fields)
    conditions = [
        filter_predicate(f, staged.cells[f.column_index], types[f.column_index])
        for f in spec.filters
    ]
    search = search_predicate(staged.cells, spec.query)
    if search:
        conditions.append(search)
    df = staged.df
    if conditions:
        df = df.where(" AND ".join(f"({condition})" for condition in conditions))
    if spec.sort:
        cell = staged.cells[spec.sort.column_index]
        keys = sort_keys(cell, types[spec.sort.column_index])
        names = [f"__sort_{i}" for i in range(len(keys))]
        df = df.selectExpr("*", *[f"{key} AS {name}" for key, name in zip(keys, names, strict=True)])
        absent = f"IF({cell.present}, 0, 1) AS __sort_absent"
        df = df.selectExpr("*", absent)
        ascending = spec.sort.direction == "asc"
        columns = [df["__sort_absent"].asc()]
        for name in names:
            column = df[name]
            columns.append(column.asc_nulls_last() if ascending else column.desc_nulls_last())
        columns += [df[name].asc() for name in table.order]
        df = df.orderBy(*columns)
    return table.with_df(df.selectExpr(*table.fields, *table.order))


def number_rows(df: DataFrame, name: str = "_row_index", start: int = 1) -> DataFrame:
    """Number the rows of a DataFrame in its order, without bringing them into one task.

    The ordered rows are written to the checkpoint folder once; the sizes of their partitions,
    one row each, give every partition its offset.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_folder(spark))
    placed = df.withColumn("__id", F.monotonically_increasing_id()).checkpoint()
    part, within = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit(2**33 - 1))
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset")
    )
    numbered = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return numbered.withColumn(name, F.col("__offset") + within + F.lit(start)).drop(
        "__id", "__part", "__offset"
    )
