"""Aggregates of the column profile as SQL text, shared by batch and streaming plans."""

from __future__ import annotations

from pyspark.sql import types as T

from colscope.functions.cells import TIME_TYPES, Cell, iso_text
from colscope.functions.numbers import number_text

VALUE_TYPES = ("number", "boolean", "date", "text")
DISTINCT_ERROR = 0.04
SKETCH_K = 400
TOP_VALUES = 5

INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)


def possible_types(cell: Cell) -> tuple[str, ...]:
    """Value types a column can hold, as far as its schema tells."""
    if cell.only_type is not None:
        return (cell.only_type,)
    if isinstance(cell.data_type, FLOAT_TYPES):
        return ("number", "text")
    return VALUE_TYPES


def basic_aggregates(cell: Cell) -> dict[str, str]:
    """Counts, value types, moments and ranges. All are mergeable and need no ordering."""
    types = possible_types(cell)
    found = {"non_null": f"count({cell.vtype})"}
    if len(types) > 1:
        for value_type in types:
            found[f"n_{value_type}"] = f"count_if({cell.vtype} = '{value_type}')"
    if "number" in types:
        found |= {
            "num_count": f"count({cell.num})",
            "min_number": f"min({cell.num})",
            "max_number": f"max({cell.num})",
            "mean": f"avg({cell.num})",
            "std_dev": f"stddev_pop({cell.num})",
        }
    if "date" in types:
        found |= {
            "min_instant": f"min({cell.instant})",
            "max_instant": f"max({cell.instant})",
        }
    if "text" in types:
        found |= {"min_length": f"min({cell.units})", "max_length": f"max({cell.units})"}
    return found


def date_texts(cell: Cell) -> dict[str, str]:
    """Source texts of the earliest and latest date; equal instants resolve by text."""
    dated = f"IF({cell.vtype} = 'date', struct({cell.instant} AS at, {cell.text} AS text), NULL)"
    return {"min_text": f"min({dated}).text", "max_text": f"max({dated}).text"}


def distinct_estimate(cell: Cell) -> str:
    """HyperLogLog estimate of the distinct values of a cell."""
    code, text, digest, num = cell.key
    if isinstance(cell.data_type, INTEGER_TYPES + FLOAT_TYPES):
        value = cell.raw
    elif isinstance(cell.data_type, TIME_TYPES):
        value = num
    elif isinstance(cell.data_type, T.StringType):
        value = f"coalesce({digest}, {text})"
    else:
        value = f"IF({cell.present}, struct({code}, coalesce({digest}, {text})), NULL)"
    return f"approx_count_distinct({value}, {DISTINCT_ERROR}D)"


def tracked_text(text: str, digest: str) -> str:
    """What a sketch tracks of a text: the text, or the digest and the short form of a long one."""
    return f"IF({digest} IS NULL, concat('s', {text}), concat('l', {digest}, {text}))"


def tracked_value(item: str) -> str:
    """The shown form of a tracked text."""
    return f"IF(startswith({item}, 's'), substring({item}, 2), substring({item}, 66))"


def top_values_sketch(cell: Cell) -> str:
    """Approximate most frequent values as ``array<struct<value, count>>``.

    Typed numbers and times are tracked unformatted; only the few survivors become text.
    """
    if isinstance(cell.data_type, INTEGER_TYPES):
        item, shown = f"CAST({cell.raw} AS BIGINT)", "CAST(e.item AS STRING)"
    elif isinstance(cell.data_type, FLOAT_TYPES):
        item = f"CAST({cell.raw} AS DOUBLE)"
        shown = (
            f"IF(isnan(e.item) OR abs(e.item) = DOUBLE('Infinity'), "
            f"CAST(e.item AS STRING), {number_text('e.item')})"
        )
    elif isinstance(cell.data_type, TIME_TYPES):
        item, shown = cell.instant, iso_text("e.item")
    else:
        item = f"IF({cell.present}, {tracked_text(cell.key[1], cell.key[2])}, NULL)"
        shown = tracked_value("e.item")
    entry = f"struct({shown} AS value, CAST(e.count AS BIGINT) AS count)"
    return f"transform(approx_top_k({item}, {TOP_VALUES}), e -> {entry})"


def quantile_sketch(cell: Cell) -> str:
    return f"kll_sketch_agg_double({cell.num}, {SKETCH_K})"
