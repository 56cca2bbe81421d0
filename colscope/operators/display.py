"""Cells as people read them: grouped numbers, written-out dates, and tab-separated text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from colscope.functions.cells import TIME_TYPES, Cell, stage, utc_seconds
from colscope.functions.numbers import number_text
from colscope.functions.text import literal, quoted, trim_blanks
from colscope.sources.table import Table

# Display formats.
DATE_FORMAT = "MMM dd, yyyy"


def grouped_number(text: str) -> str:
    """Plain number text with thousands separators; exponents are spelled out."""
    plain = (
        f"IF(contains(lower({text}), 'e'), "
        f"regexp_replace(CAST(TRY_CAST({text} AS DECIMAL(38,20)) AS STRING), '\\\\.?0+\\\\z', ''), {text})"
    )
    whole = f"substring_index({plain}, '.', 1)"
    grouped = f"regexp_replace({whole}, '(?<=[0-9])(?=(?:[0-9]{{3}})+\\\\z)', ',')"
    fraction = f"IF(contains({plain}, '.'), concat('.', substring_index({plain}, '.', -1)), '')"
    return f"concat({grouped}, {fraction})"


def display_text(cell: Cell, column_type: str) -> str:
    """Display text of a cell by the type of its column; what does not convert stays as it is."""
    text = cell.text
    if column_type == "number":
        value = text if cell.only_type == "number" else number_text(cell.num)
        shown = f"IF({cell.num} IS NULL, {text}, {grouped_number(value)})"
    elif column_type == "boolean":
        low = f"lower({trim_blanks(text)})"
        shown = f"CASE {low} WHEN 'true' THEN 'True' WHEN 'false' THEN 'False' ELSE {text} END"
    elif column_type == "date":
        utc = utc_seconds(cell.instant)
        day = f"date_format(CAST(substring_index({utc}, ' ', 1) AS DATE), {literal(DATE_FORMAT)})"
        timed = "TRUE" if isinstance(cell.data_type, TIME_TYPES) else (
            f"{text} RLIKE 'T|[0-9]{{1,2}}:[0-9]{{2}}'"
        )
        shown = (
            f"coalesce(concat({day}, IF({timed}, concat(', ', substring({utc}, -8), ' UTC'), '')), {text})"
        )
    else:
        shown = text
    return f"coalesce({shown}, 'NULL')"


def render_columns(table: Table, types: Sequence[str]) -> DataFrame:
    """Every cell as display text, under the shown names."""
    staged = stage(table.df, table.fields)
    return staged.df.selectExpr(
        *(
            f"{display_text(cell, kind)} AS {quoted(name)}"
            for cell, kind, name in zip(staged.cells, types, table.columns, strict=True)
        )
    )


def copy_text(cell: Cell) -> str:
    """Text of a value for copying; a missing value is empty."""
    return f"coalesce({cell.text}, '')"


def tsv_field(text: str) -> str:
    """A field of a tab-separated row, quoted when it holds a tab, line break or quote."""
    quoted_text = f"concat('\"', replace({text}, '\"', '\"\"'), '\"')"
    return f"IF({text} RLIKE '[\\\\t\\\\r\\\\n\"]', {quoted_text}, {text})"


def tsv_rows(table: Table) -> DataFrame:
    """Rows as tab-separated text: one column ``value``, next to the ordering columns."""
    staged = stage(table.df, table.fields)
    names = [f"__copy_{cell.index}" for cell in staged.cells]
    copied = staged.df.selectExpr(
        *(f"{copy_text(c)} AS {name}" for c, name in zip(staged.cells, names, strict=True)), *table.order
    )
    row = f"concat_ws('\\t', {', '.join(tsv_field(name) for name in names)})"
    return copied.selectExpr(f"{row} AS value", *table.order)


def value_text(table: Table, column_index: int) -> DataFrame:
    """One column as plain text: one column ``value``, next to the ordering columns."""
    staged = stage(table.df, table.fields)
    return staged.df.selectExpr(f"{copy_text(staged.cells[column_index])} AS value", *table.order)


