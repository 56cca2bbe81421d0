"""Normalized cells: how every Spark type becomes a tagged scalar with a value type.

A cell has a kind (``s`` text, ``n`` number, ``b`` boolean), a text, a value type (``number``,
``boolean``, ``date`` or ``text``; null for a missing cell), a finite number or null, and an
instant or null. ``stage`` adds what a column needs as flat projected columns, in steps that
build on each other, so that no expression is evaluated twice per row. Typed columns need almost
nothing: their value type is known from the schema.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.functions.numbers import MAX_SAFE_INTEGER, finite, is_finite, number_text
from colscope.functions.text import (
    BLANKS,
    BLANKS_SQL,
    MAX_DISPLAY_UNITS,
    cut_text,
    display_value,
    literal,
    long_text_digest,
    quoted,
    trim_blanks,
    utf16_units,
)

# Patterns of typed text and the text of times.
NUMBER_PATTERN = r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
BLANK_CLASS = "[" + "".join(f"\\x{{{ord(blank):x}}}" for blank in BLANKS) + "]"
DATE_PATTERN = (
    r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}(?:(?:T|" + BLANK_CLASS + r")[^\n\r\x{2028}\x{2029}]*)?\z"
)
TYPED_TEXT_STARTS = "+-.0123456789tTfF"
"""First characters a number, boolean or date can have; all other text skips the patterns."""

CELL_TYPE = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("num", T.DoubleType()),
    ]
)
"""Column type of sources whose cells can be text, number or boolean within one column."""

TIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
NO_TEXT, NO_NUMBER = "CAST(NULL AS STRING)", "CAST(NULL AS DOUBLE)"
NO_INSTANT, NO_UNITS = "CAST(NULL AS TIMESTAMP)", "CAST(NULL AS INT)"


def is_cell_type(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.StructType) and [
        (f.name, f.dataType) for f in data_type.fields
    ] == [(f.name, f.dataType) for f in CELL_TYPE.fields]


def utc_seconds(instant: str) -> str:
    """``yyyy-MM-dd HH:mm:ss`` of an instant in UTC. A time without zone is counted up, as conversions through the session
    zone lose the hours that its clock skips."""
    days, rest = f"floor(unix_millis({instant}) / 86400000)", f"pmod(unix_millis({instant}), 86400000L) DIV 1000"
    return (
        f"CAST(TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(CAST({days} AS INT), 0, 0, CAST({rest} AS DECIMAL(18, 6))) "
        "AS STRING)"
    )


def iso_text(instant: str) -> str:
    millis = f"lpad(CAST(pmod(unix_millis({instant}), 1000L) AS STRING), 3, '0')"
    return f"concat(replace({utc_seconds(instant)}, ' ', 'T'), '.', {millis}, 'Z')"


def utc_instant(value: str, data_type: T.DataType) -> str:
    """The instant of a date or of a time without zone, both taken as UTC in any session zone."""
    days = f"datediff(CAST({value} AS DATE), DATE'1970-01-01') * 86400L"
    if isinstance(data_type, T.DateType):
        return f"timestamp_seconds({days})"
    micros = f"CAST(extract(SECOND FROM {value}) * 1000000 AS BIGINT)"
    return f"timestamp_micros(({days} + hour({value}) * 3600L + minute({value}) * 60L) * 1000000L + {micros})"


def to_millis(instant: str) -> str:
    """Drop everything below the millisecond, the precision at which times compare."""
    return f"timestamp_millis(unix_millis({instant}))"


def typed_candidate(text: str) -> str:
    """The trimmed text when its first character allows a number, boolean or date, else null."""
    starts = ", ".join(literal(c) for c in TYPED_TEXT_STARTS)
    start = f"substring(trim(LEADING {BLANKS_SQL} FROM {text}), 1, 1)"
    return f"IF({start} IN ({starts}), {trim_blanks(text)}, NULL)"


def text_value_type(text: str, candidate: str) -> str:
    """Value type of a text cell, given its ``typed_candidate``."""
    return (
        f"CASE WHEN {text} IS NULL THEN NULL WHEN {candidate} IS NULL THEN 'text' "
        f"WHEN {candidate} RLIKE {literal(NUMBER_PATTERN)} THEN 'number' "
        f"WHEN length({candidate}) <= 5 AND lower({candidate}) IN ('true', 'false') THEN 'boolean' "
        f"WHEN substring({candidate}, 5, 1) = '-' AND {candidate} RLIKE {literal(DATE_PATTERN)} "
        f"AND TRY_CAST({candidate} AS TIMESTAMP) IS NOT NULL THEN 'date' ELSE 'text' END"
    )


def json_text(value: str, data_type: T.DataType, depth: int = 0) -> str:
    """JSON text of a nested value; nested 64-bit integers are written as strings."""
    item = f"v{depth}"
    if isinstance(data_type, T.ArrayType):
        inner = json_text(item, data_type.elementType, depth + 1)
        body = f"concat('[', array_join(transform({value}, {item} -> {inner}), ','), ']')"
    elif isinstance(data_type, T.StructType):
        members = [
            f"concat({literal(json.dumps(field.name, ensure_ascii=False) + ':')}, "
            + json_text(f"{value}.{quoted(field.name)}", field.dataType, depth + 1)
            + ")"
            for field in data_type.fields
        ]
        body = f"IF({value} IS NULL, NULL, concat('{{', concat_ws(',', {', '.join(members)}), '}}'))"
    elif isinstance(data_type, T.MapType):
        key = json_text(f"CAST({item}.key AS STRING)", T.StringType(), depth + 1)
        inner = json_text(f"{item}.value", data_type.valueType, depth + 1)
        entries = f"transform(map_entries({value}), {item} -> concat({key}, ':', {inner}))"
        body = f"concat('{{', array_join({entries}, ','), '}}')"
    elif isinstance(data_type, T.LongType):
        body = f"concat('\"', CAST({value} AS STRING), '\"')"
    elif isinstance(data_type, (T.FloatType, T.DoubleType)):
        wide = f"CAST({value} AS DOUBLE)"
        body = f"IF({is_finite(wide)}, {number_text(wide)}, NULL)"
    elif isinstance(data_type, TIME_TYPES):
        instant = f"CAST({value} AS TIMESTAMP)" if isinstance(data_type, T.TimestampType) else utc_instant(value, data_type)
        body = f"concat('\"', {iso_text(instant)}, '\"')"
    elif isinstance(
        data_type, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.DecimalType)
    ):
        body = f"CAST({value} AS STRING)"
    else:
        listed = f"to_json(array(CAST({value} AS STRING)))"
        body = f"IF({value} IS NULL, NULL, substring({listed}, 2, length({listed}) - 2))"
    return body if depth == 0 else f"coalesce({body}, 'null')"


@dataclass(frozen=True)
class Cell:
    """Expressions of one column over a staged DataFrame.

    ``vtype`` is null exactly for missing cells. ``only_type`` is the value type when the schema
    fixes it. ``key`` identifies a distinct value: ``(code, text, digest, num)``, where code tells
    text ``s``, number ``n``, boolean ``b`` and time ``t`` apart, long text is represented by its
    short form plus a SHA-256 digest, and typed numbers and times are kept unformatted.
    """

    index: int
    data_type: T.DataType
    raw: str
    kind: str
    text: str
    vtype: str
    key: tuple[str, str, str, str]
    num: str = NO_NUMBER
    instant: str = NO_INSTANT
    units: str = NO_UNITS
    only_type: str | None = None

    @property
    def decided_by_value(self) -> bool:
        """Whether the value type is decided value by value."""
        return self.vtype.startswith("__cell_")

    @property
    def present(self) -> str:
        return f"({self.text if self.decided_by_value else self.vtype}) IS NOT NULL"


def key_value_text(code: str, text: str, num: str) -> str:
    """The shown text of a frequency key."""
    return (
        f"coalesce({text}, CASE {code} WHEN 't' THEN "
        f"{iso_text(f'timestamp_millis(CAST({num} AS BIGINT))')} "
        f"WHEN 'n' THEN {number_text(num)} END)"
    )


@dataclass(frozen=True)
class StagedCells:
    """A DataFrame with what its cells need, and the one it was made of."""

    df: DataFrame
    cells: list[Cell]
    source: DataFrame
    cell_units: int | None = None


def stage(df: DataFrame, columns: Sequence[str] | None = None, cell_units: int | None = None) -> StagedCells:
    """Add what the named columns need (all columns by default) and describe their cells.

    Texts are whole unless ``cell_units`` sets a limit, as previews do.
    """
    names, source = list(df.columns if columns is None else columns), df
    data_types = {field.name: field.dataType for field in df.schema.fields}
    steps: list[dict[str, str]] = [{}, {}, {}, {}]
    cells = [_cell(index, name, data_types[name], steps, cell_units) for index, name in enumerate(names)]
    for step in steps:
        if step:
            df = df.selectExpr("*", *[f"{expression} AS {name}" for name, expression in step.items()])
    return StagedCells(df, cells, source, cell_units)


def _cell(
    index: int, name: str, data_type: T.DataType, steps: list[dict[str, str]], cell_units: int | None
) -> Cell:
    raw = quoted(name)
    if isinstance(data_type, (T.StringType, T.ArrayType, T.StructType, T.MapType, T.VariantType)):
        return _text_cell(index, raw, data_type, steps, cell_units)

    def typed(kind: str, vtype: str, text: str, key: tuple[str, str, str, str], **given) -> Cell:
        return Cell(
            index, data_type, raw, literal(kind), text,
            f"IF({raw} IS NOT NULL, '{vtype}', NULL)", key, only_type=vtype, **given,
        )

    text = f"CAST({raw} AS STRING)"
    num = f"CAST({raw} AS DOUBLE)"
    if isinstance(data_type, T.BooleanType):
        return typed("b", "boolean", text, ("'b'", text, NO_TEXT, NO_NUMBER))
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType)):
        return typed("n", "number", text, ("'n'", NO_TEXT, NO_TEXT, num), num=num)
    if isinstance(data_type, T.LongType):
        safe = f"{raw} BETWEEN {-MAX_SAFE_INTEGER} AND {MAX_SAFE_INTEGER}"
        kind = f"IF({safe}, 'n', 's')"
        key = (kind, f"IF({safe}, NULL, {text})", NO_TEXT, num)
        return replace(typed("n", "number", text, key, num=num), kind=kind)
    if isinstance(data_type, T.DecimalType):
        if data_type.scale > 0:
            text = f"regexp_replace({text}, '\\\\.?0+\\\\z', '')"
        return typed("n", "number", text, ("'n'", text, NO_TEXT, num), num=num)
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        kind = f"IF({is_finite(num)}, 'n', 's')"
        odd = (
            f"CASE WHEN isnan({num}) THEN 'NaN' WHEN {num} = DOUBLE('Infinity') THEN 'Infinity' "
            f"WHEN {num} = DOUBLE('-Infinity') THEN '-Infinity' END"
        )
        vtype = f"CASE WHEN {is_finite(num)} THEN 'number' WHEN {raw} IS NOT NULL THEN 'text' END"
        return Cell(
            index, data_type, raw, kind, f"coalesce({odd}, {number_text(num)})", vtype,
            (kind, odd, NO_TEXT, finite(num)), num=finite(num), units=f"length({odd})",
        )
    if isinstance(data_type, TIME_TYPES):
        instant = raw if isinstance(data_type, T.TimestampType) else utc_instant(raw, data_type)
        key = ("'t'", NO_TEXT, NO_TEXT, f"CAST(unix_millis({instant}) AS DOUBLE)")
        return typed("s", "date", iso_text(instant), key, instant=to_millis(instant))
    if isinstance(data_type, T.BinaryType):
        text = f"concat('[binary: ', octet_length({raw}), ' bytes]')"
        key = ("'s'", text, NO_TEXT, NO_NUMBER)
        return typed("s", "text", text, key, units=f"length({text})")
    if isinstance(data_type, T.NullType):
        return Cell(
            index, data_type, raw, "'s'", NO_TEXT, NO_TEXT,
            ("'s'", NO_TEXT, NO_TEXT, NO_NUMBER), only_type="text",
        )
    return _text_cell(index, raw, data_type, steps, cell_units)


def _text_cell(
    index: int, raw: str, data_type: T.DataType, steps: list[dict[str, str]], cell_units: int | None
) -> Cell:
    """A cell that is text, or is written as text; its value type is decided value by value."""
    from_cell = is_cell_type(data_type)
    if from_cell:
        written = f"{raw}.text"
    elif isinstance(data_type, (T.ArrayType, T.StructType, T.MapType)):
        written = json_text(raw, data_type)
    elif isinstance(data_type, T.VariantType):
        written = f"to_json({raw})"
    else:
        written = raw if isinstance(data_type, T.StringType) else f"CAST({raw} AS STRING)"
    names = ("text", "trimmed", "vtype", "num", "instant", "units", "display", "digest")
    text, trimmed, vtype, num, instant, units, display, digest = (
        f"__cell_{index}_{name}" for name in names
    )
    value_type = text_value_type(text, trimmed)
    parsed = finite(f"TRY_CAST({trimmed} AS DOUBLE)")
    kind = "'s'"
    if from_cell:
        kind = f"coalesce({raw}.kind, 's')"
        value_type = (
            f"CASE {raw}.kind WHEN 'n' THEN 'number' WHEN 'b' THEN 'boolean' ELSE {value_type} END"
        )
        parsed = f"IF({raw}.kind = 'n', {raw}.num, {parsed})"
    present = f"nullif({written}, '')"
    steps[0][text] = present if cell_units is None else cut_text(present, cell_units)
    steps[1][trimmed] = typed_candidate(text)
    steps[2][vtype] = value_type
    steps[3][num] = f"IF({vtype} = 'number', {parsed}, NULL)"
    read = f"TRY_CAST({trimmed} AS TIMESTAMP)"
    day = utc_instant(f"TRY_CAST({trimmed} AS DATE)", T.DateType())
    at = to_millis(f"IF(length({trimmed}) = 10, {day}, {read})")
    steps[3][instant] = f"IF({vtype} = 'date', {at}, NULL)"
    steps[3][units] = f"IF({vtype} = 'text', {utf16_units(text)}, NULL)"
    steps[3][display] = display_value(text)
    steps[3][digest] = long_text_digest(text, MAX_DISPLAY_UNITS)
    return Cell(
        index, data_type, raw, kind, text, vtype, (kind, display, digest, num),
        num=num, instant=instant, units=units,
    )


#: Columns that one scan takes into the long form; what they read apart from each other is read once anyway.
LONG_COLUMNS = 64


def long_form(staged: StagedCells, cells: Sequence[Cell], classes: Sequence[object] | None = None) -> list[tuple[StagedCells, list]]:
    """Cells as rows ``column_index`` and one value column for each type, of which a row fills at most one.

    What a type needs is then written once, not once for each column, so generated code is bounded and one scan
    serves all columns. ``classes`` tells columns of one type apart that are to be treated differently. Several parts
    come back only for more than ``LONG_COLUMNS`` columns; each with its value columns as cells and their classes.
    """
    tags = [None] * len(cells) if classes is None else classes
    parts = []
    for start in range(0, len(cells), LONG_COLUMNS):
        chunk = list(zip(cells, tags, strict=True))[start : start + LONG_COLUMNS]
        kinds = list(dict.fromkeys((cell.data_type.json(), tag) for cell, tag in chunk))
        types = {(cell.data_type.json(), tag): cell.data_type for cell, tag in chunk}
        rows = [
            F.struct(
                F.lit(cell.index).alias("column_index"),
                *(
                    (F.expr(cell.raw) if kind == (cell.data_type.json(), tag) else F.lit(None).cast(types[kind])).alias(f"v{k}")
                    for k, kind in enumerate(kinds)
                ),
            )
            for cell, tag in chunk
        ]
        long = staged.source.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
        parts.append((stage(long, [f"v{k}" for k in range(len(kinds))], staged.cell_units), [tag for _, tag in kinds]))
    return parts
