"""Column-name search, dataset summaries and profile overviews."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colscope.functions.text import BLANKS
from colscope.operators.quality import percent_label
from colscope.sources.files import format_megabytes

if TYPE_CHECKING:
    from colscope.plans.profile import ProfileResult
    from colscope.sources.open import Preview
    from colscope.sources.table import Table

# Labels of separators and encodings.
DELIMITER_LABELS = {",": "comma", ";": "semicolon", "\t": "tab", "|": "pipe"}
ENCODING_LABELS = {"utf8": "UTF-8", "utf16le": "UTF-16 LE", "latin1": "Latin-1"}


def column_listing(spark: SparkSession, tables: Mapping[str, Sequence[str] | DataFrame]) -> DataFrame:
    """``(table, column, ordinal)`` of the given tables, from their schemas alone."""
    rows = []
    for name, found in tables.items():
        columns = found.columns if isinstance(found, DataFrame) else found
        rows += [(name, column, ordinal) for ordinal, column in enumerate(columns)]
    return spark.createDataFrame(rows, "table string, column string, ordinal int")


def search_columns(listing: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Columns whose name matches: exact first, then by prefix, then anywhere.

    Result: ``(table, column, ordinal, rank, position, total)``, at most ``limit`` rows (1..100);
    ``total`` counts all matches.
    """
    wanted = query.strip(BLANKS).lower()
    limit = max(1, min(100, math.floor(limit)))
    name = F.lower("column")
    rank = (
        F.when(name == wanted, 0).when(name.startswith(wanted), 1).when(name.contains(wanted), 2)
    )
    matches = listing.withColumn("rank", rank).where(F.col("rank").isNotNull() & F.lit(bool(wanted)))
    total = matches.agg(F.count(F.lit(1)).alias("total"))
    order = ("rank", "table", "ordinal")
    best = matches.orderBy(*order).limit(limit)
    numbered = best.withColumn("position", F.row_number().over(Window.orderBy(*order)))
    return numbered.withColumn("total", total.scalar())


def match_columns(columns: Sequence[str], query: str, limit: int = 20) -> tuple[list[int], int]:
    """The same search over the names of one open table, without a job."""
    wanted = query.strip(BLANKS).lower()
    if not wanted:
        return [], 0
    tests = (str.__eq__, str.startswith, str.__contains__)
    ranked = []
    for index, column in enumerate(columns):
        rank = next((r for r, test in enumerate(tests) if test(column.lower(), wanted)), None)
        if rank is not None:
            ranked.append((rank, index))
    limit = max(1, min(100, math.floor(limit)))
    return [index for _, index in sorted(ranked)][:limit], len(ranked)


def table_summary(table: Table, preview: Preview) -> DataFrame:
    """One row that describes an open table; counts that are not known end in ``+``."""
    total = f"{preview.total_rows:,} rows" if preview.total_rows is not None else f"{preview.row_count:,}+ rows"
    shown, width = len(table.columns), table.width
    columns = f"{shown:,} of {width:,} columns" if width > shown else f"{shown:,} columns"
    parsing = table.parsing
    row = (
        table.format, total, columns, format_megabytes(table.size_bytes or 0),
        f"Previewing first {preview.row_count:,}" if preview.truncated_rows else None,
        DELIMITER_LABELS.get(parsing.resolved_delimiter, parsing.resolved_delimiter) if parsing else None,
        ENCODING_LABELS[parsing.applied.encoding] if parsing else None,
        table.sheet,
    )
    return table.df.sparkSession.createDataFrame(
        [row],
        "format string, rows string, columns string, size string, note string, delimiter string, "
        "encoding string, sheet string",
    )


def profile_note(result: ProfileResult) -> str:
    """A line on what a profile covers."""
    columns = f"{len(result.types):,} columns"
    if result.scope != "full":
        return f"Based on preview · {result.row_count:,} rows · {columns}"
    estimated = result.profiles.where("approximate_metrics IS NOT NULL").count() > 0
    note = f"Full dataset · {result.row_count:,} rows · {columns}"
    return note + " · ≈ estimated" if estimated else note


def profile_report(result: ProfileResult) -> DataFrame:
    """Profiles as an overview, one row per column, estimates marked with ``≈``."""
    def marked(metric: str, value: str) -> str:
        flag = f"array_contains(coalesce(approximate_metrics, array()), '{metric}')"
        return f"concat(IF({flag}, '≈', ''), {value})"

    ranged = (
        "CASE WHEN min_number IS NOT NULL THEN concat(min_number, ' – ', max_number) "
        "WHEN min_text IS NOT NULL THEN concat(min_text, ' – ', max_text) "
        "WHEN min_length IS NOT NULL THEN concat(min_length, ' – ', max_length, ' characters') END"
    )
    missing = F.concat(
        F.format_number("missing", 0), F.lit(" ("), percent_label(F.col("missing_ratio")), F.lit(")")
    )
    return result.profiles.select(
        "column_index", "name", "type", missing.alias("missing"),
        F.expr(marked("distinct", "format_number(distinct, 0)")).alias("distinct"),
        F.expr(ranged).alias("range"),
        F.expr(marked("median", "CAST(median AS STRING)")).alias("median"),
        F.expr(
            "array_join(transform(top_values, v -> concat(v.value, ' (', v.count, ')')), ', ')"
        ).alias("top_values"),
    )


def column_warnings(result: ProfileResult) -> DataFrame:
    """Warnings with the type of the column they point to."""
    columns = result.profiles.select("column_index", "type")
    return result.warnings.join(columns, "column_index").select(
        "column_index", "name", "type", "position", "code", "message"
    )
