"""Opening any supported source by its extension, and bounded previews of it."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.functions.cells import stage
from colscope.functions.text import MAX_CELL_UNITS, is_cut
from colscope.options import MAX_PREVIEW_EXPANDED_BYTES, DelimitedOptions, Limits
from colscope.plans.profile import METRICS, ProfileResult, profile
from colscope.sources.delimited import open_delimited
from colscope.sources.files import ScanLimitError, check_budget
from colscope.sources.parquet import footer_audit, open_parquet
from colscope.sources.table import Table
from colscope.sources.workbook import open_workbook

# Supported extensions.
FORMATS = {
    ".csv": "delimited", ".tsv": "delimited", ".parquet": "parquet",
    ".xlsx": "workbook", ".xlsm": "workbook",
}


def extension_of(path: str) -> str:
    match = re.search(r"(\.[^./\\*?\[\]{}]+)[*\]})]*/?$", path)
    return match.group(1).lower() if match else ""


def is_supported(path: str) -> bool:
    return extension_of(path) in FORMATS


def open_table(
    spark: SparkSession,
    path: str,
    *,
    options: DelimitedOptions | None = None,
    limits: Limits | None = None,
    sheet: str | None = None,
    format: str | None = None,
    **delimited: object,
) -> Table:
    """Open a file, folder or glob. ``format`` names the reader when the path has no extension."""
    kind = format or FORMATS.get(extension_of(path))
    if kind == "delimited":
        table = open_delimited(spark, path, options, limits, **delimited)
    elif kind == "parquet":
        table = open_parquet(spark, path)
    elif kind == "workbook":
        table = open_workbook(spark, path, sheet, limits)
    else:
        raise ValueError(f"Unsupported file type: {extension_of(path) or '(no extension)'}")
    return replace(table, limits=limits)


def profile_table(
    table: Table, mode: str = "exact", limits: Limits | None = None, metrics=METRICS
) -> ProfileResult:
    """Profile every row of a table, within the scan budget if ``limits`` set one."""
    budget = (limits or Limits()).max_profile_scan_mb
    check_budget(table.size_bytes or 0, budget)
    if budget is not None and table.format == "PARQUET":
        audit = footer_audit(table.df.sparkSession, table.path, int(budget * 1024 * 1024), table.columns)
        expanded = audit.agg(F.sum("expanded_bytes")).first()[0] or 0
        if expanded > budget * 1024 * 1024:
            raise ScanLimitError(
                f"Full-data Parquet profiling exceeds the {budget:.1f} MB safety limit. "
                "Increase max_profile_scan_mb or reduce max_columns."
            )
    return profile(table.df, table.fields, table.columns, mode=mode, metrics=metrics)


@dataclass(frozen=True)
class Preview:
    """A bounded head of a table with its own profile."""

    table: Table
    """The head rows; its DataFrame is local, in source order under ``_row_index``."""
    profile: ProfileResult
    row_count: int
    total_rows: int | None
    truncated_rows: bool
    truncated_columns: bool
    truncated_cells: int

    @property
    def scope(self) -> str:
        return "preview" if self.truncated_rows else "full"

    def truncation(self) -> DataFrame:
        """One row ``(rows, columns, cells)``: what the preview leaves out or shortens."""
        return self.table.df.sparkSession.createDataFrame(
            [(self.truncated_rows, self.truncated_columns, self.truncated_cells)],
            "rows boolean, columns boolean, cells bigint",
        )


def head_rows(table: Table, count: int) -> list:
    """The first rows in source order, as many as asked, without a pass over the data.

    Several files are taken in path order, a few at first and more only as needed.
    """
    if not table.order:
        return table.df.limit(count).collect()
    if "_file" not in table.order:
        return table.df.orderBy(*table.order).limit(count).collect()
    paths = sorted(set(table.df.inputFiles()))
    if len(paths) <= 1:
        return table.df.limit(count).collect()
    rows, taken, step = [], 0, 1
    while len(rows) < count and taken < len(paths):
        for path in paths[taken : taken + step]:
            if len(rows) < count:
                rows += table.df.where(F.col("_file") == path).limit(count - len(rows)).collect()
        taken += step
        step *= 2
    return rows


def count_cut_cells(table: Table) -> DataFrame:
    """One row ``(cells)``: how many cells the text limit shortened."""
    staged = stage(table.df, table.fields, MAX_CELL_UNITS)
    texts = [c for c in staged.cells if c.only_type is None and c.text.startswith("__cell_")]
    counts = " + ".join(f"count_if({is_cut(c.text)})" for c in texts) or "0"
    return staged.df.selectExpr(f"CAST({counts} AS BIGINT) AS cells")


def preview(table: Table, limits: Limits | None = None) -> Preview:
    """The head of a table under the row, column and cell limits, profiled on its own.

    One row more than shown is asked for, to learn whether more exist without counting them.
    Parquet row counts come from the footers and are always known.
    """
    limits = limits or table.limits or Limits()
    spark = table.df.sparkSession
    table = replace(table, columns=table.columns[: limits.max_columns], total_columns=table.width)
    wanted = limits.head_rows(len(table.columns))
    if table.format == "PARQUET" and table.path:
        audit = footer_audit(spark, table.path, MAX_PREVIEW_EXPANDED_BYTES, table.columns, wanted)
        if audit.where("verdict = 'rejected'").count():
            raise ScanLimitError(
                "Parquet preview exceeds the 256 MB uncompressed safety limit. Reduce max_columns."
            )
    found = head_rows(table, wanted + 1)
    more = len(found) > wanted
    data_schema = table.data().schema
    shown = [(*(row[f] for f in table.fields), i) for i, row in enumerate(found[:wanted])]
    schema = data_schema.add("_row_index", "long")
    head = replace(table, df=spark.createDataFrame(shown, schema), order=("_row_index",))
    total = None if more else len(shown)
    if more and table.format == "PARQUET":
        total = table.df.count()
    result = profile(
        head.df, head.fields, head.columns, scope="preview" if more else "full", cell_units=MAX_CELL_UNITS
    )
    if more:  # quality rules speak about complete tables only
        result = replace(result, warnings=result.warnings.where("FALSE"))
    return Preview(
        table=head,
        profile=result,
        row_count=len(shown),
        total_rows=total,
        truncated_rows=more,
        truncated_columns=table.width > len(table.columns),
        truncated_cells=count_cut_cells(head).first()[0],
    )
