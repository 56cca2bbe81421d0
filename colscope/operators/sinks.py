"""Writing rows as tab-separated text, and profiles as result sets."""

from __future__ import annotations

from colscope.operators.display import tsv_field, tsv_rows
from colscope.plans.profile import ProfileResult
from colscope.sources.table import Table


def write_tsv(table: Table, path: str, header: bool = False, ordered: bool = False) -> None:
    """Write all rows as tab-separated text files.

    ``ordered`` sorts rows into source order across files. ``header`` puts the column names into a
    first file of their own.
    """
    rows = tsv_rows(table)
    if ordered and table.order:
        rows = rows.orderBy(*table.order)
    rows = rows.select("value")
    if header:
        spark = table.df.sparkSession
        names = spark.createDataFrame([tuple(table.columns)], [f"n{i}" for i in range(len(table.columns))])
        line = names.selectExpr(
            "concat_ws('\\t', " + ", ".join(tsv_field(f"n{i}") for i in range(len(table.columns))) + ") AS value"
        )
        rows = line.coalesce(1).union(rows)
    rows.write.text(path)


def write_profile(result: ProfileResult, path: str, format: str = "parquet") -> None:
    """Write profiles and warnings below ``path``."""
    if format not in ("parquet", "json"):
        raise ValueError("format must be 'parquet' or 'json'")
    result.profiles.write.format(format).save(f"{path}/profiles")
    result.warnings.write.format(format).save(f"{path}/warnings")
