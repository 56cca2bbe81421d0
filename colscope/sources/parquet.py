"""Parquet as tables, and size budgets read from footers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.functions.text import literal
from colscope.options import Limits
from colscope.sources.files import list_files, open_random_access, per_file, source_bytes
from colscope.sources.table import Table

ORDER = ("_file", "_row_index")
FOOTER_SCHEMA = (
    "path string, row_group bigint, rows_before bigint, rows bigint, column string, "
    "uncompressed bigint, compressed bigint"
)


def open_parquet(spark: SparkSession, path: str) -> Table:
    """All columns of Parquet files; previews take the first few of them."""
    df = spark.read.parquet(path)
    ordered = df.selectExpr(
        *(f"`{name.replace('`', '``')}`" for name in df.columns),
        "_metadata.file_path AS _file",
        "_metadata.row_index AS _row_index",
    )
    table = Table.from_dataframe(
        ordered, order=ORDER, format="PARQUET", path=path, size_bytes=source_bytes(spark, path)
    )
    return replace(table, total_columns=len(df.columns))


def parquet_footers(spark: SparkSession, path: str) -> DataFrame:
    """One row per file, row group and column chunk, read from the footers alone."""

    def read(uri: str) -> Iterator[dict]:
        import pyarrow.parquet as pq

        with open_random_access(uri) as stream:
            metadata = pq.read_metadata(stream)
        before = 0
        for group in range(metadata.num_row_groups):
            row_group = metadata.row_group(group)
            for position in range(row_group.num_columns):
                chunk = row_group.column(position)
                yield {
                    "path": uri, "row_group": group, "rows_before": before,
                    "rows": row_group.num_rows, "column": chunk.path_in_schema.split(".")[0],
                    "uncompressed": chunk.total_uncompressed_size,
                    "compressed": chunk.total_compressed_size,
                }
            before += row_group.num_rows

    return per_file(list_files(spark, path, "*.parquet"), read, FOOTER_SCHEMA)


def footer_audit(
    spark: SparkSession,
    path: str,
    max_bytes: int,
    columns: Sequence[str] | None = None,
    row_limit: int | None = None,
) -> DataFrame:
    """Uncompressed bytes a read of the given columns and first rows needs, per file.

    Result: ``(path, rows, expanded_bytes, verdict, reason)``; row groups count until the row
    limit is covered.
    """
    footers = parquet_footers(spark, path)
    covered = "TRUE" if row_limit is None else f"rows_before < {int(row_limit)}"
    chosen = covered
    if columns is not None:
        listed = ", ".join(map(literal, columns)) or "NULL"
        chosen = f"{covered} AND column IN ({listed})"
    totals = footers.groupBy("path").agg(
        F.expr("max(rows_before + rows)").alias("rows"),
        F.expr(f"coalesce(sum(IF({chosen}, uncompressed, 0)), 0)").alias("expanded_bytes"),
        F.expr(f"count_if({covered} AND rows < 0)").alias("bad_groups"),
        F.expr(f"count_if({chosen} AND uncompressed < 0)").alias("bad_chunks"),
    )
    limit = literal(f"exceeds the {max_bytes / (1024 * 1024):.1f} MB uncompressed safety limit")
    reason = (
        "CASE WHEN bad_groups > 0 THEN 'negative row-group size' "
        "WHEN bad_chunks > 0 THEN 'negative column size' "
        f"WHEN expanded_bytes > {int(max_bytes)} THEN {limit} END"
    )
    return totals.selectExpr(
        "path", "rows", "expanded_bytes",
        f"IF({reason} IS NULL, 'accepted', 'rejected') AS verdict", f"{reason} AS reason",
    )
