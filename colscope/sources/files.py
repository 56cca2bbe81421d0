"""Listing files and reading their heads inside Spark tasks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES_PER_TASK = 32


class ScanLimitError(ValueError):
    """A source lies beyond a configured size or safety limit."""


def format_megabytes(count: float) -> str:
    return f"{count / (1024 * 1024):.1f} MB"


def list_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``(path, length)`` of every file below a path or glob. Contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "length")


def source_bytes(spark: SparkSession, path: str) -> int:
    return list_files(spark, path).agg(F.sum("length")).first()[0] or 0


def check_budget(size: int, maximum_mb: float | None) -> None:
    """Refuse a scan of more bytes than allowed; ``None`` allows any size."""
    if maximum_mb is not None and size > maximum_mb * 1024 * 1024:
        raise ScanLimitError(
            f"Full-data profiling is limited to {format_megabytes(maximum_mb * 1024 * 1024)}. "
            "Increase max_profile_scan_mb to scan this file."
        )


def open_random_access(uri: str):
    """Open a file named by a Hadoop URI for reading inside a task."""
    from pyarrow import fs

    uri = re.sub(r"^s3[an]://", "s3://", uri)
    uri = re.sub(r"^file:/+", "/", uri)
    if uri.startswith("/"):
        from urllib.parse import unquote

        return fs.LocalFileSystem().open_input_file(unquote(uri))
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def per_file(files: DataFrame, read: Callable[[str], Iterator[dict]], schema: str) -> DataFrame:
    """Run ``read`` once per listed file, spread over tasks, and collect its records as rows.

    The listing is what Spark's own file index holds on the driver, so its count is bounded; only
    names are shuffled.
    """
    spark = files.sparkSession
    tasks = max(1, min(files.count() // FILES_PER_TASK + 1, 100_000))
    tasks = max(tasks, spark.sparkContext.defaultParallelism)
    names = [part.strip().split(" ")[0] for part in re.split(r",(?![^<(]*[>)])", schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                rows = []
                for record in read(path):
                    rows.append(record)
                    if len(rows) >= 5000:
                        yield pd.DataFrame(rows, columns=names, dtype=object)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names, dtype=object)

    return files.select("path").repartition(tasks, "path").mapInPandas(run, schema)
