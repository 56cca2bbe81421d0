"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from colscope.session import scratch_folder


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared scratch folder and read it back.

    Cuts the lineage in a way that survives lost executors.
    """
    path = f"{scratch_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` as a long, ``text`` as its UTF-8 bytes, and the columns named in ``more``."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").cast("binary").alias("text"),
        *more,
    )


def map_rows(df: DataFrame, schema: str, rows_of: Callable[[dict], Iterable[tuple]]) -> DataFrame:
    """Run ``rows_of`` over Arrow batches given as ``{column: list}``; it yields output tuples."""
    from pyspark.sql.types import _parse_datatype_string

    spark_schema = _parse_datatype_string(schema)
    arrow_schema = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                rows = list(rows_of(part.to_pydict()))
                if rows:
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), arrow_schema)]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow_schema)

    return df.mapInArrow(run, spark_schema)


#: Rows and bytes that one call of a row function sees at most (one row may be larger).
PIECE_ROWS, PIECE_BYTES = 1000, 4 << 20


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of bounded size."""
    if not batch.num_rows:
        return
    step = max(1, min(PIECE_ROWS, batch.num_rows * PIECE_BYTES // max(1, batch.nbytes)))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def decoded(text: bytes | None) -> str:
    """The text; null is empty, bytes that are no UTF-8 become U+FFFD."""
    return "" if text is None else text.decode("utf-8", "replace")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(*columns: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 that depends on the columns and the seed alone."""
    bits = F.xxhash64(F.lit(seed), *columns).bitwiseAND(F.lit((1 << 52) - 1))
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def sampled_ids(ids: DataFrame, most: int, seed: int) -> DataFrame:
    """About ``most`` of the distinct ``doc_id``, chosen by hash; all of them where there are fewer."""
    ids = ids.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    share = most / max(most, ids.count())
    return ids.filter(unit(F.col("doc_id"), seed=seed) < share)
