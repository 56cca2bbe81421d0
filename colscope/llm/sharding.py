"""Contiguous shards of near equal bytes, cut from global prefix sums.

Rows are put in order by range partitions. Each partition sums its own sizes as it streams by; the
partition totals, one row each, give where a partition starts; a row's start in the whole decides its
shard: shard ``s`` takes the rows that start in the ``s``-th of equal parts of all bytes. No shard
differs from its share by more than one row. Only numbers are shuffled, never texts.

Defined cases: null text has no bytes; null ids come first; equal ids are ordered by checksum and size,
rows that are equal in all of these are interchangeable; an empty table gives an empty result; a row
larger than a share can leave shards empty; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colscope.llm.common import save

ORDER = ("doc_id", "text_crc32", "size", "tie")
SCHEMA = pa.schema([(c, pa.int64()) for c in ("doc_id", "size", "text_crc32", "part", "before", "row")])


def contiguous_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for each row; ``slot`` counts the rows of a shard from 0."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    sized = save(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.monotonically_increasing_id().alias("tie"),
        ),
        "sized",
    )
    summed = save(sized.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(_running, _ddl()), "summed")
    totals = summed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # One row per partition of the shuffle: few enough for one task and a broadcast.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("part_bytes"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("part_rows"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    start = (F.col("part_bytes") + F.col("before")).cast("decimal(38,0)")
    placed = summed.join(F.broadcast(starts), "part").select(
        "doc_id", "size", "text_crc32",
        F.floor(start * shards / F.col("all_bytes")).cast("int").alias("shard"),
        (F.col("part_rows") + F.col("row")).alias("row"),
    )
    placed = save(placed, "placed")
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot")
    )


def _ddl() -> str:
    return ", ".join(f"{name} long" for name in SCHEMA.names)


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one partition with the bytes and rows that come before each in it."""
    part, before, row = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        size = batch["size"].to_numpy()
        ends = before + np.cumsum(size)
        yield pa.RecordBatch.from_arrays(
            [
                batch["doc_id"], batch["size"], batch["text_crc32"], pa.array(np.full(len(size), part, np.int64)),
                pa.array(ends - size), pa.array(np.arange(row, row + len(size))),
            ],
            schema=SCHEMA,
        )
        before, row = int(ends[-1]) if len(ends) else before, row + len(size)
