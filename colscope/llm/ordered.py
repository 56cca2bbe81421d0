"""Running aggregates over ordered groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colscope.llm.common import save

#: How the running value of a part and what comes before the part make one value.
JOINED = {"sum": lambda a, b: a + b, "bit_xor": lambda a, b: a.bitwiseXOR(b)}


def running(df: DataFrame, group: str, order: list[str], measures: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` with a column for each measure: ``{name: (sum or bit_xor, long column)}`` from the first row of
    the group up to this one.

    Rows are put in order by range partitions, which cut a large group where they must. Inside a part
    a window runs; what a group had in earlier parts is added. Only the first group of a part can go on
    from the part before, so what is broadcast has one row for each part of the shuffle at most. Rows
    that tie in ``order`` are numbered in any order. ``group`` must not be null.
    """
    ranged = save(df.repartitionByRange(group, *order).withColumn("part", F.spark_partition_id()), "ranged")
    firsts = ranged.groupBy("part").agg(F.min(group).alias(group)).select(group).distinct()
    totals = ranged.join(F.broadcast(firsts), group, "left_semi").groupBy(group, "part").agg(
        *[_aggregate(kind, column).alias(name) for name, (kind, column) in measures.items()]
    )
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        group, "part", *[_aggregate(kind, name).over(earlier).alias(f"{name}_before") for name, (kind, _) in measures.items()]
    ).filter(F.col(f"{next(iter(measures))}_before").isNotNull())
    here = Window.partitionBy("part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = ranged.select("*", *[_aggregate(kind, column).over(here).alias(name) for name, (kind, column) in measures.items()])
    found = found.join(F.broadcast(carried), [group, "part"], "left")
    whole = {
        name: JOINED[kind](F.col(name), F.coalesce(F.col(f"{name}_before"), F.lit(0)))
        for name, (kind, _) in measures.items()
    }
    return found.select(*[F.col(c) for c in df.columns], *[value.alias(name) for name, value in whole.items()])


def _aggregate(kind: str, column: str) -> Column:
    return F.sum(column) if kind == "sum" else F.bit_xor(column)
