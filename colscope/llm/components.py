"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.llm.common import save


def connected_components(links: DataFrame) -> DataFrame:
    """``id, component`` for every end of a link; the component is its smallest id.

    ``links`` has long columns ``a`` and ``b``; order, repeats, loops and nulls do not matter. Large
    and small stars alternate: each round hangs the neighbours of a node on its smallest neighbour,
    so the depth shrinks fast on chains too. Hot nodes meet partial aggregates and joins that Spark
    splits, never one group in one task.
    """
    edges = save(
        links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        edges = save(_star(_star(both, edges_of="larger"), edges_of="all"), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    found = edges.select(F.col("b").alias("id"), F.col("a").alias("component"))
    return found.union(edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())


def _star(edges: DataFrame, edges_of: str) -> DataFrame:
    """Links (smaller a, larger b) after one star step.

    ``larger``: ``edges`` holds both directions; the larger neighbours of a node move to the smallest
    of the node and its neighbours. ``all``: ``edges`` points from smaller a to larger b; the node b
    and all its smaller neighbours move to the smallest neighbour.
    """
    if edges_of == "larger":
        least = edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        moved = edges.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
    else:
        least = edges.groupBy("b").agg(F.min("a").alias("m"))
        moved = edges.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b"))
        moved = moved.union(least.select(F.col("m").alias("a"), "b"))
    return moved.filter("a <> b").distinct()
