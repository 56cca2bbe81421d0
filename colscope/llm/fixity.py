"""Fixity audit of archive replicas by Merkle trees over offset ranges.

A record is a leaf: SHA-256 of its bytes; only lengths and hashes are shuffled. The lowest nodes cover ``RANGE`` bytes
of an archive, by the offset at which a record starts; a node hashes its ordered offsets, lengths and record hashes. Every
further level joins ``FANOUT`` neighbouring ranges, up to one root for an archive. Node numbers follow
from offsets alone, so a huge archive is spread over tasks like many small ones, and a node has few
children. Records that share an offset are summed first, so that a range lists an offset once. The audit compares roots and
then, level by level, only the children of unequal nodes; where ranges differ, their records are compared.

Defined cases: a null record hashes as no bytes; a null archive is an archive of its own; null offsets
count as offset -1, however many; of repeated rows as many match as both sides have, what is left at an offset is paired
as ``corrupt`` in the order of the hashes, then ``extra`` or ``missing``; two empty replicas give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.llm.common import save
from colscope.llm.ordered import running

RANGE, FANOUT = 1 << 16, 64


def leaves(records: DataFrame) -> DataFrame:
    """``archive, offset, length, sha256`` for each of ``archive, offset, record``."""
    record = F.coalesce(F.col("record"), F.lit("").cast("binary")).cast("binary")
    return records.select(
        F.concat(F.lit("="), F.col("archive").cast("string")).alias("archive"),
        F.coalesce(F.col("offset").cast("long"), F.lit(-1)).alias("offset"),
        F.octet_length(record).cast("long").alias("length"),
        F.sha2(record, 256).alias("sha256"),
    ).withColumn("archive", F.coalesce("archive", F.lit("none")))


def ranges(found: DataFrame) -> DataFrame:
    """The lowest nodes: ``archive, node, sha256``."""
    lanes = [F.conv(F.substring("sha256", 1 + 14 * k, 14), 16, 10).cast("decimal(38,0)") for k in range(4)]
    offsets = found.groupBy("archive", "offset").agg(
        F.count("*").alias("n"), F.sum("length").alias("length"), F.min("sha256").alias("sha256"),
        *[F.sum(lane).cast("string").alias(f"lane{k}") for k, lane in enumerate(lanes)],
    )
    summed = F.when(F.col("n") == 1, F.col("sha256")).otherwise(F.concat_ws("+", F.col("n").cast("string"), *[f"lane{k}" for k in range(4)]))
    line = F.concat_ws(":", F.lpad(F.col("offset").cast("string"), 20, " "), "length", summed)
    listed = F.array_join(F.array_sort(F.collect_list(line)), ",")
    return offsets.groupBy("archive", F.floor(F.col("offset") / RANGE).alias("node")).agg(F.sha2(listed, 256).alias("sha256"))


def parents(nodes: DataFrame) -> DataFrame:
    """The nodes one level up."""
    line = F.concat_ws(":", F.lpad(F.col("node").cast("string"), 20, " "), "sha256")
    listed = F.array_join(F.array_sort(F.collect_list(line)), ",")
    return nodes.groupBy("archive", F.floor(F.col("node") / FANOUT).alias("node")).agg(F.sha2(listed, 256).alias("sha256"))


def _unequal(left: DataFrame, right: DataFrame) -> DataFrame:
    """Nodes that only one side has or that differ."""
    other = right.withColumnRenamed("sha256", "other")
    return left.join(other, ["archive", "node"], "full").filter("NOT (sha256 <=> other)").select("archive", "node")


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """``archive, offset, length, status`` for each record of two replicas (``archive, offset, record``).

    ``status`` is match, corrupt (bytes differ at an offset), missing (only left has the record) or extra
    (only right has it). Records under equal nodes match without being compared.
    """
    return audit_leaves(*[save(leaves(x), "leaves") for x in (left, right)])


def audit_leaves(left: DataFrame, right: DataFrame) -> DataFrame:
    """``audit`` of the ``leaves`` of two replicas, which are read several times."""
    sides = [left, right]
    levels = [[save(ranges(x), "nodes") for x in sides]]
    highest = max((x.agg(F.max("offset")).first()[0] or 0 for x in sides), default=0)
    span = RANGE
    while span <= highest:
        levels.append([save(parents(x), "nodes") for x in levels[-1]])
        span *= FANOUT
    open_nodes = save(_unequal(*levels[-1]), "unequal")
    for level in reversed(levels[:-1]):
        parent = F.floor(F.col("node") / FANOUT)
        wanted = open_nodes.select("archive", F.col("node").alias("parent"))
        below = [x.withColumn("parent", parent).join(wanted, ["archive", "parent"], "left_semi").drop("parent") for x in level]
        open_nodes = save(_unequal(*below), "unequal")
    return _records(*sides, open_nodes)


def _records(left: DataFrame, right: DataFrame, open_nodes: DataFrame) -> DataFrame:
    node = F.floor(F.col("offset") / RANGE)
    marked = open_nodes.withColumn("open", F.lit(True))
    left, right = (x.withColumn("node", node).join(marked, ["archive", "node"], "left") for x in (left, right))
    equal = left.filter("open IS NULL").select("archive", "offset", "length", F.lit("match").alias("status"))
    columns = ("archive", "offset", "length", "sha256")
    both = [x.filter("open").select(*columns, F.lit(side).alias("side")) for x, side in ((left, "ours"), (right, "theirs"))]
    both = both[0].union(both[1]).withColumn("tie", F.monotonically_increasing_id())
    content = F.concat_ws(":", "side", "archive", "offset", "length", "sha256")
    ours, theirs = _numbered(save(both, "open"), content, ["tie"])
    same = [*columns, "k"]
    met = ours.select(*same).join(theirs.select(*same), same, "left_semi")
    rest = ours.join(theirs.select(*same), same, "left_anti").union(theirs.join(ours.select(*same), same, "left_anti"))
    place = F.concat_ws(":", "side", "archive", "offset")
    ours, theirs = _numbered(save(rest.drop("k"), "rest"), place, ["sha256", "length", "tie"])
    ours = ours.select("archive", "offset", "k", F.col("length").alias("our_length"))
    theirs = theirs.select("archive", "offset", "k", F.col("length").alias("their_length"))
    status = F.when(F.col("their_length").isNull(), "missing").when(F.col("our_length").isNull(), "extra").otherwise("corrupt")
    odd = ours.join(theirs, ["archive", "offset", "k"], "full").select(
        "archive", "offset", F.coalesce("our_length", "their_length").alias("length"), status.alias("status")
    )
    found = equal.union(met.select("archive", "offset", "length", F.lit("match"))).union(odd)
    return found.withColumn("archive", F.expr("CASE WHEN archive <> 'none' THEN substring(archive, 2) END"))


def _numbered(rows: DataFrame, group: Column, order: list[str]) -> list[DataFrame]:
    """The rows of each side with their number ``k`` in the group; groups may be of any size."""
    keyed = rows.withColumn("group", group).withColumn("one", F.lit(1).cast("long"))
    found = save(running(keyed, "group", order, {"k": ("sum", "one")}).drop("group", "one"), "numbered")
    return [found.filter(F.col("side") == side) for side in ("ours", "theirs")]
