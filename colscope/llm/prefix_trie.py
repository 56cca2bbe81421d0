"""Prefix tree of rebuilt conversations by collapse of whole sequences.

``rebuild`` makes the conversations: id c takes the first h turns of conversation c - c % 5 and then its own
turns after its first h, where h = crc32(decimal c) % 9. ``prefix_tree`` works on any conversations given
as ``conv_id, depth, turn_key, size``:

1. Equal whole sequences collapse into one, with a weight, the smallest id and the list of the ids that end
   there. From here on one conversation stands for its copies, however many there are.
2. A sequence that is a proper prefix of another is found by an anti-join; what is left are the leaves.
3. The prefixes of the weighted sequences are aggregated into nodes.

Sums over subtrees need no walk: a node's subtree holds the later turns of every sequence through it, each
counted for all of its members, less once for each distinct node; a distinct node is charged to the sequence
of its smallest id, and the nodes that a sequence is charged with are the last ones of its path. So the rows
grow with the turns of distinct sequences, never with depth times turns.

A prefix is known by its depth and 128 bits, the XOR of the hashes of (place, turn); a turn by 128 bits of
SHA-256 of role and text. Texts are read once and not shuffled. Places and prefixes are running aggregates
over range partitions, so a conversation of any length is spread over tasks. The ids that end at a node are
joined in runs of ``RUN`` and hashed as a stream.

Defined cases: null role and text are empty; a null turn number comes first; turns of one number are ordered by
their hash, repeated rows are repeated turns; rows without ``conv_id`` belong to no conversation and are left
out; a conversation that is rebuilt without turns is a member of the root alone; an empty table has no
members, hence no root and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.llm.common import save
from colscope.llm.ordered import running

#: Ids in a run of ends lie in a range of this size.
RUN = 1024
#: Conversations share the turns of the first of ``SHARED``; at most ``MOST`` - 1 turns of it.
SHARED, MOST = 5, 9


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, turn_key, size`` for each turn; places count from 1."""
    role, text = (f"coalesce(CAST({c} AS STRING), '')" for c in ("role", "text"))
    turns = conversations.filter("conv_id IS NOT NULL").selectExpr(
        "CAST(conv_id AS LONG) AS conv_id", "CAST(turn AS LONG) AS turn",
        f"unhex(left(sha2(concat(CAST(octet_length({role}) AS STRING), ':', {role}, {text}), 256), 32)) AS turn_key",
        f"CAST(octet_length({text}) AS LONG) AS size", "1L AS one",
    )
    return running(turns, "conv_id", ["turn", "turn_key"], {"place": ("sum", "one")}).select("conv_id", "place", "turn_key", "size")


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All ``conv_id``, and ``conv_id, depth, turn_key, size`` of the rebuilt conversations."""
    turns = save(turns_of(conversations), "turns")
    ids = turns.filter("place = 1").selectExpr(
        "conv_id", f"conv_id - conv_id % {SHARED} AS base", f"crc32(CAST(CAST(conv_id AS STRING) AS BINARY)) % {MOST} AS own_from"
    )
    heads = turns.filter(f"place < {MOST}").withColumnRenamed("conv_id", "base")
    sizes = heads.groupBy("base").agg(F.max("place").alias("held"))
    ids = save(ids.join(sizes, "base", "left").withColumn("taken", F.expr("least(own_from, coalesce(held, 0L))")), "ids")
    shared = ids.join(heads, "base").filter("place <= own_from").select("conv_id", F.col("place").alias("depth"), "turn_key", "size")
    own = turns.join(ids.select("conv_id", "own_from", "taken"), "conv_id").filter("place > own_from")
    own = own.selectExpr("conv_id", "place - own_from + taken AS depth", "turn_key", "size")
    return ids.select("conv_id"), shared.union(own)


def prefix_tree(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` for each node.

    ``ids`` has each ``conv_id`` once; ``turns`` has ``conv_id, depth, turn_key, size`` with depths from 1.
    """
    keyed = turns.selectExpr("*", "xxhash64(depth, turn_key) AS x", "xxhash64(turn_key, -depth) AS y")
    measures = {"p": ("bit_xor", "x"), "q": ("bit_xor", "y"), "upto": ("sum", "size")}
    prefixes = save(
        running(keyed.drop("turn_key"), "conv_id", ["depth"], measures).selectExpr(
            "conv_id", "depth", "p", "q", "p ^ x AS parent_p", "q ^ y AS parent_q", "size", "upto"
        ),
        "prefixes",
    )
    last = prefixes.groupBy("conv_id").agg(F.max(F.struct("depth", "p", "q", "upto")).alias("last"))
    wholes = save(
        ids.join(last, "conv_id", "left").selectExpr(
            "conv_id", *(f"coalesce(last.{c}, 0L) AS {c}" for c in ("depth", "p", "q")), "coalesce(last.upto, 0L) AS total"
        ),
        "wholes",
    )
    sequences = wholes.groupBy("depth", "p", "q").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("weight"), F.max("total").alias("total")
    )
    sequences = save(sequences, "sequences")
    parents = prefixes.join(sequences.select("conv_id"), "conv_id", "left_semi")
    proper = parents.selectExpr("depth - 1 AS depth", "parent_p AS p", "parent_q AS q").distinct()
    leaves = sequences.join(proper, ["depth", "p", "q"], "left_anti")
    sequences = save(sequences.join(leaves.selectExpr("conv_id", "1L AS leaf"), "conv_id", "left").fillna(0, ["leaf"]), "sequences")

    columns = ("conv_id", "depth", "p", "q", "parent_p", "parent_q", "size", "upto", "weight", "total", "leaf")
    root = sequences.selectExpr("conv_id", *(f"0L AS {c}" for c in columns[1:8]), *columns[8:])
    paths = prefixes.join(sequences.select("conv_id", "weight", "total", "leaf"), "conv_id").select(*columns)
    paths = save(paths.union(root), "paths")
    nodes = save(
        paths.groupBy("depth", "p", "q").agg(
            F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"),
            *(F.min(c).alias(c) for c in ("parent_p", "parent_q", "size")),
        ),
        "nodes",
    )
    charged = nodes.groupBy("conv_id").agg(F.min("depth").alias("charged_from"), F.sum("size").alias("charged"))
    later = "(total - upto + size)"
    once = f"CASE WHEN charged_from IS NULL THEN 0L WHEN depth <= charged_from THEN charged ELSE {later} END"
    saved = paths.join(charged, "conv_id", "left").groupBy("depth", "p", "q").agg(
        F.sum(F.expr(f"weight * {later} - {once}")).alias("saved_tokens")
    )
    below = nodes.filter("depth > 0")
    children = below.selectExpr("depth - 1 AS depth", "parent_p AS p", "parent_q AS q").groupBy("depth", "p", "q")
    children = children.agg(F.count("*").alias("n_children"))
    parents = nodes.selectExpr("depth + 1 AS depth", "p AS parent_p", "q AS parent_q", "conv_id AS parent_conv_id")
    linked = below.join(parents, ["depth", "parent_p", "parent_q"]).select(*nodes.columns, "parent_conv_id")
    linked = linked.union(nodes.filter("depth = 0").select("*", F.lit(None).cast("long")))
    key = ["depth", "p", "q"]
    found = linked.join(saved, key).join(children, key, "left").join(ends_of(wholes), key, "left")
    none = hashlib.sha256(b"").hexdigest()
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )


def ends_of(wholes: DataFrame) -> DataFrame:
    """``depth, p, q, ends_sha256``: SHA-256 of the decimal ids that end at a node, in order, joined by commas."""
    run = F.floor(F.col("conv_id") / RUN).cast("long").alias("run")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    runs = wholes.groupBy("depth", "p", "q", run).agg(joined.alias("ids"))
    ordered = runs.repartition("depth", "p", "q").sortWithinPartitions("depth", "p", "q", "run")
    return ordered.select("depth", "p", "q", "ids").mapInArrow(_hashed, "depth long, p long, q long, ends_sha256 string")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each stretch of rows of one node; only the hash of the open one is held."""
    names = ["depth", "p", "q", "ends_sha256"]
    key, state, done = None, None, []
    for batch in batches:
        for depth, p, q, ids in zip(*(column.to_pylist() for column in batch.columns)):
            if (depth, p, q) != key:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (depth, p, q), hashlib.sha256(ids.encode())
            else:
                state.update(b",")
                state.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=names)
            done = []
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], names=names)
