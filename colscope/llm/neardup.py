"""Near-duplicate documents by a chosen-path similarity join on minwise tokens.

Every distinct shingle set gets ``POSITIONS`` minwise tokens. A tree starts with all sets in its
root; a node sends each of its sets to the children named by the set's tokens at positions chosen for
that node, so two sets of similarity s go on together with probability s for each position. Nodes
with one set end. Nodes up to ``node_limit`` sets are compared exhaustively, inside one row. Larger
nodes compare every set with a few pivots. They stop as soon as all their sets are known to be
connected; if only a few sets remain outside, these are compared with the whole node; otherwise the
node branches again. Independent trees repeat this until the chance to miss a link at the
threshold is negligible. Comparisons of tokens only propose; every link is confirmed on full sets.

Exact copies of a set are one class from the start, so groups of copies cost one partial aggregate.

Defined cases: null or wordless text has no shingles and no links; fewer words than a shingle make
one shingle; a null ``doc_id`` is returned with a null component and not kept; rows that repeat a
``doc_id`` share one component; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.llm.common import id_and_text, map_rows, mix, save
from colscope.llm.components import connected_components

POSITIONS = 64
#: Levels of a tree; what is open below them is compared in full.
LEVELS = POSITIONS
#: Rows of the (shingles x positions) hash table that are held at once.
CHUNK = 4096
#: Sets of a large node that are compared together, and about how many shingles these have.
BLOCK, BLOCK_SHINGLES = 256, 1 << 18
#: Shingles in one incidence matrix.
COLUMNS = 8192


@dataclass(frozen=True)
class Settings:
    """Shingle words, similarity in percent, and the shape of the trees.

    A large node with few sets outside its largest component is compared with these in full; others
    branch. ``outsiders`` says how few, in the first ``early`` levels, which part unlike sets, and below,
    where nodes that are still large hold much alike sets. A node branches on ``100 / percent`` positions on average. ``slack`` standard deviations below the
    threshold, token comparisons still propose a pair.
    """

    words: int = 5
    percent: int = 80
    trees: int = 10
    node_limit: int = 24
    pivots: int = 3
    outsiders: tuple[int, int] = (64, 4096)
    early: int = 2
    slack: float = 5.0
    seed: int = 20240501

    @property
    def roots(self) -> np.ndarray:
        """The positions at which the roots branch, different ones for all trees while they last."""
        rng = np.random.default_rng(self.seed)
        wanted = sum(1 + int(rng.random() < 100 / self.percent - 1) for _ in range(self.trees))
        return np.concatenate([rng.permutation(POSITIONS) for _ in range(1 + wanted // POSITIONS)])[:wanted]

    @property
    def least_equal(self) -> int:
        """Equal tokens that make a pair worth confirming."""
        s = self.percent / 100
        return max(1, math.floor(POSITIONS * s - self.slack * math.sqrt(POSITIONS * s * (1 - s))))


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text, A-Z in lower case."""
    found = [] if text is None else text.lower().split()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    if not found:
        return hashes
    width = min(words, len(found))
    folded = np.full(len(found) - width + 1, width, np.uint64)
    for i in range(width):
        folded = mix(folded * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + len(folded)])
    return np.unique(folded)


def minwise(values: np.ndarray, seed: int) -> np.ndarray:
    """One 64-bit token per position: which shingle is the least under that position's hash."""
    rng = np.random.default_rng(seed)
    by_low, by_high = rng.integers(0, 1 << 32, (2, POSITIONS), np.uint32) | np.uint32(1)
    least = np.full(POSITIONS, np.iinfo(np.uint32).max, np.uint32)
    for start in range(0, len(values), CHUNK):
        part = values[start : start + CHUNK]
        low, high = part.astype(np.uint32)[:, None], (part >> np.uint64(32)).astype(np.uint32)[:, None]
        np.minimum(least, (low * by_low + high * by_high).min(axis=0), out=least)
    return mix(least.astype(np.uint64) + (np.arange(POSITIONS, dtype=np.uint64) << np.uint64(32)) + np.uint64(seed))


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    sketches = save(_sketches(docs, settings), "sketches")
    classes = save(
        sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("set_low", "set_high")
        .agg(F.min("doc_id").alias("id"), F.any_value("tag").alias("tag"), F.any_value("nodes").alias("nodes")),
        "classes",
    )
    repeated = save(sketches.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    of_one_id = sketches.join(repeated, "doc_id").join(classes.select("set_low", "set_high", "id"), ["set_low", "set_high"])
    shared = of_one_id.groupBy("doc_id").agg(F.min("id").alias("a"))
    shared = save(of_one_id.join(shared, "doc_id").select("a", F.col("id").alias("b")).filter("a <> b").distinct(), "shared")
    parts = similar_classes(docs, classes.select("id", "tag", "nodes"), settings, shared)
    named = save(
        classes.select("set_low", "set_high", "id")
        .join(parts, "id", "left")
        .select("set_low", "set_high", F.coalesce("component", "id").alias("component_id")),
        "named",
    )
    found = (
        sketches.select("doc_id", "n_shingles", "set_low", "set_high")
        .join(named, ["set_low", "set_high"], "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    )
    if not repeated.isEmpty():  # rows without words follow the other rows of their id
        least = found.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("least"))
        found = found.join(save(least, "least"), "doc_id", "left").withColumn("component_id", F.coalesce("least", "component_id"))
    return found.select(
        "doc_id", "n_shingles", "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def deduplicate(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that are kept, as they are; rows without id stay, of repeated rows one stays."""
    kept = near_duplicates(docs, settings).filter("kept").select("doc_id").distinct()
    found = docs.join(kept, "doc_id", "left_semi").select(docs.columns)
    if not docs.groupBy("doc_id").count().filter("doc_id IS NOT NULL AND count > 1").isEmpty():
        found = found.dropDuplicates(["doc_id", "text"])
    return found.union(docs.filter("doc_id IS NULL"))


def _sketches(docs: DataFrame, settings: Settings) -> DataFrame:
    """Set size, 128-bit digest of the set, one token byte per position, and the root's children."""
    roots = settings.roots
    salts = mix(np.arange(1, len(roots) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def rows(batch: dict) -> Iterable[tuple]:
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            values = shingles(text, settings.words)
            if not len(values):
                yield doc_id, 0, None, None, None, None
                continue
            digest = xxhash.xxh3_128_digest(values.tobytes())
            low, high = np.frombuffer(digest, np.int64).tolist()
            tokens = minwise(values, settings.seed)
            nodes = mix(tokens[roots] ^ salts).view(np.int64).tolist()
            yield doc_id, len(values), low, high, tokens.astype(np.uint8).tobytes(), nodes

    schema = "doc_id long, n_shingles long, set_low long, set_high long, tag binary, nodes array<long>"
    return map_rows(id_and_text(docs), schema, rows)


def similar_classes(docs: DataFrame, classes: DataFrame, settings: Settings, known: DataFrame) -> DataFrame:
    """``id, component`` of all classes (``id, tag, nodes``) that are linked to another one; ``known`` links count too."""
    members = classes.select("id", "tag", F.explode("nodes").alias("node"))
    sizes = save(members.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    small = _of_nodes(members, sizes.filter(F.col("n") <= settings.node_limit))
    large = save(_of_nodes(members, sizes.filter(F.col("n") > settings.node_limit), "n"), "large")
    proposed = save(_pairs_in_small(small, settings).union(_pairs_with_pivots(large, settings)).distinct(), "pairs")
    links, level = save(_confirmed(docs, proposed, settings).union(known), "links"), 0
    parts = connected_components(links)
    while not large.isEmpty() and level < LEVELS:
        named, counts = _unresolved(large, parts)
        early = (F.col("outside") <= settings.outsiders[0]) & (2 * F.col("outside") <= F.col("n"))
        few = early if level < settings.early else F.col("outside") <= settings.outsiders[1]
        if level + 1 == LEVELS:
            few = F.lit(True)
        more = save(_links_of_outsiders(docs, named, counts.filter(few), settings), "links")
        members = save(_branch(_of_nodes(named, counts.filter(~few)), level, settings), "members")
        sizes = save(members.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
        small = _of_nodes(members, sizes.filter(F.col("n") <= settings.node_limit))
        large = save(_of_nodes(members, sizes.filter(F.col("n") > settings.node_limit), "n"), "large")
        if not members.isEmpty():
            proposed = _pairs_in_small(small, settings).union(_pairs_with_pivots(large, settings)).distinct()
            more = save(more.union(_confirmed(docs, save(proposed, "pairs"), settings)), "links")
        if not more.isEmpty():
            links = save(links.union(more), "links")
            parts = connected_components(links)
        level += 1
    return parts


def _of_nodes(members: DataFrame, nodes: DataFrame, *more: str) -> DataFrame:
    return members.join(nodes.select("node", *more), "node").select("node", "id", "tag", *more, *set(members.columns) & {"component"})


def _pairs_in_small(members: DataFrame, settings: Settings) -> DataFrame:
    """All pairs of a small node with enough equal tokens; a node is one row of bounded size."""
    nodes = members.groupBy("node").agg(F.collect_list("id").alias("ids"), F.collect_list("tag").alias("tags"))
    least = settings.least_equal

    def rows(batch: dict) -> Iterable[tuple]:
        seen = set()
        for ids, tags in zip(batch["ids"], batch["tags"]):
            table = np.frombuffer(b"".join(tags), np.uint8).reshape(len(ids), POSITIONS)
            for i in range(len(ids) - 1):
                equal = (table[i + 1 :] == table[i]).sum(axis=1)
                for j in np.flatnonzero(equal >= least):
                    a, b = sorted((ids[i], ids[i + 1 + j]))
                    if a != b:
                        seen.add((a, b))
        yield from seen

    return map_rows(nodes.select("ids", "tags"), "a long, b long", rows)


def _pairs_with_pivots(members: DataFrame, settings: Settings) -> DataFrame:
    """Pairs of each set of a large node with the node's pivots, where enough tokens are equal."""
    ranks = [F.xxhash64(F.lit(settings.seed + k), "id") for k in range(settings.pivots - 1)] + [F.col("id")]
    least = [F.min(F.struct(rank.alias("rank"), "id", "tag")) for rank in ranks]
    pivots = members.groupBy("node").agg(F.array(*least).alias("pivots"))
    pivots = pivots.select("node", F.expr("pivots.id AS other_ids"), F.expr("pivots.tag AS other_tags"))
    return _compared(members, save(pivots, "pivots"), settings)


def _links_of_outsiders(docs: DataFrame, named: DataFrame, counts: DataFrame, settings: Settings) -> DataFrame:
    """Links across components in nodes where the sets outside the largest component are few enough.

    Every outsider meets every set of its node in full. Both sides come in blocks of bounded size; a
    pair of blocks is one row, compared by a product of incidence matrices.
    """
    members = save(_of_nodes(named, counts, "main"), "outsiders")
    members = members.drop("tag").join(_full_sets(docs, members.select("id"), settings), "id")
    weights = members.groupBy("node").agg(F.count("*").alias("n"), F.sum(F.size("shingles")).alias("total"))
    split = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES))
    members = members.join(weights.select("node", split.alias("blocks")), "node")
    members = members.withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    listed = lambda side: [F.collect_list(c).alias(f"{side}_{c}") for c in ("id", "component", "shingles")]
    left = members.filter("component <> main").groupBy("node", "block").agg(*listed("left")).drop("block")
    right = members.groupBy("node", "block").agg(*listed("right")).drop("block")

    def rows(batch: dict) -> Iterable[tuple]:
        names = [f"{side}_{c}" for side in ("left", "right") for c in ("id", "component", "shingles")]
        for ids, parts, values, other_ids, other_parts, other_values in zip(*(batch[c] for c in names)):
            alike = similar(values, other_values, settings.percent)
            alike &= np.array(parts)[:, None] != np.array(other_parts)[None, :]
            for i in range(len(ids)):
                reached = {other_parts[j]: other_ids[j] for j in np.flatnonzero(alike[i])}
                yield from ((ids[i], other) for other in reached.values())

    return map_rows(left.join(right, "node").drop("node"), "a long, b long", rows)


def similar(left: list[list[int]], right: list[list[int]], percent: int) -> np.ndarray:
    """Which sets of the two lists have a Jaccard similarity of at least ``percent``."""
    a, b = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(a, b)
    both = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, len(shared), COLUMNS):
        part = shared[start : start + COLUMNS]
        both += _incidence(a, left, part) @ _incidence(b, right, part).T
    sizes = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
    return 100 * both.astype(np.int64) >= percent * (sizes - both.astype(np.int64))


def _incidence(values: np.ndarray, sets: list[list[int]], vocabulary: np.ndarray) -> np.ndarray:
    table = np.zeros((len(sets), len(vocabulary)), np.float32)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    at = np.searchsorted(vocabulary, values).clip(max=len(vocabulary) - 1)
    found = vocabulary[at] == values
    table[owner[found], at[found]] = 1
    return table


def _compared(members: DataFrame, others: DataFrame, settings: Settings) -> DataFrame:
    """Pairs of members (``node, id, tag, n``) with their node's short list of others.

    A node's members are dealt into blocks, so a hot node spreads over many rows of bounded size.
    """
    block = F.pmod(F.xxhash64("id", "tag"), F.ceil(F.col("n") / BLOCK))
    blocks = members.groupBy("node", block.alias("block"))
    blocks = blocks.agg(F.collect_list("id").alias("ids"), F.collect_list("tag").alias("tags"))
    least = settings.least_equal

    def rows(batch: dict) -> Iterable[tuple]:
        seen = set()
        for ids, tags, other_ids, other_tags in zip(*(batch[c] for c in ("ids", "tags", "other_ids", "other_tags"))):
            table = np.frombuffer(b"".join(tags), np.uint8).reshape(len(ids), POSITIONS)
            for other, tag in zip(other_ids, other_tags):
                for i in np.flatnonzero((table == np.frombuffer(tag, np.uint8)).sum(axis=1) >= least):
                    if ids[i] != other:
                        seen.add((min(ids[i], other), max(ids[i], other)))
        yield from seen

    met = blocks.join(others, "node").select("ids", "tags", "other_ids", "other_tags")
    return map_rows(met, "a long, b long", rows)


def _full_sets(docs: DataFrame, ids: DataFrame, settings: Settings) -> DataFrame:
    """``id, shingles`` for the given ids. They are written first, so that few of them cost no shuffle of texts."""
    ids = save(ids.select(F.col("id").alias("doc_id")).distinct(), "ids")
    wanted = id_and_text(docs).join(ids, "doc_id", "left_semi")

    def rows(batch: dict) -> Iterable[tuple]:
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            yield doc_id, shingles(text, settings.words).view(np.int64).tolist()

    return save(map_rows(wanted, "id long, shingles array<long>", rows), "sets")


def _confirmed(docs: DataFrame, pairs: DataFrame, settings: Settings) -> DataFrame:
    """The pairs whose full sets meet the threshold, in whole numbers."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    sets = _full_sets(docs, ids, settings)
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("right"))
    both = F.size(F.array_intersect("left", "right"))
    either = F.size("left") + F.size("right") - both
    return pairs.join(left, "a").join(right, "b").filter(100 * both >= settings.percent * either).select("a", "b")


def _unresolved(large: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sets of large nodes with their components so far, and a row for each node that has several.

    Of these, ``main`` is the largest component, ``n`` the sets and ``outside`` those not in ``main``.
    """
    named = large.drop("n").join(parts, "id", "left")
    named = save(named.select("node", "id", "tag", F.coalesce("component", "id").alias("component")), "named")
    counts = named.groupBy("node", "component").agg(F.count("*").alias("k")).groupBy("node")
    counts = counts.agg(F.sum("k").alias("n"), F.max("k").alias("most"), F.max_by("component", F.struct("k", "component")).alias("main"))
    counts = counts.filter("most < n").select("node", "n", "main", (F.col("n") - F.col("most")).alias("outside"))
    return named, save(counts, "open")


def _branch(members: DataFrame, level: int, settings: Settings) -> DataFrame:
    """Children of large nodes: one or two positions for each node, chosen by its number."""
    permuted = F.pmod(F.xxhash64(F.lit(settings.seed + level), "node"), F.lit(POSITIONS)).cast("int")
    second = F.pmod(F.xxhash64(F.lit(settings.seed + level), "node", F.lit(1)), F.lit(1000)) < F.lit(
        round(1000 * (100 / settings.percent - 1))
    )
    offsets = F.when(second, F.array(F.lit(0), F.lit(POSITIONS // 2))).otherwise(F.array(F.lit(0)))
    chosen = members.select("node", "id", "tag", permuted.alias("first"), F.explode(offsets).alias("offset"))
    position = F.pmod(F.col("first") + F.col("offset"), F.lit(POSITIONS)).cast("int")
    token = F.substring(F.col("tag"), position + 1, F.lit(1))
    return chosen.select("id", "tag", F.xxhash64("node", position, token).alias("node"))
