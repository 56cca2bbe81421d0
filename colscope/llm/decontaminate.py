"""Benchmark passages in documents, found within a bounded edit distance.

Texts are compared in lower case with runs of white space as one space. An item of m characters may
differ by k = ``percent`` % of m edits, rounded down. Cut into k + 1 pieces, at least one piece of it
is unharmed wherever the item occurs with at most k edits. All pieces are searched at once by an
Aho-Corasick automaton; around each hit, Myers' bit-parallel algorithm gives the least edit distance
of the item to any part of the window.

Items come in blocks of at most ``BLOCK`` characters; a block and its automaton are all that a task
holds, and each block is one pass over the documents, written before the next one.

Defined cases: null and blank texts and items match nothing; equal items are all reported; an item
longer than a block has a block of its own; repeated rows and null ids are returned as they come,
also null item ids; an
empty benchmark contaminates nothing; an empty table gives an empty result; other columns are ignored,
``clean`` keeps them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.llm.common import decoded, id_and_text, map_rows, pieces, save

PERCENT = 5
BLOCK = 1 << 20


def plain(text: str) -> str:
    return " ".join(text.lower().split())


def least_distance(pattern: str, text: str) -> tuple[int, int]:
    """The least edit distance of ``pattern`` to any part of ``text``, and where the first such part ends."""
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    size = len(pattern)
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, distance = full, 0, size  # differences +1 and -1 between neighbouring rows of the table
    best, where = size, 0
    for place, c in enumerate(text):
        equal = masks.get(c, 0)
        vertical = equal | down
        diagonal = (((equal & up) + up) ^ up) | equal
        raised, lowered = down | (~(diagonal | up) & full), up & diagonal
        distance += bool(raised & top) - bool(lowered & top)
        raised, lowered = (raised << 1) & full, (lowered << 1) & full
        up, down = lowered | (~(vertical | raised) & full), raised & vertical
        if distance < best:
            best, where = distance, place + 1
    return best, where


class Block:
    """Items (``id, text``) with the automaton of their pieces."""

    def __init__(self, items: list[tuple[int, str]], percent: int) -> None:
        self.percent = percent
        self.ids: dict[str, list[int | None]] = defaultdict(list)
        for item, text in items:
            if plain(text):
                self.ids[plain(text)].append(item)
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[str, int, int]]] = defaultdict(list)
        for text in self.ids:
            budget = len(text) * percent // 100
            for k in range(budget + 1):
                start, end = k * len(text) // (budget + 1), (k + 1) * len(text) // (budget + 1)
                places[text[start:end]].append((text, start, budget))
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int | None, int, int]]:
        """``item, distance, end`` of the best occurrence of every item in a plain text, items without id first.

        The windows around the hits of an item are joined where they overlap, so no character is compared twice.
        """
        if not self.ids:
            return []
        starts: dict[str, set[int]] = defaultdict(set)
        for last, (size, places) in self.automaton.iter(text):
            for item, offset, _ in places:
                starts[item].add(last - size + 1 - offset)
        best = {}
        for item, found in starts.items():
            exact = min((s for s in found if s >= 0 and text.startswith(item, s)), default=None)
            if exact is not None:
                best[item] = 0, exact + len(item)
                continue
            budget = len(item) * self.percent // 100
            nearest = budget + 1, 0
            for low, high in joined((max(0, s - budget), s + len(item) + budget) for s in sorted(found)):
                distance, end = least_distance(item, text[low:high])
                nearest = min(nearest, (distance, low + end))
            if nearest[0] <= budget:
                best[item] = nearest
        found = [(i, *where) for item, where in best.items() for i in self.ids[item]]
        return sorted(found, key=lambda x: (x[0] is not None, x[0] or 0, *x[1:]))


def joined(windows: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Ordered windows, those that overlap as one."""
    open_window = None
    for low, high in windows:
        if open_window is None or low > open_window[1]:
            if open_window is not None:
                yield open_window
            open_window = low, high
        else:
            open_window = open_window[0], max(open_window[1], high)
    if open_window is not None:
        yield open_window


def blocks_of(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size."""
    block, size = [], 0
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text IS NOT NULL")
    for item, text in items.toLocalIterator():
        if block and size + len(text) > BLOCK:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text)
    if block:
        yield block


class _Lazy:
    """A block in each process that uses it, built from the broadcast items."""

    held: tuple | None = None

    @classmethod
    def get(cls, items, percent: int) -> Block:
        if cls.held is None or cls.held[0] != (items.id, percent):
            cls.held = (items.id, percent), Block(items.value, percent)
        return cls.held[1]


class _Items:
    """Broadcast items under a number that survives pickling."""

    def __init__(self, spark, items: list[tuple[int, str]]) -> None:
        self.broadcast = spark.sparkContext.broadcast(items)
        self.id = hash(tuple(items))

    @property
    def value(self) -> list[tuple[int, str]]:
        return self.broadcast.value


MATCHES = "array<struct<item_id: bigint, distance: bigint, end: bigint>>"


def find(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, matches`` for each row: items found, their distance, and their end in the plain text."""
    found = id_and_text(docs, F.expr(f"CAST(array() AS {MATCHES})").alias("matches"))
    blocks = blocks_of(benchmark)
    block = next(blocks, None)
    while block is not None:
        items, block = _Items(docs.sparkSession, block), next(blocks, None)
        found = _searched(found, items, percent, last=block is None)
        if block is not None:
            found = save(found, "searched")
    return found.select("doc_id", F.array_sort("matches").alias("matches"))


def _searched(found: DataFrame, items: _Items, percent: int, last: bool) -> DataFrame:
    """``matches`` with those of one block; the text stays for the next block only."""

    def rows(batch: dict) -> Iterable[tuple]:
        block = _Lazy.get(items, percent)
        for doc_id, text, before in zip(batch["doc_id"], batch["text"], batch["matches"]):
            here = block.matches(plain(decoded(text)))
            yield doc_id, None if last else text, before + [dict(zip(("item_id", "distance", "end"), x)) for x in here]

    return map_rows(found, f"doc_id long, text binary, matches {MATCHES}", rows)


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` in which no item is found, as they are."""
    blocks = blocks_of(benchmark)
    block = next(blocks, None)
    while block is not None:
        docs, block = _without(docs, _Items(docs.sparkSession, block), percent), next(blocks, None)
        if block is not None:  # one block and its automaton at a time
            docs = save(docs, "cleaned")
    return docs


def _without(docs: DataFrame, items: _Items, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Lazy.get(items, percent)
        for batch in batches:
            for part in pieces(batch):
                kept = [t is None or not block.matches(plain(t)) for t in part["text"].to_pylist()]
                yield part.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
