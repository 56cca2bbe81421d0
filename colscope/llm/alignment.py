"""Alignment of two tokenizations of the same bytes by skipping along diagonals.

Both tokenizers cut the same bytes; where both end a token, a group ends. From a common end on, the end
arrays are compared at the current shift between their indices, in stretches of doubling length; the last
stretch is halved to find where it breaks. So one-to-one stretches are jumped in slices. Where the ends differ, the two
sides are merged end by end until they meet again; that is one irregular group, which sets the new shift.
The merge also meets every pair of tokens that overlap: its links.

The tokenizers are A, byte-level BPE from a ``tokenizers`` file, run by tiktoken with the ids of that file as
ranks, and B, a ``sentencepiece`` model, which puts a space before the text itself. Long texts are cut before a
space between two other characters, about every ``STRETCH`` characters; no token of either side reaches over
such a place, so it is a common end too, and parts are aligned one by one. For the same reason the unit between two such
places is encoded once and memoised; alignment always runs over whole parts.

A pair of ids counts once for each document that holds it linked. The pairs of a document, each once, meet the
counts by an ordinary join on the pair, so nothing that grows with the corpus is broadcast by this code.

Defined cases: null and empty texts, and those whose joined tokens are not the text again (B cannot
tell U+2581 from a space), have no tokens, groups or links; repeated rows are documents of their own; null ids are
returned as they come; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colscope.llm.common import pieces, save

#: Characters after which a long text is cut at the next place that is safe.
STRETCH = 1 << 18
SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Memoised units, about; the memo starts anew when it is full. Units that are encoded in one string.
MEMO, TOGETHER = 400_000, 1000
#: A pair is the id of A times this plus the id of B.
B_IDS = 1 << 15


def diagonal_groups(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The groups in order as rows ``(i, j, n, m)``, and the links ``(i, j)`` inside irregular groups.

    ``a`` and ``b`` are the ascending ends of the tokens; the last ends are equal. With m = 0 a row is a
    stretch of n one-to-one groups from token i of A and j of B on, else one group of n tokens of A and m of B.
    """
    found: list[int] = []
    links: list[int] = []
    i = j = 0
    n_a = len(a)
    while i < n_a:
        if a[i] == b[j]:
            n, step = 1, 8
            while (here := a[i + n : i + n + step]) and here == b[j + n : j + n + step]:
                n += len(here)
                step *= 2
            while step > 1 and i + n < n_a:
                step //= 2
                here = a[i + n : i + n + step]
                if here == b[j + n : j + n + step]:
                    n += len(here)
            found += (i, j, n, 0)
            i, j = i + n, j + n
            continue
        from_a, from_b = i, j
        end_a, end_b = a[i], b[j]
        while end_a != end_b:
            links += (i, j)
            if end_a < end_b:
                i += 1
                end_a = a[i]
            else:
                j += 1
                end_b = b[j]
        links += (i, j)
        i, j = i + 1, j + 1
        found += (from_a, from_b, i - from_a, j - from_b)
    return np.array(found, np.int64).reshape(-1, 4), np.array(links, np.int64).reshape(-1, 2)


def ends_of_groups(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each group, stretches taken apart, where its tokens of A and of B end, and whether it is one-to-one."""
    i, j, n, m = groups.T
    straight = m == 0
    times = np.where(straight, n, 1)
    first = np.cumsum(times) - times
    shift_a, shift_b = i + np.where(straight, 1, n) - first, j + np.where(straight, 1, m) - first
    each = np.arange(first[-1] + times[-1])
    return each + np.repeat(shift_a, times), each + np.repeat(shift_b, times), np.repeat(straight, times)


def all_links(to_a: np.ndarray, to_b: np.ndarray, straight: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of A and of B of every link, from ``ends_of_groups`` and the links of irregular groups."""
    return np.concatenate([to_a[straight] - 1, links[:, 0]]), np.concatenate([to_b[straight] - 1, links[:, 1]])


def byte_level_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes and ids of a byte-level BPE file: each character of a token stands for a byte."""
    kept = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = (b for b in range(256) if b not in set(kept))
    byte_of = {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(moved)}
    file = json.loads(content)
    special = {x["content"] for x in file["added_tokens"]}
    return {bytes(byte_of[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in special}


class Pair:
    """Both tokenizers, with the bytes of their tokens."""

    held: tuple | None = None

    def __init__(self, file_a: bytes, file_b: bytes) -> None:
        ranks = byte_level_ranks(file_a)
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = [b""] * (1 + max(ranks.values()))
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_proto=file_b)
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        if len(self.bytes_b) > B_IDS or any(b" " in piece.lstrip(b" ") for piece in self.bytes_b):
            raise ValueError(f"B has more than {B_IDS} pieces, or one that reaches over the start of a word")
        self.units = Units(self)
        self.sizes = [np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b)]
        # Decimal ids and the mark behind them, filled up with zero bytes: two rows for each id, of A and then of B;
        # the second of the two ends its side of a group.
        names = [b"%d%s" % (i, mark) for side, last in ((self.bytes_a, b"|"), (self.bytes_b, b";")) for i in range(len(side)) for mark in (b",", last)]
        self.names = np.array(names).view(np.uint8).reshape(len(names), -1)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:-1], 16)])
        return b"" if self.b.is_control(i) else piece.replace("▁", " ").encode()

    @classmethod
    def get(cls, files) -> Pair:
        """The tokenizers of this process."""
        if cls.held is None or cls.held[0] != files.value:
            cls.held = files.value, cls(*files.value)
        return cls.held[1]

    def aligned(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, bytes, np.ndarray, np.ndarray]]:
        """For each text: tokens of A and of B, groups, the groups as text, the linked pairs, the links of each."""
        here: dict[str, int] = {}  # the units of these texts, numbered as they come
        cut = [
            [[here.setdefault(unit, len(here)) for unit in SAFE.split(part[1:])] for part in stretches(" " + text)] if text else []
            for text in texts
        ]
        if len(self.units.number) > MEMO:
            self.units = Units(self)
        numbers = self.units.add(here)
        for parts in cut:
            found = [self._part(numbers[units]) for units in parts]
            if not found or None in found:
                yield 0, 0, 0, b"", np.empty(0, np.int32), np.empty(0, np.int32)
                continue
            *counts, listed, codes = zip(*found)
            pairs, times = np.unique(np.concatenate(codes), return_counts=True)
            yield *map(sum, counts), b"".join(listed)[:-1], pairs.astype(np.int32), times.astype(np.int32)

    def _part(self, units: np.ndarray) -> tuple | None:
        """As ``aligned`` for a part of a text, with a code for each link; none if B is not the text again."""
        a, b = self.units.ids(units)
        if b.min() < 0:
            return None
        ends_a, ends_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        groups, links = diagonal_groups(ends_a.tolist(), ends_b.tolist())
        to_a, to_b, straight = ends_of_groups(groups)
        in_a, in_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        named = np.empty(len(a) + len(b), np.int64)
        named[np.arange(len(a)) + np.repeat(to_b - in_b, in_a)] = 2 * a
        named[np.arange(len(b)) + np.repeat(to_a, in_b)] = 2 * (b + len(self.bytes_a))
        named[to_a + to_b - in_b - 1] += 1
        named[to_a + to_b - 1] += 1
        listed = self.names[named].ravel()
        at_a, at_b = all_links(to_a, to_b, straight, links)
        return len(a), len(b), len(to_a), listed[listed != 0].tobytes(), a[at_a] * B_IDS + b[at_b]


class Units:
    """The ids of both sides for units of text, each unit once. A unit of -1 of B is not made by its tokens."""

    def __init__(self, pair: Pair) -> None:
        self.pair = pair
        self.number: dict[str, int] = {}
        self.flat = [np.empty(0, np.int64), np.empty(0, np.int64)]
        self.ends = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.held: tuple[list, list] = ([], [])
        self.held_ends: tuple[list, list] = ([], [])
        self.last = [0, 0]

    def ids(self, numbers: np.ndarray) -> Iterator[np.ndarray]:
        """Those of A and those of B for units in a row."""
        for flat, ends in zip(self.flat, self.ends):
            start, size = ends[numbers], ends[numbers + 1] - ends[numbers]
            before = np.cumsum(size) - size
            yield flat[np.repeat(start - before, size) + np.arange(before[-1] + size[-1])]

    def add(self, units: dict[str, int]) -> np.ndarray:
        """The numbers of the units."""
        fresh = [unit for unit in units if unit not in self.number]
        # Only the first and the last unit of a text can begin or end with a blank.
        plain = [unit for unit in fresh if not (unit[0].isspace() or unit[-1].isspace())]
        odd = [unit for unit in fresh if unit[0].isspace() or unit[-1].isspace()]
        together = [plain[k : k + TOGETHER] for k in range(0, len(plain), TOGETHER)] + [[unit] for unit in odd]
        while together:
            encoded = self.pair.b.encode([" ".join(some) for some in together], num_threads=1)
            apart: list[list[str]] = []
            for some, ids_b in zip(together, encoded):
                text = " " + " ".join(some)
                if b"".join(map(self.pair.bytes_b.__getitem__, ids_b)) == text.encode():
                    self._keep(some, self.pair.a.encode_ordinary(text), ids_b)
                elif len(some) == 1:
                    self._append(0, self.pair.a.encode_ordinary(text), [])
                    self._append(1, [-1], [])
                    self.number[some[0]] = len(self.number)
                else:
                    apart += [[unit] for unit in some]
            together = apart
        self._settle()
        return np.array(list(map(self.number.__getitem__, units)), np.int64)

    def _keep(self, units: list[str], *ids: list[int]) -> None:
        ends = np.cumsum([1 + len(unit.encode()) for unit in units])
        for side, found in enumerate(ids):
            last = np.searchsorted(np.cumsum(self.pair.sizes[side][found]), ends)
            self._append(side, found, (last[:-1] + 1).tolist())
        start = len(self.number)
        self.number.update(zip(units, range(start, start + len(units))))

    def _append(self, side: int, ids: list[int], cuts: list[int]) -> None:
        """Hold the ids of further units until ``_settle``; ``cuts`` are the ends of all units but the last."""
        self.held[side].append(np.array(ids, np.int64))
        self.held_ends[side].append(self.last[side] + np.array([*cuts, len(ids)], np.int64))
        self.last[side] += len(ids)

    def _settle(self) -> None:
        for side in (0, 1):
            self.flat[side] = np.concatenate([self.flat[side], *self.held[side]])
            self.ends[side] = np.concatenate([self.ends[side], *self.held_ends[side]])
        self.held, self.held_ends = ([], []), ([], [])


def stretches(text: str) -> list[str]:
    """The text in parts that both tokenizers treat as they treat the whole; each begins with a space."""
    parts, at = [], 0
    while cut := SAFE.search(text, at + STRETCH):
        parts.append(text[at : cut.start()])
        at = cut.start()
    return [*parts, text[at:]]


ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, groups string, pairs array<int>, times array<int>"
)


def align(docs: DataFrame, file_a: str, file_b: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, groups, pairs, times`` for each row.

    ``groups`` lists the ids of A and B: ``a1,a2|b1;a3|b2,b3``. ``pairs`` holds each linked pair of ids once, as
    ``a * B_IDS + b``, ``times`` its number of links.
    """
    contents = []
    for path in (file_a, file_b):
        with open(path, "rb") as file:
            contents.append(file.read())
    files = docs.sparkSession.sparkContext.broadcast(tuple(contents))  # the two vocabulary files

    def lists(arrays: list[np.ndarray]) -> pa.ListArray:
        offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_a", "n_b", "n_groups", "groups", "pairs", "times"]
        for batch in batches:
            for part in pieces(batch):
                found = list(zip(*Pair.get(files).aligned(part["text"].to_pylist())))
                numbers = [pa.array(x, pa.int64()) for x in found[:3]]
                groups = pa.array(found[3], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part["doc_id"], *numbers, groups, *map(lists, found[4:])], names=names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n_docs, best``: documents that hold a pair, and whether no other pair of its A id has more."""
    counted = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs"))
    of_a = Window.partitionBy(F.expr(f"pair DIV {B_IDS}"))  # as many rows as B has ids, at most
    return counted.withColumn("best", F.col("n_docs") == F.max("n_docs").over(of_a))


def alignments(docs: DataFrame, file_a: str, file_b: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, groups_sha256, n_links, n_best, count_sum`` for each row."""
    hashed = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("").alias("groups_sha256")
    aligned = align(docs, file_a, file_b).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", hashed, "pairs", "times"
    )
    aligned = save(aligned, "aligned")
    counts = pair_counts(aligned)
    links = aligned.select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("n"))))
    links = links.toDF("row", "pair", "n").join(counts.hint("shuffle_hash"), "pair")  # counts are the small side: no sort
    sums = links.groupBy("row").agg(
        F.sum("n").alias("n_links"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"),
        F.sum(F.col("n") * F.col("n_docs")).alias("count_sum"),
    )
    totals = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")]
    return aligned.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", *totals)
