"""Records of delimited text on files that are cut into splits, also where quoted fields hold line breaks.

A light pass over the lines learns how each split would leave the quotes: as they were, closed, open, or turned round.
These four effects follow each other along a file, so a window over the splits gives the state in which each split
begins; then the task of a split finds its first true record by itself. Lines without a quote pass by in
whole batches. The pass gives the number of fields and the bytes of the widest record too.

Where no record goes on over a line break, nothing else is needed. Otherwise lines become records in
the tasks that read them. What a split has of a record that began before it, and what it leaves open at its end, are a
fragment each; fragments are joined by record and are at most two for each split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colscope.functions.text import literal
from colscope.options import DelimitedOptions
from colscope.session import scratch_folder

FILE_KEY = "xxhash64(_metadata.file_path)"
#: Bytes of one record that goes on over line breaks: a quote that is never closed ends here with an error.
LONGEST_OPEN = 64 << 20


def read_lines(spark: SparkSession, path: str, options: DelimitedOptions) -> DataFrame:
    """``value, _key, _file, _block, _length``: lines as they are, without their line feed."""
    reader = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n")
    value = "value"
    if options.encoding != "utf8":
        reader = reader.option("encoding", options.spark_encoding)
        value = f"decode(CAST(value AS BINARY), '{options.spark_encoding}')"
    return reader.text(path).selectExpr(
        f"{value} AS value", f"{FILE_KEY} AS _key", "_metadata.file_path AS _file",
        "_metadata.file_block_start AS _block", "_metadata.file_block_length AS _length",
    )


@dataclass(frozen=True)
class Quotes:
    """How quotes act on the fields of a line."""

    separator: str
    quote: str
    escape: str

    @property
    def closing(self) -> re.Pattern:
        """From inside a quoted field to behind the quote that closes it."""
        q, e = re.escape(self.quote), re.escape(self.escape)
        if q == e:
            return re.compile(rf"[^{q}]*+(?:{q}{q}[^{q}]*+)*+{q}")
        return re.compile(rf"(?:[^{q}{e}]|{e}.)*+{q}", re.DOTALL)

    def reader(self):
        """``(line, inside) -> (inside after the line, fields that begin in it)``."""
        closing, separator, quote = self.closing, self.separator, self.quote

        def read(line: str, inside: bool) -> tuple[bool, int]:
            at, fields = 0, 0 if inside else 1
            while True:
                if inside or line.startswith(quote, at):
                    found = closing.match(line, at if inside else at + 1)
                    if found is None:
                        return True, fields
                    at, inside = found.end(), False
                at = line.find(separator, at) + 1
                if not at:
                    return False, fields
                fields += 1

        return read


@dataclass(frozen=True)
class Dropped:
    """How many leading lines each file loses. ``special`` holds files that differ from ``usual``, by key: the number, and
    the offsets of these lines where they may reach into a later split."""

    usual: int
    special: dict[int, tuple[int, list[int] | None]]

    def in_split(self, key: int, block: int, length: int) -> int:
        count, starts = self.special.get(key, (self.usual, None))
        if starts is None:
            return count if block == 0 else 0
        return sum(start == block == 0 or block < start <= block + length for start in starts)


def runs_of_splits(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int, int]]:
    """``(key, block, length, start, end)`` for each stretch of rows of one split."""
    keys, blocks, lengths = (np.asarray(batch.column(c)) for c in ("_key", "_block", "_length"))
    if not len(keys):
        return
    changes = np.flatnonzero((np.diff(keys) != 0) | (np.diff(blocks) != 0)) + 1
    edges = [0, *changes.tolist(), len(keys)]
    for start, end in zip(edges[:-1], edges[1:], strict=True):
        yield int(keys[start]), int(blocks[start]), int(lengths[start]), start, end


SUMMARY = (
    "_key bigint, _block bigint, from_outside boolean, from_inside boolean, crosses boolean, width bigint, bytes bigint"
)


def summarize(lines: DataFrame, quotes: Quotes, dropped: Dropped) -> DataFrame:
    """One row for each split: where it leaves the quotes if it begins outside or inside of them, whether a record that
    begins in it goes on over a line break, and the most fields and bytes of its other records."""
    quote, separator = literal(quotes.quote), literal(quotes.separator)
    marked = f"instr(value, {quote}) > 0 OR instr(rtrim('\\r', value), '\\r') > 0"
    given = lines.selectExpr(
        "_key", "_block", "_length", f"IF({marked}, value, NULL) AS marked",
        f"IF(value IN ('', '\\r'), 0, length(value) - length(replace(value, {separator}, '')) + 1) AS fields",
        "octet_length(value) AS bytes",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = quotes.reader()
        states: dict[tuple[int, int], list] = {}  # the splits of one task
        for batch in batches:
            for key, block, length, start, end in runs_of_splits(batch):
                state = states.get((key, block))
                if state is None:
                    state = states[key, block] = [False, True, False, 0, 0, dropped.in_split(key, block, length)]
                left = min(state[5], end - start)
                state[5] -= left
                part = batch.slice(start + left, end - start - left)
                if not part.num_rows:
                    continue
                marked, fields = part.column("marked"), np.asarray(part.column("fields"))
                plain = np.asarray(marked.is_null())
                state[3] = max(state[3], int(fields[plain].max(initial=0)))
                state[4] = max(state[4], int(np.asarray(part.column("bytes")).max(initial=0)))
                for line in marked.drop_null().to_pylist():
                    outside, inside = state[:2]
                    line = line.removesuffix("\r")
                    state[0], count = read(line, outside)
                    state[1] = state[0] if inside == outside else read(line, inside)[0]
                    state[2] |= state[0]
                    if "\r" in line:  # it ends lines too, unless it is quoted
                        found = [read(piece, outside) for piece in line.split("\r")]
                        state[2] |= any(open_ for open_, _ in found)
                        count = max(n for _, n in found)
                    state[3] = max(state[3], count)
        rows = [(*split, *state[:5]) for split, state in states.items()]
        if rows:
            names = [x.strip().split(" ")[0] for x in SUMMARY.split(",")]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)

    return given.mapInArrow(run, SUMMARY)


def starts_inside(summary: DataFrame) -> DataFrame:
    """``_key, _block`` of the splits that begin inside a quoted field."""
    earlier = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    turns = F.sum(F.expr("IF(from_outside AND NOT from_inside, 1, 0)")).over(earlier)
    told = summary.withColumn("turns", F.coalesce(turns, F.lit(0)))
    fixed = F.expr("IF(from_outside = from_inside, named_struct('open', from_outside, 'turns', turns), NULL)")
    told = told.withColumn("fixed", F.last(fixed, ignorenulls=True).over(earlier))
    return told.filter(
        "coalesce(fixed.open, false) <> ((turns - coalesce(fixed.turns, 0)) % 2 = 1)"
    ).select("_key", "_block")


def save_summary(summary: DataFrame) -> DataFrame:
    """The summary, written once: one row for each split."""
    return _saved(summary, "splits")


def _saved(df: DataFrame, name: str) -> DataFrame:
    path = f"{scratch_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ASSEMBLED = "value string, _file string, _key bigint, _block bigint, _line bigint, part string"


def records(lines: DataFrame, quotes: Quotes, dropped: Dropped, summary: DataFrame) -> DataFrame:
    """``value, _file, _block, _line``: records that may hold line breaks, without the dropped lines and blank ones.

    They are written once, below the shared scratch folder. Which splits begin inside a quoted field reaches all tasks: a
    pair of numbers for each such split, at most.
    """
    inside = {(r["_key"], r["_block"]) for r in starts_inside(summary).toLocalIterator()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.strip().split(" ")[0] for x in ASSEMBLED.split(",")]
        split, assembler = None, None
        for batch in batches:
            rows: list[tuple] = []
            files, values = batch.column("_file"), batch.column("value")
            for key, block, length, start, end in runs_of_splits(batch):
                if (key, block) != split:
                    rows += assembler.rest() if assembler else []
                    split = key, block
                    left = dropped.in_split(key, block, length)
                    assembler = Assembler(quotes, (files[start].as_py(), key, block), split in inside)
                skipped = min(left, end - start)
                left -= skipped
                rows += assembler.add(values.slice(start + skipped, end - start - skipped).to_pylist())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
        if assembler and (rows := assembler.rest()):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)

    columns = ("value", "_file", "_block", "_line")
    assembled = _saved(lines.mapInArrow(run, ASSEMBLED), "records")
    upto = Window.partitionBy("_key").orderBy("_block", "_line").rowsBetween(Window.unboundedPreceding, 0)
    fragments = assembled.filter("part <> 'whole'").withColumn("record", F.sum(F.expr("IF(part = 'tail', 1, 0)")).over(upto))
    ordered = "array_sort(collect_list(named_struct('_block', _block, '_line', _line, 'value', value)))"
    too_long = literal(f"A record exceeds {LONGEST_OPEN} characters: is a quote never closed?")
    joined = fragments.groupBy("_key", "record").agg(
        F.expr(f"IF(sum(length(value)) > {LONGEST_OPEN}, raise_error({too_long}), array_join(transform({ordered}, x -> x.value), '\n'))").alias("value"),
        F.min("_file").alias("_file"), F.expr("min(struct(_block, _line))").alias("at"),
    )
    return assembled.filter("part = 'whole'").select(*columns).union(
        joined.select("value", "_file", "at._block", "at._line")
    )


class Assembler:
    """Makes records of the lines of one split."""

    def __init__(self, quotes: Quotes, place: tuple[str, int, int], inside: bool) -> None:
        self.read, self.place = quotes.reader(), place
        self.inside = self.lead = inside  # lead: still in the record that began before the split
        self.held: list[str] = []
        self.line = self.start = self.size = 0

    def add(self, lines: list[str]) -> Iterator[tuple]:
        for line in lines:
            if self.line == 0 and self.place[2] == 0:
                line = line.removeprefix("\ufeff")
            text = line.removesuffix("\r")
            if not self.held:
                self.start = self.line
            self.line += 1
            if not text and not self.inside:
                continue
            self.inside, _ = self.read(text, self.inside)
            self.size += len(text)
            if self.size > LONGEST_OPEN:
                raise ValueError(f"A record exceeds {LONGEST_OPEN} characters: is a quote never closed?")
            self.held.append(line if self.inside else text)
            if not self.inside:
                yield self._row("lead" if self.lead else "whole")
                self.lead = False

    def rest(self) -> list[tuple]:
        """What is left open at the end of the split."""
        return [self._row("middle" if self.lead else "tail")] if self.held else []

    def _row(self, part: str) -> tuple:
        row = ("\n".join(self.held), *self.place, self.start, part)
        self.held, self.size = [], 0
        return row


def widest(found: DataFrame, quotes: Quotes) -> int:
    """The most fields of a record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = quotes.reader()
        for batch in batches:
            most = max((read(x, False)[1] for x in batch.column("value").to_pylist()), default=0)
            yield pa.RecordBatch.from_arrays([pa.array([most], pa.int64())], names=["n"])

    return found.select("value").mapInArrow(run, "n bigint").agg(F.max("n")).first()[0] or 0
