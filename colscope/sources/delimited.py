"""Delimited text as tables.

The schema is all text and explicit: names come from the heads of the files, types are decided value by
value later. A light pass over the lines finds the width, the longest record, and whether quoted fields hold line
breaks. Files without such fields go through Spark's CSV reader, those with lines to skip through its text reader, where
only the dropping of leading lines runs in Python, on whole Arrow batches. Where fields hold line breaks, records
are made from lines (``records``); such files stay splittable. Files whose headers differ meet by name.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.functions.cells import CELL_TYPE
from colscope.functions.numbers import localized_number, number_text
from colscope.functions.text import literal
from colscope.options import DelimitedOptions, Limits, ParsingMetadata
from colscope.sources.files import list_files
from colscope.sources import records
from colscope.sources.heads import (
    choose_delimiter,
    fallback_delimiter,
    file_heads,
    parse_lines,
    unique_headers,
)
from colscope.sources.table import Table

ORDER = ("_file", "_block", "_line")


def open_delimited(
    spark: SparkSession,
    path: str,
    options: DelimitedOptions | None = None,
    limits: Limits | None = None,
    widen: str = "full",
    multi_line: bool | None = None,
    max_record_bytes: int | None = None,
) -> Table:
    """Open one file, a folder or a glob of files.

    ``widen`` decides the width: ``sample`` takes the widest record of a preview, ``full`` the widest of all records, found
    by a light pass over the lines. That pass also finds line breaks inside quotes, which are part of the record
    unless ``multi_line`` is False; with True, or without the pass, Spark's own reader takes them, which cannot split files.
    With ``max_record_bytes``, a longer record fails, whatever columns are read.
    """
    options, limits = options or DelimitedOptions(), limits or Limits()
    if widen not in ("sample", "full"):
        raise ValueError("widen must be 'sample' or 'full'")
    if multi_line and options.skip_rows:
        raise ValueError("skip_rows cannot be combined with multi_line=True; leave it out to have both")
    files = list_files(spark, path)
    listed = files.agg(F.min("path"), F.sum("length"), F.count("path")).first()
    first, size, count = listed[0], listed[1] or 0, listed[2]
    if not count:
        raise FileNotFoundError(f"No files at {path}")

    wanted = limits.preview_rows + 1
    one = spark.createDataFrame([(first,)], "path string")
    head = file_heads(one, options, wanted).first()
    counts = {",": head["comma"], ";": head["semicolon"], "\t": head["tab"], "|": head["pipe"]}
    counts = {character: found for character, found in counts.items() if found is not None}
    detected = choose_delimiter(counts, fallback_delimiter(first))
    separator = options.separator or detected
    names, width = _layout(head, options, separator, limits)
    heads = file_heads(files, options, 0)
    layouts = _other_layouts(heads, head["header"], options, separator) if count > 1 else {}
    own = len(names)
    for other in layouts.values():
        names += [name for name in other if name not in names]
    dropped = _lines_to_drop(spark, heads)

    quotes = records.Quotes(separator, options.quote, options.escape)
    lines = records.read_lines(spark, path, options)
    made = None
    if (widen == "full" and not multi_line) or max_record_bytes is not None:
        summary = records.save_summary(records.summarize(lines, quotes, dropped))
        crosses, widest, longest = summary.agg(F.max("crosses"), F.max("width"), F.max("bytes")).first()
        if crosses and not multi_line and multi_line is not False:
            made = records.records(lines, quotes, dropped, summary)
            widest = records.widest(made, quotes)
            longest = made.agg(F.max(F.octet_length("value"))).first()[0]
        if max_record_bytes is not None and (longest or 0) > max_record_bytes:
            raise ValueError(f"A record exceeds the maximum of {max_record_bytes} bytes.")
        width = max(width, (widest or 0) if widen == "full" else 0)
    elif widen == "full":
        width = _full_width(spark, path, options, separator, width)
    raw_width = max([width, *map(len, layouts.values())])

    if made is not None:
        raw = _parsed(made, options, separator, raw_width)
    elif options.skip_rows:
        raw = _parsed(_kept_lines(lines, dropped), options, separator, raw_width)
    else:
        raw = _read_records(spark, path, options, separator, raw_width, bool(multi_line))
    if layouts:
        raw, width = _by_name(raw, heads, layouts, names, own, raw_width)
    names = names + [f"column_{i + 1}" for i in range(len(names), width)]
    cells = [f"{_cell_value(f'c{i}', options)} AS c{i}" for i in range(width)]
    return Table(
        df=raw.selectExpr(*cells, *ORDER),
        columns=tuple(names),
        order=ORDER,
        format="TSV" if first.lower().endswith(".tsv") else "CSV",
        path=path,
        size_bytes=size,
        total_columns=width,
        parsing=ParsingMetadata(detected, separator, options),
    )


def _header_names(header: str | None, options: DelimitedOptions, separator: str) -> list[str]:
    rows = parse_lines([header], options, separator) if header else []
    return unique_headers(rows[0] if rows else [])


def _other_layouts(heads: DataFrame, first: str | None, options: DelimitedOptions, separator: str) -> dict[str, list[str]]:
    """The names of each header that differs from the first file's. As many as there are different headers."""
    if options.header != "firstNonEmpty":
        return {}
    found = heads.filter("header IS NOT NULL").select("header").distinct().orderBy("header").collect()
    own = _header_names(first, options, separator)
    named = {r["header"]: _header_names(r["header"], options, separator) for r in found}
    return {header: names for header, names in named.items() if names != own}


def _by_name(
    raw: DataFrame, heads: DataFrame, layouts: dict, names: list[str], own: int, width: int
) -> tuple[DataFrame, int]:
    """Fields by the names of their file's header; the first file has the first ``own`` names. Fields beyond a header come
    after all names.

    The positions of the files with another header are broadcast: one row for each of these files, which the driver lists.
    """
    most = len(names) + max(width - len(x) for x in [names[:own], *layouts.values()])
    beyond = range(most - len(names))
    positions = {}
    for header, found in layouts.items():
        place = {name: i for i, name in enumerate(found)}
        positions[header] = [place.get(name, -1) for name in names] + [len(found) + i for i in beyond]
    usual = [i if i < own else -1 for i in range(len(names))] + [own + i for i in beyond]
    spark = raw.sparkSession
    table = spark.createDataFrame(list(positions.items()), "header string, at array<int>")
    odd = heads.join(F.broadcast(table), "header").selectExpr("xxhash64(path) AS _key", "at")
    given = raw.selectExpr(f"array({', '.join(f'c{i}' for i in range(width))}) AS f", "xxhash64(_file) AS _key", *ORDER)
    met = given.join(F.broadcast(odd), "_key", "left")
    columns = [f"get(f, IF(at IS NULL, {usual[i]}, at[{i}])) AS c{i}" for i in range(most)]
    return met.selectExpr(*columns, *ORDER), most


def _layout(head, options: DelimitedOptions, separator: str, limits: Limits) -> tuple[list[str], int]:
    """Names and true width from the sampled head."""
    rows = parse_lines([line for line in head["sample"] if line], options, separator)
    if options.header == "firstNonEmpty":
        names = _header_names(head["header"], options, separator)
    else:
        names = [f"column_{i + 1}" for i in range(len(rows[0]) if rows else 0)]
    width = len(names)
    for seen, row in enumerate(rows):
        width = max(width, len(row))
        if seen >= limits.head_rows(min(width, limits.max_columns)):
            break
    return names, width


def _reader_options(options: DelimitedOptions, separator: str) -> dict[str, str]:
    return {
        "sep": separator,
        "quote": options.quote,
        "escape": options.escape,
        "mode": "PERMISSIVE",
        "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false",
        "maxColumns": "200000",
        "unescapedQuoteHandling": "STOP_AT_DELIMITER",
    }


def _text_schema(width: int) -> str:
    return ", ".join(f"c{i} string" for i in range(width))


def _read_records(
    spark: SparkSession,
    path: str,
    options: DelimitedOptions,
    separator: str,
    width: int,
    multi_line: bool,
) -> DataFrame:
    reader = spark.read.schema(_text_schema(width)).options(**_reader_options(options, separator))
    reader = reader.option("recursiveFileLookup", "true").option("encoding", options.spark_encoding)
    reader = reader.option("header", str(options.header == "firstNonEmpty").lower())
    if multi_line:
        reader = reader.option("multiLine", "true")
    elif options.encoding == "utf16le":
        reader = reader.option("lineSep", "\n")
    fields = [f"c{i}" for i in range(width)]
    df = reader.csv(path).selectExpr(
        *fields,
        "_metadata.file_path AS _file",
        "_metadata.file_block_start AS _block",
        "monotonically_increasing_id() AS _line",
    )
    if options.encoding == "utf16le" and not multi_line:
        last = fields[-1]
        df = df.selectExpr(*fields[:-1], f"rtrim('\\r', {last}) AS {last}", *ORDER)
    return df


def _full_width(spark: SparkSession, path: str, options: DelimitedOptions, separator: str, known: int) -> int:
    """Largest field count over all records that Spark's own reader finds in files it may not split.

    One scan with room for twice the known width; only a record that fills it asks for another.
    """
    room = max(16, 2 * known)
    while True:
        reader = spark.read.schema(_text_schema(room)).options(
            **_reader_options(options, separator), recursiveFileLookup="true",
            encoding=options.spark_encoding, header="false", nullValue="\u0000", emptyValue="", multiLine="true",
        )
        fields = ", ".join(f"c{i}" for i in range(room))
        counted = reader.csv(path).selectExpr(f"size(array_compact(array({fields}))) AS n")
        found = max(known, counted.agg(F.max("n")).first()[0] or 0)
        if found < room:
            return found
        room *= 4


def _kept_lines(lines: DataFrame, dropped: records.Dropped) -> DataFrame:
    """``value`` and ``ORDER`` of the lines that are left when each split has dropped the leading lines that begin in it."""
    given = lines.selectExpr("rtrim('\r', value) AS value", "_key", "_file", "_block", "_length")
    kept = given.mapInArrow(_line_dropper(dropped), "value string, _file string, _block bigint").where("value <> ''")
    return kept.withColumn("_line", F.monotonically_increasing_id())


def _parsed(found: DataFrame, options: DelimitedOptions, separator: str, width: int) -> DataFrame:
    parse = {**_reader_options(options, separator), "multiLine": "true"}
    parsed = found.select(F.from_csv("value", _text_schema(width), parse).alias("fields"), *ORDER)
    return parsed.selectExpr("fields.*", *ORDER)


def _lines_to_drop(spark: SparkSession, heads: DataFrame) -> records.Dropped:
    """The usual number of leading lines to drop, and the files that differ, or whose lines may reach into a second split.

    One small record per such file reaches the driver, like Spark's own file listing. No split but the last of a file is
    shorter than the least of the two settings.
    """
    settings = spark._jsparkSession.sessionState().conf()  # sizes as numbers, defaults included
    shortest = min(settings.filesMaxPartitionBytes(), settings.filesOpenCostInBytes())
    counted = heads.selectExpr(
        "xxhash64(path) AS key", "size(starts) AS drop",
        f"IF(try_element_at(starts, -1) >= {shortest}, starts, NULL) AS starts",
    )
    groups = counted.groupBy("drop").count().orderBy(F.desc("count"), "drop").collect()
    usual = groups[0]["drop"]
    rows = counted.where(f"drop <> {usual} OR starts IS NOT NULL").collect()
    return records.Dropped(usual, {row["key"]: (row["drop"], row["starts"]) for row in rows})


def _line_dropper(dropped: records.Dropped):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        left: dict[tuple[int, int], int] = {}
        for batch in batches:
            for key, block, length, start, end in records.runs_of_splits(batch):
                if (key, block) not in left:
                    left[(key, block)] = dropped.in_split(key, block, length)
                skipped = min(left[(key, block)], end - start)
                left[(key, block)] -= skipped
                if skipped < end - start:
                    part = batch.slice(start + skipped, end - start - skipped)
                    names = ["value", "_file", "_block"]
                    yield pa.RecordBatch.from_arrays([part.column(name) for name in names], names=names)

    return run


def _cell_value(field: str, options: DelimitedOptions) -> str:
    """A field after null tokens and localized numbers."""
    value = f"nullif({field}, '')"
    if options.null_tokens:
        tokens = ", ".join(map(literal, options.null_tokens))
        value = f"IF({field} IN ({tokens}), NULL, {value})"
    if not options.localized:
        return value
    number = localized_number(field, options.decimal_separator, options.thousands_separator)
    cell = (
        f"transform(array({number}), n -> named_struct('kind', IF(n IS NULL, 's', 'n'), "
        f"'text', coalesce({number_text('n')}, {field}), 'num', n))[0]"
    )
    return f"CAST(IF({value} IS NULL, NULL, {cell}) AS {CELL_TYPE.simpleString()})"
