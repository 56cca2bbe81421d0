"""Workbooks (``.xlsx``, ``.xlsm``) as tables, and the safety audit of their archives.

A workbook cannot be split, so a file is read by one task and sent on in small batches of rows;
parallelism comes from many files. Files the audit rejects are never expanded.
"""

from __future__ import annotations

import datetime as dt
import io
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.functions.cells import CELL_TYPE
from colscope.options import Limits
from colscope.sources.files import (
    ScanLimitError,
    format_megabytes,
    list_files,
    open_random_access,
    per_file,
)
from colscope.sources.heads import unique_headers
from colscope.sources.table import Table

# Archive limits, namespaces and built-in date formats of workbooks.
MAX_ARCHIVE_ENTRIES = 10_000
MAX_COMPRESSION_RATIO = 1_000
RATIO_CHECK_MIN_BYTES = 10 * 1024 * 1024
WORKBOOK_PATTERN = "*.xls[xm]"
MAX_WORKBOOK_COLUMNS = 2000
BUILT_IN_DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])

ENTRY_SCHEMA = (
    "path string, position bigint, name string, compressed bigint, uncompressed bigint, "
    "encrypted boolean, error string"
)
ROW_SCHEMA = (
    "path string, sheet_no int, sheet string, row_no bigint, width int, "
    f"cells array<{CELL_TYPE.simpleString()}>"
)


class _ArchiveStream(io.RawIOBase):
    """A random-access stream that reports impossible positions as the zip reader expects."""

    def __init__(self, stream):
        self.stream = stream

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.stream.tell()

    def seek(self, offset: int, whence: int = 0) -> int:
        try:
            self.stream.seek(offset, whence)
        except ValueError as error:
            raise OSError(str(error)) from error
        return self.stream.tell()

    def readinto(self, buffer) -> int:
        data = self.stream.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def _open_archive(stream):
    import zipfile

    return zipfile.ZipFile(io.BufferedReader(_ArchiveStream(stream)))


# -- archive audit ------------------------------------------------------------------------------


def archive_entries(files: DataFrame) -> DataFrame:
    """Entries of every archive, from the central directories alone; nothing is expanded."""

    def read(uri: str) -> Iterator[dict]:
        import zipfile

        try:
            with open_random_access(uri) as stream, _open_archive(stream) as archive:
                for position, entry in enumerate(archive.infolist(), 1):
                    yield {
                        "path": uri, "position": position, "name": entry.filename,
                        "compressed": entry.compress_size, "uncompressed": entry.file_size,
                        "encrypted": bool(entry.flag_bits & 1), "error": None,
                    }
        except (zipfile.BadZipFile, OSError, ValueError) as error:
            yield {"path": uri, "position": 0, "error": str(error)}

    return per_file(files, read, ENTRY_SCHEMA)


def archive_audit(
    spark: SparkSession, path: str, max_expanded_mb: float | None = None, max_bytes: int | None = None
) -> DataFrame:
    """Verdict per workbook: ``(path, entries, expanded_bytes, verdict, reason)``.

    The reason is the first rule broken in archive order.
    """
    megabytes = Limits(max_workbook_expanded_mb=max_expanded_mb or 250).max_workbook_expanded_mb
    budget = int(max_bytes if max_bytes is not None else megabytes * 1024 * 1024)
    files = list_files(spark, path, WORKBOOK_PATTERN)
    entries = archive_entries(files).selectExpr(
        "*", "sum(uncompressed) OVER (PARTITION BY path ORDER BY position) AS expanded"
    )
    reason = (
        "CASE WHEN error IS NOT NULL THEN concat('Invalid Excel archive: ', error) "
        f"WHEN position > {MAX_ARCHIVE_ENTRIES} THEN 'too many archive entries' "
        "WHEN encrypted THEN 'encrypted ZIP entries are not supported' "
        f"WHEN uncompressed > {budget} THEN 'a single archive entry is too large' "
        f"WHEN expanded > {budget} THEN 'expanded workbook size exceeds the configured safety limit' "
        f"WHEN uncompressed >= {RATIO_CHECK_MIN_BYTES} AND compressed > 0 "
        f"AND uncompressed / compressed > {MAX_COMPRESSION_RATIO} THEN 'suspicious compression ratio' END"
    )
    judged = entries.selectExpr("*", f"{reason} AS reason").groupBy("path").agg(
        F.expr("max(position)").alias("entries"),
        F.expr("coalesce(sum(uncompressed), 0)").alias("expanded_bytes"),
        F.expr("min(IF(reason IS NOT NULL, struct(position, reason), NULL)).reason").alias("reason"),
    )
    # An archive without entries yields no entry rows; it is sound.
    return files.select("path").join(judged, "path", "left").selectExpr(
        "path", "coalesce(entries, 0) AS entries", "coalesce(expanded_bytes, 0) AS expanded_bytes",
        "IF(reason IS NULL, 'accepted', 'rejected') AS verdict", "reason",
    )


# -- reading one workbook inside a task ---------------------------------------------------------


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _column_number(reference: str) -> int:
    number = 0
    for character in re.match(r"[A-Z]+", reference).group():
        number = number * 26 + ord(character) - 64
    return number


def _text_of(element) -> str:
    """Text of a shared or inline string; the parts of rich text are joined, readings left out."""
    parts = []
    for child in element:
        if _local(child.tag) == "t":
            parts.append(child.text or "")
        elif _local(child.tag) == "r":
            parts += [t.text or "" for t in child if _local(t.tag) == "t"]
    return "".join(parts)


def _date_styles(archive) -> set[int]:
    """Indexes of the cell styles that show a number as a date."""
    from xml.etree import ElementTree

    if "xl/styles.xml" not in archive.namelist():
        return set()
    root = ElementTree.fromstring(archive.read("xl/styles.xml"))
    dated = set(BUILT_IN_DATE_FORMATS)
    for element in root.iter():
        if _local(element.tag) == "numFmt":
            code = re.sub(r'"[^"]*"|\\.|\[(?![hms]+\])[^\]]*\]', "", element.get("formatCode", ""))
            if re.search(r"[dmyhs]", code, re.IGNORECASE) and "General" not in code:
                dated.add(int(element.get("numFmtId")))
    for element in root:
        if _local(element.tag) == "cellXfs":
            return {i for i, xf in enumerate(element) if int(xf.get("numFmtId", 0)) in dated}
    return set()


def _sheets(archive) -> tuple[list[tuple[str, str]], bool]:
    """Names and parts of the worksheets in order, and whether dates count from 1904."""
    from xml.etree import ElementTree

    targets = {}
    for link in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels")):
        target = link.get("Target", "")
        part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        targets[link.get("Id")] = (part, link.get("Type", ""))
    found, from_1904 = [], False
    for element in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter():
        if _local(element.tag) == "workbookPr":
            from_1904 = element.get("date1904") in ("1", "true")
        elif _local(element.tag) == "sheet":
            identity = next((v for k, v in element.attrib.items() if _local(k) == "id"), None)
            part, kind = targets.get(identity, ("", ""))
            if kind.endswith("/worksheet"):
                found.append((element.get("name"), part))
    return found, from_1904


def _number_cell(value: float) -> dict:
    text = repr(value)
    if value.is_integer() and abs(value) < 1e21:
        text = str(int(value))
    elif "e" in text:
        mantissa, _, exponent = text.partition("e")
        power = int(exponent)
        if -7 < power < 21:
            text = f"{value:.{max(0, len(mantissa.replace('.', '').lstrip('-')) - 1 - power)}f}"
        else:
            text = f"{mantissa}e{power:+d}"
    return {"kind": "n", "text": text, "num": value}


def _cell(element, shared: list[str], dated: set[int], from_1904: bool) -> dict | None:
    """The value shown by a cell: results of formulas, joined rich text, error codes as text."""
    kind, raw = element.get("t", "n"), None
    for child in element:
        name = _local(child.tag)
        if name == "v":
            raw = child.text
        elif name == "is":
            raw, kind = _text_of(child), "str"
    if raw is None or raw == "":
        return None
    if kind == "s":
        raw = shared[int(raw)]
    if kind == "b":
        return {"kind": "b", "text": "true" if raw in ("1", "true") else "false", "num": None}
    if kind == "n":
        value = float(raw)
        if int(element.get("s", 0)) in dated:
            start = dt.datetime(1904, 1, 1) if from_1904 else dt.datetime(1899, 12, 30)
            moment = start + dt.timedelta(milliseconds=round(value * 86_400_000))
            text = moment.isoformat(timespec="milliseconds") + "Z"
            return {"kind": "s", "text": text, "num": None}
        return _number_cell(value)
    return {"kind": "s", "text": raw, "num": None} if raw else None


def read_workbook(uri: str) -> Iterator[dict]:
    """Non-empty rows of every sheet. ``width`` is the last used column, beyond the kept ones too."""
    from xml.etree import ElementTree

    with open_random_access(uri) as stream, _open_archive(stream) as archive:
        shared = []
        if "xl/sharedStrings.xml" in archive.namelist():
            for _, element in ElementTree.iterparse(archive.open("xl/sharedStrings.xml")):
                if _local(element.tag) == "si":
                    shared.append(_text_of(element))
                    element.clear()
        dated = _date_styles(archive)
        sheets, from_1904 = _sheets(archive)
        for sheet_no, (sheet, part) in enumerate(sheets):
            base = {"path": uri, "sheet_no": sheet_no, "sheet": sheet}
            yield {**base, "row_no": 0, "width": 0, "cells": []}
            row_no = 0
            for _, element in ElementTree.iterparse(archive.open(part)):
                if _local(element.tag) != "row":
                    continue
                row_no = int(element.get("r", row_no + 1))
                cells, width = {}, 0
                for item in element:
                    column = _column_number(item.get("r")) if item.get("r") else width + 1
                    value = _cell(item, shared, dated, from_1904)
                    width = max(width, column)
                    if value is not None and column <= MAX_WORKBOOK_COLUMNS:
                        cells[column] = value
                element.clear()
                if cells or width:
                    dense = [cells.get(i) for i in range(1, max(cells, default=0) + 1)]
                    yield {**base, "row_no": row_no, "width": width, "cells": dense}


# -- tables -------------------------------------------------------------------------------------


def workbook_rows(spark: SparkSession, path: str, limits: Limits | None = None) -> DataFrame:
    """Rows of all accepted workbooks: ``(path, sheet_no, sheet, row_no, width, cells)``.

    Every sheet also has one row numbered 0 without cells, so that empty sheets are listed.
    """
    limits = limits or Limits()
    cap = int(limits.max_workbook_mb * 1024 * 1024)
    small = list_files(spark, path, WORKBOOK_PATTERN).where(F.col("length") <= cap).select("path")
    sound = archive_audit(spark, path, limits.max_workbook_expanded_mb).where("verdict = 'accepted'")
    return per_file(small.join(sound.select("path"), "path", "left_semi"), read_workbook, ROW_SCHEMA)


def list_sheets(rows: DataFrame) -> DataFrame:
    """``(path, sheet_no, sheet, rows, columns)``: non-empty rows and the true column extent."""
    return rows.groupBy("path", "sheet_no", "sheet").agg(
        F.expr("count_if(size(cells) > 0)").alias("rows"), F.expr("max(width)").alias("columns")
    )


def open_workbook(
    spark: SparkSession, path: str, sheet: str | None = None, limits: Limits | None = None
) -> Table:
    """One sheet of one workbook; an unknown sheet name gives the first sheet."""
    limits = limits or Limits()
    size = list_files(spark, path).agg(F.sum("length")).first()[0] or 0
    if size > limits.max_workbook_mb * 1024 * 1024:
        raise ScanLimitError(
            f"This workbook is {format_megabytes(size)}. Increase max_workbook_mb to open it."
        )
    verdict = archive_audit(spark, path, limits.max_workbook_expanded_mb).first()
    if verdict and verdict["reason"]:
        reason = verdict["reason"]
        invalid = reason.startswith("Invalid Excel archive")
        raise ScanLimitError(reason if invalid else f"Workbook rejected for safety: {reason}.")
    rows = per_file(list_files(spark, path), read_workbook, ROW_SCHEMA)
    sheets = list_sheets(rows).orderBy("sheet_no").collect()
    if not sheets:
        raise ValueError("The workbook does not contain a worksheet.")
    chosen = next((s for s in sheets if s["sheet"] == sheet), sheets[0])
    rows = rows.where((F.col("sheet_no") == chosen["sheet_no"]) & (F.col("row_no") > 0))
    header = rows.where("size(cells) > 0").orderBy("row_no").limit(1).collect()
    width = min(chosen["columns"], limits.max_columns)
    texts = [cell["text"] if cell else None for cell in header[0]["cells"]] if header else []
    names = unique_headers((texts + [None] * width)[:width]) if header else []
    cells = [f"get(cells, {i}) AS c{i}" for i in range(len(names))]
    present = " OR ".join(f"c{i} IS NOT NULL" for i in range(len(names))) or "FALSE"
    first_row = header[0]["row_no"] if header else 0
    data = rows.where(F.col("row_no") > first_row).selectExpr(*cells, "row_no AS _row_index")
    return Table(
        df=data.where(present),
        columns=tuple(names),
        order=("_row_index",),
        format="EXCEL",
        path=path,
        size_bytes=size,
        total_columns=chosen["columns"],
        sheet=chosen["sheet"],
        sheets=tuple(s["sheet"] for s in sheets),
    )
