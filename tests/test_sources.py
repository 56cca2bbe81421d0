import os
import random
import zipfile

import pytest

from colscope.operators.metadata import profile_note, table_summary
from colscope.options import DelimitedOptions, Limits
from colscope.sources.delimited import open_delimited
from colscope.sources.files import ScanLimitError
from colscope.sources.heads import count_outside_quotes, detect_delimiters, unique_headers
from colscope.sources.open import is_supported, open_table, preview, profile_table
from colscope.sources.parquet import footer_audit
from colscope.sources.workbook import archive_audit, list_sheets, workbook_rows
from tests.workbooks import write_workbook


def write(folder, name, content):
    path = os.path.join(folder, name)
    with open(path, "wb") as out:
        out.write(content if isinstance(content, bytes) else content.encode())
    return path


def rows(table):
    return [tuple(r) for r in table.data().collect()]


def texts(table):
    return [tuple(None if v is None else v["text"] if hasattr(v, "asDict") else v for v in r) for r in rows(table)]


def test_formats():
    assert is_supported("/a/B.CSV") and is_supported("x.XLSM") and not is_supported("x.json")
    assert is_supported("/data/*.parquet")


def test_wide_and_budget(spark, tmp_path):
    header = ",".join(f"c{i}" for i in range(12))
    path = write(tmp_path, "wide.csv", f"{header}\n{','.join(map(str, range(12)))}\n")
    shown = preview(open_table(spark, path, limits=Limits(max_columns=10)))
    assert len(shown.table.columns) == 10 and shown.table.width == 12 and shown.truncated_columns
    assert Limits(preview_rows=5000).head_rows(500) == 500


def test_late_wide_record_widens_the_preview(spark, tmp_path):
    lines = "\n".join(map(str, range(600)))
    path = write(tmp_path, "late.csv", f"first\n{lines}\n{','.join(map(str, range(40)))}\n")
    table = open_table(spark, path, limits=Limits(preview_rows=5000))
    assert len(table.columns) == 40 and table.columns[:2] == ("first", "column_2")
    assert table.df.where("c39 = '39'").count() == 1


def test_quoted_preview_and_full_profile(spark, tmp_path):
    people = "\n".join(f'"Person, {i}",{i},{str(i % 2 == 0).lower()}' for i in range(105))
    shown = preview(open_table(spark, write(tmp_path, "people.csv", f"name,score,active\n{people}\n")), Limits(preview_rows=100))
    assert shown.row_count == 100 and shown.truncated_rows and shown.total_rows is None and shown.scope == "preview"
    assert shown.table.df.first()["c0"] == "Person, 0" and shown.profile.types == ("text", "number", "boolean")
    assert shown.profile.warnings.count() == 0
    assert profile_note(shown.profile) == "Based on preview · 100 rows · 3 columns"
    assert table_summary(shown.table, shown).first()["rows"] == "100+ rows"

    classes = "\n".join(f"{i},{'early' if i < 500 else 'late'}" for i in range(750))
    table = open_table(spark, write(tmp_path, "classes.csv", f"id,class\n{classes}\n"))
    assert preview(table, Limits(preview_rows=100)).profile.profiles.collect()[1].distinct == 1
    full = profile_table(table)
    assert full.row_count == 750
    assert [tuple(t) for t in full.profiles.collect()[1].top_values] == [("early", 500), ("late", 250)]


def test_parsing_settings(spark, tmp_path):
    localized = write(tmp_path, "localized.csv", "Generated report\nname;amount;note\nAda;1.234,50;NA\nGrace;25,75;ok\n")
    options = DelimitedOptions(
        delimiter="semicolon", skip_rows=1, null_tokens=("NA",), decimal_separator="comma", thousands_separator="dot"
    )
    table = open_table(spark, localized, options=options)
    assert table.columns == ("name", "amount", "note") and table.parsing.detected_delimiter == ";"
    assert texts(table) == [("Ada", "1234.5", None), ("Grace", "25.75", "ok")]
    assert profile_table(table).types == ("text", "number", "text")

    headerless = write(tmp_path, "headerless.csv", "Ada|36\nGrace|85\n")
    table = open_table(spark, headerless, options=DelimitedOptions(delimiter="custom", custom_delimiter="|", header="none"))
    assert table.columns == ("column_1", "column_2") and rows(table) == [("Ada", "36"), ("Grace", "85")]

    quoted = write(tmp_path, "quoted.csv", "name;note\nAda;'can\\'t stop'\n")
    table = open_table(spark, quoted, options=DelimitedOptions(delimiter="semicolon", quote="'", escape="\\"))
    assert rows(table) == [("Ada", "can't stop")]


@pytest.mark.parametrize("skip", [0, 3])
@pytest.mark.parametrize("encoding, bom, codec", [("utf16le", b"\xff\xfe", "utf-16-le"), ("latin1", b"", "latin-1"), ("utf8", b"\xef\xbb\xbf", "utf-8")])
def test_encodings_and_skipped_lines(spark, tmp_path, encoding, bom, codec, skip):
    head = "intro\n\nmore\n" if skip else ""
    path = write(tmp_path, "t.csv", bom + (head + "name;city\n\nAndré;Zürich\n").encode(codec))
    table = open_table(spark, path, options=DelimitedOptions(encoding=encoding, skip_rows=skip))
    assert table.columns == ("name", "city") and rows(table) == [("André", "Zürich")]


def test_skipped_lines_across_splits_and_files(spark, tmp_path):
    rng = random.Random(1)
    total = 0
    for n in range(4):
        lines = ["preamble"] * 3 + ["key;value"] + [f"{n * 10000 + i};{'v' * rng.randrange(60)}" for i in range(3000 * (n + 1))]
        total += 3000 * (n + 1)
        write(tmp_path, f"part-{n}.csv", "\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        table = open_delimited(spark, str(tmp_path), DelimitedOptions(skip_rows=3, delimiter="semicolon"))
        assert table.df.rdd.getNumPartitions() > 4
        assert table.df.count() == total
        assert table.df.where("c0 = 'key' OR c0 = 'preamble'").count() == 0
        assert table.df.selectExpr("count(DISTINCT c0)").first()[0] == total
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.fixture()
def splits(spark):
    """Sets the size of splits for one test."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {name: spark.conf.get(name) for name in names}

    def change(size):
        for name in names:
            spark.conf.set(name, str(size))

    yield change
    for name, value in old.items():
        spark.conf.set(name, value)


def test_skipped_part_spanning_splits(spark, tmp_path, splits):
    lines = [f"skip {i} {'x' * 40}" for i in range(500)] + ["key"] + [str(i) for i in range(4000)]
    path = write(tmp_path, "big.csv", "\n".join(lines) + "\n")
    splits(5000)
    table = open_delimited(spark, path, DelimitedOptions(skip_rows=500, delimiter="comma"))
    assert sorted(int(r[0]) for r in rows(table)) == list(range(4000))
    lines = ['odd " quote'] * 7 + ["key"] + [str(i) for i in range(30)]
    path = write(tmp_path, "small.csv", "\n".join(lines) + "\n")
    splits(64)
    table = open_delimited(spark, path, DelimitedOptions(skip_rows=7, delimiter="comma"))
    assert sorted(int(r[0]) for r in rows(table)) == list(range(30))


@pytest.mark.parametrize("size", [48, 1000])
@pytest.mark.parametrize("skip", [0, 3])
def test_line_breaks_in_quotes_by_default(spark, tmp_path, splits, size, skip):
    rng = random.Random(size + skip)
    cells = ["plain", "two\nlines", 'a "quoted" word', "", "x,y", "long " * 30 + "\n\n" + "end", "c\r\nd", "é\n", '5" pipe']
    expected, text = [], 'intro "\n\nmore\n' if skip else ""
    text += 'id,"first\nname",note\n'
    for i in range(24):
        row = [str(i), rng.choice(cells), rng.choice(cells)]
        expected.append(tuple(x or None for x in row))
        quoted = [f'"{x.replace(chr(34), chr(34) * 2)}"' if rng.random() < 0.3 or any(c in x for c in ',\n\r') or x.startswith(chr(34)) else x for x in row]
        text += ",".join(quoted) + rng.choice(["\n", "\r\n", "\n\n"])
    path = write(tmp_path, "t.csv", text)
    splits(size)
    table = open_delimited(spark, path, DelimitedOptions(delimiter="comma", skip_rows=skip))
    assert table.columns == ("id", "first\nname", "note")
    assert sorted(rows(table), key=lambda r: int(r[0])) == expected
    assert [r[0] for r in table.df.orderBy(*table.order).collect()] == [str(i) for i in range(24)]


def test_other_escapes_and_encodings_with_line_breaks(spark, tmp_path, splits):
    splits(40)
    text = "name;note\nAda;'can\\'t\nstop; here'\nBob;'x'\n"
    table = open_delimited(spark, write(tmp_path, "e.csv", text), DelimitedOptions(delimiter="semicolon", quote="'", escape="\\"))
    assert sorted(rows(table)) == [("Ada", "can't\nstop; here"), ("Bob", "x")]
    for encoding, codec in (("latin1", "latin-1"), ("utf16le", "utf-16-le")):
        path = write(tmp_path, f"{encoding}.csv", 'a,b\n1,"Zürich\nBern"\n2,"é"\n'.encode(codec))
        assert sorted(rows(open_delimited(spark, path, DelimitedOptions(encoding=encoding)))) == [("1", "Zürich\nBern"), ("2", "é")]


def test_a_quote_that_is_never_closed(spark, tmp_path, monkeypatch):
    path = write(tmp_path, "open.csv", 'a,b\n1,"open\n2,x\n')
    assert rows(open_delimited(spark, path)) == [("1", "open\n2,x\n")] or rows(open_delimited(spark, path)) == [("1", "open\n2,x")]
    monkeypatch.setattr("colscope.sources.records.LONGEST_OPEN", 4)
    with pytest.raises(Exception, match="never closed"):
        rows(open_delimited(spark, path))


def test_headers_meet_by_name(spark, tmp_path):
    write(tmp_path, "a.csv", "id,name\n1,x\n2,y,more\n")
    write(tmp_path, "b.csv", "name,id\nz,3\n")
    write(tmp_path, "c.csv", 'extra,name\ne,"two\nlines",late\n')
    write(tmp_path, "d.csv", "")
    table = open_delimited(spark, str(tmp_path), DelimitedOptions(delimiter="comma"))
    assert table.columns[:3] == ("id", "name", "extra")
    assert sorted(tuple(x or "" for x in r) for r in rows(table)) == sorted([
        ("1", "x", "", ""), ("2", "y", "", "more"), ("3", "z", "", ""), ("", "two\nlines", "e", "late"),
    ])


def test_long_header_keeps_its_names(spark, tmp_path):
    names = [f"column {i} {'x' * 1000}" for i in range(5000)]
    path = write(tmp_path, "wide.csv", ",".join(names) + "\n" + ",".join(map(str, range(5000))) + "\n")
    table = open_delimited(spark, path)
    assert len(",".join(names)) > 4 << 20 and table.columns == tuple(names)


def test_ragged_blank_and_quoted_records(spark, tmp_path):
    path = write(tmp_path, "r.csv", 'a,a,,a_2\n1\n2,3,4,5,6\n\n"x""y",5\n')
    table = open_table(spark, path)
    assert table.columns == ("a", "a_2", "column_3", "a_2", "column_5")
    assert rows(table) == [("1", None, None, None, None), ("2", "3", "4", "5", "6"), ('x"y', "5", None, None, None)]
    assert unique_headers(["x", " x ", None]) == ["x", "x_2", "column_3"]


def test_record_limit_and_long_cell(spark, tmp_path):
    path = write(tmp_path, "long.csv", "value\n" + "x" * 100_001 + "\n")
    shown = preview(open_table(spark, path))
    assert shown.truncated_cells == 1 and shown.scope == "full"
    assert [w["code"] for w in shown.profile.warnings.collect()] == ["constant"]
    assert shown.profile.profiles.first().max_length == 100_000
    with pytest.raises(Exception, match="exceeds the maximum"):
        open_delimited(spark, path, max_record_bytes=1000).df.count()


def test_delimiters(spark, tmp_path):
    for name, text in [("a.csv", 'x;"1;2,3,4";y\n'), ("b.tsv", "plain\n"), ("c.csv", "plain\n"), ("d.csv", "a|b,c|d\n")]:
        write(tmp_path, name, text)
    found = {os.path.basename(r["path"]): r["detected"] for r in detect_delimiters(spark, str(tmp_path)).collect()}
    assert found == {"a.csv": ";", "b.tsv": "\t", "c.csv": ",", "d.csv": "|"}
    assert count_outside_quotes('"",a,b', ",", '"', '"') == 0
    assert count_outside_quotes('"a""b",c,d', ",", '"', '"') == 2


def test_parquet_preview_profile_and_budget(spark, tmp_path):
    path = str(tmp_path / "skewed.parquet")
    spark.range(150).selectExpr("IF(id < 100, 'early', 'late') AS class", "CAST(id AS INT) AS value").coalesce(1).write.parquet(path)
    table = open_table(spark, path)
    shown = preview(table, Limits(preview_rows=100))
    assert shown.row_count == 100 and shown.total_rows == 150
    assert shown.profile.profiles.first().distinct == 1 and shown.profile.warnings.count() == 0
    full = profile_table(table)
    assert [tuple(t) for t in full.profiles.first().top_values] == [("early", 100), ("late", 50)]
    assert [(w["code"], w["column_index"]) for w in full.warnings.collect()] == [("possibleIdentifier", 1)]
    audit = footer_audit(spark, path, 10).collect()
    assert [r["verdict"] for r in audit] == ["rejected"] and audit[0]["rows"] == 150


def test_scan_budget(spark, tmp_path):
    path = write(tmp_path, "oversized.csv", "value\n")
    os.truncate(path, 65 * 1024 * 1024)
    table = open_table(spark, path, options=DelimitedOptions(delimiter="comma"))
    with pytest.raises(ScanLimitError, match="Full-data profiling is limited to 64.0 MB"):
        profile_table(table, limits=Limits(max_profile_scan_mb=64))


def test_workbooks(spark, tmp_path):
    folder = str(tmp_path)
    styles = '<styleSheet><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>'
    shared = "<sst><si><r><t>rich </t></r><r><t>text</t></r></si></sst>"
    raw = {
        (4, 1): '<c r="A4" t="s"><v>0</v></c>', (4, 2): '<c r="B4" s="1"><v>45293.5</v></c>',
        (5, 1): '<c r="A5" t="e"><v>#DIV/0!</v></c>', (5, 2): '<c r="B5"><f>1+1</f><v>2</v></c>',
        (6, 1): '<c r="A6" t="str"><f>"a"</f><v>a</v></c>', (6, 2): '<c r="B6" t="b"><v>1</v></c>',
    }
    people = {(1, 1): "name", (1, 2): "age", (2, 1): "Ada", (2, 2): 36, (3, 1): "Grace", (3, 2): 85.25}
    write_workbook(f"{folder}/people.xlsx", [("People", people)], raw, styles, shared)
    table = open_table(spark, f"{folder}/people.xlsx")
    assert texts(table) == [
        ("Ada", "36"), ("Grace", "85.25"), ("rich text", "2024-01-02T12:00:00.000Z"), ("#DIV/0!", "2"), ("a", "true"),
    ]
    two = [("People", people), ("Scores", {(1, 1): "team", (1, 2): "score", (2, 1): "Blue", (2, 2): 10})]
    write_workbook(f"{folder}/two.xlsx", two)
    table = open_table(spark, f"{folder}/two.xlsx", sheet="Scores")
    assert table.sheets == ("People", "Scores") and texts(table) == [("Blue", "10")]
    assert profile_table(table).profiles.collect()[1].mean == 10
    assert open_table(spark, f"{folder}/two.xlsx", sheet="Nope").sheet == "People"

    sparse = {(1, 1): "name", (10000, 1): "late row", (10001, 26): "outside"}
    write_workbook(f"{folder}/sparse.xlsx", [("Sparse", sparse), ("Blank", {})])
    table = open_table(spark, f"{folder}/sparse.xlsx", limits=Limits(max_columns=10))
    assert table.width == 26 and texts(table) == [("late row",) + (None,) * 9]
    listed = {(os.path.basename(r["path"]), r["sheet"]): r["rows"] for r in list_sheets(workbook_rows(spark, folder)).collect()}
    assert listed[("sparse.xlsx", "Blank")] == 0 and listed[("two.xlsx", "Scores")] == 2


def test_archive_audit(spark, tmp_path):
    folder = str(tmp_path)
    write_workbook(f"{folder}/good.xlsx", [("S", {(1, 1): "a"})])
    with zipfile.ZipFile(f"{folder}/bomb.xlsx", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("zeros", b"\0" * (16 * 1024 * 1024))
    with zipfile.ZipFile(f"{folder}/many.xlsx", "w") as z:
        for i in range(10_001):
            z.writestr(str(i), b"")
    write(folder, "broken.xlsx", b"not a zip")
    with zipfile.ZipFile(f"{folder}/none.xlsx", "w"):
        pass
    found = {os.path.basename(r["path"]): r["reason"] for r in archive_audit(spark, folder).collect()}
    assert found["good.xlsx"] is None and found["none.xlsx"] is None
    assert found["bomb.xlsx"] == "suspicious compression ratio"
    assert found["many.xlsx"] == "too many archive entries"
    assert found["broken.xlsx"].startswith("Invalid Excel archive: ")
    small = {os.path.basename(r["path"]): r["reason"] for r in archive_audit(spark, folder, max_bytes=300).collect()}
    assert small["bomb.xlsx"] == "a single archive entry is too large"
    assert small["good.xlsx"] == "expanded workbook size exceeds the configured safety limit"
    with pytest.raises(ScanLimitError, match="Workbook rejected for safety"):
        open_table(spark, f"{folder}/bomb.xlsx")
