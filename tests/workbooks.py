"""Small workbooks for tests."""

import zipfile
from xml.sax.saxutils import escape


def column(number):
    name = ""
    while number:
        number, rest = divmod(number - 1, 26)
        name = chr(65 + rest) + name
    return name


def write_workbook(path, sheets, raw_cells=None, styles=None, shared=None):
    """``sheets``: list of (name, {(row, column): value}). ``raw_cells``: {(row, column): xml}."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        listed = "".join(
            f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, (n, _) in enumerate(sheets, 1)
        )
        z.writestr("xl/workbook.xml", f'<workbook xmlns="m" xmlns:r="x"><sheets>{listed}</sheets></workbook>')
        links = "".join(
            f'<Relationship Id="r{i}" Type="t/worksheet" Target="worksheets/sheet{i}.xml"/>'
            for i in range(1, len(sheets) + 1)
        )
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        if styles:
            z.writestr("xl/styles.xml", styles)
        if shared:
            z.writestr("xl/sharedStrings.xml", shared)
        for i, (_, cells) in enumerate(sheets, 1):
            rows = {}
            for (r, c), value in cells.items():
                ref = f"{column(c)}{r}"
                if isinstance(value, bool):
                    xml = f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
                elif isinstance(value, (int, float)):
                    xml = f'<c r="{ref}"><v>{value}</v></c>'
                else:
                    xml = f'<c r="{ref}" t="inlineStr"><is><t>{escape(value)}</t></is></c>'
                rows.setdefault(r, []).append((c, xml))
            for (r, c), xml in (raw_cells or {}).items():
                rows.setdefault(r, []).append((c, xml))
            body = "".join(
                f'<row r="{r}">{"".join(x for _, x in sorted(rows[r]))}</row>' for r in sorted(rows)
            )
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="m"><sheetData>{body}</sheetData></worksheet>')
