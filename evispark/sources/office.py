"""Spreadsheets and word-processor files from the standard library: small artefacts, written and read on the driver."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from xml.sax.saxutils import escape

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG = "http://schemas.openxmlformats.org/package/2006"
_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


def _package(parts: dict[str, tuple[str, str]], main: str, kind: str) -> bytes:
    """A zip of parts: name -> (content type, XML)."""
    types = "".join(f'<Override PartName="/{n}" ContentType="application/vnd.openxmlformats-officedocument.{t}+xml"/>' for n, (t, _) in parts.items() if t)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PKG}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{types}</Types>')
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PKG}/relationships"><Relationship Id="rId1" Type="{_REL}/{kind}" Target="{main}"/></Relationships>')
        for n, (_, xml) in parts.items():
            z.writestr(n, _HEAD + xml)
    return out.getvalue()


def column_name(i: int) -> str:
    """0 -> A, 25 -> Z, 26 -> AA."""
    name = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        name = chr(65 + r) + name
    return name


def xlsx(sheets: dict[str, tuple[list[str], list[tuple]]], widths: dict[str, list[int]] | None = None) -> bytes:
    """A workbook: sheet name -> (headings, rows); headings are bold, widths in characters per column."""

    def cell(r: int, c: int, v) -> str:
        at = f'r="{column_name(c)}{r}"' + (' s="1"' if r == 1 else "")
        if isinstance(v, int | float) and not isinstance(v, bool):
            return f"<c {at}><v>{v}</v></c>"
        return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>'

    parts, listed, rels = {}, "", ""
    for i, (name, (headings, rows)) in enumerate(sheets.items(), start=1):
        body = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate([headings, *rows], start=1))
        wide = "".join(f'<col min="{k}" max="{k}" width="{w}" customWidth="1"/>' for k, w in enumerate((widths or {}).get(name, []), start=1))
        parts[f"xl/worksheets/sheet{i}.xml"] = ("spreadsheetml.worksheet", f'<worksheet xmlns="{_MAIN}">' + (f"<cols>{wide}</cols>" if wide else "") + f"<sheetData>{body}</sheetData></worksheet>")
        listed += f'<sheet name="{escape(name)}" sheetId="{i}" r:id="rId{i}"/>'
        rels += f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>'
    rels += f'<Relationship Id="rId{len(sheets) + 1}" Type="{_REL}/styles" Target="styles.xml"/>'
    style = "<fonts><font/><font><b/></font></fonts><fills><fill/></fills><borders><border/></borders><cellStyleXfs><xf/></cellStyleXfs>"
    style += '<cellXfs><xf/><xf fontId="1" applyFont="1" applyAlignment="1"><alignment vertical="top" wrapText="1"/></xf></cellXfs>'
    parts["xl/workbook.xml"] = ("spreadsheetml.sheet.main", f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{listed}</sheets></workbook>')
    parts["xl/styles.xml"] = ("spreadsheetml.styles", f'<styleSheet xmlns="{_MAIN}">{style}</styleSheet>')
    parts["xl/_rels/workbook.xml.rels"] = ("", f'<Relationships xmlns="{_PKG}/relationships">{rels}</Relationships>')
    return _package(parts, "xl/workbook.xml", "officeDocument")


def read_xlsx(content: bytes, sheet: str | None = None) -> list[list[str | None]]:
    """The rows of the named or first sheet as strings; empty cells are None."""
    tag = lambda n: f"{{{_MAIN}}}{n}"
    text = lambda e: "".join(t.text or "" for t in e.iter(tag("t")))
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = [text(s) for s in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        listed = {s.get("name"): s.get(f"{{{_REL}}}id") for s in ET.fromstring(z.read("xl/workbook.xml")).iter(tag("sheet"))}
        if sheet is not None and sheet not in listed:
            raise ValueError(f"no sheet {sheet!r}")
        target = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}[listed[sheet] if sheet is not None else next(iter(listed.values()))]
        root = ET.fromstring(z.read("xl/" + target.removeprefix("/xl/")))
    rows = []
    for row in root.iter(tag("row")):
        cells: dict[int, str | None] = {}
        for c in row.iter(tag("c")):
            at = 0
            for ch in re.match("[A-Z]+", c.get("r"))[0]:
                at = at * 26 + ord(ch) - 64
            v = c.find(tag("v"))
            cells[at - 1] = text(c) if c.get("t") == "inlineStr" else None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
        rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    return rows


def docx(blocks: list[tuple[str, str]]) -> bytes:
    """A document of (style, text): Title, Heading1, Heading2 or Normal; line ends break lines."""

    def paragraph(style: str, text: str) -> str:
        runs = "<w:r><w:br/></w:r>".join(f'<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r>' for t in text.split("\n"))
        return f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr>{runs}</w:p>'

    body = "".join(paragraph(s, t) for s, t in blocks)
    parts = {"word/document.xml": ("wordprocessingml.document.main", f'<w:document xmlns:w="{_WORD}"><w:body>{body}</w:body></w:document>')}
    return _package(parts, "word/document.xml", "officeDocument")
