"""Readers of docx and xlsx archives with the standard library alone, and writers for fixtures.

Errors keep one taxonomy: a missing file, a damaged archive or part, an empty document.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_HEADING = re.compile(r"^(?:heading|заголовок|titre|h)\s*([1-4])$", re.I)


class InvalidDocument(ValueError):
    """The archive or one of its parts can't be read."""


class EmptyDocument(RuntimeError):
    """There is no text in the document."""


def _part(archive: zipfile.ZipFile, name: str, needed: bool = True) -> ET.Element | None:
    try:
        return ET.fromstring(archive.read(name))
    except KeyError:
        if needed:
            raise InvalidDocument(f"{name} is missing") from None
        return None
    except ET.ParseError as e:
        raise InvalidDocument(f"{name}: {e}") from e


def _open(data: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise InvalidDocument(str(e)) from e


def markdown_table(rows: list[list[str]]) -> str:
    """The first row is the header; others are filled or cut to its width."""
    if not rows:
        return ""
    width = len(rows[0])
    lines = [rows[0], ["---"] * width, *([*r, *[""] * width][:width] for r in rows[1:])]
    return "\n".join("| " + " | ".join(r) + " |" for r in lines)


def _cell(text: str) -> str:
    return re.sub(r"\s*[\r\n]+\s*", " ", text.replace("|", "\\|")).strip()


def read_docx(data: bytes, throw_if_empty: bool = True) -> dict:
    """``content`` (markdown), ``title``, ``author`` and ``modified`` of a docx archive."""
    archive = _open(data)
    body = _part(archive, "word/document.xml").find(f"{_W}body")
    parts: list[str] = []
    title = None

    def text_of(e: ET.Element) -> str:
        out = []
        for x in e.iter():
            if x.tag == f"{_W}t":
                out.append(x.text or "")
            elif x.tag == f"{_W}tab":
                out.append("\t")
            elif x.tag == f"{_W}br":
                out.append("\n\n---\n\n" if x.get(f"{_W}type") == "page" else "\n")
        return "".join(out)

    for e in body if body is not None else ():
        if e.tag == f"{_W}p":
            text = text_of(e)
            style = e.find(f"{_W}pPr/{_W}pStyle")
            m = _HEADING.match(style.get(f"{_W}val", "")) if style is not None else None
            if m and text.strip():
                title = title or text.strip()
                text = "#" * int(m[1]) + " " + text.strip()
            if text.strip():
                parts.append(text)
        elif e.tag == f"{_W}tbl":
            rows = [[_cell(" ".join(text_of(p) for p in c.iter(f"{_W}p"))) for c in r.iter(f"{_W}tc")] for r in e.iter(f"{_W}tr")]
            if rows:
                parts.append(markdown_table(rows))
    content = "\n\n".join(parts)
    if throw_if_empty and not content.strip():
        raise EmptyDocument("no text")
    core = _part(archive, "docProps/core.xml", needed=False)
    found = {x.tag.rpartition("}")[2]: (x.text or "").strip() for x in core.iter()} if core is not None else {}
    return {"content": content, "title": found.get("title") or title, "author": found.get("creator"), "modified": found.get("modified")}


def column_number(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", reference.upper())[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def read_xlsx(data: bytes, throw_if_empty: bool = True) -> dict:
    """``content``: a markdown table for each sheet under ``## Sheet: name``; sparse cells keep their columns."""
    archive = _open(data)
    book = _part(archive, "xl/workbook.xml")
    rels = _part(archive, "xl/_rels/workbook.xml.rels")
    target = {r.get("Id"): r.get("Target") for r in rels}
    shared = _part(archive, "xl/sharedStrings.xml", needed=False)
    strings = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in shared] if shared is not None else []

    def value(c: ET.Element) -> str:
        kind, v = c.get("t"), c.find(f"{_S}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter(f"{_S}t"))
        if v is None or v.text is None:
            return ""
        if kind == "s":
            return strings[int(v.text)] if v.text.isdigit() and int(v.text) < len(strings) else ""
        return ("TRUE" if v.text == "1" else "FALSE") if kind == "b" else v.text

    parts = []
    for sheet in book.iter(f"{_S}sheet"):
        path = target.get(sheet.get(f"{_R}id"), "")
        root = _part(archive, path.lstrip("/") if path.startswith("/") else "xl/" + path)
        rows = []
        for r in root.iter(f"{_S}row"):
            cells = {column_number(c.get("r", "")): _cell(value(c)) for c in r.iter(f"{_S}c")}
            row = [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]
            if any(row):
                rows.append(row)
        if rows:
            width = max(map(len, rows))
            head = [x or f"Col_{i + 1}" for i, x in enumerate([*rows[0], *[""] * width][:width])]
            parts.append(f"## Sheet: {sheet.get('name')}\n\n" + markdown_table([head, *rows[1:]]))
    content = "\n\n".join(parts)
    if throw_if_empty and not content:
        raise EmptyDocument("no cells")
    return {"content": content, "title": None, "author": None, "modified": None}


# -- writers ------------------------------------------------------------------------


def _escape(text: str) -> str:
    clean = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text)
    return clean.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def write_docx(paragraphs: list[str], title: str = "", author: str = "") -> bytes:
    """A docx archive; paragraphs that begin with ``#`` get the style of their heading."""
    out = io.BytesIO()
    body = []
    for p in paragraphs:
        m = re.match(r"(#{1,4}) (.*)", p, re.S)
        style = f'<w:pPr><w:pStyle w:val="Heading{len(m[1])}"/></w:pPr>' if m else ""
        body.append(f'<w:p>{style}<w:r><w:t xml:space="preserve">{_escape(m[2] if m else p)}</w:t></w:r></w:p>')
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{_W[1:-1]}"><w:body>{"".join(body)}</w:body></w:document>')
        z.writestr("docProps/core.xml", f'<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{_escape(title)}</dc:title><dc:creator>{_escape(author)}</dc:creator></c>')
    return out.getvalue()


def _column_name(i: int) -> str:
    name = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        name = chr(65 + r) + name
    return name


def write_xlsx(sheets: dict[str, list[list[str]]]) -> bytes:
    """An xlsx archive of inline strings."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        names = list(sheets)
        listed = "".join(f'<sheet name="{_escape(n)}" sheetId="{i + 1}" r:id="r{i + 1}"/>' for i, n in enumerate(names))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_S[1:-1]}" xmlns:r="{_R[1:-1]}"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<R Id="r{i + 1}" Target="worksheets/s{i + 1}.xml"/>' for i in range(len(names))) + "</Relationships>")
        for i, n in enumerate(names):
            rows = "".join(
                f'<row r="{y + 1}">' + "".join(f'<c r="{_column_name(x)}{y + 1}" t="inlineStr"><is><t>{_escape(v)}</t></is></c>' for x, v in enumerate(row) if v) + "</row>"
                for y, row in enumerate(sheets[n])
            )
            z.writestr(f"xl/worksheets/s{i + 1}.xml", f'<worksheet xmlns="{_S[1:-1]}"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()
