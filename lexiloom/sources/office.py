"""DOCX, PPTX and XLSX files to blocks, and the choice of a reader by media type.

Files come from ``spark.read.format("binaryFile")``; each is one zip of XML parts, read in a task.
A file whose parts are too many, too large or too compressed is a finding, not a failure.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from lexiloom.sources.markup import scan_html

MAX_PARTS, MAX_BYTES, MAX_RATIO = 2_000, 200 << 20, 200
#: Media types of the readers.
MEDIA = {
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "text/html": "html",
    "text/plain": "text",
}


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attribute(element, name: str) -> str | None:
    return next((v for k, v in element.attrib.items() if _local(k) == name), None)


def _archive(data: bytes) -> zipfile.ZipFile:
    """The archive, if its parts stay within the limits."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    parts = archive.infolist()
    packed, whole = sum(p.compress_size for p in parts), sum(p.file_size for p in parts)
    if len(parts) > MAX_PARTS or whole > MAX_BYTES or whole > MAX_RATIO * max(packed, 1024):
        raise ValueError("unsafe_archive")
    if any(p.filename.lower().endswith("vbaproject.bin") for p in parts):
        raise ValueError("unsafe_macros")
    return archive


def _xml(archive: zipfile.ZipFile, name: str):
    raw = archive.read(name)
    if b"<!DOCTYPE" in raw[:4096].upper() or b"<!ENTITY" in raw[:4096].upper():
        raise ValueError("unsafe_xml")
    return ElementTree.fromstring(raw)


def _text(element, run: str = "t") -> str:
    return "".join(x.text or "" for x in element.iter() if _local(x.tag) == run).strip()


def _docx(archive):
    """Paragraphs by style: headings set the path, numbered ones are list items; tables are rows of cells."""
    body = next(x for x in _xml(archive, "word/document.xml") if _local(x.tag) == "body")
    path: list[str] = []
    for part in body:
        kind = _local(part.tag)
        if kind == "tbl":
            rows = [" | ".join(_text(c) for c in row if _local(c.tag) == "tc") for row in part if _local(row.tag) == "tr"]
            yield "table", "\n".join(rows), tuple(path)
        elif kind == "p" and _text(part):
            style = next((_attribute(x, "val") or "" for x in part.iter() if _local(x.tag) == "pStyle"), "")
            level = re.fullmatch(r"(?i)heading\s*([1-9])", style)
            if level:
                del path[int(level[1]) - 1 :]
                yield "heading", _text(part), tuple(path)
                path.append(_text(part))
            else:
                listed = any(_local(x.tag) == "numPr" for x in part.iter())
                yield "list_item" if listed else "paragraph", _text(part), tuple(path)


def _slide_parts(element):
    """Paragraphs and tables of a slide in order; a table's cells are not paragraphs too."""
    for part in element:
        kind = _local(part.tag)
        if kind in ("tbl", "p"):
            yield kind, part
        else:
            yield from _slide_parts(part)


def _pptx(archive):
    """Slides in order; a slide's first text is its heading, its tables are rows of cells."""
    names = sorted((n for n in archive.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    for name in names:
        head: tuple[str, ...] = ()
        for kind, part in _slide_parts(_xml(archive, name)):
            if kind == "tbl":
                rows = [" | ".join(_text(c) for c in row if _local(c.tag) == "tc") for row in part if _local(row.tag) == "tr"]
                if any(r.strip(" |") for r in rows):
                    yield "table", "\n".join(rows), head
            elif _text(part):
                yield ("paragraph" if head else "heading"), _text(part), head
                head = head or (_text(part),)


#: Columns of a sheet, by the file format.
COLUMNS = 16_384


def _xlsx(archive):
    """Sheets in order, one table block each: rows of tab-separated cells."""
    shared: list[str] = []
    if "xl/sharedStrings.xml" in archive.namelist():
        shared = [_text(x) for x in _xml(archive, "xl/sharedStrings.xml") if _local(x.tag) == "si"]
    names = sorted((n for n in archive.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    for nth, name in enumerate(names, 1):
        rows = []
        for row in (x for x in _xml(archive, name).iter() if _local(x.tag) == "row"):
            cells: list[str] = []
            for cell in row:
                letters = re.match(r"[A-Z]+", _attribute(cell, "r") or "")
                if letters:
                    at = 0
                    for c in letters[0]:
                        at = at * 26 + ord(c) - 64
                    if at > COLUMNS:
                        raise ValueError("a cell behind the last column")
                    cells += [""] * (at - 1 - len(cells))
                value = _text(cell, "t") if _attribute(cell, "t") == "inlineStr" else _text(cell, "v")
                cells.append(shared[int(value)] if _attribute(cell, "t") == "s" and value else value)
            rows.append("\t".join(cells))
        if any(r.strip() for r in rows):
            yield "table", "\n".join(rows), (f"Sheet {nth}",)


def read_file(data: bytes, kind: str):
    """(type, text, heading path) blocks of one file."""
    if kind == "text":
        for line in data.decode("utf-8-sig").split("\n\n"):
            if line.strip():
                yield "paragraph", line.strip(), ()
    elif kind == "html":
        for block in scan_html(data.decode("utf-8", "replace"), "plain"):
            yield block[:3]
    else:
        yield from {"docx": _docx, "pptx": _pptx, "xlsx": _xlsx}[kind](_archive(data))


def file_blocks(files: DataFrame) -> DataFrame:
    """path, ordinal, type, text, heading_path, finding of (path, media_type, content) rows.

    A file that cannot be read gives one row with its finding; so does an unknown media type.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for path, media, data in zip(pdf["path"], pdf["media_type"], pdf["content"], strict=True):
                kind = MEDIA.get(media)
                try:
                    found = list(read_file(bytes(data or b""), kind)) if kind else None
                    finding = "no_extractable_text" if found == [] else None if found else "unsupported_media_type"
                except ValueError as error:
                    found, finding = None, str(error) if str(error).startswith("unsafe") else "malformed_file"
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, StopIteration):
                    found, finding = None, "malformed_file"
                rows += [(path, n, t, x, list(p), None) for n, (t, x, p) in enumerate(found or [])]
                if finding:
                    rows.append((path, None, None, None, None, finding))
            yield pd.DataFrame(rows, columns=["path", "ordinal", "type", "text", "heading_path", "finding"]).astype({"ordinal": "Int64"})

    return files.select("path", "media_type", "content").mapInPandas(run, "path string, ordinal long, type string, text string, heading_path array<string>, finding string")
