import io
import zipfile

import pytest

from lexiloom.operators.retrieval import Settings
from lexiloom.sources.office import MEDIA, file_blocks

KIND = {v: k for k, v in MEDIA.items()}


def packed(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", text)
    return out.getvalue()


def test_office_files(spark):
    p = lambda t, style="": f"<w:p><w:pPr>{f'<w:pStyle w:val=\"{style}\"/>' if style else ''}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>"
    docx = packed(word__document=f'<w:document xmlns:w="w"><w:body>{p("Top", "Heading1")}{p("body")}<w:tbl><w:tr><w:tc>{p("a")}</w:tc><w:tc>{p("b")}</w:tc></w:tr></w:tbl></w:body></w:document>')
    slide = '<s xmlns:a="a"><a:p><a:r><a:t>Title</a:t></a:r></a:p><a:p><a:r><a:t>Point</a:t></a:r></a:p></s>'
    sheet = '<s><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row></s>'
    xlsx = packed(xl__sharedStrings="<s><si><t>name</t></si></s>", xl__worksheets__sheet1=sheet)
    bomb = packed(word__document="<x>" + " " * 40_000_000 + "</x>")
    files = [("d", KIND["docx"], docx), ("p", KIND["pptx"], packed(ppt__slides__slide1=slide)), ("x", KIND["xlsx"], xlsx), ("b", KIND["docx"], bomb), ("m", KIND["xlsx"], b"no zip"),
             ("u", "image/png", b""), ("t", "text/plain", "﻿one\n\ntwo".encode()), ("e", "text/plain", b""), ("h", "text/html", b"<h1>H</h1><p>x")]
    df = spark.createDataFrame(files, "path string, media_type string, content binary")
    got = {}
    for r in file_blocks(df).collect():
        got.setdefault(r.path, []).append((r.type, r.text, tuple(r.heading_path or ()), r.finding))
    assert got["d"] == [("heading", "Top", (), None), ("paragraph", "body", ("Top",), None), ("table", "a | b", ("Top",), None)]
    assert got["p"] == [("heading", "Title", (), None), ("paragraph", "Point", ("Title",), None)]
    assert got["x"] == [("table", "name\t\t3", ("Sheet 1",), None)]
    assert [got[k][0][3] for k in "bmue"] == ["unsafe_archive", "malformed_file", "unsupported_media_type", "no_extractable_text"]
    assert [g[1] for g in got["t"]] == ["one", "two"] and [g[:2] for g in got["h"]] == [("heading", "H"), ("paragraph", "x")]


def test_macros_are_refused_and_slide_tables_read(spark):
    slide = '<s xmlns:a="a"><a:p><a:r><a:t>Title</a:t></a:r></a:p><a:tbl><a:tr><a:tc><a:p><a:r><a:t>a</a:t></a:r></a:p></a:tc><a:tc><a:p><a:r><a:t>b</a:t></a:r></a:p></a:tc></a:tr></a:tbl><a:p><a:r><a:t>End</a:t></a:r></a:p></s>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "<d><body/></d>")
        z.writestr("word/vbaProject.bin", "x")
    df = spark.createDataFrame([("p", KIND["pptx"], packed(ppt__slides__slide1=slide)), ("m", KIND["docx"], out.getvalue())], "path string, media_type string, content binary")
    rows = file_blocks(df).collect()
    assert [(r.type, r.text) for r in rows if r.path == "p"] == [("heading", "Title"), ("table", "a | b"), ("paragraph", "End")]
    assert [r.finding for r in rows if r.path == "m"] == ["unsafe_macros"]


@pytest.mark.parametrize("bad", [{"top_k": 0}, {"top_k": 51}, {"candidates": 3}, {"candidates": 201}, {"vector_weight": 1.1}, {"maximum_distance": 2.5}, {"mode": "x"}])
def test_settings_are_checked(bad):
    Settings()
    with pytest.raises(ValueError):
        Settings(**bad)
