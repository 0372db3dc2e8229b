import zlib

import pytest

from evispark.sources import files, pdf
from evispark.sources.pdf_writer import make_pdf


def blocks(spark, *contents):
    df = spark.createDataFrame([(f"f{i}.pdf", bytearray(c)) for i, c in enumerate(contents)], "path string, content binary")
    return files.read_blocks(df)


def one_page(stream, fonts=b"<< /F1 << /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >> >>", more=b"", extra=b"", head=b""):
    return (
        b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font " + fonts + more + b" >> >> endobj\n"
        b"3 0 obj << /Type /Page /Parent 2 0 R /Contents 4 0 R >> endobj\n4 0 obj << " + head + b" >>\nstream\n" + stream + b"\nendstream endobj\n" + extra + b"trailer << /Root 1 0 R >>\n%%EOF"
    )


def test_lines_and_blanks(spark):
    body = b"BT /F1 10 Tf 14 TL 72 700 Td (Hello \\(big\\)) Tj 0 -14 Td [(wo) 20 (rld) -900 (and)] TJ (\\351t\\351) ' ET BT /F1 10 Tf 1 0 0 1 300 701 Tm (right) Tj ET"
    got = blocks(spark, one_page(body)).where("type = 'text'").first()
    assert (got["page"], got["text"]) == (1, "Hello (big) right\nworld and\nété")


def test_filters_forms_and_unicode(spark):
    packed = one_page(zlib.compress(b"BT /F1 9 Tf 10 10 Td (packed) Tj ET"), head=b"/Filter /FlateDecode")
    form = one_page(
        b"q 1 0 0 1 50 50 cm /X Do Q", more=b" /XObject << /X 9 0 R >>",
        extra=b"9 0 obj << /Type /XObject /Subtype /Form /Resources << /Font << /F2 10 0 R >> >> >>\nstream\nBT /F2 9 Tf (inside) Tj ET\nendstream endobj\n10 0 obj << /Type /Font /Subtype /Type1 >> endobj\n",
    )
    cmap = b"1 beginbfchar <0041> <03B103B2> endbfchar 1 beginbfrange <0050> <0052> <0430> endbfrange"
    wide = one_page(
        b"BT /F1 9 Tf 10 10 Td <004100500052> Tj ET", fonts=b"<< /F1 << /Type /Font /Subtype /Type0 /ToUnicode 9 0 R /DescendantFonts [<< /DW 1000 /W [65 [600]] >>] >> >>",
        extra=b"9 0 obj << >>\nstream\n" + cmap + b"\nendstream endobj\n",
    )
    inner = b"1 0 3 60 " + b"<< /Type /Catalog /Pages 2 0 R >>".ljust(60) + b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << >> >>"
    stored = b"%PDF-1.5\n2 0 obj << /Type /Pages /Kids [3 0 R] >> endobj\n4 0 obj << /Length 37 >>\nstream\nBT /F1 9 Tf 10 10 Td (in store) Tj ET \nendstream endobj\n"
    stored = stored.replace(b"/Kids", b"/Resources << /Font << /F1 << /Subtype /Type1 >> >> >> /Kids").replace(b" /Resources << >> >>", b"")
    inner = inner.replace(b" /Resources << >>", b"")
    stored += b"7 0 obj << /Type /ObjStm /N 2 /First 9 /Filter /FlateDecode >>\nstream\n" + zlib.compress(inner) + b"\nendstream endobj\n8 0 obj << /Type /XRef /Root 1 0 R >> endobj"
    got = {r["path"]: (r["text"], r["error"]) for r in blocks(spark, packed, form, wide, stored).collect()}
    assert got == {"f0.pdf": ("packed", None), "f1.pdf": ("inside", None), "f2.pdf": ("αβав", None), "f3.pdf": ("in store", None)}


def test_tables_and_locators(spark):
    page = [("head line", None), (None, [["a", "b c"], ["", "d|e"]]), ("between", None), (None, [["x"], ["y"]])]
    single = [("only", None), (None, [["k", "v"], ["1", "2"]])]
    got = files.snippets_of(blocks(spark, make_pdf([page, single, []]))).orderBy("pos").collect()
    assert [(r["locator"], r["type"]) for r in got] == [("Table 1 on p. 1", "table"), ("Table 2 on p. 1", "table"), ("p. 1", "text"), ("Table on p. 2", "table"), ("p. 2", "text")]
    assert got[0]["text"] == "| a | b c |\n| --- | --- |\n|  | d\\|e |" and got[1]["text"] == "| x |\n| --- |\n| y |"
    assert got[2]["text"] == "head line\na b c\nd|e\nbetween\nx\ny" and got[4]["text"] == "only\nk v\n1 2"


@pytest.mark.parametrize("bad", [b"", b"no file", one_page(b"x", head=b"/Filter /LZWDecode"), one_page(b"").replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 5 0 R")])
def test_broken_files_are_errors(spark, bad):
    got = blocks(spark, bad, make_pdf([[("fine", None)]])).collect()
    assert sorted((r["path"], r["text"], r["error"] is not None) for r in got) == sorted([("f0.pdf", None, True), ("f1.pdf", "fine", False)])


def test_no_files(spark):
    assert blocks(spark).count() == 0


def test_scanner_passes_over_images_and_odd_marks():
    found = list(pdf.operations(b"BI /W 1 ID \x00(\xff EI 1 2 Td % remark\n<4 1> Tj [(a\\\n\\101)] TJ"))
    assert found[2:5] == [("Td", [1.0, 2.0]), ("Tj", [b"A"]), ("TJ", [[b"aA"]])]


def test_pages_share_their_resources_and_marks_go_on_together(spark, monkeypatch):
    calls, real = [], pdf.Document.resources
    monkeypatch.setattr(pdf.Document, "resources", lambda self, *x: calls.append(1) or real(self, *x))
    assert len({known for _, _, known in pdf.read_pages(make_pdf([[(f"page {n}", None)] for n in range(20)]))}) == 1 and len(calls) == 1
    monkeypatch.setattr(files, "PAGES", 10_000)
    got = blocks(spark, make_pdf([[(f"page {n}", None)] for n in range(20)]), b"no file").collect()
    assert sorted((r["page"], r["text"]) for r in got if r["error"] is None) == [(n + 1, f"page {n}") for n in range(20)]
    assert [r["path"] for r in got if r["error"]] == ["f1.pdf"]
