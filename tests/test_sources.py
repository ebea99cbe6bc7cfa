"""Files of every format, broken ones included."""

import io
import zipfile

import pytest
from pyspark.errors import AnalysisException
from termforge.sources import parse


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


W = 'xmlns:w="http://w"'
DOCX = zipped(word__document_dot_xml=f"<w:document {W}><w:p><w:r><w:t>Batch DS-</w:t></w:r><w:r><w:t>2291 was purified</w:t></w:r></w:p><w:p><w:t>end</w:t></w:p></w:document>")
PPTX = zipped(ppt__slides__slide1_dot_xml='<sld xmlns:a="http://a"><a:p><a:t>MabSelect SuRe</a:t></a:p></sld>', ppt__slides__slide2_dot_xml='<sld xmlns:a="http://a"><a:p><a:t>two</a:t></a:p></sld>')
XLSX = zipped(
    xl__workbook_dot_xml='<workbook xmlns:r="http://r"><sheets><sheet name="Runs" r:id="r1"/></sheets></workbook>',
    xl___rels__workbook_dot_xml_dot_rels='<R><Relationship Id="r1" Target="worksheets/sheet1.xml"/></R>',
    xl__sharedStrings_dot_xml="<sst><si><t>Batch</t></si><si><r><t>DS-</t></r><r><t>2291</t></r></si></sst>",
    xl__worksheets__sheet1_dot_xml='<worksheet><sheetData><row><c t="s"><v>0</v></c><c><v>91.4</v></c><c t="s"><v>1</v></c></row><row><c><v>5</v></c></row><row><c t="inlineStr"><is><t> in </t></is></c><c t="b"><v>1</v></c></row></sheetData></worksheet>',
)
MAIL = b"From: a@b.cd\r\nSubject: =?utf-8?q?Batch_DS-2291?=\r\nMessage-ID: <hidden@x>\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nConfirmed caf\xc3\xa9.\r\n"


def test_sniffing():
    assert [parse.sniffed(x) for x in (b"%PDF-1.7", b"\xd0\xcf\x11\xe0..", DOCX, PPTX, XLSX, MAIL, b"Subject: alone\nx", b"PK\x03\x04junk", b"", b"\xff\xfe")] == ["Pdf", "Email", "Docx", "Pptx", "Xlsx", "Email", "PlainText", "PlainText", "PlainText", "PlainText"]


def test_formats():
    text = lambda x, **k: parse.parsed(x, **k)[0]
    assert text(DOCX) == "Batch DS-2291 was purified\nend\n"
    assert text(PPTX) == "MabSelect SuRe\n\ntwo\n\n"
    assert text(XLSX) == "Runs\nBatch\tDS-2291\nin\n"
    assert text(MAIL).split("\n")[0] == "Batch DS-2291" and "Confirmed café." in text(MAIL) and "hidden" not in text(MAIL)
    assert text(b"\xef\xbb\xbfx") == "x" and text(b"caf\xe9") == "café" and text(DOCX, hint="PlainText").startswith("PK")


def test_pdf_by_a_reader(monkeypatch):
    assert parse.parsed(b"%PDF-1") == ("", "Pdf", False, None)
    monkeypatch.setattr(parse, "PDF_READER", [])
    assert parse.parsed(b"%PDF-1") == (None, "Pdf", None, "UnsupportedFormat")
    monkeypatch.setattr(parse, "PDF_READER", [lambda content: ("few", True)])
    assert parse.parsed(b"%PDF-1") == ("few", "Pdf", False, None)

    def locked(content):
        raise parse.Encrypted

    monkeypatch.setattr(parse, "PDF_READER", [locked])
    assert parse.parsed(b"%PDF-1")[3] == "Encrypted"


@pytest.mark.parametrize("content", [DOCX[:60], b"PK\x03\x04", b"\xd0\xcf\x11\xe0" * 3, zipped(word__document_dot_xml="<broken"), zipped(xl__workbook_dot_xml="no")])
def test_broken_files_never_raise(content):
    text, source, layer, error = parse.parsed(content)
    assert error or text is not None


def test_documents_of_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, content in {"a.bin": DOCX, "sub/b": MAIL, "c.txt": b"plain words", "d": zipped(word__document_dot_xml="<broken")}.items():
        (tmp_path / name).write_bytes(content)
    rows = {r["path"].rsplit("/", 1)[1]: r for r in parse.documents(parse.files(spark, str(tmp_path))).collect()}
    assert {k: r["source"] for k, r in rows.items()} == {"a.bin": "WordProcessing", "b": "Email", "c.txt": "Plain", "d": "WordProcessing"}
    assert rows["d"]["error"].startswith("Docx") and rows["d"]["text"] == "" and len({r["doc_id"] for r in rows.values()}) == 4
    with pytest.raises(AnalysisException):
        parse.files(spark, str(tmp_path / "missing")).count()


def test_tables_of_terms(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("# head\nDS-1\tlab\tcode\nDS-2\tlab\tcode\n")
    (tmp_path / "y.tsv").write_text("Q-1\tlab\tcode\n")
    assert sorted(r["surface"] for r in parse.tsv(spark, str(tmp_path), 1).collect()) == ["DS-1", "Q-1"]
    (tmp_path / "z.tsv").write_text("two\tfields\n")
    with pytest.raises(Exception, match="three columns"):
        parse.tsv(spark, str(tmp_path)).collect()


def test_pdf_text():
    import zlib

    page = b"BT /F1 9 Tf (Stock of \\(new\\) tins) Tj 0 -12 Td [(two) -300 (words) 20 (!)] TJ T* <C974E9> Tj ET"
    file = lambda head, data: b"%PDF-1.5\n4 0 obj <<" + head + b">> stream\n" + data + b"\nendstream endobj trailer <</Root 1 0 R>>"
    want = "Stock of (new) tins\ntwo words!\nÉté\n"
    assert parse.parsed(file(b"/Length 9", page), least_layer=5) == (want, "Pdf", True, None)
    assert parse.parsed(file(b"/Filter /FlateDecode /Length 9", zlib.compress(page)), least_layer=5) == (want, "Pdf", True, None)
    wide = b"beginbfchar <0001> <0041> endbfchar beginbfrange <0002> <0004> <0062> endbfrange"
    both = file(b"/Length 9", wide) + file(b"/Length 9", b"BT <00010002 0004> Tj ET")
    assert parse.parsed(both, least_layer=1)[0] == "Abd\n"
    assert parse.parsed(file(b"/Length 9", b"0 0 10 10 re f"))[1:] == ("Pdf", False, None)
    assert parse.parsed(b"%PDF-1.5 trailer <</Encrypt 5 0 R>>")[3] == "Encrypted"
    assert parse.parsed(b"%PDF-1.5" + bytes(range(256)) * 40)[1] == "Pdf"
