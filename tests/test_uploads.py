"""Uploads, CSV files and discovered sources."""

import io
import zipfile

from corvane.sources.records import discover, docx_text, read_csv, read_uploads

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", f'<?xml version="1.0"?><w:document {NS}><w:body>{body}</w:body></w:document>')
    return out.getvalue()


PARAGRAPHS = "<w:p><w:r><w:t>First </w:t></w:r><w:r><w:t>line</w:t></w:r></w:p><w:p><w:r><w:t> </w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>Cell</w:t><w:tab/><w:t>é &amp; b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"


def test_word_documents():
    assert docx_text(docx(PARAGRAPHS)) == "First line\nCell\té & b" and docx_text(docx("")) == ""


def test_uploads_of_all_kinds(spark, tmp_path):
    files = {
        "a.docx": docx(PARAGRAPHS), "b.docx": b"PK no archive", "c.docx": docx("<w:p/>"), "d.pdf": b"%PDF-1 two", "e.pdf": b"%PDF-1 none", "f.PDF": b"%PDF-1 bad", "g.txt": b" caf\xe9 ", "h.md": b"", "noending": b"plain", "i.exe": b"x",
        "j.txt": b"x" * 2000, "k.rst": b" \n",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)

    def read(content):
        if content.endswith(b"bad"):
            raise ValueError("broken")
        return ["One ", "", "Two"] if content.endswith(b"two") else ["", " "]

    got = lambda **options: {r.path.rsplit("/")[-1]: (r.text, r.status) for r in read_uploads(spark, str(tmp_path), 1500, **options).collect()}
    assert got(read_pdf=read) == {
        "a.docx": ("First line\nCell\té & b", "ok"), "b.docx": (None, "unreadable"), "c.docx": (None, "no text"), "d.pdf": ("--- Page 1 ---\nOne\n\n--- Page 3 ---\nTwo", "ok"), "e.pdf": (None, "no text"), "f.PDF": (None, "unreadable"),
        "g.txt": ("café", "ok"), "noending": ("plain", "ok"), "i.exe": (None, "unsupported"), "j.txt": (None, "too large"), "k.rst": (None, "empty"),
    }
    assert got()["d.pdf"] == (None, "unsupported")


def test_csv_with_quotes_and_line_ends(spark, tmp_path):
    (tmp_path / "t.csv").write_text('name,n\n"a, ""b""",1\n"two\nlines",\n')
    rows = {r.n: r.name for r in read_csv(spark, str(tmp_path / "t.csv"), "name string, n int").collect()}
    assert rows == {None: "two\nlines", 1: 'a, "b"'}


def test_discovered_sources_by_jurisdiction_and_code(spark):
    records = spark.createDataFrame([("CA", "VEH", "/d/b/1.json"), ("CA", "VEH", "/d/a/2.json"), ("CA", "PEN", "/d/p/1.json"), ("TX", "TN", "/d/t/1.json"), ("TX", "TN", "/d/jsonl/1.json")], "jurisdiction string, law_code string, path string")
    found = lambda *by: sorted(map(tuple, discover(records, *by).collect()))
    assert found() == [("CA", "PEN", "/d/p"), ("CA", "VEH", "/d/a"), ("TX", "TN", "/d/t")]
    assert found("ca") == [("CA", "PEN", "/d/p"), ("CA", "VEH", "/d/a")] and found("CA", " veh") == [("CA", "VEH", "/d/a")] and found(None, "tn") == [("TX", "TN", "/d/t")] and found("ZZ") == []
