import zlib

from quillmill.plans import pipeline
from quillmill.sources import pdf


def make_pdf(pages, compress=True, info=b"<< /Title (Untitled) /CreationDate (D:20190101) >>"):
    """A file with one Helvetica font; a page is a list of (x, y, size, text)."""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding << /Differences [ 200 /fi /eacute ] >> >>", info]
    kids = []
    for items in pages:
        body = b"".join(b"BT /F1 %g Tf 1 0 0 1 %g %g Tm (%s) Tj ET\n" % (s, x, y, t.replace("(", r"\(").replace(")", r"\)").encode("cp1252")) for x, y, s, t in items)
        data = zlib.compress(body) if compress else body
        objects.append(b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), b"/Filter /FlateDecode" if compress else b"", data))
        objects.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % len(objects))
        kids.append(b"%d 0 R" % len(objects))
    objects[1] = b"<< /Type /Pages /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> /Kids [%s] /Count %d >>" % (b" ".join(kids), len(kids))
    out = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, o) for i, o in enumerate(objects))
    return out + b"trailer << /Root 1 0 R /Info 4 0 R >>\n%%EOF"


def paper():
    one = [(60, 700, 18, "A Study Of Odd Things"), (60, 660, 11, "Ann Lee and Bo Roe"), (60, 630, 10, "Abstract We looked at it."), (60, 600, 10, "1 Introduction"), (60, 588, 10, "As shown [1], [2] the micro-"), (60, 576, 10, "scope works and a microscope is good."), (60, 20, 9, "doi:10.1000/odd.1"), (60, 770, 9, "Journal of Odd 1")]
    two = [(60, 770, 9, "Journal of Odd 2"), (60, 700, 10, "More body text (here)."), (60, 680, 12, "References"), (60, 660, 10, "[1] A. Smith, First long title of a work, J. X 1(2), 3-4, 2001."), (60, 640, 10, "[2] B. Poe, Second long title of a work, J. Y 2002. doi:10.1000/y.2")]
    return make_pdf([one, two])


def test_reader():
    s = pdf.NativeBackend().open(make_pdf([[(10, 20, 12, "Hello (World)")]], compress=False))
    p = s.page(1)
    assert s.page_count() == 1 and p.spans[0][0] == "Hello (World)" and p.spans[0][1:3] == (10, 20) and p.spans[0][6] == 12 and s.info()["Title"] == "Untitled"
    assert pdf.glyph_text("eacute") == "é" and pdf.glyph_text("uni00410042") == "AB" and pdf.glyph_text("alpha") == "α" and pdf.glyph_text("seven") == "7" and pdf.glyph_text("nonsense") == "�"
    assert pdf.unicode_map(b"2 beginbfchar <01> <0041> <02> <00660069> endbfchar 1 beginbfrange <05> <07> <0061> endbfrange") == {1: "A", 2: "fi", 5: "a", 6: "b", 7: "c"}
    assert pdf.cluster([(0, 0, 5, 5), (8, 0, 12, 5), (100, 100, 101, 101)]) == [(0, 0, 12, 5), (100, 100, 101, 101)]


def test_broken_files(spark):
    rows = [("a", bytearray(b"no pdf")), ("b", bytearray(make_pdf([]))), ("c", None), ("d", bytearray(paper()[:700]))]
    got = pdf.read_pages(spark.createDataFrame(rows, "hash string, content binary")).collect()
    assert {r.doc_hash for r in got if r.page == 0} >= {"a", "c"}


def test_pipeline(spark):
    t = pipeline.extract(spark.createDataFrame([("h", bytearray(paper()), "x")], "hash string, content binary, page string"))
    meta = t["metadata"].first()
    assert meta.title == "A Study Of Odd Things" and meta.doi == "10.1000/odd.1" and meta.provenance["title"] == "page1" and meta.abstract == "We looked at it."
    refs = t["references"].orderBy("idx").collect()
    assert [r.label for r in refs] == ["[1]", "[2]"] and refs[1].doi == "10.1000/y.2" and refs[0].year == 2001
    assert [r.targets for r in t["markers"].collect()] == [[1, 2]]
    text = {r.page: r.text for r in t["texts"].collect()}
    assert "the microscope" in text[1] and "Journal of Odd" not in text[1]
    assert t["chunks"].count() == 2 and t["roles"].filter("role = 'heading'").count() == 2
