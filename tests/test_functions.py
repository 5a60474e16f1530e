from pyspark.sql import functions as F

from quillmill.functions import identifiers as I
from quillmill.functions import text as X
from quillmill.functions import vectors as V
from quillmill.functions import web as W


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


def test_normal_forms(spark):
    assert one(spark, "  The  β-Cell: A Review! ", X.normalize_title) == "the β cell a review"
    assert one(spark, None, X.normalize_title) is None
    assert one(spark, "", X.words) == []
    assert one(spark, " Page 12 \t of  340 ", X.digit_key) == "Page # of #"
    assert one(spark, "a b c d", lambda c: X.leading_words(c, 2)) == "a b"
    assert one(spark, "abcdef", lambda c: X.truncate_chars(c, 3)) == "abc […]"
    assert one(spark, 'two "words" here', X.fts_query) == '"two" OR "words" OR "here"'
    assert one(spark, "…", X.fts_query) is None


def test_line_predicates(spark):
    yes = {"12": X.is_page_number, "Page 3 of 9": X.is_page_number, "xiv": X.is_page_number, "Intro . . . . . 12": X.is_toc, "0.1 0.2 0.3 time": X.is_axis_like, "3.1 4.2 5 6": X.is_mostly_numeric, "x = y + 2": X.is_math_line, "while x do": X.is_algorithm_line, "done.”": X.ends_sentence}
    for text, f in yes.items():
        assert one(spark, text, f) is True, text
    no = {"page of contents": X.is_page_number, "Intro 12": X.is_toc, "We saw that this was so": X.is_math_line, "the end of it all": X.is_algorithm_line}
    for text, f in no.items():
        assert one(spark, text, f) is False, text
    assert one(spark, "Figure 3: A thing", X.caption_kind) == "figure"
    assert one(spark, "Table IV. Things", X.caption_kind) == "table"
    assert one(spark, "Figures are here", X.caption_kind) is None
    assert one(spark, "12", lambda c: X.script_form(c, True)) == "¹²"
    assert one(spark, "micro-\nscope", X.join_break_hyphens) == "microscope"


def test_similarity(spark):
    d = spark.createDataFrame([("kitten", "sitting", ["a", "b"], ["b", "c"])], "a string, b string, x array<string>, y array<string>")
    r = d.select(X.similarity(F.col("a"), F.col("b")), X.jaccard(F.col("x"), F.col("y")), X.similarity(F.lit(""), F.lit("")), X.jaccard(F.array().cast("array<string>"), F.col("y"))).first()
    assert abs(r[0] - (1 - 3 / 7)) < 1e-9 and abs(r[1] - 1 / 3) < 1e-9 and r[2] == 1 and r[3] == 0


def test_identifiers(spark):
    assert one(spark, "https://doi.org/10.1000/ABC.(1)x).", I.normalize_doi) == "10.1000/abc.(1)x"
    assert one(spark, "no doi", I.normalize_doi) is None
    assert one(spark, "see doi:10.1000/x1, and 10.1000/X1 and 10.2000/y.", I.all_dois) == ["10.1000/x1", "10.2000/y"]
    assert one(spark, "arXiv:2101.00001v3 [cs]", I.find_arxiv) == "2101.00001"
    assert one(spark, "hep-th/9901001", I.year_from_arxiv) == 1999
    assert one(spark, "2101.00001", I.year_from_arxiv) == 2021
    assert one(spark, "pmc123", I.normalize_pmcid) == "PMC123"
    assert one(spark, "pp. 1990-1999 (2003)", I.find_year) == 2003
    assert one(spark, "D:20190203", I.year_from_pdf_date) == 2019
    assert one(spark, "[12] A. Smith", I.strip_label) == "A. Smith"
    assert one(spark, "10.1000/xxx", I.is_placeholder_doi) is True
    assert one(spark, "J. X 12(3):45-67", I.parse_numbers).asDict() == {"volume": "12", "issue": "3", "pages": "45–67"}
    assert one(spark, "nothing here", I.parse_numbers) is None
    assert one(spark, "PMID: 12, PMC 345, 999", I.biomedical_ids) == ["12", "PMC345"]
    assert one(spark, "no evidence at all", I.has_reference_evidence) is False


def test_vectors(spark):
    assert V.fnv1a(b"") == 0xCBF29CE484222325 and V.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    d = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>")
    r = d.select(V.norm(F.col("a")), V.l2_normalize(F.col("a")), V.l2_normalize(F.col("z")), V.cosine(F.col("a"), F.col("a")), V.cosine(F.col("a"), F.col("z"))).first()
    assert r[0] == 5 and [round(x, 6) for x in r[1]] == [0.6, 0.8] and r[2] == [0, 0] and abs(r[3] - 1) < 1e-9 and r[4] == 0
    e = V.HashEmbedder(16)
    assert abs((e("some words here") ** 2).sum() - 1) < 1e-6 and not e("").any() and (e("A b") == e("a B")).all()


def test_web(spark):
    assert W.normalize_url_text("HTTP://User@Example.ORG:80/a/../b?utm_source=x&q=1#f") == "http://example.org/b?q=1"
    assert W.normalize_url_text("ftp://x/y") is None and W.normalize_url_text("http://[bad") is None and W.normalize_url_text(None) is None
    assert one(spark, "a%20b+c%FF", lambda c: W.percent_decode(c)) == "a b+c�"
    assert one(spark, "a b/c", W.percent_encode) == "a%20b%2Fc"
    assert one(spark, "www.x.ac.uk", W.registrable_domain) == "x.ac.uk"
    assert one(spark, "https://x.org/a.PDF", W.classify_pdf_url)["verdict"] == "likely"
    assert one(spark, "https://x.org/page", W.classify_pdf_url)["verdict"] == "no"
    assert one(spark, 'attachment; filename="a b.pdf"', W.content_disposition).asDict() == {"kind": "attachment", "filename": "a b.pdf"}
    assert one(spark, '<u1>; rel="next", <u2>; rel="last"', W.link_header) == [("u1", "next"), ("u2", "last")]
    assert one(spark, "bad line", W.netscape_cookie) is None
    c = one(spark, ".x.org\tTRUE\t/\tTRUE\t99\tn\tv", W.netscape_cookie)
    assert (c.domain, c.subdomains, c.secure, c.expires) == ("x.org", True, True, 99)
    html = '<!-- <a href=no> --><meta name="citation_doi" content="doi:10.1/x"><meta name="citation_doi" content="10.1000/Y"><script>var a="<a href=1>"</script><p>A &amp; <b>B</b></p><a href="/p/x.pdf?utm_source=1">t</a>'
    d = spark.createDataFrame([(html, "https://x.org/q/")], "h string, b string")
    r = d.select(W.html_text(F.col("h")), W.declared_dois(W.html_tags(F.col("h"))), W.pdf_links(F.col("h"), F.col("b")), W.attribute_values(W.html_tags(F.col("h")), "a", "href")).first()
    assert r[0] == "A & B t" and r[1] == ["10.1000/y"] and r[2][0].url == "https://x.org/p/x.pdf" and r[3] == ["/p/x.pdf?utm_source=1"]
