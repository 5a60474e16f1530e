from pyspark.sql import functions as F

from quillmill.operators import cleanup as U
from quillmill.operators import evaluate as E
from quillmill.sources import truth as T


def test_ground_truth(spark):
    rows = [("p", "main.tex", r"\title{A \emph{Big} One}\author{A. Lee \and B. Roe\thanks{x}}\begin{document}\input{s1} \cite{k2}\end{document}"), ("p", "s1.tex", r"text \citep{k1,k3} % \cite{no}"), ("p", "r.bib", "@article{k1, title={One}, year=2001} @book{k2, title={Two}} @misc{k9, title={Nine}}"), ("q", "x.tex", r"\begin{document}\cite{a}\begin{thebibliography}{1}\bibitem{a} A. Lee. \newblock T. \newblock 2001.\end{thebibliography}\end{document}"), ("z", "m.tex", None)]
    got = {r.paper_id: r for r in T.ground_truth(spark.createDataFrame(rows, "paper_id string, path string, text string")).collect()}
    assert got["p"].title == "A Big One" and got["p"].authors == ["A. Lee", "B. Roe"] and got["p"].method == "cited" and [r.key for r in got["p"].refs] == ["k1", "k2"] and got["p"].cited == ["k1", "k3", "k2"]
    assert got["q"].method == "bbl" and got["z"].method == "none"
    t = T.ground_truth(spark.createDataFrame(rows, "paper_id string, path string, text string"))
    assert [(r.paper_id, r.key) for r in T.missing_keys(t).collect()] == [("p", "k3")]


def test_author_and_title_agreement(spark):
    d = spark.createDataFrame([(["Ann Lee", "Lee, Ann", "B. Roe"], ["A. Lee", "Roe, Bo", "X"], "A b c", "a B-c"), ([], None, None, None)], "t array<string>, e array<string>, a string, b string")
    r = d.select(E.author_matches(F.col("t"), F.col("e")), E.title_equal(F.col("a"), F.col("b")), E.paper_title_matches(F.col("a"), F.col("b"))).collect()
    assert tuple(r[0]) == (2, True, True) and r[1][1] is True


def test_marker_correctness(spark):
    m = spark.createDataFrame([("d", [0, 1]), ("d", [1]), ("d", [5])], "doc string, targets array<int>")
    k = spark.createDataFrame([("d", 0, "a"), ("d", 1, "b")], "doc string, e_idx int, key string")
    c = spark.createDataFrame([("d", "a"), ("d", "c"), ("e", "x")], "doc string, key string")
    assert {r.doc: (r.targets, r.correct, r.keys_hit, r.keys_cited) for r in E.marker_correctness(m, k, c).collect()} == {"d": (3, 1, 1, 2), "e": (0, 0, 0, 1)}


def test_clean_up_details(spark):
    schema = "doc_hash string, page int, line_idx int, text string, x0 double, y0 double, x1 double, y1 double, size double"
    lines = spark.createDataFrame([("d", 1, 0, "energy E = mc", 60.0, 700.0, 140.0, 710.0, 10.0), ("d", 1, 1, "2", 141.0, 706.0, 144.0, 712.0, 6.0), ("d", 1, 2, "other line", 60.0, 688.0, 140.0, 698.0, 10.0)], schema)
    assert [(r.line_idx, r.base_idx, r.text) for r in U.merge_scripts(lines).collect()] == [(1, 0, "²")]
    front = spark.createDataFrame([("d", 1, 0, "Title"), ("d", 1, 1, "Ann Lee"), ("d", 1, 2, "Abstract We"), ("d", 1, 3, "more"), ("e", 1, 0, "no stop")], "doc_hash string, page int, line_idx int, text string")
    assert {(r.doc_hash, r.line_idx) for r in U.front_matter(front).collect()} == {("d", 0), ("d", 1)}
    pages = spark.createDataFrame([("d", 1, "Title only"), ("d", 2, "Abstract\nx"), ("e", 1, "Abstract\nx"), ("e", 2, "y")], "doc_hash string, page int, text string")
    assert [r.doc_hash for r in U.is_title_page(pages).collect()] == ["d"]
    foot = spark.createDataFrame([("d", 1, 0, "body", 60.0, 400.0, 200.0, 410.0, 10.0), ("d", 1, 1, "1 a note that goes", 60.0, 80.0, 200.0, 88.0, 8.0), ("d", 2, 0, "body", 60.0, 400.0, 200.0, 410.0, 10.0), ("d", 2, 1, "on here.", 60.0, 80.0, 200.0, 88.0, 8.0)], schema).withColumns({"body_size": F.lit(10.0), "page_width": F.lit(612.0), "page_height": F.lit(792.0)})
    rules = spark.createDataFrame([("d", 1, 60.0, 95.0, 160.0, 95.5)], "doc_hash string, page int, x0 double, y0 double, x1 double, y1 double")
    notes = U.ruled_footnotes(foot, rules)
    assert [(r.page, r.line_idx) for r in notes.collect()] == [(1, 1)]
    assert [(r.page, r.line_idx) for r in U.continued_footnotes(notes, foot).collect()] == [(2, 1)]
    bio = spark.createDataFrame([("d", 1, 0, "Ann Lee received it"), ("d", 1, 1, "References"), ("d", 1, 2, "[1] x 2001"), ("d", 1, 3, "Ann B. Lee received the degree"), ("d", 1, 4, "in 2001.")], "doc_hash string, page int, line_idx int, text string")
    assert sorted(r.line_idx for r in U.biographies(bio).collect()) == [3, 4]


def test_jats(spark):
    from quillmill.sources import jats

    xml = '<article><ref-list><ref id="r1"><label>1</label><mixed-citation><name><surname>Lee</surname><given-names>A</given-names></name>. <article-title>A <i>big</i> one</article-title>. <source>J X</source> <year>2001a</year>;<volume>3</volume>:<fpage>4</fpage>. <pub-id pub-id-type="doi">10.1000/X</pub-id></mixed-citation></ref><ref id="r2"/></ref-list></article>'
    got = jats.article_references(xml)
    assert (got[0]["title"], got[0]["year"], got[0]["authors"], got[0]["doi"]) == ("A big one", 2001, ["A Lee"], "10.1000/x") and got[1]["key"] == "r2"
    d = spark.createDataFrame([(xml,), ("<broken",), (None,), ('<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>',)], "x string")
    assert [r[0] for r in d.select(F.size(jats.parse_jats(F.col("x")))).collect()] == [2, 0, 0, 0]


def test_reports(spark):
    from quillmill.operators import sampling

    a, b = spark.createDataFrame([("r", 0.9), ("p", 0.8), ("x", 1.0)], "metric string, value double"), spark.createDataFrame([("r", 0.95), ("p", 0.7), ("y", 1.0)], "metric string, value double")
    assert {r.metric: r.verdict for r in sampling.compare_reports(a, b).collect()} == {"r": "better", "p": "worse", "x": "gone", "y": "new"}
    rows = spark.range(100).select("id", (F.col("id") % 3).alias("s"))
    one = sampling.stratified(rows, ["s"], "id", 4)
    assert one.groupBy("s").count().filter("count = 4").count() == 3 and one.exceptAll(sampling.stratified(rows.orderBy(F.desc("id")), ["s"], "id", 4)).count() == 0


def test_body_alignment(spark):
    d = spark.createDataFrame([("a", "Figure 1: not this"), ("a", "we keep this line"), ("a", "x = y + 1"), ("a", None)], "doc_hash string, text string")
    assert [r.text for r in E.body_lines(d).collect()] == ["we keep this line"]
    x, y = spark.createDataFrame([("a", "one two three"), ("b", "word")], "doc_hash string, text string"), spark.createDataFrame([("a", "One, three!")], "doc_hash string, text string")
    assert {r.doc_hash: r.score for r in E.body_alignment(x, y).collect()} == {"a": 0.8, "b": 0.0}


def test_percentile_by_rank(spark):
    rows = [("a", float(i)) for i in range(101)] + [("b", 3.0), ("b", 1.0), ("c", None)]
    d = spark.createDataFrame(rows, "g string, v double").repartition(5)
    assert {r.g: r.v for r in E.percentile_by_rank(d, "g", "v", 0.9).collect()} == {"a": 90.0, "b": 3.0}
