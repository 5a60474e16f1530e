import pytest
from pyspark.sql import functions as F

from quillmill.functions import web as W
from quillmill.operators import bibliography as B
from quillmill.operators import citations as C
from quillmill.operators import evaluate as E
from quillmill.operators import metadata as M
from quillmill.operators import resolve as V
from quillmill.operators import search as S

LIST = "References\n[1] Adams, A. One. 2001.\n[2] Brown, B. Two. 2002.\n[3] Clark, C. Three. 2003."


def test_scan_backward(spark):
    pages = spark.createDataFrame(
        [("a", 1, "Text\nReferences\nonly one\n"), ("a", 2, "more"), ("a", 3, LIST), ("a", 4, None), ("b", 1, "No list"), ("c", 1, LIST.replace("[3]", "[9]")), ("d", 1, "x " * 20_000), ("a", 3, LIST)][:7],
        "doc_hash string, page int, text string",
    ).withColumn("line", F.lit("clash"))
    got = {r.doc_hash: r for r in B.scan_backward(pages).collect()}
    assert (got["a"].page, got["a"].line_no, got["a"].entries, got["a"].plausible, got["a"].complete, got["a"].pages_read) == (3, 0, 3, True, True, 2)
    assert not got["b"].complete and got["b"].pages_read == 1 and got["b"].page is None and not got["d"].complete
    assert got["c"].complete and not got["c"].plausible
    assert {r.doc_hash for r in B.scan_backward(pages, floor=4).collect()} == {"a"} and B.scan_backward(pages.limit(0)).count() == 0


def test_keep_better(spark):
    first = spark.createDataFrame([("a", 1, "none"), ("b", 1, LIST)], "doc_hash string, page int, text string")
    second = spark.createDataFrame([("a", 1, LIST), ("b", 1, LIST + "\n[4] Dole, D. Four. 2004.")], "doc_hash string, page int, text string")
    got = {r.doc_hash: (r.route, r.tried, r.entries) for r in B.scan_auto(first, second).collect()}
    assert got == {"a": ("second", "first>second", 3), "b": ("first", "first", 3)}
    same = B.scan_backward(first)
    assert {r.route for r in B.keep_better([("x", same), ("y", same)]).collect()} == {"x"}


def test_first_page(spark):
    lines = spark.createDataFrame([("a", 1, 0, "1999 was a year", 50.0, 55.0, 100.0), ("a", 1, 1, "Published 2004", 50.0, 55.0, 100.0), ("a", 1, 2, "Keywords", 1.0, 2.0, 100.0), ("a", 1, 3, "one; two.", 1.0, 2.0, 100.0), ("b", 2, 0, "2001", 1.0, 2.0, 100.0), ("c", 1, 0, None, 1.0, 2.0, 100.0)], "doc_hash string, page int, line_idx int, text string, y0 double, y1 double, page_height double")
    assert [(r.doc_hash, r.year) for r in M.page1_year(lines).collect()] == [("a", 2004)]
    assert [(r.doc_hash, r.keywords) for r in M.page1_keywords(lines).collect()] == [("a", ["one", "two"])]
    assert M.page1_publisher_doi(lines).count() == 0


def test_choices(spark):
    d = spark.createDataFrame([([5, 3], "b", [["A", "B"], ["A", "C", "D"]], "c", False), ([5, 3], "", [["A", "B"], ["A", "C", "D"]], "b", False), ([5, 3], "z", [["A"], ["A", "C", "D"]], None, True), ([7], "b", [["A"]], None, True)], "c array<int>, s string, a array<array<string>>, second string, many boolean")
    got = [(r.p, r.n) for r in d.select(C.pick_by_suffix(F.col("c"), F.col("s")).alias("p"), C.narrow_by_coauthors(F.col("c"), F.col("a"), F.col("second"), F.col("many")).alias("n")).collect()]
    assert got == [([5], [5, 3]), ([5, 3], [5]), ([5, 3], [3]), ([7], [7])]


def test_order_duplicates(spark):
    m = spark.createDataFrame([("d", 1, 9, "x"), ("d", 2, 4, "x"), ("d", 3, 7, "y")], "doc string, t_idx int, e_idx int, method string")
    g = spark.createDataFrame([("d", 1, 0), ("d", 2, 0)], "doc string, t_idx int, g int")
    assert sorted((r.t_idx, r.e_idx) for r in E.order_duplicates(m, g).collect()) == [(1, 4), (2, 9), (3, 7)]


def test_biomedical(spark):
    e = spark.createDataFrame([(1, "Smith J. A study of large rivers. 2001. PMID: 77"), (2, "Else. 1950. PMID: 77"), (3, None)], "entry_id int, raw string")
    r = spark.createDataFrame([(10, "77", "a study of large rivers", "smith j", 2001)], "record_id int, identifier string, title string, author string, year int")
    assert sorted((x.entry_id, x.outcome) for x in V.select_biomedical(e, r).collect()) == [(1, "verified"), (2, "mismatch")]


def test_embedder_of_an_index(spark):
    index = spark.createDataFrame([("hash", 256)], "embedder string, dim int")
    S.check_embedder(index, "hash", 256)
    S.check_embedder(index.limit(0), "other", 3)
    with pytest.raises(ValueError, match="256"):
        S.check_embedder(index, "hash", 128)
    assert spark.range(1).select(W.scholar_search_url(F.lit("a b&c"))).first()[0].endswith("?q=a%20b%26c")


def test_vector_index(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(2)
    centre = r.standard_normal((12, 16))
    rows = [(i, (centre[i % 12] + 0.3 * r.standard_normal(16)).tolist()) for i in range(600)] + [(1000 + i, centre[0].tolist()) for i in range(300)] + [(5000, [0.0] * 16)]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("list", F.lit("clash"))
    queries = v.filter("vec_id % 20 = 0 AND vec_id < 1000").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    monkeypatch.setattr(S, "LIST_ROWS", 50)
    exact = {(x.query_id, x.vec_id) for x in S.vector_search(v, queries, 10).collect()}
    found = {(x.query_id, x.vec_id) for x in S.index_search(v, queries, 10, S.fit_index(v)).collect()}
    assert len(exact & found) >= 0.9 * len(exact) == 0.9 * 300
    assert S.index_search(v.limit(0), queries, 3, S.fit_index(v.limit(0))).count() == 0 and S.index_search(v, queries.limit(0), 3, S.fit_index(v)).count() == 0
