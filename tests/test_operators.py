import random

import pytest
from pyspark.sql import functions as F

from quillmill.operators import citations as C
from quillmill.operators import cleanup as U
from quillmill.operators import evaluate as E
from quillmill.operators import ledger as L
from quillmill.operators import lines as N
from quillmill.operators import metadata as M
from quillmill.operators import records as R
from quillmill.operators import regions as G
from quillmill.operators import resolve as V
from quillmill.operators import search as S


def span(i, text, x0, y0, x1, size=10.0, seq=None):
    x0, y0, x1 = float(x0), float(y0), float(x1)
    return {"span_idx": i, "text": text, "x0": x0, "y0": y0, "x1": x1, "y1": y0 + size, "size": size, "seq": i if seq is None else seq, "font": "F"}


def two_columns():
    spans, i = [], 0
    spans.append(span(0, "A Wide Title Over Both Columns Of The Page", 60, 740, 550, 18.0))
    for r in range(6):
        for x in (60, 320):
            i += 1
            spans.append(span(i, f"{'left' if x == 60 else 'right'} line {r} of text here", x, 690 - 12 * r, x + 220))
    return spans


def test_reading_order_of_columns(spark):
    spans = two_columns()
    random.Random(1).shuffle(spans)
    texts = [ln.text for ln in N.order_page(spans, 612)]
    assert texts[0].startswith("A Wide") and texts[1:7] == [f"left line {r} of text here" for r in range(6)] and texts[7].startswith("right line 0")
    df = spark.createDataFrame([("d", 1, *[s[c] for c in ("span_idx", "text", "x0", "y0", "x1", "y1", "font", "size", "seq")]) for s in spans], "doc_hash string, page int, span_idx int, text string, x0 double, y0 double, x1 double, y1 double, font string, size double, seq int")
    got = [r.text for r in N.page_lines(df).orderBy("line_idx").collect()]
    assert got == texts


def test_line_joins_spans_and_accents():
    lines = N.group_lines([span(0, "caf", 10, 100, 25), span(1, "e", 25, 100, 30), span(2, "́", 25, 100.5, 30, seq=3), span(3, "bar", 40, 100, 55, seq=4), span(4, "far", 300, 100, 315, seq=5)])
    assert [ln.text for ln in lines] == ["café bar", "far"]
    assert N.group_lines([]) == [] and N.order_lines([], 612) == []


def test_furniture(spark):
    rows = []
    for p in range(1, 5):
        rows += [("d", p, 0, f"Journal of Things {p}", 760.0, 775.0), ("d", p, 1, f"body text {'abcd'[p - 1]}", 400.0, 410.0), ("d", p, 2, str(p), 20.0, 30.0)]
    df = spark.createDataFrame(rows, "doc_hash string, page int, line_idx int, text string, y0 double, y1 double").withColumn("page_height", F.lit(792.0))
    got = {(r.page, r.line_idx) for r in U.page_furniture(df).collect()}
    assert got == {(p, i) for p in range(1, 5) for i in (0, 2)}
    kept = {r.page: r.text for r in U.rebuild(df, U.page_furniture(df)).collect()}
    assert kept[1] == "body text a"


def test_hyphens(spark):
    count = {"micro-scope": 0, "microscope": 2, "well-known": 3, "wellknown": 0}.get
    assert U.hyphen_policy("micro", "scope", lambda w: count(w) or 0) == "join"
    assert U.hyphen_policy("well", "known", lambda w: count(w) or 0) == "keep"
    df = spark.createDataFrame([("d", 1, 0, "the micro-"), ("d", 1, 1, "scope is a microscope"), ("d", 2, 0, "no break"), ("d", 2, 1, None)], "doc_hash string, page int, line_idx int, text string")
    got = [r.text for r in U.join_hyphens(df).orderBy("page", "line_idx").collect()]
    assert got == ["the microscope", "is a microscope", "no break", ""]


def test_sections_and_entries(spark):
    body = ["Intro", "text [1]", "References", "[1] A. Smith, “The first long title,” J. X, 2001.", "[2] B. Lee. Second long title. J. Y 2002; 1:2-", "9.", "[3] C. Roe, 2003."]
    df = spark.createDataFrame([("d", 1, i, t) for i, t in enumerate(body)] + [("e", 1, 0, "nothing here")], "doc_hash string, page int, line_idx int, text string")
    assert [(r.doc_hash, r.line_idx) for r in C.reference_sections(df).collect()] == [("d", 2)]
    got = C.reference_entries(df).orderBy("idx").collect()
    assert [r.label for r in got] == ["[1]", "[2]", "[3]"] and got[1].raw.endswith("2- 9.")
    parsed = C.parse_entries(C.reference_entries(df)).orderBy("idx").collect()
    assert parsed[0].title == "The first long title" and parsed[0].year == 2001 and parsed[0].authors == ["A. Smith"]


def test_segment_restart_and_author_year():
    assert [a for a, _ in C.segment(["1. A 2001", "2. B 2002", "3. C 2003", "4. D 2004", "1. Appendix 2005"])] == ["1.", "2.", "3.", "4."]
    got = C.segment(["Smith, A. (2001). One.", "more of it", "Lee, B. (2002). Two."])
    assert [r for _, r in got] == ["Smith, A. (2001). One. more of it", "Lee, B. (2002). Two."]
    assert C.segment([]) == []


def test_markers(spark):
    d = spark.createDataFrame([("1, 3–5",), ("0",), ("5-3",), ("7",), ("1-99",)], "x string")
    assert [r[0] for r in d.select(C.cited_numbers(F.col("x"), F.lit(6))).collect()] == [[1, 3, 4, 5], None, None, None, None]
    p = spark.createDataFrame([("d", 1, "As [1], [2] and [4]–[6] show."), ("d", 2, None)], "doc_hash string, page int, text string")
    n = spark.createDataFrame([("d", 9)], "doc_hash string, n int")
    assert [(r.offset, r.targets) for r in C.numeric_markers(p, n).orderBy("offset").collect()] == [(3, [1, 2]), (16, [4, 5, 6])]
    t = spark.createDataFrame([("Smith et al. (2001) and others (Lee, 2002a,b; 2003).",)], "x string")
    got = t.select(C.author_year_groups(F.col("x"))).first()[0]
    assert [(g.name, g.years) for g in got] == [("Smith et al.", ["2001"]), ("Lee", ["2002a", "2002b"]), ("Lee", ["2003"])]
    m = spark.createDataFrame([("d", 1, 5, "x", "Lee", ["2002b"]), ("d", 1, 9, "y", "Roe and Poe", ["2003"])], "doc_hash string, page int, offset int, text string, name string, years array<string>")
    e = spark.createDataFrame([("d", 0, "Lee", 2002), ("d", 1, "Lee", 2002), ("d", 2, "Roe", 2003)], "doc_hash string, idx int, surname string, year int")
    assert {r.offset: r.targets for r in C.resolve_author_year(m, e).collect()} == {5: [1], 9: [2]}


def test_links(spark):
    e = spark.createDataFrame([("d", 1, 0, 60.0, 700.0, 612.0), ("d", 1, 1, 60.0, 600.0, 612.0)], "doc_hash string, page int, idx int, x0 double, top double, page_width double")
    k = spark.createDataFrame([("d", 1, 100.0, 585.0, 595.0, "https://doi.org/10.1000/X")], "doc_hash string, page int, x0 double, y0 double, y1 double, uri string")
    assert [(r.idx, r.doi_link) for r in C.attach_links(e, k).collect()] == [(1, "10.1000/x")]


def test_metadata(spark):
    d = spark.createDataFrame([("Untitled",), ("main.pdf",), ("A real title",)], "t string")
    assert [r[0] for r in d.select(M.title_is_generic("t")).collect()] == [True, True, False]
    assert M.looks_like_person_name("Ana de la Cruz") and not M.looks_like_person_name("University of 2001")
    rows = [("d", 1, 0, "A Big Title", 18.0, 700.0), ("d", 1, 1, "In Two Lines", 18.0, 680.0), ("d", 1, 2, "Abstract We did it.", 10.0, 600.0), ("d", 1, 3, "And more. doi:10.1000/z9", 10.0, 590.0), ("d", 1, 4, "1 Introduction", 10.0, 580.0), ("d", 1, 5, "words", 10.0, 570.0)]
    lines = spark.createDataFrame(rows, "doc_hash string, page int, line_idx int, text string, size double, y1 double").withColumn("y0", F.col("y1") - 10).withColumn("page_height", F.lit(792.0))
    assert M.title_block(lines).first().title == "A Big Title In Two Lines"
    assert M.page1_abstract(lines).first().abstract == "We did it. And more. doi:10.1000/z9"
    assert M.page1_doi(lines).first().doi == "10.1000/z9"
    m = spark.createDataFrame([("d", "untitled", "Ann Bo; Cy Dee", "D:2010", None, "Printed", "10.1/x", 2001, None)], "doc_hash string, info_title string, info_author string, info_date string, info_subject string, page_title string, page_doi string, page_year int, arxiv_id string")
    r = M.merge_metadata(m).first()
    assert r.title == "Printed" and r.year == 2010 and r.provenance["title"] == "page1" and r.authors == ["Ann Bo", "Cy Dee"]


def test_regions():
    rows = [{"text": t, "x0": 60.0, "x1": 200.0, "y0": 700.0 - 12 * i, "y1": 710.0 - 12 * i, "role": "body"} for i, t in enumerate(["This is a long prose line that goes on and on here.", "0.1 0.2 0.3", "a b", "1 2 3", "Figure 2: What was seen.", "Another long prose line that is not part of it at all."])]
    assert G.tag_page(rows) == ["body", "figure", "figure", "figure", "caption", "body"]
    assert G.tag_page([]) == []


def test_components_and_merge(spark):
    edges = spark.createDataFrame([(i, f"k{i}") for i in range(40)] + [(i + 1, f"k{i}") for i in range(39)] + [(100, "z"), (101, "z"), (200, "q")], "n bigint, k string")
    got = {r.n: r.component for r in R.components(edges, "n", "k").collect()}
    assert all(got[i] == 0 for i in range(40)) and got[100] == got[101] == 100 and got[200] == 200
    rec = spark.createDataFrame([(1, "A title", ["X"], 2001, None, "10.1000/a", None, "pmc"), (2, "a Title!", [], 2001, "V", None, None, "crossref"), (3, None, None, None, None, "doi:10.1000/A", "2101.00001", "other"), (4, None, None, None, None, None, None, "other")], "rec_id bigint, title string, authors array<string>, year int, venue string, doi string, arxiv_id string, source string")
    m = {r.component: r for r in R.merge_records(rec).collect()}
    assert m[1].members == 3 and m[1].source == "crossref" and m[1].title == "a Title!" and m[1].authors == ["X"] and m[1].arxiv_id == "2101.00001" and m[4].members == 1


def test_resolution(spark):
    d = spark.createDataFrame([("smith, j. the long title of some work. 2001", "The Long Title of Some Work", "John Smith", 2000), ("smith, j. other words entirely here. 2001", "The Long Title of Some Work", "John Smith", 2001), ("smith 1990", "The Long Title of Some Work", "John Smith", 2001)], "e string, t string, a string, y int")
    s = [r[0] for r in d.select(V.verify(F.col("e"), F.col("t"), F.col("a"), F.col("y"))).collect()]
    assert s[0] == 1 and s[1] is None and s[2] is None
    c = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.88), (2, "a", 0.9), (2, "b", 0.5), (3, "a", None)], "entry_id int, doi string, score double")
    assert {r.entry_id: (r.doi, r.outcome) for r in V.select_records(c).collect()} == {1: ("a", "ambiguous"), 2: ("a", "verified")}
    assert spark.createDataFrame([("Łukasz Ågrén",)], "x string").select(V.folded(F.col("x"))).first()[0] == "lukasz agren"


def test_alignment_and_errors(spark):
    r = random.Random(3)

    def table(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(200):
        a, b = ([r.randrange(4) for _ in range(r.randrange(20))] for _ in range(2))
        assert E.lcs_length(a, b) == table(a, b)
    assert E.alignment([], []) == 1 and E.alignment(["a"], []) == 0
    d = spark.createDataFrame([("the cat sat", "the bat sat down"), ("", "x")], "a string, b string")
    assert [x[0] for x in d.select(E.word_error_rate(F.col("a"), F.col("b"))).collect()] == [2 / 3, None]


def test_greedy_matching(spark):
    t = [{"doi": "x", "title": "one two"}, {"title": "three four five six", "year": 2001}, {"author": "roe", "year": 2003}, {"title": "part 1 of it"}]
    e = [{"title": "three four five six", "year": 2002}, {"title": "three four five six", "year": 2001}, {"doi": "x"}, {"author": "roe", "year": 2003}, {"title": "part 2 of it"}]
    got = {(a, b): m for a, b, m, _ in E.greedy_match(t, e)}
    assert got[0, 2] == "doi" and got[1, 1] == "title" and got[2, 3] == "author_year" and (3, 4) not in got


def test_search(spark):
    c = spark.createDataFrame([(1, "red fish blue fish"), (2, "one red bird"), (3, None), (4, "green ham")], "chunk_id int, text string")
    qs = spark.createDataFrame([(7, "Red fish"), (8, "zzz"), (9, "")], "query_id int, query string")
    got = S.top_k(S.bm25(c, qs), 5, "chunk_id").orderBy("rank").collect()
    assert [(r.query_id, r.chunk_id) for r in got] == [(7, 1), (7, 2)]
    r = random.Random(6)
    many = spark.createDataFrame([(i, " ".join(r.choices("abcdefghijklmnopqrstuvwxyz", weights=[2 ** (k / 2) for k in range(26)], k=r.randrange(1, 30)))) for i in range(300)], "chunk_id int, text string")
    asks = spark.createDataFrame([(i, " ".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=4))) for i in range(30)], "query_id int, query string")
    for k in (1, 7):
        plain = S.top_k(S.bm25(many, asks).withColumn("score", F.round("score", 9)), k, "chunk_id")
        assert sorted(map(tuple, plain.select("query_id", "chunk_id", "rank").collect())) == sorted(map(tuple, S.bm25_top_k(many, asks, k).select("query_id", "chunk_id", "rank").collect()))
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0])], "vec_id int, embedding array<float>")
    qv = spark.createDataFrame([(5, [1.0, 0.1])], "query_id int, query_vec array<float>")
    assert [r.vec_id for r in S.vector_search(v, qv, 3).orderBy("rank").collect()] == [1, 3, 2]
    assert S.vector_search(v, qv.limit(0), 3).count() == 0
    assert S.hybrid_search(c, qs, 0).count() == 0 and S.hybrid_search(c, qs, 2).filter("query_id = 7").orderBy("rank").first().chunk_id == 1
    assert S.reciprocal_rank_fusion([(0.0, S.vector_search(v, qv, 3))], "vec_id").count() == 0


def test_lexical_search_in_many_blocks_and_shards(spark, monkeypatch):
    """Queries beyond a block do not each read the chunks in a branch of their own; scores are not rounded."""
    for name, n in (("QUERY_BLOCK", 8), ("SHARD_ROWS", 32), ("DENSE", 4), ("CANDIDATES", 16)):
        monkeypatch.setattr(S, name, n)
    r = random.Random(9)
    c = spark.createDataFrame([(f"k{i}", " ".join(r.choices("abcdefghijklmnopqrstuvwxyz", weights=[2 ** (k / 2) for k in range(26)], k=r.randrange(30))) or None) for i in range(300)], "chunk_id string, text string")
    qs = spark.createDataFrame([(i, " ".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(7)))) for i in range(60)], "query_id int, query string")
    for k in (3, 400):
        got = S.bm25_top_k(c, qs, k)
        want = S.top_k(S.bm25(c, qs).withColumn("by", F.round("score", 9)), k, "chunk_id", by="by").select("query_id", "chunk_id", "score", "rank").collect()
        assert {(x.query_id, x.chunk_id, x["rank"]): x.score for x in got.collect()} == pytest.approx({(x.query_id, x.chunk_id, x["rank"]): x.score for x in want}, abs=1e-12)
    # One read by each task that shares out the shards, however many blocks of queries.
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") <= spark.sparkContext.defaultParallelism
    assert S.bm25_top_k(c.limit(0), qs, 3).count() == 0 == S.bm25_top_k(c, qs.limit(0), 3).count()


def test_fused_search_is_run_once(spark, data):
    from pyspark.sql import functions as F

    from quillmill.plans import search as P

    d = P.search_fused(spark, data)
    assert "MapInArrow" not in d._jdf.queryExecution().optimizedPlan().toString()
    best = d.groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("m"))
    assert best.filter("n <> m OR n > 50").count() == 0 < best.count()


def test_vector_search_in_many_blocks_and_shards(spark, monkeypatch):
    """Ties within the error of a sum go by key; queries beyond a block do not each read the vectors."""
    import numpy as np

    for name, n in (("QUERY_BLOCK", 8), ("SHARD_ROWS", 32), ("CANDIDATES", 16)):
        monkeypatch.setattr(S, name, n)
    r = np.random.default_rng(4)
    # The same directions in other lengths: equal but for rounding.
    way = r.standard_normal((40, 7))
    rows = [(i, (way[i % 40] * (1 + 0.37 * i)).tolist()) for i in range(300)] + [(900, [0.0] * 7)]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    qs = spark.createDataFrame([(i, way[i].tolist()) for i in range(40)], "query_id int, query_vec array<double>")
    got = S.vector_search(v, qs, 12)
    m = np.array([x for _, x in rows])
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
    by = np.round(way / np.linalg.norm(way, axis=1, keepdims=True) @ m.T, 9)
    ids = np.array([i for i, _ in rows])
    want = {(q, int(ids[x]), n + 1) for q in range(40) for n, x in enumerate(np.lexsort((ids, -by[q]))[:12])}
    assert {(x.query_id, x.vec_id, x["rank"]) for x in got.collect()} == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") <= spark.sparkContext.defaultParallelism
    assert S.vector_search(v.limit(0), qs, 3).count() == 0


def test_windows():
    words = [f"w{i}" for i in range(450)]
    assert S.window_spans(words) == [(0, 200), (160, 360), (320, 450)]
    words[149] = "end."
    words[150] = "Start"
    assert S.window_spans(words)[0] == (0, 150) and S.window_spans([]) == []


def test_running_chunk_index(spark):
    p = spark.createDataFrame([("d", 1, " ".join(["x"] * 250)), ("d", 2, "y"), ("d", 3, None)], "doc_hash string, page int, text string")
    assert [(r.page, r.idx) for r in S.chunk_pages(p).orderBy("idx").collect()] == [(1, 0), (1, 1), (2, 2)]


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "runs")
    a = spark.createDataFrame([("k1", "aa1", 1), ("k2", "ab2", 1)], "run_key string, hash string, v int")
    b = spark.createDataFrame([("k2", "ab2", 2), ("k3", "cc3", 2)], "run_key string, hash string, v int")
    for df in (a, b, b):
        L.publish(L.with_prefix(df), path)
    assert {(r.run_key, r.v) for r in spark.read.parquet(path).collect()} == {("k1", 1), ("k2", 2), ("k3", 2)}
    m = spark.createDataFrame([({"b": "2", "a": "1"},), ({"a": "1", "b": "2"},)], "m map<string,string>")
    assert m.select(L.config_digest(F.col("m"))).distinct().count() == 1
    n = spark.createDataFrame([("d", 1, "complete", "abcdef"), ("d", 2, "complete", "abc"), ("e", 1, "complete", "abc")], "doc_hash string, page int, status string, text string")
    c = spark.createDataFrame([("d", 1, "complete", "ab"), ("d", 2, "complete", "abc"), ("e", 1, "complete", "abcd")], "doc_hash string, page int, status string, text string")
    assert {r.doc_hash: (r.use, r.reason) for r in L.prefer_candidate(n, c).collect()} == {"d": ("native", "text lost"), "e": ("candidate", None)}


def test_verifiable_pairs_are_all_pairs_that_verify(spark, data):
    from pyspark.sql import functions as F

    from quillmill.operators import resolve as V
    from quillmill.session import cut, table

    e = table(spark, data, "extracted_refs").select(F.col("ext_id").alias("entry_id"), V.folded(F.col("raw")).alias("entry"))
    r = table(spark, data, "source_refs").select(F.col("ref_id").alias("record_id"), V.folded(F.col("title")).alias("title"), V.folded(F.get("authors", F.lit(0))).alias("author"), "year", F.col("doi"))
    # A year off, a misread surname, no year, no author, neither title nor year, a neighbour's year without a title.
    extra_e = spark.createDataFrame([(-1, "smyth j. gentle rivers carry heavy stones. j. x 2002"), (-2, "unheard, k. notes. 1999")], e.schema)
    extra_r = spark.createDataFrame([(-k, t, a, y, None) for k, (t, a, y) in enumerate([("gentle rivers carry heavy stones", "John Smythe", 2001), ("gentle rivers carry heavy stones", "John Smythe", None), ("gentle rivers carry heavy stones", None, 2003), (None, "Karl Unheard", None), ("notes", "Karl Unherd", 2000), ("notes", "Karl Other", 2000)], 1)], r.schema)
    e, r = cut(e.unionByName(extra_e)), cut(r.unionByName(extra_r))
    found = lambda p: {(x.entry_id, x.record_id) for x in p.filter(V.verify(F.col("entry"), F.col("title"), F.col("author"), F.col("year")).isNotNull()).select("entry_id", "record_id").collect()}
    want = found(e.repartition(8).crossJoin(F.broadcast(r)))
    assert found(V.verifiable_pairs(e, r)) == want and {(-1, -1), (-1, -2), (-1, -3), (-2, -4), (-2, -5)} <= want and (-2, -6) not in want


def test_titles_of_any_script_against_brute_force(spark, tmp_path):
    import itertools
    import unicodedata
    from collections import Counter

    import pytest

    from quillmill.plans import catalog

    titles = ["Größe der Flüsse", "größe, der flüsse!", "Тихие реки", "тихие РЕКИ", "静かな川", "静かな川", "A plain one", "A plain one", "", None]
    split = lambda t: "".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in t).split()
    norm = lambda t: split(t.lower())
    rows = [(i, t, "Ли", 2001, f"10.1000/{i}") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "ref_id bigint, title string, surname string, year int, doi string").write.parquet(f"{tmp_path}/source_refs.parquet")
    spark.createDataFrame(rows, "ext_id bigint, title string, surname string, year int, doi string").write.parquet(f"{tmp_path}/extracted_refs.parquet")
    spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, title string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    known = [(i, norm(t)) for i, t in enumerate(titles) if t is not None]
    want = Counter(f"title:{' '.join(w)}|2001" for _, w in known if w) + Counter(f"doi:10.1000/{i}" for i in range(len(titles)))
    assert {r.match_key: r.records for r in run("record_keys")} == want
    assert {(i, i) for i, w in known if w} <= {(r.t_idx, r.e_idx) for r in run("exact_title_pass")} <= {(i, i) for i, _ in known}
    assert {r.ref_id: r.fts for r in run("search_query_text")} == {i: " OR ".join(f'"{w}"' for w in split(titles[i])) or None for i, _ in known}

    def edits(a, b):
        line = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            line = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j: min(left + 1, line[j] + 1, line[j - 1] + (c != b[j - 1])), initial=i))
        return line[-1]

    similar = {r.doc_id: (r.jaccard, r.similarity) for r in run("title_similarity")}
    for i, (a, b) in enumerate(itertools.pairwise([norm(t or "") for t in titles])):
        x, y = " ".join(a), " ".join(b)
        jaccard = len({*a} & {*b}) / len({*a} | {*b}) if a and b else 0.0
        assert similar[i] == pytest.approx((jaccard, 1 - edits(x, y) / max(len(x), len(y)) if x or y else 1.0))
    assert len(similar) == len(titles) - 1
