import io
import json
import sqlite3
import tarfile

from pyspark.sql import functions as F

from quillmill.sources import files, latex, registries
from quillmill.sources.library import LibraryItems
from quillmill.streaming import index


def body(spark, *docs):
    return spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),) for d in docs], "body string")


def test_registries(spark):
    w = {"results": [{"id": "W1", "doi": "https://doi.org/10.1000/A", "display_name": "T", "publication_year": 2001, "abstract_inverted_index": {"Hello": [0], "world": [1]}, "authorships": [{"author": {"display_name": "A B"}}], "open_access": {"oa_url": "https://arxiv.org/pdf/1"}}]}
    r = registries.openalex(body(spark, w, "broken{")).collect()
    assert len(r) == 1 and r[0].doi == "10.1000/a" and r[0].abstract_text == "Hello world" and r[0].authors == ["A B"] and r[0].candidates[0].requires_session is False
    c = {"message": {"items": [{"DOI": "10.1000/B", "title": ["A <i>b</i> &amp; c"], "author": [{"given": "X", "family": "Y"}], "issued": {"date-parts": [[1999, 1]]}, "link": [{"URL": "https://p.org/x.pdf", "content-type": "application/pdf"}]}]}}
    r = registries.crossref(body(spark, c)).first()
    assert (r.title, r.year, r.authors, r.candidates[0].url) == ("A b & c", 1999, ["X Y"], "https://p.org/x.pdf")
    s = {"result": {"uids": ["7"], "7": {"uid": "7", "title": "T.", "pubdate": "2003 May", "authors": [{"name": "Z"}], "articleids": [{"idtype": "doi", "value": "10.1000/c"}]}}}
    r = registries.pubmed_summary(body(spark, s)).first()
    assert (r.title, r.year, r.doi, r.pmid) == ("T", 2003, "10.1000/c", "7")
    assert [x.id for x in registries.search_ids(body(spark, {"esearchresult": {"idlist": ["1", "2"]}})).collect()] == ["1", "2"]
    u = registries.unpaywall(body(spark, {"doi": "10.1000/d", "best_oa_location": {"url": "u1"}, "oa_locations": [{"url": "u1"}, {"url_for_pdf": "u2"}]})).collect()
    assert [(x.url, x.is_best) for x in u] == [("u1", True), ("u2", False)]
    z = registries.library_items(body(spark, [{"key": "K", "version": 3, "data": {"title": "T", "date": "May 2004", "extra": "PMID: 5\nDOI: 10.1000/e", "creators": [{"creatorType": "author", "firstName": "A", "lastName": "B"}]}}]))
    r = registries.item_record(z).first()
    assert (r.title, r.year, r.doi, r.pmid, r.authors) == ("T", 2004, "10.1000/e", "5", ["A B"])


def test_latex(spark):
    assert latex.latex_to_text(r"M{\"u}ller \& S\o n --- it's \emph{good} % no") == "Müller & Søn — it's good"
    b = latex.bib_entries('@string{x="y"} @article{k, author = "A. Smith and {Lee, B.}", title = {The {Big} One}, year = 2001, eprint={2101.00001}, archivePrefix={arXiv}}')
    assert b[0]["title"] == "The Big One" and b[0]["year"] == 2001 and b[0]["arxiv_id"] == "2101.00001" and len(b[0]["authors"]) == 2
    t = spark.createDataFrame([(r"\citep[see][p. 2]{a, b} and \textcite{c} %\cite{d}",)], "t string")
    assert t.select(latex.cited_keys(F.col("t"))).first()[0] == ["a", "b", "c"]
    e = spark.createDataFrame([(r"\bibitem[S01]{k} A. Smith. \newblock Title. \newblock 2001.",), (None,)], "t string").select(F.size(latex.parse_bbl(F.col("t")))).collect()
    assert [x[0] for x in e] == [1, 0]


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"abc")
    (tmp_path / "empty.pdf").write_bytes(b"")
    (tmp_path / "b.txt").write_bytes(b"abc")
    s = files.snapshot(spark, str(tmp_path), max_bytes=10).collect()
    assert len(s) == 1 and s[0].hash.startswith("ba7816bf")
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w:gz") as t:
        for name in ("m.tex", "../evil.tex"):
            info = tarfile.TarInfo(name)
            info.size = 2
            t.addfile(info, io.BytesIO(b"hi"))
    got = spark.createDataFrame([(bytearray(buf.getvalue()),), (bytearray(b"%PDF-1"),), (None,)], "b binary").select(files.unpack_source(F.col("b"))).collect()
    assert [x.path for x in got[0][0]] == ["m.tex"] and got[1][0] == [] and got[2][0] == []


def test_library_source(spark, tmp_path):
    path = str(tmp_path / "lib.sqlite")
    with sqlite3.connect(path) as c:
        c.executescript("""CREATE TABLE items(itemID, key, itemTypeID); CREATE TABLE itemTypes(itemTypeID, typeName); CREATE TABLE itemData(itemID, fieldID, valueID); CREATE TABLE fields(fieldID, fieldName); CREATE TABLE itemDataValues(valueID, value); CREATE TABLE deletedItems(itemID);
        INSERT INTO items VALUES (1,'A',1),(2,'B',1),(3,'C',1); INSERT INTO itemTypes VALUES (1,'book'); INSERT INTO itemData VALUES (1,1,1),(3,1,2); INSERT INTO fields VALUES (1,'title'); INSERT INTO itemDataValues VALUES (1,'T1'),(2,'T3'); INSERT INTO deletedItems VALUES (2);""")
    spark.dataSource.register(LibraryItems)
    got = {r.key: r.fields for r in spark.read.format("library_items").option("path", path).load().collect()}
    assert got == {"A": {"title": "T1"}, "C": {"title": "T3"}}


def test_stream_index_is_idempotent(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    a = spark.createDataFrame([(1, "aa", "r1", "x"), (2, "ab", "r1", "y")], "chunk_id int, doc_hash string, run_key string, text string")
    a.write.parquet(src)
    for _ in range(2):
        index.start(index.arriving_chunks(spark, src, a.schema), out, cp).awaitTermination(60)
    spark.createDataFrame([(2, "ab", "r2", "z")], a.schema).write.mode("append").parquet(src)
    index.start(index.arriving_chunks(spark, src, a.schema), out, cp).awaitTermination(60)
    assert {(r.chunk_id, r.text) for r in spark.read.parquet(out).collect()} == {(1, "x"), (2, "z")}
