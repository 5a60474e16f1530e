from pyspark.sql import functions as F

from quillmill import __main__ as cli
from quillmill.functions import identifiers as I
from quillmill.functions import web as W
from quillmill.operators import ledger as L
from tests.test_pdf import paper


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(paper())
    (tmp_path / "in" / "b.pdf").write_bytes(b"broken")
    out, idx = str(tmp_path / "ledger"), str(tmp_path / "index")
    for _ in range(2):
        cli.main(["extract", str(tmp_path / "in"), out])
        cli.main(["index", out, idx])
    assert spark.read.parquet(f"{out}/references").count() == 2
    cli.main(["query", idx, "microscope works", "--mode", "lexical"])
    cli.main(["stats", idx])
    said = capsys.readouterr().out
    assert "microscope works" in said and "documents\t1" in said


def test_addresses_and_pages(spark):
    d = spark.createDataFrame([("https://x.org/doi/10.1000%2Fab.1/full?x=1", '<meta name="citation_doi" content="10.1000/zz"><p>arXiv:2101.00001v2 and arXiv: 2101.00001</p>')], "u string, h string")
    r = d.select(I.dois_in_url("u"), W.inspect_page(F.col("u"), F.col("h"))).first()
    assert r[0] == ["10.1000/ab.1"] and r[1].primary_doi == "10.1000/zz" and r[1].arxiv_ids == ["2101.00001"]
    c = spark.createDataFrame([([("a", 0), ("b", 5), ("c", 50)],)], "c array<struct<name:string,expires:bigint>>").select(W.live_cookies(F.col("c"), F.lit(10))).first()[0]
    assert [x.name for x in c] == ["a", "c"]


def test_nested_result(spark):
    run = spark.createDataFrame([("k", 1)], "run_key string, v int")
    p = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a")], "run_key string, page int, text string")
    e = spark.createDataFrame([("k", 0, "r")], "run_key string, idx int, raw string")
    m = spark.createDataFrame([], "run_key string, page int, offset int, text string")
    r = L.load_result(run, p, e, m).first()
    assert [x.text for x in r.pages] == ["a", "b"] and r.references[0].raw == "r" and r.markers is None
