"""Sources, sinks and streams."""

import json

from pyspark.sql import functions as F

from quire.sources import jsonl
from quire.sources.pages import PageLines, html_blocks
from quire.streaming import ingest


def test_jsonl(spark, tmp_path):
    f = tmp_path / "r.jsonl"
    f.write_text('{"a": 1, "b": "x"}\n\n{bad\n{"a": 2, "b": "y"}\n')
    good, bad = jsonl.read_lenient(spark, str(f), "a int, b string")
    assert sorted((r["a"], r["b"]) for r in good.collect()) == [(1, "x"), (2, "y")]
    assert [r["line"] for r in bad.collect()] == ["{bad"]
    assert jsonl.read_optional(spark, str(tmp_path / "none"), "a int").count() == 0
    jsonl.write(spark.createDataFrame([(1, None), (2, "z")], "a int, b string"), str(tmp_path / "out"), ["a"])
    lines = [json.loads(x) for p in (tmp_path / "out").glob("part*") for x in p.read_text().splitlines()]
    assert {"a": 1} in lines and {"a": 2, "b": "z"} in lines
    assert jsonl.file_hashes(spark, str(tmp_path), "*.jsonl").count() == 1


def test_page_lines(spark, tmp_path):
    spark.dataSource.register(PageLines)
    f = tmp_path / "book.txt"
    f.write_text("a\n\nb\fc\fd\ne")
    got = spark.read.format("page_lines").option("path", str(f)).option("pages", "1,3").load()
    assert sorted((r["page"], r["line_no"], r["text"]) for r in got.collect()) == [(1, 1, "a"), (1, 3, "b"), (3, 1, "d"), (3, 2, "e")]


def test_html_blocks(spark):
    df = spark.createDataFrame([(1, "<h1>T <b>x</b></h1><p>one</p><ul><li>i</li></ul>"), (2, None)], "page_id int, html string")
    assert [(r["kind"], r["text"]) for r in html_blocks(df).orderBy("block_no").collect()] == [("heading", "T x"), ("paragraph", "one"), ("list", "i")]


def test_ingest(spark, tmp_path):
    for window, rows in (("pages-0001-0002", [(1, "a", 1), (2, "b", 1)]), ("pages-0003-0004", [(2, "c", 2), (3, "d", 1)])):
        (tmp_path / "in" / window).mkdir(parents=True)
        (tmp_path / "in" / window / "r.json").write_text("\n".join(json.dumps(dict(zip(("id", "text", "at"), r))) for r in rows))
    s = ingest.page_stream(spark, str(tmp_path / "in"), "id int, text string, at int")
    ingest.ingest(s, str(tmp_path / "t"), ["id"], "at", str(tmp_path / "cp")).awaitTermination()
    version = spark.read.text(str(tmp_path / "t" / "_current")).first()[0]
    got = spark.read.parquet(str(tmp_path / "t" / version))
    assert sorted((r["id"], r["text"]) for r in got.collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_progress_stream(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.write.parquet(str(tmp_path / "e"))
    s = ingest.progress(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")))
    q = s.writeStream.format("memory").queryName("progress").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("progress").agg(F.sum("n")).first()[0] == e.count()
