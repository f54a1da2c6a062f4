"""Operators on small fixtures whose results are known."""

import pytest
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import chunks, corpus, layout, lines, retrieval, semantics, tables
from quire.sources.pages import parse_pages, sample_pages


def test_page_ranges():
    assert parse_pages("1-3, 7,2", 9) == [1, 2, 3, 7]
    assert parse_pages(None, 3) == [1, 2, 3]
    for bad in ("3-1", "0", "1-10", "x"):
        with pytest.raises(ValueError):
            parse_pages(bad, 9)
    assert sample_pages(list(range(1, 11)), 3) == [1, 5, 10] or sample_pages(list(range(1, 11)), 3)[0] == 1


@pytest.mark.parametrize(
    "text, strength",
    [("The controller shall return SUCCESS.", "required"), ("The host shall not modify reserved bits.", "prohibited"), ("It may 5 or may 2024.", None), ("It may vary.", "optional"), ("You should test.", "recommended"), ("Plain.", None)],
)
def test_strength(spark, text, strength):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(semantics.strength("t").alias("s")).first()["s"] == strength


def test_requirement_parts(spark):
    df = spark.createDataFrame([(1, 9, "The controller shall report synthetic health status when requested.")], "unit int, page int, text string")
    r = semantics.requirements(df, ["unit"]).first()
    assert (r["condition"], r["testability"], r["intent"]) == ("when requested", "directly_testable", "direct_test")


def test_references():
    found = semantics.references("See Section 2.1 and Table 1; Clauses 4.1, 4.2 and 5. LID 02h")
    assert [(a, b) for a, b, *_ in found] == [("section", "2.1"), ("table", "1"), ("section", "4.1"), ("section", "4.2"), ("section", "5"), ("log_page", "02h")]


def test_resolution(spark):
    refs = spark.createDataFrame([(1, "section", "2.1"), (2, "section", "9"), (3, "log_page", "0x02"), (4, "figure", "1")], "unit int, target_type string, label string")
    targets = spark.createDataFrame([("section", "2.1", "block-3"), ("section", "2-1", "block-4"), ("log_page", "02h", "row-1")], "target_type string, label string, target string")
    got = {r["unit"]: (r["target"], r["unresolved_reason"]) for r in semantics.resolve(refs, targets, ["unit"]).collect()}
    assert got == {1: ("block-3", None), 2: (None, "missing_target_label"), 3: ("row-1", None), 4: (None, "missing_target_type")}


def test_heading_nesting(spark):
    h = spark.createDataFrame([(1, 1, 1, "A"), (1, 2, 3, "B"), (1, 3, 3, "C")], "doc int, o bigint, level int, text string")
    assert [r["path"] for r in layout.heading_paths(h, ["doc"], "o").orderBy("o").collect()] == ["A", "A > B", "A > B > C"]


def test_line_merge(spark):
    rows = [(1, 1, 10.0, 10.0, 20.0, "one"), (1, 2, 12.0, 22.0, 32.0, "two."), (1, 3, 10.0, 34.0, 44.0, "three"), (1, 4, 30.0, 46.0, 56.0, "four")]
    df = spark.createDataFrame(rows, "page int, line_no int, x0 double, top double, bottom double, text string")
    assert [r["run"] for r in lines.merge_runs(df, ["page"]).orderBy("line_no").collect()] == [1, 1, 2, 3]


def test_split_text():
    text = "First sentence. Second one is here. " * 4
    parts = chunks.split_text(text, 50)
    assert all(len(p) <= 50 for p in parts) and " ".join(parts) == text.strip()
    assert chunks.split_text("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    assert chunks.split_text(None, 10) == []


def test_grid_repair():
    assert tables.repair([["a", "", "c"], ["", "b", "d"]]) == [["a", "c"], ["b", "d"]]


def test_diff_of_empty(spark):
    none = spark.createDataFrame([], "doc_id int, sha string")
    one = spark.createDataFrame([(1, "x")], "doc_id int, sha string")
    assert corpus.diff(none, one).first()["status"] == "added"
    assert corpus.diff(one, none).first()["status"] == "removed"


def test_reference_keys(spark):
    df = spark.createDataFrame([("0x002",), ("02h",), ("2.1",), ("Register CAP",)], "l string")
    assert [r["k"] for r in df.select(tx.ref_key("l").alias("k")).collect()] == ["hex:2", "hex:2", "21", "cap"]


def test_partition_invariance(spark):
    """The same rows in other partitions give the same result."""
    rows = [(d, i, f"line {i} of {d}.") for d in range(9) for i in range(1, 30)]
    df = spark.createDataFrame(rows, "doc_id int, line_no int, text string")
    a, b = (sorted(map(tuple, chunks.greedy_groups(x, ["doc_id"], "line_no", F.char_length("text"), 60).select("doc_id", "line_no", "grp").collect())) for x in (df.repartition(7), df.coalesce(1)))
    assert a == b


def test_retrieval_both_ways(spark):
    """By scan and by join; ids of text are joined; no queries, no rows."""
    chunks = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 11}" for k in range(1, 7)), i % 3 or None) for i in range(60)], "chunk_id long, text string, priority int").repartition(4)
    queries = spark.createDataFrame([(i, f"w{i} w{i + 1} w{i + 2} zz") for i in range(8)] + [(9, None)], "query_id long, query string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    scan, join = rows(retrieval.retrieve(chunks, queries, 4)), rows(retrieval.retrieve(chunks, queries, 4, most=0))
    assert scan == join and len(scan) == 32
    named = rows(retrieval.retrieve(chunks.withColumn("chunk_id", F.format_string("%03d", "chunk_id")), queries, 4))
    assert [(q, int(c), r, s) for q, c, r, s in named] == scan
    assert rows(retrieval.retrieve(chunks, queries.limit(0))) == []
