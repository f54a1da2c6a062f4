"""Queries over whole tables that have no SQL, against brute force."""

import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire import session
from quire.functions.text import tokens
from quire.operators import chunks, retrieval, semantics, tables
from quire.plans import q_retrieval
from quire.plans.catalog import QUERIES
from quire.plans.corpus_data import rows, spec
from quire.session import table

DATA = "/root/testdata/sf0.001"


def test_union_has_whole_texts(spark):
    got = Counter((r["source_rank"], r["ord"], r["text"], r["token_estimate"]) for r in QUERIES["union_chunks"](spark, DATA).collect())
    want = [(0, r["p_partkey"], r["p_name"]) for r in table(spark, DATA, "part").collect()]
    want += [(1, r["row_id"], r["row_text"]) for r in tables.typed_rows(rows(spark, DATA)).collect()]
    want += [(2, r["doc_id"], r["text"]) for r in table(spark, DATA, "documents").collect()]
    assert got == Counter((a, b, t, None if t is None else (len(t) + 3) // 4) for a, b, t in want)
    assert max(len(t or "") for _, _, t in want) > 80


def test_all_references_are_resolved(spark):
    refs = [(r["unit"], kind, label) for r in spec(spark, DATA).collect() for kind, label, *_ in semantics.references(r["text"])]
    assert {"section", "table", "figure", "log_page", "opcode", "requirement"} <= {kind for _, kind, _ in refs}
    assert Counter(map(tuple, QUERIES["crossref_targets"](spark, DATA).collect())) == Counter(refs)
    exact = {}
    for r in table(spark, DATA, "supplier").collect():
        k = r["s_suppkey"]
        label = str(k % 40) if k % 2 == 0 else f"{k % 9 + 1}{'.' if k % 4 == 1 else '-'}{k % 5 + 1}"
        exact.setdefault(("section" if k % 2 else "table", label), []).append(f"block-{k}")
    got = QUERIES["crossref_resolve"](spark, DATA).collect()
    assert Counter((r["unit"], r["target_type"], r["label"]) for r in got) == Counter(refs)
    for r in got:
        same = exact.get((r["target_type"], r["label"]))
        if same:
            assert r["target"] == max(same)
        elif r["target_type"] not in ("section", "table"):
            assert (r["target"], r["unresolved_reason"]) == (None, "missing_target_type")
        else:
            key = "".join(c for c in r["label"].lower() if c.isalnum())
            near = {t for (kind, label), found in exact.items() if kind == r["target_type"] and "".join(c for c in label if c.isalnum()) == key for t in found}
            assert r["candidates"] == len(near) and r["target"] == (min(near) if len(near) == 1 else None)


def test_html_blocks_of_all_kinds(spark):
    want = Counter()
    for r in table(spark, DATA, "pages").collect():
        for n, m in enumerate(re.finditer(r"<(h[1-6]|p|li)[^>]*>(.*?)</\1>", r["html"] or "", re.I | re.S), 1):
            text = re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", m[2]), flags=re.A).strip(" ")
            if text:
                want[r["page_id"], n, {"h": "heading", "p": "paragraph", "l": "list"}[m[1][0].lower()], text] += 1
    got = Counter((r["page_id"], r["block_no"], r["kind"], r["text"]) for r in QUERIES["html_blocks"](spark, DATA).collect())
    assert got == want and {k[2] for k in want} == {"heading", "paragraph", "list"}


def test_row_pipeline_repeats_no_steps(spark):
    """Each step reads the columns of the one before it, not their expressions."""
    plan = QUERIES["table_row_pipeline"](spark, DATA)._jdf.queryExecution().optimizedPlan()
    assert len(plan.toString()) < 30_000


@pytest.mark.parametrize("name", ["hyphen_repair", "two_column_order", "line_metadata", "warning_order", "warning_policy", "candidate_prune"])
def test_partitions_follow_the_files(spark, monkeypatch, name):
    """Of larger tables a task holds no more: 116 kB of line items in parts of 10."""
    monkeypatch.setattr(session, "TASK_BYTES", 10_000)
    held = QUERIES[name](spark, DATA).select(F.spark_partition_id().alias("at")).distinct().count()
    assert held > 8


def test_parts_of_a_long_batch(spark, monkeypatch):
    """Parts are made of a few texts at a time, whatever the Arrow batch."""
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    runs, real, split = [], type(df).mapInArrow, chunks.split_text
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: runs.append(run) or real(self, run, schema))
    chunks.split_chunks(df, "text", 20)
    texts, seen = ["One two. " * (i % 9) for i in range(1000)], []
    monkeypatch.setattr(chunks, "split_text", lambda t, n: seen.append(t) or split(t, n))
    out = runs[0](iter([pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(texts)], ["doc_id", "text"])]))
    first = next(out)
    assert len(seen) == first.num_rows <= 200
    parts = first.column(2).to_pylist() + [x for b in out for x in b.column(2).to_pylist()]
    assert parts == [split(t, 20) for t in texts]


def test_hits_are_counted_in_turns(spark, monkeypatch):
    """Many short turns and one give the same best chunks."""
    want = sorted(map(tuple, QUERIES["retrieve_topk"](spark, DATA).collect()))
    runs, real = [], type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, run, schema: runs.append(run) or real(self, run, schema))
    monkeypatch.setattr(retrieval, "HITS", 50)
    QUERIES["retrieve_topk"](spark, DATA)
    c = q_retrieval.chunks(spark, DATA).select("chunk_id", F.col("priority").cast("double").alias("priority"), tokens("text").alias("tok")).withColumn("n_tok", F.size("tok"))
    got = []
    for batch in runs[0](iter(c.toArrow().combine_chunks().to_batches())):
        got += zip(*(batch.column(i).to_pylist() for i in range(3)))
    rank = defaultdict(list)
    for query, chunk, score in sorted(got, key=lambda x: (x[0], -x[2], x[1])):
        rank[query].append((query, chunk, len(rank[query]) + 1, score))
    got = sorted(x for xs in rank.values() for x in xs)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(got, want))
