"""Queries of batches, reports, semantic units, the row pipeline and scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import batch as op
from ..session import table
from .corpus_data import SPEC_SQL, spec
from .q_headers import grids
from .q_quality import FIND_SQL, findings
from .registry import query

_RESULT = "CASE WHEN o_orderkey % 6 = 0 THEN 'skipped' WHEN o_orderkey % 17 = 0 THEN 'cancelled' WHEN c_custkey IS NULL THEN 'failed' WHEN o_orderkey % 4 = 0 THEN 'partial_success' ELSE 'success' END"
DOCS_SQL = f"res AS (SELECT o_custkey % 20 AS batch, o_orderkey, {_RESULT} AS result, CASE WHEN {_RESULT} IN ('success', 'partial_success') THEN o_orderkey % 30 ELSE 0 END AS pages, CASE WHEN c_custkey IS NULL THEN 0 ELSE o_orderkey % 3 END AS warnings FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 5 > 0) ON c_custkey = o_custkey)"


def results(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("batch"), k, "o_custkey", (k % 6 == 0).alias("unchanged"))
    good = table(spark, d, "customer").filter("c_custkey % 5 > 0").select(F.col("c_custkey").alias("o_custkey"))
    out = table(spark, d, "orders").join(good, "o_custkey", "left_semi").select(k, F.when(k % 4 == 0, "partial_success").otherwise("success").alias("status"), (k % 30).alias("pages"), (k % 3).alias("warnings"))
    return op.document_results(o, out, ["o_orderkey"], "unchanged", k % 17 == 0)


@query(f"WITH {DOCS_SQL} SELECT batch, o_orderkey, result, pages, warnings FROM res")
def document_results(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).select("batch", "o_orderkey", "result", "pages", "warnings")


@query(f"""WITH {DOCS_SQL} SELECT batch, count(*) AS documents, {', '.join(f"count(*) FILTER (result = '{s}') AS {s}" for s in ('success', 'partial_success', 'skipped', 'failed', 'cancelled'))}, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(warnings) AS BIGINT) AS warnings,
CASE WHEN count(*) FILTER (result = 'failed') > 0 THEN 2 WHEN count(*) FILTER (result IN ('partial_success', 'cancelled')) > 0 THEN 1 ELSE 0 END AS exit_code FROM res GROUP BY 1""")
def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    return op.batch_summary(results(spark, d), ["batch"])


@query("""WITH a AS (SELECT o_custkey AS doc_id, count(*) AS pages, CAST(sum(o_orderkey % 4) AS BIGINT) AS warnings FROM orders GROUP BY 1), b AS (SELECT c_custkey AS doc_id, c_nationkey AS tables FROM customer), c AS (SELECT user_id AS doc_id, count(*) AS chunks FROM events GROUP BY 1) SELECT doc_id, coalesce(pages, 0) AS pages, coalesce(warnings, 0) AS warnings, coalesce(tables, 0) AS tables, coalesce(chunks, 0) AS chunks FROM a FULL JOIN b USING (doc_id) FULL JOIN c USING (doc_id)""")
def document_report(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.count("*").alias("pages"), F.sum(F.col("o_orderkey") % 4).alias("warnings"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_nationkey").alias("tables"))
    c = table(spark, d, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.count("*").alias("chunks"))
    return op.report({"pages": a, "tables": b, "chunks": c}, ["doc_id"])


@query("""WITH t AS (SELECT o_custkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN 'HTML' WHEN 1 THEN 'gfm' ELSE 'image' END AS m, o_orderkey % 3 > 0 AS tried, CASE WHEN o_orderkey % 5 > 0 THEN 'x' ELSE ' ' END AS text, o_orderkey % 10 / 10 AS c FROM orders)
SELECT doc_id, count(*) FILTER (m <> 'gfm') AS eligible, count(*) FILTER (m <> 'gfm' AND tried) AS attempted, count(*) FILTER (m <> 'gfm' AND tried AND trim(text) <> '') AS with_text, count(*) FILTER (m <> 'gfm' AND tried AND c < 0.65) AS low_confidence FROM t GROUP BY 1""")
def region_ocr_counters(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    t = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'HTML' WHEN 1 THEN 'gfm' ELSE 'image' END").alias("source_mode"), (k % 3 > 0).alias("attempted"), F.when(k % 5 > 0, "x").otherwise(" ").alias("text"), (k % 10 / 10).alias("confidence"))
    return op.ocr_counters(t, ["doc_id"])


BLK = """SELECT page, unit AS ord, concat('b-', unit) AS block_id, CASE unit % 5 WHEN 0 THEN 'heading' WHEN 1 THEN 'list' ELSE 'body' END AS block_type, CASE unit % 5 WHEN 1 THEN concat('1. ', text, EOL, 'and', EOL, '- close it') WHEN 4 THEN ' ' ELSE text END AS text FROM spec"""
BLK_SQL = f"{SPEC_SQL}, blk AS ({BLK.replace('EOL', 'chr(10)')})"


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(BLK.replace("EOL", "'\\n'").replace("FROM spec", "FROM {spec}"), spec=spec(spark, d))


_LEAD = "lower(regexp_extract(trim(text), '(?i)^(warning|caution|note)\\b\\s*:?', 1))"


@query(f"""WITH {BLK_SQL}, k AS (SELECT page, ord, trim(text) AS text, CASE WHEN block_type = 'heading' THEN 'section' WHEN {_LEAD} IN ('warning', 'caution') THEN 'warning' WHEN {_LEAD} = 'note' THEN 'note' WHEN block_type = 'list' THEN 'procedure_step' ELSE 'paragraph' END AS unit_type FROM blk WHERE trim(text) <> ''),
e AS (SELECT page, ord, 0 AS i, unit_type, text AS unit_text FROM k WHERE unit_type <> 'procedure_step' UNION ALL SELECT page, ord, i, unit_type, trim(regexp_replace(string_split(text, chr(10))[i], '^\\s*([-*+]|\\d+[.)])\\s+', '')) FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM k WHERE unit_type = 'procedure_step') WHERE regexp_matches(string_split(text, chr(10))[i], '^\\s*([-*+]|\\d+[.)])\\s+'))
SELECT page, ord, unit_type, unit_text, CAST(row_number() OVER (PARTITION BY page ORDER BY ord, i) AS INT) AS unit_no FROM e""")
def semantic_units(spark: SparkSession, d: str) -> DataFrame:
    return op.semantic_units(blocks(spark, d), ["page"])


@query(f"WITH {BLK_SQL} SELECT ord, page, last_value(CASE WHEN block_type = 'heading' THEN block_id END IGNORE NULLS) OVER (PARTITION BY page ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section_id FROM blk")
def section_ids(spark: SparkSession, d: str) -> DataFrame:
    return op.section_ids(blocks(spark, d), ["page"], "ord").select("ord", "page", "section_id")


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN concat('1 Overview > ', 'Appendix ', p_brand) WHEN 1 THEN 'Vendor rules' WHEN 2 THEN NULL ELSE 'CLAUSE 4' END AS heading_context FROM part""")
def table_heading_context(spark: SparkSession, d: str) -> DataFrame:
    path = F.when(F.col("p_size") % 4 == 0, F.array(F.lit("1 Overview"), F.concat(F.lit("Appendix "), "p_brand"))).when(F.col("p_size") % 4 == 1, F.array(F.lit("Vendor rules"))).when(F.col("p_size") % 4 == 2, F.array(F.lit("Summary"))).otherwise(F.array(F.lit("CLAUSE 4")))
    t = table(spark, d, "part").withColumn("path", path)
    return t.select("p_partkey", op.heading_context(t, "path").alias("heading_context"))


@query()
def table_row_pipeline(spark: SparkSession, d: str) -> DataFrame:
    p = op.processed_rows(grids(spark, d), "grid")
    return p.select("grid_id", F.array_join("headers", ",").alias("headers"), F.array_join(F.transform("body", lambda r: F.array_join(r, "/")), ";").alias("body"), "promoted", "moves", "multi", F.size("notes").alias("n_notes"))


@query(f"""WITH {FIND_SQL} SELECT code, severity, field, record_id, CAST(row_number() OVER (PARTITION BY severity ORDER BY code, field, record_id) AS INT) AS place FROM f""")
def ordered_findings(spark: SparkSession, d: str) -> DataFrame:
    return op.ordered_findings(findings(spark, d).select("severity", "code", "field", "record_id"), ["severity"])


LEAF = """concat('{"id": ', o_orderkey, ', "who": {"mail": "u', o_custkey, '@x.org", "tags": [{"note": "', o_orderpriority, '"}, {"path": "/home/u', o_custkey % 9, '/a"}]}, "n": {"deep": {"mail": "', CASE WHEN o_orderkey % 3 = 0 THEN 'v@y.org' ELSE 'none' END, '"}}}')"""


@query("""SELECT o_orderkey, 'mail' AS field, concat('u', o_custkey, '@x.org') AS value FROM orders UNION ALL SELECT o_orderkey, 'path', concat('/home/u', o_custkey % 9, '/a') FROM orders UNION ALL SELECT o_orderkey, 'mail', 'v@y.org' FROM orders WHERE o_orderkey % 3 = 0""")
def confidential_leaves(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "orders").select("o_orderkey", F.expr(LEAF).alias("json"))
    return op.json_leaves(r, "o_orderkey", "json", r"@[a-z]+[.]|^/home/")
