"""Queries of contracts, impact review, scopes, targets and chunk unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contracts as op
from ..operators import tables as tab
from ..session import table
from .corpus_data import GEO_SQL, ROWS_SQL, SPEC_SQL, geo, rows, spec
from .q_figures import FIG_SQL, figs
from .q_tables import NAMED_SQL
from .registry import query


@query("""WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN ' ' WHEN o_orderkey % 11 > 0 THEN o_orderpriority END AS title, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 4 END AS page, CASE o_orderkey % 6 WHEN 0 THEN [1] WHEN 1 THEN [3, 2] WHEN 2 THEN [0, 1] WHEN 3 THEN NULL ELSE [1, 2] END AS rng, CASE o_orderkey % 5 WHEN 0 THEN [0.0, 1, 2, 3] WHEN 1 THEN [5.0, 1, 2, 3] WHEN 2 THEN [1.0, NULL, 2, 3] WHEN 3 THEN [1.0, 2] END AS box FROM orders)
SELECT 'invalid_string_field' AS code, 'title' AS field, CAST(id AS VARCHAR) AS record_id FROM r WHERE title IS NULL OR trim(title) = '' UNION ALL SELECT 'invalid_integer_field', 'page', CAST(id AS VARCHAR) FROM r WHERE page IS NULL OR page < 1 UNION ALL SELECT 'invalid_page_range', 'rng', CAST(id AS VARCHAR) FROM r WHERE NOT coalesce(len(rng) = 2 AND rng[1] >= 1 AND rng[2] >= 1 AND rng[1] <= rng[2], false)
UNION ALL SELECT 'invalid_bbox', 'box', CAST(id AS VARCHAR) FROM r WHERE NOT coalesce(len(box) = 4 AND len(list_filter(box, lambda x: x IS NULL)) = 0 AND box[1] <= box[3] AND box[2] <= box[4], false)""")
def value_contract(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "orders").selectExpr(
        "o_orderkey AS id", "CASE WHEN o_orderkey % 7 = 0 THEN ' ' WHEN o_orderkey % 11 > 0 THEN o_orderpriority END AS title", "CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 4 END AS page",
        "CASE o_orderkey % 6 WHEN 0 THEN array(1) WHEN 1 THEN array(3, 2) WHEN 2 THEN array(0, 1) WHEN 3 THEN NULL ELSE array(1, 2) END AS rng", "CASE o_orderkey % 5 WHEN 0 THEN array(0D, 1D, 2D, 3D) WHEN 1 THEN array(5D, 1D, 2D, 3D) WHEN 2 THEN array(1D, NULL, 2D, 3D) WHEN 3 THEN array(1D, 2D) END AS box",
    )
    return op.value_findings(r, "id", {"title": True}, {"page": True}, ["rng"], ["box"])


UNITS = "SELECT o_custkey AS doc_id, o_orderkey AS unit_id, CASE o_orderkey % 4 WHEN 0 THEN 'command' WHEN 1 THEN 'log_page' WHEN 2 THEN 'requirement' ELSE 'note' END AS unit_type, o_orderkey % 9 = 0 AS review_only, o_orderkey % 13 = 0 AS bare, CASE WHEN o_orderkey % 3 > 0 THEN 'x' ELSE '' END AS opcode, CASE WHEN o_orderkey % 5 > 0 THEN 'y' ELSE '' END AS name FROM orders"


@query(f"""WITH u AS ({UNITS}) SELECT doc_id, CASE WHEN bare THEN 'missing_normalized_fields' ELSE 'missing_normalized_field' END AS code, unit_id FROM u WHERE NOT review_only AND (bare OR (unit_type IN ('command', 'log_page') AND opcode = '' AND name = '') OR (unit_type = 'requirement' AND (opcode = '' OR name = ''))) UNION ALL SELECT doc_id, 'missing_core_domain_unit', NULL FROM u GROUP BY doc_id HAVING NOT bool_or(unit_type IN ('command', 'log_page'))""")
def unit_contract(spark: SparkSession, d: str) -> DataFrame:
    u = spark.sql(UNITS.replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders"))
    u = u.withColumn("fields", F.when(~F.col("bare"), F.create_map(F.lit("opcode"), "opcode", F.lit("name"), "name")))
    return op.unit_contract(u, ["doc_id"], ["command", "log_page"], {"command": ["opcode", "name"], "log_page": ["opcode", "name"]}, {"requirement": ["opcode", "name"]})


@query("""WITH r AS (SELECT * FROM (VALUES ('nvme', 'storage', 'ssd'), ('ocp', 'datacenter', 'ssd'), ('tcg', 'security', 'trust')) v(adapter, agent_domain, compatibility_group)), u AS (SELECT o_orderkey AS unit_id, CASE o_orderkey % 4 WHEN 0 THEN 'nvme' WHEN 1 THEN 'ocp' WHEN 2 THEN 'tcg' ELSE 'manual' END AS adapter, CASE o_custkey % 3 WHEN 0 THEN 'command' WHEN 1 THEN 'requirement' ELSE 'field' END AS unit_type FROM orders)
SELECT unit_id, u.adapter, unit_type, agent_domain, compatibility_group, CASE WHEN u.adapter = 'nvme' AND unit_type = 'command' THEN 'opcode' WHEN u.adapter = 'ocp' AND unit_type = 'requirement' THEN 'id,text' ELSE '' END AS required_fields FROM u LEFT JOIN r ON u.adapter = r.adapter""")
def adapter_registry(spark: SparkSession, d: str) -> DataFrame:
    registry = spark.createDataFrame([("nvme", "storage", "ssd", {"command": ["opcode"]}), ("ocp", "datacenter", "ssd", {"requirement": ["id", "text"]}), ("tcg", "security", "trust", {})], "adapter string, agent_domain string, compatibility_group string, required map<string,array<string>>")
    u = table(spark, d, "orders").selectExpr("o_orderkey AS unit_id", "CASE o_orderkey % 4 WHEN 0 THEN 'nvme' WHEN 1 THEN 'ocp' WHEN 2 THEN 'tcg' ELSE 'manual' END AS adapter", "CASE o_custkey % 3 WHEN 0 THEN 'command' WHEN 1 THEN 'requirement' ELSE 'field' END AS unit_type")
    return op.with_registry(u, registry).select("unit_id", "adapter", "unit_type", "agent_domain", "compatibility_group", F.array_join("required_fields", ",").alias("required_fields"))


@query("""WITH e AS (SELECT o_custkey AS doc_id, o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' ELSE 'changed' END AS status, o_orderkey % 3 AS f, o_orderpriority AS p, o_orderkey % 5 AS a, o_orderkey % 7 AS b FROM orders)
SELECT doc_id, o_orderkey, format('impact-{:04d}', row_number() OVER (PARTITION BY doc_id ORDER BY o_orderkey)) AS review_id, status, CASE WHEN status = 'added' THEN 'create_or_extend_test_coverage' WHEN status = 'removed' THEN 'review_obsolete_tests_and_trace_links' WHEN f = 0 THEN 'review_test_logic_and_expected_results' WHEN f = 1 THEN 'verify_citation_and_traceability_only' ELSE 'review_requirement_metadata' END AS recommendation,
CASE WHEN status <> 'added' THEN p END AS previous_preview, CASE WHEN status <> 'removed' THEN concat('now ', p) END AS current_preview, CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE concat(least(a, b), ',', greatest(a, b)) END AS pages FROM e""")
def impact_review_pack(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(k % 4 == 0, "added").when(k % 4 == 1, "removed").otherwise("changed")
    none = F.array().cast("array<string>")
    e = table(spark, d, "orders").select(
        F.col("o_custkey").alias("doc_id"), k, status.alias("status"), F.when(k % 3 == 0, F.array(F.lit("texts"), F.lit("source_refs"))).when(k % 3 == 1, F.array(F.lit("source_refs"))).otherwise(none).alias("changed_fields"),
        F.when(status == "added", none).otherwise(F.array(F.lit(" "), "o_orderpriority")).alias("previous_texts"), F.when(status == "removed", none).otherwise(F.array(F.concat(F.lit("now "), "o_orderpriority"))).alias("current_texts"), F.array(k % 5, k % 7, k % 5).alias("previous_pages"), F.array(k % 5).alias("current_pages"),
    )
    r = op.impact_review(e, ["doc_id"], "o_orderkey")
    return r.select("doc_id", "o_orderkey", "review_id", "status", "recommendation", "previous_preview", "current_preview", F.array_join(F.transform("previous_pages", lambda x: x.cast("string")), ",").alias("pages"))


@query("""SELECT o_custkey AS doc_id, count(*) FILTER (o_orderkey % 4 = 0) AS added, count(*) FILTER (o_orderkey % 4 > 1) AS changed, count(*) FILTER (o_orderkey % 4 = 1) AS removed FROM orders GROUP BY 1""")
def impact_status_counts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.when(k % 4 == 0, "added").when(k % 4 == 1, "removed").otherwise("changed").alias("status"))
    return op.status_counts(e, ["doc_id"], "status", ("added", "changed", "removed"))


@query("""WITH r AS (SELECT o_orderkey AS run, list_concat(['blocks', 'chunks'], list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'figures' END, CASE WHEN o_orderkey % 3 = 0 THEN 'layout' END], lambda x: x IS NOT NULL)) AS e, list_filter(['blocks', CASE WHEN o_orderkey % 5 > 0 THEN 'chunks' END, CASE WHEN o_orderkey % 4 = 0 THEN 'figures' END, CASE WHEN o_orderkey % 7 = 0 THEN 'extra' END], lambda x: x IS NOT NULL) AS w FROM orders)
SELECT run, array_to_string(list_sort(e), ',') AS expected, array_to_string(list_sort(list_filter(e, lambda x: NOT list_contains(w, x))), ',') AS missing, array_to_string(list_sort(list_filter(w, lambda x: NOT list_contains(e, x))), ',') AS unexpected FROM r""")
def sidecar_scope(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    written = F.filter(F.array(F.lit("blocks"), F.when(k % 5 > 0, "chunks"), F.when(k % 4 == 0, "figures"), F.when(k % 7 == 0, "extra")), lambda x: x.isNotNull())
    r = table(spark, d, "orders").select(k.alias("run"), (k % 2 == 0).alias("has_figures"), (k % 3 == 0).alias("has_layout"), written.alias("written"))
    return op.sidecar_scope(r, ["blocks", "chunks"], {"figures": "has_figures", "layout": "has_layout"}, "written").select("run", "expected", "missing", "unexpected")


@query("""WITH c AS (SELECT o_orderkey, unnest([concat('a/', o_orderkey % 50), concat('b/', o_orderkey % 70), concat('c/', o_custkey % 90)]) AS path, unnest([0, 1, 2]) AS rank FROM orders), f AS (SELECT concat(CASE c_custkey % 3 WHEN 0 THEN 'a/' WHEN 1 THEN 'b/' ELSE 'c/' END, c_custkey % 90) AS path FROM customer) SELECT o_orderkey, arg_min(path, rank) AS path, min(rank) AS rank FROM c WHERE path IN (SELECT path FROM f) GROUP BY 1""")
def first_existing_path(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    c = table(spark, d, "orders").select("o_orderkey", F.posexplode(F.array(F.concat(F.lit("a/"), k % 50), F.concat(F.lit("b/"), k % 70), F.concat(F.lit("c/"), F.col("o_custkey") % 90))).alias("rank", "path"))
    files = table(spark, d, "customer").select(F.concat(F.expr("CASE c_custkey % 3 WHEN 0 THEN 'a/' WHEN 1 THEN 'b/' ELSE 'c/' END"), F.col("c_custkey") % 90).alias("path"))
    return op.first_existing(c, files, ["o_orderkey"])


@query(f"""WITH {GEO_SQL}, u AS (SELECT doc_id, page, 0 AS k, 'text_block' AS region_type, concat('b', line_no) AS source_id, line_no AS order_index, 'paragraph' AS role FROM geo WHERE line_no % 3 = 0 UNION ALL SELECT doc_id, page, 1, 'table', CASE WHEN line_no % 7 > 1 THEN concat('t', line_no) END, line_no, 'table' FROM geo WHERE line_no % 3 = 1 UNION ALL SELECT doc_id, page, 2, 'figure', concat('f', line_no), 100 - line_no, 'image' FROM geo WHERE line_no % 3 = 2)
SELECT doc_id, page, region_type, source_id, CAST(order_index AS INT) AS order_index, role, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY k, order_index, source_id) AS INT) AS region_no FROM u WHERE source_id IS NOT NULL""")
def region_refs(spark: SparkSession, d: str) -> DataFrame:
    g, n = geo(spark, d), F.col("line_no")
    side = lambda r, i, o, role: g.filter(n % 3 == r).select("doc_id", "page", i.alias("source_id"), o.cast("int").alias("order_index"), F.lit(role).alias("role"))
    return op.region_refs(side(0, F.concat(F.lit("b"), n), n, "paragraph"), side(1, F.when(n % 7 > 1, F.concat(F.lit("t"), n)), n, "table"), side(2, F.concat(F.lit("f"), n), 100 - n, "image"), ["doc_id", "page"])


_CELL = " ".join(f"WHEN k IN ({', '.join(repr(x) for x in xs)}) THEN '{n}'" for n, xs in op.CELL_TARGETS.items())


@query(f"""WITH {ROWS_SQL}, b AS (SELECT p_partkey % 4 AS doc_id, concat('b-', p_partkey) AS block_id, p_partkey AS ord, CASE p_partkey % 3 WHEN 0 THEN 'heading' WHEN 1 THEN 'caption' ELSE 'body' END AS block_type, CASE p_partkey % 7 WHEN 0 THEN concat(p_size % 6, '.', p_size % 4, ' ', p_name) WHEN 1 THEN concat('Appendix ', p_size % 5, ' x') WHEN 2 THEN concat('see Table ', p_size % 8, '-', p_size % 3) WHEN 3 THEN concat('Figure A', p_size % 5, ': y') ELSE p_name END AS text FROM part),
t AS (SELECT row_id % 4 AS doc_id, table_id, concat('Table ', row_id % 9, ' of parts') AS caption, row_id AS ord FROM tab WHERE row_id % 5 = 0), c AS (SELECT row_id % 4 AS doc_id, row_id, regexp_replace(lower(headers[i]), '[^a-z0-9]+', '', 'g') AS k, trim(vals[i]) AS label FROM (SELECT *, unnest(range(1, len(headers) + 1)) AS i FROM tab)),
u AS (SELECT doc_id, 0 AS stage, ord, 'section' AS target_type, regexp_extract(text, '^(\\d+(?:\\.\\d+)*)\\b', 1) AS label, block_id AS target FROM b WHERE block_type = 'heading' UNION ALL SELECT doc_id, 0, ord, 'appendix', regexp_extract(text, '(?i)^Appendix\\s+([A-Za-z0-9]+)\\b', 1), block_id FROM b WHERE block_type = 'heading'
UNION ALL SELECT doc_id, 0, ord, 'table', regexp_extract(text, '(?i)\\bTable\\s+([A-Za-z0-9]+(?:[.\\-][A-Za-z0-9]+)*)', 1), block_id FROM b WHERE block_type = 'caption' UNION ALL SELECT doc_id, 0, ord, 'figure', regexp_extract(text, '(?i)\\bFigure\\s+([A-Za-z0-9]+(?:[.\\-][A-Za-z0-9]+)*)', 1), block_id FROM b WHERE block_type = 'caption'
UNION ALL SELECT doc_id, 1, ord, 'table', regexp_extract(caption, '(?i)\\bTable\\s+([A-Za-z0-9]+(?:[.\\-][A-Za-z0-9]+)*)', 1), table_id FROM t UNION ALL SELECT doc_id, 2, row_id, CASE {_CELL} END, label, CAST(row_id AS VARCHAR) FROM c)
SELECT doc_id, target_type, label, target FROM u WHERE label <> '' AND target_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, target_type, label ORDER BY stage DESC, ord DESC, target DESC) = 1""")
def reference_targets(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "part").selectExpr(
        "p_partkey % 4 AS doc_id", "concat('b-', p_partkey) AS block_id", "p_partkey AS ord", "CASE p_partkey % 3 WHEN 0 THEN 'heading' WHEN 1 THEN 'caption' ELSE 'body' END AS block_type",
        "CASE p_partkey % 7 WHEN 0 THEN concat(p_size % 6, '.', p_size % 4, ' ', p_name) WHEN 1 THEN concat('Appendix ', p_size % 5, ' x') WHEN 2 THEN concat('see Table ', p_size % 8, '-', p_size % 3) WHEN 3 THEN concat('Figure A', p_size % 5, ': y') ELSE p_name END AS text",
    )
    r = rows(spark, d).withColumns({"doc_id": F.col("row_id") % 4, "ord": F.col("row_id")})
    t = r.filter("row_id % 5 = 0").select("doc_id", "table_id", F.concat(F.lit("Table "), F.col("row_id") % 9, F.lit(" of parts")).alias("caption"), "ord")
    return op.reference_targets(b, t, r, ["doc_id"])


TEMPLATES = {"command_opcode": "What is the opcode of {}?", "log_page": "Which log page is {}?", "status_code": "What does status {} mean?"}


@query(f"""WITH {NAMED_SQL}, s AS (SELECT page, unit_type AS bucket, coalesce(command, log_id, sc) AS name, row_id FROM typed WHERE unit_type IN ('command_opcode', 'log_page', 'status_code') AND trim(coalesce(command, log_id, sc)) <> '')
SELECT page, bucket, min(row_id) AS expected_id, count(*) AS bucket_size, CASE bucket WHEN 'command_opcode' THEN concat('What is the opcode of ', arg_min(name, row_id), '?') WHEN 'log_page' THEN concat('Which log page is ', arg_min(name, row_id), '?') ELSE concat('What does status ', arg_min(name, row_id), ' mean?') END AS query FROM s GROUP BY page, bucket""")
def evaluation_queries(spark: SparkSession, d: str) -> DataFrame:
    t = tab.typed_rows(rows(spark, d)).withColumn("name", F.coalesce("command", "log_id", "sc"))
    return op.bucketed_queries(t, ["page"], "unit_type", "name", "row_id", TEMPLATES)


@query(f"""WITH {NAMED_SQL.replace('tab AS', SPEC_SQL + ', ' + FIG_SQL + ', tab AS', 1)}, u AS (SELECT page % 8 AS doc_id, 0 AS source_rank, 'text_block' AS chunk_type, unit AS ord, text, 50 AS priority FROM spec UNION ALL SELECT page % 8, 1, 'requirement', unit, text, 90 FROM spec WHERE contains(text, 'shall') UNION ALL SELECT page % 8, 2, 'cross_ref', unit, concat('Reference: ', text), 40 FROM spec WHERE contains(text, 'see ')
UNION ALL SELECT page % 8, 3, 'table_row', row_id, row_text, 60 FROM typed UNION ALL SELECT page % 8, 4, 'technical_row', row_id, concat(unit_type, ': ', row_text), 94 FROM typed WHERE unit_type IS NOT NULL UNION ALL SELECT page % 8, 5, 'table', min(row_id), concat('Table ', table_id), 55 FROM typed GROUP BY page, table_id
UNION ALL SELECT page % 8, 6, 'figure_text', figure_id, caption_text, 68 FROM fig UNION ALL SELECT page % 8, 7, 'figure_labels', figure_id, array_to_string(detected_labels, ' | '), 44 FROM fig UNION ALL SELECT page % 8, 8, 'figure_ocr', figure_id, array_to_string(ocr_texts, ' '), 42 FROM fig UNION ALL SELECT page % 8, 9, 'figure_context', figure_id, array_to_string(list_concat(heading_path, nearby_texts), ' '), 41 FROM fig),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY source_rank, ord, text) AS i FROM u WHERE trim(text) <> '') SELECT doc_id, source_rank, chunk_type, ord, text, priority, CAST(i AS INT) AS chunk_index, format('chunk-{{:06d}}', i) AS chunk_id, CAST(length(text) AS INT) AS char_count, CAST((length(text) + 3) // 4 AS INT) AS token_estimate, sha256(text) AS text_sha256 FROM n""")
def chunk_sources(spark: SparkSession, d: str) -> DataFrame:
    s, f, t = spec(spark, d), figs(spark, d), tab.typed_rows(rows(spark, d))
    part = lambda df, o, text, p: df.select((F.col("page") % 8).alias("doc_id"), F.col(o).alias("ord"), text.alias("text"), F.lit(p).alias("priority"))
    tables = t.groupBy("page", "table_id").agg(F.min("row_id").alias("row_id"))
    sources = [
        ("text_block", part(s, "unit", F.col("text"), 50)), ("requirement", part(s.filter(F.col("text").contains("shall")), "unit", F.col("text"), 90)), ("cross_ref", part(s.filter(F.col("text").contains("see ")), "unit", F.concat(F.lit("Reference: "), "text"), 40)),
        ("table_row", part(t, "row_id", F.col("row_text"), 60)), ("technical_row", part(t.filter("unit_type is not null"), "row_id", F.concat("unit_type", F.lit(": "), "row_text"), 94)), ("table", part(tables, "row_id", F.concat(F.lit("Table "), "table_id"), 55)),
        ("figure_text", part(f, "figure_id", F.col("caption_text"), 68)), ("figure_labels", part(f, "figure_id", F.array_join("detected_labels", " | "), 44)), ("figure_ocr", part(f, "figure_id", F.array_join("ocr_texts", " "), 42)), ("figure_context", part(f, "figure_id", F.array_join(F.concat("heading_path", "nearby_texts"), " "), 41)),
    ]
    return op.chunk_union(sources, ["doc_id"])


JSON = """CASE o_orderkey % 6 WHEN 0 THEN ' ' WHEN 1 THEN concat('{"id": ', o_orderkey, ', "name": "', o_orderpriority) WHEN 2 THEN 'not json' ELSE concat('{"id": ', o_orderkey, ', "name": "', o_orderpriority, '"}') END"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr("o_custkey AS file", "o_orderkey AS line_no", f"{JSON} AS line")


@query("""SELECT o_custkey AS file, o_orderkey AS line_no, o_orderkey AS id, o_orderpriority AS name FROM orders WHERE o_orderkey % 6 > 2""")
def json_records(spark: SparkSession, d: str) -> DataFrame:
    return op.parsed_lines(_lines(spark, d), "id bigint, name string", ["file"])[0]


@query(f"""SELECT o_custkey AS file, o_orderkey AS line_no, 'invalid_json_line' AS code, {JSON} AS line FROM orders WHERE o_orderkey % 6 IN (1, 2)""")
def json_findings(spark: SparkSession, d: str) -> DataFrame:
    return op.parsed_lines(_lines(spark, d), "id bigint, name string", ["file"])[1]
