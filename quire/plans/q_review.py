"""Queries of warnings, table review, guarded references and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import review as op
from ..session import parts, table
from .corpus_data import ROWS_SQL, SPEC_SQL, rows, spec
from .registry import query

# Warnings: one a line item of an order (its document), pages by line number.
WARN = """SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS page, l_partkey * 100 + l_suppkey AS seq, CASE l_suppkey % 5 WHEN 0 THEN 'OCR_EMPTY_RESULT' WHEN 1 THEN 'OCR_FAILED' WHEN 2 THEN 'TABLE_COMPLEXITY' WHEN 3 THEN 'IMAGE_SKIPPED' ELSE 'PAGE_RANGE' END AS code,
 CASE l_suppkey % 5 WHEN 3 THEN 'advisory' ELSE 'warning' END AS severity, CASE l_suppkey % 5 WHEN 2 THEN 'table' WHEN 3 THEN 'image' WHEN 4 THEN 'page' ELSE 'ocr' END AS domain, l_suppkey % 5 <> 3 AS exits, l_partkey % 4 = 0 AS forced,
 CASE l_partkey % 3 WHEN 0 THEN 'low_text_density' WHEN 1 THEN 'empty_text_layer' ELSE 'other' END AS reason, CASE WHEN l_partkey % 2 = 0 THEN CAST(l_partkey % 5 AS INT) END AS chars, CAST(NULL AS INT) AS images FROM lineitem"""
WARN_SQL = f"warn AS ({WARN}), pg AS (SELECT o_orderkey AS doc_id, CAST(o_custkey % 4 AS INT) AS page_chars, CAST(o_custkey % 3 AS INT) AS page_images FROM orders), ctx AS (SELECT w.* REPLACE (CASE WHEN code = 'OCR_EMPTY_RESULT' THEN coalesce(chars, page_chars) ELSE chars END AS chars, CASE WHEN code = 'OCR_EMPTY_RESULT' THEN coalesce(images, page_images) ELSE images END AS images) FROM warn w LEFT JOIN pg USING (doc_id))"
_ADVICE = "(severity = 'advisory' OR (code = 'OCR_EMPTY_RESULT' AND NOT coalesce(forced, false) AND coalesce(CASE WHEN reason = 'low_text_density' THEN chars < 3 WHEN reason = 'empty_text_layer' THEN chars = 0 AND images = 0 END, false)))"


def warnings(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(WARN.replace("FROM lineitem", "FROM {li}"), li=table(spark, d, "lineitem"))


@query(f"""WITH {WARN_SQL} SELECT doc_id, code, count(*) AS warnings, count(*) FILTER ({_ADVICE}) AS advisory, count(*) FILTER (NOT {_ADVICE} AND (code LIKE '%\\_FAILED' ESCAPE '\\' OR (exits AND domain IN ('ocr', 'table', 'image')))) AS exit_relevant FROM ctx GROUP BY ALL""")
def warning_policy(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 4).cast("int").alias("page_chars"), (F.col("o_custkey") % 3).cast("int").alias("page_images"))
    n = parts(table(spark, d, "lineitem"))
    w = op.with_page_context(warnings(spark, d).repartition(n, "doc_id"), pages.repartition(n, "doc_id"), ["doc_id"])
    return w.groupBy("doc_id", "code").agg(F.count("*").alias("warnings"), F.count(F.when(op.advisory(), 1)).alias("advisory"), F.count(F.when(op.affects_exit(), 1)).alias("exit_relevant"))


@query(f"""WITH {WARN_SQL}, sel AS (SELECT DISTINCT doc_id, page, 10 - page AS ordinal FROM warn WHERE page % 3 <> 0), r AS (SELECT warn.doc_id, warn.page, seq, row_number() OVER (PARTITION BY warn.doc_id ORDER BY coalesce(ordinal, 1000000), seq) AS place FROM warn LEFT JOIN sel ON warn.doc_id = sel.doc_id AND warn.page = sel.page) SELECT doc_id, seq, min(CAST(place AS INT)) AS place, count(*) AS n FROM r GROUP BY doc_id, seq""")
def warning_order(spark: SparkSession, d: str) -> DataFrame:
    n = parts(table(spark, d, "lineitem"))
    w = warnings(spark, d).repartition(n, "doc_id", "page")
    selection = w.filter("page % 3 <> 0").select("doc_id", "page", (10 - F.col("page")).alias("ordinal")).distinct()
    return op.by_selected_page(w, selection, ["doc_id"], "seq", n).groupBy("doc_id", "seq").agg(F.min("place").alias("place"), F.count("*").alias("n"))


@query("""WITH a AS (SELECT p_size AS doc_id, CASE p_partkey % 5 WHEN 0 THEN 'recovered_exact' WHEN 1 THEN 'suppressed_ambiguous' WHEN 2 THEN 'suppressed_no_candidate' WHEN 3 THEN 'other' END AS reason FROM part), n AS (SELECT unnest(['recovered_exact', 'recovered_context_validated', 'suppressed_no_candidate', 'suppressed_ambiguous']) AS name)
SELECT d.doc_id, n.name, count(a.reason) AS count FROM (SELECT DISTINCT doc_id FROM a) d JOIN n ON true LEFT JOIN a ON a.doc_id = d.doc_id AND a.reason = n.name GROUP BY d.doc_id, n.name""")
def marker_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "part").select(F.col("p_size").alias("doc_id"), F.expr("CASE p_partkey % 5 WHEN 0 THEN 'recovered_exact' WHEN 1 THEN 'suppressed_ambiguous' WHEN 2 THEN 'suppressed_no_candidate' WHEN 3 THEN 'other' END").alias("reason"))
    return op.zero_filled(a, ["doc_id"], "reason", op.MARKER_REASONS)


# Tables under review: an order each; rows its lines; technical units by quantity; domain units by customer.
PACK_SQL = """q AS (SELECT o_orderkey AS table_id, CAST(o_custkey % 10 AS DOUBLE) / 10 AS quality_score, o_orderkey % 9 = 0 AS actionable, o_orderkey % 11 = 0 AS missing_refs, CASE o_orderkey % 4 WHEN 0 THEN ['LOW_HEADER_CONFIDENCE'] WHEN 1 THEN ['ROW_SPLIT_SUSPECTED', 'HEADER_FRAGMENTED'] ELSE []::VARCHAR[] END AS reasons, CASE WHEN o_orderkey % 3 = 0 THEN 'HTML' ELSE 'gfm' END AS mode, o_orderkey % 2 = 0 AS unresolved, CAST(o_orderkey % 5 AS DOUBLE) / 5 AS placeholder_ratio FROM orders),
low AS (SELECT * FROM q WHERE quality_score < 0.55), r AS (SELECT l_orderkey AS table_id, count(*) AS row_count, arg_min(concat('Row ', l_partkey, ' of ', l_suppkey), CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey) AS sample FROM lineitem WHERE l_quantity < 30 GROUP BY 1), t AS (SELECT l_orderkey AS table_id, count(*) AS technical_units FROM lineitem WHERE l_quantity > 40 GROUP BY 1),
u AS (SELECT table_id, count(*) AS domain_units FROM (SELECT l_partkey, l_suppkey, l_linenumber, unnest(list_distinct([l_orderkey, l_orderkey + l_linenumber])) AS table_id FROM lineitem WHERE l_tax > 0.06) GROUP BY 1), f AS (SELECT DISTINCT l_orderkey AS table_id FROM lineitem WHERE l_discount > 0.08),
j AS (SELECT low.*, coalesce(row_count, 0) AS row_count, coalesce(technical_units, 0) AS technical_units, coalesce(domain_units, 0) AS domain_units, sample, f.table_id IS NOT NULL AS fb FROM low LEFT JOIN r USING (table_id) LEFT JOIN t USING (table_id) LEFT JOIN u USING (table_id) LEFT JOIN f ON low.table_id = f.table_id)"""
_ACT = "(actionable OR missing_refs OR list_has_any(reasons, [" + ", ".join(f"'{x}'" for x in op.ACTIONABLE) + "]) OR (lower(mode) <> 'html' AND NOT fb AND unresolved))"
_WHY = "array_to_string(list_sort(list_filter([CASE WHEN row_count = 0 THEN 'no_rag_rows' WHEN row_count >= 2 THEN 'rag_rows_available' END, CASE WHEN placeholder_ratio >= 0.5 THEN 'placeholder_headers' END, CASE WHEN technical_units > 0 THEN 'technical_units_present' END, CASE WHEN domain_units > 0 THEN 'domain_units_present' END, " + ", ".join(f"CASE WHEN list_contains(reasons, '{x}') THEN '{x.lower()}' END" for x in op.HEADER_REASONS) + "], lambda x: x IS NOT NULL)), ',')"


@query(f"""WITH {PACK_SQL} SELECT table_id, quality_score, row_count, technical_units, domain_units, sha256(sample) AS sample_sha256, sample AS sample_preview, CASE WHEN {_ACT} THEN 'actionable' ELSE 'advisory' END AS status, {_WHY} AS triage_reasons FROM j""")
def table_review_pack(spark: SparkSession, d: str) -> DataFrame:
    return _pack(spark, d).withColumn("triage_reasons", F.array_join("triage_reasons", ","))


def _pack(spark: SparkSession, d: str) -> DataFrame:
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem").withColumn("table_id", F.col("l_orderkey"))
    k = F.col("o_orderkey")
    q = o.select(
        k.alias("table_id"), ((F.col("o_custkey") % 10).cast("double") / 10).alias("quality_score"), (k % 9 == 0).alias("actionable"), (k % 11 == 0).alias("missing_refs"),
        F.expr("CASE o_orderkey % 4 WHEN 0 THEN array('LOW_HEADER_CONFIDENCE') WHEN 1 THEN array('ROW_SPLIT_SUSPECTED', 'HEADER_FRAGMENTED') ELSE cast(array() as array<string>) END").alias("reasons"),
        F.when(k % 3 == 0, "HTML").otherwise("gfm").alias("mode"), (k % 2 == 0).alias("unresolved"), ((k % 5).cast("double") / 5).alias("placeholder_ratio"),
    )
    r = li.filter("l_quantity < 30").select("table_id", F.concat(F.lit("Row "), "l_partkey", F.lit(" of "), "l_suppkey").alias("row_text"), (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("row_index"))
    u = li.filter("l_tax > 0.06").select(F.lit(1).alias("unit_id"), F.array("l_orderkey", F.col("l_orderkey") + F.col("l_linenumber")).alias("table_ids"))
    return op.review_pack(q, r, li.filter("l_quantity > 40"), u, li.filter("l_discount > 0.08"), ["table_id"])


@query(f"""WITH {PACK_SQL} SELECT CAST(table_id // 100 AS BIGINT) AS page, count(*) AS low_tables, count(*) FILTER ({_ACT}) AS actionable FROM j GROUP BY 1""")
def low_quality_pages(spark: SparkSession, d: str) -> DataFrame:
    return _pack(spark, d).groupBy(F.expr("table_id div 100").alias("page")).agg(F.count("*").alias("low_tables"), F.count(F.when(F.col("status") == "actionable", 1)).alias("actionable"))


REFS = "SELECT unit, text, CASE unit % 5 WHEN 0 THEN 'section' WHEN 1 THEN 'table' WHEN 2 THEN 'figure' WHEN 3 THEN 'appendix' ELSE 'clause' END AS kind, CASE unit % 7 WHEN 0 THEN 'Following' WHEN 1 THEN 'AB-C1' WHEN 2 THEN '4.2,' WHEN 3 THEN 'interface' WHEN 4 THEN 'ABC' ELSE '' END AS label, CAST(unit % 50 AS INT) AS s, CAST(unit % 50 + 5 AS INT) AS e, unit % 4 = 0 AS resolved FROM (SELECT unit, concat(CASE WHEN unit % 3 = 0 THEN 'see RFC 12 and ' WHEN unit % 3 = 1 THEN 'as in ISO 90 ' ELSE '' END, text) AS text FROM spec)"


@query(f"""WITH {SPEC_SQL}, refs AS ({REFS}), c AS (SELECT *, text[greatest(s - 39, 1):s] AS pre, text[e + 1:e + 40] AS post, text[greatest(s - 39, 1):e + 40] AS win, trim(label, ' .,;:') AS bare FROM refs)
SELECT unit, (kind IN ('appendix', 'section') AND (regexp_matches(pre, '(?i)\\b(?:RFC|ISO|IEC|PCI(?:e)?|MSI-X)\\s+\\d*') OR regexp_matches(post, '(?i)\\b(?:of|in)\\s+(?:RFC|ISO|IEC)\\s+\\d+'))) OR (kind = 'table' AND NOT regexp_matches(label, '[0-9]') AND regexp_matches(win, '(?i)\\b(?:RFC|ISO|IEC|PCI(?:e)?|MSI-X)\\s+\\d*')) AS external,
NOT resolved AND (lower(bare) IN ('above', 'below', 'defines', 'describes', 'following', 'in', 'of', 'specifies') OR (kind IN ('table', 'figure') AND NOT regexp_matches(bare, '[0-9]')) OR (kind IN ('section', 'clause', 'table', 'figure') AND NOT (regexp_matches(bare, '[0-9]') OR regexp_matches(bare, '^[A-Z]{{1,4}}([.-][A-Z0-9]{{1,8}})*$')))) AS skipped FROM c""")
def reference_guards(spark: SparkSession, d: str) -> DataFrame:
    refs = spark.sql(REFS.replace("FROM spec", "FROM {spec}"), spec=spec(spark, d))
    return refs.select("unit", op.is_external("text", "s", "e", "kind", "label").alias("external"), op.skips_unresolved("kind", "label", "resolved").alias("skipped"))


_LOW = "list_transform(headers, lambda h: lower(trim(h)))"


@query(f"""WITH {ROWS_SQL}, p AS (SELECT row_id, {_LOW} AS low, vals FROM tab) SELECT row_id, CASE WHEN list_has_any(low, [{', '.join(f"'{h}'" for h in op.PARAMETER_HEADERS)}]) THEN coalesce({', '.join(f"CASE WHEN list_position(low, '{k}') > 0 THEN nullif(trim(vals[list_position(low, '{k}')]), '') END" for k in op.PARAMETER_KEYS)}, list_filter(list_transform(vals, lambda x: trim(x)), lambda x: x <> '')[1]) END AS parameter FROM p""")
def parameter_keys(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d).select("row_id", op.parameter_key("headers", "vals").alias("parameter"))


KEYWORDS = "'Command; opcode,Description\n Feature Identifier,, command ;Register,offset'"


@query(f"""WITH {ROWS_SQL}, k AS (SELECT ['command', 'opcode', 'description', 'featureidentifier', 'register', 'offset'] AS words) SELECT row_id, array_to_string(words, ',') AS keywords, len(list_intersect(list_distinct(list_transform(headers, lambda h: regexp_replace(lower(h), '[^a-z0-9]+', '', 'g'))), words)) >= 2 AS known FROM tab, k""")
def manual_adapter_rows(spark: SparkSession, d: str) -> DataFrame:
    r = rows(spark, d).withColumn("words", op.split_keywords(F.expr(KEYWORDS)))
    return r.select("row_id", F.array_join("words", ",").alias("keywords"), op.knows_row("headers", F.col("words")).alias("known"))


RUN = "SELECT o_custkey % 8 AS run, CASE WHEN o_orderkey % 10 < 6 THEN 'success' WHEN o_orderkey % 10 < 8 THEN 'partial_success' WHEN o_orderkey % 10 = 8 THEN 'failed' ELSE 'cancelled' END AS status, o_orderkey % 5 AS tables, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS low_tables, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice / 1000 END AS pages_per_second, o_orderkey % 2 AS side FROM orders"
RUN_SQL = f"runs AS ({RUN}), summ AS (SELECT run, side, count(*) AS documents, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'partial_success') AS partial, count(*) FILTER (status NOT IN ('success', 'partial_success')) AS failed, CAST(sum(tables) AS BIGINT) AS tables, CAST(sum(low_tables) AS BIGINT) AS low_tables, min(pages_per_second) AS speed_min, round(avg(pages_per_second), 4) AS speed_mean FROM runs GROUP BY run, side), rated AS (SELECT *, round(partial / documents, 6) AS partial_rate, round(CASE WHEN tables > 0 THEN low_tables / tables ELSE 0 END, 6) AS low_table_rate FROM summ)"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return op.corpus_summary(spark.sql(RUN.replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders")), ["run", "side"])


@query(f"WITH {RUN_SQL} SELECT * FROM rated")
def corpus_evaluation(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d)


_METRICS = ("partial", "failed", "low_tables", "success", "speed_mean")


@query(f"""WITH {RUN_SQL}, c AS (SELECT * FROM rated WHERE side = 0), b AS (SELECT * FROM rated WHERE side = 1), {', '.join(f"m{i} AS (SELECT c.run, '{m}' AS metric, CAST(b.{m} AS DOUBLE) AS baseline, CAST(c.{m} AS DOUBLE) AS current FROM c JOIN b ON c.run = b.run WHERE c.{m} {'<' if m in ('success', 'speed_mean') else '>'} b.{m})" for i, m in enumerate(_METRICS))}
SELECT run, 'baseline_regression' AS type, metric, baseline, current FROM ({' UNION ALL '.join(f'SELECT * FROM m{i}' for i in range(len(_METRICS)))}) UNION ALL SELECT run, 'threshold_failure', 'partial_rate', 0.2, partial_rate FROM c WHERE partial_rate > 0.2 UNION ALL SELECT run, 'threshold_failure', 'low_table_rate', 0.07, low_table_rate FROM c WHERE low_table_rate > 0.07 UNION ALL SELECT run, 'threshold_failure', 'speed_min', 5.0, speed_min FROM c WHERE speed_min < 5.0""")
def corpus_quality_gate(spark: SparkSession, d: str) -> DataFrame:
    s = _runs(spark, d)
    return op.quality_gate(s.filter("side = 0"), s.filter("side = 1"), "run", _METRICS[:3], _METRICS[3:], {"partial_rate": ("max", 0.2), "low_table_rate": ("max", 0.07), "speed_min": ("min", 5.0)})


@query("""WITH m AS (SELECT o_custkey AS run, concat('R', o_orderkey % 3) AS a, o_orderkey % 4 AS x, concat('R', o_orderkey % 5) AS b, o_orderkey % 6 AS y FROM orders) SELECT run, reason, CAST(sum(n) AS BIGINT) AS count FROM (SELECT run, a AS reason, x AS n FROM m UNION ALL SELECT run, b, y FROM m WHERE a <> b) GROUP BY ALL""")
def merged_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    a, b = F.concat(F.lit("R"), k % 3), F.concat(F.lit("R"), k % 5)
    first = F.create_map(a, k % 4)
    return op.merged_counts(table(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.when(a == b, first).otherwise(F.create_map(a, k % 4, F.when(a == b, F.concat(b, F.lit("_"))).otherwise(b), k % 6)).alias("counts")), ["run"], "counts")


@query("""WITH s AS (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'min_tables below Appendix limit' WHEN 1 THEN 'Figure caption missing' WHEN 2 THEN 'technical Heading lost' ELSE 'timeout' END AS text, CASE event_id % 3 WHEN 0 THEN 'conversion_exit_code' WHEN 1 THEN 'minimum' ELSE event_type END AS category FROM events),
h AS (SELECT 'appendix_clause_requirement_fixture' AS hint, 'P1' AS priority, * FROM s WHERE regexp_matches(lower(text), 'appendix|clause|heading|requirement') UNION ALL SELECT 'vendor_requirement_table_fixture', 'P1', * FROM s WHERE regexp_matches(lower(text), 'table|domain_units|technical|min_tables|min_domain_units') UNION ALL SELECT 'captionless_diagram_diagnostics', 'P2', * FROM s WHERE regexp_matches(lower(text), 'figure|diagram|ocr|caption|image') UNION ALL SELECT 'conversion_failure_reproducer', 'P1', * FROM s WHERE category = 'conversion_exit_code')
SELECT hint, priority, count(*) AS signatures, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories FROM h GROUP BY ALL""")
def followup_hints(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").select(F.col("event_id").alias("id"), F.expr("CASE event_id % 4 WHEN 0 THEN 'min_tables below Appendix limit' WHEN 1 THEN 'Figure caption missing' WHEN 2 THEN 'technical Heading lost' ELSE 'timeout' END").alias("text"), F.expr("CASE event_id % 3 WHEN 0 THEN 'conversion_exit_code' WHEN 1 THEN 'minimum' ELSE event_type END").alias("category"))
    return op.followups(s, "text", "category", "id")


@query("""WITH l AS (SELECT o_custkey AS doc_id, CASE o_orderkey % 6 WHEN 0 THEN concat('/abs/', o_orderkey % 9) WHEN 1 THEN 'https://x/y.png' WHEN 2 THEN concat('./img-', o_orderkey % 9) ELSE concat('img-', o_orderkey % 9) END AS path FROM orders), m AS (SELECT o_custkey AS doc_id, concat('img-', o_orderkey % 11) AS path FROM orders WHERE o_orderkey % 3 = 0), a AS (SELECT o_custkey AS doc_id, concat('img-', o_orderkey % 13) AS path FROM orders WHERE o_orderkey % 4 < 3),
s AS (SELECT doc_id, regexp_replace(path, '^\\./', '') AS path, 1 AS side FROM l WHERE NOT regexp_matches(path, '^(?i)[a-z][a-z0-9+.-]*:') UNION ALL SELECT *, 2 FROM m UNION ALL SELECT *, 4 FROM a), b AS (SELECT doc_id, path, bool_or(side = 1) AS linked, bool_or(side = 2) AS listed, bool_or(side = 4) AS there FROM s GROUP BY ALL)
SELECT doc_id, 'warning' AS severity, 'absolute_markdown_image_link' AS code, path FROM b WHERE linked AND starts_with(path, '/') UNION ALL SELECT doc_id, 'error', 'missing_markdown_image_asset', path FROM b WHERE linked AND NOT there UNION ALL SELECT doc_id, 'error', 'missing_manifest_image_asset', path FROM b WHERE listed AND NOT there UNION ALL SELECT doc_id, 'warning', 'orphan_image_asset', path FROM b WHERE there AND NOT linked AND NOT listed""")
def artifact_integrity(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("doc_id", F.col("o_custkey"))
    links = o.select("doc_id", F.expr("CASE o_orderkey % 6 WHEN 0 THEN concat('/abs/', o_orderkey % 9) WHEN 1 THEN 'https://x/y.png' WHEN 2 THEN concat('./img-', o_orderkey % 9) ELSE concat('img-', o_orderkey % 9) END").alias("path"))
    manifest = o.filter("o_orderkey % 3 = 0").select("doc_id", F.concat(F.lit("img-"), F.col("o_orderkey") % 11).alias("path"))
    assets = o.filter("o_orderkey % 4 < 3").select("doc_id", F.concat(F.lit("img-"), F.col("o_orderkey") % 13).alias("path"))
    return op.integrity(links, manifest, assets, ["doc_id"])


@query("""WITH e AS (SELECT o_orderkey AS file, o_custkey % 5 AS expected, o_orderkey % 10 = 0 AS omitted FROM orders), a AS (SELECT l_orderkey AS file, count(*) AS n FROM lineitem WHERE l_quantity < 25 GROUP BY 1), j AS (SELECT e.*, n FROM e LEFT JOIN a USING (file))
SELECT file, 'warning' AS severity, 'omitted_sidecar_present' AS code FROM j WHERE omitted AND n IS NOT NULL UNION ALL SELECT file, 'error', 'missing_counted_sidecar' FROM j WHERE expected > 0 AND n IS NULL UNION ALL SELECT file, 'error', 'sidecar_record_count_mismatch' FROM j WHERE coalesce(n, 0) <> expected AND NOT (expected > 0 AND n IS NULL)""")
def sidecar_count_check(spark: SparkSession, d: str) -> DataFrame:
    expected = table(spark, d, "orders").select(F.col("o_orderkey").alias("file"), (F.col("o_custkey") % 5).alias("expected"), (F.col("o_orderkey") % 10 == 0).alias("omitted"))
    return op.sidecar_counts(expected, table(spark, d, "lineitem").filter("l_quantity < 25").select(F.col("l_orderkey").alias("file")), ["file"])
