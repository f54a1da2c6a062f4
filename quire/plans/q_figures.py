"""Figure queries: figures from parts, blocks from lines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import figures as op
from ..session import table
from .corpus_data import GEO_SQL, geo
from .q_lines import PAGE
from .registry import query

FIG = """SELECT p_partkey AS figure_id, CAST(p_partkey // 40 AS INT) AS page, CASE p_size % 5 WHEN 0 THEN 'diagram' WHEN 1 THEN 'chart' ELSE 'image' END AS figure_kind,
 CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN concat('Figure ', p_partkey, ': Block diagram of ', p_name) WHEN 2 THEN concat('Memory map of ', p_name) ELSE concat('Result ', p_name) END AS caption_text,
 CASE WHEN p_size % 3 = 0 THEN {} ELSE {'1 Overview', p_brand} END AS heading_path, CASE WHEN p_size % 7 < 3 THEN {} WHEN p_size % 7 < 5 THEN {'FIFO'} ELSE {'FIFO', p_brand, 'PHY-1'} END AS detected_labels,
 CASE WHEN p_partkey % 3 = 0 THEN {p_type} ELSE {} END AS nearby_texts, CASE WHEN p_partkey % 5 = 0 THEN {p_name, 'flowchart'} ELSE {} END AS ocr_texts,
 p_size % 2 = 0 AS diagram_candidate, CASE WHEN p_size % 6 > 0 THEN p_size % 10 / 10.0 END AS caption_confidence FROM part"""
FIG_SQL = "fig AS (" + re.sub(r"\{([^}]*)\}", r"[\1]::VARCHAR[]", FIG).replace("/ 10.0 END", "/ 10.0::DOUBLE END") + ")"


def figs(spark: SparkSession, d: str) -> DataFrame:
    sql = re.sub(r"\{([^}]*)\}", r"cast(array(\1) as array<string>)", FIG).replace("//", "div").replace("/ 10.0 END", "/ 10.0D END").replace("FROM part", "FROM {part}")
    return spark.sql(sql, part=table(spark, d, "part"))


SIGNALS = "CASE WHEN caption_text <> '' THEN 1 ELSE 0 END" + "".join(f" + CASE WHEN len({c}) > 0 THEN 1 ELSE 0 END" for c in op.LISTS)
CONF_SQL = f"""{FIG_SQL}, sig AS (SELECT *, {SIGNALS} AS signals FROM fig), conf AS (SELECT *, round(least(greatest(0.42::DOUBLE + 0.1::DOUBLE * signals + CASE WHEN diagram_candidate THEN 0.08::DOUBLE ELSE 0 END, coalesce(least(caption_confidence, 0.92::DOUBLE), 0)), 0.95::DOUBLE), 2) AS confidence FROM sig)"""


@query(f"""WITH {CONF_SQL} SELECT figure_id, CAST(signals AS INT) AS signals, confidence, CASE WHEN confidence < 0.55 OR signals <= 1 THEN 'high' WHEN confidence < 0.65 OR caption_text = '' THEN 'medium' ELSE 'low' END AS risk,
array_to_string(list_sort(list_filter(['visual_pixels_not_interpreted', CASE WHEN confidence < 0.65 THEN 'low_classification_confidence' END, CASE WHEN caption_text = '' THEN 'missing_caption' END, CASE WHEN signals <= 1 THEN 'single_evidence_signal' END], lambda x: x IS NOT NULL)), ',') AS review_reasons FROM conf""")
def figure_confidence(spark: SparkSession, d: str) -> DataFrame:
    return op.with_confidence(figs(spark, d)).select("figure_id", "signals", "confidence", "risk", F.array_join("review_reasons", ",").alias("review_reasons"))


_HAY = "lower(concat_ws(' ', figure_kind, caption_text, array_to_string(heading_path, ' '), array_to_string(nearby_texts, ' ')))"
TYPE_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains({_HAY}, '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in op.STRUCTURES) + " WHEN figure_kind = 'image' AND len(detected_labels) > 0 THEN 'diagram' ELSE figure_kind END"


def _text_sql(first: str, caption: str, path: str, labels: str, nearby: str, ocr: str) -> str:
    each = lambda p, c: f"list_transform({c}, lambda x: concat('{p}', x))"
    listed = lambda p, c, s: f"CASE WHEN len({c}) > 0 THEN concat('{p}', array_to_string({c}, '{s}')) END"
    head = f"list_filter([{first}, CASE WHEN caption_text <> '' THEN concat('{caption}', caption_text) END, {listed(path, 'heading_path', ' > ')}, {listed(labels, 'detected_labels', ' | ')}], lambda x: x IS NOT NULL)"
    return f"array_to_string(list_concat(list_concat({head}, {each(nearby, 'nearby_texts')}), {each(ocr, 'ocr_texts')}), chr(10))"


@query(f"""WITH {FIG_SQL}, t AS (SELECT *, {TYPE_SQL} AS structure_type FROM fig) SELECT figure_id, structure_type, {_text_sql("concat('figure_structure: ', structure_type)", 'caption: ', 'heading_path: ', 'nodes_or_labels: ', 'nearby_text: ', 'observed_ocr_text: ')} AS structure_text FROM t""")
def figure_structures(spark: SparkSession, d: str) -> DataFrame:
    return figs(spark, d).withColumn("structure_type", op.structure_type()).select("figure_id", "structure_type", op.structure_text().alias("structure_text"))


@query(f"""WITH {FIG_SQL} SELECT figure_id, {_text_sql("'Generated figure description (context-only).', concat('Figure kind: ', figure_kind, '.')", 'Caption: ', 'Heading path: ', 'Detected labels: ', 'Nearby text: ', 'Observed OCR text: ')} AS description_text FROM fig""")
def figure_descriptions(spark: SparkSession, d: str) -> DataFrame:
    return figs(spark, d).select("figure_id", op.description_text().alias("description_text"))


@query(f"""WITH {FIG_SQL}, h AS (SELECT figure_id, detected_labels AS l, unnest(range(1, len(detected_labels))) AS i FROM fig) SELECT figure_id, CAST(i - 1 AS INT) AS hint_no, l[i] AS source_label, l[i + 1] AS target_label FROM h""")
def figure_label_hints(spark: SparkSession, d: str) -> DataFrame:
    return op.hints(figs(spark, d), "figure_id")


BLOCKS_SQL = "blk AS (SELECT doc_id, page, line_no AS block_index, CASE WHEN line_no % 4 <> 0 THEN line_no * 2 END AS line_max, CASE WHEN line_no % 5 <> 0 THEN top END AS top, text AS heading FROM geo WHERE line_no % 2 = 1), img AS (SELECT doc_id, page, line_no AS figure_id, CASE WHEN line_no % 3 = 0 THEN line_no * 2 - 3 END AS anchor_line, CASE WHEN line_no % 3 < 2 THEN top - 30 END AS anchor_top FROM geo WHERE line_no % 2 = 0)"


@query(f"""WITH {GEO_SQL}, {BLOCKS_SQL} SELECT doc_id, page, figure_id, coalesce((SELECT arg_max(heading, line_max * 1000 + block_index) FROM blk b WHERE b.doc_id = i.doc_id AND b.page = i.page AND b.line_max <= i.anchor_line), (SELECT arg_max(heading, top * 1000 + block_index) FROM blk b WHERE b.doc_id = i.doc_id AND b.page = i.page AND b.top <= i.anchor_top), (SELECT arg_min(heading, block_index) FROM blk b WHERE b.doc_id = i.doc_id AND b.page = i.page)) AS heading FROM img i""")
def figure_headings(spark: SparkSession, d: str) -> DataFrame:
    g = geo(spark, d)
    n = F.col("line_no")
    blocks = g.filter(n % 2 == 1).select(*PAGE, n.alias("block_index"), F.when(n % 4 != 0, n * 2).alias("line_max"), F.when(n % 5 != 0, F.col("top")).alias("top"), F.col("text").alias("heading"))
    images = g.filter(n % 2 == 0).select(*PAGE, n.cast("long").alias("figure_id"), F.when(n % 3 == 0, n * 2 - 3).alias("anchor_line"), F.when(n % 3 < 2, F.col("top") - 30).alias("anchor_top"))
    return op.nearby_heading(images, blocks, PAGE).select(*PAGE, "figure_id", "heading")


@query(f"""WITH {GEO_SQL}, t AS (SELECT doc_id, page, CASE WHEN line_no % 2 = 0 THEN 'table' ELSE 'figure' END AS target_type, CAST(line_no AS BIGINT) AS target_id, CASE WHEN line_no % 5 = 0 THEN ' ' ELSE upper(replace(text, ' ', '  ')) END AS caption_text, font_size / 20 AS confidence FROM geo),
b AS (SELECT doc_id, page, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS k, min(CAST(line_no + 100 AS BIGINT)) AS block FROM geo WHERE line_no % 3 <> 0 GROUP BY ALL)
SELECT t.doc_id, t.page, concat(target_type, '_caption') AS link_type, target_type, target_id, CASE WHEN block IS NULL THEN target_type ELSE 'text_block' END AS caption_source_type, coalesce(block, target_id) AS caption_source_id, confidence FROM t LEFT JOIN b ON t.doc_id = b.doc_id AND t.page = b.page AND lower(trim(regexp_replace(caption_text, '\\s+', ' ', 'g'))) = k WHERE trim(caption_text) <> ''""")
def caption_block_links(spark: SparkSession, d: str) -> DataFrame:
    g, n = geo(spark, d), F.col("line_no")
    targets = g.select(*PAGE, F.when(n % 2 == 0, "table").otherwise("figure").alias("target_type"), n.cast("long").alias("target_id"), F.when(n % 5 == 0, " ").otherwise(F.upper(F.replace("text", F.lit(" "), F.lit("  ")))).alias("caption_text"), (F.col("font_size") / 20).alias("confidence"))
    blocks = g.filter(n % 3 != 0).select(*PAGE, (n + 100).cast("long").alias("block_id"), "text")
    return op.caption_links(targets, blocks, PAGE)


@query(f"""WITH {GEO_SQL} SELECT doc_id, page, line_no, 48.96::DOUBLE AS crop_x0, CASE WHEN top > 90 THEN greatest(0, greatest(top - 8, 1) - 70) ELSE least(bottom + 8, 199) END AS crop_top, 563.04::DOUBLE AS crop_x1, CASE WHEN top > 90 THEN greatest(top - 8, 1) ELSE least(200, least(bottom + 8, 199) + 70) END AS crop_bottom FROM geo""")
def caption_crops(spark: SparkSession, d: str) -> DataFrame:
    x0, top, x1, bottom = op.crop_near_caption(F.col("top"), F.col("bottom"), 612.0, 200.0)
    return geo(spark, d).select(*PAGE, "line_no", x0.alias("crop_x0"), top.alias("crop_top"), x1.alias("crop_x1"), bottom.alias("crop_bottom"))


@query("""WITH lay AS (SELECT CASE WHEN o_orderkey % 13 > 0 THEN concat('layout-', o_orderkey) END AS id, o_custkey % 9 > 0 AS paged, CASE WHEN o_orderkey % 17 > 0 THEN o_orderkey % 4 END AS n, o_orderkey % 4 + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS declared FROM orders),
fg AS (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0), ev AS (SELECT CASE WHEN o_orderkey % 11 > 0 THEN concat('ev-', o_orderkey) END AS id, o_orderkey % 2 = 0 AS is_fig, o_custkey AS f, o_orderkey % 5 > 0 AS has, o_orderkey % 19 = 0 AS repl, c_custkey IS NOT NULL AS known FROM orders LEFT JOIN fg ON o_custkey = c_custkey),
de AS (SELECT concat('de-', o_orderkey) AS id, CASE WHEN o_orderkey % 8 > 0 THEN o_custkey END AS f, o_orderkey % 5 > 0 AS has, o_orderkey % 6 > 0 AS gen, o_orderkey % 23 > 0 AS scoped, c_custkey IS NOT NULL AS known FROM orders LEFT JOIN fg ON o_custkey = c_custkey)
SELECT 'page_layout' AS file, 'missing_layout_id' AS code, id AS record_id FROM lay WHERE id IS NULL UNION ALL SELECT 'page_layout', 'invalid_layout_page', id FROM lay WHERE NOT paged UNION ALL SELECT 'page_layout', 'invalid_layout_region_refs', id FROM lay WHERE n IS NULL UNION ALL SELECT 'page_layout', 'layout_region_ref_count_mismatch', id FROM lay WHERE n IS NOT NULL AND n <> declared
UNION ALL SELECT 'ocr_evidence', 'missing_evidence_id', id FROM ev WHERE id IS NULL UNION ALL SELECT 'ocr_evidence', 'ocr_evidence_unresolved_figure', id FROM ev WHERE is_fig AND NOT known UNION ALL SELECT 'ocr_evidence', 'ocr_evidence_missing_figure_source_ref', id FROM ev WHERE is_fig AND NOT has UNION ALL SELECT 'ocr_evidence', 'ocr_evidence_replaced_source_text', id FROM ev WHERE repl
UNION ALL SELECT 'descriptions', 'missing_description_figure_id', id FROM de WHERE f IS NULL UNION ALL SELECT 'descriptions', 'description_unresolved_figure', id FROM de WHERE f IS NOT NULL AND NOT known UNION ALL SELECT 'descriptions', 'description_missing_figure_source_ref', id FROM de WHERE f IS NOT NULL AND known AND NOT has
UNION ALL SELECT 'descriptions', 'description_missing_generated_text_flag', id FROM de WHERE NOT gen UNION ALL SELECT 'descriptions', 'description_generated_content_scope_violation', id FROM de WHERE NOT scoped""")
def visual_contract(spark: SparkSession, d: str) -> DataFrame:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    refs = F.when(k % 5 > 0, F.array("o_custkey")).otherwise(F.array().cast("array<bigint>"))
    lay = o.select(F.when(k % 13 > 0, F.concat(F.lit("layout-"), k)).alias("layout_id"), F.when(F.col("o_custkey") % 9 > 0, 1).alias("page"), F.when(k % 17 > 0, F.expr("if(o_orderkey % 4 = 0, array(), sequence(1, cast(o_orderkey % 4 as int)))")).alias("region_refs"), (k % 4 + F.when(k % 7 == 0, 1).otherwise(0)).alias("region_ref_count"))
    ev = o.select(F.when(k % 11 > 0, F.concat(F.lit("ev-"), k)).alias("evidence_id"), F.when(k % 2 == 0, "figure").otherwise("table").alias("target_type"), F.col("o_custkey").alias("target_id"), refs.alias("ref_ids"), (k % 19 == 0).alias("text_replaced"))
    de = o.select(F.concat(F.lit("de-"), k).alias("description_id"), F.when(k % 8 > 0, F.col("o_custkey")).alias("figure_id"), refs.alias("ref_ids"), (k % 6 > 0).alias("generated_text"), F.when(k % 23 > 0, "sidecar_only").otherwise("markdown").alias("scope"), F.lit(False).alias("markdown_inserted"))
    return op.visual_findings(lay, ev, de, table(spark, d, "customer").filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("figure_id")))


@query(f"""WITH {CONF_SQL} SELECT figure_kind, count(*) AS figures, count(*) FILTER (caption_text <> '') AS captioned, count(*) FILTER (len(ocr_texts) > 0) AS with_ocr, count(*) FILTER (confidence < 0.65) AS low_confidence, round(avg(confidence), 4) AS mean_confidence, round(count(*) FILTER (confidence >= 0.55) / count(*), 4) AS pass_rate FROM conf GROUP BY 1""")
def figure_evaluation(spark: SparkSession, d: str) -> DataFrame:
    c = op.with_confidence(figs(spark, d))
    n = lambda x: F.count(F.when(x, 1))
    return c.groupBy("figure_kind").agg(
        F.count("*").alias("figures"), n(F.col("caption_text") != "").alias("captioned"), n(F.size("ocr_texts") > 0).alias("with_ocr"), n(F.col("confidence") < op.LOW_CONFIDENCE).alias("low_confidence"),
        F.round(F.avg("confidence"), 4).alias("mean_confidence"), F.round(n(F.col("confidence") >= 0.55) / F.count("*"), 4).alias("pass_rate"),
    )
