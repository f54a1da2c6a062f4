"""Queries of outputs, samples and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import domain as dom
from ..operators import lines as ln
from ..operators import outputs as op
from ..operators.retrieval import coverage_sets as sets
from ..session import table
from .corpus_data import GEO_SQL, SPEC_SQL, geo, spec
from .q_lines import PAGE, TYPED_SQL
from .q_tables import GRID_SQL, measured
from .registry import query, sql_case


@query(f"""WITH {GEO_SQL}, {TYPED_SQL} SELECT doc_id, page, string_agg(CASE WHEN line_type = 'heading_index' THEN concat('## ', text) WHEN line_type = 'list_item' THEN concat('- ', regexp_replace(text, '^\\s*([-*]|\\d+[.)])\\s+', '')) WHEN line_type LIKE '%caption' THEN concat('*', text, '*') ELSE text END, chr(10) || chr(10) ORDER BY line_no) AS markdown FROM typed GROUP BY ALL""")
def markdown_pages(spark: SparkSession, d: str) -> DataFrame:
    return op.markdown(ln.typed(geo(spark, d)), PAGE, "line_no")


@query("""WITH j AS (SELECT p_partkey, concat('{"id":"part-', p_partkey, '","brand":"', p_brand, '"', CASE WHEN p_size % 2 = 0 THEN concat(',"size":', p_size) ELSE '' END, '}') AS metadata FROM part) SELECT p_partkey, metadata, CAST(strlen(metadata) AS INT) AS metadata_bytes, strlen(metadata) <= 48 AS fits FROM j""")
def vector_metadata(spark: SparkSession, d: str) -> DataFrame:
    fields = {"id": F.concat(F.lit("part-"), "p_partkey"), "brand": F.col("p_brand"), "size": F.when(F.col("p_size") % 2 == 0, F.col("p_size"))}
    return op.metadata(table(spark, d, "part"), fields, 48).select("p_partkey", "metadata", "metadata_bytes", "fits")


@query("""SELECT o_custkey AS grp, o_orderkey, format('doc-{:04d}', dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)) AS public_id FROM orders""")
def confidential_ids(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("grp"), "o_orderkey")
    return op.public_ids(o, "o_orderkey", "o_orderkey", True)


@query(f"""WITH {GRID_SQL}, s AS (SELECT grid_id, 0.4 * (0.35 * (1 - empty_ratio) + 0.2 + 0.15 * (header_fill + consistency + density)) + 0.25 * header_fill + 0.15 * density + 0.1 * header_fill + 0.1 * (1 - empty_ratio) + CASE WHEN grid_id % 2 = 0 THEN 0.03 ELSE 0 END - CASE WHEN grid_id % 5 = 0 THEN 0.06 ELSE 0 END
 - least(grid_id % 7 * 0.025, 0.12) - 0.02 - CASE WHEN header_fill < 0.5 THEN 0.08 ELSE 0 END AS s FROM rat), c AS (SELECT grid_id, round(greatest(0, least(CASE WHEN grid_id % 5 = 0 THEN least(s, 0.79) ELSE s END, 1)), 4)::DOUBLE AS confidence FROM s)
SELECT grid_id, confidence, CASE WHEN confidence >= 0.82 THEN 'high' WHEN confidence >= 0.64 THEN 'medium' ELSE 'low' END AS bucket FROM c""")
def table_confidence(spark: SparkSession, d: str) -> DataFrame:
    m = measured(spark, d)
    q = 0.35 * (1 - F.col("empty_ratio")) + 0.2 + 0.15 * (F.col("header_fill") + F.col("consistency") + F.col("density"))
    m = m.withColumns({"quality": q, "header_confidence": F.col("header_fill"), "captioned": F.col("grid_id") % 2 == 0, "is_html": F.col("grid_id") % 5 == 0, "fallbacks": F.col("grid_id") % 7, "notes": F.lit(True), "merged": F.lit(False)})
    return op.table_confidence(m).select("grid_id", "confidence", "bucket")


@query(f"""WITH {SPEC_SQL}, c AS (SELECT unit, page, {sql_case(op.SECURITY_TEXT, t='text')} AS candidate, CASE unit % 4 WHEN 0 THEN 0.64 WHEN 1 THEN 0.60 WHEN 2 THEN 0.58 ELSE 0.56 END + CASE WHEN page % 2 = 0 THEN 0.03 ELSE 0 END AS c FROM spec) SELECT unit, candidate, round(least(c, 0.67), 2)::DOUBLE AS confidence FROM c WHERE candidate IS NOT NULL""")
def security_candidates(spark: SparkSession, d: str) -> DataFrame:
    s = spec(spark, d).withColumns({"block": F.expr("CASE unit % 4 WHEN 0 THEN 'heading' WHEN 1 THEN 'list' WHEN 2 THEN 'paragraph' ELSE 'code' END"), "under": F.col("page") % 2 == 0})
    return op.text_candidates(s, "text", "block", "under").select("unit", "candidate", "confidence")


@query(f"""WITH {SPEC_SQL} SELECT unit, CASE {' '.join(f"WHEN regexp_matches(lower(text), '{w}') THEN '{n}'" for n, w in dom.FAMILIES)} END AS family FROM spec""")
def requirement_families(spark: SparkSession, d: str) -> DataFrame:
    return spec(spark, d).select("unit", dom.family("text").alias("family"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey > 5 THEN c_nationkey END AS nation, nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END, '') AS segment, CAST(1 + CASE WHEN c_nationkey > 5 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 3 <> 0 THEN 1 ELSE 0 END AS INT) AS n_fields FROM customer""")
def normalized_fields(spark: SparkSession, d: str) -> DataFrame:
    f = dom.normalised({"name": F.col("c_name"), "nation": F.when(F.col("c_nationkey") > 5, F.col("c_nationkey")), "segment": F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment"))})
    c = table(spark, d, "customer").withColumn("fields", f)
    return c.select("c_custkey", F.element_at("fields", F.lit("nation")).cast("int").alias("nation"), F.element_at("fields", F.lit("segment")).alias("segment"), F.size("fields").alias("n_fields"))


@query("""WITH a AS (SELECT o_custkey AS k, list_sort(list(DISTINCT o_orderkey % 10)) AS found, list_sort(list(DISTINCT o_orderkey % 7)) AS expected FROM orders GROUP BY 1)
SELECT k, array_to_string(list_sort(list_filter(expected, lambda x: list_contains(found, x))), ',') AS covered, array_to_string(list_sort(list_filter(expected, lambda x: NOT list_contains(found, x))), ',') AS missing FROM a""")
def coverage_sets(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set(F.col("o_orderkey") % 10).alias("found"), F.collect_set(F.col("o_orderkey") % 7).alias("expected"))
    covered, missing = sets("found", "expected")
    text = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x.cast("string")), ",")
    return a.select("k", text(covered).alias("covered"), text(missing).alias("missing"))


@query("""WITH c AS (SELECT l_returnflag AS preset, l_suppkey % 3 + 1 AS weight, l_discount * 12 AS ratio FROM lineitem), s AS (SELECT preset, round(sum(weight * greatest(0, least(ratio, 1))), 4) AS earned, CAST(sum(weight) AS BIGINT) AS possible FROM c GROUP BY 1) SELECT *, round(earned / possible * 100, 2) AS score FROM s""")
def preset_score(spark: SparkSession, d: str) -> DataFrame:
    return op.weighted_score(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("preset"), (F.col("l_suppkey") % 3 + 1).alias("weight"), (F.col("l_discount") * 12).alias("ratio")), ["preset"])


@query(f"""WITH {GEO_SQL}, u AS (SELECT doc_id, page * 100 + line_no AS o, text, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY page * 100 + line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM geo) SELECT doc_id, o, left(text, CAST(120 - used AS INT)) AS text FROM u WHERE used < 120""")
def preflight_sample(spark: SparkSession, d: str) -> DataFrame:
    g = geo(spark, d).select("doc_id", (F.col("page") * 100 + F.col("line_no")).alias("o"), "text")
    return op.text_sample(g, ["doc_id"], "o", "text", 120)


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE n <= 4 OR i IN (0, round_even((n - 1) / 3, 0), round_even(2 * (n - 1) / 3, 0), n - 1)""")
def even_page_sample(spark: SparkSession, d: str) -> DataFrame:
    return op.even_sample(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", 4)


@query("""SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL""")
def first_per_type(spark: SparkSession, d: str) -> DataFrame:
    return op.first_of(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_type", "event_id")


@query(f"""WITH {GEO_SQL}, {TYPED_SQL}, b AS (SELECT doc_id, font_size AS body_size FROM geo GROUP BY doc_id, font_size QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, font_size) = 1),
g AS (SELECT *, CASE WHEN lag(bottom) OVER w IS NOT NULL THEN greatest(top - lag(bottom) OVER w, 0) END AS gb, CASE WHEN lead(top) OVER w IS NOT NULL THEN greatest(lead(top) OVER w - bottom, 0) END AS ga FROM typed WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_no))
SELECT doc_id, page, line_no, CASE WHEN line_type IN ('figure_caption', 'table_caption') THEN 'caption' WHEN line_type = 'heading_index' THEN 'heading' WHEN line_type = 'list_item' THEN 'list'
WHEN font_size >= greatest(body_size * 1.35, body_size + 3) AND length(trim(text)) <= 120 AND NOT regexp_matches(text, '[.!?]$') AND line_type = 'body_line' THEN CASE WHEN (gb IS NULL OR gb >= body_size * 1.2) AND (ga IS NULL OR ga >= body_size * 1.2) THEN 'heading' ELSE 'large_paragraph' END ELSE 'paragraph' END AS block_type FROM g JOIN b USING (doc_id)""")
def block_types(spark: SparkSession, d: str) -> DataFrame:
    g = ln.gaps(ln.typed(geo(spark, d)), PAGE)
    return op.classified(g, ["doc_id"], ln.body_size(geo(spark, d), ["doc_id"])).select(*PAGE, "line_no", "block_type")
