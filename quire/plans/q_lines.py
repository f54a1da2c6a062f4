"""Line-level queries: texts from documents, geometry from order items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import LINE_TYPE
from ..functions.text import char_tokens, digit_mask, heading_level, leading_index, regex_tokens, search_key, slug
from ..operators import lines as op
from .corpus_data import GEO_SQL, LINES_SQL, geo, lines
from .registry import query, sql_case

PAGE = ["doc_id", "page"]
TYPED_SQL = f"typed AS (SELECT *, {sql_case(LINE_TYPE, 'body_line', t='trim(text)')} AS line_type FROM geo)"
MASK = r"regexp_replace(lower(trim(regexp_replace({}, '\s+', ' ', 'g'))), '[0-9]+', '#', 'g')"


@query(f"WITH {GEO_SQL}, {TYPED_SQL} SELECT doc_id, line_type, count(*) AS n FROM typed GROUP BY ALL")
def line_types(spark: SparkSession, d: str) -> DataFrame:
    return op.typed(geo(spark, d)).groupBy("doc_id", "line_type").agg(F.count("*").alias("n"))


@query(f"""WITH {LINES_SQL} SELECT doc_id, line_no, {MASK.format('text')} AS masked, nullif(left(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), 96), '') AS slug,
nullif(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), '') AS search_key, CAST((length(text) + 3) // 4 AS INT) AS char_tokens, CAST(len(regexp_extract_all(text, '\\w+|[^\\w\\s]')) AS INT) AS regex_tokens FROM lines""")
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("doc_id", "line_no", digit_mask("text").alias("masked"), slug("text").alias("slug"), search_key("text").alias("search_key"), char_tokens("text").alias("char_tokens"), regex_tokens("text").alias("regex_tokens"))


@query(f"""WITH {GEO_SQL}, i AS (SELECT doc_id, page, line_no, nullif(regexp_extract(trim(text), '^(\\d+(?:[.]\\d+)*)\\s+\\S', 1), '') AS idx FROM geo)
SELECT doc_id, page, line_no, idx, CAST(least(length(idx) - length(replace(idx, '.', '')) + 1, 6) AS INT) AS level FROM i WHERE idx IS NOT NULL""")
def heading_levels(spark: SparkSession, d: str) -> DataFrame:
    g = geo(spark, d).withColumn("idx", leading_index("text")).filter("idx is not null")
    return g.select("doc_id", "page", "line_no", "idx", heading_level("idx").cast("int").alias("level"))


MARGIN = "(top <= 87.12 OR bottom >= 792 - 75)"
REPEATED_SQL = f"""{GEO_SQL}, pages AS (SELECT doc_id, count(DISTINCT page) AS pages FROM geo GROUP BY 1),
keyed AS (SELECT doc_id, page, line_no, CAST(round_even(top / 12.0, 0) * 12 AS INT) AS band, {MASK.format('text')} AS key, {MARGIN} AS in_margin FROM geo),
repeated AS (SELECT doc_id, band, key, count(DISTINCT page) AS on_pages FROM keyed JOIN pages USING (doc_id) WHERE in_margin AND length(key) >= 2 GROUP BY doc_id, band, key, pages HAVING pages >= 3 AND count(DISTINCT page) >= greatest(3, ceil(pages * 0.6)))"""


@query(f"WITH {REPEATED_SQL} SELECT * FROM repeated")
def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    return op.repeated_keys(geo(spark, d), ["doc_id"])


@query(f"WITH {REPEATED_SQL} SELECT g.* FROM geo g JOIN keyed k USING (doc_id, page, line_no) WHERE NOT (in_margin AND EXISTS (SELECT 1 FROM repeated r WHERE r.doc_id = k.doc_id AND r.band = k.band AND r.key = k.key))")
def remove_repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    return op.without_repeated(geo(spark, d), ["doc_id"])


@query(f"WITH {GEO_SQL} SELECT doc_id, round(font_size, 2) AS body_size FROM geo GROUP BY doc_id, round(font_size, 2) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, round(font_size, 2)) = 1")
def body_font_mode(spark: SparkSession, d: str) -> DataFrame:
    return op.body_size(geo(spark, d), ["doc_id"])


@query(f"WITH {GEO_SQL} SELECT doc_id, x0 FROM geo GROUP BY doc_id, x0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(page * 1000 + line_no)) = 1")
def dominant_indent(spark: SparkSession, d: str) -> DataFrame:
    return op.dominant(geo(spark, d).withColumn("o", F.col("page") * 1000 + F.col("line_no")), ["doc_id"], "x0", "o")


@query(f"""WITH {GEO_SQL} SELECT doc_id, page, line_no, CASE WHEN lag(bottom) OVER w IS NOT NULL THEN greatest(top - lag(bottom) OVER w, 0) END AS gap_before, CASE WHEN lead(top) OVER w IS NOT NULL THEN greatest(lead(top) OVER w - bottom, 0) END AS gap_after
FROM geo WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_no)""")
def line_gaps(spark: SparkSession, d: str) -> DataFrame:
    return op.gaps(geo(spark, d), PAGE).select(*PAGE, "line_no", "gap_before", "gap_after")


@query(f"""WITH {GEO_SQL}, {TYPED_SQL}, c AS (SELECT *, CASE WHEN line_type IS NOT DISTINCT FROM lag(line_type) OVER (PARTITION BY doc_id, page ORDER BY line_no) THEN 0 ELSE 1 END AS ch FROM typed),
i AS (SELECT *, sum(ch) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS island FROM c)
SELECT doc_id, page, CAST(island AS BIGINT) AS island, line_type, min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom, string_agg(text, chr(10) ORDER BY line_no) AS text FROM i GROUP BY doc_id, page, island, line_type""")
def islands_blocks(spark: SparkSession, d: str) -> DataFrame:
    i = op.islands(op.typed(geo(spark, d)), PAGE, "line_type")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    return i.groupBy(*PAGE, "island", "line_type").agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"), text.alias("text"))


@query()
def greedy_line_merge(spark: SparkSession, d: str) -> DataFrame:
    return op.merge_runs(geo(spark, d), PAGE).groupBy(*PAGE, "run").agg(F.count("*").alias("n_lines"), F.min("line_no").alias("first_line"))


@query(f"""WITH {GEO_SQL}, c AS (SELECT *, coalesce(regexp_matches(text, '[A-Za-z0-9]-$') AND regexp_matches(lead(text) OVER w, '^[a-z0-9A-Z]'), false) AS cand, lead(text) OVER w AS nxt FROM geo WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_no)),
i AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id, page, cand ORDER BY line_no) AS isl FROM c), j AS (SELECT *, cand AND row_number() OVER (PARTITION BY doc_id, page, cand, isl ORDER BY line_no) % 2 = 1 AS joins FROM i),
t AS (SELECT *, coalesce(lag(joins) OVER (PARTITION BY doc_id, page ORDER BY line_no), false) AS taken FROM j)
SELECT doc_id, page, line_no, CASE WHEN joins THEN concat(left(text, length(text) - 1), nxt) ELSE text END AS text, joins FROM t WHERE NOT taken""")
def hyphen_repair(spark: SparkSession, d: str) -> DataFrame:
    return op.hyphen_pairs(geo(spark, d), PAGE).select(*PAGE, "line_no", "text", "joins")


REGIONS_SQL = "regions AS (SELECT doc_id, page, x0 - 3 AS x0, top - 4 AS top, x1 * 0.8 AS x1, bottom + 30 AS bottom FROM geo WHERE line_no = 2)"


@query(f"""WITH {GEO_SQL}, {REGIONS_SQL}, j AS (SELECT l.doc_id, l.page, l.line_no, greatest(least(l.x1, r.x1) - greatest(l.x0, r.x0), 0) * greatest(least(l.bottom, r.bottom) - greatest(l.top, r.top), 0) AS ov,
(l.x1 - l.x0) * (l.bottom - l.top) + (r.x1 - r.x0) * (r.bottom - r.top) AS sizes, (l.x0 + l.x1) / 2 BETWEEN r.x0 - 2 AND r.x1 + 2 AND (l.top + l.bottom) / 2 BETWEEN r.top - 2 AND r.bottom + 2 AS inside FROM geo l JOIN regions r USING (doc_id, page))
SELECT doc_id, page, line_no FROM geo g WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.doc_id = g.doc_id AND j.page = g.page AND j.line_no = g.line_no AND (inside OR (sizes - ov > 0 AND ov / (sizes - ov) >= 0.05)))""")
def bbox_overlap_suppress(spark: SparkSession, d: str) -> DataFrame:
    g = geo(spark, d)
    regions = g.filter("line_no = 2").select(*PAGE, (F.col("x0") - 3).alias("x0"), (F.col("top") - 4).alias("top"), (F.col("x1") * 0.8).alias("x1"), (F.col("bottom") + 30).alias("bottom"))
    return op.suppressed(g, regions, PAGE).select(*PAGE, "line_no")


@query(f"""WITH {GEO_SQL}, s AS (SELECT *, CASE WHEN x1 <= 125 THEN 1 WHEN x0 >= 80 THEN 2 ELSE 0 END AS side FROM (SELECT * REPLACE (CASE WHEN x0 >= 80 THEN x0 + 50 ELSE x0 END AS x0, CASE WHEN x0 >= 80 THEN x1 + 50 ELSE x1 END AS x1) FROM geo)),
c AS (SELECT *, CASE WHEN count(*) FILTER (x1 <= 125) OVER w >= 2 AND count(*) FILTER (x0 >= 125 AND x1 > 125) OVER w >= 2 THEN greatest(CASE WHEN x1 <= 125 THEN 1 WHEN x0 >= 125 THEN 2 ELSE 0 END, 1) ELSE 1 END AS col FROM s WINDOW w AS (PARTITION BY doc_id, page))
SELECT doc_id, page, line_no, CAST(col AS INT) AS "column", CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY col, top, x0, line_no) AS INT) AS position FROM c""")
def two_column_order(spark: SparkSession, d: str) -> DataFrame:
    wide = geo(spark, d)
    moved = F.col("x0") >= 80
    wide = wide.withColumns({"x0": F.when(moved, F.col("x0") + 50).otherwise(F.col("x0")), "x1": F.when(moved, F.col("x1") + 50).otherwise(F.col("x1"))})
    return op.reading_order(wide, PAGE, 250.0).select(*PAGE, "line_no", F.col("column").cast("int").alias("column"), "position")


@query(f"""WITH {GEO_SQL} SELECT doc_id, page, string_agg(text, chr(10) ORDER BY line_no) AS text FROM geo GROUP BY ALL""")
def page_text(spark: SparkSession, d: str) -> DataFrame:
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    return geo(spark, d).groupBy(*PAGE).agg(joined.alias("text"))


@query()
def captions_once(spark: SparkSession, d: str) -> DataFrame:
    return op.captions_once(geo(spark, d), ["doc_id"])
