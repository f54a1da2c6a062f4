"""Layout, figure and OCR queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import FIGURE_KIND
from ..operators import layout as op
from ..operators import lines as ln
from ..session import table
from .corpus_data import GEO_SQL, geo
from .q_lines import PAGE, TYPED_SQL
from .registry import query, sql_case

HEAD_SQL = """heads AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, CAST(o_orderkey % 3 + 1 AS INT) AS level, concat('H', o_orderkey) AS text FROM orders)"""


def heads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("level"), F.concat(F.lit("H"), "o_orderkey").alias("text"))


@query(f"""WITH RECURSIVE {HEAD_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM heads),
p AS (SELECT doc_id, ord, i, [text] AS path FROM n WHERE i = 1 UNION ALL SELECT n.doc_id, n.ord, n.i, list_concat(p.path[:n.level - 1], [n.text]) FROM p JOIN n ON n.doc_id = p.doc_id AND n.i = p.i + 1)
SELECT doc_id, ord, array_to_string(path, ' > ') AS path FROM p""")
def heading_paths(spark: SparkSession, d: str) -> DataFrame:
    return op.heading_paths(heads(spark, d), ["doc_id"], "ord")


@query(f"""WITH {HEAD_SQL} SELECT doc_id, ord, level, (SELECT max(b.ord) FROM heads b WHERE b.doc_id = a.doc_id AND b.ord < a.ord AND b.level < a.level AND NOT EXISTS (SELECT 1 FROM heads c WHERE c.doc_id = a.doc_id AND c.ord > b.ord AND c.ord < a.ord AND c.level < b.level)
 AND b.level = (SELECT max(e.level) FROM heads e WHERE e.doc_id = a.doc_id AND e.ord < a.ord AND e.level < a.level AND NOT EXISTS (SELECT 1 FROM heads c WHERE c.doc_id = a.doc_id AND c.ord > e.ord AND c.ord < a.ord AND c.level < e.level))) AS parent FROM heads a""")
def parent_headings(spark: SparkSession, d: str) -> DataFrame:
    return op.parent_headings(heads(spark, d).drop("text"), ["doc_id"], "ord")


@query("""WITH l AS (SELECT o_custkey AS k, o_orderkey AS id, epoch_us(o_orderdate) AS t FROM orders WHERE o_orderkey % 3 = 0), r AS (SELECT o_custkey AS k, epoch_us(o_orderdate) AS t, max(o_orderkey) AS v FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY ALL)
SELECT k, id, t, coalesce((SELECT arg_max(v, r.t) FROM r WHERE r.k = l.k AND r.t <= l.t), (SELECT arg_min(v, r.t) FROM r WHERE r.k = l.k)) AS v FROM l""")
def asof_heading(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("t"))
    right = o.filter("id % 3 <> 0").groupBy("k", "t").agg(F.max("id").alias("v"))
    return op.as_of(o.filter("id % 3 = 0"), right, ["k"], "t", "v")


BOX_SQL = "boxes AS (SELECT doc_id, page, line_no AS box_id, x0, top, x1, bottom FROM geo WHERE line_no % 2 = 0), caps AS (SELECT doc_id, page, line_no, x0, top, x1, bottom FROM geo WHERE line_no % 3 = 1)"


def boxes(spark: SparkSession, d: str) -> DataFrame:
    return geo(spark, d).filter("line_no % 2 = 0").select(*PAGE, F.col("line_no").alias("box_id"), "x0", "top", "x1", "bottom")


@query(f"""WITH {GEO_SQL}, {BOX_SQL}, j AS (SELECT b.doc_id, b.page, b.box_id, c.line_no AS caption_line, CASE WHEN b.top - c.bottom BETWEEN 0 AND 48 THEN b.top - c.bottom WHEN c.top - b.bottom BETWEEN 0 AND 24 THEN c.top - b.bottom + 12 END AS distance
FROM boxes b JOIN caps c USING (doc_id, page) WHERE greatest(least(b.x1, c.x1) - greatest(b.x0, c.x0), 0) / least(b.x1 - b.x0, c.x1 - c.x0) >= 0.25)
SELECT doc_id, page, box_id, caption_line, distance FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, box_id ORDER BY distance, caption_line) AS nth FROM j WHERE distance IS NOT NULL) WHERE nth = 1""")
def caption_link(spark: SparkSession, d: str) -> DataFrame:
    return op.nearest_captions(boxes(spark, d), geo(spark, d).filter("line_no % 3 = 1"), PAGE)


@query(f"""WITH {GEO_SQL}, {BOX_SQL} SELECT b.doc_id, b.page, b.box_id, CAST(coalesce(min(g.line_no) FILTER (g.top >= b.top), count(*) + 1) AS BIGINT) AS anchor FROM boxes b JOIN geo g USING (doc_id, page) GROUP BY b.doc_id, b.page, b.box_id""")
def block_anchors(spark: SparkSession, d: str) -> DataFrame:
    return op.anchors(boxes(spark, d), geo(spark, d).withColumn("position", F.col("line_no")), PAGE)


@query(f"""WITH {GEO_SQL}, {TYPED_SQL} SELECT doc_id, page, count(*) AS n_lines, count(*) FILTER (line_type = 'heading_index') AS n_heading_index, count(*) FILTER (line_type = 'list_item') AS n_list_item, count(*) FILTER (line_type = 'table_caption') AS n_table_caption, count(*) FILTER (line_type = 'body_line') AS n_body_line,
min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom FROM typed GROUP BY ALL""")
def page_layout(spark: SparkSession, d: str) -> DataFrame:
    return op.page_layout(ln.typed(geo(spark, d)), PAGE)


FIG_SQL = "figs AS (SELECT p_partkey AS id, concat(CASE p_partkey % 7 WHEN 0 THEN 'Block Diagram of ' WHEN 1 THEN 'Register map, ' WHEN 2 THEN 'State machine: ' WHEN 3 THEN 'Timing diagram ' WHEN 4 THEN 'flow of ' WHEN 5 THEN 'matrix ' ELSE '' END, p_name) AS caption FROM part)"


@query(f"WITH {FIG_SQL} SELECT id, {sql_case(FIGURE_KIND, 'image', t='lower(caption)')} AS kind FROM figs")
def figure_kinds(spark: SparkSession, d: str) -> DataFrame:
    sql = FIG_SQL[FIG_SQL.index("SELECT") : -1].replace("FROM part", "FROM {part}")
    return spark.sql(sql, part=table(spark, d, "part")).select("id", op.figure_kind("caption").alias("kind"))


@query("""WITH i AS (SELECT l_orderkey AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS idx, md5(CAST(l_partkey % 500 AS VARCHAR)) AS sha, CAST(l_quantity AS INT) AS width, CAST(l_suppkey % 20 + 5 AS INT) AS height, l_returnflag = 'A' AS captioned FROM lineitem),
n AS (SELECT *, concat(page, '-', idx) AS path, count(*) OVER (PARTITION BY sha) AS frequency, first_value(concat(page, '-', idx)) OVER (PARTITION BY sha ORDER BY page, idx) AS canonical FROM i)
SELECT page, idx, frequency, canonical, ((height <= 8 OR width <= 16) AND NOT captioned) OR ((height <= 10 OR width <= 20) AND frequency >= 2 AND NOT captioned) AS decorative FROM n""")
def image_dedupe(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    li = table(spark, d, "lineitem")
    idx = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    i = li.select(F.col("l_orderkey").alias("page"), idx.alias("idx"), F.md5((F.col("l_partkey") % 500).cast("string")).alias("sha"), F.col("l_quantity").cast("int").alias("width"), (F.col("l_suppkey") % 20 + 5).cast("int").alias("height"), (F.col("l_returnflag") == "A").alias("captioned"))
    return op.deduplicated_images(i.withColumn("path", F.concat_ws("-", "page", "idx")), ["page", "idx"]).select("page", "idx", "frequency", "canonical", "decorative")


@query("""SELECT user_id, round(avg(value), 4) AS mean, median(value) AS median, round(avg(CASE WHEN value < 60 THEN 1 ELSE 0 END), 4) AS low_ratio FROM events WHERE value >= 0 GROUP BY 1""")
def ocr_metrics(spark: SparkSession, d: str) -> DataFrame:
    return op.ocr_metrics(table(spark, d, "events").select("user_id", F.col("value").alias("confidence")), ["user_id"])


@query("""WITH v AS (SELECT user_id, event_type AS text, count(*) AS votes, round(avg(value), 6) AS confidence FROM events GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, confidence DESC, text) AS INT) AS rank FROM v""")
def marker_votes(spark: SparkSession, d: str) -> DataFrame:
    return op.votes(table(spark, d, "events").select("user_id", F.col("event_type").alias("text"), F.col("value").alias("confidence")), ["user_id"])


@query("""WITH m AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderkey FROM orders), n AS (SELECT k, i, CASE WHEN o_orderkey % 3 <> 1 THEN i END AS marker FROM m),
w AS (SELECT *, last_value(marker IGNORE NULLS) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, first_value(marker IGNORE NULLS) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS x FROM n)
SELECT k, CAST(i AS INT) AS i, CAST(marker AS INT) AS marker, CAST(coalesce(marker, CASE WHEN x - p = 2 THEN p + 1 END, p + 1) AS INT) AS recovered, CASE WHEN marker IS NOT NULL THEN 'exact' WHEN x - p = 2 THEN 'sibling_midpoint' WHEN p IS NOT NULL THEN 'previous_plus_one' ELSE 'no_candidate' END AS reason FROM w""")
def marker_recovery(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    m = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), i.alias("i"), "o_orderkey")
    return op.siblings(m.select("k", "i", F.when(F.col("o_orderkey") % 3 != 1, F.col("i")).alias("marker")), ["k"], "i")


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'runtime_unavailable' WHEN event_id % 7 = 0 THEN 'not_attempted' WHEN event_id % 5 = 0 THEN 'rejected_empty' WHEN event_id % 13 = 0 THEN 'rejected_missing_confidence' WHEN value / 100 < 0.65 THEN 'rejected_low_confidence' ELSE 'accepted' END AS status FROM events""")
def ocr_evidence(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 11 != 0).alias("available"), (F.col("event_id") % 7 != 0).alias("attempted"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("text"), F.when(F.col("event_id") % 13 != 0, F.col("value") / 100).alias("confidence"))
    return e.select("event_id", op.ocr_status("available", "attempted", "text", "confidence").alias("status"))
