"""Corpus queries: two snapshots of the documents, windows of order pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus as op
from ..session import table
from .corpus_data import GEO_SQL, SPEC_SQL, geo, spec
from .registry import query

SNAP_SQL = """prev AS (SELECT doc_id, sha256(text) AS sha FROM documents WHERE doc_id % 10 <> 3), cur AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN concat(text, '!') ELSE text END) AS sha FROM documents WHERE doc_id % 11 <> 5)"""


def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return docs.filter("doc_id % 10 <> 3").select("doc_id", F.sha2("text", 256).alias("sha")), docs.filter("doc_id % 11 <> 5").select("doc_id", F.sha2(changed, 256).alias("sha"))


@query(f"""WITH {SNAP_SQL} SELECT doc_id, CASE WHEN p.sha IS NULL THEN 'added' WHEN c.sha IS NULL THEN 'removed' WHEN p.sha = c.sha THEN 'unchanged' ELSE 'changed' END AS status, p.sha AS previous_sha, c.sha AS current_sha FROM prev p FULL JOIN cur c USING (doc_id)""")
def corpus_diff(spark: SparkSession, d: str) -> DataFrame:
    return op.diff(*snapshots(spark, d))


@query(f"WITH {SNAP_SQL} SELECT doc_id, sha FROM cur c WHERE NOT EXISTS (SELECT 1 FROM prev p WHERE p.doc_id = c.doc_id AND p.sha = c.sha AND p.doc_id % 13 <> 1)")
def reuse_unchanged(spark: SparkSession, d: str) -> DataFrame:
    prev, cur = snapshots(spark, d)
    return op.to_convert(cur, prev, prev.filter("doc_id % 13 <> 1"))


@query("SELECT * FROM (SELECT lower(regexp_replace(c_name, '[0-9]$', '')) AS stem, count(*) AS n, list_sort(list(DISTINCT c_name)) AS names FROM (SELECT concat(CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END, '-', c_nationkey, '.pdf') AS c_name FROM customer) GROUP BY 1) WHERE n > 1".replace("regexp_replace(c_name, '[0-9]$', '')", "regexp_replace(c_name, '[.][^.]*$', '')"))
def duplicate_stems(spark: SparkSession, d: str) -> DataFrame:
    segment = F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment"))
    return op.duplicate_stems(table(spark, d, "customer").select(F.concat(segment, F.lit("-"), "c_nationkey", F.lit(".pdf")).alias("name")))


REQ_SQL = f"""{SPEC_SQL}, a AS (SELECT unit, page, unit % 9 AS doc_id, concat('req-', unit % 300) AS requirement_key, text, CASE unit % 3 WHEN 0 THEN 'required' WHEN 1 THEN 'optional' END AS strength FROM spec),
b AS (SELECT unit, page, doc_id, requirement_key, CASE WHEN unit % 5 = 0 THEN concat(text, ' revised') ELSE text END AS text, CASE WHEN unit % 8 = 0 THEN 'prohibited' ELSE strength END AS strength FROM a WHERE unit % 300 <> 17),
ga AS (SELECT doc_id, requirement_key, list(text ORDER BY o) FILTER (t1) AS text, list(strength ORDER BY so) FILTER (strength IS NOT NULL AND s1) AS strength FROM (SELECT *, unit AS o, unit AS so, row_number() OVER (PARTITION BY doc_id, requirement_key, strength ORDER BY unit) = 1 AS s1, row_number() OVER (PARTITION BY doc_id, requirement_key, text ORDER BY unit) = 1 AS t1 FROM a WHERE unit % 300 <> 23) GROUP BY ALL),
gb AS (SELECT doc_id, requirement_key, list(text ORDER BY o) FILTER (t1) AS text, list(strength ORDER BY so) FILTER (strength IS NOT NULL AND s1) AS strength FROM (SELECT *, unit AS o, unit AS so, row_number() OVER (PARTITION BY doc_id, requirement_key, strength ORDER BY unit) = 1 AS s1, row_number() OVER (PARTITION BY doc_id, requirement_key, text ORDER BY unit) = 1 AS t1 FROM b) GROUP BY ALL)"""


@query(f"""WITH {REQ_SQL}, j AS (SELECT doc_id, requirement_key, ga.doc_id IS NULL AS np, gb.doc_id IS NULL AS nc, len(coalesce(ga.text, [])) AS previous_texts, len(coalesce(gb.text, [])) AS current_texts,
list_filter([CASE WHEN coalesce(ga.text, []) IS DISTINCT FROM coalesce(gb.text, []) THEN 'text' END, CASE WHEN coalesce(ga.strength, []) IS DISTINCT FROM coalesce(gb.strength, []) OR (ga.doc_id IS NULL) <> (gb.doc_id IS NULL) THEN 'strength' END], lambda x: x IS NOT NULL) AS changed FROM ga FULL JOIN gb USING (doc_id, requirement_key)),
s AS (SELECT *, CASE WHEN np THEN 'added' WHEN nc THEN 'removed' WHEN len(changed) > 0 THEN 'changed' ELSE 'unchanged' END AS status FROM j)
SELECT doc_id, requirement_key, status, CASE WHEN status = 'added' THEN 'review_new_requirement' WHEN status = 'removed' THEN 'confirm_removal' WHEN list_contains(changed, 'strength') THEN 'reassess_compliance' WHEN list_contains(changed, 'text') THEN 'review_text_change' ELSE 'check_references' END AS recommendation,
array_to_string(changed, ',') AS changed_fields, CAST(previous_texts AS INT) AS previous_texts, CAST(current_texts AS INT) AS current_texts FROM s WHERE status <> 'unchanged'""")
def requirement_impact(spark: SparkSession, d: str) -> DataFrame:
    s = spec(spark, d)
    a = s.select("unit", "page", (F.col("unit") % 9).alias("doc_id"), F.concat(F.lit("req-"), F.col("unit") % 300).alias("requirement_key"), "text", F.expr("CASE unit % 3 WHEN 0 THEN 'required' WHEN 1 THEN 'optional' END").alias("strength"))
    b = a.filter("unit % 300 <> 17").withColumns({"text": F.when(F.col("unit") % 5 == 0, F.concat("text", F.lit(" revised"))).otherwise(F.col("text")), "strength": F.when(F.col("unit") % 8 == 0, "prohibited").otherwise(F.col("strength"))})
    keys = ["doc_id", "requirement_key"]
    grouped = lambda x: x.groupBy(*keys).agg(op.ordered_distinct("text", "unit").alias("text"), op.ordered_distinct("strength", "unit").alias("strength"))
    i = op.impact(grouped(a.filter("unit % 300 <> 23")), grouped(b), keys, ["text", "strength"])
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    return i.select(*keys, "status", op.recommendation().alias("recommendation"), F.array_join("changed_fields", ",").alias("changed_fields"), F.greatest(n("previous_text"), F.lit(0)).alias("previous_texts"), F.greatest(n("current_text"), F.lit(0)).alias("current_texts"))


@query(f"""WITH {GEO_SQL}, p AS (SELECT DISTINCT doc_id // 100 AS book, doc_id % 100 * 8 + page AS page FROM geo), w AS (SELECT *, (row_number() OVER (PARTITION BY book ORDER BY page) - 1) // 25 + 1 AS window_no FROM p)
SELECT book, window_no, min(page) AS first_page, max(page) AS last_page, count(*) AS n_pages, format('pages-{{:04d}}-{{:04d}}', min(page), max(page)) AS window_id FROM w GROUP BY book, window_no""")
def page_windows(spark: SparkSession, d: str) -> DataFrame:
    return op.page_windows(books(spark, d), ["book"], 25)


def books(spark: SparkSession, d: str) -> DataFrame:
    return geo(spark, d).select(F.expr("doc_id div 100").alias("book"), (F.col("doc_id") % 100 * 8 + F.col("page")).alias("page"))


@query(f"""WITH {GEO_SQL}, p AS (SELECT DISTINCT doc_id // 100 AS book, doc_id % 100 * 8 + page AS page FROM geo), i AS (SELECT *, page - row_number() OVER (PARTITION BY book ORDER BY page) AS isl FROM p),
r AS (SELECT book, min(page) AS a, max(page) AS b FROM i GROUP BY book, isl) SELECT book, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE concat(a, '-', b) END, ',' ORDER BY a) AS ranges FROM r GROUP BY book""")
def page_ranges(spark: SparkSession, d: str) -> DataFrame:
    return op.page_ranges(books(spark, d), ["book"])


WINDOW_SQL = """rec AS (SELECT o_custkey % 50 AS doc_id, concat('w', o_orderkey % 4) AS window_id, concat('block-', o_orderkey % 97) AS record_id, o_orderkey FROM orders),
ids AS (SELECT *, CASE WHEN n > 1 THEN concat(window_id, '__', record_id) ELSE record_id END AS new_id FROM rec JOIN (SELECT doc_id, record_id, count(DISTINCT window_id) AS n FROM rec GROUP BY ALL) USING (doc_id, record_id))"""


def window_records(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select((F.col("o_custkey") % 50).alias("doc_id"), F.concat(F.lit("w"), F.col("o_orderkey") % 4).alias("window_id"), F.concat(F.lit("block-"), F.col("o_orderkey") % 97).alias("record_id"), "o_orderkey")


@query(f"WITH {WINDOW_SQL} SELECT doc_id, window_id, record_id, o_orderkey, new_id FROM ids")
def window_collisions(spark: SparkSession, d: str) -> DataFrame:
    return op.scoped_ids(window_records(spark, d), ["doc_id"], "record_id", "window_id")


@query(f"""WITH {WINDOW_SQL}, refs AS (SELECT doc_id, window_id, concat('block-', o_orderkey % 120) AS target, o_orderkey FROM rec)
SELECT r.doc_id, r.window_id, r.target, r.o_orderkey, i.new_id AS new_target FROM refs r JOIN (SELECT DISTINCT doc_id, window_id, record_id, new_id FROM ids) i ON r.doc_id = i.doc_id AND r.window_id = i.window_id AND r.target = i.record_id""")
def window_references(spark: SparkSession, d: str) -> DataFrame:
    rec = window_records(spark, d)
    refs = rec.select("doc_id", "window_id", F.concat(F.lit("block-"), F.col("o_orderkey") % 120).alias("target"), "o_orderkey")
    return op.rewrite_refs(refs, op.scoped_ids(rec, ["doc_id"], "record_id", "window_id"), ["doc_id"], "window_id", "record_id")


@query("""SELECT file, window_id, count(*) AS n_rows, sum(size) AS bytes FROM (SELECT o_orderpriority AS file, concat('w', o_orderkey % 4) AS window_id, length(o_orderpriority) + o_orderkey % 100 AS size FROM orders) GROUP BY GROUPING SETS ((file), (window_id), ())""")
def sidecar_inventory(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("file"), F.concat(F.lit("w"), F.col("o_orderkey") % 4).alias("window_id"), (F.char_length("o_orderpriority") + F.col("o_orderkey") % 100).alias("size"))
    return op.inventory(o, "file", "window_id", "size")


@query(f"""WITH {GEO_SQL}, r AS (SELECT doc_id, CASE WHEN line_no % 5 <> 0 THEN page END AS page, CASE WHEN line_no % 3 <> 0 THEN top END AS top, page % 2 AS window_no, line_no, concat('r', doc_id, '-', page, '-', line_no) AS record_id FROM geo)
SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(page, 0), coalesce(top, 1e6), window_no, line_no, record_id) AS INT) AS position FROM r""")
def merge_sort_order(spark: SparkSession, d: str) -> DataFrame:
    g = geo(spark, d)
    r = g.select("doc_id", F.when(F.col("line_no") % 5 != 0, F.col("page")).alias("page"), F.when(F.col("line_no") % 3 != 0, F.col("top")).alias("top"), (F.col("page") % 2).alias("window_no"), "line_no", F.concat(F.lit("r"), "doc_id", F.lit("-"), "page", F.lit("-"), "line_no").alias("record_id"))
    return op.merge_order(r)


@query("""SELECT user_id, min(epoch_us(ts) // 1000000) AS started, max(epoch_us(ts) // 1000000) AS finished, sum(CAST(floor(value) AS BIGINT)) AS duration_ms,
CASE WHEN bool_or(event_type = 'error') THEN 'failed' WHEN bool_or(event_type = 'click') THEN 'partial' ELSE 'success' END AS status, bool_or(value > 50) AS used_ocr, count(*) AS n_windows FROM events GROUP BY user_id""")
def merged_report(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "partial").otherwise("success")
    return op.merged_report(e.select("user_id", seconds.alias("started"), seconds.alias("finished"), F.floor("value").alias("duration_ms"), status.alias("status"), (F.col("value") > 50).alias("used_ocr")), ["user_id"])


@query("""SELECT o_custkey, array_to_string(list_sort(list(DISTINCT to_json({a: o_orderstatus, b: o_orderpriority}))), ';') AS parts FROM orders GROUP BY 1""")
def dedupe_json(spark: SparkSession, d: str) -> DataFrame:
    j = F.to_json(F.struct(F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b")))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set(j)), ";").alias("parts"))
