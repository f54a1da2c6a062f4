"""Retrieval queries over line-group chunks of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import char_tokens
from ..operators import retrieval as r
from ..session import table
from .corpus_data import LINES_SQL, lines
from .registry import query

GROUP = 4
CHUNKS_SQL = f"""{LINES_SQL},
chunks AS (SELECT doc_id * 100000 + (line_no - 1) // {GROUP} AS chunk_id, doc_id, string_agg(text, chr(10) ORDER BY line_no) AS text, doc_id % 7 AS priority FROM lines GROUP BY doc_id, (line_no - 1) // {GROUP})"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """(chunk_id, doc_id, text, priority): groups of GROUP lines."""
    grouped = lines(spark, d).groupBy("doc_id", F.floor((F.col("line_no") - 1) / GROUP).alias("g")).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]).alias("t"))
    return grouped.select((F.col("doc_id") * 100000 + F.col("g")).alias("chunk_id"), "doc_id", F.array_join("t", "\n").alias("text"), (F.col("doc_id") % 7).alias("priority"))


TOP_SQL = f"""{CHUNKS_SQL},
ct AS (SELECT chunk_id, priority, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS tok FROM chunks),
qt AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS token FROM benchmark),
hits AS (SELECT item_id AS query_id, chunk_id, n_tok, priority, count(*) AS shared FROM (SELECT chunk_id, priority, len(tok) AS n_tok, unnest(tok) AS token FROM ct) JOIN qt USING (token) GROUP BY ALL),
ranked AS (SELECT *, shared + shared / n_tok + priority / 1000.0::DOUBLE AS s, row_number() OVER (PARTITION BY query_id ORDER BY shared + shared / n_tok + priority / 1000.0::DOUBLE DESC, chunk_id) AS rank FROM hits),
top AS (SELECT query_id, chunk_id, CAST(rank AS INT) AS rank, round(s, 6) AS score FROM ranked WHERE rank <= 5)"""


def top(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return r.retrieve(chunks(spark, d), q)


@query(f"WITH {TOP_SQL} SELECT * FROM top")
def retrieve_topk(spark: SparkSession, d: str) -> DataFrame:
    return top(spark, d)


@query(f"""WITH {TOP_SQL}, found AS (SELECT query_id, chunk_id // 100000 AS source_id, min(rank) AS rank FROM top GROUP BY ALL),
rel AS (SELECT query_id, source_id FROM found JOIN labels ON doc_id = source_id WHERE quality = 1 UNION SELECT item_id, item_id * 5 FROM benchmark),
per AS (SELECT item_id, (SELECT count(*) FROM rel WHERE query_id = item_id) AS expected, (SELECT min(rank) FROM found JOIN rel USING (query_id, source_id) WHERE query_id = item_id) AS first,
 (SELECT count(*) FROM found JOIN rel USING (query_id, source_id) WHERE query_id = item_id) AS covered FROM benchmark)
SELECT count(*) AS query_count, round(avg(CASE WHEN first IS NOT NULL THEN 1 ELSE 0 END), 4) AS hit_at_k, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(sum(covered) / sum(expected), 4) AS coverage FROM per""")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    found = top(spark, d).groupBy("query_id", F.floor(F.col("chunk_id") / 100000).alias("source_id")).agg(F.min("rank").alias("rank"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    good = table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("source_id"))
    relevant = found.join(good, "source_id").select("query_id", "source_id").union(items.select("query_id", F.col("query_id") * 5)).distinct()
    return r.query_metrics(found, relevant, items)


METRIC_SQL = f"""{CHUNKS_SQL}, sized AS (SELECT CAST((length(text) + 3) // 4 AS INT) AS tok, md5(text) AS source_key FROM chunks),
m AS (SELECT count(*) AS chunk_count, max(tok) AS token_max, round(avg(tok), 2) AS token_avg, count(*) FILTER (tok > 128) AS over_target, round(avg(CASE WHEN tok <= 128 THEN 1 ELSE 0 END), 4) AS compliance,
 count(source_key) - count(DISTINCT source_key) AS duplicate_sources, round((count(source_key) - count(DISTINCT source_key)) / count(source_key), 4) AS duplicate_ratio,
 list_sort(list(tok))[CAST(round_even((count(*) - 1) * 0.95, 0) AS BIGINT) + 1] AS token_p95 FROM sized)"""


def metrics(spark: SparkSession, d: str) -> DataFrame:
    return r.chunk_metrics(chunks(spark, d).select(char_tokens("text").alias("token_estimate"), F.md5("text").alias("source_key")), 128)


@query(f"WITH {METRIC_SQL} SELECT * FROM m")
def intrinsic_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics(spark, d)


@query(f"""WITH {METRIC_SQL}, long AS (SELECT * FROM (VALUES ('token_max', (SELECT token_max::DOUBLE FROM m)), ('compliance', (SELECT compliance FROM m)), ('duplicate_ratio', (SELECT duplicate_ratio FROM m)), ('token_p95', (SELECT token_p95::DOUBLE FROM m))) v(metric, current)),
t AS (SELECT * FROM (VALUES ('token_max', 'max', 50.0), ('compliance', 'min', 0.2), ('duplicate_ratio', 'max', 0.0), ('token_p95', 'min', 1.0), ('mystery', 'min', 1.0)) v(metric, direction, bound))
SELECT metric, direction, bound::DOUBLE AS bound, current, CASE WHEN current IS NULL THEN 'missing_metric' ELSE 'threshold' END AS reason FROM t LEFT JOIN long USING (metric)
WHERE current IS NULL OR (direction = 'min' AND current < bound) OR (direction = 'max' AND current > bound)""")
def calibration_gate(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.createDataFrame([("token_max", "max", 50.0), ("compliance", "min", 0.2), ("duplicate_ratio", "max", 0.0), ("token_p95", "min", 1.0), ("mystery", "min", 1.0)], "metric string, direction string, bound double")
    return r.calibrate(metrics(spark, d), wanted)
