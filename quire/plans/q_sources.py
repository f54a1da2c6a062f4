"""Queries over sources and event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.pages import html_blocks as blocks
from ..session import table
from ..streaming.ingest import progress
from .registry import query


_ELEMENTS = "|".join(f"<{t}[^>]*>.*?</{t}>" for t in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li"))


@query(f"""WITH x AS (SELECT page_id, regexp_extract_all(html, '(?is){_ELEMENTS}') AS ms FROM pages), m AS (SELECT page_id, CAST(i AS INT) AS block_no, ms[i] AS m FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM x)),
t AS (SELECT page_id, block_no, CASE lower(m[2:2]) WHEN 'h' THEN 'heading' WHEN 'p' THEN 'paragraph' ELSE 'list' END AS kind, trim(regexp_replace(regexp_replace(m, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM m)
SELECT * FROM t WHERE text <> ''""")
def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocks(table(spark, d, "pages")).select("page_id", "block_no", "kind", "text")


@query("""SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL""")
def event_progress(spark: SparkSession, d: str) -> DataFrame:
    return progress(table(spark, d, "events"))
