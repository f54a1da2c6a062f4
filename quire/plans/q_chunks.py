"""Chunk assembly queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import char_tokens
from ..operators import chunks as op
from ..operators import tables as tab
from ..session import table
from .corpus_data import LINES_SQL, lines, rows, spec
from .q_tables import NAMED_SQL
from .registry import query

TURN_SQL = """turns AS (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS chunk_index, concat('chunk-', conv_id, '-', turn) AS chunk_id, role AS group_id, CASE turn % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'A > B' ELSE 'A > B > C' END AS section_path FROM conversations)"""


def turns(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    c = table(spark, d, "conversations")
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.select(F.col("conv_id").alias("doc_id"), n.alias("chunk_index"), F.concat(F.lit("chunk-"), "conv_id", F.lit("-"), "turn").alias("chunk_id"), F.col("role").alias("group_id"), F.expr("CASE turn % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'A > B' ELSE 'A > B > C' END").alias("section_path"))


@query(f"""WITH {TURN_SQL}, c AS (SELECT *, row_number() OVER g AS group_index, count(*) OVER (PARTITION BY doc_id, group_id) AS group_count, lag(chunk_id) OVER g AS previous_id, lead(chunk_id) OVER g AS next_id, row_number() OVER s AS section_index,
count(*) OVER (PARTITION BY doc_id, section_path) AS section_count, first_value(chunk_id) OVER s AS anchor, CASE section_path WHEN 'A > B' THEN 'A' WHEN 'A > B > C' THEN 'A > B' END AS parent_path FROM turns WINDOW g AS (PARTITION BY doc_id, group_id ORDER BY chunk_index), s AS (PARTITION BY doc_id, section_path ORDER BY chunk_index)),
p AS (SELECT doc_id, section_path AS parent_path, arg_min(chunk_id, chunk_index) AS parent_anchor_id FROM turns GROUP BY ALL)
SELECT c.doc_id, chunk_id, CAST(group_index AS INT) AS group_index, group_count, previous_id, next_id, CAST(section_index AS INT) AS section_index, section_count, nullif(anchor, chunk_id) AS anchor_id, c.parent_path, parent_anchor_id FROM c LEFT JOIN p ON c.doc_id = p.doc_id AND c.parent_path = p.parent_path""")
def chunk_neighbors(spark: SparkSession, d: str) -> DataFrame:
    r = op.relate(turns(spark, d))
    return r.select("doc_id", "chunk_id", "group_index", "group_count", "previous_id", "next_id", "section_index", "section_count", "anchor_id", "parent_path", "parent_anchor_id")


@query(f"""WITH {LINES_SQL}, x AS (SELECT doc_id, list(struct_pack(total := length(text), g := 0, gs := [0]) ORDER BY line_no) AS xs, list(line_no ORDER BY line_no) AS nos FROM lines GROUP BY doc_id),
f AS (SELECT doc_id, nos, list_reduce(xs, lambda a, b: struct_pack(total := CASE WHEN a.total + b.total > 800 THEN b.total ELSE a.total + b.total END, g := CASE WHEN a.total + b.total > 800 THEN a.g + 1 ELSE a.g END, gs := list_append(a.gs, CASE WHEN a.total + b.total > 800 THEN a.g + 1 ELSE a.g END))).gs AS gs FROM x)
SELECT doc_id, line_no, grp FROM (SELECT doc_id, unnest(nos) AS line_no, unnest(gs) AS grp FROM f)""")
def greedy_chunks(spark: SparkSession, d: str) -> DataFrame:
    return op.greedy_groups(lines(spark, d), ["doc_id"], "line_no", F.char_length("text"), 800).select("doc_id", "line_no", "grp")


@query()
def budget_split(spark: SparkSession, d: str) -> DataFrame:
    parts = op.split_chunks(table(spark, d, "documents").select("doc_id", "text"), "text", 512)
    return parts.select("doc_id", "part_index", "part_count", F.char_length("part").alias("n_chars"), char_tokens("part").alias("token_estimate"))


@query(f"""WITH {NAMED_SQL} SELECT row_id, coalesce(map {{'command_opcode': 96, 'command_dword_field': 94, 'command_pointer_field': 94, 'status_code': 90}}[unit_type], 88) AS priority,
concat(CASE WHEN trim(table_id) <> '' THEN concat('Table: ', table_id, chr(10)) ELSE '' END, 'Headers: ', array_to_string(headers, ' | '), chr(10), CASE WHEN unit_type IS NOT NULL THEN concat('Unit type: ', unit_type, chr(10)) ELSE '' END, CASE WHEN opcode IS NOT NULL THEN concat('Related command opcode: ', opcode, chr(10)) ELSE '' END, 'Text: ', row_text) AS embedding_text FROM typed""")
def context_text(spark: SparkSession, d: str) -> DataFrame:
    r = tab.typed_rows(rows(spark, d))
    text = op.context_text([("Table", F.col("table_id")), ("Headers", F.array_join("headers", " | ")), ("Unit type", F.col("unit_type")), ("Related command opcode", F.col("opcode"))], "row_text")
    return r.select("row_id", op.priority().alias("priority"), text.alias("embedding_text"))


@query(f"""WITH {NAMED_SQL.replace('tab AS', 'spec AS (SELECT p_partkey AS unit, p_name AS text FROM part), tab AS', 1)}, u AS (SELECT 0 AS source_rank, unit AS ord, text FROM spec UNION ALL SELECT 1, row_id, row_text FROM typed UNION ALL SELECT 2, doc_id, text FROM documents)
SELECT source_rank, ord, text, CAST((length(text) + 3) // 4 AS INT) AS token_estimate FROM u""")
def union_chunks(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "part").select(F.lit(0).alias("source_rank"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("text"))
    b = tab.typed_rows(rows(spark, d)).select(F.lit(1).alias("source_rank"), F.col("row_id").alias("ord"), F.col("row_text").alias("text"))
    c = table(spark, d, "documents").select(F.lit(2).alias("source_rank"), F.col("doc_id").alias("ord"), "text")
    return a.unionByName(b).unionByName(c).withColumn("token_estimate", char_tokens("text"))


@query("""WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos, event_type AS ref FROM events) SELECT user_id, array_to_string(list(ref ORDER BY p), ',') AS refs FROM (SELECT user_id, ref, min(pos) AS p FROM r GROUP BY ALL) GROUP BY user_id""")
def unique_refs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("refs"))
    return op.unique_refs(e, ["user_id"], "refs").select("user_id", F.array_join("refs", ",").alias("refs"))
