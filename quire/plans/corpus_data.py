"""Relations that the queries read: lines, blocks, sentences and table rows
derived from the driver's tables, each with the same rows as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import parts, table

# Sentences in the manner of a specification, one a part.
SENTENCES = [
    "concat('The controller shall return status ', p_size, ' when the ', p_name, ' is selected.')",
    "concat('The host shall not modify ', p_name, ' unless the device is idle.')",
    "concat('Firmware should report ', p_name, ' as specified in Table ', p_size, '.')",
    "concat('The device may support ', p_brand, ' except in Section ', p_size % 9 + 1, '.', p_size % 4 + 1, '.')",
    "concat('Unit ', p_partkey, ' means the part of type ', p_type, '.')",
    "concat('NOTE: see Section 3.', p_size, ' and Figure ', p_size % 7 + 1, ' for ', p_name, '.')",
    "concat('All rights reserved under the license of ', p_brand, '.')",
    "concat('REQ-', p_partkey, ' The unit must clear ', p_name, ' if power is lost; see Clauses 4.1, 4.2 and 5.', p_size % 5, '.')",
    "concat('Example: Log Identifier 0', p_size % 10, 'h returns data. Opcode 0x', p_size % 10, 'A is reserved.')",
    "concat('The limit may 2024 change. It can vary by ', p_type, '.')",
    "concat('WARNING: vendor ', p_brand, ' is required to verify ', p_name, ' per Requirement REQ-', p_partkey, '.')",
    "'Table of Contents'",
]
SPEC_SQL = f"""spec AS (SELECT p_partkey AS unit, CAST(p_partkey // 40 AS INT) AS page,
 CASE p_partkey % {len(SENTENCES)} {' '.join(f'WHEN {i} THEN {s}' for i, s in enumerate(SENTENCES))} END AS text FROM part)"""


def spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, page, text)"""
    case = " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(SENTENCES))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("unit"), F.expr("CAST(p_partkey div 40 AS INT)").alias("page"), F.expr(f"CASE p_partkey % {len(SENTENCES)} {case} END").alias("text"))


LINES_SQL = """lines AS (SELECT doc_id, CAST(i AS INT) AS line_no, string_split(text, chr(10))[i] AS text
 FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no from 1, text)"""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return d.select("doc_id", (F.col("i") + 1).alias("line_no"), "text")


# Geometry of page lines: an order is a page, its items are lines.
GEO_SQL = """geo AS (SELECT l_orderkey // 8 AS doc_id, CAST(l_orderkey % 8 AS INT) AS page, l_line AS line_no,
 CAST(l_line * 24 + l_partkey % 9 AS DOUBLE) AS top, CAST(l_line * 24 + l_partkey % 9 + 10 + l_suppkey % 5 AS DOUBLE) AS bottom,
 CAST(72 + (l_suppkey % 3) * 4 AS DOUBLE) AS x0, CAST(72 + (l_suppkey % 3) * 4 + 40 + l_quantity AS DOUBLE) AS x1,
 CASE WHEN l_quantity >= 45 THEN 16.0 WHEN l_quantity >= 30 THEN 11.0 ELSE 9.5 END::DOUBLE AS font_size,
 CASE WHEN l_line = 1 THEN concat('Chapter ', l_orderkey // 8 % 3, ' draft') WHEN l_partkey % 7 = 0 THEN concat('- item ', l_partkey) WHEN l_partkey % 7 = 1 THEN concat(l_line, '.', l_suppkey % 4 + 1, ' Title ', l_suppkey)
 WHEN l_partkey % 7 = 2 THEN concat('Table ', l_suppkey % 9, ': ', l_returnflag) WHEN l_partkey % 7 = 3 THEN concat('word', l_suppkey, '-') ELSE concat('plain text ', l_partkey, CASE WHEN l_partkey % 2 = 0 THEN '.' ELSE '' END) END AS text
 FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS l_line FROM lineitem))"""


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, line_no, top, bottom, x0, x1, font_size, text), hashed by
    (doc_id, page): windows over pages need no further shuffle."""
    li = table(spark, sf_dir, "lineitem")
    paged = li.select(F.expr("l_orderkey div 8").alias("doc_id"), F.expr("CAST(l_orderkey % 8 AS INT)").alias("page"), *[c for c in li.columns if c.startswith("l_")]).repartition(parts(li), "doc_id", "page")
    sql = GEO_SQL[GEO_SQL.index("SELECT") : -1].replace("//", "div").replace("END::DOUBLE", "END").replace("16.0", "16.0D").replace("11.0", "11.0D").replace("9.5", "9.5D").replace("FROM lineitem", "FROM {paged}")
    sql = sql.replace("l_orderkey div 8 AS doc_id, CAST(l_orderkey % 8 AS INT) AS page", "doc_id, page").replace("PARTITION BY l_orderkey", "PARTITION BY doc_id, page")  # the same groups
    return spark.sql(sql, paged=paged)


# Table rows: ten kinds of header sets.
KINDS = [
    (("Command", "Opcode", "Description"), ("p_name", "concat('0', p_size % 10, 'h')", "concat('Admin command for ', p_type)")),
    (("Log Identifier", "Description"), ("concat('0', p_size % 10, 'h')", "p_type")),
    (("Feature Identifier", "Description"), ("concat('0x', p_size % 10)", "p_name")),
    (("Status Code Type", "Status Code", "Description"), ("CASE p_size % 4 WHEN 0 THEN 'Generic' WHEN 1 THEN '1h' WHEN 2 THEN 'Media and Data Integrity' ELSE 'Vendor' END", "concat('0', p_size % 3, 'h')", "CASE p_size % 5 WHEN 0 THEN 'Successful completion' WHEN 1 THEN 'Command aborted; retry' WHEN 2 THEN 'Invalid LBA range' WHEN 3 THEN 'Time out, do not retry' ELSE 'Guard check' END")),
    (("Field", "Bits", "Description"), ("p_brand", "concat(p_size % 32, ':', p_size % 8)", "p_type")),
    (("Register", "Offset", "Field"), ("p_brand", "concat(p_size, 'h')", "p_name")),
    (("Value", "Meaning"), ("CAST(p_size AS STRING)", "p_type")),
    (("Command Dword", "Field", "Description"), ("concat('Dword ', p_size % 16)", "p_name", "'I/O data pointer'")),
    (("Method", "UID"), ("p_name", "concat('00', p_size % 10)")),
    (("Requirement ID", "Description"), ("concat('REQ-', p_partkey)", "''")),
]


def _cells(values: tuple[str, ...]) -> str:
    return ", ".join(values)


ROWS_SQL = f"""tab AS (SELECT p_partkey AS row_id, concat('table-', p_partkey % 10, '-', p_partkey // 60) AS table_id, CAST(p_partkey // 60 AS INT) AS page,
 CAST(p_partkey % 60 AS INT) AS row_index, CASE p_partkey % 10 {' '.join(f"WHEN {i} THEN [{', '.join(repr(h) for h in hs)}]" for i, (hs, _) in enumerate(KINDS))} END AS headers,
 CASE p_partkey % 10 {' '.join(f"WHEN {i} THEN [{_cells(v)}]" for i, (_, v) in enumerate(KINDS))} END AS vals FROM part)""".replace("AS STRING", "AS VARCHAR")


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, table_id, page, row_index, headers, cells)"""
    heads = " ".join(f"WHEN {i} THEN array({', '.join(repr(h) for h in hs)})" for i, (hs, _) in enumerate(KINDS))
    values = " ".join(f"WHEN {i} THEN array({_cells(v)})" for i, (_, v) in enumerate(KINDS))
    return (
        table(spark, sf_dir, "part")
        .selectExpr("p_partkey AS row_id", "concat('table-', p_partkey % 10, '-', p_partkey div 60) AS table_id", "CAST(p_partkey div 60 AS INT) AS page", "CAST(p_partkey % 60 AS INT) AS row_index", f"CASE p_partkey % 10 {heads} END AS headers", f"CASE p_partkey % 10 {values} END AS vals")
        .withColumn("cells", F.map_from_arrays("headers", "vals"))
    )


def sql_cell(*names: str) -> str:
    """The first non-blank cell among header aliases, for relation tab."""
    import re

    keys = [re.sub("[^a-z0-9]+", "", n.lower()) for n in names]
    pick = "list_position(list_transform(headers, lambda h: regexp_replace(lower(h), '[^a-z0-9]+', '', 'g')), '{}')"
    return "coalesce(" + ", ".join(f"nullif(trim(vals[{pick.format(k)}]), '')" for k in keys) + ")"
