"""Queries of technical row types, over rows of two dozen header sets."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import technical as op
from ..session import table
from .corpus_data import sql_cell
from .registry import query, sql_case

KINDS = [
    (("Command Name", "Combined Opcode"), ("p_name", "concat('0', p_size, 'h')")), (("Opcode", "Meaning"), ("'02h'", "p_type")), (("Message", "Message Code"), ("p_name", "'0x81'")), (("Request", "Response"), ("p_name", "p_type")),
    (("Measurement Index", "Type"), ("CAST(p_size AS STRING)", "p_type")), (("Certificate Slot", "Description"), ("CAST(p_size AS STRING)", "p_name")), (("Base Asym Algo", "Algorithm"), ("''", "p_name")), (("Key Exchange", "Type"), ("p_name", "p_type")),
    (("Method ID", "Note"), ("p_name", "''")), (("SP", "UID"), ("p_name", "p_brand")), (("Range", "Bits"), ("p_name", "'3:0'")), (("Key Management", "Type"), ("p_name", "p_type")), (("State", "Note"), ("p_name", "p_type")),
    (("Object", "ProtocolID"), ("p_name", "''")), (("Authority", "Type"), ("p_name", "p_type")), (("UID", "Security Description"), ("p_brand", "p_name")), (("Identifier", "Description"), ("concat('0', p_size % 10, 'Ch')", "p_name")),
    (("Value", "Commands Affected", "Description"), ("concat(p_size, 'h')", "p_name", "p_type")), (("Status Value", "Value", "Description"), ("''", "'1Fh'", "CASE WHEN p_size % 2 = 0 THEN 'command aborted' ELSE 'other' END")),
    (("DW", "Bit"), ("CAST(p_size % 16 AS STRING)", "'7'")), (("Data Pointer", "Parameter"), ("p_name", "p_type")), (("Controller Support", "Note"), ("'yes'", "p_name")), (("Queue Field", "Access"), ("p_name", "'RW'")),
    (("Field", "Namespace"), ("p_name", "p_brand")), (("Parameter", "Controller"), ("p_name", "''")), (("Field Name", "Structure"), ("p_name", "p_type")), (("Address", "Field"), ("concat(p_size, 'h')", "p_name")), (("Field", "Bit Range"), ("p_name", "CASE WHEN p_size % 2 = 0 THEN '7:4' ELSE 'all' END")),
    (("Code", "Meaning"), ("CAST(p_size AS STRING)", "p_name")), (("Text", "Remark"), ("concat('see AB-', p_size)", "''")), (("Parameter", "Default", "Type"), ("p_name", "''", "''")), (("Column 1", "Column 2"), ("p_name", "''")),
]


def _case(open_: str, close: str, which: int) -> str:
    return f"CASE p_partkey % {len(KINDS)} " + " ".join(f"WHEN {i} THEN {open_}{', '.join(repr(x) if which == 0 else x for x in k[which])}{close}" for i, k in enumerate(KINDS)) + " END"


_RX = lambda t: re.sub(r"\brx\(", "regexp_matches(", t)
_STAGES = ", ".join(f"s{i + 1} AS (SELECT *, {', '.join(f'{_RX(v)} AS {k}' for k, v in stage.items())} FROM s{i})" for i, stage in enumerate(op.DERIVED))
TECH_SQL = f"""tab AS (SELECT p_partkey AS row_id, {_case('[', ']', 0)} AS headers, {_case('[', ']', 1)} AS vals FROM part), n AS (SELECT *, array_to_string(list_filter(list_transform(headers, lambda h, i: CASE WHEN trim(vals[i]) <> '' THEN concat(h, ' = ', vals[i]) END), lambda x: x IS NOT NULL), ' | ') AS row_text, array_to_string(headers, ' ') AS header_text,
list_distinct(list_filter(flatten(list_transform(headers, lambda h: regexp_extract_all(lower(h), '[a-z]+'))), lambda w: w IN ({', '.join(f"'{w}'" for w in op.HINT_WORDS)}))) AS hint_words FROM tab), s0 AS (SELECT *, array_to_string(hint_words, ' ') AS hints, len(hint_words) AS n_hints, {', '.join(f'{sql_cell(*v)} AS {k}' for k, v in op.NAMES.items())} FROM n), {_STAGES}""".replace("AS STRING", "AS VARCHAR")


@query(f"""WITH {TECH_SQL} SELECT row_id, row_text, {sql_case(op.TYPES)} AS unit_type, sct, sc FROM s{len(op.DERIVED)}""")
def technical_row_types(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr("p_partkey AS row_id", f"{_case('array(', ')', 0)} AS headers", f"{_case('array(', ')', 1)} AS vals").withColumn("cells", F.map_from_arrays("headers", "vals"))
    return op.typed(rows).select("row_id", "row_text", "unit_type", "sct", "sc")
