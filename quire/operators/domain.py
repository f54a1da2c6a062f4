"""Domain adapters: scores of a text, units from typed rows, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rules import DOMAIN_WORDS
from .semantics import page_keys


def occurrences(text: Column, word: Column | str) -> Column:
    w = F.lit(word) if isinstance(word, str) else word
    return ((F.char_length(text) - F.char_length(F.replace(text, w, F.lit("")))) / F.char_length(w)).cast("int")


def score_array(text: str, words: dict[str, str] = DOMAIN_WORDS) -> Column:
    """(adapter, score) of every adapter; the keyword table is a literal."""
    low = F.lower(text)
    return F.array(*[F.struct(F.lit(a).alias("adapter"), sum((occurrences(low, w.lstrip("+")) * (3 if w.startswith("+") else 1) for w in ws.split("|")), F.lit(0)).alias("score")) for a, ws in words.items()])


def scores(docs: DataFrame, keys: list[str], text: str = "text", words: dict[str, str] = DOMAIN_WORDS) -> DataFrame:
    """One row a document and adapter; the text is scanned where it lies."""
    return docs.select(*keys, F.explode(score_array(text, words)).alias("s")).select(*keys, "s.adapter", "s.score")


def recommend(docs: DataFrame, keys: list[str], text: str = "text", words: dict[str, str] = DOMAIN_WORDS) -> DataFrame:
    """The best adapter (ties by name) and how far it leads, in place: the
    scores of a document are sorted in its row."""
    by_score = F.array_sort(F.transform(score_array(text, words), lambda s: F.struct((-s["score"]).alias("minus"), s["adapter"].alias("adapter"))))
    # A generator keeps the scan from being repeated by each column that reads it.
    r = docs.select(*keys, F.explode(F.array(by_score)).alias("s"))
    score, second = -F.col("s")[0]["minus"], -F.col("s")[1]["minus"]
    level = F.when(score <= 0, "none").when((score >= 4) & (score >= second + 2), "high").when((score >= 2) & (score > second), "medium").otherwise("low")
    return r.select(*keys, F.when(score > 0, F.col("s")[0]["adapter"]).alias("adapter"), score.alias("score"), F.when(second > 0, F.col("s")[1]["adapter"]).alias("runner_up"), (score - second).alias("margin"), level.alias("confidence"))


#: technical unit type -> (domain unit type, name cell, value cell), in order
NVME_UNITS = [
    ("command_opcode", "command", "command", "opcode"), ("log_page", "log_page", "log_id", "log_id"), ("feature_identifier", "feature", "feature_id", "feature_id"), ("status_code", "status_code", "sct", "sc"),
    ("command_dword_field", "command_dword_field", "coalesce(field, dword)", "dword"), ("register_field", "register_field", "coalesce(field, register)", "coalesce(value, offset_)"), ("bitfield", "register_field", "field", "bits"), ("enum_value", "enum_value", "value", "description"),
]


def units(typed: DataFrame) -> DataFrame:
    """Domain units of typed rows: the first of equal (type, name, value)."""
    case = lambda k: F.expr("CASE unit_type " + " ".join(f"WHEN '{u[0]}' THEN {k(u)}" for u in NVME_UNITS) + " END")
    u = typed.select("row_id", *page_keys(typed), case(lambda u: f"'{u[1]}'").alias("domain_type"), case(lambda u: u[2]).alias("name"), case(lambda u: u[3]).alias("value")).filter("domain_type is not null")
    first = Window.partitionBy("domain_type", "name", "value").orderBy("row_id")
    once = u.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")
    # Numbers are per page of a document: a global order would be one task's.
    return once.withColumn("unit_no", F.row_number().over(Window.partitionBy(*page_keys(once)).orderBy("row_id")))


def normalised(fields: dict[str, Column]) -> Column:
    """A map of the fields that are present."""
    entries = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))])
    return F.map_filter(entries, lambda _, v: v.isNotNull() & (v != ""))


FAMILIES = [("log_page", "log|telemetry"), ("feature", "feature"), ("thermal", "temperature|thermal"), ("security", "key|security|tcg"), ("command_timeout", "timeout|time out"), ("form_factor", "connector|form factor")]


def family(text: str) -> Column:
    low = F.lower(text)
    c = F.lit(None).cast("string")
    for name, words in reversed(FAMILIES):
        c = F.when(low.rlike(words), name).otherwise(c)
    return c


def coverage(units_: DataFrame, expected: DataFrame, group: list[str]) -> DataFrame:
    """Share of units of a type that carry each expected field. units_ has
    `fields` (a map); expected has (domain_type, field)."""
    j = units_.join(F.broadcast(expected), "domain_type", "left")  # a rule table
    return j.groupBy(*group, "domain_type", "field").agg(F.count("*").alias("units"), F.count_if(F.map_contains_key("fields", F.col("field"))).alias("present")).withColumn("ratio", F.round(F.col("present") / F.col("units"), 4))


def merged_coverage(parts: DataFrame) -> DataFrame:
    """Coverage of a corpus from coverages of its parts: sums first, ratio last."""
    s = parts.groupBy("domain_type", "field").agg(F.sum("units").alias("units"), F.sum("present").alias("present"))
    return s.withColumn("ratio", F.round(F.col("present") / F.col("units"), 4))
