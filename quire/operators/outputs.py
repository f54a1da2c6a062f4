"""What leaves the engine: Markdown, metadata for vector stores, redaction,
scores, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .semantics import c_sql


def markdown(blocks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Markdown of a page from typed blocks (line_type, text), in order."""
    line = F.when(F.col("line_type") == "heading_index", F.concat(F.lit("## "), "text")).when(F.col("line_type") == "list_item", F.concat(F.lit("- "), F.regexp_replace("text", r"^\s*([-*]|\d+[.)])\s+", ""))).when(F.col("line_type").endswith("caption"), F.concat(F.lit("*"), "text", F.lit("*"))).otherwise(F.col("text"))
    b = blocks.withColumn("_md", line)
    return b.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_md").alias("m")))), lambda x: x["m"]), "\n\n").alias("markdown"))


def metadata(df: DataFrame, fields: dict[str, Column], most_bytes: int) -> DataFrame:
    """`metadata` as JSON without nulls, its size, and whether it fits."""
    j = df.withColumn("metadata", F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])))
    return j.withColumn("metadata_bytes", F.octet_length("metadata")).withColumn("fits", F.col("metadata_bytes") <= most_bytes)


def public_ids(df: DataFrame, order: str, name: str, safe: bool) -> DataFrame:
    """With `safe`, document names become doc-0001 ... within their group."""
    if not safe:
        return df.withColumn("public_id", F.col(name))
    return df.withColumn("public_id", F.format_string("doc-%04d", F.dense_rank().over(Window.partitionBy("grp").orderBy(order))))


def table_confidence(df: DataFrame) -> DataFrame:
    """Confidence of a table from its ratios and signals, and its bucket.
    Columns: quality, header_confidence, density, header_fill, empty_ratio,
    captioned, is_html, fallbacks, notes, merged."""
    flag = lambda c, v: F.when(F.col(c), F.lit(v)).otherwise(F.lit(0.0))
    s = 0.4 * F.col("quality") + 0.25 * F.col("header_confidence") + 0.15 * F.col("density") + 0.1 * F.col("header_fill") + 0.1 * (1 - F.col("empty_ratio"))
    s = s + flag("captioned", 0.03) - flag("is_html", 0.06) - F.least(F.col("fallbacks") * 0.025, F.lit(0.12)) - flag("notes", 0.02) - flag("merged", 0.06) - F.when(F.col("header_confidence") < 0.5, 0.08).otherwise(F.lit(0.0))
    s = F.when(F.col("is_html"), F.least(s, F.lit(0.79))).otherwise(s)
    d = df.withColumn("confidence", F.round(F.greatest(F.lit(0.0), F.least(s, F.lit(1.0))), 4))
    return d.withColumn("bucket", F.when(F.col("confidence") >= 0.82, "high").when(F.col("confidence") >= 0.64, "medium").otherwise("low"))


SECURITY_TEXT = [
    ("certificate", r"rx(t, '(?i)\bcertificate')"), ("measurement", r"rx(t, '(?i)\bmeasure')"), ("key", r"rx(t, '(?i)\bkey\b')"), ("power_loss", r"rx(t, '(?i)\bpower\b.*\blost\b')"), ("authority", r"rx(t, '(?i)\bvendor\b')"), ("session", r"rx(t, '(?i)\bsession\b')"),
]
BASE = {"paragraph": 0.58, "list": 0.60, "heading": 0.64}


def text_candidates(df: DataFrame, text: str, block_type: str, has_path: str) -> DataFrame:
    """Review-only candidates: the first matching rule, a base confidence by
    block type and a little more under a heading, at most 0.67."""
    c = df.withColumn("candidate", F.expr(c_sql(SECURITY_TEXT, t=text))).filter("candidate is not null")
    base = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in BASE.items() for x in kv]), F.col(block_type)), F.lit(0.56))
    return c.withColumn("confidence", F.round(F.least(base + F.when(F.col(has_path), 0.03).otherwise(F.lit(0.0)), F.lit(0.67)), 2))


def weighted_score(components: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of weight * clamped ratio, out of the sum of weights."""
    earned = F.col("weight") * F.greatest(F.lit(0.0), F.least(F.col("ratio"), F.lit(1.0)))
    return components.groupBy(*keys).agg(F.round(F.sum(earned), 4).alias("earned"), F.sum("weight").alias("possible")).withColumn("score", F.round(F.when(F.col("possible") > 0, F.col("earned") / F.col("possible") * 100), 2))


def text_sample(df: DataFrame, keys: list[str], order: str, text: str, limit: int) -> DataFrame:
    """The first `limit` characters of a document's parts, part by part: a
    running sum says how much of each part still fits."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.char_length(text)).over(w), F.lit(0))
    s = df.withColumn("_room", F.greatest(F.lit(limit) - used, F.lit(0)).cast("int")).filter("_room > 0")
    return s.withColumn(text, F.substring(F.col(text), F.lit(1), F.col("_room"))).drop("_room")


def even_sample(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """n rows of a key spread evenly, both ends among them."""
    w = Window.partitionBy(*keys)
    s = df.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    # Row i is the j-th sample for some j: i = bround(j * (n_rows - 1) / (n - 1)).
    j = F.sequence(F.lit(0), F.lit(n - 1))
    hit = F.exists(j, lambda x: F.bround(x * (F.col("_n") - 1) / F.lit(n - 1)) == F.col("_i"))
    return s.filter((F.col("_n") <= n) | hit).drop("_i", "_n")


def first_of(df: DataFrame, keys: list[str], kind: str, order: str) -> DataFrame:
    w = Window.partitionBy(*keys, kind).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def classified(lines: DataFrame, keys: list[str], body: DataFrame) -> DataFrame:
    """Block type of typed lines with gaps: explicit types first, then large
    print with room around it is a heading."""
    large = (F.col("font_size") >= F.greatest(F.col("body_size") * 1.35, F.col("body_size") + 3)) & (F.char_length(F.trim("text")) <= 120) & ~F.col("text").rlike("[.!?]$")
    room = lambda c: F.col(c).isNull() | (F.col(c) >= F.col("body_size") * 1.2)
    kind = (
        F.when(F.col("line_type").isin("figure_caption", "table_caption"), "caption").when(F.col("line_type") == "heading_index", "heading").when(F.col("line_type") == "list_item", "list")
        .when(large & (F.col("line_type") == "body_line"), F.when(room("gap_before") & room("gap_after"), "heading").otherwise("large_paragraph")).otherwise("paragraph")
    )
    return lines.join(body, keys).withColumn("block_type", kind)
