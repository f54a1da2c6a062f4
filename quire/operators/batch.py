"""Batches and reports: document results, counters, semantic units of blocks,
table context, the row pipeline of a grid, findings in order, JSON leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import headers as hd
from . import tables as tab
from .quality import severity_rank

OCR_MODES = ("html", "image", "scanned")
CONTEXT_WORDS = "appendix|clause|requirement|vendor"


def document_results(inputs: DataFrame, outcomes: DataFrame, keys: list[str], skipped: str, cancelled_after: Column) -> DataFrame:
    """One row an input document: unchanged ones are skipped, those after the
    cancellation cancelled, the others have the status of their outcome
    (status, pages, warnings), failed where there is none."""
    j = inputs.join(outcomes, keys, "left")
    status = F.when(F.col(skipped), "skipped").when(cancelled_after, "cancelled").otherwise(F.coalesce("status", F.lit("failed")))
    return j.select(*inputs.columns, status.alias("result"), F.when(status.isin("success", "partial_success"), F.coalesce("pages", F.lit(0))).otherwise(0).alias("pages"), F.coalesce("warnings", F.lit(0)).alias("warnings"))


def batch_summary(results: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by result, pages and warnings of each batch, and its exit code:
    2 if anything failed, 1 if anything is partial or cancelled, else 0."""
    n = lambda s: F.count(F.when(F.col("result") == s, 1))
    names = ("success", "partial_success", "skipped", "failed", "cancelled")
    s = results.groupBy(*keys).agg(F.count("*").alias("documents"), *[n(x).alias(x) for x in names], F.sum("pages").alias("pages"), F.sum("warnings").alias("warnings"))
    return s.withColumn("exit_code", F.when(F.col("failed") > 0, 2).when(F.col("partial_success") + F.col("cancelled") > 0, 1).otherwise(0))


def report(parts: dict[str, DataFrame], doc: list[str]) -> DataFrame:
    """One wide row a document: each part is already a row a document, so the
    parts are joined on the document, nulls being zero for numbers."""
    out = None
    for df in parts.values():
        out = df if out is None else out.join(df, doc, "full")
    return out.fillna(0)


def ocr_counters(tables: DataFrame, keys: list[str]) -> DataFrame:
    """Eligible tables (source_mode), those attempted, with text, below the
    confidence threshold (status, text, confidence); others don't count."""
    some = tables.withColumn("_e", F.lower("source_mode").isin(*OCR_MODES))
    n = lambda c: F.count(F.when(F.col("_e") & c, 1))
    tried = F.col("attempted")
    return some.groupBy(*keys).agg(n(F.lit(True)).alias("eligible"), n(tried).alias("attempted"), n(tried & (F.trim("text") != "")).alias("with_text"), n(tried & (F.col("confidence") < 0.65)).alias("low_confidence"))


def semantic_units(blocks: DataFrame, doc: list[str]) -> DataFrame:
    """Units of a block (block_type, text, ord): a section for a heading, a
    warning or note by its first word, steps for a list, a paragraph else;
    numbered by place in the document. One block gives all of its steps."""
    text = F.trim("text")
    lead = F.lower(F.regexp_extract(text, r"(?i)^(warning|caution|note)\b\s*:?", 1))
    steps = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*([-*+]|\d+[.)])\s+"))
    bare = F.transform(steps, lambda x: F.trim(F.regexp_replace(x, r"^\s*([-*+]|\d+[.)])\s+", "")))
    one = lambda kind: F.array(F.struct(F.lit(kind).alias("unit_type"), text.alias("unit_text")))
    units = (
        F.when(F.col("block_type") == "heading", one("section")).when(lead.isin("warning", "caution"), one("warning")).when(lead == "note", one("note"))
        .when((F.col("block_type") == "list") & (F.size(steps) > 0), F.transform(bare, lambda x: F.struct(F.lit("procedure_step").alias("unit_type"), x.alias("unit_text")))).otherwise(one("paragraph"))
    )
    each = blocks.filter(text != "").select(*doc, "ord", F.posexplode(units).alias("i", "u")).select(*doc, "ord", "i", "u.*")
    return each.withColumn("unit_no", F.row_number().over(Window.partitionBy(*doc).orderBy("ord", "i"))).drop("i")


def section_ids(blocks: DataFrame, doc: list[str], order: str) -> DataFrame:
    """`section_id`: the block id of the last heading at or before a block."""
    w = Window.partitionBy(*doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("section_id", F.last(F.when(F.col("block_type") == "heading", F.col("block_id")), ignorenulls=True).over(w))


def heading_context(tables: DataFrame, path: str) -> Column:
    """A table's heading path, where it speaks of an appendix, a clause, a
    requirement or a vendor; null else."""
    return F.when(F.lower(F.array_join(path, " ")).rlike(CONTEXT_WORDS), F.array_join(path, " > "))


def processed_rows(grids: DataFrame, grid: str) -> DataFrame:
    """The whole way of a grid: cells trimmed to a rectangle, notes split off,
    empty columns dropped, a descriptor header promoted, header cells moved
    over their bodies, two header rows made one, names made unique. Adds
    headers, body, notes and the numbers of promoted rows and moves."""
    g = tab.settled(grids.withColumn("_r", tab.rectangle(F.col(grid))))
    body, notes = tab.split_notes(F.col("_r"))
    blank_first = F.forall(F.col("_r")[0], lambda x: x == "")
    kept = F.when(blank_first, F.concat(F.slice("_r", 1, 1), body)).otherwise(body)  # a blank header row is no blank row
    g = tab.settled(g.withColumns({"notes": notes, "_k": kept})).filter(F.size("_k") > 0)
    g = tab.settled(g.withColumn("_c", tab.compact(F.col("_k")))).filter(F.size(F.col("_c")[0]) > 0)
    g = tab.settled(g.withColumn("_p", hd.promoted("_c"))).withColumn("_g", F.col("_p.grid"))
    g = tab.settled(g.withColumn("_a", hd.realigned("_g"))).withColumn("_h", F.col("_a.grid"))
    g = tab.settled(g.withColumn("_m", hd.is_multi_row("_h")))
    single = F.transform(F.col("_h")[0], lambda x, i: F.when(F.trim(x) == "", F.concat(F.lit("Column "), (i + 1).cast("string"))).otherwise(F.trim(x)))
    g = tab.settled(g.withColumn("_n", F.when(F.col("_m"), hd.joined("_h")).otherwise(single)))
    rest = F.slice("_h", F.when(F.col("_m"), 3).otherwise(2), F.greatest(F.size("_h"), F.lit(1)))
    out = g.withColumns({"headers": tab.unique_headers(F.col("_n")), "body": rest, "promoted": F.col("_p.n"), "moves": F.col("_a.shifts"), "multi": F.col("_m")})
    return out.drop("_r", "_k", "_c", "_p", "_g", "_a", "_h", "_m", "_n")


def ordered_findings(findings: DataFrame, keys: list[str]) -> DataFrame:
    """`place` of findings: errors first, then by code, field and record."""
    w = Window.partitionBy(*keys).orderBy(severity_rank("severity"), "code", "field", "record_id")
    return findings.withColumn("place", F.row_number().over(w))


def json_leaves(records: DataFrame, record_id: str, json: str, pattern: str) -> DataFrame:
    """(record_id, field, value) of named string values at any depth of a JSON
    text that match a pattern: names and values are read in pairs, so nesting
    needs no recursion. Escapes stay as they are written."""
    pair = r'"((?:[^"\\]|\\.)*)"\s*:\s*"((?:[^"\\]|\\.)*)"'
    names, values = (F.regexp_extract_all(json, F.lit(pair), F.lit(i)) for i in (1, 2))
    each = records.select(record_id, F.explode(F.arrays_zip(names.alias("field"), values.alias("value"))).alias("x")).select(record_id, "x.*")
    return each.filter(F.col("value").rlike(pattern))
