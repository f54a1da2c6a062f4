"""Contracts of values and units, impact review, scopes, runs, reference
targets and evaluation queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import collapse, preview

TABLE_LABEL = r"(?i)\b{}\s+([A-Za-z0-9]+(?:[.\-][A-Za-z0-9]+)*)"
CELL_TARGETS = {
    "requirement": ("requirementid", "requirement", "reqid", "id"), "log_page": ("logidentifier", "lid", "logpage"), "feature": ("featureidentifier", "fid", "feature"), "opcode": ("opcode", "commandopcode"), "register": ("register", "capability", "field"),
}


def value_findings(records: DataFrame, record_id: str, texts: dict[str, bool], integers: dict[str, bool], ranges: list[str], boxes: list[str]) -> DataFrame:
    """(code, field, record_id) of values that break their type's rule.

    texts: field -> required (a required one may not be blank, an optional one
    may be null); integers: field -> positive; ranges: [first, last] pages from
    1 on; boxes: four finite numbers in order. One pass, no join."""
    found = []
    for f, required in texts.items():
        bad = (F.col(f).isNull() | (F.trim(f) == "")) if required else F.lit(False)
        found.append(F.when(bad, F.struct(F.lit("invalid_string_field").alias("code"), F.lit(f).alias("field"))))
    for f, positive in integers.items():
        found.append(F.when(F.col(f).isNull() | (F.lit(positive) & (F.col(f) < 1)), F.struct(F.lit("invalid_integer_field").alias("code"), F.lit(f).alias("field"))))
    for f in ranges:
        good = (F.size(f) == 2) & F.forall(f, lambda p: p.isNotNull() & (p >= 1)) & (F.get(f, F.lit(0)) <= F.get(f, F.lit(1)))
        found.append(F.when(~F.coalesce(good, F.lit(False)), F.struct(F.lit("invalid_page_range").alias("code"), F.lit(f).alias("field"))))
    for f in boxes:
        good = (F.size(f) == 4) & F.forall(f, lambda x: x.isNotNull() & ~F.isnan(x)) & (F.get(f, F.lit(0)) <= F.get(f, F.lit(2))) & (F.get(f, F.lit(1)) <= F.get(f, F.lit(3)))
        found.append(F.when(~F.coalesce(good, F.lit(False)), F.struct(F.lit("invalid_bbox").alias("code"), F.lit(f).alias("field"))))
    each = records.select(F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("f"), F.col(record_id).cast("string").alias("record_id"))
    return each.select("f.code", "f.field", "record_id")


def unit_contract(units: DataFrame, keys: list[str], core: list[str], any_of: dict[str, list[str]], all_of: dict[str, list[str]]) -> DataFrame:
    """(keys, code, unit_id) of confirmed domain units (unit_type, fields: a
    map, review_only) that lack what their type needs, and of documents (null
    unit_id) with units but none of a core type."""
    present = lambda f: F.coalesce(F.element_at("fields", F.lit(f)) != "", F.lit(False))
    lacks = F.lit(False)
    for kind, fields in any_of.items():
        some = present(fields[0])
        for f in fields[1:]:
            some = some | present(f)
        lacks = lacks | ((F.col("unit_type") == kind) & ~some)
    for kind, fields in all_of.items():
        every = present(fields[0])
        for f in fields[1:]:
            every = every & present(f)
        lacks = lacks | ((F.col("unit_type") == kind) & ~every)
    confirmed = units.filter(~F.col("review_only"))
    code = F.when(F.col("fields").isNull(), "missing_normalized_fields").when(lacks, "missing_normalized_field")
    bad = confirmed.withColumn("code", code).filter("code is not null").select(*keys, "code", "unit_id")
    none = units.groupBy(*keys).agg(F.bool_or(F.col("unit_type").isin(*core)).alias("has")).filter(~F.col("has"))
    return bad.unionByName(none.select(*keys, F.lit("missing_core_domain_unit").alias("code"), F.lit(None).cast(units.schema["unit_id"].dataType).alias("unit_id")))


def with_registry(units: DataFrame, registry: DataFrame) -> DataFrame:
    """units with their adapter's registry row and its required fields for the
    unit's type; registry has a row an adapter, so it is broadcast."""
    r = registry.select("adapter", "agent_domain", "compatibility_group", "required")
    return units.join(F.broadcast(r), "adapter", "left").withColumn("required_fields", F.coalesce(F.element_at("required", F.col("unit_type")), F.array().cast("array<string>"))).drop("required")


def recommendation() -> Column:
    """What a change of a requirement (status, changed_fields) asks for."""
    return (
        F.when(F.col("status") == "added", "create_or_extend_test_coverage").when(F.col("status") == "removed", "review_obsolete_tests_and_trace_links")
        .when(F.array_contains("changed_fields", "texts"), "review_test_logic_and_expected_results").when(F.array_contains("changed_fields", "source_refs"), "verify_citation_and_traceability_only").otherwise("review_requirement_metadata")
    )


def impact_review(entries: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Numbered review items of impact entries (status, changed_fields,
    previous_texts, current_texts, previous_pages, current_pages)."""
    w = Window.partitionBy(*keys).orderBy(order)
    first = lambda c: preview(F.get(F.filter(c, lambda x: F.trim(x) != ""), F.lit(0)))
    pages = lambda c: F.array_sort(F.array_distinct(c))
    return entries.select(
        *keys, order, F.format_string("impact-%04d", F.row_number().over(w)).alias("review_id"), "status", recommendation().alias("recommendation"), first("previous_texts").alias("previous_preview"), first("current_texts").alias("current_preview"),
        pages("previous_pages").alias("previous_pages"), pages("current_pages").alias("current_pages"),
    )


def status_counts(entries: DataFrame, keys: list[str], status: str, names: tuple[str, ...]) -> DataFrame:
    return entries.groupBy(*keys).agg(*[F.count(F.when(F.col(status) == n, 1)).alias(n) for n in names])


def sidecar_scope(runs: DataFrame, always: list[str], optional: dict[str, str], written: str) -> DataFrame:
    """Expected, missing and unexpected relations of each run: those of its
    scope, and optional ones by a flag column, against the array `written`."""
    expected = F.concat(F.array(*map(F.lit, always)), F.filter(F.array(*[F.when(F.col(flag), F.lit(name)) for name, flag in optional.items()]), lambda x: x.isNotNull()))
    text = lambda c: F.array_join(F.array_sort(c), ",")
    return runs.withColumn("_e", expected).withColumns({"expected": text("_e"), "missing": text(F.array_except("_e", written)), "unexpected": text(F.array_except(written, "_e"))}).drop("_e")


def first_existing(candidates: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """The first of each key's candidate paths (path, rank) that is a file."""
    return candidates.join(files.select("path").distinct(), "path", "left_semi").groupBy(*keys).agg(F.min_by("path", "rank").alias("path"), F.min("rank").alias("rank"))


def region_refs(blocks: DataFrame, tables: DataFrame, figures: DataFrame, keys: list[str]) -> DataFrame:
    """Regions of a page: blocks, tables, figures, each by its own index. All
    have keys, source_id, order_index, role; rows without an id are left out."""
    kind = lambda df, k: df.filter("source_id is not null").select(*keys, F.lit(k[0]).alias("kind_order"), F.lit(k[1]).alias("region_type"), "source_id", "order_index", "role")
    u = kind(blocks, (0, "text_block")).unionAll(kind(tables, (1, "table"))).unionAll(kind(figures, (2, "figure")))
    w = Window.partitionBy(*keys).orderBy("kind_order", "order_index", "source_id")
    return u.withColumn("region_no", F.row_number().over(w)).drop("kind_order")


def reference_targets(blocks: DataFrame, tables: DataFrame, rows: DataFrame, doc: list[str]) -> DataFrame:
    """(doc, target_type, label, target) of what references may point to.

    Numbered headings and appendices, captions of tables and figures (blocks:
    block_id, block_type, text, ord), captions of tables (table_id, caption,
    ord) and cells under id headers (row_id, headers, vals, ord). Of one label
    the last target stands: blocks first, then tables, then rows, in order."""
    def found(df: DataFrame, stage: int, kind: str, label: Column, target: str) -> DataFrame:
        return df.select(*doc, F.lit(stage).alias("stage"), F.col("ord").cast("long").alias("ord"), F.lit(kind).alias("target_type"), label.alias("label"), F.col(target).cast("string").alias("target")).filter("label <> ''")

    text = F.trim("text")
    heads, caps = blocks.filter("block_type = 'heading'"), blocks.filter("block_type = 'caption'")
    parts = [
        found(heads, 0, "section", F.regexp_extract(text, r"^(\d+(?:\.\d+)*)\b", 1), "block_id"), found(heads, 0, "appendix", F.regexp_extract(text, r"(?i)^Appendix\s+([A-Za-z0-9]+)\b", 1), "block_id"),
        found(caps, 0, "table", F.regexp_extract(text, TABLE_LABEL.format("Table"), 1), "block_id"), found(caps, 0, "figure", F.regexp_extract(text, TABLE_LABEL.format("Figure"), 1), "block_id"),
        found(tables, 1, "table", F.regexp_extract("caption", TABLE_LABEL.format("Table"), 1), "table_id"),
    ]
    each = rows.select(*doc, "row_id", "ord", F.explode(F.arrays_zip("headers", "vals")).alias("c")).withColumn("k", F.regexp_replace(F.lower("c.headers"), "[^a-z0-9]+", ""))
    kind = F.lit(None).cast("string")
    for name, keys in CELL_TARGETS.items():
        kind = F.when(F.col("k").isin(*keys), name).otherwise(kind)
    cells = each.withColumn("target_type", kind).filter("target_type is not null").select(*doc, F.lit(2).alias("stage"), F.col("ord").cast("long").alias("ord"), "target_type", F.trim("c.vals").alias("label"), F.col("row_id").cast("string").alias("target")).filter("label <> ''")
    u = parts[0]
    for p in [*parts[1:], cells]:
        u = u.unionAll(p)
    return u.groupBy(*doc, "target_type", "label").agg(F.max_by("target", F.struct("stage", "ord", "target")).alias("target"))


def bucketed_queries(rows: DataFrame, doc: list[str], kind: str, name: str, order: str, templates: dict[str, str]) -> DataFrame:
    """One evaluation query a document and bucket: the template of the first
    row of its kind that has a name, with the rows it should find."""
    some = rows.filter(F.col(kind).isin(*templates) & (F.trim(name) != "")).select(*doc, F.col(kind).alias("bucket"), F.col(name).alias("name"), F.col(order).alias("o"))
    first = some.groupBy(*doc, "bucket").agg(F.min_by("name", "o").alias("name"), F.min("o").alias("expected_id"), F.count("*").alias("bucket_size"))
    text = F.lit(None).cast("string")
    for k, t in templates.items():
        a, b = t.split("{}")
        text = F.when(F.col("bucket") == k, F.concat(F.lit(a), collapse("name"), F.lit(b))).otherwise(text)
    return first.withColumn("query", text).drop("name")


def chunk_union(sources: list[tuple[str, DataFrame]], doc: list[str]) -> DataFrame:
    """One relation of chunks from many sources, in the order given; each has
    doc, ord, text, priority. Chunk numbers run over a document; estimates
    count four characters a token; blank texts are left out."""
    u = None
    for rank, (name, df) in enumerate(sources):
        part = df.select(*doc, F.lit(rank).alias("source_rank"), F.lit(name).alias("chunk_type"), F.col("ord").cast("long").alias("ord"), F.col("text"), F.col("priority").cast("int").alias("priority")).filter("trim(text) <> ''")
        u = part if u is None else u.unionAll(part)
    w = Window.partitionBy(*doc).orderBy("source_rank", "ord", "text")
    n = F.row_number().over(w)
    estimate = F.floor((F.char_length("text") + 3) / 4).cast("int")
    return u.withColumns({"chunk_index": n, "chunk_id": F.format_string("chunk-%06d", n), "char_count": F.char_length("text"), "token_estimate": estimate, "text_sha256": F.sha2("text", 256)})


def parsed_lines(lines: DataFrame, ddl: str, keys: list[str], line: str = "line", order: str = "line_no") -> tuple[DataFrame, DataFrame]:
    """(records, findings) of JSON lines with their numbers: blank lines don't
    count, lines that are no record of the schema become findings."""
    some = lines.filter(F.trim(line) != "").withColumn("r", F.from_json(line, ddl + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("r._bad").isNotNull() | F.col("r").isNull()
    names = [c.split()[0] for c in ddl.split(", ")]
    return some.filter(~bad).select(*keys, order, *[f"r.{n}" for n in names]), some.filter(bad).select(*keys, order, F.lit("invalid_json_line").alias("code"), F.col(line).alias("line"))
