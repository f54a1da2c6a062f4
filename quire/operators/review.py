"""Warnings, table review, references under guard, evaluation of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import preview

LOW_QUALITY = 0.55
ACTIONABLE = ("CELL_ALIGNMENT_FAILED", "HEADER_ALIGNMENT_FAILED", "MISSING_SOURCE_REFS", "RAG_SIDECAR_MISMATCH", "ROW_SPLIT_SUSPECTED", "SOURCE_REF_MISSING")
HEADER_REASONS = ("LOW_HEADER_CONFIDENCE", "HEADER_FRAGMENTED", "MERGED_CELL_SUSPECTED")
MARKER_REASONS = ("recovered_exact", "recovered_context_validated", "suppressed_no_candidate", "suppressed_ambiguous")
EXIT_DOMAINS = ("ocr", "table", "image")
EXTERNAL_BEFORE = r"(?i)\b(?:RFC|ISO|IEC|PCI(?:e)?|MSI-X)\s+\d*"
EXTERNAL_AFTER = r"(?i)\b(?:of|in)\s+(?:RFC|ISO|IEC)\s+\d+"
STOPWORDS = ("above", "below", "defines", "describes", "following", "in", "of", "specifies")
LABEL_SHAPE = r"^[A-Z]{1,4}([.-][A-Z0-9]{1,8})*$"
PARAMETER_KEYS = ("field", "parameter", "command", "opcode", "bits", "value", "name")
PARAMETER_HEADERS = ("bits", "command", "description", "field", "name", "opcode", "parameter", "value")


def advisory() -> Column:
    """Whether a warning (severity, code, forced, reason, chars, images) is
    advice: by its registered severity, or an empty OCR result of a page that
    has next to no text and no image."""
    empty = (F.col("code") == "OCR_EMPTY_RESULT") & ~F.coalesce("forced", F.lit(False))
    sparse = F.when(F.col("reason") == "low_text_density", F.col("chars") < 3).when(F.col("reason") == "empty_text_layer", (F.col("chars") == 0) & (F.col("images") == 0))
    return (F.col("severity") == "advisory") | (empty & F.coalesce(sparse, F.lit(False)))


def affects_exit() -> Column:
    """Whether a warning turns success into partial success."""
    return ~advisory() & (F.col("code").endswith("_FAILED") | (F.col("exits") & F.col("domain").isin(*EXIT_DOMAINS)))


def with_page_context(warnings: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Empty OCR results get the page's characters and images where they lack
    them. pages: keys, page_chars, page_images."""
    empty = F.col("code") == "OCR_EMPTY_RESULT"
    fill = lambda own, page: F.when(empty, F.coalesce(own, page)).otherwise(F.col(own)).alias(own)
    out = warnings.join(pages, keys, "left")
    return out.select(*[fill(c, f"page_{c}") if c in ("chars", "images") else F.col(c) for c in warnings.columns])


def by_selected_page(warnings: DataFrame, selection: DataFrame, keys: list[str], order: str, partitions: int | None = None) -> DataFrame:
    """`place` of each warning in its document: by the place of its page in
    the selection (keys, page, ordinal), unselected pages last, stable.
    partitions: of documents; null leaves them to the session."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*keys).orderBy(F.coalesce("ordinal", F.lit(1 << 30)), order)
    placed = warnings.join(selection, [*keys, "page"], "left")
    placed = placed if partitions is None else placed.repartition(partitions, *keys)
    return placed.withColumn("place", F.row_number().over(w)).drop("ordinal")


def zero_filled(rows: DataFrame, keys: list[str], column: str, names: tuple[str, ...]) -> DataFrame:
    """(keys, name, count) of every name, also where nothing has it; values
    outside the names don't count. One aggregation, no join."""
    counts = rows.groupBy(*keys).agg(*[F.count(F.when(F.col(column) == n, 1)).alias(f"n{i}") for i, n in enumerate(names)])
    return counts.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"n{i}").alias("count")) for i, n in enumerate(names)])).alias("x")).select(*keys, "x.name", "x.count")


def low_quality_actionable() -> Column:
    """Of a table below LOW_QUALITY (actionable, missing_refs, reasons, mode,
    has_fallback, unresolved): whether somebody has to act on it."""
    hard = F.coalesce("actionable", F.lit(False)) | F.coalesce("missing_refs", F.lit(False)) | F.arrays_overlap("reasons", F.array(*map(F.lit, ACTIONABLE)))
    soft = (F.lower("mode") != "html") & ~F.col("has_fallback") & F.coalesce("unresolved", F.lit(False))
    return (F.col("quality_score") < LOW_QUALITY) & (hard | soft)


def review_pack(quality: DataFrame, rows: DataFrame, technical: DataFrame, domain: DataFrame, fallbacks: DataFrame, keys: list[str]) -> DataFrame:
    """Low-quality tables with counts of their rows, technical and domain
    units (an array of table ids each), a preview of the first row, status and
    sorted reasons. Every side is aggregated before it is joined."""
    low = quality.filter(F.col("quality_score") < LOW_QUALITY)
    r = rows.groupBy(*keys).agg(F.count("*").alias("row_count"), F.min_by("row_text", "row_index").alias("sample"))
    t = technical.groupBy(*keys).agg(F.count("*").alias("technical_units"))
    u = domain.select("unit_id", F.explode(F.array_distinct("table_ids")).alias(keys[0])).groupBy(keys[0]).agg(F.count("*").alias("domain_units"))
    f = fallbacks.select(*keys).distinct().withColumn("has_fallback", F.lit(True))
    j = low.join(r, keys, "left").join(t, keys, "left").join(u, keys[0], "left").join(f, keys, "left").fillna(0, ["row_count", "technical_units", "domain_units"]).withColumn("has_fallback", F.coalesce("has_fallback", F.lit(False)))
    why = [
        (F.col("row_count") == 0, "no_rag_rows"), (F.col("row_count") >= 2, "rag_rows_available"), (F.col("placeholder_ratio") >= 0.5, "placeholder_headers"), (F.col("technical_units") > 0, "technical_units_present"),
        (F.col("domain_units") > 0, "domain_units_present"), *[(F.array_contains("reasons", x), x.lower()) for x in HEADER_REASONS],
    ]
    reasons = F.array_sort(F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in why]), lambda x: x.isNotNull()))
    return j.select(*keys, "quality_score", "row_count", "technical_units", "domain_units", F.sha2("sample", 256).alias("sample_sha256"), preview("sample").alias("sample_preview"), F.when(low_quality_actionable(), "actionable").otherwise("advisory").alias("status"), reasons.alias("triage_reasons"))


def is_external(text: str, start: str, end: str, kind: str, label: str) -> Column:
    """Whether a reference (span start, end from 0) belongs to another
    standard, by 40 characters on either side."""
    before = F.substring(F.col(text), F.greatest(F.col(start) - 39, F.lit(1)), F.least(F.col(start), F.lit(40)))
    after = F.substring(F.col(text), F.col(end) + 1, F.lit(40))
    around = F.substring(F.col(text), F.greatest(F.col(start) - 39, F.lit(1)), F.col(end) + 40 - F.greatest(F.col(start) - 40, F.lit(0)))
    section = F.col(kind).isin("appendix", "section") & (before.rlike(EXTERNAL_BEFORE) | after.rlike(EXTERNAL_AFTER))
    return section | ((F.col(kind) == "table") & ~F.col(label).rlike("[0-9]") & around.rlike(EXTERNAL_BEFORE))


def skips_unresolved(kind: str, label: str, resolved: str) -> Column:
    """Whether an unresolved reference is no reference after all."""
    bare = F.btrim(label, F.lit(" .,;:"))
    digits = bare.rlike("[0-9]")
    shaped = digits | bare.rlike(LABEL_SHAPE)
    return ~F.col(resolved) & (F.lower(bare).isin(*STOPWORDS) | (F.col(kind).isin("table", "figure") & ~digits) | (F.col(kind).isin("section", "clause", "table", "figure") & ~shaped))


def parameter_key(headers: str, values: str) -> Column:
    """The first non-blank value under a preferred header, else the first
    non-blank value at all; null where no header names a parameter."""
    low = F.transform(headers, lambda h: F.lower(F.trim(h)))
    value = lambda i: F.nullif(F.trim(F.get(F.col(values), i)), F.lit(""))
    picked = [value((F.array_position(low, k) - 1).cast("int")) for k in PARAMETER_KEYS]
    known = F.arrays_overlap(low, F.array(*map(F.lit, PARAMETER_HEADERS)))
    rest = F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != "")
    return F.when(known, F.coalesce(*[F.when(F.array_position(low, k) > 0, p) for k, p in zip(PARAMETER_KEYS, picked)], F.get(rest, F.lit(0))))


def split_keywords(text: str) -> Column:
    """Cleaned, distinct keywords of a list by comma, semicolon or line."""
    from ..functions.text import clean_key

    return F.array_distinct(F.filter(F.transform(F.split(text, r"[,;\n]+"), lambda x: clean_key(F.trim(x))), lambda x: x != ""))


def knows_row(headers: str, tokens: Column) -> Column:
    """Whether at least two distinct header names are an adapter's."""
    from ..functions.text import clean_key

    return F.size(F.array_intersect(F.array_distinct(F.transform(headers, clean_key)), tokens)) >= 2


def corpus_summary(documents: DataFrame, keys: list[str]) -> DataFrame:
    """Status counts, sums and speeds of the documents (status, tables,
    low_tables, pages_per_second) of each run, with their rates."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    rate = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 6)
    s = documents.groupBy(*keys).agg(
        F.count("*").alias("documents"), n("success").alias("success"), n("partial_success").alias("partial"), (F.count("*") - n("success") - n("partial_success")).alias("failed"), F.sum("tables").alias("tables"), F.sum("low_tables").alias("low_tables"),
        F.min("pages_per_second").alias("speed_min"), F.round(F.avg("pages_per_second"), 4).alias("speed_mean"),
    )
    return s.withColumns({"partial_rate": rate("partial", "documents"), "low_table_rate": rate("low_tables", "tables")})


def merged_counts(rows: DataFrame, keys: list[str], counts: str) -> DataFrame:
    """(keys, reason, count): maps of counts added up by reason."""
    return rows.select(*keys, F.explode(counts).alias("reason", "_n")).groupBy(*keys, "reason").agg(F.sum("_n").alias("count"))


def quality_gate(current: DataFrame, baseline: DataFrame, key: str, rising: tuple[str, ...], falling: tuple[str, ...], limits: dict[str, tuple[str, float]]) -> DataFrame:
    """(key, type, metric, baseline, current): metrics of a run that rose or
    fell against its baseline's, and those beyond a limit ("max" or "min").
    Metrics are unpivoted on either side and joined once."""
    def long(df: DataFrame, name: str) -> DataFrame:
        names = [*rising, *falling]
        return df.select(key, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in names])).alias("x")).select(key, "x.*")

    both = long(current, "current").join(long(baseline, "baseline"), [key, "metric"])
    worse = F.when(F.col("metric").isin(*falling), F.col("current") < F.col("baseline")).otherwise(F.col("current") > F.col("baseline"))
    moved = both.filter(worse).select(key, F.lit("baseline_regression").alias("type"), "metric", "baseline", "current")
    beyond = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(v).alias("baseline"), F.col(m).cast("double").alias("current"), (F.col(m) > v if how == "max" else F.col(m) < v).alias("bad")) for m, (how, v) in limits.items()])
    over = current.select(key, F.explode(F.filter(beyond, lambda x: x["bad"])).alias("x")).select(key, F.lit("threshold_failure").alias("type"), "x.metric", "x.baseline", "x.current")
    return moved.unionAll(over)


def followups(signatures: DataFrame, text: str, category: str, key: str) -> DataFrame:
    """(hint, priority, signatures, categories): what the failure signatures
    suggest to do next, by words in their text."""
    low = F.lower(text)
    has = lambda *ws: F.greatest(*[F.locate(w, low) for w in ws]) > 0
    rules = [
        ("appendix_clause_requirement_fixture", "P1", has("appendix", "clause", "heading", "requirement")), ("vendor_requirement_table_fixture", "P1", has("table", "domain_units", "technical", "min_tables", "min_domain_units")),
        ("captionless_diagram_diagnostics", "P2", has("figure", "diagram", "ocr", "caption", "image")), ("conversion_failure_reproducer", "P1", F.col(category) == "conversion_exit_code"),
    ]
    hints = F.filter(F.array(*[F.when(c, F.struct(F.lit(n).alias("hint"), F.lit(p).alias("priority"))) for n, p, c in rules]), lambda x: x.isNotNull())
    each = signatures.select(F.explode(hints).alias("h"), category, key).select("h.*", category, key)
    return each.groupBy("hint", "priority").agg(F.count(key).alias("signatures"), F.array_join(F.array_sort(F.collect_set(category)), ",").alias("categories"))


def integrity(links: DataFrame, manifest: DataFrame, assets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, severity, code, path): image links and manifest images without a
    file, absolute links, and files nobody refers to. All three carry `path`;
    one aggregation by path instead of four anti joins."""
    clean = F.regexp_replace("path", r"^\./", "")
    side = lambda df, n: df.filter(~F.col("path").rlike(r"^(?i)[a-z][a-z0-9+.-]*:")).select(*keys, clean.alias("path"), F.lit(n).alias("side"))
    by = side(links, 1).unionAll(side(manifest, 2)).unionAll(side(assets, 4)).groupBy(*keys, "path").agg(F.bit_or("side").alias("sides"))
    has = lambda n: F.col("sides").bitwiseAND(n) != 0
    rules = [
        ("warning", "absolute_markdown_image_link", has(1) & F.col("path").startswith("/")), ("error", "missing_markdown_image_asset", has(1) & ~has(4)), ("error", "missing_manifest_image_asset", has(2) & ~has(4)),
        ("warning", "orphan_image_asset", has(4) & ~has(1) & ~has(2)),
    ]
    found = F.filter(F.array(*[F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(n).alias("code"))) for s, n, c in rules]), lambda x: x.isNotNull())
    return by.select(*keys, F.explode(found).alias("f"), "path").select(*keys, "f.severity", "f.code", "path")


def sidecar_counts(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, severity, code) where a report's count of a relation (expected,
    omitted) isn't the number of its records (actual: one row a record)."""
    a = actual.groupBy(*keys).agg(F.count("*").alias("n"))
    j = expected.join(a, keys, "left")
    there, n = F.col("n").isNotNull(), F.coalesce("n", F.lit(0))
    rules = [("warning", "omitted_sidecar_present", F.col("omitted") & there), ("error", "missing_counted_sidecar", (F.col("expected") > 0) & ~there), ("error", "sidecar_record_count_mismatch", (n != F.col("expected")) & ((F.col("expected") <= 0) | there))]
    found = F.filter(F.array(*[F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(x).alias("code"))) for s, x, c in rules]), lambda x: x.isNotNull())
    return j.select(*keys, F.explode(found).alias("f")).select(*keys, "f.severity", "f.code")
