"""Figures: evidence, confidence, descriptions, structures, headings and
caption links. An evidence row has figure_kind, caption_text, heading_path,
detected_labels, nearby_texts, ocr_texts, diagram_candidate and
caption_confidence; empty arrays and texts are no signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import collapse

LOW_CONFIDENCE = 0.65
STRUCTURES = (
    ("register_map", ("register map", "memory map", "address map")),
    ("register_layout", ("register layout", "bit field", "bitfield", "bits ")),
    ("waveform", ("waveform", "timing diagram", "signal trace", "timing waveform")),
    ("circuit_diagram", ("circuit", "schematic")),
    ("block_diagram", ("block diagram", "blockdiagram", "architecture")),
    ("flow_diagram", ("flow diagram", "flowchart", "process flow")),
    ("table_like_image", ("table-like", "table like", "matrix", "grid layout")),
)
LISTS = ("heading_path", "detected_labels", "nearby_texts", "ocr_texts")


def signal_count() -> Column:
    """How many of the five kinds of evidence there are."""
    return sum((F.when(F.size(c) > 0, 1).otherwise(0) for c in LISTS), F.when(F.col("caption_text") != "", 1).otherwise(0))


def with_confidence(figures: DataFrame) -> DataFrame:
    """figures with signals, confidence, risk and the sorted reasons of their
    review. A caption's own confidence may raise the score to 0.92."""
    base = F.lit(0.42) + 0.1 * F.col("signals") + F.when(F.col("diagram_candidate"), 0.08).otherwise(0.0)
    raised = F.greatest(base, F.least(F.col("caption_confidence"), F.lit(0.92)))
    out = figures.withColumn("signals", signal_count()).withColumn("confidence", F.round(F.least(raised, F.lit(0.95)), 2))
    low, bare = F.col("confidence") < LOW_CONFIDENCE, F.col("caption_text") == ""
    risk = F.when((F.col("confidence") < 0.55) | (F.col("signals") <= 1), "high").when(low | bare, "medium").otherwise("low")
    reasons = F.array(F.lit("visual_pixels_not_interpreted"), F.when(low, "low_classification_confidence"), F.when(bare, "missing_caption"), F.when(F.col("signals") <= 1, "single_evidence_signal"))
    return out.withColumns({"risk": risk, "review_reasons": F.array_sort(F.filter(reasons, lambda x: x.isNotNull()))})


def structure_type() -> Column:
    """The first kind whose words occur in kind, caption, headings or nearby
    texts; else a labelled image is a diagram, others keep their kind."""
    text = F.lower(F.concat_ws(" ", "figure_kind", "caption_text", "heading_path", "nearby_texts"))
    kind = F.when((F.col("figure_kind") == "image") & (F.size("detected_labels") > 0), F.lit("diagram")).otherwise(F.col("figure_kind"))
    for name, words in reversed(STRUCTURES):
        kind = F.when(F.greatest(*[F.locate(w, text) for w in words], F.lit(0), F.lit(0)) > 0, F.lit(name)).otherwise(kind)
    return kind


def _lines(first: list[Column], caption: str, path: str, labels: str, nearby: str, ocr: str) -> Column:
    each = lambda prefix, c: F.transform(F.col(c), lambda x: F.concat(F.lit(prefix), x))
    listed = lambda prefix, c, sep: F.when(F.size(c) > 0, F.concat(F.lit(prefix), F.array_join(c, sep)))
    head = F.array(*first, F.when(F.col("caption_text") != "", F.concat(F.lit(caption), "caption_text")), listed(path, "heading_path", " > "), listed(labels, "detected_labels", " | "))
    return F.array_join(F.concat(F.filter(head, lambda x: x.isNotNull()), each(nearby, "nearby_texts"), each(ocr, "ocr_texts")), "\n")


def description_text() -> Column:
    """What is known of a figure from its context, a line each."""
    return _lines([F.lit("Generated figure description (context-only)."), F.concat(F.lit("Figure kind: "), "figure_kind", F.lit("."))], "Caption: ", "Heading path: ", "Detected labels: ", "Nearby text: ", "Observed OCR text: ")


def structure_text(kind: str = "structure_type") -> Column:
    return _lines([F.concat(F.lit("figure_structure: "), kind)], "caption: ", "heading_path: ", "nodes_or_labels: ", "nearby_text: ", "observed_ocr_text: ")


def hints(figures: DataFrame, key: str) -> DataFrame:
    """One row a pair of neighbouring labels of a figure, numbered from 0."""
    pairs = F.when(F.size("detected_labels") > 1, F.arrays_zip(F.slice("detected_labels", 1, F.size("detected_labels") - 1).alias("a"), F.slice("detected_labels", 2, F.size("detected_labels") - 1).alias("b")))
    return figures.select(key, F.posexplode(pairs).alias("hint_no", "p")).select(key, "hint_no", F.col("p.a").alias("source_label"), F.col("p.b").alias("target_label"))


def nearby_heading(figures: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """figures (keys, figure_id, anchor_line, anchor_top) with the heading of
    the last block of their page at or before the anchor line, else at or above
    the anchor's top, else of the page's first block. blocks: keys,
    block_index, line_max, top, heading. Ties go to the later block. Each rule
    is a union and one window."""
    def last(at: str, order: str) -> DataFrame:
        left = figures.select(*keys, "figure_id", F.col(at).cast("double").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("string").alias("h")).filter("at is not null")
        right = blocks.select(*keys, F.lit(None).cast("long").alias("figure_id"), F.col(order).cast("double").alias("at"), F.lit(0).alias("side"), F.col("block_index").cast("long").alias("b"), F.col("heading").alias("h")).filter("at is not null")
        w = Window.partitionBy(*keys).orderBy("at", "side", "b").rowsBetween(Window.unboundedPreceding, 0)
        return left.unionByName(right).withColumn("found", F.last("h", ignorenulls=True).over(w)).filter("side = 1").select(*keys, "figure_id", F.col("found").alias(f"by_{at}"))

    first = blocks.groupBy(*keys).agg(F.min_by("heading", "block_index").alias("by_page"))
    on = [*keys, "figure_id"]
    out = figures.join(last("anchor_line", "line_max"), on, "left").join(last("anchor_top", "top"), on, "left").join(first, keys, "left")
    return out.select(*figures.columns, F.coalesce("by_anchor_line", "by_anchor_top", "by_page").alias("heading"))


def caption_key(c: str) -> Column:
    return F.lower(collapse(c))


def caption_links(targets: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """targets (keys, target_type, target_id, caption_text, confidence) linked
    to the first caption block (keys, block_id, text) of their page with the
    same text but for case and spaces; without one the target is its own source."""
    held = blocks.groupBy(*keys, caption_key("text").alias("_k")).agg(F.min("block_id").alias("_block"))
    named = targets.filter("trim(caption_text) <> '' and target_id is not null").withColumn("_k", caption_key("caption_text"))
    out = named.join(held, [*keys, "_k"], "left")
    return out.select(
        *keys, F.concat("target_type", F.lit("_caption")).alias("link_type"), "target_type", "target_id",
        F.when(F.col("_block").isNotNull(), "text_block").otherwise(F.col("target_type")).alias("caption_source_type"), F.coalesce("_block", "target_id").alias("caption_source_id"), "confidence",
    )


def crop_near_caption(top: Column, bottom: Column, width: float, height: float) -> list[Column]:
    """x0, top, x1, bottom of the region that a caption belongs to: above a
    caption in the lower part of a page, else below it."""
    margin, tall = max(36.0, width * 0.08), min(220.0, height * 0.35)
    low = top > height * 0.45
    up = F.greatest(top - 8.0, F.lit(1.0))
    down = F.least(bottom + 8.0, F.lit(height - 1.0))
    return [F.lit(margin), F.when(low, F.greatest(F.lit(0.0), up - tall)).otherwise(down), F.lit(width - margin), F.when(low, up).otherwise(F.least(F.lit(height), down + tall))]


def visual_findings(layouts: DataFrame, evidence: DataFrame, descriptions: DataFrame, figures: DataFrame) -> DataFrame:
    """(file, code, record_id): breaches of the visual relations' contract.
    layouts: layout_id, page, region_refs, region_ref_count; evidence:
    evidence_id, target_type, target_id, ref_ids, text_replaced; descriptions:
    description_id, figure_id, ref_ids, generated_text, scope,
    markdown_inserted; figures: figure_id. One pass a relation, one anti join
    for both references."""
    def rules(df: DataFrame, file: str, key: str, checks: list[tuple[str, Column]]) -> DataFrame:
        codes = F.array(*[F.when(c, F.lit(code)) for code, c in checks])
        return df.select(F.lit(file).alias("file"), F.explode(F.filter(codes, lambda x: x.isNotNull())).alias("code"), F.col(key).cast("string").alias("record_id"))

    known = figures.select(F.col("figure_id").alias("_id"), F.lit(True).alias("_known")).distinct()
    e = evidence.join(known, evidence["target_id"] == F.col("_id"), "left")
    d = descriptions.join(known, descriptions["figure_id"] == F.col("_id"), "left")
    is_figure = (F.col("target_type") == "figure") & F.col("target_id").isNotNull()
    lacks = lambda c: ~F.coalesce(F.array_contains("ref_ids", F.col(c)), F.lit(False))
    return (
        rules(layouts, "page_layout", "layout_id", [
            ("missing_layout_id", F.col("layout_id").isNull()), ("invalid_layout_page", F.col("page").isNull()), ("invalid_layout_region_refs", F.col("region_refs").isNull()),
            ("layout_region_ref_count_mismatch", F.col("region_refs").isNotNull() & (F.col("region_ref_count") != F.size("region_refs"))),
        ])
        .unionAll(rules(e, "ocr_evidence", "evidence_id", [
            ("missing_evidence_id", F.col("evidence_id").isNull()), ("ocr_evidence_unresolved_figure", is_figure & F.col("_known").isNull()),
            ("ocr_evidence_missing_figure_source_ref", is_figure & lacks("target_id")), ("ocr_evidence_replaced_source_text", F.coalesce("text_replaced", F.lit(False))),
        ]))
        .unionAll(rules(d, "descriptions", "description_id", [
            ("missing_description_figure_id", F.col("figure_id").isNull()), ("description_unresolved_figure", F.col("figure_id").isNotNull() & F.col("_known").isNull()),
            ("description_missing_figure_source_ref", F.col("_known").isNotNull() & lacks("figure_id")), ("description_missing_generated_text_flag", ~F.coalesce("generated_text", F.lit(False))),
            ("description_generated_content_scope_violation", ~F.coalesce((F.col("scope") == "sidecar_only") & ~F.col("markdown_inserted"), F.lit(False))),
        ]))
    )
