"""Chunks put together: sibling merges, inherited table context, figure
chunks, retrieval Markdown, agent records, record order, lines and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g

LABEL = r"\b(?:[A-Z]{2,}[A-Z0-9_-]*-\d+|[A-Z]{2,}[0-9]+|[A-Z][A-Za-z]+)\b"
LABEL_CONFIDENCE = 0.65


def merge_siblings(chunks: DataFrame, doc: list[str], order: str, key: list[str], max_tokens: int = 512, kind: str = "text_block") -> DataFrame:
    """Neighbouring text blocks of a document with one merge key become one
    chunk while their joined text fits the budget (four characters a token);
    other chunk types stay and end a run.

    Runs of one key are islands of a window; only within a run texts are
    packed greedily, by an ordered fold over lengths. A merged chunk has the
    first order, joined texts, the union of boxes, the highest priority, the
    distinct refs and the number of sources."""
    w = Window.partitionBy(*doc).orderBy(order)
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    joins = (F.col("chunk_type") == kind) & (F.lag("chunk_type").over(w) == kind) & same
    runs = chunks.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = runs.groupBy(*doc, "_run").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.char_length(F.trim("text")).alias("z")))).alias("xs"))
    start = F.struct(F.lit(0).alias("total"), F.lit(-1).alias("g"), F.array().cast("array<struct<o:bigint,g:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        grown = s["total"] + 2 + x["z"]
        opens = (s["g"] < 0) | (F.floor((grown + 3) / 4) > max_tokens)
        number = F.when(opens, s["g"] + 1).otherwise(s["g"])
        return F.struct(F.when(opens, x["z"]).otherwise(grown).alias("total"), number.alias("g"), F.concat(s["out"], F.array(F.struct(x["o"].cast("bigint").alias("o"), number.alias("g")))).alias("out"))

    placed = sizes.select(*doc, "_run", F.explode(F.aggregate("xs", start, step)["out"]).alias("x")).select(*doc, F.col("x.o").alias(order), F.col("x.g").alias("_grp"))
    box = g.union_box()
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.trim("text").alias("t"), F.col("ref").alias("r"))))
    merged = runs.join(placed, [*doc, order]).groupBy(*doc, "_run", "_grp").agg(F.min(order).alias(order), F.min_by("chunk_type", order).alias("chunk_type"), parts.alias("_p"), F.max("priority").alias("priority"), F.count("*").alias("n_sources"), *box)
    text = F.array_join(F.filter(F.transform("_p", lambda x: x["t"]), lambda t: t != ""), "\n\n")
    return merged.select(*doc, order, "chunk_type", text.alias("text"), F.array_distinct(F.transform("_p", lambda x: x["r"])).alias("refs"), "priority", "n_sources", "x0", "top", "x1", "bottom")


def inherit(rows: DataFrame, tables: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """rows whose blank fields (null, or an empty text) take their table's."""
    t = tables.select(*keys, *[F.col(f).alias(f"_t_{f}") for f in fields])
    own = lambda f: F.nullif(F.col(f), F.lit("")) if dict(rows.dtypes)[f] == "string" else F.col(f)
    return rows.join(t, keys, "left").select(*[F.coalesce(own(c), F.col(f"_t_{c}")).alias(c) if c in fields else F.col(c) for c in rows.columns])


def path_texts(paths: str) -> Column:
    """Distinct texts of header paths (array<array<string>>), parts by " / "."""
    joined = F.transform(paths, lambda p: F.array_join(F.filter(F.transform(p, lambda x: F.trim(x)), lambda x: x != ""), " / "))
    return F.array_distinct(F.filter(joined, lambda x: x != ""))


def rag_markdown(tables: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Row-wise Markdown of each table (keys, page, table_index, source_mode,
    grp, caption, headers) and its rows (row_index, row_text), for retrieval."""
    r = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("row_index", F.concat(F.lit("Row "), "row_index", F.lit(": "), F.coalesce("row_text", F.lit(""))).alias("line")))).alias("_rows"))
    marker = F.concat(F.lit("<!-- table-rag: page="), "page", F.lit(" index="), "table_index", F.lit(" source="), "source_mode", F.when(F.coalesce("grp", F.lit("")) != "", F.concat(F.lit(" group="), "grp")).otherwise(""), F.lit(" -->"))
    head = F.array(marker, F.when(F.coalesce("caption", F.lit("")) != "", F.concat(F.lit("Caption: "), "caption")).otherwise("Caption:"), F.concat(F.lit("Headers: "), F.array_join("headers", " | ")))
    lines = F.coalesce(F.transform("_rows", lambda x: x["line"]), F.array().cast("array<string>"))
    return tables.join(r, keys, "left").select(*keys, F.array_join(F.concat(head, lines), "\n").alias("markdown"))


def agent_shape(document_id: Column, metadata: list[str]) -> Column:
    """A chunk (chunk_id, text, page, section_path) as the agent reads it."""
    citation = F.struct(document_id.alias("document_id"), F.col("chunk_id"), F.col("page").alias("page_number"), F.col("section_path").alias("section_title"), F.col("section_path").alias("heading_path"))
    return F.struct("chunk_id", "text", citation.alias("citation"), F.struct(*metadata).alias("metadata"))


def figure_chunks(figures: DataFrame) -> DataFrame:
    """Text chunks of figures with any evidence: lines, priority and reasons.
    A caption that is not of low confidence makes a diagram weigh more."""
    signals = sum((F.when(F.size(c) > 0, 1).otherwise(0) for c in ("heading_path", "detected_labels", "nearby_texts")), F.when(F.col("caption_text") != "", 1).otherwise(0))
    some = figures.filter(signals > 0)
    captioned, there = F.col("caption_text") != "", lambda c: F.size(c) > 0
    sure = captioned & ~F.coalesce(F.col("caption_confidence") < LABEL_CONFIDENCE, F.lit(False))
    listed = lambda p, c, s: F.when(there(c), F.concat(F.lit(p), F.array_join(c, s)))
    lines = F.filter(F.array(F.when(captioned, F.concat(F.lit("caption: "), "caption_text")), listed("heading_path: ", "heading_path", " > "), F.concat(F.lit("figure_kind: "), "figure_kind"), listed("detected_labels: ", "detected_labels", " | ")), lambda x: x.isNotNull())
    near = F.transform("nearby_texts", lambda x: F.concat(F.lit("nearby_text: "), x))
    reasons = F.array(F.lit("figure_text_boundary"), F.when(captioned, "observed_caption"), F.when(there("heading_path"), "heading_context"), F.lit("figure_kind"), F.when(there("detected_labels"), "detected_labels"), F.when(there("nearby_texts"), "nearby_text"), F.when(~sure, "captionless_or_low_confidence"))
    priority = F.when(sure & F.col("diagram_candidate"), 78).when(sure, 68).otherwise(44)
    return some.select("figure_id", F.array_join(F.array_distinct(F.concat(lines, near)), "\n").alias("text"), priority.alias("priority"), F.filter(reasons, lambda x: x.isNotNull()).alias("reasons"))


def label_diagnostics(captions: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Labels of each figure: those of its caption and of OCR candidates (text,
    confidence) at LABEL_CONFIDENCE or above; numbers of promoted and rejected
    candidates. Equal candidates count once."""
    once = candidates.select(key, "text", "confidence").distinct().withColumn("labels", F.regexp_extract_all("text", F.lit(LABEL), F.lit(0)))
    good = (F.size("labels") > 0) & F.coalesce(F.col("confidence") >= LABEL_CONFIDENCE, F.lit(False))
    per = once.groupBy(key).agg(F.flatten(F.collect_list(F.when(good, F.col("labels")))).alias("_ocr"), F.count("*").alias("candidates"), F.count(F.when(good, 1)).alias("promoted"), F.count(F.when(F.size("labels") == 0, 1)).alias("without_label"), F.count(F.when((F.size("labels") > 0) & ~good, 1)).alias("low_confidence"))
    j = captions.join(per, key, "left").fillna(0, ["candidates", "promoted", "without_label", "low_confidence"])
    labels = F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all("caption_text", F.lit(LABEL), F.lit(0)), F.coalesce("_ocr", F.array().cast("array<string>")))))
    return j.withColumn("labels", labels).select(key, "labels", "candidates", "promoted", "without_label", "low_confidence", F.when((F.col("caption_text") == "") & (F.size("labels") > 0), "captionless_promoted_labels").when(F.col("caption_text") == "", "captionless_diagnostics_only").alias("captionless"))


def locators(refs: str) -> dict[str, Column]:
    """Ids by kind from source refs (source_type, source_id, table_id); of
    several the last one that has it."""
    def last(kind: str, field: str) -> Column:
        has = F.filter(refs, lambda r: (r["source_type"] == kind) & F.coalesce(r[field] != "", F.lit(False)))
        return F.when(F.size(has) > 0, F.element_at(F.transform(has, lambda r: r[field]), -1))

    return {"domain_unit_id": last("domain_unit", "source_id"), "technical_table_unit_id": last("technical_table_unit", "source_id"), "table_row_id": last("table_row", "source_id"), "table_id": last("table_row", "table_id")}


def line_metadata(lines: DataFrame, chars: DataFrame, keys: list[str], width: float, height: float) -> DataFrame:
    """lines (x0, top, x1, bottom) with the commonest font size and name of
    their characters (font_size, font_name, char_no; ties: the first seen), a
    style hint, indents, height and band (18 and 82 %)."""
    def mode(c: str) -> DataFrame:
        n = chars.filter(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count("*").alias("n"), F.min("char_no").alias("f"))
        return n.groupBy(*keys).agg(F.max_by(c, F.struct("n", -F.col("f"))).alias(c))

    low = F.lower("font_name")
    hint = F.concat_ws("+", F.when(low.rlike("courier|mono|code"), "monospace"), F.when(low.rlike("bold|black|heavy"), "bold"), F.when(low.rlike("italic|oblique"), "italic"))
    band = F.when(F.col("bottom") <= height * 0.18, "top").when(F.col("top") >= height * 0.82, "bottom").otherwise("middle")
    j = lines.join(mode("font_size"), keys, "left").join(mode("font_name"), keys, "left")
    return j.select(*keys, "font_size", "font_name", F.when(F.col("font_name").isNotNull(), F.when(hint == "", "regular").otherwise(hint)).alias("style_hint"), F.round(F.greatest(F.col("bottom") - F.col("top"), F.lit(0.0)), 2).alias("line_height"), F.round(F.greatest("x0", F.lit(0.0)), 2).alias("left_indent"), F.round(F.greatest(F.lit(width) - F.col("x1"), F.lit(0.0)), 2).alias("right_indent"), band.alias("y_band"))


def sentence_at(text: str, sentences: Column, start: str, end: str) -> Column:
    """The first sentence whose first occurrence spans start..end (from 0),
    else the trimmed text."""
    spans = F.filter(sentences, lambda s: (F.instr(F.col(text), s) > 0) & (F.instr(F.col(text), s) - 1 <= F.col(start)) & (F.col(end) <= F.instr(F.col(text), s) - 1 + F.char_length(s)))
    return F.coalesce(F.get(spans, F.lit(0)), F.trim(text))


def in_record_order(records: DataFrame, keys: list[str]) -> DataFrame:
    """`place` of records by page (null: 0), top (null: last) and id."""
    w = Window.partitionBy(*keys).orderBy(F.coalesce("page", F.lit(0)), F.coalesce("top", F.lit(1_000_000.0)), F.coalesce("id", F.lit("")))
    return records.withColumn("place", F.row_number().over(w))


def merged_pages(windows: DataFrame, keys: list[str], pages: str) -> DataFrame:
    """Distinct sorted pages of all windows of a document, and their number."""
    return windows.select(*keys, F.explode(pages).alias("_p")).groupBy(*keys).agg(F.array_sort(F.collect_set("_p")).alias("pages")).withColumn("n_pages", F.size("pages"))


def tsv_words(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, word_no, text, conf) of tab-separated OCR output: the header names
    the columns, rows without text are left out."""
    lines = F.split(F.regexp_replace(payload, "\r\n", "\n"), "\n")
    head = F.split(lines[0], "\t")
    at = lambda c: F.array_position(head, c).cast("int") - 1
    rows = payloads.select(key, at("text").alias("_t"), at("conf").alias("_c"), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))).alias("_l"))
    cells = lambda x: F.split(x, "\t")
    words = F.filter(F.transform("_l", lambda x: F.struct(F.trim(F.coalesce(F.get(cells(x), F.col("_t")), F.lit(""))).alias("text"), F.trim(F.coalesce(F.get(cells(x), F.col("_c")), F.lit(""))).alias("conf"))), lambda x: x["text"] != "")
    return rows.select(key, F.posexplode(words).alias("word_no", "w")).select(key, "word_no", "w.text", "w.conf")


def last_marker(units: DataFrame, markers: DataFrame, keys: list[str], text: str, order: str, value: str) -> DataFrame:
    """units with the value of the last marker of the same normalised text."""
    from ..functions.text import collapse

    norm = lambda c: F.lower(collapse(c))
    m = markers.groupBy(*keys, norm(text).alias("_k")).agg(F.max_by(value, order).alias(value))
    return units.withColumn("_k", norm(text)).join(m, [*keys, "_k"], "left").drop("_k")


def iso_date(c: str) -> Column:
    """Dates as yyyy-mm-dd: ISO itself, yyyy/mm/dd or "12 March 2024"; null
    where there is none or no such day."""
    iso = F.regexp_extract(c, r"(\d{4}[-/]\d{1,2}[-/]\d{1,2})", 1)
    named = F.regexp_extract(c, r"(\d{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) \d{4})", 1)
    return F.date_format(F.coalesce(F.try_to_timestamp(F.nullif(F.replace(iso, F.lit("/"), F.lit("-")), F.lit("")), F.lit("yyyy-M-d")), F.try_to_timestamp(F.nullif(named, F.lit("")), F.lit("d MMMM yyyy"))), "yyyy-MM-dd")


def similarity(a: str, b: str) -> Column:
    """Matching-blocks ratio of two texts (2 M / T), by Arrow batch: a
    recursion over longest common parts, which no built-in has."""
    from difflib import SequenceMatcher

    @F.pandas_udf("double")
    def run(x, y):
        import pandas as pd

        return pd.Series([None if p is None or q is None else SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)], dtype="float64")

    return run(F.col(a), F.col(b))
