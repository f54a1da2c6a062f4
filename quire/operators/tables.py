"""Table grids (arrays of arrays) and typed table rows (headers and cells)."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.batches import giving_back, slices
from ..functions.rules import ERROR_CLASS, HEX, POINTER, RETRY, SCOPE, STATUS_GROUP
from ..functions.text import clean_key
from .semantics import c_sql

# --- grids ---------------------------------------------------------------


def rectangle(grid: Column) -> Column:
    """Cells trimmed and rows padded to the widest."""
    width = F.array_max(F.transform(grid, F.size))
    clean = lambda r: F.transform(r, lambda x: F.trim(F.coalesce(x, F.lit(""))))
    return F.transform(grid, lambda r: F.concat(clean(r), F.array_repeat(F.lit(""), width - F.size(r))))


def compact(grid: Column) -> Column:
    """Columns without any text go."""
    used = F.filter(F.sequence(F.lit(0), F.size(grid[0]) - 1), lambda i: F.exists(grid, lambda r: F.get(r, i) != ""))
    return F.transform(grid, lambda r: F.transform(used, lambda i: F.get(r, i)))


def _filled(cells: Column) -> Column:
    return F.size(F.filter(cells, lambda x: F.trim(x) != ""))


def ratios(grid: Column) -> dict[str, Column]:
    flat, body = F.flatten(grid), F.flatten(F.slice(grid, 2, F.greatest(F.size(grid) - 1, F.lit(0))))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return {
        "empty_ratio": F.when(F.size(flat) > 0, 1 - _filled(flat) / F.size(flat)).otherwise(F.lit(1.0)),
        "header_fill": share(_filled(grid[0]), F.size(grid[0])),
        "density": share(_filled(body), F.size(body)),
        "consistency": share(F.size(F.filter(grid, lambda r: F.size(r) == F.size(grid[0]))), F.size(grid)),
    }


def quality(removed_rows: Column, n_rows: Column, compacted: Column, merged: Column) -> Column:
    """Weighted score of the ratio columns with small bonuses, within 0..1."""
    base = 0.35 * (1 - F.col("empty_ratio")) + 0.2 * (1 - removed_rows / F.greatest(n_rows, F.lit(1))) + 0.15 * (F.col("header_fill") + F.col("consistency") + F.col("density"))
    return F.greatest(F.lit(0.0), F.least(base + F.least(compacted * 0.02, F.lit(0.06)) + F.least(merged * 0.015, F.lit(0.045)), F.lit(1.0)))


def complexity(grid: str) -> Column:
    """Sorted reasons why a grid is no simple table, from the ratio columns."""
    g = F.col(grid)
    rows, width = F.size(g), F.size(g[0])
    cell = lambda p: F.exists(F.flatten(g), p)
    rules = [
        ("ambiguous_grid", (rows < 2) | (width < 2) | (F.col("empty_ratio") > 0.75) | cell(lambda x: F.char_length(F.trim(x)) > 120)),
        ("too_few_rows", rows < 2), ("too_few_columns", width < 2), ("sparse_layout", (width > 12) | (F.col("empty_ratio") > 0.55)), ("overwide_table", width > 12),
        ("header_fragmented", (F.col("header_fill") < 0.4) & (width >= 3)), ("low_data_density", F.col("density") < 0.3), ("multiline_cell", cell(lambda x: F.contains(x, F.lit("\n")))), ("long_cell", cell(lambda x: F.char_length(F.trim(x)) > 120)),
    ]
    return F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules])))


def mode(requested: str, reasons: Column) -> Column:
    simple = F.size(reasons) == 0
    if requested in ("html", "html_only"):
        return F.lit("html")
    return F.lit("markdown") if requested == "markdown" else F.when(simple, "gfm").otherwise("html")


def gfm(grid: str) -> Column:
    g = F.col(grid)
    cell = lambda x: F.replace(F.replace(x, F.lit("\n"), F.lit("<br>")), F.lit("|"), F.lit("\\|"))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.size(g[0])), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(g[0]), rule), F.transform(F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(0))), line)), "\n")


def html(grid: str) -> Column:
    g = F.col(grid)

    def escape(x: Column) -> Column:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            x = F.replace(x, F.lit(a), F.lit(b))
        return x

    row = lambda r, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda x: F.concat(F.lit(f"<{tag}>"), escape(x), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    body = F.array_join(F.transform(F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(0))), lambda r: row(r, "td")), "")
    return F.concat(F.lit("<table><thead>"), row(g[0], "th"), F.lit("</thead><tbody>"), body, F.lit("</tbody></table>"))


def unique_headers(headers: Column) -> Column:
    """Repeated names get a number: Name, Name 2."""
    n = lambda h, i: F.size(F.filter(F.slice(headers, 1, i + 1), lambda x: x == h))
    return F.transform(headers, lambda h, i: F.when(n(h, i) == 1, h).otherwise(F.concat_ws(" ", h, n(h, i).cast("string"))))


def split_notes(grid: Column) -> tuple[Column, Column]:
    """Body without rows that start with "Note", and those rows' texts."""
    is_note = lambda r: F.lower(F.get(r, F.lit(0))).startswith("note")
    notes = F.transform(F.filter(grid, is_note), lambda r: F.trim(F.array_join(F.filter(r, lambda x: F.trim(x) != ""), " ")))
    return F.filter(grid, lambda r: ~is_note(r) & F.exists(r, lambda x: F.trim(x) != "")), notes


def repair(grid: list) -> list:
    """Neighbouring columns that never both hold text in a row become one,
    until nothing changes."""
    changed = True
    while changed and grid and len(grid[0]) > 1:
        changed = False
        for i in range(len(grid[0]) - 1):
            if not any(r[i].strip() and r[i + 1].strip() for r in grid):
                grid = [[*r[:i], r[i].strip() or r[i + 1].strip(), *r[i + 2 :]] for r in grid]
                changed = True
                break
    return grid


def repaired(df: DataFrame, grid: str) -> DataFrame:
    """An iterative step, by Arrow batch."""
    @F.pandas_udf("array<array<string>>")
    def run(batch):
        return batch.map(lambda g: repair([[str(x) for x in r] for r in g]))

    return df.withColumn(grid, run(grid))


# --- candidates ----------------------------------------------------------


def best_per_box(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Of candidates with one box (to 0.1) the best quality, then strategy."""
    box = [F.round(c, 1) for c in ("x0", "top", "x1", "bottom")]
    w = Window.partitionBy(*keys, *box).orderBy(F.desc("quality"), "strategy", "candidate_id")
    return candidates.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def ranked(candidates: DataFrame, keys: list[str], page_area: float, most: int = 20) -> DataFrame:
    """The best `most` of a page by quality plus a bonus for size."""
    area = (F.col("x1") - F.col("x0")) * (F.col("bottom") - F.col("top"))
    rank = F.col("quality") + F.least(0.2 * area / page_area, F.lit(0.1))
    w = Window.partitionBy(*keys).orderBy(rank.desc(), area.desc(), "candidate_id")
    return candidates.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def pruned(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Greedy by rank: a candidate goes if an accepted one contains it to 90 %.
    A page's candidates (at most 20 by rank) are one group."""
    def keep(boxes: list[tuple]) -> set:
        kept = []
        for box in boxes:
            _, x0, top, x1, bottom = box
            area = max((x1 - x0) * (bottom - top), 1e-9)
            if not any(max(0.0, min(x1, k[3]) - max(x0, k[1])) * max(0.0, min(bottom, k[4]) - max(top, k[2])) >= 0.9 * area for k in kept):
                kept.append(box)
        return {k[0] for k in kept}

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in slices(batches, 1000):
            pages = batch.column(0)
            rows = pages.flatten().field("row")
            sides = [rows.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False).tolist() for c in ("x0", "top", "x1", "bottom")]
            boxes = list(zip(rows.field("candidate_id").to_pylist(), *sides))
            ends, start, mask = np.cumsum(pages.value_lengths().to_numpy()).tolist(), 0, []
            for end in ends:
                page, start = boxes[start:end], end
                kept = keep(page)
                mask += [box[0] in kept for box in page]
            left = rows.filter(pa.array(mask, pa.bool_()))
            yield pa.RecordBatch.from_arrays([left.field(c) for c in names], names)

    names = candidates.columns
    pages = candidates.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", F.struct(*names).alias("row")))).alias("rows"))
    return pages.select("rows").mapInArrow(giving_back(run), candidates.schema)


# --- rows ----------------------------------------------------------------


def cell(*names: str, cells: str = "by_key") -> Column:
    """The first non-blank cell among header aliases."""
    keys = [re.sub("[^a-z0-9]+", "", n.lower()) for n in names]
    return F.coalesce(*[F.nullif(F.trim(F.element_at(cells, F.lit(k))), F.lit("")) for k in keys])


def keyed(rows: DataFrame) -> DataFrame:
    """rows with `by_key` (cells by cleaned header) and `row_text`."""
    text = F.array_join(F.filter(F.transform("headers", lambda h: F.when(F.trim(F.element_at("cells", h)) != "", F.concat(h, F.lit(" = "), F.element_at("cells", h)))), lambda x: x.isNotNull()), " | ")
    return rows.withColumns({"by_key": F.map_from_arrays(F.transform("headers", clean_key), F.transform("headers", lambda h: F.element_at("cells", h))), "row_text": text})


#: unit type -> condition over the named cells, in order
UNIT_RULES = [
    ("command_opcode", "command IS NOT NULL AND opcode IS NOT NULL"),
    ("opcode", "opcode IS NOT NULL"),
    ("security_method", "method IS NOT NULL AND uid IS NOT NULL"),
    ("log_page", f"log_id IS NOT NULL AND rx(log_id, '{HEX}')"),
    ("feature_identifier", f"feature_id IS NOT NULL AND rx(feature_id, '{HEX}')"),
    ("status_code", "sct IS NOT NULL AND sc IS NOT NULL"),
    ("command_dword_field", "dword IS NOT NULL AND (field IS NOT NULL OR bits IS NOT NULL OR description IS NOT NULL)"),
    ("register_field", "register IS NOT NULL OR (offset_ IS NOT NULL AND field IS NOT NULL)"),
    ("bitfield", "field IS NOT NULL AND rx(bits, '[0-9]+:[0-9]+')"),
    ("enum_value", "value IS NOT NULL AND description IS NOT NULL"),
    ("requirement_row", "rx(row_text, '(?i)\\bREQ[-A-Z0-9_]*-[0-9]+')"),
]
CELLS = {
    "command": ("Command", "Command Name"), "opcode": ("Opcode", "Combined Opcode"), "method": ("Method", "Method ID"), "uid": ("UID", "Protocol ID"), "log_id": ("Log Identifier", "LID", "Log Page"),
    "feature_id": ("Feature Identifier", "FID"), "sct": ("Status Code Type", "SCT"), "sc": ("Status Code", "SC"), "dword": ("Command Dword", "CDW", "Dword"), "field": ("Field", "Field Name", "Parameter"),
    "bits": ("Bits", "Bit", "Bit Range"), "register": ("Register", "Register Name"), "offset_": ("Offset", "Address"), "value": ("Value",), "description": ("Description", "Definition", "Meaning"),
}


def typed_rows(rows: DataFrame) -> DataFrame:
    """rows with their named cells and `unit_type` (null: not technical)."""
    named = settled(keyed(rows).withColumns({k: cell(*v) for k, v in CELLS.items()}))
    return settled(named.withColumn("unit_type", F.expr(c_sql(UNIT_RULES))))


def settled(df: DataFrame) -> DataFrame:
    """The same rows behind a generator, so that later uses read the columns
    instead of repeating their expressions, which would multiply."""
    return df.select(F.inline(F.array(F.struct("*"))))


def dword(c: str) -> Column:
    n = F.regexp_extract(c, r"(?i)(?:cdw|dword|dw)\s*(\d{1,2})", 1)
    return F.when(n != "", F.concat(F.lit("CDW"), n.cast("int").cast("string"))).when(F.col(c).rlike(r"^\d{1,2}$"), F.concat(F.lit("CDW"), F.col(c).cast("int").cast("string"))).otherwise(F.col(c))


def scope(c: str) -> Column:
    return F.expr(c_sql(SCOPE, t=f"lower({c})"))


def pointer(c: str) -> Column:
    return F.expr(c_sql(POINTER, t=f"lower({c})"))


def status_columns(df: DataFrame) -> DataFrame:
    """group, error_class and retry_hint of (sct, sc, description)."""
    s = df.withColumns({"tt": F.lower("sct"), "kk": clean_key("sct"), "dd": F.lower(F.coalesce("description", F.lit(""))), "zz": F.coalesce(F.lower("sc").rlike("^(0x)?0+h?$"), F.lit(False))})
    s = s.withColumn("status_group", F.coalesce(F.expr(c_sql(STATUS_GROUP, t="tt", k="kk")), F.btrim(F.regexp_replace("tt", "[^a-z0-9]+", "_"), F.lit("_"))))
    s = s.withColumn("error_class", F.coalesce(F.expr(c_sql(ERROR_CLASS, d="dd", z="zz", g="status_group")), F.when(F.col("status_group") != "reserved", F.col("status_group"))))
    return s.withColumn("retry_hint", F.expr(c_sql(RETRY, d="dd", z="zz", e="error_class"))).drop("tt", "kk", "dd", "zz")


def command_relations(rows: DataFrame, scope_keys: list[str], order: str) -> DataFrame:
    """Each row's last command seen so far in its scope."""
    w = Window.partitionBy(*scope_keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    anchor = F.when(F.col("unit_type") == "command_opcode", F.struct("row_id", "command", "opcode"))
    last = F.last(anchor, ignorenulls=True).over(w)
    r = rows.withColumn("anchor", last)
    return r.withColumns({"related_row": F.col("anchor.row_id"), "related_opcode": F.col("anchor.opcode")}).drop("anchor")


def continuations(tables: DataFrame, keys: list[str]) -> DataFrame:
    """A table continues its predecessor if it is on the next page with the
    same header signature; `group_no` numbers the chains."""
    w = Window.partitionBy(*keys).orderBy("page", "table_index")
    follows = (F.col("page") - F.lag("page").over(w) == 1) & (F.col("signature") == F.lag("signature").over(w))
    t = tables.withColumn("continued", F.coalesce(follows, F.lit(False)))
    return t.withColumn("group_no", F.sum((~F.col("continued")).cast("int")).over(w))
