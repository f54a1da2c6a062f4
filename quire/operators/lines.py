"""Page lines: types, margins, fonts, gaps, runs, merges, reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..functions.rules import LINE_TYPE, first_match
from ..functions.text import digit_mask

PAGE_HEIGHT = 792.0


def typed(lines: DataFrame, text: str = "text") -> DataFrame:
    return lines.withColumn("t", F.trim(text)).withColumn("line_type", first_match(LINE_TYPE, "body_line")).drop("t")


def margin(top: str = "top", bottom: str = "bottom", height: float = PAGE_HEIGHT):
    """Whether a line lies in the head or foot margin of its page."""
    return (F.col(top) <= max(85.0, height * 0.11)) | (F.col(bottom) >= height - max(75.0, height * 0.09))


def repeated_keys(lines: DataFrame, doc: list[str], at_least: int = 3, share: float = 0.6) -> DataFrame:
    """Keys of margin lines (12-point band, digits masked) that are on at
    least max(at_least, share) of a document's pages."""
    pages = lines.groupBy(*doc).agg(F.countDistinct("page").alias("pages"))
    keyed = lines.filter(margin()).select(*doc, "page", F.expr("cast(rint(top / 12.0) * 12 as int)").alias("band"), digit_mask("text").alias("key")).filter("char_length(key) >= 2")
    found = keyed.groupBy(*doc, "band", "key").agg(F.countDistinct("page").alias("on_pages"))
    return found.join(pages, doc).filter((F.col("pages") >= at_least) & (F.col("on_pages") >= F.greatest(F.lit(at_least), F.ceil(F.col("pages") * share)))).drop("pages")


def without_repeated(lines: DataFrame, doc: list[str]) -> DataFrame:
    """Lines but the margin lines whose key repeats."""
    keys = repeated_keys(lines, doc).select(*doc, "band", "key")
    keyed = lines.withColumns({"band": F.when(margin(), F.expr("cast(rint(top / 12.0) * 12 as int)")), "key": digit_mask("text")})
    return keyed.join(keys, [*doc, "band", "key"], "left_anti").drop("band", "key")


def body_size(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The commonest font size, the smaller of equals."""
    n = lines.filter("font_size is not null").groupBy(*keys, F.round("font_size", 2).alias("size")).agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.min_by("size", F.struct(-F.col("n"), F.col("size"))).alias("body_size"))


def dominant(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The commonest value, the first seen of equals."""
    n = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("o"))
    return n.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("n"), F.col("o"))).alias(value))


def gaps(lines: DataFrame, keys: list[str], order: str = "line_no") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.greatest(F.col("top") - F.lag("bottom").over(w), F.lit(0.0))
    after = F.greatest(F.lead("top").over(w) - F.col("bottom"), F.lit(0.0))
    # greatest() skips nulls, the ends of a page have no gap
    return lines.withColumns({"gap_before": F.when(F.lag("bottom").over(w).isNotNull(), before), "gap_after": F.when(F.lead("top").over(w).isNotNull(), after)})


def islands(lines: DataFrame, keys: list[str], kind: str, order: str = "line_no") -> DataFrame:
    """`island`: number of the run of equal kinds within a key."""
    w = Window.partitionBy(*keys).orderBy(order)
    change = F.when(F.col(kind).eqNullSafe(F.lag(kind).over(w)), 0).otherwise(1)
    return lines.withColumn("_c", change).withColumn("island", F.sum("_c").over(w)).drop("_c")


def merge_runs(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Body lines joined into runs: the next line starts within 6 points of
    the run's first, lies at most 18 under its lowest, and the run's text
    doesn't end a sentence. An ordered fold over a page."""
    body = typed(lines)
    page = body.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line_no", "line_type", "x0", "top", "bottom", "text"))).alias("xs"))

    @F.pandas_udf("array<struct<line_no:int,run:int>>")
    def fold(batch):
        def one(xs):
            out, run, head, low, end, open_ = [], 0, 0.0, 0.0, "", False
            for x in xs:
                text = x["text"].strip()
                is_body = x["line_type"] == "body_line"
                joins = open_ and is_body and abs(x["x0"] - head) <= 6 and x["top"] - low <= 18 and end not in ".:;?!"
                if not joins:
                    run += 1
                    head, low = x["x0"], x["bottom"]
                low, end, open_ = max(low, x["bottom"]), text[-1:] or "?", is_body
                out.append({"line_no": x["line_no"], "run": run})
            return out

        return batch.map(one)

    placed = page.select(*keys, F.explode(fold("xs")).alias("x")).select(*keys, "x.line_no", "x.run")
    return lines.join(placed, [*keys, "line_no"])


def hyphen_pairs(lines: DataFrame, keys: list[str], order: str = "line_no") -> DataFrame:
    """Lines that end in a letter and a hyphen take the next line in, in
    non-overlapping pairs: of a chain of such lines every other one does."""
    w = Window.partitionBy(*keys).orderBy(order)
    cand = F.col("text").rlike(r"[A-Za-z0-9]-$") & F.lead("text").over(w).rlike(r"^[a-z0-9A-Z]")
    c = lines.withColumns({"_cand": F.coalesce(cand, F.lit(False)), "_next": F.lead("text").over(w)})
    c = islands(c, keys, "_cand", order)
    nth = F.row_number().over(Window.partitionBy(*keys, "island").orderBy(order))
    c = c.withColumn("joins", F.col("_cand") & (nth % 2 == 1))
    taken = F.coalesce(F.lag("joins").over(w), F.lit(False))
    whole = F.when(F.col("joins"), F.concat(F.expr("left(text, char_length(text) - 1)"), F.col("_next"))).otherwise(F.col("text"))
    return c.withColumn("_taken", taken).filter("not _taken").withColumn("text", whole).drop("_cand", "_next", "_taken", "island")


def suppressed(lines: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """Lines without those whose centre is in a region (2 points of slack) or
    that overlap one by an IoU of 0.05. An equi-join by page; the range part
    is its condition."""
    r = regions.select(*keys, *[F.col(c).alias(f"r_{c}") for c in ("x0", "top", "x1", "bottom")])
    j = lines.select(*keys, "line_no", *[F.col(c).alias(f"l_{c}") for c in ("x0", "top", "x1", "bottom")]).join(r, keys)
    cx, cy = (F.col("l_x0") + F.col("l_x1")) / 2, (F.col("l_top") + F.col("l_bottom")) / 2
    inside = cx.between(F.col("r_x0") - 2, F.col("r_x1") + 2) & cy.between(F.col("r_top") - 2, F.col("r_bottom") + 2)
    gone = j.filter(inside | (g.iou("l_", "r_") >= 0.05)).select(*keys, "line_no").distinct()
    return lines.join(gone, [*keys, "line_no"], "left_anti")


def reading_order(lines: DataFrame, keys: list[str], page_width: float = 612.0) -> DataFrame:
    """`position` in reading order: two columns if at least two lines lie
    wholly on each side of the middle, else from the top."""
    side = F.when(F.col("x1") <= page_width / 2, 1).when(F.col("x0") >= page_width / 2, 2).otherwise(0)
    w = Window.partitionBy(*keys)
    s = lines.withColumn("side", side)
    two = (F.count_if(F.col("side") == 1).over(w) >= 2) & (F.count_if(F.col("side") == 2).over(w) >= 2)
    s = s.withColumn("column", F.when(two, F.greatest(F.col("side"), F.lit(1))).otherwise(1)).drop("side")
    return s.withColumn("position", F.row_number().over(w.orderBy("column", "top", "x0", "line_no")))


def captions_once(lines: DataFrame, keys: list[str], distance: float = 30.0) -> DataFrame:
    """Captions but those within `distance` of the last kept one of the same
    text: an ordered fold over equal captions of a page."""
    c = typed(lines).filter("line_type in ('figure_caption', 'table_caption')")
    grouped = c.groupBy(*keys, "text").agg(F.array_sort(F.collect_list(F.struct("top", "line_no"))).alias("xs"))
    start = F.struct(F.lit(-1e9).alias("last"), F.array().cast("array<int>").alias("kept"))
    step = lambda a, x: F.when(x["top"] - a["last"] > distance, F.struct(x["top"].alias("last"), F.concat(a["kept"], F.array(x["line_no"])).alias("kept"))).otherwise(a)
    return grouped.select(*keys, "text", F.explode(F.aggregate("xs", start, step)["kept"]).alias("line_no"))
