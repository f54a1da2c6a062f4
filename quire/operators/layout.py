"""Blocks, headings, captions and figures of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..functions.rules import FIGURE_KIND
from .semantics import c_sql


def heading_paths(headings: DataFrame, keys: list[str], order: str) -> DataFrame:
    """`path`: path = path[:level - 1] + [text], carried over a document. The
    cut is by position, so a skipped level nests. An ordered fold a document."""
    h = headings.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "level", "text"))).alias("xs"))

    @F.pandas_udf("array<struct<o:bigint,path:string>>")
    def fold(batch):
        def one(xs):
            path, out = [], []
            for x in xs:
                path = path[: x["level"] - 1] + [x["text"]]
                out.append({"o": x["o"], "path": " > ".join(path)})
            return out

        return batch.map(one)

    return h.select(*keys, F.explode(fold("xs")).alias("x")).select(*keys, F.col("x.o").alias(order), "x.path")


def parent_headings(headings: DataFrame, keys: list[str], order: str, most: int = 6) -> DataFrame:
    """`parent`: the nearest open heading of a lower level. Opening a level
    closes the deeper ones, so a level's last heading counts only if nothing
    shallower came after it."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    h = headings
    last = {k: F.last(F.when(F.col("level") == k, F.col(order)), ignorenulls=True).over(w) for k in range(1, most)}
    h = h.withColumns({f"_l{k}": c for k, c in last.items()})
    parent = F.lit(None).cast("bigint")
    for k in range(1, most):
        shut = F.greatest(*[F.coalesce(F.col(f"_l{j}"), F.lit(-1)) for j in range(1, k)], F.lit(-1), F.lit(-1))
        parent = F.when((F.col("level") > k) & F.col(f"_l{k}").isNotNull() & (F.col(f"_l{k}") > shut), F.col(f"_l{k}")).otherwise(parent)
    return h.withColumn("parent", parent).drop(*[f"_l{k}" for k in range(1, most)])


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """left with the value of the last right row at or before `at` in its key,
    else the first one's. A union and one window: no range join."""
    l = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType)})
    r = right.select(*keys, at, F.lit(0).alias("_side"), F.col(value).alias("_v"))
    u = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    u = u.withColumn(value, F.coalesce(F.last("_v", ignorenulls=True).over(w), F.first("_v", ignorenulls=True).over(whole)))
    return u.filter("_side = 1").drop("_side", "_v")


def nearest_captions(boxes: DataFrame, captions: DataFrame, keys: list[str], above: float = 48.0, below: float = 24.0) -> DataFrame:
    """Each box's nearest caption of its page: horizontal overlap of at least
    a quarter, above within 48 points or below within 24 (12 points farther)."""
    c = captions.select(*keys, *[F.col(n).alias(f"c_{n}") for n in ("x0", "top", "x1", "bottom")], F.col("line_no").alias("caption_line"))
    b = boxes.select(*keys, "box_id", *[F.col(n).alias(f"b_{n}") for n in ("x0", "top", "x1", "bottom")])
    up, down = F.col("b_top") - F.col("c_bottom"), F.col("c_top") - F.col("b_bottom")
    distance = F.when((up >= 0) & (up <= above), up).when((down >= 0) & (down <= below), down + 12)
    j = b.join(c, keys).filter(g.horizontal_overlap("b_", "c_") >= 0.25).withColumn("distance", distance).filter("distance is not null")
    return j.groupBy(*keys, "box_id").agg(F.min(F.struct("distance", "caption_line")).alias("m")).select(*keys, "box_id", "m.caption_line", "m.distance")


def anchors(blocks: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Position of the first line (in reading order) at or under a block's
    top, the number of lines if there is none."""
    l = lines.select(*keys, "position", F.col("top").alias("l_top"))
    n = lines.groupBy(*keys).agg(F.count("*").alias("n"))
    j = blocks.join(l, keys).groupBy(*keys, "box_id", F.col("top").alias("b_top")).agg(F.min(F.when(F.col("l_top") >= F.col("top"), F.col("position"))).alias("first"))
    return j.join(n, keys).select(*keys, "box_id", F.coalesce("first", F.col("n") + 1).alias("anchor"))


def page_layout(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by kind and the content box of a page."""
    kinds = [F.count_if(F.col("line_type") == k).alias(f"n_{k}") for k in ("heading_index", "list_item", "table_caption", "body_line")]
    return lines.groupBy(*keys).agg(F.count("*").alias("n_lines"), *kinds, *g.union_box())


def figure_kind(text: str) -> Column:
    return F.expr(c_sql(FIGURE_KIND, "image", t=f"lower({text})"))


def deduplicated_images(images: DataFrame, order: list[str]) -> DataFrame:
    """Frequency of an image's hash, and the first path of equal ones."""
    # An aggregation and a join: a window would hold all copies of one image.
    of = images.groupBy("sha").agg(F.count("*").alias("frequency"), F.min_by("path", F.struct(*order)).alias("canonical"))
    i = images.join(of, "sha").select(*images.columns, "frequency", "canonical")
    tiny = ((F.col("height") <= 8) | (F.col("width") <= 16)) & ~F.col("captioned")
    repeated = ((F.col("height") <= 10) | (F.col("width") <= 20)) & (F.col("frequency") >= 2) & ~F.col("captioned")
    return i.withColumn("decorative", tiny | repeated)


def ocr_metrics(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and median confidence and the share under 60 of valid tokens."""
    c = F.col("confidence")
    return tokens.filter(c >= 0).groupBy(*keys).agg(F.round(F.avg(c), 4).alias("mean"), F.percentile(c, 0.5).alias("median"), F.round(F.avg((c < 60).cast("int")), 4).alias("low_ratio"))


def votes(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Votes and mean confidence of each candidate text, ranked."""
    v = candidates.groupBy(*keys, "text").agg(F.count("*").alias("votes"), F.round(F.avg("confidence"), 6).alias("confidence"))
    return v.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("votes"), F.desc("confidence"), "text")))


def siblings(markers: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A missing marker between siblings that differ by two is their middle,
    else one more than the previous."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    p, n = F.last("marker", ignorenulls=True).over(before), F.first("marker", ignorenulls=True).over(after)
    m = markers.withColumns({"_p": p, "_n": n})
    value = F.coalesce("marker", F.when(F.col("_n") - F.col("_p") == 2, F.col("_p") + 1), F.col("_p") + 1)
    reason = F.when(F.col("marker").isNotNull(), "exact").when(F.col("_n") - F.col("_p") == 2, "sibling_midpoint").when(F.col("_p").isNotNull(), "previous_plus_one").otherwise("no_candidate")
    return m.withColumns({"recovered": value, "reason": reason}).drop("_p", "_n")


def ocr_status(available: str, attempted: str, text: str, confidence: str, threshold: float = 0.65) -> Column:
    return (
        F.when(~F.col(available), "runtime_unavailable").when(~F.col(attempted), "not_attempted").when(F.coalesce(F.trim(text), F.lit("")) == "", "rejected_empty")
        .when(F.col(confidence).isNull(), "rejected_missing_confidence").when(F.col(confidence) < threshold, "rejected_low_confidence").otherwise("accepted")
    )
