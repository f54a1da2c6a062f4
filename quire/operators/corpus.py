"""Corpus level: snapshots and their differences, reuse, impact, windows of
pages and their merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def diff(previous: DataFrame, current: DataFrame, key: str = "doc_id", sha: str = "sha") -> DataFrame:
    """added, removed, changed or unchanged by key; one full outer join."""
    p = previous.select(key, F.col(sha).alias("previous_sha"))
    c = current.select(key, F.col(sha).alias("current_sha"))
    status = F.when(F.col("previous_sha").isNull(), "added").when(F.col("current_sha").isNull(), "removed").when(F.col("previous_sha") == F.col("current_sha"), "unchanged").otherwise("changed")
    return p.join(c, key, "full_outer").select(key, status.alias("status"), "previous_sha", "current_sha")


def to_convert(current: DataFrame, previous: DataFrame, done: DataFrame, key: str = "doc_id", sha: str = "sha") -> DataFrame:
    """Documents without a reusable result: their hash is unknown to the
    previous snapshot or its output is not among `done`."""
    reusable = previous.join(done.select(key), key, "left_semi").select(key, sha)
    return current.join(reusable, [key, sha], "left_anti")


def ordered_distinct(value: str, order: str) -> Column:
    """Distinct values in order; a group is one requirement of one document."""
    seen = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"])
    return F.array_distinct(F.filter(seen, lambda v: v.isNotNull()))


def impact(previous: DataFrame, current: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Added, removed and changed requirements; unchanged ones are left out.
    fields are array columns of both sides; changed_fields names those that
    differ."""
    p = previous.select(*keys, F.lit(True).alias("_p"), *[F.col(f).alias(f"previous_{f}") for f in fields])
    c = current.select(*keys, F.lit(True).alias("_c"), *[F.col(f).alias(f"current_{f}") for f in fields])
    j = p.join(c, keys, "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"previous_{f}").eqNullSafe(F.col(f"current_{f}")), F.lit(f)) for f in fields]))
    status = F.when(F.col("_p").isNull(), "added").when(F.col("_c").isNull(), "removed").when(F.size(changed) > 0, "changed").otherwise("unchanged")
    return j.withColumns({"changed_fields": changed, "status": status}).filter("status <> 'unchanged'").drop("_p", "_c")


def recommendation(status: str = "status", fields: str = "changed_fields") -> Column:
    return (
        F.when(F.col(status) == "added", "review_new_requirement")
        .when(F.col(status) == "removed", "confirm_removal")
        .when(F.array_contains(fields, "strength"), "reassess_compliance")
        .when(F.array_contains(fields, "text"), "review_text_change")
        .otherwise("check_references")
    )


def duplicate_stems(files: DataFrame, name: str = "name") -> DataFrame:
    """File stems that occur more than once, whatever their case."""
    stem = F.lower(F.regexp_replace(name, r"\.[^.]*$", ""))
    return files.groupBy(stem.alias("stem")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(name)).alias("names")).filter("n > 1")


def page_windows(pages: DataFrame, keys: list[str], size: int, page: str = "page") -> DataFrame:
    """Batches of `size` selected pages: window_id pages-0001-0100."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(page))
    w = pages.select(*keys, page).distinct().withColumn("window_no", F.floor((nth - 1) / size) + 1)
    g = w.groupBy(*keys, "window_no").agg(F.min(page).alias("first_page"), F.max(page).alias("last_page"), F.count("*").alias("n_pages"))
    return g.withColumn("window_id", F.format_string("pages-%04d-%04d", F.col("first_page").cast("int"), F.col("last_page").cast("int")))


def page_ranges(pages: DataFrame, keys: list[str], page: str = "page") -> DataFrame:
    """Consecutive pages as text: 1-3,7."""
    p = pages.select(*keys, page).distinct()
    island = F.col(page) - F.row_number().over(Window.partitionBy(*keys).orderBy(page))
    runs = p.withColumn("island", island).groupBy(*keys, "island").agg(F.min(page).alias("a"), F.max(page).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    return runs.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("a"), text.alias("t")))), lambda x: x["t"]), ",").alias("ranges"))


def scoped_ids(records: DataFrame, keys: list[str], field: str, window: str) -> DataFrame:
    """`new_id`: ids that several windows use get their window in front."""
    used = records.groupBy(*keys, field).agg(F.countDistinct(window).alias("_n"))
    new = F.when(F.col("_n") > 1, F.concat_ws("__", window, field)).otherwise(F.col(field))
    return records.join(used, [*keys, field]).withColumn("new_id", new).drop("_n")


def rewrite_refs(refs: DataFrame, ids: DataFrame, keys: list[str], window: str, field: str) -> DataFrame:
    """References follow their target's new id; unknown targets are dropped."""
    known = ids.select(*keys, window, F.col(field).alias("target"), F.col("new_id").alias("new_target")).distinct()
    return refs.join(known, [*keys, window, "target"])


def inventory(records: DataFrame, file: str, window: str, size: str) -> DataFrame:
    """Rows and bytes by file, by window and in all, in one pass."""
    return records.groupingSets([[F.col(file)], [F.col(window)], []], file, window).agg(F.count("*").alias("n_rows"), F.sum(size).alias("bytes"))


def merge_order(records: DataFrame) -> DataFrame:
    """Order of merged records: page, top (a million if unknown), window,
    line, id. `position` is per document."""
    w = Window.partitionBy("doc_id").orderBy(F.coalesce("page", F.lit(0)), F.coalesce("top", F.lit(1e6)), "window_no", "line_no", "record_id")
    return records.withColumn("position", F.row_number().over(w))


def merged_report(windows: DataFrame, keys: list[str]) -> DataFrame:
    """One report of the windows': the span, summed duration, worst status."""
    status = F.when(F.bool_or(F.col("status") == "failed"), "failed").when(F.bool_or(F.col("status") == "partial"), "partial").otherwise("success")
    return windows.groupBy(*keys).agg(F.min("started").alias("started"), F.max("finished").alias("finished"), F.sum("duration_ms").alias("duration_ms"), status.alias("status"), F.bool_or("used_ocr").alias("used_ocr"), F.count("*").alias("n_windows"))
