"""Boxes as structs or as four columns: x0, top, x1, bottom."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(x0, top, x1, bottom) -> Column:
    return F.greatest(x1 - x0, F.lit(0.0)) * F.greatest(bottom - top, F.lit(0.0))


def overlap(a: str, b: str) -> Column:
    """Area that boxes with column prefixes a and b share."""
    c = lambda p, n: F.col(f"{p}{n}")
    w = F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0"))
    h = F.least(c(a, "bottom"), c(b, "bottom")) - F.greatest(c(a, "top"), c(b, "top"))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: str, b: str) -> Column:
    box = lambda p: area(*(F.col(f"{p}{n}") for n in ("x0", "top", "x1", "bottom")))
    shared = overlap(a, b)
    union = box(a) + box(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def horizontal_overlap(a: str, b: str) -> Column:
    """Shared width over the narrower width."""
    c = lambda p, n: F.col(f"{p}{n}")
    w = F.greatest(F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0")), F.lit(0.0))
    narrow = F.least(c(a, "x1") - c(a, "x0"), c(b, "x1") - c(b, "x0"))
    return F.when(narrow > 0, w / narrow).otherwise(F.lit(0.0))


def union_box(strict: bool = False) -> list[Column]:
    """Aggregates for the union of x0, top, x1, bottom; with strict, null if
    any box is null."""
    whole = F.count_if(F.col("x0").isNull()) == 0
    made = [F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom")]
    return [F.when(whole, m).alias(n) for m, n in zip(made, ("x0", "top", "x1", "bottom"))] if strict else made


def contained(inner: str, outer: str, share: float = 0.9) -> Column:
    own = area(*(F.col(f"{inner}{n}") for n in ("x0", "top", "x1", "bottom")))
    return F.when(own > 0, overlap(inner, outer) / own >= share).otherwise(F.lit(False))
