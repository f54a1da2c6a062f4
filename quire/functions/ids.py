"""Content-derived identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import Words, col

UNIT = "\x1f"


def stable_source_id(source_sha256: Words, first_page: Words, last_page: Words, section_path: Words, source_type: Words, source_id: Words, seed: Words) -> Column:
    """sha1 over the unit-separated parts; `seed` is normalised text."""
    pages = F.concat(F.lit("["), col(first_page).cast("string"), F.lit(","), col(last_page).cast("string"), F.lit("]"))
    return F.sha1(F.concat_ws(UNIT, col(source_sha256), pages, F.coalesce(col(section_path), F.lit("")), col(source_type), col(source_id), F.sha1(col(seed))))


def requirement_seed(source_sha256: Words, section_path: Words, locator: Words, seed: Words) -> Column:
    return F.sha1(F.concat_ws(UNIT, col(source_sha256), F.coalesce(col(section_path), F.lit("")), col(locator), col(seed)))


def dedupe_key(refs: Words) -> Column:
    """Sorted source ids of an array of refs, joined by |; null if none."""
    ids = F.filter(F.transform(col(refs), lambda r: r["source_id"].cast("string")), lambda x: x.isNotNull() & (x != ""))
    return F.nullif(F.array_join(F.array_sort(ids), "|"), F.lit(""))


def primary_ref(refs: Words) -> Column:
    full = F.filter(col(refs), lambda r: r["source_type"].isNotNull() & (r["source_type"] != "") & r["source_id"].isNotNull() & (r["source_id"] != ""))
    return F.coalesce(F.get(full, F.lit(0)), F.get(col(refs), F.lit(0)))


def section_path(path: Words) -> Column:
    return F.array_join(F.filter(col(path), lambda x: F.trim(x) != ""), " > ")


def parent_section(path: Words) -> Column:
    parts = F.split(col(path), " > ")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), " > "))


def section_key(source_type: str, source_id: str) -> Column:
    return F.concat_ws("/", F.col(source_type), F.col(source_id))
