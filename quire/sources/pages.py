"""Page selection, page text of HTML, and a pluggable page-line source."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def parse_pages(raw: str | None, total: int) -> list[int]:
    """Sorted distinct pages of "1-3,7"; null or blank is all of them."""
    if raw is None or not raw.strip():
        return list(range(1, total + 1))
    out: set[int] = set()
    for part in raw.split(","):
        m = re.fullmatch(r"\s*(\d+)(?:\s*-\s*(\d+))?\s*", part)
        if not m:
            raise ValueError(f"no page range: {part!r}")
        a, b = int(m[1]), int(m[2] or m[1])
        if a > b or a < 1 or b > total:
            raise ValueError(f"page range {part.strip()!r} is reversed or outside 1-{total}")
        out.update(range(a, b + 1))
    return sorted(out)


def sample_pages(pages: list[int], n: int) -> list[int]:
    """n pages spread evenly, both ends among them."""
    if n <= 0 or not pages:
        return []
    if len(pages) <= n:
        return pages
    if n == 1:
        return pages[:1]
    return sorted({pages[round(i * (len(pages) - 1) / (n - 1))] for i in range(n)})


BLOCK = r"(?is)<(h[1-6]|p|li)[^>]*>(.*?)</\1>"


def html_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, block_no, kind, text) of the headings, paragraphs and list
    items of (page_id, html)."""
    # Both groups are taken in order; a backreference keeps them paired.
    kinds, bodies = F.regexp_extract_all("html", F.lit(BLOCK), F.lit(1)), F.regexp_extract_all("html", F.lit(BLOCK), F.lit(2))
    b = pages.select("page_id", F.posexplode(F.arrays_zip(kinds.alias("k"), bodies.alias("b"))).alias("pos", "x"))
    text = F.trim(F.regexp_replace(F.regexp_replace("x.b", r"<[^>]*>", " "), r"\s+", " "))
    kind = F.lower("x.k")
    return b.select("page_id", (F.col("pos") + 1).alias("block_no"), F.when(kind.startswith("h"), "heading").when(kind == "p", "paragraph").otherwise("list").alias("kind"), text.alias("text")).filter("text <> ''")


class PageLines(DataSource):
    """spark.read.format("page_lines"): lines of plain-text pages (pages apart
    by form feeds). Options: path (a file), pages ("1-3,7"), tasks. A decoder
    of another format plugs in by overriding `decode`."""

    @classmethod
    def name(cls) -> str:
        return "page_lines"

    def schema(self) -> str:
        return "page int, line_no int, text string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    @staticmethod
    def decode(path: str) -> list[str]:
        with open(path, encoding="utf-8") as f:
            return f.read().split("\f")


class _Range(InputPartition):
    def __init__(self, pages: list[int]):
        self.pages = pages


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.pages, self.tasks = options["path"], options.get("pages"), int(options.get("tasks", 4))

    def partitions(self) -> list[InputPartition]:
        pages = parse_pages(self.pages, len(PageLines.decode(self.path)))
        n = max(1, min(self.tasks, len(pages)))
        return [_Range(pages[i * len(pages) // n : (i + 1) * len(pages) // n]) for i in range(n)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        try:
            held = PageLines.decode(self.path)
        except (OSError, UnicodeDecodeError) as e:
            yield from ((p, None, None, str(e)) for p in partition.pages)
            return
        for p in partition.pages:
            for i, line in enumerate(held[p - 1].split("\n"), 1):
                if line.strip():
                    yield p, i, line.rstrip(), None
