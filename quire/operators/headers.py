"""Header rows of table grids (array<array<string>>, rectangular, trimmed)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tables import unique_headers

HINTS = ("bits", "bytes", "command", "description", "dword", "field", "name", "offset", "opcode", "parameter", "register", "reset", "type", "value")


def filled(row: Column) -> Column:
    return F.size(F.filter(row, lambda x: F.trim(x) != ""))


def width(grid: str) -> Column:
    return F.size(F.col(grid)[0])


def body_density(grid: str, skip: int) -> Column:
    """Share of non-blank cells in the rows after the first `skip`; 0 of none."""
    rows = F.slice(F.col(grid), skip + 1, F.greatest(F.size(grid) - skip, F.lit(0)))
    cells = F.flatten(rows)
    return F.when(F.size(cells) > 0, filled(cells) / F.size(cells)).otherwise(0.0)


def hint_count(row: Column) -> Column:
    """Cells that contain a technical header word."""
    has = lambda x: F.arrays_overlap(F.split(F.lower(F.trim(x)), "[^a-z]+"), F.array(*map(F.lit, HINTS)))
    return F.size(F.filter(row, has))


def realigned(grid: str) -> Column:
    """A header over an empty body column moves over the neighbouring column
    that has a body and no header: left if it is at least as full, else right,
    else left. Columns are taken from left to right, each seeing the moves
    before it."""
    g = F.col(grid)
    n = width(grid)
    body = F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(0)))
    count = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.size(F.filter(body, lambda r: F.trim(F.get(r, i)) != "")))

    def move(state: Column, i: Column) -> Column:
        h, c = state["header"], state["count"]
        at = lambda k: F.coalesce(F.trim(F.get(h, k)), F.lit("x"))
        of = lambda k: F.coalesce(F.get(c, k), F.lit(0))
        left, right = (of(i - 1) > 0) & (at(i - 1) == ""), (of(i + 1) > 0) & (at(i + 1) == "")
        to = F.when((at(i) == "") | (of(i) > 0), -1).when(left & (of(i - 1) >= of(i + 1)), i - 1).when(right, i + 1).when(left, i - 1).otherwise(-1)
        moved = F.transform(h, lambda x, k: F.when(to < 0, x).when(k == to, F.trim(F.get(h, i))).when(k == i, "").otherwise(x))
        return F.struct(moved.alias("header"), c.alias("count"), (state["shifts"] + F.when(to < 0, 0).otherwise(1)).cast("int").alias("shifts"))

    start = F.struct(g[0].alias("header"), count.alias("count"), F.lit(0).alias("shifts"))
    out = F.aggregate(F.sequence(F.lit(0), n - 1), start, move)
    short = (F.size(g) < 2) | (n < 1)
    return F.when(short, F.struct(g.alias("grid"), F.lit(0).alias("shifts"))).otherwise(F.struct(F.concat(F.array(out["header"]), body).alias("grid"), out["shifts"].alias("shifts")))


def promoted(grid: str) -> Column:
    """Of at least three rows with a blank first one, the second becomes the
    header if it is half full, names two technical fields and the body below
    is at least 35 % full. A struct of grid and n (0 or 1)."""
    g = F.col(grid)
    ok = (F.size(g) >= 3) & (filled(g[0]) == 0) & (filled(g[1]) / F.greatest(width(grid), F.lit(1)) >= 0.5) & (hint_count(g[1]) >= 2) & (body_density(grid, 2) >= 0.35)
    return F.when(ok, F.struct(F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(1))).alias("grid"), F.lit(1).alias("n"))).otherwise(F.struct(g.alias("grid"), F.lit(0).alias("n")))


def is_multi_row(grid: str) -> Column:
    """Two header rows: the second at least half full, the first repeats a
    parent or leaves two blanks over children, and the body is 35 % full."""
    g = F.col(grid)
    first, second = F.transform(g[0], lambda x: F.trim(x)), F.transform(g[1], lambda x: F.trim(x))
    repeated = F.exists(F.sequence(F.lit(1), F.greatest(F.size(first) - 1, F.lit(1))), lambda i: (F.get(first, i - 1) != "") & (F.get(first, i - 1) == F.get(first, i)))
    blanks = F.size(F.filter(F.arrays_zip(first.alias("p"), second.alias("c")), lambda z: (z["p"] == "") & (z["c"] != "")))
    half = F.greatest(F.lit(2), F.floor(F.size(second) / 2).cast("int"))
    return (F.size(g) >= 3) & (filled(second) >= half) & (body_density(grid, 2) >= 0.35) & (repeated | (blanks >= 2)) & (filled(first) > 0)


def flattened(grid: str) -> Column:
    """Names of two header rows, repeated ones numbered."""
    return unique_headers(joined(grid))


def joined(grid: str) -> Column:
    """Names of two header rows: parent / child, a blank parent taking the one
    before it where there is a child."""
    g = F.col(grid)
    pairs = F.arrays_zip(F.transform(g[0], lambda x: F.trim(x)).alias("p"), F.transform(g[1], lambda x: F.trim(x)).alias("c"))

    def step(state: Column, z: Column) -> Column:
        parent = F.when(z["p"] != "", z["p"]).when((state["last"] != "") & (z["c"] != ""), state["last"]).otherwise("")
        i = F.size(state["names"]) + 1
        name = F.when((parent != "") & (z["c"] != "") & (parent != z["c"]), F.concat(parent, F.lit(" / "), z["c"])).when(z["c"] != "", z["c"]).when(parent != "", parent).otherwise(F.concat(F.lit("Column "), i.cast("string")))
        return F.struct(F.when(z["p"] != "", z["p"]).otherwise(state["last"]).alias("last"), F.concat(state["names"], F.array(name)).alias("names"))

    out = F.aggregate(pairs, F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("names")), step)
    return out["names"]


def placeholder_ratio(headers: Column) -> Column:
    """Share of names like "Column 3"."""
    return F.when(F.size(headers) > 0, F.round(F.size(F.filter(headers, lambda h: F.trim(F.lower(h)).rlike(r"^column +\d+$"))) / F.size(headers), 4)).otherwise(0.0)


def stub_column(grid: str) -> Column:
    """Whether the first column labels rows: full in the body, without any
    digit-only cell, while some other column has one."""
    g = F.col(grid)
    body = F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(0)))
    number = lambda x: F.trim(x).rlike(r"^[0-9.,%]+$")
    return (F.size(body) > 0) & F.forall(body, lambda r: (F.trim(r[0]) != "") & ~number(r[0])) & F.exists(body, lambda r: F.exists(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), number))


def merged_suspected(grid: str) -> Column:
    """A body row that fills a single cell of at least three columns."""
    g = F.col(grid)
    return F.exists(F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(0))), lambda r: (F.size(r) >= 3) & (filled(r) == 1))


def forced(grid: str) -> Column:
    """The grid as a plain table must have it: blank headers named by place."""
    g = F.col(grid)
    header = F.transform(g[0], lambda x, i: F.when(F.trim(x) == "", F.concat(F.lit("Column "), (i + 1).cast("string"))).otherwise(F.trim(x)))
    return F.concat(F.array(header), F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(0))))
