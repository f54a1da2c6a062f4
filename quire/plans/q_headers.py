"""Queries of header rows, over small grids made of orders."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import headers as op
from ..operators import tables as tab
from ..session import table
from .registry import query

GRID = """SELECT o_orderkey AS grid_id, CASE o_orderkey % 6 WHEN 0 THEN {{'', 'Field', '', 'Note'}, {concat('f', o_custkey), '', '7', ''}, {'g', '', '9', 'x'}}
 WHEN 1 THEN {{'', '', '', ''}, {'Field', 'Bits', 'Type', ''}, {'a', '3', CAST(o_custkey AS STRING), ''}, {'b', '', '', 'q'}}
 WHEN 2 THEN {{'Group', 'Group', '', 'Z'}, {'A', 'B', 'C', ''}, {'1', '2', '3', CAST(o_custkey AS STRING)}, {'4', '', '6', ''}}
 WHEN 3 THEN {{'Column 1', 'Name', 'column  2', 'Z'}, {'alone', '', '', ''}, {'k', '5', '', '8'}}
 WHEN 4 THEN {{'Label', 'Count', 'Share', ''}, {'one', '1', '2%', ''}, {'two', CAST(o_custkey AS STRING), '', ''}} ELSE {{'A', '', '', ''}, {'', 'b', 'c', ''}, {'', 'd', '', CAST(o_custkey AS STRING)}} END AS grid FROM orders"""
GRID_SQL = "g AS (" + GRID.replace("{", "[").replace("}", "]").replace("AS STRING", "AS VARCHAR") + ")"


def grids(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(re.sub(r"\{", "array(", GRID).replace("}", ")").replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders"))


def _show(grid) -> F.Column:
    return F.array_join(F.transform(grid, lambda r: F.array_join(r, "/")), ";")


_JOIN = lambda g: f"array_to_string(list_transform({g}, lambda r: array_to_string(r, '/')), ';')"
_FULL = lambda r: f"len(list_filter({r}, lambda x: trim(x) <> ''))"
_DENSE = f"(CASE WHEN len(grid) > 2 THEN {_FULL('flatten(grid[3:])')} / len(flatten(grid[3:])) ELSE 0 END)"
_HINT = "len(list_filter(grid[2], lambda x: len(list_intersect(string_split_regex(lower(trim(x)), '[^a-z]+'), [" + ", ".join(f"'{h}'" for h in op.HINTS) + "])) > 0))"

# The moves one column after the other, as a recursion over places.
_AT = lambda k: f"coalesce(trim(CASE WHEN {k} > 0 THEN h[{k}] END), 'x')"
_OF = lambda k: f"coalesce(CASE WHEN {k} > 0 THEN c[{k}] END, 0)"
_LEFT, _RIGHT = f"({_OF('i - 1')} > 0 AND {_AT('i - 1')} = '')", f"({_OF('i + 1')} > 0 AND {_AT('i + 1')} = '')"
_TO = f"CASE WHEN {_AT('i')} = '' OR {_OF('i')} > 0 THEN 0 WHEN {_LEFT} AND {_OF('i - 1')} >= {_OF('i + 1')} THEN i - 1 WHEN {_RIGHT} THEN i + 1 WHEN {_LEFT} THEN i - 1 ELSE 0 END"


@query(f"""WITH RECURSIVE {GRID_SQL}, s AS (SELECT grid_id, 1 AS i, grid[1] AS h, list_transform(range(1, 5), lambda k: len(list_filter(grid[2:], lambda r: trim(r[k]) <> ''))) AS c, 0 AS shifts FROM g UNION ALL
SELECT grid_id, i + 1, CASE WHEN t = 0 THEN h ELSE list_transform(range(1, 5), lambda k: CASE WHEN k = t THEN trim(h[i]) WHEN k = i THEN '' ELSE h[k] END) END, c, shifts + CASE WHEN t = 0 THEN 0 ELSE 1 END FROM (SELECT *, {_TO} AS t FROM s WHERE i <= 4))
SELECT s.grid_id, CAST(shifts AS INT) AS shifts, {_JOIN('list_concat([h], grid[2:])')} AS cells FROM s JOIN g ON s.grid_id = g.grid_id WHERE i = 5""")
def header_realign(spark: SparkSession, d: str) -> DataFrame:
    r = grids(spark, d).withColumn("r", op.realigned("grid"))
    return r.select("grid_id", F.col("r.shifts").alias("shifts"), _show(F.col("r.grid")).alias("cells"))


@query(f"""WITH {GRID_SQL}, p AS (SELECT *, len(grid) >= 3 AND {_FULL('grid[1]')} = 0 AND {_FULL('grid[2]')} / 4 >= 0.5 AND {_HINT} >= 2 AND {_DENSE} >= 0.35 AS ok FROM g) SELECT grid_id, CASE WHEN ok THEN 1 ELSE 0 END AS promoted, {_JOIN('CASE WHEN ok THEN grid[2:] ELSE grid END')} AS cells FROM p""")
def header_promote(spark: SparkSession, d: str) -> DataFrame:
    p = grids(spark, d).withColumn("p", op.promoted("grid"))
    return p.select("grid_id", F.col("p.n").alias("promoted"), _show(F.col("p.grid")).alias("cells"))


_REP = "len(list_filter([1, 2, 3], lambda i: trim(grid[1][i]) <> '' AND trim(grid[1][i]) = trim(grid[1][i + 1]))) > 0"
_BLANK = "len(list_filter([1, 2, 3, 4], lambda i: trim(grid[1][i]) = '' AND trim(grid[2][i]) <> '')) >= 2"
_PAR = "CASE WHEN trim(grid[1][i]) <> '' THEN trim(grid[1][i]) WHEN trim(grid[2][i]) <> '' THEN coalesce(list_filter(list_reverse(grid[1][:i]), lambda x: trim(x) <> '')[1], '') ELSE '' END"


@query(f"""WITH {GRID_SQL}, n AS (SELECT *, {_FULL('grid[2]')} >= 2 AND len(grid) >= 3 AND {_DENSE} >= 0.35 AND ({_REP} OR {_BLANK}) AND {_FULL('grid[1]')} > 0 AS multi,
list_transform([1, 2, 3, 4], lambda i: CASE WHEN {_PAR} <> '' AND trim(grid[2][i]) <> '' AND {_PAR} <> trim(grid[2][i]) THEN concat({_PAR}, ' / ', trim(grid[2][i])) WHEN trim(grid[2][i]) <> '' THEN trim(grid[2][i]) WHEN {_PAR} <> '' THEN {_PAR} ELSE concat('Column ', i) END) AS hs FROM g)
SELECT grid_id, multi, array_to_string(list_transform(hs, lambda x, i: CASE WHEN len(list_filter(hs[:i], lambda y: y = x)) = 1 THEN x ELSE concat(x, ' ', len(list_filter(hs[:i], lambda y: y = x))) END), ',') AS headers,
round(len(list_filter(grid[1], lambda x: regexp_matches(trim(lower(x)), '^column +\\d+$'))) / 4, 4) AS placeholder_ratio,
len(list_filter(grid[2:], lambda r: trim(r[1]) <> '' AND NOT regexp_matches(trim(r[1]), '^[0-9.,%]+$'))) = len(grid) - 1 AND len(list_filter(flatten(list_transform(grid[2:], lambda r: r[2:])), lambda x: regexp_matches(trim(x), '^[0-9.,%]+$'))) > 0 AS stub,
len(list_filter(grid[2:], lambda r: {_FULL('r')} = 1)) > 0 AS merged FROM n""")
def header_shape(spark: SparkSession, d: str) -> DataFrame:
    return grids(spark, d).select(
        "grid_id", op.is_multi_row("grid").alias("multi"), F.array_join(op.flattened("grid"), ",").alias("headers"), op.placeholder_ratio(F.col("grid")[0]).alias("placeholder_ratio"), op.stub_column("grid").alias("stub"), op.merged_suspected("grid").alias("merged")
    )


@query(f"""WITH {GRID_SQL}, f AS (SELECT grid_id, list_concat([list_transform(grid[1], lambda x, i: CASE WHEN trim(x) = '' THEN concat('Column ', i) ELSE trim(x) END)], grid[2:]) AS f FROM g)
SELECT grid_id, concat('| ', array_to_string(f[1], ' | '), ' |', chr(10), '| --- | --- | --- | --- |', chr(10), array_to_string(list_transform(f[2:], lambda r: concat('| ', array_to_string(r, ' | '), ' |')), chr(10)), CASE WHEN grid_id % 3 = 0 THEN concat(chr(10), chr(10), 'Note ', grid_id) ELSE '' END) AS markdown FROM f""")
def forced_markdown(spark: SparkSession, d: str) -> DataFrame:
    notes = F.when(F.col("grid_id") % 3 == 0, F.array(F.concat(F.lit("Note "), "grid_id"), F.lit(" "))).otherwise(F.array().cast("array<string>"))
    g = grids(spark, d).withColumn("f", op.forced("grid")).withColumn("notes", F.filter(notes, lambda x: F.trim(x) != ""))
    return g.select("grid_id", F.concat(tab.gfm("f"), F.when(F.size("notes") > 0, F.concat(F.lit("\n\n"), F.array_join("notes", "\n"))).otherwise("")).alias("markdown"))


@query("""WITH c AS (SELECT l_orderkey AS page, l_linenumber % 3 AS strategy, l_tax > 0.07 AS unresolved, 0.6 + l_discount * 3 AS header_confidence, l_tax * 3 AS empty_ratio, CASE WHEN l_quantity > 48 THEN 0.25 ELSE 0 END AS placeholder FROM lineitem)
SELECT page, bool_and(NOT unresolved AND header_confidence >= 0.75 AND empty_ratio <= 0.25 AND placeholder <= 0) AS skip_others FROM c WHERE strategy = 0 GROUP BY page""")
def adaptive_skip(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_linenumber") % 3).alias("strategy"), (F.col("l_tax") > 0.07).alias("unresolved"), (0.6 + F.col("l_discount") * 3).alias("header_confidence"), (F.col("l_tax") * 3).alias("empty_ratio"), F.when(F.col("l_quantity") > 48, 0.25).otherwise(0.0).alias("placeholder"))
    good = ~F.col("unresolved") & (F.col("header_confidence") >= 0.75) & (F.col("empty_ratio") <= 0.25) & (F.col("placeholder") <= 0)
    return c.filter("strategy = 0").groupBy("page").agg(F.bool_and(good).alias("skip_others"))
