"""Table queries: grids from parts and suppliers, typed rows from parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import ERROR_CLASS, POINTER, RETRY, SCOPE, STATUS_GROUP
from ..operators import tables as op
from ..session import parts, table
from .corpus_data import ROWS_SQL, rows, sql_cell
from .registry import query, sql_case

NAMED_SQL = f"""{ROWS_SQL}, named AS (SELECT *, array_to_string(list_filter(list_transform(headers, lambda h, i: CASE WHEN trim(vals[i]) <> '' THEN concat(h, ' = ', vals[i]) END), lambda x: x IS NOT NULL), ' | ') AS row_text,
 {', '.join(f'{sql_cell(*v)} AS {k}' for k, v in op.CELLS.items())} FROM tab), typed AS (SELECT *, {sql_case(op.UNIT_RULES)} AS unit_type FROM named)"""


@query(f"WITH {NAMED_SQL} SELECT row_id, table_id, page, row_index, row_text, unit_type FROM typed")
def table_row_text(spark: SparkSession, d: str) -> DataFrame:
    return op.typed_rows(rows(spark, d)).select("row_id", "table_id", "page", "row_index", "row_text", "unit_type")


@query(f"""WITH {NAMED_SQL}, s AS (SELECT row_id, sct, sc, description, lower(sct) AS tt, regexp_replace(lower(sct), '[^a-z0-9]+', '', 'g') AS kk, lower(coalesce(description, '')) AS dd, coalesce(regexp_matches(lower(sc), '^(0x)?0+h?$'), false) AS zz FROM typed WHERE unit_type = 'status_code'),
g AS (SELECT *, coalesce({sql_case(STATUS_GROUP, t='tt', k='kk')}, trim(regexp_replace(tt, '[^a-z0-9]+', '_', 'g'), '_')) AS status_group FROM s),
e AS (SELECT *, coalesce({sql_case(ERROR_CLASS, d='dd', z='zz', g='status_group')}, CASE WHEN status_group <> 'reserved' THEN status_group END) AS error_class FROM g)
SELECT row_id, sct, sc, status_group, error_class, {sql_case(RETRY, d='dd', z='zz', e='error_class')} AS retry_hint FROM e""")
def status_code_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    r = op.typed_rows(rows(spark, d)).filter("unit_type = 'status_code'").select("row_id", "sct", "sc", "description")
    return op.status_columns(r).drop("description")


@query(f"""WITH {NAMED_SQL}, n AS (SELECT row_id, dword, description, nullif(regexp_extract(dword, '(?i)(?:cdw|dword|dw)\\s*(\\d{{1,2}})', 1), '') AS n FROM typed WHERE unit_type = 'command_dword_field')
SELECT row_id, CASE WHEN n IS NOT NULL THEN concat('CDW', CAST(n AS INT)) ELSE dword END AS dword, {sql_case(SCOPE, t='lower(description)')} AS scope, {sql_case(POINTER, t='lower(description)')} AS pointer_type FROM n""")
def command_dwords(spark: SparkSession, d: str) -> DataFrame:
    r = op.typed_rows(rows(spark, d)).filter("unit_type = 'command_dword_field'")
    return r.select("row_id", op.dword("dword").alias("dword"), op.scope("description").alias("scope"), op.pointer("description").alias("pointer_type"))


@query(f"""WITH {NAMED_SQL} SELECT row_id, page, unit_type, last_value(CASE WHEN unit_type = 'command_opcode' THEN row_id END IGNORE NULLS) OVER w AS related_row, last_value(CASE WHEN unit_type = 'command_opcode' THEN opcode END IGNORE NULLS) OVER w AS related_opcode
FROM typed WINDOW w AS (PARTITION BY page ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def command_relationships(spark: SparkSession, d: str) -> DataFrame:
    r = op.typed_rows(rows(spark, d)).select("row_id", "page", "unit_type", "command", "opcode")
    return op.command_relations(r, ["page"], "row_id").select("row_id", "page", "unit_type", "related_row", "related_opcode")


GRID_SQL = """grids AS (SELECT p_size AS grid_id, [['Name', '', 'Brand', 'Note'], [max(p_name), '', min(p_brand), ''], [CASE WHEN p_size % 3 = 0 THEN '' ELSE min(p_type) END, '', '', CASE WHEN p_size % 4 = 0 THEN concat('a|b', chr(10), 'c<d') ELSE '' END], ['Note 1', '', CAST(count(*) AS VARCHAR), '']] AS grid FROM part GROUP BY p_size),
flat AS (SELECT grid_id, grid, len(list_filter(flatten(grid), lambda x: trim(x) <> '')) AS filled, len(list_filter(flatten(grid[2:]), lambda x: trim(x) <> '')) AS body, len(list_filter(grid[1], lambda x: trim(x) <> '')) AS head FROM grids),
rat AS (SELECT grid_id, grid, 1 - filled / 16 AS empty_ratio, head / 4 AS header_fill, body / 12 AS density, 1.0::DOUBLE AS consistency FROM flat)"""


def grids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_size").alias("grid_id")).agg(
        F.expr("array(array('Name', '', 'Brand', 'Note'), array(max(p_name), '', min(p_brand), ''), array(CASE WHEN any_value(p_size) % 3 = 0 THEN '' ELSE min(p_type) END, '', '', CASE WHEN any_value(p_size) % 4 = 0 THEN 'a|b\nc<d' ELSE '' END), array('Note 1', '', cast(count(*) as string), ''))").alias("grid")
    )


def measured(spark: SparkSession, d: str) -> DataFrame:
    return grids(spark, d).withColumns(op.ratios(F.col("grid")))


@query(f"""WITH {GRID_SQL} SELECT grid_id, empty_ratio, header_fill, density, consistency, greatest(0, least(0.35 * (1 - empty_ratio) + 0.2 * (1 - 0) + 0.15 * (header_fill + consistency + density) + 0.02 + 0, 1)) AS quality FROM rat""")
def table_quality(spark: SparkSession, d: str) -> DataFrame:
    q = op.quality(F.lit(0), F.size("grid"), F.lit(1), F.lit(0))
    return measured(spark, d).select("grid_id", "empty_ratio", "header_fill", "density", "consistency", q.alias("quality"))


@query(f"""WITH {GRID_SQL}, c AS (SELECT grid_id, list_sort(list_filter([CASE WHEN density < 0.3 THEN 'low_data_density' END, CASE WHEN empty_ratio > 0.55 THEN 'sparse_layout' END, CASE WHEN len(list_filter(flatten(grid), lambda x: contains(x, chr(10)))) > 0 THEN 'multiline_cell' END, CASE WHEN empty_ratio > 0.75 THEN 'ambiguous_grid' END], lambda x: x IS NOT NULL)) AS reasons FROM rat)
SELECT grid_id, array_to_string(reasons, ',') AS reasons, CASE WHEN len(reasons) = 0 THEN 'gfm' ELSE 'html' END AS mode FROM c""")
def table_complexity(spark: SparkSession, d: str) -> DataFrame:
    m = measured(spark, d).withColumn("reasons", op.complexity("grid"))
    return m.select("grid_id", F.array_join("reasons", ",").alias("reasons"), op.mode("auto", F.col("reasons")).alias("mode"))


@query(f"""WITH {GRID_SQL}, u AS (SELECT grid_id, grid, list_filter([1, 2, 3, 4], lambda i: len(list_filter(grid, lambda r: r[i] <> '')) > 0) AS used FROM grids), c AS (SELECT grid_id, list_transform(grid, lambda r: list_transform(used, lambda i: r[i])) AS g FROM u)
SELECT grid_id, CAST(len(g[1]) AS INT) AS width, array_to_string(list_transform(g, lambda r: array_to_string(r, '/')), ';') AS cells FROM c""")
def column_compaction(spark: SparkSession, d: str) -> DataFrame:
    c = grids(spark, d).withColumn("g", op.compact(op.rectangle(F.col("grid"))))
    return c.select("grid_id", F.size(F.col("g")[0]).alias("width"), F.array_join(F.transform("g", lambda r: F.array_join(r, "/")), ";").alias("cells"))


@query(f"""WITH {GRID_SQL}, e AS (SELECT grid_id, list_transform(grid, lambda r: list_transform(r, lambda x: replace(replace(x, chr(10), '<br>'), '|', '\\|'))) AS g,
list_transform(grid, lambda r: list_transform(r, lambda x: replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'))) AS h FROM grids)
SELECT grid_id, concat('| ', array_to_string(g[1], ' | '), ' |', chr(10), '| --- | --- | --- | --- |', chr(10), array_to_string(list_transform(g[2:], lambda r: concat('| ', array_to_string(r, ' | '), ' |')), chr(10))) AS gfm,
concat('<table><thead><tr>', array_to_string(list_transform(h[1], lambda x: concat('<th>', x, '</th>')), ''), '</tr></thead><tbody>', array_to_string(list_transform(h[2:], lambda r: concat('<tr>', array_to_string(list_transform(r, lambda x: concat('<td>', x, '</td>')), ''), '</tr>')), ''), '</tbody></table>') AS html FROM e""")
def table_render(spark: SparkSession, d: str) -> DataFrame:
    return grids(spark, d).select("grid_id", op.gfm("grid").alias("gfm"), op.html("grid").alias("html"))


@query(f"""WITH {GRID_SQL} SELECT grid_id, CAST(len(list_filter(grid, lambda r: NOT starts_with(lower(r[1]), 'note') AND len(list_filter(r, lambda x: trim(x) <> '')) > 0)) AS INT) AS n_rows,
array_to_string(list_transform(list_filter(grid, lambda r: starts_with(lower(r[1]), 'note')), lambda r: trim(array_to_string(list_filter(r, lambda x: trim(x) <> ''), ' '))), ';') AS notes FROM grids""")
def table_notes(spark: SparkSession, d: str) -> DataFrame:
    body, notes = op.split_notes(F.col("grid"))
    return grids(spark, d).select("grid_id", F.size(body).alias("n_rows"), F.array_join(notes, ";").alias("notes"))


@query("""WITH h AS (SELECT l_orderkey, list(l_shipmode ORDER BY n) AS hs FROM (SELECT l_orderkey, concat(l_returnflag, l_linestatus) AS l_shipmode, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) GROUP BY 1)
SELECT l_orderkey, array_to_string(list_transform(hs, lambda x, i: CASE WHEN len(list_filter(hs[:i], lambda y: y = x)) = 1 THEN x ELSE concat(x, ' ', len(list_filter(hs[:i], lambda y: y = x))) END), ',') AS headers FROM h""")
def header_unique(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("h", F.concat("l_returnflag", "l_linestatus"))
    g = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "h"))), lambda x: x["h"]).alias("hs"))
    return g.select("l_orderkey", F.array_join(op.unique_headers(F.col("hs")), ",").alias("headers"))


@query()
def grid_repair(spark: SparkSession, d: str) -> DataFrame:
    g = op.repaired(grids(spark, d), "grid")
    return g.select("grid_id", F.array_join(F.transform("grid", lambda r: F.array_join(r, "/")), ";").alias("cells"))


CAND_SQL = """cand AS (SELECT l_orderkey // 30 AS page, row_number() OVER (PARTITION BY l_orderkey // 30 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS candidate_id, CAST(l_suppkey % 4 * 50 AS DOUBLE) AS x0, CAST(l_partkey % 5 * 60 AS DOUBLE) AS top, CAST(l_suppkey % 4 * 50 + 40 + l_quantity AS DOUBLE) AS x1, CAST(l_partkey % 5 * 60 + 50 AS DOUBLE) AS bottom, l_discount * 5 AS quality, l_returnflag AS strategy FROM lineitem)"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    whole = table(spark, d, "lineitem")
    li = whole.withColumn("page", F.expr("l_orderkey div 30")).repartition(parts(whole), "page")
    return li.select(
        "page", F.row_number().over(Window.partitionBy("page").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("candidate_id"), (F.col("l_suppkey") % 4 * 50).cast("double").alias("x0"), (F.col("l_partkey") % 5 * 60).cast("double").alias("top"),
        (F.col("l_suppkey") % 4 * 50 + 40 + F.col("l_quantity")).alias("x1"), (F.col("l_partkey") % 5 * 60 + 50).cast("double").alias("bottom"), (F.col("l_discount") * 5).alias("quality"), F.col("l_returnflag").alias("strategy"),
    )


@query(f"""WITH {CAND_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY page, round(x0, 1), round(top, 1), round(x1, 1), round(bottom, 1) ORDER BY quality DESC, strategy, candidate_id) AS nth FROM cand),
r AS (SELECT page, candidate_id, row_number() OVER (PARTITION BY page ORDER BY quality + least(0.2 * (x1 - x0) * (bottom - top) / 484704.0::DOUBLE, 0.1) DESC, (x1 - x0) * (bottom - top) DESC, candidate_id) AS rank FROM b WHERE nth = 1) SELECT page, CAST(candidate_id AS INT) AS candidate_id, CAST(rank AS INT) AS rank FROM r WHERE rank <= 20""")
def candidate_rank(spark: SparkSession, d: str) -> DataFrame:
    return op.ranked(op.best_per_box(candidates(spark, d), ["page"]), ["page"], 484704.0).select("page", "candidate_id", "rank")


@query()
def candidate_prune(spark: SparkSession, d: str) -> DataFrame:
    return op.pruned(op.ranked(op.best_per_box(candidates(spark, d), ["page"]), ["page"], 484704.0), ["page"]).select("page", "candidate_id", "rank")


@query("""WITH t AS (SELECT o_custkey % 40 AS doc_id, o_custkey AS page, o_orderkey AS table_index, concat(o_orderstatus, '|', left(o_orderpriority, 1)) AS signature FROM orders),
c AS (SELECT *, coalesce(page - lag(page) OVER w = 1 AND signature = lag(signature) OVER w, false) AS continued FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY page, table_index))
SELECT doc_id, page, table_index, continued, CAST(sum(CASE WHEN continued THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY page, table_index) AS BIGINT) AS group_no FROM c""".replace("o_custkey AS page", "o_custkey // 40 AS page"))
def table_continuation(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("doc_id"), F.expr("o_custkey div 40").alias("page"), F.col("o_orderkey").alias("table_index"), F.concat("o_orderstatus", F.lit("|"), F.left("o_orderpriority", F.lit(1))).alias("signature"))
    return op.continuations(t, ["doc_id"]).drop("signature")
