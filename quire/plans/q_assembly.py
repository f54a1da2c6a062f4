"""Queries of merged chunks, inherited context, figure chunks, labels, lines,
record order and small parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sentence_list
from ..operators import assembly as op
from ..session import parts, table
from .corpus_data import GEO_SQL, ROWS_SQL, SPEC_SQL, geo, rows, spec
from .q_figures import FIG_SQL, figs
from .q_lines import PAGE
from .registry import query

CHUNKS = "SELECT doc_id, page * 100 + line_no AS ord, CASE WHEN line_no % 6 = 0 THEN 'table' ELSE 'text_block' END AS chunk_type, CASE WHEN line_no % 7 = 6 THEN '' ELSE concat(text, ' ') END AS text, concat('r', line_no % 3) AS ref, page % 2 AS section, CAST(floor(font_size) AS INT) * 4 AS priority, x0, top, x1, bottom FROM geo"
_OPEN = "(a.g < 0 OR (a.total + 2 + b.total + 3) // 4 > 12)"


@query(f"""WITH {GEO_SQL}, c AS ({CHUNKS}), n AS (SELECT *, CASE WHEN chunk_type = 'text_block' AND lag(chunk_type) OVER w = 'text_block' AND section = lag(section) OVER w THEN 0 ELSE 1 END AS opens FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY ord)), r AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY ord) AS run FROM n),
x AS (SELECT doc_id, run, list(ord ORDER BY ord) AS os, list_prepend(struct_pack(total := 0, g := -1, gs := []::INTEGER[]), list(struct_pack(total := CAST(length(trim(text)) AS INTEGER), g := 0, gs := []::INTEGER[]) ORDER BY ord)) AS xs FROM r GROUP BY ALL),
f AS (SELECT doc_id, run, os, list_reduce(xs, lambda a, b: struct_pack(total := CASE WHEN {_OPEN} THEN b.total ELSE a.total + 2 + b.total END, g := CASE WHEN {_OPEN} THEN a.g + 1 ELSE a.g END, gs := list_append(a.gs, CASE WHEN {_OPEN} THEN a.g + 1 ELSE a.g END))).gs AS gs FROM x),
p AS (SELECT doc_id, unnest(os) AS ord, unnest(gs) AS grp FROM f), m AS (SELECT r.*, grp FROM r JOIN p USING (doc_id, ord))
SELECT doc_id, min(ord) AS ord, arg_min(chunk_type, ord) AS chunk_type, coalesce(string_agg(trim(text), chr(10) || chr(10) ORDER BY ord) FILTER (trim(text) <> ''), '') AS text, array_to_string(list_sort(list(DISTINCT ref)), ',') AS refs, max(priority) AS priority, count(*) AS n_sources, min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom FROM m GROUP BY doc_id, run, grp""")
def merged_siblings(spark: SparkSession, d: str) -> DataFrame:
    c = spark.sql(CHUNKS.replace("FROM geo", "FROM {geo}"), geo=geo(spark, d))
    return op.merge_siblings(c, ["doc_id"], "ord", ["section"], 12).withColumn("refs", F.array_join(F.array_sort("refs"), ","))


@query(f"""WITH {ROWS_SQL}, r AS (SELECT row_id, table_id, CASE row_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'own' END AS caption, CASE WHEN row_id % 2 = 0 THEN row_id / 2 END AS confidence FROM tab), t AS (SELECT table_id, concat('Caption ', min(row_id)) AS caption, min(row_id) / 4 AS confidence FROM tab GROUP BY 1 HAVING min(row_id) % 5 > 0)
SELECT row_id, r.table_id, coalesce(nullif(r.caption, ''), t.caption) AS caption, coalesce(r.confidence, t.confidence) AS confidence FROM r LEFT JOIN t USING (table_id)""")
def inherited_context(spark: SparkSession, d: str) -> DataFrame:
    tab = rows(spark, d)
    r = tab.select("row_id", "table_id", F.expr("CASE row_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'own' END").alias("caption"), F.when(F.col("row_id") % 2 == 0, F.col("row_id") / 2).alias("confidence"))
    t = tab.groupBy("table_id").agg(F.min("row_id").alias("m")).filter("m % 5 > 0").select("table_id", F.concat(F.lit("Caption "), "m").alias("caption"), (F.col("m") / 4).alias("confidence"))
    return op.inherit(r, t, ["table_id"], ["caption", "confidence"])


@query(f"""WITH {ROWS_SQL}, p AS (SELECT row_id, [[headers[1], ' ', coalesce(headers[2], '')], ['', ''], [headers[1], coalesce(headers[2], '')], [concat(' ', headers[1])]] AS paths FROM tab)
SELECT row_id, array_to_string(list_filter([t1, CASE WHEN t2 <> t1 THEN t2 END], lambda x: x IS NOT NULL), ';') AS header_paths FROM (SELECT row_id, array_to_string(list_filter(list_transform(paths[1], lambda x: trim(x)), lambda x: x <> ''), ' / ') AS t1, trim(paths[4][1]) AS t2 FROM p)""")
def header_path_texts(spark: SparkSession, d: str) -> DataFrame:
    p = rows(spark, d).withColumn("paths", F.expr("array(array(headers[0], ' ', coalesce(get(headers, 1), '')), array('', ''), array(headers[0], coalesce(get(headers, 1), '')), array(concat(' ', headers[0])))"))
    return p.select("row_id", F.array_join(op.path_texts("paths"), ";").alias("header_paths"))


@query(f"""WITH {ROWS_SQL}, t AS (SELECT table_id, min(page) AS page, min(row_index) AS table_index, CASE WHEN min(row_id) % 2 = 0 THEN 'gfm' ELSE 'html' END AS source_mode, CASE WHEN min(row_id) % 3 = 0 THEN concat('g', min(page)) ELSE '' END AS grp, CASE WHEN min(row_id) % 4 > 0 THEN concat('Cap ', min(row_id)) END AS caption, arg_min(headers, row_id) AS headers FROM tab GROUP BY 1),
r AS (SELECT table_id, string_agg(concat('Row ', row_index, ': ', array_to_string(vals, ' | ')), chr(10) ORDER BY row_index) AS lines FROM tab WHERE row_id % 9 > 0 GROUP BY 1)
SELECT table_id, concat('<!-- table-rag: page=', page, ' index=', table_index, ' source=', source_mode, CASE WHEN grp <> '' THEN concat(' group=', grp) ELSE '' END, ' -->', chr(10), CASE WHEN caption IS NOT NULL THEN concat('Caption: ', caption) ELSE 'Caption:' END, chr(10), 'Headers: ', array_to_string(headers, ' | '), CASE WHEN lines IS NOT NULL THEN concat(chr(10), lines) ELSE '' END) AS markdown FROM t LEFT JOIN r USING (table_id)""")
def rag_table_markdown(spark: SparkSession, d: str) -> DataFrame:
    tab = rows(spark, d)
    m = tab.groupBy("table_id").agg(F.min("page").alias("page"), F.min("row_index").alias("table_index"), F.min("row_id").alias("m"), F.min_by("headers", "row_id").alias("headers"))
    t = m.withColumns({"source_mode": F.when(F.col("m") % 2 == 0, "gfm").otherwise("html"), "grp": F.when(F.col("m") % 3 == 0, F.concat(F.lit("g"), "page")).otherwise(""), "caption": F.when(F.col("m") % 4 > 0, F.concat(F.lit("Cap "), "m"))})
    return op.rag_markdown(t, tab.filter("row_id % 9 > 0").select("table_id", "row_index", F.array_join("vals", " | ").alias("row_text")), ["table_id"])


@query(f"""WITH {FIG_SQL}, s AS (SELECT *, caption_text <> '' AND coalesce(caption_confidence >= 0.65, true) AS sure FROM fig WHERE caption_text <> '' OR len(heading_path) > 0 OR len(detected_labels) > 0 OR len(nearby_texts) > 0)
SELECT figure_id, array_to_string(list_concat(list_filter([CASE WHEN caption_text <> '' THEN concat('caption: ', caption_text) END, CASE WHEN len(heading_path) > 0 THEN concat('heading_path: ', array_to_string(heading_path, ' > ')) END, concat('figure_kind: ', figure_kind), CASE WHEN len(detected_labels) > 0 THEN concat('detected_labels: ', array_to_string(detected_labels, ' | ')) END], lambda x: x IS NOT NULL), list_transform(nearby_texts, lambda x: concat('nearby_text: ', x))), chr(10)) AS text,
CAST(CASE WHEN sure AND diagram_candidate THEN 78 WHEN sure THEN 68 ELSE 44 END AS INT) AS priority, array_to_string(list_filter(['figure_text_boundary', CASE WHEN caption_text <> '' THEN 'observed_caption' END, CASE WHEN len(heading_path) > 0 THEN 'heading_context' END, 'figure_kind', CASE WHEN len(detected_labels) > 0 THEN 'detected_labels' END, CASE WHEN len(nearby_texts) > 0 THEN 'nearby_text' END, CASE WHEN NOT sure THEN 'captionless_or_low_confidence' END], lambda x: x IS NOT NULL), ',') AS reasons FROM s""")
def figure_chunks(spark: SparkSession, d: str) -> DataFrame:
    return op.figure_chunks(figs(spark, d)).withColumn("reasons", F.array_join("reasons", ","))


@query(f"""WITH {FIG_SQL}, c AS (SELECT figure_id, text, confidence FROM (SELECT figure_id, unnest(['port FIFO to DDR4', 'lower case', 'PHY-12 link', 'port FIFO to DDR4']) AS text, unnest([0.7, 0.9, CASE WHEN figure_id % 3 > 0 THEN figure_id % 10 / 10.0 END, 0.7])::DOUBLE AS confidence FROM fig WHERE figure_id % 4 > 0) GROUP BY ALL), l AS (SELECT *, regexp_extract_all(text, '{op.LABEL}') AS labels FROM c), g AS (SELECT *, len(labels) > 0 AND coalesce(confidence >= 0.65, false) AS good FROM l),
p AS (SELECT figure_id, flatten(list(labels) FILTER (good)) AS ocr, count(*) AS candidates, count(*) FILTER (good) AS promoted, count(*) FILTER (len(labels) = 0) AS without_label, count(*) FILTER (len(labels) > 0 AND NOT good) AS low_confidence FROM g GROUP BY 1),
j AS (SELECT figure_id, caption_text, list_sort(list_distinct(list_concat(regexp_extract_all(caption_text, '{op.LABEL}'), coalesce(ocr, []::VARCHAR[])))) AS labels, coalesce(candidates, 0) AS candidates, coalesce(promoted, 0) AS promoted, coalesce(without_label, 0) AS without_label, coalesce(low_confidence, 0) AS low_confidence FROM fig LEFT JOIN p USING (figure_id))
SELECT figure_id, array_to_string(labels, ',') AS labels, candidates, promoted, without_label, low_confidence, CASE WHEN caption_text <> '' THEN NULL WHEN len(labels) > 0 THEN 'captionless_promoted_labels' ELSE 'captionless_diagnostics_only' END AS captionless FROM j""")
def figure_label_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    f = figs(spark, d)
    found = [("port FIFO to DDR4", F.lit(0.7)), ("lower case", F.lit(0.9)), ("PHY-12 link", F.when(F.col("figure_id") % 3 > 0, (F.col("figure_id") % 10) / 10.0)), ("port FIFO to DDR4", F.lit(0.7))]
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("text"), c.cast("double").alias("confidence")) for t, c in found]))
    c = f.filter("figure_id % 4 > 0").select("figure_id", each.alias("c")).select("figure_id", "c.*")
    return op.label_diagnostics(f.select("figure_id", "caption_text"), c, "figure_id").withColumn("labels", F.array_join("labels", ","))


@query("""WITH r AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, CASE l_suppkey % 4 WHEN 0 THEN 'domain_unit' WHEN 1 THEN 'technical_table_unit' WHEN 2 THEN 'table_row' ELSE 'text_block' END AS t, CASE WHEN l_partkey % 5 > 0 THEN concat('s', l_partkey) ELSE '' END AS sid, CASE WHEN l_partkey % 3 > 0 THEN concat('t', l_suppkey) END AS tid FROM lineitem)
SELECT k, arg_max(sid, i) FILTER (t = 'domain_unit' AND sid <> '') AS domain_unit_id, arg_max(sid, i) FILTER (t = 'technical_table_unit' AND sid <> '') AS technical_table_unit_id, arg_max(sid, i) FILTER (t = 'table_row' AND sid <> '') AS table_row_id, arg_max(tid, i) FILTER (t = 'table_row' AND tid IS NOT NULL) AS table_id FROM r GROUP BY k""")
def source_locators(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.expr("CASE l_suppkey % 4 WHEN 0 THEN 'domain_unit' WHEN 1 THEN 'technical_table_unit' WHEN 2 THEN 'table_row' ELSE 'text_block' END").alias("source_type"), F.when(F.col("l_partkey") % 5 > 0, F.concat(F.lit("s"), "l_partkey")).otherwise("").alias("source_id"), F.when(F.col("l_partkey") % 3 > 0, F.concat(F.lit("t"), "l_suppkey")).alias("table_id")).alias("r"))
    return r.groupBy("k").agg(F.array_sort(F.collect_list("r")).alias("refs")).select("k", *[c.alias(n) for n, c in op.locators("refs").items()])


CHARS_SQL = "ch AS (SELECT doc_id, page, line_no, i AS char_no, CASE WHEN (line_no + i) % 3 = 0 THEN 9.5 ELSE font_size END::DOUBLE AS font_size, CASE WHEN line_no % 5 > 0 THEN CASE (line_no + i // 2) % 4 WHEN 0 THEN 'Helvetica' WHEN 1 THEN 'Arial-BoldItalic' WHEN 2 THEN 'CourierNew' ELSE 'Heavy-Oblique' END END AS font_name FROM (SELECT *, unnest(range(0, 5)) AS i FROM geo))"


@query(f"""WITH {GEO_SQL}, {CHARS_SQL}, s AS (SELECT doc_id, page, line_no, font_size FROM (SELECT doc_id, page, line_no, font_size, count(*) AS n, min(char_no) AS f FROM ch GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id, page, line_no ORDER BY n DESC, f) = 1), f AS (SELECT doc_id, page, line_no, font_name, lower(font_name) AS low FROM (SELECT doc_id, page, line_no, font_name, count(*) AS n, min(char_no) AS f FROM ch WHERE font_name IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id, page, line_no ORDER BY n DESC, f) = 1)
SELECT g.doc_id, g.page, g.line_no, s.font_size, font_name, CASE WHEN font_name IS NOT NULL THEN coalesce(nullif(concat_ws('+', CASE WHEN regexp_matches(low, 'courier|mono|code') THEN 'monospace' END, CASE WHEN regexp_matches(low, 'bold|black|heavy') THEN 'bold' END, CASE WHEN regexp_matches(low, 'italic|oblique') THEN 'italic' END), ''), 'regular') END AS style_hint,
round(greatest(bottom - top, 0), 2) AS line_height, round(greatest(x0, 0), 2) AS left_indent, round(greatest(120 - x1, 0), 2) AS right_indent, CASE WHEN bottom <= 36 THEN 'top' WHEN top >= 164 THEN 'bottom' ELSE 'middle' END AS y_band FROM geo g LEFT JOIN s USING (doc_id, page, line_no) LEFT JOIN f USING (doc_id, page, line_no)""")
def line_metadata(spark: SparkSession, d: str) -> DataFrame:
    keys = [*PAGE, "line_no"]
    lines = geo(spark, d).repartition(parts(table(spark, d, "lineitem")), *keys)
    i, n = F.col("char_no"), F.col("line_no")
    ch = lines.select(*keys, "font_size", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("char_no"))
    name = F.expr("CASE WHEN line_no % 5 > 0 THEN CASE (line_no + char_no div 2) % 4 WHEN 0 THEN 'Helvetica' WHEN 1 THEN 'Arial-BoldItalic' WHEN 2 THEN 'CourierNew' ELSE 'Heavy-Oblique' END END")
    chars = ch.select(*keys, "char_no", F.when((n + i) % 3 == 0, 9.5).otherwise(F.col("font_size")).alias("font_size"), name.alias("font_name"))
    return op.line_metadata(lines.drop("font_size"), chars, keys, 120.0, 200.0)


@query()
def reference_sentences(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import semantics

    s = spec(spark, d)
    refs = semantics.reference_rows(s, ["unit"]).join(s, "unit")
    return refs.select("unit", "target_type", "label", op.sentence_at("text", sentence_list(F.col("text")), "start", "end").alias("sentence"))


@query("""SELECT l_orderkey AS doc_id, id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY coalesce(page, 0), coalesce(top, 1000000), id) AS INT) AS place FROM (SELECT l_orderkey, CASE WHEN l_partkey % 6 > 0 THEN CAST(l_linenumber AS INT) END AS page, CASE WHEN l_partkey % 5 > 0 THEN l_quantity END AS top, concat('r-', l_partkey, '-', l_suppkey, '-', l_linenumber, '-', l_extendedprice) AS id FROM lineitem)""")
def manifest_order(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_partkey") % 6 > 0, F.col("l_linenumber")).alias("page"), F.when(F.col("l_partkey") % 5 > 0, F.col("l_quantity")).alias("top"), F.concat_ws("-", F.lit("r"), "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice").alias("id"))
    return op.in_record_order(r, ["doc_id"]).select("doc_id", "id", "place")


@query("""WITH w AS (SELECT o_custkey AS doc_id, unnest([o_orderkey % 7, o_orderkey % 11, o_orderkey % 13]) AS p FROM orders) SELECT doc_id, array_to_string(list_sort(list(DISTINCT p)), ',') AS pages, CAST(count(DISTINCT p) AS INT) AS n_pages FROM w GROUP BY 1""")
def merged_window_pages(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    w = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.array(k % 7, k % 11, k % 13).alias("p"))
    return op.merged_pages(w, ["doc_id"], "p").withColumn("pages", F.array_join(F.transform("pages", lambda x: x.cast("string")), ","))


@query("""WITH x AS (SELECT p_partkey, unnest([p_name, '', p_brand]) AS t, unnest([CAST(p_size AS VARCHAR), '1', '-1']) AS c, unnest([1, 2, 3]) AS i FROM part) SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY i) - 1 AS INT) AS word_no, trim(t) AS text, c AS conf FROM x WHERE trim(t) <> ''""")
def tsv_words(spark: SparkSession, d: str) -> DataFrame:
    payload = F.concat_ws("\n", F.lit("level\ttext\tconf"), F.concat(F.lit("1\t "), "p_name", F.lit(" \t"), "p_size"), F.lit("1\t \t1"), F.concat(F.lit("1\t"), "p_brand", F.lit("\t-1")))
    return op.tsv_words(table(spark, d, "part").select("p_partkey", payload.alias("payload")), "p_partkey", "payload")


@query(f"""WITH {SPEC_SQL}, m AS (SELECT page, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS k, arg_max(concat('kind-', unit % 5), unit) AS kind FROM (SELECT unit, page, CASE WHEN unit % 2 = 0 THEN upper(text) ELSE text END AS text FROM spec WHERE unit % 3 > 0 UNION ALL SELECT unit + 1000000, page, text FROM spec WHERE unit % 6 = 1) GROUP BY ALL)
SELECT unit, kind FROM spec LEFT JOIN m ON spec.page = m.page AND lower(trim(regexp_replace(spec.text, '\\s+', ' ', 'g'))) = m.k""")
def review_markers(spark: SparkSession, d: str) -> DataFrame:
    s = spec(spark, d)
    a = s.filter("unit % 3 > 0").select("unit", "page", F.when(F.col("unit") % 2 == 0, F.upper("text")).otherwise(F.col("text")).alias("text"))
    b = s.filter("unit % 6 = 1").select((F.col("unit") + 1000000).alias("unit"), "page", "text")
    m = a.unionAll(b).withColumn("kind", F.concat(F.lit("kind-"), F.col("unit") % 5))
    return op.last_marker(s, m, ["page"], "text", "unit", "kind").select("unit", "kind")


@query("""SELECT o_orderkey, strftime(CASE o_orderkey % 4 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate WHEN 2 THEN o_orderdate END, '%Y-%m-%d') AS iso FROM orders""")
def iso_dates(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    text = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("on "), F.date_format(day, "yyyy-MM-dd"), F.lit("."))).when(F.col("o_orderkey") % 4 == 1, F.date_format(day, "yyyy/M/d")).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("dated "), F.date_format(day, "d MMMM yyyy"))).otherwise(F.lit("2023-02-31 or 12 Foo 2020"))
    return table(spark, d, "orders").select("o_orderkey", text.alias("t")).select("o_orderkey", op.iso_date("t").alias("iso"))


@query()
def sequence_similarity(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", op.similarity("p_name", "p_type").alias("ratio"))


@query(f"""WITH {ROWS_SQL} SELECT row_id AS chunk_id, array_to_string(vals, ' ') AS text, concat('doc-', page) AS document_id, page AS page_number, table_id AS section_title, 'table_row' AS chunk_type, row_index AS priority FROM tab WHERE row_id % 7 > 0""")
def agent_records(spark: SparkSession, d: str) -> DataFrame:
    c = rows(spark, d).filter("row_id % 7 > 0").select(F.col("row_id").alias("chunk_id"), F.array_join("vals", " ").alias("text"), "page", F.col("table_id").alias("section_path"), F.lit("table_row").alias("chunk_type"), F.col("row_index").alias("priority"))
    s = c.select(op.agent_shape(F.concat(F.lit("doc-"), "page"), ["chunk_type", "priority"]).alias("a"))
    return s.select("a.chunk_id", "a.text", "a.citation.document_id", "a.citation.page_number", "a.citation.section_title", "a.metadata.chunk_type", "a.metadata.priority")
